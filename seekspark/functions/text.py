"""Text functions, all column expressions: tokenizers, similarities, length estimates, language class.

The tokenizers differ on purpose: each scoring method is defined on its own notion of a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
HANGUL = "[가-힣]"


def longer(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda x: F.length(x) > n)


def service_tokens(c: Column) -> Column:
    """Words of lower-cased text; beside Hangul, runs of it are words of their own. Over one character."""
    low = F.lower(c)
    return longer(F.when(c.rlike(HANGUL), F.regexp_extract_all(low, F.lit(f"{HANGUL}+|{WORD}"), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0))), 1)


def sparse_tokens(c: Column) -> Column:
    """Lower-cased text split at what is no word character. Over one character."""
    return longer(F.split(F.lower(c), NON_WORD), 1)


def rerank_tokens(c: Column) -> Column:
    """Lower-cased text split at white space and . , ; : ! ?, over one character; hyphens and quotes stay."""
    return longer(F.split(F.lower(c), r"[ \t\n\r.,;:!?]"), 1)


def analyzer_tokens(c: Column) -> Column:
    """Lower-cased text split at white space and . , ; : ! ? ( ) and quotes, any length."""
    return longer(F.split(F.lower(c), r"[\s.,;:!?()\"']"), 0)


def query_terms(c: Column) -> Column:
    """Text as it is, split at white space and , . ! ?, over two characters."""
    return longer(F.split(c, r"[ \t\n,.!?]"), 2)


def space_tokens(c: Column) -> Column:
    return longer(F.split(c, " "), 0)


def space_parts(c: Column) -> Column:
    """Split at single spaces, empty parts and all."""
    return F.split(c, " ")


def tokens_floor(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def tokens_ceil(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def tokens_words(c: Column) -> Column:
    return (F.size(space_tokens(c)) * 0.75).cast("int")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f names it, also inside of f's own functions of elements."""
    return F.transform(F.array(value), f)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty, or one is null."""
    share = lambda p: F.size(F.array_intersect(p.a, p.b)) / F.greatest(F.lit(1), F.size(F.array_union(p.a, p.b)))
    return F.coalesce(once(F.struct(a.alias("a"), b.alias("b")), share), F.lit(0.0))


def keyword_score(content: Column, keyword: str) -> Column:
    """Occurrences of the keyword, any case and not overlapping, for each space-separated part."""
    low = F.lower(content)
    hits = (F.length(low) - F.length(F.replace(low, F.lit(keyword.lower()), F.lit("")))) / F.lit(len(keyword))
    return hits / F.size(space_parts(content))


def relevance(content: Column, query: Column) -> Column:
    """Share of the query's words, repeats counted, that are words of the content."""
    q, c = space_tokens(F.lower(query)), space_tokens(F.lower(content))
    return once(F.struct(q.alias("q"), c.alias("c")), lambda p: F.size(F.filter(p.q, lambda x: F.array_contains(p.c, x))) / F.greatest(F.lit(1), F.size(p.q)))


def script_class(c: Column) -> Column:
    korean, latin = c.rlike(HANGUL), c.rlike("[a-zA-Z]")
    return F.when(korean & latin, "Mixed").when(korean, "Korean").when(latin, "English").otherwise("Other")


def has_any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def count_in(tokens: Column, words: list[str]) -> Column:
    """How many tokens, repeats counted, are among the words."""
    return F.size(F.filter(tokens, lambda x: x.isin(words)))


def contains_any(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out

"""Chunkers: a document becomes rows (document_id, chunk_index, content). No Python is run for any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, tokens_floor


#: Windows that are taken from one stretch of a text: a window is found by counting characters from where its text begins.
RUN = 16


def fixed(c: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of `size` characters that share `overlap`; text of at most `size` is one chunk.

    Windows are taken from stretches of RUN windows, not each from the whole text, which would take the square of its length.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - overlap) / step).cast("int") - 1)

    def stretch(b: Column, last: Column) -> Column:
        places = F.sequence(F.lit(0), F.least(last - b * RUN, F.lit(RUN - 1)))
        return once(F.substring(c, b * (RUN * step) + 1, F.lit(RUN * step + overlap)), lambda t: F.transform(places, lambda i: F.substring(t, i * step + 1, F.lit(size))))

    return once(last, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / RUN).cast("int")), lambda b: stretch(b, n))))


#: Pieces of one inner fold.
BLOCK = 256


def _greedy(pieces: Column, size: int, keep: int, join: str) -> Column:
    """A fold over lengths: pieces are gathered until the next would pass `size`; then a chunk is closed and its last `keep` go on.

    A piece counts with one character after it. The fold moves numbers only, and few of them, as it is interpreted: lengths are
    computed once before it, and those of the last `keep` pieces are looked up when a chunk is closed. A fold
    copies its state at every step, so it runs over blocks of pieces, within which the state holds the block's own cuts only;
    the pieces are bound once, outside of it. The time is in proportion to the text.
    """
    none = F.array().cast("array<struct<a: int, b: int>>")
    cut = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def state(cuts: Column, start: Column, used: Column, n: Column) -> Column:
        return F.struct(cuts.alias("cuts"), start.alias("start"), used.alias("used"), n.alias("n"))

    def folded(lengths: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            again = F.least(F.lit(keep), s.n)
            left = F.aggregate(F.slice(lengths, s.n - again + 1, again), F.lit(0), lambda t, y: t + y) if keep else F.lit(0)
            closed = state(F.array_append(s.cuts, cut(s.start, s.n)), s.n - again, left + x, s.n + 1)
            return F.when((s.used + x > size) & (s.n > s.start), closed).otherwise(state(s.cuts, s.start, s.used + x, s.n + 1))

        def block(s: Column, i: Column) -> Column:
            joined = lambda t: state(F.concat(s.cuts, t.cuts), t.start, t.used, t.n)
            return F.aggregate(F.slice(lengths, i * BLOCK + 1, BLOCK), state(none, s.start, s.used, s.n), step, joined)

        blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int"))
        done = lambda s: F.when(s.n > s.start, F.array_append(s.cuts, cut(s.start, s.n))).otherwise(s.cuts)
        return F.aggregate(blocks, state(none, F.lit(0), F.lit(0), F.lit(0)), block, done)

    def chunks(p: Column) -> Column:
        cuts = once(F.transform(p, lambda x: F.length(x) + 1), folded)
        return F.transform(cuts, lambda c: F.array_join(F.slice(p, c.a + 1, c.b - c.a), join))

    return once(pieces, lambda p: F.when(p.isNotNull(), chunks(p)))


def words(c: Column, size: int = 512, overlap: int = 64) -> Column:
    """Words gathered to at most `size` characters, each counted with a space; the last `overlap` / 10 words are repeated."""
    return _greedy(F.filter(F.split(c, r"[ \t\r\n]+"), lambda x: x != ""), size, overlap // 10, " ")


def sentences(c: Column, size: int = 200, least: int = 0) -> Column:
    """Sentences gathered to at most `size` characters; the last one is repeated. A mark before a small letter ends none.

    A last chunk of fewer than `least` characters is left out, unless it is the only one.
    """
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?\n])(?!\p{Ll})"), lambda x: F.trim(x)), lambda x: x != "")
    out = _greedy(parts, size, 1, " ")
    if not least:
        return out
    return F.transform(F.array(out), lambda a: F.when((F.size(a) > 1) & (F.length(F.element_at(a, -1)) < least), F.slice(a, 1, F.size(a) - 1)).otherwise(a))[0]


def paragraphs(c: Column, size: int = 512, overlap: int = 0) -> Column:
    """Paragraphs (between blank lines) gathered to at most `size` characters."""
    parts = F.filter(F.transform(F.split(c, r"\n[ \t]*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _greedy(parts, size, 1 if overlap else 0, "\n\n")


def auto(c: Column, size: int = 512, overlap: int = 64) -> Column:
    """Paragraphs where the text has any, sentences where it has marks, else windows of characters."""
    return F.when(c.rlike(r"\n[ \t]*\n"), paragraphs(c, size)).when(c.rlike(r"[.!?]"), sentences(c, size)).otherwise(fixed(c, size, overlap))


#: By name; `semantic` has no splitter of its own and takes sentences. Others can be added: a function Column -> Column of an array of texts.
CHUNKERS = {"fixed": fixed, "words": words, "sentences": sentences, "paragraphs": paragraphs, "semantic": sentences, "auto": auto}


def chunk(docs: DataFrame, strategy: str = "fixed", **options: int) -> DataFrame:
    """chunk_id, document_id, chunk_index, total_chunks, content, token_count, metadata of documents (doc_id, text, lang, source)."""
    pieces = docs.select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"), CHUNKERS[strategy](F.col("text"), **options).alias("pieces"))
    # outer, and empty ones left out afterwards: else Spark cuts each text once more before, to see whether it has any piece
    flat = pieces.select("doc_id", "metadata", F.size("pieces").alias("total_chunks"), F.posexplode_outer("pieces").alias("chunk_index", "content")).where("chunk_index is not null")
    return flat.select(
        F.concat_ws("#", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_id"), "chunk_index", "total_chunks", "content", tokens_floor(F.col("content")).alias("token_count"), "metadata"
    )

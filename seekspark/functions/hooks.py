"""What a user can plug in, by name: embedders, completions, rerankers. Built-in ones need no model, and run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import space_tokens

DIMS = 16


def counted_words(c: Column, dims: int = DIMS) -> Column:
    """A vector of length 1 that counts words by a small hash; blank text has an empty one. Equal texts have equal vectors."""
    words = F.filter(F.transform(space_tokens(F.lower(c)), lambda w: F.pmod(F.ascii(w) + F.length(w), F.lit(dims))), lambda x: x.isNotNull())
    # arrays of one hold what is used several times, so that it is computed once
    count = lambda ws: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(ws, lambda x: x == i)).cast("double"))
    norm = lambda n: F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x))
    counts = F.transform(F.array(words), count)
    unit = F.transform(F.transform(counts, lambda n: F.struct(n.alias("n"), norm(n).alias("l"))), lambda p: F.transform(p.n, lambda x: x / F.when(p.l > 0, p.l)))
    return F.when(F.trim(c) != "", unit[0]).otherwise(F.array().cast("array<double>"))


#: text column -> vector column. A model is a pandas UDF of that shape.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"counted_words": counted_words}
#: prompt column -> text column. The built-in one gives back the prompt's first line.
COMPLETIONS: dict[str, Callable[[Column], Column]] = {"echo": lambda c: F.element_at(F.split(c, "\n"), 1)}
#: candidates (qid, doc_id, score, rank, ...) -> the same with other scores. Remote models are registered like any other.
RERANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"none": lambda candidates: candidates}


def register(kind: dict, name: str, hook: Callable) -> None:
    """Adds a hook, or replaces one of that name."""
    if not callable(hook):
        raise TypeError(f"{name!r} is not callable")
    kind[name] = hook


def embedded(rows: DataFrame, text: str = "content", name: str = "counted_words") -> DataFrame:
    """Adds `vec`. Each distinct text is embedded once, and rows find theirs by the text."""
    once = rows.select(text).where(F.col(text).isNotNull()).distinct()
    return rows.join(once.withColumn("vec", EMBEDDERS[name](F.col(text))), text, "left")

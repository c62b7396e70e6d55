"""A table as files that arrive one after the other, so that streams meet what streams meet: empty files, late rows and rows too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import place


def slots(rows: DataFrame, at: str, parts: int) -> DataFrame:
    """Adds `slot` (which of `parts` spans of whole days) and `edge` (the midnight at which the slot ends)."""
    day = F.to_date(F.col(at).cast("timestamp"))
    ends = rows.agg(F.min(day), F.max(day)).first()
    first = F.lit(ends[0]).cast("date")
    days = (ends[1] - ends[0]).days + 1 if ends[0] else 1
    slot = F.floor(F.datediff(day, first) * parts / days).cast("int")
    edge = F.date_add(first, F.ceil((slot + 1) * days / parts).cast("int"))
    return rows.withColumns({"slot": slot, "edge": edge.cast("timestamp")})


def feed(rows: DataFrame, at: str, late: Column | None = None, parts: int = 4) -> str:
    """The folder of the files: one for each of `parts` spans of days, an empty one after the second, and two for what is left.

    A row comes `late` files (0, 1 or 2) later than its span; `late` may use `edge`, the end of the span.
    """
    path = place(rows.sparkSession, "feed")
    placed = slots(rows, at, parts)
    placed = placed.withColumn("slot", F.col("slot") + F.coalesce(late, F.lit(0))) if late is not None else placed
    for i in range(parts + 2):
        placed.where(F.col("slot") == i).drop("slot", "edge").coalesce(1).write.mode("append").parquet(path)
        if i == 1:
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path


def arriving(rows: DataFrame, at: str, late: Column | None = None, parts: int = 4) -> DataFrame:
    """A stream of the table, a file in each micro-batch."""
    path = feed(rows, at, late, parts)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

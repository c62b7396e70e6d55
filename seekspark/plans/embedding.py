"""Embedding by a model that takes batches of texts: each text once, in batches, with a cache between runs; what fails is kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

BATCH, TTL = 50, "24 hours"
#: What a cache is: the hash of a text, its vector and when it was made.
CACHE = "hash string, vec array<double>, created timestamp"
Model = Callable[[list[str]], list[list[float]]]


def embed(rows: DataFrame, model: Model, as_of: str, cache: DataFrame | None = None, text: str = "content", batch: int = BATCH, ttl: str = TTL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with `vec` and `cached`, the cache's next state, rejects: hash and error).

    Texts that the cache holds, not older than `ttl`, are not embedded again. A batch that fails is tried again text by text, so
    one bad text takes no other with it. Blank and null texts have no vector and are no rejects.
    """
    spark = rows.sparkSession
    now = F.lit(as_of).cast("timestamp")
    hashed = rows.withColumn("_hash", F.when(F.trim(text) != "", F.sha2(text, 256)))
    live = (cache if cache is not None else spark.createDataFrame([], CACHE)).where(F.col("created") > now - F.expr(f"interval {ttl}"))
    once = hashed.where("_hash is not null").groupBy(F.col("_hash").alias("hash")).agg(F.first(text).alias("text"))
    new = kept(once.join(live.select("hash"), "hash", "left_anti").mapInArrow(_batches(model, batch), "hash string, vec array<double>, error string"), "embedded")
    state = live.unionByName(new.where("vec is not null").select("hash", "vec", now.alias("created")))
    found = live.select(F.col("hash").alias("_hash"), "vec", F.lit(True).alias("cached")).unionByName(new.where("vec is not null").select(F.col("hash").alias("_hash"), "vec", F.lit(False).alias("cached")))
    return hashed.join(found, "_hash", "left").drop("_hash"), state, new.where("error is not null").select("hash", "error")


def _batches(model: Model, size: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts = [], []

        def done() -> pa.RecordBatch:
            try:
                vecs, errors = model(texts), [None] * len(texts)
                if len(vecs) != len(texts):
                    raise ValueError(f"{len(vecs)} vectors for {len(texts)} texts")
            except Exception as e:  # whatever a model raises
                vecs, errors = [None] * len(texts), [str(e)] * len(texts)
                for i, t in enumerate(texts if len(texts) > 1 else []):
                    try:
                        (vecs[i],), errors[i] = model([t]), None
                    except Exception as one:
                        errors[i] = str(one)
            vecs = [None if v is None else [float(x) for x in v] for v in vecs]
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(vecs, pa.list_(pa.float64())), pa.array(errors, pa.string())], ["hash", "vec", "error"])

        for b in arrow:
            for h, t in zip(b.column(0), b.column(1), strict=True):  # a batch from Spark holds far more texts than the model takes
                hashes.append(h.as_py()), texts.append(t.as_py())
                if len(texts) == size:
                    yield done()
                    hashes, texts = [], []
        if texts:
            yield done()

    return run

"""The corpus pipeline: language ID, line dedup, near-duplicates, mixing, sampled pieces, over the table `documents`.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame with the columns
of documents (the last: the pieces). `run` writes each stage's result as Parquet in the shared folder and reads it again, and drops
what the stage and the one before it had written there.

Defined results, by stage. Null texts, and texts without a letter, go with the language stage, as they have none. Rows with a null
doc_id are documents like others. Repeated rows: line dedup takes them as one place and leaves them alike; near-dedup keeps one of
them. A text that line dedup empties goes. An empty table stays empty. Columns beyond those of documents pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm import lang_id, line_dedup, mixing, near_dedup, sample_pieces
from seekspark.llm.common import Scratch

#: A document's language must get this share of the probability; four even languages get 0.25 each.
LEAST_LANGUAGE = 0.4


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents again, n_chars by the text as it is now."""
    n = {"n_chars": F.length("text").cast("long")} if "n_chars" in like.columns else {}
    return docs.withColumns(n).select(*like.columns) if n else docs.select(*like.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that the network is somewhat sure of."""
    net = lang_id.fit(docs.where(~lang_id.fold(docs)).select("doc_id", "text", "lang"))
    named = lang_id.predict(docs.select("text", F.struct(*docs.columns).alias("row")), net, ["row"])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines of 20 words; a document that loses its whole text goes."""
    out = line_dedup.line_dedup(docs, Scratch(spark, "lines"))
    return _sized(out.where("lines_removed = 0 or trim(text) <> ''"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest doc_id, of each group of near-duplicates (similarity 0.8)."""
    return near_dedup.one_each(docs, Scratch(spark, "near"), percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: not at all, or once to three times."""
    return mixing.mixture(docs, Scratch(spark, "mixed"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and a checksum of the sampled pieces, and whether they spell the text (they always do)."""
    return sample_pieces.encode_checked(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixed), ("pieces", pieces)]

#: The language network, MinHash, the sampled mix and pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, others = scratch.last, list(Scratch.live)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        for x in [x for x in Scratch.live if x not in others]:
            x.drop()
        if before:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

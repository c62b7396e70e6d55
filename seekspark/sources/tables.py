"""Document and chunk tables: scans, lookups, and changes as joins that give the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("Pending", "Processing", "Indexed", "Failed", "Deleted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vec)."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id doc_id", "embedding vec")


def hybrid_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their vector where they have one: (doc_id, text, vec).

    Where ids of vectors are unique the plan is told so: what asks for texts alone then has no join, and no text is shuffled to
    meet a vector that is not needed.
    """
    v = vectors(spark, sf_dir)
    again = v.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        v = v.dropDuplicates(["doc_id"])
    return documents(spark, sf_dir).select("doc_id", "text").join(v, "doc_id", "left")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries with the vector of the same number: (qid, text, vec)."""
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id qid", "text")
    return items.join(vectors(spark, sf_dir).withColumnRenamed("doc_id", "qid"), "qid")


def status(docs: DataFrame) -> DataFrame:
    """A status for documents that have none: Failed without text, Pending if short, else Indexed."""
    return docs.withColumn("status", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "Failed").when(F.length("text") < 100, "Pending").otherwise("Indexed"))


def keyword_scan(docs: DataFrame, keyword: str, k: int) -> DataFrame:
    """The first k documents, by id, whose text or name has the keyword in any case."""
    return docs.where(F.contains(F.lower("text"), F.lit(keyword.lower())) | F.contains(F.lower("source"), F.lit(keyword.lower()))).orderBy("doc_id").limit(k)


def get_many(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids, key, "left_semi")


def insert_absent(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return rows.unionByName(new.join(rows.select(key), key, "left_anti"))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def update_present(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` that the table has not are ignored."""
    return upsert(rows, new.join(rows.select(key), key, "left_semi"), key)


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def append_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Adds chunks (document_id, content, position) after each document's last, and corrects the totals."""
    last = chunks.groupBy("document_id").agg((F.max("chunk_index") + 1).alias("next"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("position")) - 1
    more = new.withColumn("place", place).join(last, "document_id", "left").select("document_id", (F.coalesce("next", F.lit(0)) + F.col("place")).alias("chunk_index"), "content")
    both = chunks.select("document_id", "chunk_index", "content").unionByName(more)
    return both.withColumn("total_chunks", F.count("*").over(Window.partitionBy("document_id")).cast("int"))


def nested(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its chunks in order."""
    own = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    return docs.join(own, docs.doc_id == own.document_id, "left").drop("document_id")


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks with the content before and after."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.withColumns({"previous": F.lag("content").over(w), "following": F.lead("content").over(w)})


def quarantine(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid chunks, and those with a blank id or content, or an index out of range."""
    ok = F.coalesce((F.trim("chunk_id") != "") & (F.trim("content") != "") & (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("total_chunks")), F.lit(False))
    return chunks.where(ok), chunks.where(~ok)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Stores chunks so that a document's are together in a file, in order; readers skip by document_id."""
    chunks.repartitionByRange("document_id").sortWithinPartitions("document_id", "chunk_index").write.mode(mode).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Takes all rows out of a stored table; its columns stay."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

"""Web pages and files as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles and tags, white space collapsed."""
    plain = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"[ \t\r\n\x0B\f]+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def document_id(url: Column) -> Column:
    """web_<host>_<path>, with / . - as underscores, in lower case."""
    return F.concat(F.lit("web_"), F.lower(F.translate(F.concat(host(url), F.lit("_"), F.regexp_replace(path(url), "^/", "")), "/.-", "___")))


def file_name(url: Column) -> Column:
    """The last part of the path, or the host with .html."""
    last = F.regexp_extract(path(url), r"([^/]+)$", 1)
    return F.when(last != "", last).otherwise(F.concat(host(url), F.lit(".html")))


def web_documents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, lang, source, metadata) of pages (page_id, url, html), and the pages that gave no text."""
    html = F.col("html")
    rows = pages.select(
        "page_id", document_id(F.col("url")).alias("doc_id"), visible_text(html).alias("text"), F.lit(None).cast("string").alias("lang"), F.col("url").alias("source"),
        F.create_map(F.lit("source_url"), F.col("url"), F.lit("source_type"), F.lit("web"), F.lit("wf_title"), title(html), F.lit("content_type"), F.lit("text/html")).alias("metadata"),
    )
    ok = F.coalesce(F.length("text") > 0, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def web_chunks(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    return chunk(web_documents(pages)[0], "fixed", size=size, overlap=overlap)


def file_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, text, lang, source, metadata) of text files, one document each."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("source"))
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    meta = F.create_map(F.lit("source_file"), name, F.lit("source_type"), F.lit("file"), F.lit("file_extension"), F.regexp_extract("source", r"(\.[^./]+)$", 1))
    return whole.select(F.xxhash64("source").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", meta.alias("metadata"))


def prefixed(metadata: Column, prefix: str) -> Column:
    """The map with a prefix before each key."""
    return F.transform_keys(metadata, lambda k, _: F.concat(F.lit(prefix), k))


EXTENSIONS = (".txt", ".md", ".csv", ".json", ".html")


def parsed_files(files: DataFrame, size: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of files (path, content), as `binaryFile` reads them: one bad file stops nothing.

    Chunks are (document_id, chunk_index, content, metadata); metadata has the file's name and type, and of the chunk its place, under
    names that begin with ff_. Rejects are (path, reason): an unknown extension, bytes that are no UTF-8, or no text.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~extension.isin(*EXTENSIONS), "extension").when(~F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False)), "encoding")
    reason = reason.when(~F.col("content").cast("string").rlike(r"[^ \t\r\n]"), "empty")
    rows = files.select("path", F.col("content").cast("string").alias("text"), extension.alias("extension"), reason.alias("reason"))
    good = rows.where("reason is null").select(F.xxhash64("path").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.col("path").alias("source"), "extension")
    cut = chunk(good, "fixed", size=size, overlap=overlap).join(good.select(F.col("doc_id").alias("document_id"), F.col("source").alias("path"), "extension"), "document_id")
    start = F.col("chunk_index") * (size - overlap)
    own = {"chunk_id": F.concat_ws("#", "document_id", "chunk_index"), "chunk_index": F.col("chunk_index"), "strategy": F.lit("fixed"), "start_char": start, "end_char": start + F.length("content")}
    chunk_meta = prefixed(F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v.cast("string")))), "ff_")
    file_meta = F.create_map(F.lit("source_file"), F.regexp_extract("path", r"([^/]+)$", 1), F.lit("source_type"), F.lit("file"), F.lit("file_extension"), F.col("extension"))
    return cut.select("document_id", "chunk_index", "content", F.map_concat(file_meta, chunk_meta).alias("metadata")), rows.where("reason is not null").select("path", "reason")

"""Readers and writers of documents, corpora and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.office import OFFICE_SUFFIXES
from eventloom.sources.office import decode as decode_office

TEXT_SUFFIXES = ("md", "markdown", "txt", "html", "htm", "csv", "json", "xml")
#: Read as bytes; for other formats than Office's a decoder must be given to read_files().
BINARY_SUFFIXES = ("docx", "doc", "pptx", "ppt", "xlsx", "xls", "pdf", "png", "jpg", "jpeg")


def html_to_text(html):
    """Title and body of a page as text: scripts, styles and tags go, blocks end lines, entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ")
    t = F.regexp_replace(t, r"(?is)<title[^>]*>(.*?)</title>", "# $1\n\n")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?is)</(p|div|h[1-6]|li|tr|table|ul|ol|section|article)\s*>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))


def read_files(spark: SparkSession, path: str, recursive: bool = True, decode=None) -> DataFrame:
    """(path, suffix, bytes, text, error): a row for each supported file of a folder; others aren't read.

    Spark plans the files by their bytes. Markdown and other text is taken as it is, HTML as text, Word, PowerPoint and
    Excel files as Markdown. decode: a function from a column of bytes and one of suffixes to text, for the other binary
    formats, which are left out without it. A damaged file has a null text and the reason; a text without a sign but
    white space is the error `empty`.
    """
    others = tuple(s for s in BINARY_SUFFIXES if s not in OFFICE_SUFFIXES) if decode else ()
    suffixes = (*TEXT_SUFFIXES, *OFFICE_SUFFIXES, *others)
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).load(path)
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.col("length").alias("bytes"), "content")
    office = F.col("suffix").isin(*OFFICE_SUFFIXES)
    raw = F.decode("content", "UTF-8")
    text = F.when(F.col("suffix").isin("html", "htm"), html_to_text(raw)).when(F.col("suffix").isin(*TEXT_SUFFIXES), raw)
    if decode:
        text = text.otherwise(decode(F.col("content"), F.col("suffix")))
    plain = files.where(~office).select("path", "suffix", "bytes", text.alias("text"), F.lit(None).cast("string").alias("error"))
    out = plain.unionByName(decode_office(files.where(office)))
    empty = F.col("error").isNull() & (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")) == 0)
    return out.withColumns({"text": F.when(~empty, F.col("text")), "error": F.when(empty, "empty").otherwise(F.col("error"))})


def documents(spark: SparkSession, path: str, recursive: bool = True, decode=None) -> DataFrame:
    """(path, suffix, text): the files of read_files() that have a text."""
    return read_files(spark, path, recursive, decode).where(F.col("text").isNotNull()).select("path", "suffix", "text")


def conversation(messages: DataFrame, conversation_id, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Messages of one conversation in order, both ends included, deleted ones left out where they are marked."""
    rows = messages.where(F.col("conversation_id") == conversation_id)
    if "del_flag" in messages.columns:
        rows = rows.where(F.coalesce("del_flag", F.lit(0)) == 0)
    rows = rows if start is None else rows.where(F.col(ts) >= start)
    rows = rows if end is None else rows.where(F.col(ts) <= end)
    return rows.orderBy(ts)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON arrays."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line; a line that doesn't fit the schema fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_markdown(docs: DataFrame, path: str, title: str = "title", text: str = "text", per_file: int = 500) -> None:
    """'# title' and text of each document, up to per_file documents in a file; the folder is replaced."""
    docs.select(F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(text), F.lit("\n"))).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def read_parquet_shards(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if limit is None else rows.limit(limit)


def latest_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(snapshot, ...): the JSON of the newest of the folders that are named by time; only that one is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    newest = max(x.getPath().getName() for x in found if x.isDirectory())
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{path.rstrip('/')}/{newest}")
    return rows.withColumn("snapshot", F.lit(newest))


def save_chunks(chunks: DataFrame, path: str, by: str = "source_id") -> None:
    """Replaces the partitions of the sources that occur in chunks and keeps all others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored_document(chunks: DataFrame, source, key: str = "source_id", rank: str = "rank") -> DataFrame:
    """The chunks of a stored document in their order; it is not chunked again."""
    return chunks.where(F.col(key) == source).orderBy(rank)


def cached_until(cache: DataFrame, now) -> DataFrame:
    """Entries of a key-value table that have not expired."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))

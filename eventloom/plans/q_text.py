"""Queries of text, time and value functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import sources
from eventloom.functions import text as tx
from eventloom.functions import time as tm
from eventloom.functions import values as vl
from eventloom.operators import chunking as ch
from eventloom.plans.catalog import query, table

_CN, _W = r"[\x{4e00}-\x{9fff}]", r"[^\p{L}\p{N}\p{M}_\s]"


@query(rf"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '{_CN}')) * 0.8) + len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')))
+ floor(len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\p{{M}}_\s\x{{0b}}]')) * 0.5)) END::BIGINT AS tokens FROM documents""")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.chunk_tokens(F.col("text")).cast("long").alias("tokens"))


@query(rf"SELECT doc_id, floor(len(regexp_extract_all(text, '{_CN}')) / 1.5 + (length(text) - len(regexp_extract_all(text, '{_CN}'))) / 4)::BIGINT AS tokens FROM documents")
def simple_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(rf"SELECT doc_id, CASE WHEN 10 * len(regexp_extract_all(text, '{_CN}')) > 3 * (len(regexp_extract_all(text, '{_CN}')) + len(regexp_extract_all(text, '[a-zA-Z]'))) THEN 'chinese' ELSE 'english' END AS lang FROM documents")
def language_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.detect_language(F.col("text")).alias("lang"))


@query(rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')'), '{_W}', '', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def normalize_entity_name(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.normalize_entity_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("name"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents")
def normalize_and_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.text_hash(tx.normalize_text(F.col("text"))).alias("hash"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE text[1:97] || '...' END AS short FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate(F.col("text")).alias("short"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[!?;。！？；]+'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) >= 5)) AS n FROM documents""")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '')) AS n FROM documents""")
def paragraph_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.paragraphs(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, length(text) < 5 OR regexp_matches(text, '[\x00-\x1f\x7f-\x9f]{3,}') AS bad FROM (SELECT doc_id, trim(regexp_replace(text, 'https?://\S+', '', 'g')) AS text FROM documents)""")
def low_quality_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(tx.low_quality(F.col("source"), F.col("text"), F.lit(1))["bad"], F.lit(False)).alias("bad"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '[a-z]', 'x', 'g'), '\\s+', ' ', 'g')) AS h FROM documents")
def answer_shape(spark, d):
    bare = F.regexp_replace(F.lower("text"), f"[{tx.PUNCTUATION}]", "")
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace(F.regexp_replace(bare, "[a-z]", "x"), r"\s+", " ")).alias("h"))


@query("""SELECT event_id, round(exp(-0.01 * floor((epoch(TIMESTAMP '2024-03-01') - epoch_us(ts) / 1e6) / 86400)), 6) AS decay, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events""")
def time_decay(spark, d):
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.round(tm.time_decay(F.col("ts"), now), 6).alias("decay"), tm.format_datetime(F.col("ts")).alias("t"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_columns(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'datetime' WHEN 1 THEN 'int' ELSE CASE WHEN value = floor(value) THEN 'int' ELSE 'float' END END AS type,
CASE event_id % 3 WHEN 1 THEN user_id WHEN 2 THEN CASE WHEN value = floor(value) THEN value::BIGINT END END AS int_value, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) END AS datetime_value,
CASE WHEN event_id % 3 = 2 AND value <> floor(value) THEN round(value, 6) END AS float_value FROM events""")
def typed_values(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit("元"))).otherwise(F.col("value").cast("string"))
    v = e.select("event_id", vl.parse_value(text).alias("v"))
    return v.select("event_id", "v.type", "v.int_value", "v.datetime_value", F.round("v.float_value", 6).alias("float_value"))


@query()
def page_text(spark, d):
    """Pages as text, with the sections that their headings make."""
    pages = table(spark, d, "pages").select("page_id", sources.html_to_text(F.col("html")).alias("text"))
    return ch.sections(pages, "page_id", "text")


@query(r"""WITH s AS (SELECT source AS article_id, doc_id AS chunk_id, unnest(list_transform(string_split_regex(text, '[!?;。！？；]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS content, unnest(range(len(string_split_regex(text, '[!?;。！？；]+')))) AS pos FROM documents)
SELECT article_id, chunk_id, row_number() OVER (PARTITION BY article_id ORDER BY chunk_id, pos) - 1 AS rank, content FROM s WHERE length(content) >= 5""")
def document_sentences(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("article_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return ch.sentence_sections(docs)


@query()
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.keywords(F.col("text")).alias("keywords"))

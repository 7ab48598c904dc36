"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe, collocations, licenses, line_dedup, media, mixing, near, pieces, quality, sharding, token_counts, vector_codes, warc
from eventloom.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, concat_ws(chr(10), ls[i + 1], ls[i + 2], ls[i + 3]) AS w
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l)),
o AS (SELECT doc_id, i, first_value(doc_id) OVER f AS fd, first_value(i) OVER f AS fi
      FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]') WINDOW f AS (PARTITION BY w ORDER BY doc_id, i)),
p AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(i, fi + 3) ELSE i END, i + 3)) AS p
      FROM o WHERE doc_id <> fd OR i <> fi),
k AS (SELECT doc_id, string_agg(ls[j + 1], chr(10) ORDER BY j) AS kept, count(*) AS n
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS j FROM l) x
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = x.doc_id AND p.p = x.j) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.ls), 0)::BIGINT AS n_lines, coalesce(len(l.ls) - coalesce(k.n, 0), 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.kept, '')) END::BIGINT AS kept_chars,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = warc.records_of(warc.read(spark, warc.write(warc.plan_records(pages)), payloads=False))
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("id").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"), "source", F.size("copies").alias("copies"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read(media.encode(_table(spark, sf_dir, "documents")))
    clips = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"])), ",")
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("clips="), clips), F.concat(F.lit("histogram="), F.array_join(F.col("histogram").cast("array<string>"), ","))).alias("feature"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
      FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.text, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 10 * len(regexp_extract_all(text, '\p{Lu}')) > 3 * length(text)
            OR 2 * n_dup_lines > len(l) OR NOT (word_chars / n_words BETWEEN 2 AND 15)) AS kept
FROM b
"""


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near.near_classes(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    starts, named = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(named).alias("base_labels"),
        joined(F.concat(named, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0))).alias("score"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    coded = materialize(vector_codes.encode(vectors, books, carry=("label",)))
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM i, (VALUES (1), (2), (3), (4), (5)) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
s AS (SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, n.n,
             ((1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score, cut
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
      JOIN c AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
      JOIN c AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
      JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS f
           FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS j FROM c, (VALUES (2), (3), (4)) AS ms(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_warc, op4_mixing, op5_token_counts, op6_media, op7_quality, op8_near, op9_licenses, op10_pieces, op11_vector_codes, op12_byte_bpe, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op7_quality": OP7_SQL, "op13_collocations": OP13_SQL}

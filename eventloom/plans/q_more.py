"""Queries of filters by evaluations, provenance, message formatting, nested samples and related events."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import sources
from eventloom.functions import text as tx
from eventloom.functions import time as tm
from eventloom.functions import values as vl
from eventloom.operators import chunking as ch
from eventloom.operators import evaluation as ev
from eventloom.operators import ranking as rk
from eventloom.operators import relational as rel
from eventloom.operators import stats
from eventloom.plans import search
from eventloom.plans.catalog import EDGES, edges, query, table


STOPWORDS = ("the", "and", "for", "with", "that", "this", "from")


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 3 <> 0")
def soft_delete_filter(spark, d):
    flag = F.when(F.col("c_nationkey") % 3 == 0, True).when(F.col("c_nationkey") % 3 == 1, False)
    return rel.not_deleted(table(spark, d, "customer").withColumn("is_delete", flag)).select("c_custkey")


@query("SELECT o_orderkey AS event_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def invalid_event_removal(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "event_id")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "invalid_event").otherwise("other")
    judged = o.select("event_id", (F.col("o_orderstatus") == "F").alias("is_invalid"), F.array(F.struct(kind.alias("type"))).alias("issues"))
    return rel.drop_invalid_events(o.select("event_id"), judged)


@query("""SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q
WHERE q.p_partkey % 50 = 0 AND q.p_size = p.p_size AND q.p_brand = p.p_brand AND lower(q.p_name) = lower(p.p_name))""")
def invalid_entity_removal(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("event_id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"))
    issues = rows.where("p_partkey % 50 = 0").select("event_id", "type", F.upper("name").alias("name"))
    return rel.drop_invalid_entities(rows, issues).select("p_partkey")


@query("""WITH c AS (SELECT p_brand, p_name, min('T' || p_size) AS t FROM part WHERE p_partkey % 50 = 0 GROUP BY 1, 2)
SELECT p_partkey, coalesce(t, p_brand) AS type FROM part LEFT JOIN c USING (p_brand, p_name)""")
def type_correction(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("type"), F.col("p_name").alias("name"), "p_size")
    fixes = rows.where("p_partkey % 50 = 0").select("type", "name", F.concat(F.lit("T"), "p_size").alias("correct_type"))
    return rel.correct_types(rows, fixes).select("p_partkey", "type")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND (n_regionkey = 0 OR n_regionkey = 2)")
def active_type_scope(spark, d):
    source = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey"))
    types = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 2 == 0).alias("is_active"), source.alias("source_config_id"))
    return rel.active_types(types, 2).select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE (p_type, lower(replace(p_name, ' ', ''))) IN (SELECT p_type, lower(replace(p_name, ' ', '')) FROM part WHERE p_partkey % 50 = 0)")
def composite_key_lookup(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type"), tx.name_key(F.col("p_name")).alias("name"))
    return rel.by_keys(rows, rows.where("p_partkey % 50 = 0"), ["type", "name"]).select("p_partkey")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def share_of_total(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return stats.share_of_total(counted, "n").withColumn("share", F.round("share", 6))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y年%m月%d日 %H:%M:%S') AS entity FROM events")
def time_strings(spark, d):
    return table(spark, d, "events").select("event_id", tm.iso_utc(F.col("ts")).alias("iso"), tm.time_entity(F.col("ts")).alias("entity"))


@query("""SELECT conv_id, turn, sha256('{"role":"' || role || '","turn":' || turn || '}') AS key FROM conversations""")
def cache_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.cache_key(F.col("role"), F.col("turn")).alias("key"))


@query("""SELECT doc_id, CASE WHEN n_chars <= 5000 THEN 0 WHEN n_chars <= 50000 THEN least(150, greatest(1, floor(n_chars // 40 * 0.3))) WHEN n_chars <= 400000 THEN least(350, greatest(1, floor(n_chars // 40 * 0.3)))
ELSE least(500, greatest(1, floor(n_chars // 40 * 0.3))) END::BIGINT AS n FROM documents""")
def summary_budget(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.sentence_budget(F.col("n_chars"), F.floor(F.col("n_chars") / 40)).cast("long").alias("n"))


@query("SELECT doc_id, md5(concat_ws(chr(10) || chr(10), source, text[1:500])) AS h FROM documents")
def embedding_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.embedding_text(F.col("source"), F.col("text"), 500)).alias("h"))


@query("SELECT event_id, user_id::VARCHAR AS v FROM events")
def typed_texts(spark, d):
    text = F.concat(F.col("user_id").cast("string"), F.lit("元"))
    return table(spark, d, "events").select("event_id", vl.typed_value(vl.parse_value(text)).alias("v"))


@query("SELECT o_custkey % 5 AS recalled, count(*) AS questions FROM orders GROUP BY 1")
def recalled_histogram(spark, d):
    return ev.recalled_histogram(table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("matched")))


@query("SELECT o_orderkey, o_orderkey % 7 > 0 AS enough, CASE o_orderkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 5 THEN 0.85 WHEN 6 THEN 0.85 ELSE 0.65 END AS confidence FROM orders")
def knowledge_sufficiency(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ev.sufficiency(F.col("o_orderkey") % 7).alias("s")).select("o_orderkey", "s.enough", "s.confidence")


@query("SELECT round(avg(quality), 4) AS quality FROM labels")
def pooled_score(spark, d):
    return ev.pooled(table(spark, d, "labels"), "quality")


@query("""WITH r AS (SELECT p_size, lower(trim(p_name)) AS t, p_type[1:150] AS x FROM part WHERE p_partkey % 3 = 0)
SELECT o.p_size AS question_id, p_partkey AS oracle_id, min(CASE WHEN lower(trim(p_name)) = t THEN 1 WHEN contains(t, lower(trim(p_name))) THEN 2 ELSE 3 END) AS how
FROM part o JOIN r ON r.p_size = o.p_size WHERE lower(trim(p_name)) = t OR contains(t, lower(trim(p_name))) OR p_type[1:150] = x GROUP BY 1, 2""")
def title_text_cascade(spark, d):
    part = table(spark, d, "part").select(F.col("p_size").alias("question_id"), F.col("p_partkey").alias("oracle_id"), F.col("p_name").alias("title"), F.col("p_type").alias("text"))
    return ev.text_match(part, part.where("oracle_id % 3 = 0"))


@query(f"""WITH {EDGES} SELECT entity_id, count(*) AS events FROM e GROUP BY 1
HAVING count(*) FILTER (event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')) = 0""")
def lost_keys(spark, d):
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"))
    kept = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"))
    return search.lost_keys(keys, edges(spark, d), kept)


_CLUES = "c AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS src, l_orderkey % 1000 AS dst, l_returnflag AS stage, l_linenumber % 2 AS display_level, l_quantity * 30.0 - 100 AS confidence FROM lineitem)"


def _clues(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 1000).alias("dst"), F.col("l_returnflag").alias("stage"), (F.col("l_linenumber") % 2).alias("display_level"), (F.col("l_quantity") * 30.0 - 100).cast("double").alias("confidence"))


@query(f"""WITH {_CLUES}, n AS (SELECT *, row_number() OVER (PARTITION BY src, dst, stage, display_level ORDER BY seq) AS nth FROM c)
SELECT seq, CASE WHEN confidence BETWEEN 0 AND 1000 THEN confidence ELSE greatest(0, least(10, confidence)) END::DOUBLE AS confidence FROM n WHERE nth = 1""")
def provenance_edges(spark, d):
    return search.clue_edges(_clues(spark, d)).select("seq", "confidence")


@query(f"""WITH {_CLUES}, f AS (SELECT display_level AS hop, src, min(seq) AS seq FROM c WHERE stage = 'R' GROUP BY 1, 2)
SELECT hop, md5(string_agg(src::VARCHAR, ',' ORDER BY seq, src)) AS entities FROM f GROUP BY 1""")
def hop_entities(spark, d):
    clues = _clues(spark, d).where("stage = 'R'").select("seq", F.col("display_level").alias("hop"), F.col("src").alias("id"))
    return search.entities_by_hop(clues).select("hop", F.md5(F.array_join(F.col("entities").cast("array<string>"), ",")).alias("entities"))


@query("""WITH i AS (SELECT o_orderkey AS item_id, (o_custkey % 50)::DOUBLE AS w, 1.0 / (1 + o_orderkey % 100) AS r FROM orders)
SELECT item_id, round(0.8 * w + 0.2 * r * (SELECT max(w) FROM i) / (SELECT max(r) FROM i), 6) AS weight FROM i""")
def pagerank_blend(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 50).cast("double").alias("weight"))
    ranks = o.select("item_id", (1.0 / (1 + F.col("item_id") % 100)).alias("rank"))
    return rk.blend(o, ranks).select("item_id", F.round("weight", 6).alias("weight"))


@query("SELECT conv_id, turn, md5(role || '[' || role || '](2024-01-01 00:00:00):' || chr(10) || text || chr(10)) AS h FROM conversations")
def formatted_messages(spark, d):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(ch.format_message(F.col("role"), F.col("role"), ts, F.col("text"))).alias("h"))


@query("SELECT conv_id, turn, greatest(1, ceil(length(text) / 50))::BIGINT AS n, CASE WHEN length(text) > 50 THEN '[Continued] ' || text[51:100] END AS second FROM conversations")
def split_messages(spark, d):
    parts = table(spark, d, "conversations").select("conv_id", "turn", ch.split_long(F.col("text"), 50).alias("p"))
    return parts.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.get("p", F.lit(1)).alias("second"))


@query("SELECT o_orderkey, 'a' || CASE WHEN o_custkey % 4 BETWEEN 1 AND 3 THEN ',' || ['a', 'b', 'c'][o_custkey % 4] ELSE '' END AS ids FROM orders")
def resolved_references(spark, d):
    ids = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    given = F.array(F.lit("1"), F.lit("x"), F.lit("9"), (F.col("o_custkey") % 4).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(ch.resolve_references(ids, given), ",").alias("ids"))


def _samples(spark, d):
    """Conversations as nested samples: a context of (title, sentences), and the facts that name the first turn."""
    m = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("title"), F.split("text", "\n").alias("sentences")).alias("c"))
    one = m.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list("c")).alias("c"))
    context = F.transform("c", lambda x: F.struct(x["title"].alias("title"), x["sentences"].alias("sentences")))
    facts = F.transform(F.slice("c", 1, 1), lambda x: F.struct(x["title"].alias("title"), F.lit(0).alias("sent_id")))
    return one.select("id", context.alias("context"), facts.alias("supporting_facts"))


_TURNS = "t AS (SELECT conv_id::VARCHAR AS id, role || turn AS title, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"


@query(f"WITH {_TURNS} SELECT printf('%s-%02d', id, pos) AS chunk_id, md5('# ' || title || chr(10) || replace(text, chr(10), ' ')) AS h FROM t")
def nested_corpus(spark, d):
    return ev.corpus_of(_samples(spark, d)).select("chunk_id", F.md5("text").alias("h"))


@query(f"WITH {_TURNS} SELECT a.id, a.title, md5(replace(a.text, chr(10), ' ')) AS h FROM t a JOIN t b ON a.id = b.id AND b.pos = 0 AND a.title = b.title")
def gold_paragraphs(spark, d):
    return ev.gold_documents(_samples(spark, d)).select("id", "title", F.md5("text").alias("h"))


@query(f"WITH {_TURNS} SELECT id, title, md5(split_part(text, chr(10), 1)) AS h FROM t WHERE pos = 0")
def gold_sentences(spark, d):
    return ev.supporting_sentences(_samples(spark, d)).select("id", "title", F.md5("sentence").alias("h"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS nth FROM s)
SELECT query_id, vec_id, round(c, 6) AS score FROM r WHERE nth <= 5 AND c >= 0.1""")
def related_events(spark, d):
    rows = table(spark, d, "embeddings")
    found = rk.knn_join(rows, rows.where("vec_id % 50 = 0"), "embedding", "vec_id", 5, threshold=0.1)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 3")
def stored_document(spark, d):
    return sources.stored_document(table(spark, d, "conversations"), 3, "conv_id", "turn").select("turn", "role", "text")


_CN = r"len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]'))"


@query(rf"""WITH t AS (SELECT doc_id, text, floor({_CN} / 1.5 + (length(text) - {_CN}) / 4) AS n, trim(regexp_extract(text, '(?m)^#{{1,6}}\s+(.+)$', 1)) AS h FROM documents)
SELECT doc_id, CASE WHEN h = '' THEN 'Untitled' ELSE h END AS title, CASE WHEN n <= 100 THEN length(text) ELSE floor(length(text) * (100 / n) * 0.9) END::BIGINT AS kept FROM t""")
def document_metadata(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.document_title(text).alias("title"), F.length(tx.truncate_to_tokens(text, 100)).cast("long").alias("kept"))


def _uuid5_sql(name):
    h = f"sha1('\\x6b\\xa7\\xb8\\x10\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode({name}))"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[18:20] || '-' || {h}[21:32]"


@query(f"""WITH q AS (SELECT item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN text ELSE 'please: ' || text END AS original FROM benchmark),
n AS (SELECT DISTINCT original AS content, 'origin' AS category, '原始搜索内容' AS description FROM q UNION SELECT query, 'rewrite', '重写的请求' FROM q WHERE query <> original)
SELECT {_uuid5_sql("content")} AS id, 'query' AS type, category, content, description FROM n""")
def query_provenance(spark, d):
    original = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("please: "), "text"))
    return search.query_nodes(table(spark, d, "benchmark").select(F.col("text").alias("query"), original.alias("original")))


@query(f"""SELECT CASE WHEN p_size > 5 THEN p_partkey::VARCHAR ELSE 'fallback-' || {_uuid5_sql("p_name")} END AS id, 'entity' AS type, p_brand AS category, p_name AS content, '' AS description, p_size % 3 AS hop FROM part""")
def entity_provenance(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.when(F.col("p_size") > 5, F.col("p_partkey")).alias("entity_id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"), (F.col("p_size") % 3).alias("hop"))
    return search.entity_nodes(rows)


@query(f"""SELECT p_partkey, 'extracted-' || {_uuid5_sql("p_brand || ':' || p_name")} AS id FROM part""")
def extracted_provenance(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name"), F.lit("").alias("description"), "p_partkey")
    return search.extracted_nodes(rows, carry=["p_partkey"]).select("p_partkey", "id")


@query()
def embedding_normalized(spark, d):
    """Texts as they go to an embedding; NFKC is not in SQL."""
    return table(spark, d, "documents").select("doc_id", tx.normalize_for_embedding(F.col("text")).alias("text"))


@query()
def keywords_but_stopwords(spark, d):
    """First keywords of each document, stopwords left out."""
    return table(spark, d, "documents").select("doc_id", tx.keywords(F.col("text"), stopwords=STOPWORDS).alias("keywords"))


@query()
def long_sentence_parts(spark, d):
    """Benchmark items as sentences that are too long for 12 estimated tokens."""
    return table(spark, d, "benchmark").select("item_id", F.posexplode(ch.split_sentence(F.col("text"), 12)).alias("pos", "part"))


@query(f"""WITH {EDGES}, s AS (SELECT p_partkey AS entity_id, p_size / 64.0 AS k1 FROM part WHERE p_size / 64.0 >= 0.4 ORDER BY k1 DESC, entity_id LIMIT 25),
w AS (SELECT unnest(['cold', 'Large', 'blue rod']) AS word), m AS (SELECT p_partkey AS entity_id, row_number() OVER (PARTITION BY word ORDER BY p_partkey) AS nth FROM part, w WHERE starts_with(lower(p_name), lower(word))),
k AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT DISTINCT entity_id, 63 / 64.0 FROM m WHERE nth <= 2 AND entity_id NOT IN (SELECT entity_id FROM s)) ORDER BY k1 DESC, entity_id LIMIT 25),
r AS (SELECT event_id, 0.5 * ((event_id % 64) / 64.0) + 0.5 * sum(k1) AS weight FROM e JOIN k USING (entity_id) GROUP BY 1 ORDER BY weight DESC, event_id LIMIT 60)
SELECT o_custkey AS chunk_id, max(weight)::DOUBLE AS weight, arg_max(event_id, (weight, -event_id)) AS event_id FROM r JOIN orders ON o_orderkey = event_id GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 25""")
def query_key_event_chunk(spark, d):
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), (F.col("p_size") / F.lit(64.0)).alias("similarity"))
    words = spark.createDataFrame([("cold",), ("Large",), ("blue rod",)], "word string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("chunk_id"), (F.col("o_orderkey") % 64 / F.lit(64.0)).alias("e1"))
    return search.recall_chunks(entities, words, edges(spark, d), o, 25, named=63 / 64).select("chunk_id", "weight", "event_id")

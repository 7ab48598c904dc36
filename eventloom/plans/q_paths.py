"""Queries of provenance paths and response assembly: customers lead to orders, orders to parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans import search
from eventloom.plans.catalog import query, table
from eventloom.plans.q_more import _uuid5_sql

_CLUES = """c AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 1.0 / (1 + o_orderkey % 4) AS confidence FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 1.0 / (1 + l_partkey % 5) FROM lineitem)"""
_PATHS = """p AS (SELECT b.dst AS target, a.src AS n0, a.dst AS n1, round(a.confidence * b.confidence, 4) AS confidence FROM c a JOIN c b ON a.dst = b.src)"""


def _clues(spark, d):
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    bought = table(spark, d, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), (1.0 / (1 + F.col("o_orderkey") % 4)).alias("confidence"))
    held = table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), (1.0 / (1 + F.col("l_partkey") % 5)).alias("confidence"))
    return bought.unionByName(held)


def _paths(spark, d):
    key = lambda t, c, sign: table(spark, d, t).select(F.concat(F.lit(sign), F.col(c).cast("string")).alias("id"))
    return search.paths_to(_clues(spark, d), key("part", "p_partkey", "p"), key("customer", "c_custkey", "c"), max_depth=4)


@query(f"WITH {_CLUES}, {_PATHS} SELECT target, n0 || '>' || n1 || '>' || target AS path, confidence, 2 AS hops FROM p")
def clue_paths(spark, d):
    return _paths(spark, d).select("target", F.array_join("nodes", ">").alias("path"), "confidence", "hops")


@query(f"""WITH {_CLUES}, {_PATHS}, r AS (SELECT target, n0 || '>' || n1 || '>' || target AS path, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, n0, n1) AS s,
row_number() OVER (PARTITION BY target ORDER BY confidence DESC, n0 DESC, n1 DESC) AS l FROM p)
SELECT a.target, a.path AS shortest, b.path AS longest FROM r a JOIN r b USING (target) WHERE a.s = 1 AND b.l = 1""")
def clue_path_ends(spark, d):
    out = search.shortest_and_longest(_paths(spark, d))
    return out.select("target", F.array_join("shortest", ">").alias("shortest"), F.array_join("longest", ">").alias("longest"))


@query(f"""WITH {_CLUES}, {_PATHS} SELECT n0 || '>' || n1 || '>' || target AS path, 'query:' || c_name || '|event:' || o_orderpriority || '|entity:' || p_name AS steps
FROM p JOIN customer ON n0 = 'c' || c_custkey JOIN orders ON n1 = 'o' || o_orderkey JOIN part ON target = 'p' || p_partkey""")
def resolved_paths(spark, d):
    """Paths with their query, event and entity nodes."""
    node = lambda t, key, sign, kind, text: table(spark, d, t).select(F.concat(F.lit(sign), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(text).alias("content"))
    nodes = node("customer", "c_custkey", "c", "query", "c_name").unionByName(node("orders", "o_orderkey", "o", "event", "o_orderpriority")).unionByName(node("part", "p_partkey", "p", "entity", "p_name"))
    out = search.resolve_paths(_paths(spark, d), nodes)
    return out.select(F.array_join("nodes", ">").alias("path"), F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["type"], x["content"])), "|").alias("steps"))


@query("""WITH i AS (SELECT o_orderkey AS item_id, 1.0 / (1 + o_orderkey % 100) AS weight FROM orders), l AS (SELECT l_orderkey AS item_id, l_linenumber AS seq, 'p' || l_partkey AS src, min(l_discount) AS c FROM lineitem GROUP BY ALL)
SELECT item_id, round(weight, 8) AS weight, o_orderstatus AS title, string_agg(seq || ':' || src, ',' ORDER BY seq, src) AS clues FROM i JOIN orders ON o_orderkey = item_id LEFT JOIN l USING (item_id) GROUP BY ALL""")
def assembled_response(spark, d):
    """Every order as an item with its event and the clues that lead to it."""
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (1.0 / (1 + F.col("o_orderkey") % 100)).alias("weight"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("title"))
    clues = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("dst"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src")).agg(F.min("l_discount").alias("confidence"))
    out = search.response(items, events, clues.withColumn("stage", F.lit("expand")))
    told = F.when(F.size("clues") > 0, F.array_join(F.transform("clues", lambda c: F.concat_ws(":", c["seq"].cast("string"), c["src"])), ","))
    return out.select("item_id", F.round("weight", 8).alias("weight"), F.col("event.title").alias("title"), told.alias("clues"))


@query("""WITH c AS (SELECT o_orderkey AS item_id, o_totalprice / 1000000.0 AS similarity FROM orders), k AS (SELECT p_partkey AS entity_id, 1.0 / (1 + p_partkey % 7) AS weight, p_partkey % 3 AS hop FROM part),
e AS (SELECT l_orderkey AS item_id, l_partkey AS entity_id, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT item_id, sum(weight / (1 + hop)) AS relation, sum(weight * ln(1 + n) / (hop + 1)) AS density FROM e JOIN k USING (entity_id) GROUP BY 1),
r AS (SELECT item_id, row_number() OVER (ORDER BY similarity DESC, item_id) AS a, row_number() OVER (ORDER BY round(coalesce(relation, 0), 9) DESC, item_id) AS b, row_number() OVER (ORDER BY round(coalesce(density, 0), 9) DESC, item_id) AS c FROM c LEFT JOIN s USING (item_id))
SELECT item_id, round(1.5 / (60 + a) + 0.5 / (60 + b) + 0.2 / (60 + c), 8) AS weight FROM r ORDER BY 2 DESC, 1 LIMIT 50""")
def reranked_sections(spark, d):
    """Sections, here orders, reranked by the clues of their events."""
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_totalprice") / 1000000.0).alias("similarity"), F.lit(None).cast("double").alias("bm25"))
    p = F.col("p_partkey")
    keys = table(spark, d, "part").select(p.alias("entity_id"), (1.0 / (1 + p % 7)).alias("weight"), (p % 3).alias("hop"))
    mentions = table(spark, d, "lineitem").select(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("event_id"), F.col("l_partkey").alias("entity_id"), F.lit(1).alias("count"))
    events = table(spark, d, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("event_id"), F.col("o_orderkey").alias("chunk_id"))
    return search.rerank_sections(chunks, keys, mentions, events).select("item_id", F.round("weight", 8).alias("weight"))


@query(f"""WITH s AS (SELECT l_orderkey AS event_id, ['recall', 'expand', 'rerank'][1 + l_linenumber % 3] AS stage, CASE WHEN l_linenumber <> 4 THEN l_quantity::INT % 3 END AS hop, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) || '_recall' END AS m FROM lineitem),
k AS (SELECT DISTINCT event_id, stage, CASE WHEN stage = 'expand' THEN 'hop' || hop WHEN stage = 'rerank' THEN m END AS kind FROM s),
i AS (SELECT *, stage || '_' || kind || '_' || event_id AS own FROM k)
SELECT CASE WHEN kind IS NULL THEN stage || '_' || event_id ELSE own || '_' || left({_uuid5_sql("own")}, 8) END AS id, event_id, o_orderpriority AS content, o_orderstatus AS category, stage FROM i JOIN orders ON o_orderkey = event_id""")
def event_provenance(spark, d):
    """The nodes of each order as the stages of a search have seen it."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    seen = li.select(
        (F.col("l_orderkey") * 10 + n).alias("seq"),
        F.col("l_orderkey").alias("event_id"),
        F.get(F.array(F.lit("recall"), F.lit("expand"), F.lit("rerank")), (n % 3).cast("int")).alias("stage"),
        F.when(n != 4, F.round("l_quantity").cast("int") % 3).alias("hop"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lower("l_returnflag"), F.lit("_recall"))).alias("recall_method"),
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("content"))
    return search.event_nodes(seen.join(orders, "event_id")).select("id", "event_id", "content", "category", "stage")


@query(f"""SELECT DISTINCT CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE 'fallback-section-' || {_uuid5_sql("lang || ':' || source || ':' || coalesce(text, '')")} END AS id, lang AS category, left(source, 50) AS content FROM documents""")
def section_provenance(spark, d):
    """The nodes of documents as sections, a third of them without an id."""
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("section_id"), F.col("lang").alias("section_type"), F.col("source").alias("heading"), F.col("text").alias("content"), F.lit(None).cast("string").alias("summary"))
    return search.section_nodes(rows).select("id", "category", "content")

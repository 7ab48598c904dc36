"""Queries of vectors, BM25, fusion, weights, expansion, graph ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.functions import vectors as vx
from eventloom.operators import evaluation as ev
from eventloom.operators import ranking as rk
from eventloom.plans import search
from eventloom.plans.catalog import EDGES, edges, query, stored_edges, table

#: The vector of vec_id 0, as SQL, and the cosine to it, guarded against zero norms.
_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_V = f"{_Q}, v AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS c FROM embeddings, q)"


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first().embedding]


@query(f"WITH {_V} SELECT vec_id, round(c, 6) AS score FROM v ORDER BY c DESC, vec_id LIMIT 20")
def knn_cosine_topk(spark, d):
    return rk.knn(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_V} SELECT vec_id, round((1 + c) / 2, 6) AS score FROM v WHERE label IN (1, 3) ORDER BY c DESC, vec_id LIMIT 10")
def knn_filtered(spark, d):
    rows = table(spark, d, "embeddings").where("label in (1, 3)")
    return rk.knn(rows, "embedding", _query_vector(spark, d), 10, "vec_id", mode="unit").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_V}, k AS (SELECT * FROM v ORDER BY c DESC, vec_id LIMIT 40) SELECT vec_id, round(c * (1 + label * 0.1), 6) AS weight FROM k WHERE c >= 0.1")
def knn_type_weighted(spark, d):
    near = rk.knn(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 40, "vec_id")
    return near.where("score >= 0.1").select("vec_id", F.round(F.col("score") * (1 + F.col("label") * 0.1), 6).alias("weight"))


@query(f"WITH {_V} SELECT vec_id, round(greatest(0.0, least(1.0, c)), 6) AS clipped, round(0.7 * c + 0.3 * c, 6) AS hybrid, true AS valid FROM v")
def cosine_variants(spark, d):
    c = vx.cosine(F.col("embedding"), vx.literal(_query_vector(spark, d)))
    rows = table(spark, d, "embeddings").select("vec_id", c.alias("c"), vx.is_valid(F.col("embedding")).alias("valid"))
    return rows.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c")), 6).alias("clipped"), F.round(vx.hybrid(F.lit(None).cast("double"), F.col("c")), 6).alias("hybrid"), "valid")


_TERMS = ("the", "onthat", "ention")
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\p{{M}}]+')"


def _bm25_field(alias: str, expr: str) -> str:
    lists = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(_TERMS))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
    total = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avg)) ELSE 0 END" for i in range(len(_TERMS)))
    return f"""{alias}_t AS (SELECT doc_id, len(t) AS dl, {lists} FROM (SELECT doc_id, {_TOKENS.format(expr)} AS t FROM documents)),
{alias}_s AS (SELECT count(*) FILTER (dl > 0) AS n, avg(dl) FILTER (dl > 0) AS avg, {stats} FROM {alias}_t),
{alias} AS (SELECT doc_id, {total} AS s FROM {alias}_t, {alias}_s)"""


@query(f"WITH {_bm25_field('b', 'text')} SELECT doc_id, round(s, 6) AS score FROM b WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 20")
def bm25_documents(spark, d):
    out = rk.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, _TERMS)
    return out.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25_field('h', "split_part(text, chr(10), 1)")}, {_bm25_field('b', 'text')}
SELECT doc_id, round(greatest(3 * h.s, b.s), 6) AS score FROM h JOIN b USING (doc_id) WHERE greatest(3 * h.s, b.s) >= 0.5""")
def bm25_fielded(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("heading"), F.col("text").alias("content"))
    return rk.bm25(docs, "doc_id", {"heading": 3.0, "content": 1.0}, _TERMS, min_score=0.5).select("doc_id", F.round("score", 6).alias("score"))


@query(rf"""WITH t AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark), df AS (SELECT term, count(DISTINCT item_id) AS df FROM t GROUP BY 1),
i AS (SELECT term, ln((SELECT count(*) FROM benchmark) - df + 0.5) - ln(df + 0.5) AS idf FROM df), w AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS w FROM i WHERE term IN {_TERMS}),
l AS (SELECT item_id, count(*) AS dl FROM t GROUP BY 1), s AS (SELECT item_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM l)))) AS s
FROM (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2) JOIN w USING (term) JOIN l USING (item_id) GROUP BY 1) SELECT item_id, round(coalesce(s, 0), 6) AS score FROM benchmark LEFT JOIN s USING (item_id)""")
def bm25_okapi_candidates(spark, d):
    return rk.bm25_okapi(table(spark, d, "benchmark"), "item_id", "text", _TERMS).select("item_id", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (ORDER BY length(source || lang) + doc_id % 97 DESC, doc_id) AS b FROM documents)
SELECT doc_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 8) AS rrf FROM r""")
def rrf_two_way(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("emb"), (F.length(F.concat("source", "lang")) + F.col("doc_id") % 97).alias("bm25"))
    return rk.rrf(rows, "doc_id", {"emb": 1.0, "bm25": 1.0}).select("doc_id", F.round("rrf", 8).alias("rrf"))


@query("""WITH s AS (SELECT doc_id, n_chars AS a, doc_id % 53 AS b, doc_id % 31 AS c, CASE WHEN doc_id % 3 = 0 THEN doc_id % 17 END AS e FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY a DESC, doc_id) AS ra, row_number() OVER (ORDER BY b DESC, doc_id) AS rb, row_number() OVER (ORDER BY c DESC, doc_id) AS rc, row_number() OVER (ORDER BY e DESC NULLS LAST, doc_id) AS re FROM s)
SELECT doc_id, round(1.5 / (60 + ra) + 0.5 / (60 + rb) + 0.2 / (60 + rc) + CASE WHEN e IS NOT NULL THEN 2.0 / (60 + re) ELSE 0 END, 8) AS rrf FROM r""")
def rrf_weighted(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("similarity"), (i % 53).alias("relation"), (i % 31).alias("density"), F.when(i % 3 == 0, i % 17).alias("bm25"))
    return rk.rrf(rows, "doc_id", rk.RERANK_WEIGHTS).select("doc_id", F.round("rrf", 8).alias("rrf"))


_KEYS = f"{EDGES}, k AS (SELECT p_partkey AS entity_id, p_size / 50.0 AS k1 FROM part WHERE p_partkey % 4 = 0), q AS (SELECT o_orderkey AS event_id, 1.0 / (1 + o_orderkey % 10) AS e1 FROM orders)"
_PRIOR = "p AS (SELECT event_id, 0.5 * any_value(coalesce(e1, 0)) + 0.5 * sum(coalesce(k1, 0)) AS weight FROM e LEFT JOIN k USING (entity_id) LEFT JOIN q USING (event_id) GROUP BY 1)"


def _keys(spark, d):
    k = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") / 50.0).alias("k1"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (1.0 / (1 + F.col("o_orderkey") % 10)).alias("e1"))
    return k, q


@query(f"WITH {_KEYS}, {_PRIOR} SELECT event_id, round(weight, 6) AS weight FROM p ORDER BY weight DESC, event_id LIMIT 60")
def event_weight_recall(spark, d):
    k, q = _keys(spark, d)
    return rk.event_prior(edges(spark, d), k, q).select("event_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {_KEYS}, {_PRIOR} SELECT entity_id, round(avg(weight), 9) AS weight FROM e JOIN p USING (event_id) GROUP BY 1")
def key_weight_recall(spark, d):
    k, q = _keys(spark, d)
    e = edges(spark, d)
    return rk.key_weight_recall(e, rk.event_prior(e, k, q, None)).select("entity_id", F.round("weight", 9).alias("weight"))


_MENTIONS = "m AS (SELECT l_orderkey AS event_id, l_discount AS weight, (l_linenumber % 3)::INT AS count, l_linenumber::INT AS step FROM lineitem)"


def _mentions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_discount").alias("weight"), (F.col("l_linenumber") % 3).alias("count"), F.col("l_linenumber").alias("step"))


@query(f"WITH {_MENTIONS} SELECT event_id, round(0.5 / (1 + event_id % 10) + ln(1 + sum(weight * ln(1 + count))), 6) AS weight FROM m GROUP BY 1")
def mention_weight_recall(spark, d):
    return rk.mention_weight(_mentions(spark, d), _keys(spark, d)[1]).select("event_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_MENTIONS}, w AS (SELECT event_id, ln(1 + sum(weight * ln(1 + greatest(1, count)) / step)) AS weight FROM m GROUP BY 1),
t AS (SELECT * FROM w ORDER BY weight DESC, event_id LIMIT 500) SELECT event_id, round(weight / (SELECT max(weight) FROM w), 6) AS weight FROM t WHERE weight > 0""")
def mention_weight_expand(spark, d):
    return rk.normalize_to_max(rk.mention_weight(_mentions(spark, d), steps=True), 500).select("event_id", F.round("weight", 6).alias("weight"))


@query("""SELECT p_brand AS entity_id, round(sum(p_retailprice * h / 3) / sum(h / 3), 6) AS weight FROM (SELECT *, 1.0 + p_size % 3 AS h FROM part) GROUP BY 1""")
def hop_weighted_mean(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("entity_id"), (1 + F.col("p_size") % 3).alias("hop"), F.col("p_retailprice").alias("weight"))
    return rk.hop_weighted_mean(rows, 3).select("entity_id", F.round("weight", 6).alias("weight"))


@query("""SELECT l_orderkey AS item_id, round(sum(l_discount / (1 + l_linenumber % 4) * CASE WHEN l_returnflag = 'R' THEN 1.5 ELSE 1 END), 6) AS relation,
round(sum(l_discount * ln(1 + l_linenumber % 5) / l_linenumber), 6) AS density FROM lineitem WHERE l_linenumber % 5 > 0 GROUP BY 1""")
def relation_density(spark, d):
    li = table(spark, d, "lineitem")
    clues = li.select(F.col("l_orderkey").alias("item_id"), F.col("l_discount").alias("weight"), (F.col("l_linenumber") % 4).alias("hop"), F.col("l_linenumber").alias("step"), (F.col("l_linenumber") % 5).alias("count"), (F.col("l_returnflag") == "R").alias("is_target"))
    return rk.relation_and_density(clues).select("item_id", F.round("relation", 6).alias("relation"), F.round("density", 6).alias("density"))


@query("""WITH k AS (SELECT p_partkey AS entity_id, p_size / 100.0 AS weight, p_partkey % 2 = 0 AS t FROM part), s AS (SELECT min(weight) FILTER (t) AS low, max(weight) FILTER (NOT t) AS high FROM k)
SELECT entity_id, round(weight + CASE WHEN t THEN greatest(0, high + 0.05 - low) ELSE 0 END, 6) AS weight FROM k, s""")
def tokenizer_priority(spark, d):
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") / 100.0).alias("weight"), (F.col("p_partkey") % 2 == 0).alias("from_tokenizer"))
    return rk.priority_bias(keys).select("entity_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {EDGES}, c AS (SELECT event_id, entity_id, (entity_id % 9 + 1) / 10.0 AS w FROM e)
SELECT a.event_id AS a, b.event_id AS b, round(sum((a.w + b.w) / 2), 6) AS weight FROM c a JOIN c b USING (entity_id) WHERE a.event_id < b.event_id GROUP BY 1, 2""")
def shared_entity_graph(spark, d):
    return rk.shared_entity_graph(_clues(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


def _clues(spark, d):
    return edges(spark, d).select(F.col("event_id").alias("item_id"), "entity_id", ((F.col("entity_id") % 9 + 1) / 10.0).alias("weight"))


_G = f"""{EDGES}, c AS (SELECT event_id, entity_id, (entity_id % 9 + 1) / 10.0 AS w FROM e),
g AS (SELECT a.event_id AS s, b.event_id AS t, sum((a.w + b.w) / 2) AS w FROM c a JOIN c b USING (entity_id) WHERE a.event_id <> b.event_id GROUP BY 1, 2),
l AS (SELECT s, t, w / sum(w) OVER (PARTITION BY s) AS p FROM g), n AS (SELECT DISTINCT event_id AS i FROM c), r0 AS (SELECT i, 1.0 / (SELECT count(*) FROM n) AS r FROM n)"""


@query(f"WITH {_G}, " + ", ".join(f"r{k} AS (SELECT i, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce((SELECT sum(r * p) FROM l JOIN r{k - 1} x ON x.i = l.s WHERE l.t = n.i), 0) AS r FROM n)" for k in range(1, 6)) + " SELECT i AS item_id, round(r, 8) AS rank FROM r5")
def pagerank_5_iters(spark, d):
    clues = rk.cut_lineage(_clues(spark, d))
    start = rk.cut_lineage(clues.select("item_id").distinct().withColumn("weight", F.lit(1.0)))
    return rk.shared_pagerank(clues, start, rounds=5, tolerance=0).select("item_id", F.round("rank", 8).alias("rank"))


@query(f"WITH {_G}, u AS (SELECT s AS i, count(DISTINCT t) AS d FROM g GROUP BY 1), a AS (SELECT n.i, coalesce(d, 0) AS d FROM n LEFT JOIN u USING (i)) SELECT round(avg(d), 6) AS mean, max(d) AS most, count(*) FILTER (d = 0) AS isolated FROM a")
def degree_statistics(spark, d):
    clues = _clues(spark, d)
    return rk.degree_facts(rk.shared_degrees(clues), clues.select("item_id").distinct()).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {EDGES}, s AS (SELECT p_partkey AS k, 1.0 AS w FROM part WHERE p_partkey IN (5, 9)),
x1 AS (SELECT event_id, ln(1 + sum(w * ln(2))) AS w FROM e JOIN s ON k = entity_id GROUP BY 1), t1 AS (SELECT * FROM x1 ORDER BY w DESC, event_id LIMIT 100), n1 AS (SELECT event_id, w / (SELECT max(w) FROM x1) AS w FROM t1),
k1 AS (SELECT entity_id, avg(w) * least(2.0, ln(1 + count(*))) AS w FROM e JOIN n1 USING (event_id) GROUP BY 1),
f1 AS (SELECT * FROM k1 WHERE entity_id NOT IN (SELECT k FROM s) ORDER BY w DESC, entity_id LIMIT 10),
x2 AS (SELECT event_id, ln(1 + sum(w * ln(2) / 2)) AS w FROM e JOIN f1 USING (entity_id) GROUP BY 1), t2 AS (SELECT * FROM x2 ORDER BY w DESC, event_id LIMIT 100), n2 AS (SELECT event_id, w / (SELECT max(w) FROM x2) AS w FROM t2),
k2 AS (SELECT entity_id, avg(w) * least(2.0, ln(1 + count(*))) AS w FROM e JOIN n2 USING (event_id) GROUP BY 1),
ch AS (SELECT abs((SELECT sum(w) FROM k2) - (SELECT sum(w) FROM k1)) / (SELECT sum(w) FROM k1) AS c),
f2 AS (SELECT entity_id, w FROM k2, ch WHERE c >= 0.1 AND entity_id NOT IN (SELECT k FROM s UNION SELECT entity_id FROM f1) ORDER BY w DESC, entity_id LIMIT 10),
a AS (SELECT k AS entity_id, 0 AS hop FROM s UNION ALL SELECT entity_id, 1 FROM f1 UNION ALL SELECT entity_id, 2 FROM f2),
v AS (SELECT entity_id, 1 AS h, w FROM k1 UNION ALL SELECT entity_id, 2, w FROM k2), m AS (SELECT entity_id, sum(w * h / 2) / sum(h / 2.0) AS w FROM v GROUP BY 1)
SELECT a.entity_id, hop, round(coalesce(m.w, 0), 6) AS weight FROM a LEFT JOIN m USING (entity_id)""")
def expand_two_hops(spark, d):
    start = table(spark, d, "part").where("p_partkey in (5, 9)").select(F.col("p_partkey").alias("entity_id"), F.lit(1.0).alias("weight"))
    found, _ = search.expand(stored_edges(spark, d), start, search.SearchConfig(hops=2))
    return found.select("entity_id", "hop", F.round("weight", 6).alias("weight"))


@query()
def search_flagship(spark, d):
    """Recall, expansion and rerank: parts are keys, orders are events, both with vectors for similarity."""
    vectors = table(spark, d, "embeddings").select("vec_id", vx.cosine(F.col("embedding"), vx.literal(_query_vector(spark, d)), clip=True).alias("c"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    near = lambda rows, key: rows.join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n")))).withColumn("vec_id", F.col(key) % F.col("n")).join(vectors, "vec_id").drop("n", "vec_id")
    vectors = rk.cut_lineage(vectors)
    entities = near(part, "entity_id").withColumnRenamed("c", "similarity").withColumn("type_weight", F.lit(1.0))
    e1 = rk.cut_lineage(near(order, "event_id").select("event_id", F.col("c").alias("e1")))
    e = stored_edges(spark, d)
    cfg = search.SearchConfig(key_threshold=0.0, rerank_threshold=0.1)
    keys = search.recall(entities, e, e1, cfg=cfg)
    found, _ = search.expand(e, keys, cfg)
    items = e1.select(F.col("event_id").alias("item_id"), F.col("e1").alias("similarity"), F.lit(None).cast("double").alias("bm25"))
    links = e.select(F.col("event_id").alias("item_id"), "entity_id", F.lit(1).alias("count"))
    return search.rerank(items, found.select("entity_id", "weight", "hop"), links, cfg).select("item_id", "similarity", "relation", "density", F.round("weight", 8).alias("weight"))


_RET = "r AS (SELECT l_partkey % 50 AS question_id, l_orderkey AS item_id, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem), g AS (SELECT DISTINCT l_partkey % 50 AS question_id, l_orderkey AS item_id FROM lineitem WHERE l_orderkey % 40 = 0)"


def _retrieved(spark, d):
    li = table(spark, d, "lineitem").withColumn("question_id", F.col("l_partkey") % 50)
    r = li.select("question_id", F.col("l_orderkey").alias("item_id"), F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")).alias("rank"))
    return r, li.where("l_orderkey % 40 = 0").select("question_id", F.col("l_orderkey").alias("item_id")).distinct()


@query(f"""WITH {_RET}, h AS (SELECT g.question_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.question_id = g.question_id AND r.item_id = g.item_id AND rank <= 20)) AS m FROM g GROUP BY 1)
SELECT q.question_id, round(coalesce(m / n, 0), 6) AS recall FROM (SELECT DISTINCT question_id FROM r) q LEFT JOIN h USING (question_id)""")
def recall_at_k(spark, d):
    r, g = _retrieved(spark, d)
    return ev.recall_at(r, g, 20).withColumn("recall", F.round("recall", 6))


_ANS = "a AS (SELECT d.doc_id AS question_id, regexp_replace(lower(d.text), '[^a-z0-9 \n]', '', 'g') AS x, regexp_replace(lower(b.text), '[^a-z0-9 \n]', '', 'g') AS y FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"


def _answers(spark, d):
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 \n]", "")
    b = table(spark, d, "benchmark").select("item_id", clean("text").alias("gold"))
    return _with_item(spark, d).select(F.col("doc_id").alias("question_id"), "item_id", clean("text").alias("answer")).join(b, "item_id").drop("item_id")


def _with_item(spark, d):
    """All documents, each with one of the benchmark's items."""
    n = table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "documents").join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).drop("n")


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace({}, '\b(a|an|the)\b', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query(rf"""WITH {_ANS}, t AS (SELECT question_id, {_WORDS.format('x')} AS a, {_WORDS.format('y')} AS g FROM a),
ta AS (SELECT question_id, w, count(*) AS n FROM (SELECT question_id, unnest(a) AS w FROM t) GROUP BY 1, 2), tg AS (SELECT question_id, w, count(*) AS n FROM (SELECT question_id, unnest(g) AS w FROM t) GROUP BY 1, 2),
s AS (SELECT question_id, sum(least(ta.n, tg.n)) AS same FROM ta JOIN tg USING (question_id, w) GROUP BY 1)
SELECT question_id, round(CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * same / (len(a) + len(g)) END, 6) AS f1 FROM t LEFT JOIN s USING (question_id)""")
def token_f1(spark, d):
    return ev.token_f1(_answers(spark, d)).withColumn("f1", F.round("f1", 6))


@query(rf"WITH {_ANS} SELECT question_id, CASE WHEN {_WORDS.format('x')} = {_WORDS.format('y')} THEN 1.0 ELSE 0.0 END AS em FROM a")
def exact_match(spark, d):
    return ev.exact_match(_answers(spark, d))


@query(f"""WITH {_RET}, h AS (SELECT g.question_id, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.question_id = g.question_id AND r.item_id = g.item_id AND rank <= 400)) AS m FROM g GROUP BY 1)
SELECT count(*) FILTER (m >= gold) AS complete, count(*) FILTER (m > 0 AND m < gold) AS partial, count(*) FILTER (m = 0 AND gold > 0) AS zero, round(sum(m) / sum(gold), 4) AS micro, round(avg(m / gold), 4) AS macro FROM h""")
def recall_buckets(spark, d):
    r, g = _retrieved(spark, d)
    hit = g.join(r.where("rank <= 400").select("question_id", "item_id").distinct().withColumn("hit", F.lit(1)), ["question_id", "item_id"], "left")
    return ev.buckets(hit.groupBy("question_id").agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("gold")))


@query(r"""SELECT md5(p) AS purified, string_agg(DISTINCT doc_id::VARCHAR, '//' ORDER BY doc_id::VARCHAR) AS merged_id, count(*) AS n
FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', '', 'g') AS p FROM documents) GROUP BY p""")
def chunk_dedup_purified(spark, d):
    return ev.dedup_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1""")
def first_seen_dedup(spark, d):
    return ev.first_seen(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


_SPLIT = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"


@query(f"""SELECT b.item_id, d.doc_id, round(len(list_intersect({_SPLIT.format('b.text')}, {_SPLIT.format('d.text')})) / len({_SPLIT.format('b.text')}), 6) AS overlap
FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id""")
def word_overlap(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"))
    return _with_item(spark, d).join(b, "item_id").select("item_id", "doc_id", F.round(tx.word_overlap(F.col("gold"), F.col("text")), 6).alias("overlap"))


@query("SELECT lang AS stage, sum(n_chars)::BIGINT AS prompt_tokens, sum(doc_id)::BIGINT AS completion_tokens, sum(n_chars + doc_id)::BIGINT AS total_tokens, count(*) AS calls FROM documents GROUP BY 1")
def token_accounting(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("stage"), F.col("n_chars").alias("prompt_tokens"), F.col("doc_id").alias("completion_tokens"), (F.col("n_chars") + F.col("doc_id")).alias("total_tokens"))
    return ev.token_accounting(rows)


@query("SELECT round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM labels")
def judge_score_means(spark, d):
    return ev.metric_means(table(spark, d, "labels"), "quality", "toxic")


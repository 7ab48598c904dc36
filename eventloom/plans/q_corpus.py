"""Queries of operators over whole corpora: summaries, words and keywords, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import lexicon as lx
from eventloom.operators import ranking as rk
from eventloom.operators import summaries as sm
from eventloom.operators.lineage import materialize, shared_folder
from eventloom.operators.text_index import TextIndex
from eventloom.operators.vector_index import VectorIndex
from eventloom.plans import search
from eventloom.plans.catalog import query, table
from eventloom.plans.q_ranking import _TERMS, _bm25_field


@query()
def extractive_summaries(spark, d):
    """The five best sentences of each document."""
    out = sm.summaries(table(spark, d, "documents"), "doc_id", count=5)
    return out.select("doc_id", "n_sentences", "method", "positions", F.array_join("sentences", " ").alias("summary"))


@query()
def document_summaries(spark, d):
    """Title and summary by the budget of each document's estimated tokens."""
    docs = table(spark, d, "documents")
    out = sm.summaries(docs, "doc_id")
    return docs.select("doc_id", tx.document_title(F.col("text")).alias("title")).join(out.select("doc_id", "n_sentences", "method", F.size("sentences").alias("taken"), F.md5(F.array_join("sentences", "\n")).alias("summary_md5")), "doc_id")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND v.label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS nth FROM s) SELECT query_id, vec_id, round(c, 6) AS score FROM r WHERE nth <= 10""")
def indexed_knn(spark, d):
    """Ten rows of a type for each query, from a stored index that holds the type."""
    rows = table(spark, d, "embeddings")
    index = VectorIndex.build(rows, "vec_id", "embedding", shared_folder(spark), carry=["label"])
    found = index.search(rows.where("vec_id % 50 = 0"), "embedding", 10, where=F.col("label") == 3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in tx.ENGLISH_STOPWORDS)


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9]*')) AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM e GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS k, min(pos) AS pos FROM e WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY 1, 2),
s AS (SELECT doc_id, term, pos, k / sum(k) OVER (PARTITION BY doc_id) * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) AS weight FROM tf JOIN df USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pos) AS nth FROM s)
SELECT doc_id, nth::INT AS nth, term, round(weight, 8) AS weight FROM r WHERE nth <= 10""")
def tfidf_keywords(spark, d):
    """Ten keywords of each document by a stored model of the corpus."""
    docs = table(spark, d, "documents").select("doc_id", lx.latin_words(F.coalesce("text", F.lit(""))).alias("tokens"))
    model = materialize(lx.document_frequencies(docs, most=None))
    return lx.keywords_of_all(docs, "doc_id", model, top=10).select("doc_id", "nth", "term", F.round("weight", 8).alias("weight"))


@query(f"""WITH {_bm25_field('h', "split_part(text, chr(10), 1)")}, {_bm25_field('b', 'text')}
SELECT doc_id, round(greatest(3 * h.s, b.s), 6) AS score FROM h JOIN b USING (doc_id) WHERE greatest(h.s, b.s) > 0 ORDER BY greatest(3 * h.s, b.s) DESC, doc_id LIMIT 20""")
def indexed_bm25(spark, d):
    """The best documents by boosted fields, from an inverted index made of all documents."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("heading"), F.col("text").alias("content"))
    index = TextIndex.build(docs, "doc_id", ["heading", "content"], shared_folder(spark))
    return index.search(_TERMS, 20, {"heading": 3.0, "content": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, vec_id + 1 AS event_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS nth, c FROM s),
m AS (SELECT l_orderkey AS event_id, p_name AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, l_returnflag) AS nth FROM lineitem JOIN part ON p_partkey = l_partkey),
e AS (SELECT event_id, string_agg(name, ',' ORDER BY nth) AS entities FROM m WHERE nth <= 3 GROUP BY 1)
SELECT query_id, event_id, o_orderpriority AS title, o_orderstatus AS category, coalesce(entities, '') AS entities FROM r JOIN orders ON o_orderkey = event_id LEFT JOIN e USING (event_id) WHERE r.nth <= 5 AND c >= 0.1""")
def related_event_details(spark, d):
    """Events like a given one, with their first three entities."""
    rows = table(spark, d, "embeddings")
    hits = rk.knn_join(rows, rows.where("vec_id % 50 = 0"), "embedding", "vec_id", 5, threshold=0.1)
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("category"))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mentions = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("type"), F.col("p_name").alias("name"))
    out = search.related_details(hits.select("query_id", (F.col("vec_id") + 1).alias("event_id"), "score"), events, mentions, most=3)
    return out.select("query_id", "event_id", "title", "category", F.array_join(F.transform("entities", lambda x: x["name"]), ",").alias("entities"))

"""Work that grows with the input: rows that joins make, tables larger than what is sent to tasks, bounded batches."""

import random
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from eventloom.functions import text as tx
from eventloom.operators import chunking as ch
from eventloom.operators import evaluation as ev
from eventloom.operators import lexicon as lx
from eventloom.operators import ranking as rk
from eventloom.operators import relational as rel
from eventloom.operators import vector_index as vi
from eventloom.plans import catalog
from pyspark.sql import functions as F

catalog.load()


def join_rows(df):
    """The most rows that a join of df's plan has made."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if "Join" in name or "Cartesian" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in name:
            left.append(node.plan())
        children = node.children()
        left.extend(children.apply(k) for k in range(children.size()))
    return most


def copies(spark, small, tmp_path, table, key, n):
    """A folder with n copies of a table under shifted keys."""
    rows = spark.read.parquet(f"{small}/{table}.parquet")
    step = rows.count() + 1
    many = rows.crossJoin(spark.range(n)).selectExpr(*[f"{c} + id * {step} as {c}" if c == key else c for c in rows.columns])
    many.write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path), rows.count() * n


def test_extracted_provenance_copies(spark, small, tmp_path):
    folder, n = copies(spark, small, tmp_path, "part", "p_partkey", 20)
    got = catalog.QUERIES["extracted_provenance"](spark, folder)
    assert join_rows(got) <= n
    assert got.count() == n == got.select("p_partkey").distinct().count()


def test_title_text_cascade_copies(spark, small, tmp_path):
    folder, n = copies(spark, small, tmp_path, "part", "p_partkey", 20)
    assert join_rows(catalog.QUERIES["title_text_cascade"](spark, folder)) <= 2 * n


def test_text_match_nulls(spark):
    o = spark.createDataFrame([(1, 1, " A ", "x"), (1, 2, None, "y"), (1, 3, "b", None), (2, 4, "a", "q"), (1, 5, "", "none")], "question_id int, oracle_id int, title string, text string")
    r = spark.createDataFrame([(1, "a", "z"), (1, "cab", "y"), (1, None, None), (2, None, "q")], "question_id int, title string, text string")
    assert sorted(map(tuple, ev.text_match(o, r).collect())) == [(1, 1, 1), (1, 2, 3), (1, 3, 2), (1, 5, 2), (2, 4, 3)]


def test_wanted_rings_in_pieces(monkeypatch):
    monkeypatch.setattr(vi, "AT_ONCE_OUT", 600, raising=False)
    rng = np.random.default_rng(3)
    index = vi.VectorIndex(None, "", "id", vi.unit(rng.normal(0, 1, (40, 6))))
    held = {(c, r): (9, r / 20, (r + 1) / 20) for c in range(40) for r in range(20)}
    queries = pa.RecordBatch.from_pydict({"query_id": list(range(300)), "v": rng.normal(0, 1, (300, 6)).tolist(), "least": pa.nulls(300, pa.float64())})

    class Asked:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([queries])))

    for first in (True, False):
        got = index._wanted(Asked(), held, "long", None, first)
        assert max(b.num_rows for b in got) <= 100
        rings = {(q, c, r) for b in got for q, c, r in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))}
        assert len(rings) == sum(b.num_rows for b in got) == 300 * 20 * (vi.FIRST if first else 40 - vi.FIRST)


def test_nfkc_in_pieces():
    texts = ["\ufb01\u2460 \u00c5 " * 4000] * 300 + [None, ""]
    batch, want = pa.array(texts), [x and unicodedata.normalize("NFKC", x) for x in texts]
    tracemalloc.start()
    got = tx.nfkc(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want
    assert peak < 300 * 4000 * 6 * 2
    assert tx.nfkc(pa.array([], pa.string())).to_pylist() == []


def test_keywords_beyond_the_terms_sent(spark, small, monkeypatch):
    """Terms that aren't sent to the tasks keep their own frequencies."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", lx.latin_words(F.col("text")).alias("tokens"))
    whole = lx.document_frequencies(docs)
    want = sorted((r.doc_id, k, x.term, x.weight) for r in lx.keywords(docs, whole, top=10).collect() for k, x in enumerate(r.keywords, 1))
    for most in (40, 1):
        got = lx.keywords_of_all(docs, "doc_id", lx.document_frequencies(docs, most=None), top=10, most=most)
        assert sorted(map(tuple, got.collect())) == want


def shuffled_rows(df):
    """The most rows that one shuffle of df's plan has written."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            left.append(node.plan())
        left.extend(node.children().apply(k) for k in range(node.children().size()))
    return most


def test_graph_shuffles_lists(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(30), rng.random()) for i in range(400) for _ in range(3)]
    rows += [(7, 3, 0.5), (7, 3, 0.5), (None, 3, 1.0), (8, None, 1.0), (9, 3, None)]
    clues = spark.createDataFrame(rows, "item_id long, entity_id long, weight double")
    want = {}
    fine = [r for r in rows if r[0] is not None and r[1] is not None]
    for a, e, w in fine:
        for b, f, v in fine:
            if e == f and a < b:
                want.setdefault((a, b), []).extend([(w + v) / 2] if w is not None and v is not None else [])
    for block in (1024, 7):
        monkeypatch.setattr(rk, "BLOCK_ITEMS", block, raising=False)
        graph = rk.shared_entity_graph(clues)
        got = {(r.a, r.b): r.weight for r in graph.collect()}
        assert got == {k: pytest.approx(sum(v)) if v else None for k, v in want.items()}
        if block == 1024:
            assert shuffled_rows(graph) <= len(rows) < len(want) / 5
    degree = {}
    for a, b in want:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    ends = rk.shared_degrees(clues)
    assert {r.item_id: r.d for r in ends.collect()} == {r[0]: degree.get(r[0], 0) for r in fine}
    assert shuffled_rows(ends) < len(want) / 2

def test_shared_pagerank_shuffles_messages_only(spark, monkeypatch):
    """A round shuffles what is sent and got, not the clues; buckets and plain tables give the ranks of the pairs."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(40), rng.random() if i % 3 else 0.5) for i in range(300) for _ in range(3)]
    rows += [(7, 3, 0.5), (7, 3, 0.5), (None, 3, 1.0), (8, None, 1.0), (9, 3, None), (301, 77, 0.4)]
    clues = spark.createDataFrame(rows, "item_id long, entity_id long, weight double")
    start = spark.createDataFrame([(i, 1.0 + i % 4) for i in range(303)], "item_id long, weight double")
    want = {r.item_id: r.rank for r in rk.pagerank(rk.shared_entity_graph(clues.where("weight is not null")), start, rounds=4, tolerance=0).collect()}
    asked, rank = [], rk._rank
    monkeypatch.setattr(rk, "_rank", lambda start, flow, *rest: rank(start, lambda ranks: asked.append(flow(ranks)) or asked[-1], *rest))
    tables = spark.catalog.listTables()
    for least in (1, 1 << 18):
        monkeypatch.setattr(rk, "BUCKETED", least, raising=False)
        got = rk.shared_pagerank(clues, start, rounds=4, tolerance=0).collect()
        assert {r.item_id: pytest.approx(r.rank, abs=1e-12) for r in got} == want
        if least == 1:
            plan = asked[-1]._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2
    assert spark.catalog.listTables() == tables


def test_document_sentences_shuffle_no_sentences(spark, monkeypatch):
    """Sentences are placed by their chunks' counts, on every way the chunks can be numbered and joined."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k if k else None, " . ".join("word　" * rng.randrange(3) + "!" * rng.randrange(2) for _ in range(rng.randrange(40)))) for k in range(300)] + [("a", 500, None), ("c", 501, "")]
    trimmed = lambda x: x.strip("\t\n\x0b\x0c\r \x85\xa0　")
    for more in ([], [("a", 7, "twice there! and here"), ("c", 501, "some more; of it")]):
        want = []
        for a in ("a", "b", "c", None):
            chunks = sorted(((k is not None, k, t) for x, k, t in rows + more if x == a and t), key=lambda r: (r[0], r[1] or 0))
            mine = [(k or 0, p, k, s) for _, k, t in chunks for p, s in enumerate([s for s in map(trimmed, re.split("[!?;]+", t)) if len(s) >= 5])]
            want += [(a, k, n) for n, (_, _, k, _) in enumerate(sorted(mine, key=lambda r: r[:2]))]
        docs = spark.createDataFrame(rows + more, "article_id string, chunk_id long, content string").withColumn("rank", F.col("chunk_id"))
        for send, one in ((1 << 17, 1 << 20), (0, 1 << 20), (0, 10)):
            monkeypatch.setattr(ch, "SEND_CHUNKS", send, raising=False)
            monkeypatch.setattr(rel, "NUMBER_IN_ONE", one)
            out = ch.sentence_sections(docs)
            got = sorted(((r.article_id, r.chunk_id, r["rank"]) for r in out.collect()), key=str)
            assert got == sorted(want, key=str) and len(got) > 300
            assert more or shuffled_rows(out) <= len(rows)


def test_sentences_trim_what_regex_trims(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() or c in (0x180E, 0x200B, 0xFEFF)]
    texts = spark.createDataFrame([(f"{c} {c}middle{c}part{c}{c}",) for c in spaces], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert texts.where(tx.sentences(F.col("t"), 0)[0] != old).count() == 0


def test_numbered_rows_are_shuffled_once(spark, monkeypatch):
    """Beyond one window rows are dealt by range and numbered as they are written, not shuffled again by range."""
    monkeypatch.setattr(rel, "NUMBER_IN_ONE", 10)
    rows = spark.range(2000).select("id", ((F.col("id") * 7919) % 500).alias("v"))
    got = rel.numbered(rows, [F.desc("v"), "id"], "place")
    assert shuffled_rows(got) <= 100
    want = sorted(range(2000), key=lambda k: (-(k * 7919 % 500), k))
    assert {(r.id, r.place) for r in got.collect()} == {(k, n) for n, k in enumerate(want, 1)}

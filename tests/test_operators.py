"""Operators on small tables worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom import sources, streaming
from eventloom.operators import chunking, evaluation, maintenance, ranking, relational, stats
from eventloom.plans import search

EDGES = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "d"), (4, "e")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "event_id long, entity_id string")


def test_expand_stops_when_weights_settle(spark, edges):
    start = spark.createDataFrame([("a", 1.0)], "entity_id string, weight double")
    keys, evolution = search.expand(edges, start, search.SearchConfig())
    got = {r.entity_id: (r.hop, r.parent) for r in keys.collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (2, "b")}
    assert {r.hop for r in evolution.collect()} == {1, 2, 3}
    keys, _ = search.expand(edges, start, search.SearchConfig(convergence=0.0))
    assert {r.entity_id for r in keys.collect()} == {"a", "b", "c", "d"}


def test_pagerank_loses_the_mass_of_isolated_items(spark, edges):
    clues = edges.select(F.col("event_id").alias("item_id"), "entity_id", F.lit(1.0).alias("weight"))
    graph = ranking.shared_entity_graph(clues)
    start = spark.createDataFrame([(k, 1.0) for k in (1, 2, 3, 4)], "item_id long, weight double")
    ranks = {r.item_id: r[1] for r in ranking.pagerank(graph, start).collect()}
    assert abs(ranks[4] - 0.0375) < 1e-9 and ranks[2] > ranks[1] and sum(ranks.values()) < 1


def test_shared_pagerank_needs_no_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(20), rng.random()) for i in range(60) for _ in range(3)]
    rows += [(i, 99, 0.5) for i in range(0, 60, 3)] + [(60, 100, 1.0), (None, 99, 1.0), (1, None, 1.0), (2, 99, None)]  # 99: a hub
    items, weight, both = range(61), {}, rows[:-3]
    for a, e, wa in both:
        for b, f, wb in both:
            if e == f and a != b:
                weight[a, b] = weight.get((a, b), 0) + (wa + wb) / 2
    total = {a: sum(w for (s, _), w in weight.items() if s == a) for a in items}
    want = {i: 1 / 61 for i in items}
    for _ in range(7):
        want = {b: 0.15 / 61 + 0.85 * sum(want[a] * w / total[a] for (a, t), w in weight.items() if t == b) for b in items}
    clues = spark.createDataFrame(rows, "item_id long, entity_id long, weight double")
    start = spark.createDataFrame([(i, 1.0) for i in items], "item_id long, weight double")
    got = {r.item_id: r["rank"] for r in ranking.shared_pagerank(clues, start, rounds=7, tolerance=0).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    hub = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(1).alias("entity_id"), F.lit(1.0).alias("weight"))
    ranks = ranking.shared_pagerank(hub, hub.select("item_id", "weight"), rounds=2, tolerance=0)  # 5e9 pairs
    low, high, n = ranks.agg(F.min("rank"), F.max("rank"), F.count(F.lit(1))).first()
    assert (low, high, n) == (pytest.approx(1e-5), pytest.approx(1e-5), 100_000)


def test_rrf_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(2, 0.5, None), (1, 0.5, 3.0)], "id int, emb double, bm25 double")
    got = {r.id: r.rrf for r in ranking.rrf(rows, "id", {"emb": 1.0, "bm25": 1.0}).collect()}
    assert abs(got[1] - 2 / 61) < 1e-12 and abs(got[2] - 1 / 62) < 1e-12


def test_bm25_finds_only_rows_with_a_term(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple tart"), (3, "plum"), (4, None)], "id int, t string")
    got = [r.id for r in ranking.bm25(docs, "id", {"t": 1.0}, ["Apple", "tart"]).orderBy(F.desc("score")).collect()]
    assert got == [2, 1]


def test_histogram_has_empty_bins_and_closes_the_last(spark):
    v = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    got = [r.n for r in stats.histogram(v, "v", 5).orderBy("bin").collect()]
    assert got == [2, 0, 0, 0, 1]


def test_recall_em_f1(spark):
    gold = spark.createDataFrame([("q", "x"), ("q", "y")], "question_id string, item_id string")
    found = spark.createDataFrame([("q", "x", 1), ("q", "z", 2), ("q", "y", 3)], "question_id string, item_id string, rank int")
    assert [r.recall for r in evaluation.recall_at(found, gold, 2).collect()] == [0.5]


def test_upsert_tells_what_it_did(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    rows = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    got = {r.k: r.status for r in maintenance.upsert(known, rows, "k").collect()}
    assert got == {1: "kept", 2: "updated", 3: "unchanged", 4: "inserted"}


def test_delete_needs_every_list(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    assert maintenance.delete_where(rows).count() == 3
    assert maintenance.delete_where(rows, k=[]).count() == 3
    assert [r.k for r in maintenance.delete_where(rows, k=[1, 2, 3], v=["x"]).orderBy("k").collect()] == [2, 3]


def test_paths_are_simple_and_bounded(spark):
    clues = spark.createDataFrame([("q", "a", 0.5), ("a", "b", 0.5), ("b", "a", 0.9), ("b", "e", 1.0), ("q", "e", 0.2)], "src string, dst string, confidence double")
    target, origin = spark.createDataFrame([("e",)], "id string"), spark.createDataFrame([("q",)], "id string")
    paths = search.paths_to(clues, target, origin)
    got = {tuple(r.nodes): r.confidence for r in paths.collect()}
    assert got == {("q", "e"): 0.2, ("q", "a", "b", "e"): 0.25}
    ends = search.shortest_and_longest(paths).first()
    assert ends.shortest == ["q", "e"] and ends.longest == ["q", "a", "b", "e"]


def test_type_focus_wins_over_exclude(spark):
    rows = spark.createDataFrame([("person",), ("tags",), ("time",)], "type string")
    assert {r.type for r in relational.type_filter(rows, focus=["person"], exclude=["person"]).collect()} == {"person", "tags"}
    assert {r.type for r in relational.type_filter(rows, exclude=["time"]).collect()} == {"person", "tags"}


def test_names_match_exactly_then_by_prefix(spark):
    entities = spark.createDataFrame([(1, "Alpha Beta"), (2, "alphabetical"), (3, "Gamma")], "entity_id int, name string")
    names = spark.createDataFrame([("alpha beta",)], "name string")
    assert [r.entity_id for r in relational.exact_names(entities, names).collect()] == [1]


def test_sections_join_bare_headings(spark):
    docs = spark.createDataFrame([(1, "# Top\n## Sub\ntext here\n## Next\nmore")], "id int, t string")
    got = [(r.rank, r.heading) for r in chunking.sections(docs, "id", "t").orderBy("rank").collect()]
    assert [h for _, h in got] == ["Top", "Next"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\nwords")
    (tmp_path / "in/b.html").write_text("<html><title>T</title><body><p>x &amp; y</p><script>no</script></body></html>")
    (tmp_path / "in/c.md").write_text("  ")
    (tmp_path / "in/d.exe").write_text("no")
    got = {r.suffix: r.text for r in sources.documents(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"md", "html"} and got["md"] == "# A\nwords" and "x & y" in got["html"] and "no" not in got["html"]
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    sources.write_jsonl(rows, f"file://{tmp_path}/out")
    assert [tuple(r) for r in sources.read_jsonl(spark, f"file://{tmp_path}/out", "k int, v string").collect()] == [(1, "a")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m}0:00", h) for h in range(4) for m in range(3)], "ts string, k int").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"file://{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/rows")
    done = streaming.window_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    done.awaitTermination(120)
    want = sorted(map(tuple, streaming.window_counts(rows).collect()))
    assert sorted(map(tuple, spark.table("counted").collect())) == want and len(want) == 4

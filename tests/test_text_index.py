"""The inverted index gives what the scan gives, through segments, new versions and merges."""

import random

import pytest
from eventloom.operators import ranking, text_index
from pyspark.sql import functions as F


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["中文", "The", "über", "x_1"]
    weight = [1 / (k + 1) for k in range(len(words))]
    return [(k, " ".join(rng.choices(words, weight, k=rng.randint(0, 12))) or None, " ".join(rng.choices(words, weight, k=rng.randint(1, 80)))) for k in range(n)]


def pairs(found):
    return sorted((r.id, pytest.approx(r.score, abs=1e-9)) for r in found.collect())


QUERY = ["w20", "W3", "the", "中", "w39", "absent"]
BOOSTS = {"title": 3.0, "body": 1.0}


@pytest.mark.parametrize("zone", [4096, 9])
def test_equals_scan(spark, tmp_path, monkeypatch, zone):
    monkeypatch.setattr(text_index, "ZONE_DOCS", zone)
    monkeypatch.setattr(text_index, "FIRST_ZONES", 2)
    rows = texts(300, 1)
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    scan = lambda df, **kw: ranking.bm25(df, "id", BOOSTS, QUERY, **kw)
    index = text_index.TextIndex.build(docs.where("id < 150"), "id", ["title", "body"], f"file://{tmp_path}/index")
    assert {r.status for r in index.append(docs.where("id >= 150")).collect()} == {"created"}
    want = {r.id: r.score for r in scan(docs).collect()}
    assert dict(pairs(index.search(QUERY, boosts=BOOSTS))) == want
    for k in (1, 10, 1000):
        top = sorted(want.items(), key=lambda r: (-r[1], r[0]))[:k]
        got = index.search(QUERY, k, BOOSTS).collect()
        assert [pytest.approx(s, abs=1e-9) for _, s in top] == [r.score for r in got] and {r.id for r in got} <= set(want)
    assert dict(pairs(index.search(QUERY, boosts=BOOSTS, min_score=5.0))) == {r.id: r.score for r in scan(docs, min_score=5.0).collect()}
    assert dict(pairs(index.search(["w20"], boosts={"body": 1.0}))) == {r.id: r.score for r in ranking.bm25(docs, "id", {"body": 1.0}, ["w20"]).collect()}

    # new versions, repeats and rows without a key
    new = [(5, "w39 w39", "w20"), (5, "w39", "w20"), (None, "w39", "w39"), (900, None, None)]
    status = index.append(spark.createDataFrame(new, "id long, title string, body string")).collect()
    assert sorted((r.id or 0, r.status) for r in status) == [(0, "failed"), (5, "superseded"), (5, "updated"), (900, "created")]
    index.merge()
    now = [r for r in rows if r[0] != 5] + [(5, "w39 w39", "w20"), (900, None, None)]
    scanned = scan(spark.createDataFrame(now, "id long, title string, body string"))
    assert dict(pairs(index.search(QUERY, boosts=BOOSTS))) == {r.id: r.score for r in scanned.collect()}


def test_marks_and_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "two")], "id long, body string")
    index = text_index.TextIndex.build(docs, "id", ["body"], f"file://{tmp_path}/index")
    index.append(spark.createDataFrame([(1, "three")], "id long, body string"))
    assert [r.id for r in index.search(["two"], 5).collect()] == [2] and index.search(["one"], 5).count() == 0
    assert [r.id for r in index.search(["three"]).collect()] == [1]
    assert index.search([], 5).count() == index.search(["two"], 0).count() == 0
    empty = text_index.TextIndex.build(docs.limit(0), "id", ["body"], f"file://{tmp_path}/empty")
    assert empty.search(["two"], 3).count() == 0
    empty.append(docs.where(F.col("id") == 2))
    assert empty.search(["two"], 3).count() == 1


def test_blocks_cut_short(spark, tmp_path, monkeypatch):
    """Texts are cut into tokens once, and zones of many characters make several blocks for a term."""
    monkeypatch.setattr(text_index.tx, "count_tokens", None)
    docs = spark.createDataFrame(texts(2000, 3), "id long, title string, body string")
    indexes = []
    for k, most in enumerate((1 << 25, 2000)):
        monkeypatch.setattr(text_index, "BLOCK_CHARS", most, raising=False)
        indexes.append(text_index.TextIndex.build(docs, "id", ["title", "body"], f"file://{tmp_path}/index{k}"))
    monkeypatch.undo()
    want = {r.id: r.score for r in ranking.bm25(docs, "id", BOOSTS, QUERY).collect()}
    few, many = (index._blocks(index._segments()) for index in indexes)
    assert few.count() == few.select("field", "term").distinct().count() < many.count()
    for index in indexes:
        assert dict(pairs(index.search(QUERY, boosts=BOOSTS))) == want
        assert [r.score for r in index.search(QUERY, 10, BOOSTS).collect()] == pytest.approx(sorted(want.values(), reverse=True)[:10])

"""Operators that SQL can't express, or whose other way begins beyond a size, against brute force on small tables."""

import random
import re
import unicodedata
import uuid
from statistics import median

import pytest
from pyspark.sql import functions as F

from eventloom import sources
from eventloom.functions import text as tx
from eventloom.operators import chunking, lineage, ranking, relational, stats
from eventloom.plans import catalog, q_more, search

catalog.load()


def test_numbering_by_ranges_equals_one_window(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0])) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    for by in ([], ["g"]):
        monkeypatch.setattr(relational, "NUMBER_IN_ONE", 1 << 20)
        want = {(r.id, r.place) for r in relational.numbered(df, [F.desc("v"), "id"], "place", by).collect()}
        monkeypatch.setattr(relational, "NUMBER_IN_ONE", 10)
        got = relational.numbered(df, [F.desc("v"), "id"], "place", by)
        assert got.columns == ["id", "g", "v", "place"] and {(r.id, r.place) for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_median_by_bins(spark, monkeypatch, n):
    monkeypatch.setattr(stats, "MEDIAN_IN_ONE", 20)
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 5.0, 1e6 * rng.random()]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "v double")
    assert stats.median(df, "v", bins=4) == median(values)
    assert stats.median(df.where("v is null"), "v") is None
    assert stats.median(df.withColumn("v", F.when(F.col("v").isNotNull(), 7.0)), "v") == 7.0


def test_recent_and_sampled(spark, small):
    got = [r.event_id for r in catalog.QUERIES["recent_and_sampled"](spark, small).collect()]
    rows = sorted(((r.o_orderdate, -r.o_orderkey) for r in catalog.table(spark, small, "orders").collect()), reverse=True)
    assert {-k for _, k in rows[:100]} == set(got[:100]) and len(set(got)) == 300
    assert got == [r.event_id for r in catalog.QUERIES["recent_and_sampled"](spark, small).collect()]


def test_keywords(spark, small):
    texts = {r.doc_id: r.text for r in catalog.table(spark, small, "documents").collect()}
    for r in catalog.QUERIES["keywords"](spark, small).collect():
        found = re.findall(r"\b[A-Za-z][A-Za-z0-9\-]{2,}\b", texts[r.doc_id])
        assert r.keywords == list(dict.fromkeys(x.lower() for x in found))[:20]


def test_packed_conversations(spark, small):
    rows = catalog.table(spark, small, "conversations").select("conv_id", "turn", tx.chunk_tokens(F.col("text")).alias("n")).collect()
    want, by = set(), {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r.n)
    for k, sizes in by.items():
        batches = [[]]
        for n in sizes:
            if batches[-1] and sum(batches[-1]) + n > 400:
                batches.append([])
            batches[-1].append(n)
        want |= {(k, i, len(b), sum(b)) for i, b in enumerate(batches)}
    assert {tuple(r) for r in catalog.QUERIES["packed_conversations"](spark, small).collect()} == want


def test_bm25_counts_whole_tokens(spark):
    docs = spark.createDataFrame([(1, "The theme: the_the the-the 中the 中")], "id int, t string")
    got = docs.select(tx.count_token(F.col("t"), "the"), tx.count_token(F.col("t"), "中"), tx.count_tokens(F.col("t"))).first()
    words = docs.select(tx.tokens(F.lower("t"))).first()[0]
    assert tuple(got) == (words.count("the"), words.count("中"), len(words))


def test_knn_join_in_blocks(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = ranking.knn_join(df, df.where("id % 5 = 0"), "v", "id", 3, threshold=0.2).collect()

    def cosine(a, b):
        length = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / length if length else 0.0

    want = {}
    for q, a in rows[:61:5]:
        near = sorted((-cosine(a, b), k) for k, b in rows if b and k != q)[:3]
        want |= {(q, k): pytest.approx(-c) for c, k in near if -c >= 0.2}
    assert {(r.query_id, r.id): r.score for r in got} == want


def test_sections_are_reranked_by_the_clues_of_their_events(spark):
    edges = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (2, "b", 1), (3, "c", 1)], "event_id long, entity_id string, count int")
    events = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "event_id long, chunk_id long")
    keys = spark.createDataFrame([("a", 1.0, 0), ("c", 0.5, 1)], "entity_id string, weight double, hop int")
    chunks = spark.createDataFrame([(10, 0.1, None), (20, 0.2, None), (30, -0.5, 3.0)], "item_id long, similarity double, bm25 double")
    got = search.rerank_sections(chunks, keys, edges, events).collect()
    assert {r.item_id: round(r.relation, 6) for r in got} == {10: 1.0, 20: 0.25, 30: 0.0}
    rank = {"similarity": {20: 1, 10: 2, 30: 3}, "relation": {10: 1, 20: 2, 30: 3}, "density": {10: 1, 20: 2, 30: 3}}
    want = {k: sum(ranking.RERANK_WEIGHTS[s] / (60 + r[k]) for s, r in rank.items()) + (2.0 / 61 if k == 30 else 0) for k in (10, 20, 30)}
    assert {r.item_id: r.weight for r in got} == pytest.approx(want)
    assert [r.item_id for r in search.intermediate(search.rerank_sections(chunks, keys, edges, events), 1).collect()] == sorted(want, key=lambda k: -want[k])


def test_one_correction_counts(spark):
    rows = spark.createDataFrame([(1, "x", "n")], "id int, type string, name string")
    fixes = spark.createDataFrame([("x", "n", "z"), ("x", "n", "y")], "type string, name string, correct_type string")
    assert [tuple(r) for r in relational.correct_types(rows, fixes).select("id", "type").collect()] == [(1, "y")]


def test_newest_snapshot_alone_is_read(spark, tmp_path):
    for name, text in (("2024-01-01", "broken"), ("2024-02-01", '[{"k": 1}, {"k": 2}]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(text)
    got = sources.latest_snapshot(spark, f"file://{tmp_path}", "k int").collect()
    assert {(r.k, r.snapshot) for r in got} == {(1, "2024-02-01"), (2, "2024-02-01")}


def test_shared_tables_can_be_discarded(spark):
    kept = lineage.materialize(spark.range(3))
    assert kept.count() == 3
    lineage.discard(kept, None, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(kept.eventloom_folder).count()


def test_texts_for_embedding(spark, small):
    texts = {r.doc_id: r.text for r in catalog.table(spark, small, "documents").collect()}
    for r in catalog.QUERIES["embedding_normalized"](spark, small).collect():
        assert r.text == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", texts[r.doc_id]).lower()).strip()
    odd = spark.createDataFrame([("Ｈｅｌｌｏ  ½\t①",), ("",), (None,)], "t string")
    assert [r[0] for r in odd.select(tx.normalize_for_embedding(F.col("t"))).collect()] == ["hello 1⁄2 1", "", ""]


def test_keywords_but_stopwords(spark, small):
    texts = {r.doc_id: r.text for r in catalog.table(spark, small, "documents").collect()}
    for r in catalog.QUERIES["keywords_but_stopwords"](spark, small).collect():
        found = dict.fromkeys(x.lower() for x in re.findall(r"\b[A-Za-z][A-Za-z0-9\-]{2,}\b", texts[r.doc_id]))
        assert r.keywords == [x for x in found if x not in q_more.STOPWORDS][:20]


def test_names_have_the_uuid_of_version_5(spark):
    names = ["", "a", "什么 是 é", "x" * 300]
    got = spark.createDataFrame([(x,) for x in names], "t string").select("t", tx.uuid5(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == {x: str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in names}


def test_titles_and_cut_texts(spark):
    rows = [("intro\n## One \n# Two", "One"), ("#no", "Untitled"), (None, "Untitled"), ("", "Untitled")]
    got = spark.createDataFrame(rows, "t string, want string").select(tx.document_title(F.col("t")), "want").collect()
    assert all(r[0] == r.want for r in got)
    cut = spark.createDataFrame([("a" * 4000,), ("a" * 400,), (None,)], "t string").select(F.length(tx.truncate_to_tokens(F.col("t"), 100))).collect()
    assert [r[0] for r in cut] == [360, 400, None]


def test_nodes_of_what_lacks_fields(spark):
    rows = spark.createDataFrame([(None, None, None, None, None)], "entity_id long, type string, name string, description string, hop int")
    made = str(uuid.uuid5(uuid.NAMESPACE_DNS, "unknown"))
    assert tuple(search.entity_nodes(rows).first()) == (f"fallback-{made}", "entity", "unknown", "", "", 0)
    assert search.extracted_nodes(rows).first().id == f"extracted-{uuid.uuid5(uuid.NAMESPACE_DNS, 'unknown:')}"
    asked = spark.createDataFrame([("q", None), ("q", "q"), ("new", "q")], "query string, original string")
    got = {(r.category, r.content) for r in search.query_nodes(asked).collect()}
    assert got == {("origin", "q"), ("rewrite", "new")} and search.query_nodes(asked).count() == 2


def parts_of(text, most):
    """Brute force: shortest pieces that end after a separator, packed; characters of those that are too long."""

    def estimate(t):
        return max(1, int(len(re.findall("[一-鿿]", t)) * 0.8) + len(re.findall(r"\b[a-zA-Z]+\b", t)) + int(len(re.findall(r"[^\w\s]", t)) * 0.5))

    def tokens(t):  # of a piece's beginning: a word counts where it begins
        words = sum(1 for a, b in zip(" " + t, t) if b.isascii() and b.isalpha() and not (a.isascii() and a.isalpha()))
        return int(len(re.findall("[一-鿿]", t)) * 0.8) + words + int(len(re.findall(r"[^\w\s]", t)) * 0.5)

    pieces, now = [], ""
    for c in text:
        now += c
        if c in "，,、 \t" and now.strip():
            pieces.append(now)
            now = ""
    pieces += [now] if now.strip() else []
    out, held, total = [], "", 0
    for x in pieces:
        n = estimate(x)
        if held and total + n > most:
            out.append((held, total))
            held, total = "", 0
        held, total = held + x, total + n
    out += [(held, total)] if held else []
    done = []
    for x, n in out:
        while n > most and x:
            k = max([j for j in range(1, len(x) + 1) if tokens(x[:j]) <= most] or [1])
            done.append(x[:k])
            x = x[k:]
        done += [x] if n <= most else []
    return [x.strip() for x in done if x.strip()]


def test_long_sentences(spark, small):
    texts = {r.item_id: r.text for r in catalog.table(spark, small, "benchmark").collect()}
    got = {}
    for r in catalog.QUERIES["long_sentence_parts"](spark, small).orderBy("item_id", "pos").collect():
        got.setdefault(r.item_id, []).append(r.part)
    assert got == {k: parts_of(t, 12) for k, t in texts.items() if parts_of(t, 12)}
    odd = ["", "  ", " , a\t\tb，c", "这" * 40 + "，好、" + "x " * 30, "!" * 70, "a,b" * 20, "long " + "，" * 3 + "字" * 16 + " end"]
    rows = spark.createDataFrame([(x,) for x in [*odd, None]], "t string").select("t", chunking.split_sentence(F.col("t"), 12).alias("p")).collect()
    assert {r.t: r.p for r in rows} == {x: parts_of(x, 12) for x in odd} | {None: []}


def test_folders_are_discarded(spark):
    from eventloom.operators import lineage

    one, two = lineage.materialize(spark.range(3)), lineage.materialize(spark.range(4))
    lineage.discard(one)
    assert two.count() == 4 and lineage.discard_all(spark) >= 1 and lineage.discard_all(spark) == 0
    with pytest.raises(Exception):
        spark.read.schema(two.schema).parquet(two.eventloom_folder).count()

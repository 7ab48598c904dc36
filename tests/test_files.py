"""Readers and writers come back with what went in; sections, short chunks and sentences against loops."""

import datetime as dt
import random
import re

import pytest
from eventloom import sources
from eventloom.operators import chunking
from eventloom.plans import q_text
from pyspark.sql import functions as F

ODD = [(1, "a", 1.5), (2, None, None), (None, "", 0.0), (4, 'quote " comma , line\nend\\', -1.0), (5, "ü 中文 \U0001f600", 1e300), (1, "a", 1.5)]
SCHEMA = "k int, t string, x double"


def same(df, rows):
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, df.collect()), key=order) == sorted(rows, key=order)


def test_round_trips(spark, tmp_path):
    rows, at = spark.createDataFrame(ODD, SCHEMA), lambda name: f"file://{tmp_path}/{name}"
    sources.write_jsonl(rows, at("jsonl"))
    same(sources.read_jsonl(spark, at("jsonl"), SCHEMA), ODD)
    sources.write_csv(rows, at("csv"))
    back = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", "\\").csv(at("csv"))
    assert back.count() == len(ODD) and sorted(r.x for r in back.collect() if r.x is not None) == [-1.0, 0.0, 1.5, 1.5, 1e300]
    rows.write.parquet(at("shards"))
    same(sources.read_parquet_shards(spark, at("shards")), ODD)
    assert sources.read_parquet_shards(spark, at("shards"), 2).count() == 2
    (tmp_path / "array.json").write_text('[{"k": 1, "t": "x"},\n {"k": 2}]')
    same(sources.read_json_array(spark, at("array.json"), "k int, t string"), [(1, "x"), (2, None)])
    (tmp_path / "bad.json").write_text('{"k": "no"}')
    with pytest.raises(Exception):
        sources.read_jsonl(spark, at("bad.json"), "k int").collect()


def test_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([(f"t{k}", f"text {k}\nmore") for k in range(7)], "title string, text string").coalesce(1)
    sources.write_markdown(docs, f"file://{tmp_path}/md", per_file=3)
    files = sorted(p.read_text() for p in (tmp_path / "md").glob("part-*"))
    assert len(files) == 3 and sum(f.count("# t") for f in files) == 7 and "# t0\n\ntext 0\nmore\n" in "".join(files)


def test_chunks_of_sources(spark, tmp_path):
    at = f"file://{tmp_path}/chunks"
    sources.save_chunks(spark.createDataFrame([("a", 1, "x"), ("a", 0, "w"), ("b", 0, "y")], "source_id string, rank int, content string"), at)
    sources.save_chunks(spark.createDataFrame([("a", 0, "new")], "source_id string, rank int, content string"), at)
    held = spark.read.parquet(at)
    assert [r.content for r in sources.stored_document(held, "a").collect()] == ["new"] and held.count() == 2


def test_conversation(spark):
    t = lambda k: dt.datetime(2024, 1, 1, 0, k)
    rows = spark.createDataFrame([("c", t(3), 0, "d"), ("c", t(1), None, "b"), ("c", t(2), 1, "gone"), ("o", t(1), 0, "x"), ("c", t(0), 0, "a")], "conversation_id string, ts timestamp, del_flag int, m string")
    assert [r.m for r in sources.conversation(rows, "c").collect()] == ["a", "b", "d"]
    assert [r.m for r in sources.conversation(rows, "c", t(1), t(3)).collect()] == ["b", "d"]


def sectioned(text):
    """Sections by a walk over the lines: a heading begins one, unless only headings have come since the last did."""
    out, now, last = [], [], None
    for line in text.split("\n"):
        head = re.match(r"\s*(#{1,6})\s+(.+)$", line)
        if head and last != "h":
            out.append(now)
            now = []
        now.append((line, (len(head[1]), head[2]) if head else None))
        last = "h" if head else "t" if line.strip(" ") else last
    found = []
    for lines in [*out, now]:
        content = "\n".join(x for x, _ in lines).strip()
        heads = [(h[0], k, h[1]) for k, (_, h) in enumerate(lines) if h]
        if content:
            level, _, title = min(heads) if heads else (None, None, None)
            found.append((len(found), title, level, content))
    return found


def test_sections(spark, small):
    rng = random.Random(2)
    parts = ["# One", "## Two  x", "text", "", "more text", "   ### Three", "#no heading", "####### seven"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(150)]
    got = {}
    for r in chunking.sections(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect():
        got.setdefault(r.k, []).append((r["rank"], r.heading, r.level, r.content))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == sectioned(t), t
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", sources.html_to_text(F.col("html")).alias("t")).collect()
    made = {}
    for r in q_text.page_text(spark, small).collect():
        made.setdefault(r.page_id, []).append((r["rank"], r.heading, r.level, r.content))
        assert r.char_count == len(r.content)
    for p in pages:
        assert sorted(made.get(p.page_id, [])) == sectioned(p.t or "")


def test_page_text(spark):
    html = "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var x = '<p>';</script></head><body><nav>menu</nav><h2 class=x>Sub</h2><p>one<br/>two &lt;3</p><!-- no --><div>three</div></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(sources.html_to_text(F.col("h")).alias("t")).first().t
    assert got.split("\n") == ["# A & B", "## Sub", "one", "two <3", "three"]


def test_short_chunks_are_merged(spark):
    rng = random.Random(3)
    rows = [(k, [(rng.choice([10, 50, 99, 100, 300]), rng.choice([5, 400, 900])) for _ in range(rng.randint(0, 9))]) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, c array<struct<length:int,size:int>>")
    got = {r.k: [tuple(x) for x in r.m] for r in df.select("k", chunking.merge_short(F.col("c"), "length", "size", 100, 1000).alias("m")).collect()}
    for k, chunks in rows:
        want, i = [], 0
        while i < len(chunks):
            joins = chunks[i][0] < 100 and i + 1 < len(chunks) and chunks[i][1] + chunks[i + 1][1] <= 1000
            want.append((i, i + joins))
            i += 1 + joins
        assert got[k] == want

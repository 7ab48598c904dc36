"""Segments of windows: a stream gives what the table gives, and both what loops give."""

import datetime as dt
import random

import pytest
from eventloom.streaming import segments, tasks
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "conversation_id string, ts timestamp, seq long, message_id string, sender_name string, content string"


def brute(rows, most, minutes=60):
    out, rank, by = [], {}, {}
    for r in sorted((r for r in rows if r[1]), key=lambda r: (r[0], r[1], r[2], r[3])):
        by.setdefault((r[0], (r[1] - DAY) // dt.timedelta(minutes=minutes)), []).append(r)
    for (key, window), ms in sorted(by.items()):
        parts, total = [[]], 0
        for m in ms:
            said = f"{m[4] or 'Unknown'}({m[1]:%Y-%m-%d %H:%M:%S}):\n{m[5] or ''}\n\n"
            words = len([w for w in said.replace("\n", " ").replace("(", " ").replace(")", " ").replace(":", " ").split() if w.isalpha()])
            n = max(1, words + int(sum(not (c.isalnum() or c.isspace() or c == "_") for c in said) * 0.5))
            if parts[-1] and total + n > most:
                parts.append([])
                total = 0
            parts[-1].append((m, said))
            total += n
        for k, p in enumerate(parts, 1):
            rank[key] = rank.get(key, -1) + 1
            heading = f"{p[0][0][1]:%Y-%m-%d %H:%M}-{p[-1][0][1]:%H:%M} 对话" + (f" (第{k}段)" if len(parts) > 1 else "")
            out.append((key, rank[key], k, heading, "".join(s for _, s in p).strip(), [m[3] for m, _ in p]))
    return out


def plain(df):
    return sorted((r.conversation_id, r["rank"], r.part, r.heading, r.content, r.references) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(rng.choice("abc"), DAY + dt.timedelta(minutes=4 * (k // 2)), k % 2, f"m{k:03d}", rng.choice(["Ann", None]), rng.choice([None, "", "one two", "three four five " * rng.randint(1, 9)])) for k in range(150)]


def test_table(spark, rows):
    df = spark.createDataFrame([*rows, ("a", None, 0, "x", None, "no time")], SCHEMA)
    got = plain(segments.window_segments(df, most=60))
    assert got == brute(rows, 60) and any("段" in r[3] for r in got) and any("段" not in r[3] for r in got)
    assert segments.window_segments(df.limit(0)).count() == 0


def test_stream_equals_table(spark, tmp_path, rows):
    rng = random.Random(1)
    files = [rows[:80], rows[80:], [("z", DAY + dt.timedelta(days=30), 0, "end", None, "")], [("a", DAY, 0, "late", None, "much too late"), ("z", DAY + dt.timedelta(days=60), 0, "end2", None, "")]]
    for part in files:
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = segments.window_segments(stream, most=60).writeStream.format("memory").queryName("parts").outputMode("append")
    out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(200)
    got = [r for r in plain(spark.table("parts")) if r[0] != "z"]
    assert got == brute(rows, 60)


def test_pipeline_restarts(spark, tmp_path, monkeypatch):
    """Stopped after the results and before the states are written, then started again: each document once."""
    schema = "id int, text string"
    for part in ([(1, "a"), (2, "bad"), (3, "c")], [(4, "d"), (5, "lost")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    landed = spark.read.schema(schema).json(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")

    def work(docs):
        return docs.where("text <> 'lost'").withColumn("error", F.when(F.col("text") == "bad", "unreadable"))

    folder, calls = f"{tmp_path}/out", []
    writer = type(landed.write)
    write = writer.parquet

    def stopped(self, path, *a, **k):
        if "/status/" in path:
            calls.append(path)
            if len(calls) == 2:
                raise OSError("executor of the driver is gone")
        return write(self, path, *a, **k)

    monkeypatch.setattr(writer, "parquet", stopped)
    with pytest.raises(Exception):
        tasks.process(stream(), "id", work, folder).awaitTermination()
    assert {r.status for r in tasks.status(spark, folder, "id", landed).collect()} == {"processing", "pending"}
    tasks.process(stream(), "id", work, folder).awaitTermination()
    tasks.process(stream(), "id", work, folder).awaitTermination()  # nothing new
    assert sorted(r.id for r in tasks.results(spark, folder).collect()) == [1, 3, 4]
    got = {r.id: (r.status, r.reason) for r in tasks.status(spark, folder, "id", landed).collect()}
    assert got == {1: ("completed", None), 2: ("failed", "unreadable"), 3: ("completed", None), 4: ("completed", None), 5: ("failed", "no result")}
    assert tuple(tasks.progress(tasks.status(spark, folder, "id", landed)).first()) == (5, 0, 0, 3, 2, 100.0)


def test_pipeline_whose_work_fails(spark, tmp_path):
    spark.createDataFrame([(1,)], "id int").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int").json(f"{tmp_path}/in")

    def work(docs):
        raise ValueError("no model")

    tasks.process(stream, "id", work, f"{tmp_path}/out").awaitTermination()
    assert [tuple(r)[:3] for r in tasks.status(spark, f"{tmp_path}/out", "id").collect()] == [(1, "failed", "ValueError: no model")]

"""Streams against the batch operators, over files that arrive out of order."""

import datetime as dt
import random

from eventloom import streaming

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "conversation_id string, ts timestamp, seq long, tokens long"


def packed(rows, most):
    want, by = [], {}
    for key, ts, seq, n in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(key, []).append(n)
    for key, sizes in by.items():
        batches = [[]]
        for n in sizes:
            if batches[-1] and sum(batches[-1]) + n > most:
                batches.append([])
            batches[-1].append(n)
        want += [(key, k, len(b), sum(b)) for k, b in enumerate(batches)]
    return sorted(want)


def test_packed_segments(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), DAY + dt.timedelta(minutes=k), k, rng.randint(1, 60)) for k in range(120)] + [("d", DAY, 0, 500)]
    end = [("z", DAY + dt.timedelta(days=5), 999, 1)]  # brings the watermark past all others
    files = [rows[:60], rows[60:], end]
    for k in range(55, 65):  # late, but within the delay: some of each part come with the other
        if k % 2:
            home = files[k >= 60]
            home.remove(rows[k])
            files[k < 60].append(rows[k])
    for k, part in enumerate(files):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streaming.packed_segments(stream, most=100).writeStream.format("memory").queryName("segments").outputMode("append")
    out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(100)
    got = [tuple(r)[:4] for r in spark.table("segments").collect()]
    assert sorted(got) == packed(rows, 100)


def test_first_of_each_key(spark):
    rows = [("a", DAY + dt.timedelta(hours=k), k, 100 - k) for k in (3, 1, 2)] + [(None, DAY, 7, 1), ("b", DAY, 5, None)]
    got = streaming.dedup(spark.createDataFrame(rows, SCHEMA), "conversation_id", "ts")
    assert got.columns == ["conversation_id", "ts", "seq", "tokens"]
    assert {(r.conversation_id, r.seq) for r in got.collect()} == {("a", 1), (None, 7), ("b", 5)}

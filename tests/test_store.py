"""The store over a table, over a stream, and as its last values, against a dictionary."""

import datetime as dt
import json
import random

import pytest
from eventloom.streaming import store

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "key string, op string, field string, value string, ttl_ms long, ts timestamp, seq long"
OPS = ["set", "get", "incr", "exists", "delete", "expire", "ttl", "hset", "hget", "hdel", "hgetall", "sadd", "srem", "sismember", "smembers"]


def brute(rows):
    held, out = {}, []
    for key, op, field, value, ttl, ts, seq in sorted((r for r in rows if r[0]), key=lambda r: (r[5], r[6])):
        at = int((ts - DAY).total_seconds() * 1000)
        k = held.get(key, {})
        if k.get("until") is not None and at >= k["until"]:
            k = {}
        h, s = k.setdefault("h", {}), k.setdefault("s", set())
        alive = "v" in k or bool(h) or bool(s)
        r = None
        if op == "set":
            k["v"], k["until"], r = value or "", None if ttl is None else at + ttl, "OK"
        elif op == "get":
            r = k.get("v")
        elif op == "incr":
            try:
                k["v"] = r = str(int(k.get("v") or 0) + int(value or 1))
            except ValueError:
                r = "error: not a whole number"
        elif op == "exists":
            r = str(int(alive))
        elif op == "delete":
            k, r = {}, str(int(alive))
        elif op == "expire":
            r = str(int(alive))
            if alive:
                k["until"] = at + (ttl or 0)
        elif op == "ttl":
            r = None if k.get("until") is None else str(k["until"] - at)
        elif op == "hset":
            r = str(int((field or "") not in h))
            h[field or ""] = value or ""
        elif op == "hget":
            r = h.get(field)
        elif op == "hdel":
            r = str(int(h.pop(field or "", None) is not None))
        elif op == "hgetall":
            r = json.dumps(h, ensure_ascii=False, sort_keys=True)
        elif op == "sadd":
            r = str(int((value or "") not in s))
            s.add(value or "")
        elif op == "srem":
            r = str(int((value or "") in s))
            s.discard(value or "")
        elif op == "sismember":
            r = str(int(value in s))
        elif op == "smembers":
            r = json.dumps(sorted(s), ensure_ascii=False)
        else:
            r = f"error: no operation {op}"
        held[key] = k
        out.append((key, seq, op, r))
    return sorted(out)


def plain(df):
    return sorted((r.key, r.seq, r.op, r.result) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(rng.choice(["a", "b", "ü"]), rng.choice(OPS), rng.choice(["f", "g"]), rng.choice(["1", "7", "x", None]), rng.choice([None, 5000, 60_000]), DAY + dt.timedelta(seconds=2 * k), k) for k in range(400)]
    return [*out, (None, "get", None, None, None, DAY, 900), ("a", "fly", None, None, None, DAY, 901)]


def test_table(spark, rows):
    assert plain(store.store(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert store.store(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream(spark, tmp_path, rows):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store.ROCKSDB)
    try:
        own = sorted((r for r in rows if r[0]), key=lambda r: (r[5], r[6]))
        for part in (own[:150], own[150:300], own[300:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = store.store(stream).writeStream.format("memory").queryName("answers").outputMode("append")
        out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(200)
        assert plain(spark.table("answers")) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_latest(spark):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [("a", "set", None, "1", None, at(0), 0), ("a", "set", None, "2", None, at(0), 1), ("b", "set", None, "1", 5000, at(0), 0), ("c", "set", None, "1", 50_000, at(0), 0), ("d", "set", None, "1", None, at(1), 0),
            ("d", "delete", None, None, None, at(2), 0), ("e", "set", None, None, None, at(90), 0), ("a", "get", None, None, None, at(3), 0)]
    got = store.latest(spark.createDataFrame(rows, SCHEMA), at(5)).collect()
    assert sorted((r.key, r.value, r.expires) for r in got) == [("a", "2", None), ("c", "1", at(50))]

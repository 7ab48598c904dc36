"""A store of keys with lifetimes over a stream of operations: values, counters, hashes and sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that holds values, maps and timers; the session must name it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ASKED = ["key", "op", "field", "value", "ttl_ms", "at", "seq"]
_RESULT = ["key", "at", "seq", "op", "result"]


class _Memory:
    """One key's state in a task: for replay over a table."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.text, self.until, self.hash, self.set = None, None, {}, set()

    def get(self):
        return self.text

    def put(self, text: str) -> None:
        self.text = text

    def expires(self):
        return self.until

    def expire(self, at: int | None) -> None:
        self.until = at

    def field(self, name: str):
        return self.hash.get(name)

    def put_field(self, name: str, text: str) -> None:
        self.hash[name] = text

    def drop_field(self, name: str) -> None:
        self.hash.pop(name, None)

    def fields(self) -> dict:
        return dict(self.hash)

    def has(self, member: str) -> bool:
        return member in self.set

    def add(self, member: str) -> None:
        self.set.add(member)

    def remove(self, member: str) -> None:
        self.set.discard(member)

    def members(self) -> list:
        return list(self.set)

    def exists(self) -> bool:
        return self.text is not None or bool(self.hash) or bool(self.set)


class _Held:
    """The same over Spark's state: only what an operation names is read."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.now = handle, None
        self.value = handle.getValueState("value", "text string")
        self.until = handle.getValueState("until", "at long")
        self.hash = handle.getMapState("hash", "field string", "text string")
        self.set = handle.getMapState("set", "member string", "one int")

    def clear(self) -> None:
        self.expire(None)
        for state in (self.value, self.hash, self.set):
            state.clear()

    def get(self):
        return self.value.get()[0] if self.value.exists() else None

    def put(self, text: str) -> None:
        self.value.update((text,))

    def expires(self):
        return self.until.get()[0] if self.until.exists() else None

    def expire(self, at: int | None) -> None:
        if (old := self.expires()) is not None:
            self.handle.deleteTimer(old)
            self.until.clear()
        if at is not None:
            self.until.update((at,))
            self.handle.registerTimer(at)

    def field(self, name: str):
        return self.hash.getValue((name,))[0] if self.hash.containsKey((name,)) else None

    def put_field(self, name: str, text: str) -> None:
        self.hash.updateValue((name,), (text,))

    def drop_field(self, name: str) -> None:
        self.hash.removeKey((name,))

    def fields(self) -> dict:
        return {k[0]: v[0] for k, v in self.hash.iterator()}

    def has(self, member: str) -> bool:
        return self.set.containsKey((member,))

    def add(self, member: str) -> None:
        self.set.updateValue((member,), (1,))

    def remove(self, member: str) -> None:
        self.set.removeKey((member,))

    def members(self) -> list:
        return [k[0] for k in self.set.keys()]

    def exists(self) -> bool:
        return self.value.exists() or self.hash.exists() or self.set.exists()


def _apply(state, op: str, field: str | None, value: str | None, ttl: int | None, at: int) -> str | None:
    """What an operation gives at a time, in milliseconds."""
    until = state.expires()
    if until is not None and at >= until:
        state.clear()
    flag = lambda x: "1" if x else "0"
    if op == "get":
        return state.get()
    if op == "exists":
        return flag(state.exists())
    if op == "hget":
        return state.field(field)
    if op == "hgetall":
        return json.dumps(state.fields(), ensure_ascii=False, sort_keys=True)
    if op == "sismember":
        return flag(state.has(value))
    if op == "smembers":
        return json.dumps(sorted(state.members()), ensure_ascii=False)
    if op == "ttl":
        until = state.expires()
        return None if until is None else str(until - at)
    if op == "set":
        state.put(value or "")
        state.expire(None if ttl is None else at + ttl)
        return "OK"
    if op == "incr":
        try:
            new = str(int(state.get() or 0) + int(value or 1))
        except ValueError:
            return "error: not a whole number"
        state.put(new)
        return new
    if op == "hset":
        new = state.field(field or "") is None
        state.put_field(field or "", value or "")
        return flag(new)
    if op == "hdel":
        had = state.field(field or "") is not None
        state.drop_field(field or "")
        return flag(had)
    if op == "sadd":
        new = not state.has(value or "")
        state.add(value or "")
        return flag(new)
    if op == "srem":
        had = state.has(value or "")
        state.remove(value or "")
        return flag(had)
    if op == "expire":
        had = state.exists()
        if had:
            state.expire(at + (ttl or 0))
        return flag(had)
    if op == "delete":
        had = state.exists()
        state.clear()
        return flag(had)
    return f"error: no operation {op}"


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """Operations in order of time and number."""
    none = lambda x: None if x is None or x != x else x
    rows = [tuple(map(none, r)) for pdf in frames for r in pdf[_ASKED].itertuples(index=False)]
    return sorted(rows, key=lambda r: (r[5], r[6]))


def _answers(state, rows: list[tuple]) -> pd.DataFrame:
    made = [(key, at, seq, op, _apply(state, op, field, value, None if ttl is None else int(ttl), int(at))) for key, op, field, value, ttl, at, seq in rows]
    return pd.DataFrame(made, columns=_RESULT)


class Store(StatefulProcessor):
    """A key's operations; a timer forgets it when its lifetime has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = _Held(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield _answers(self.state, _rows(rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.state.expires()
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame([], columns=_RESULT)

    def close(self) -> None:
        pass


def _asked(operations: DataFrame, ts: str) -> DataFrame:
    return operations.where(F.col("key").isNotNull() & F.col(ts).isNotNull()).select(
        "key", "op", "field", "value", F.col("ttl_ms").cast("long").alias("ttl_ms"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), ts
    )


def _shaped(found: DataFrame) -> DataFrame:
    return found.select("key", F.timestamp_millis("at").alias("ts"), "seq", "op", "result")


def store(operations: DataFrame, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, ts, seq, op, result): the answer to each operation (key, op, field, value, ttl_ms, ts, seq).

    set (with a lifetime, which a set without one ends), get, incr, exists, delete, expire, ttl; hset, hget, hdel,
    hgetall; sadd, srem, sismember, smembers. Lists and hashes are answered as JSON. Operations of a key take effect by
    time, then seq; in a stream, within the batch that brings them, and a batch's after those before. Lifetimes count in
    the operations' own time: a key whose time is up is gone for later operations, and its state is removed when the
    watermark has passed. A stream needs ROCKSDB as the session's state store. Rows without a key or a time are left out.
    """
    if not operations.isStreaming:
        return replay(operations, ts)
    rows = _asked(operations.withWatermark(ts, late), ts)
    found = rows.groupBy("key").transformWithStateInPandas(Store(), "key string, at long, seq long, op string, result string", "Append", "EventTime")
    return _shaped(found)


def replay(operations: DataFrame, ts: str = "ts") -> DataFrame:
    """store() over a table: a key's operations are run in one task, and held there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _answers(_Memory(), _rows(iter([frame])))

    return _shaped(_asked(operations, ts).groupBy("key").applyInPandas(run, "key string, at long, seq long, op string, result string"))


def latest(operations: DataFrame, now, ts: str = "ts") -> DataFrame:
    """(key, value, expires) of the keys that are alive at a time: the last set of each, unless it was deleted or its
    lifetime has ended. One aggregation; other operations than set and delete are not looked at."""
    rows = _asked(operations, ts).where(F.col("op").isin("set", "delete") & (F.col(ts) <= F.lit(now).cast("timestamp")))
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "value", (F.col("at") + F.col("ttl_ms")).alias("until")), F.struct("at", "seq")).alias("x")).select("key", "x.*")
    alive = last.where((F.col("op") == "set") & (F.col("until").isNull() | (F.col("until") > F.unix_millis(F.lit(now).cast("timestamp")))))
    return alive.select("key", F.coalesce("value", F.lit("")).alias("value"), F.timestamp_millis("until").alias("expires"))

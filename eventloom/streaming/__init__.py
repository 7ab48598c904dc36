"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def window_counts(messages: DataFrame, ts: str = "ts", minutes: int = 60, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """(by, window_start, window_end, n) of tumbling windows; the same plan for a table and a stream.

    In a stream a window is given out when the watermark, one interval by default, has passed its end.
    """
    rows = messages.withWatermark(ts, late or f"{minutes} minutes") if messages.isStreaming else messages
    out = rows.groupBy(F.window(ts, f"{minutes} minutes"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def dedup(rows: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first of each key: within the watermark in a stream, by time in a table (ties by a hash of the row)."""
    if rows.isStreaming:
        return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    order = F.struct(F.col(ts), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.groupBy(F.col(key).alias("dedup_key")).agg(F.min_by(whole, order).alias("dedup_row")).select("dedup_row.*")


def packed_segments(messages: DataFrame, key: str = "conversation_id", size: str = "tokens", most: int = 8000, ts: str = "ts", seq: str = "seq", late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """(key, segment, n, tokens, start_ms) of a stream of messages: a segment ends when the next one would go over most.

    Messages are packed by time, then seq, whatever batch brings them: each waits until the watermark has reached it, so
    a key's state holds those of one delay. When the watermark has gone idle beyond a key's last message, its open
    segment is given out and its state goes; a later message begins at segment 0 again, told apart by start_ms.
    A null size counts 0.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(ids: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, n, total, start, last, *held = state.get if state.exists else (0, 0, 0, 0, 0, [], [], [])
        held = list(zip(*held, strict=True))
        for pdf in batches:
            held += zip(pdf["at_ms"].tolist(), pdf["seq"].tolist(), pdf["size"].tolist(), strict=True)
        mark, out = state.getCurrentWatermarkMs(), []
        held.sort()
        ready = sum(x[0] <= mark for x in held)
        for at, _, x in held[:ready]:
            if n and total + x > most:
                out.append((ids[0], segment, n, total, start))
                segment, n, total = segment + 1, 0, 0
            start = start if n else at
            n, total, last = n + 1, total + x, at
        held = held[ready:]
        if not held and mark >= last + wait:
            if n:
                out.append((ids[0], segment, n, total, start))
            if state.exists:
                state.remove()
        else:
            state.update((segment, n, total, start, last, *([x[k] for x in held] for k in range(3))))
            state.setTimeoutTimestamp(max(mark + 1, held[0][0] if held else last + wait))
        yield pd.DataFrame(out, columns=[key, "segment", "n", "tokens", "start_ms"])

    kind = messages.schema[key].dataType.simpleString()
    rows = messages.withWatermark(ts, late).select(F.col(key).alias("key"), ts, F.unix_millis(ts).alias("at_ms"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    held = "segment int, n int, tokens long, start long, last long, ats array<long>, seqs array<long>, sizes array<long>"
    return rows.groupBy("key").applyInPandasWithState(step, f"`{key}` {kind}, segment int, n int, tokens long, start_ms long", held, "append", "EventTimeTimeout")


def landing(spark, path: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands each batch of new JSON files in a folder to a function, once."""
    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

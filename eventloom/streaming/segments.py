"""Conversations cut by time windows and, within them, by tokens; one plan for tables, one operator for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from eventloom.functions import text as tx
from eventloom.operators import chunking as ch

# What a heading says of a segment, and of one of several of a window.
TITLE, PART = " 对话", " (第{}段)"
UNKNOWN = "Unknown"


def window_segments(messages: DataFrame, key: str = "conversation_id", ts: str = "ts", seq: str = "seq", message: str = "message_id", sender: str = "sender_name", content: str = "content", minutes: int = 60, most: int = 8000, late: str = "1 hour", idle: str = "7 days") -> DataFrame:
    """(key, rank, window_start, part, heading, content, references, tokens): the segments of each window of a
    conversation, by time, then seq; a new one begins where the next message would go over `most` estimated tokens.

    Windows are of whole multiples of `minutes`. rank counts a conversation's segments, part a window's; headings name
    the part where a window has several. Messages without a time are left out, null contents are empty, equal times and
    numbers go by message id. In a stream a window is cut when the watermark has passed its end; messages that come
    later than that are dropped. A conversation's state holds its open windows, and is forgotten with its rank when the
    watermark has gone `idle` beyond the last one.
    """
    said = F.concat(F.coalesce(sender, F.lit(UNKNOWN)), F.lit("("), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("):\n"), F.coalesce(content, F.lit("")), F.lit("\n\n"))
    rows = messages.where(F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, late) if messages.isStreaming else rows
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("seq"), F.col(message).cast("string").alias("id"), said.alias("said"))
    rows = rows.withColumn("tokens", tx.chunk_tokens(F.col("said")).cast("long"))
    return _stream(rows, key, messages, minutes, most, idle) if messages.isStreaming else _table(rows, key, minutes, most)


def _heading(first: Column, last: Column, part: Column, several: Column) -> Column:
    clock = lambda c, how: F.date_format(F.timestamp_millis(c), how)
    before, after = PART.split("{}")
    return F.concat(clock(first, "yyyy-MM-dd HH:mm"), F.lit("-"), clock(last, "HH:mm"), F.lit(TITLE), F.when(several, F.concat(F.lit(before), part.cast("string"), F.lit(after))).otherwise(""))


def _shape(parts: DataFrame, key: str) -> DataFrame:
    """From (key, rank, start, part, several, first, last, content, references, tokens)."""
    return parts.select(F.col("key").alias(key), "rank", F.timestamp_millis("start").alias("window_start"), "part", _heading(F.col("first"), F.col("last"), F.col("part"), F.col("several")).alias("heading"), "content", "references", "tokens")


def _table(rows: DataFrame, key: str, minutes: int, most: int) -> DataFrame:
    start = (F.floor(F.col("at") / (minutes * 60_000)) * (minutes * 60_000)).cast("long")
    whole = rows.groupBy("key", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("at", "seq", "id", "said", "tokens"))).alias("m"))
    cut = whole.withColumn("parts", ch.pack(F.col("m"), "tokens", most))
    each = cut.select("key", "start", "m", (F.size("parts") > 1).alias("several"), F.posexplode("parts").alias("p", "x"))
    items = F.transform("x.items", lambda i: F.get("m", i))
    each = each.select("key", "start", "several", (F.col("p") + 1).alias("part"), items.alias("i"), F.col("x.total").alias("tokens"))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("start", "part")) - 1)
    text = F.regexp_replace(F.array_join(F.transform("i", lambda x: x["said"]), ""), r"(?U)^\s+|\s+$", "")
    return _shape(each.select("key", "rank", "start", "part", "several", F.get("i", F.lit(0))["at"].alias("first"), F.element_at("i", -1)["at"].alias("last"), text.alias("content"), F.transform("i", lambda x: x["id"]).alias("references"), "tokens"), key)


def _stream(rows: DataFrame, key: str, messages: DataFrame, minutes: int, most: int, idle: str) -> DataFrame:
    width, wait = minutes * 60_000, int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = ["key", "rank", "start", "part", "several", "first", "last", "content", "references", "tokens"]

    def step(ids: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, closed, last, *held = state.get if state.exists else (0, 0, 0, [], [], [], [], [])
        held = list(zip(*held, strict=True))
        for pdf in batches:
            held += zip(*(pdf[c].tolist() for c in ("at", "seq", "id", "said", "tokens")), strict=True)
        mark, out = state.getCurrentWatermarkMs(), []
        end = lambda m: m[0] // width * width + width
        held = sorted((m for m in held if end(m) > closed), key=lambda m: (*m[:2], m[2] is not None, m[2] or ""))
        last = max([last, *(end(m) for m in held)])
        while held and end(held[0]) <= mark:
            whole = [m for m in held if end(m) == end(held[0])]
            held = held[len(whole) :]
            parts = [[]]
            for m in whole:
                if parts[-1] and sum(x[4] for x in parts[-1]) + m[4] > most:
                    parts.append([])
                parts[-1].append(m)
            for n, p in enumerate(parts, 1):
                out.append((ids[0], rank, end(p[0]) - width, n, len(parts) > 1, p[0][0], p[-1][0], "".join(m[3] for m in p).strip(), [m[2] for m in p], sum(m[4] for m in p)))
                rank += 1
        if not held and mark >= last + wait:
            if state.exists:
                state.remove()
        else:
            state.update((rank, max(mark, closed), last, *([m[k] for m in held] for k in range(5))))
            state.setTimeoutTimestamp(max(mark + 1, end(held[0]) if held else last + wait))
        yield pd.DataFrame(out, columns=columns)

    kind = messages.schema[key].dataType.simpleString()
    held = "rank int, closed long, last long, ats array<long>, seqs array<long>, ids array<string>, said array<string>, tokens array<long>"
    made = f"key {kind}, rank int, start long, part int, several boolean, first long, last long, content string, references array<string>, tokens long"
    return _shape(rows.groupBy("key").applyInPandasWithState(step, made, held, "append", "EventTimeTimeout"), key)

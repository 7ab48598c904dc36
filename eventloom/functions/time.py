"""Date and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO 8601 with Z or an offset; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def format_datetime(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def _seconds(ts: Column, now: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(ts.cast("timestamp")) / 1e6


def time_ago(ts: Column, now: Column) -> Column:
    s = _seconds(ts, now)
    days = F.floor(s / 86400)
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    return (
        F.when(s < 60, "刚刚").when(s < 3600, n(s / 60, "分钟前")).when(s < 86400, n(s / 3600, "小时前"))
        .when(s < 86400 * 30, n(days, "天前")).when(s < 86400 * 365, n(days / 30, "个月前")).otherwise(n(days / 365, "年前"))
    )


def time_decay(ts: Column, now: Column, factor: float = 0.01) -> Column:
    return F.exp(-factor * F.floor(_seconds(ts, now) / 86400))


def time_entity(ts: Column) -> Column:
    return F.date_format(ts, "yyyy'年'MM'月'dd'日' HH:mm:ss")

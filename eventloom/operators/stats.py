"""Statistics over typed entity values and their links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_profile(values: DataFrame, value: str) -> DataFrame:
    """One row: n, low, high, mean, median of the non-null values; true values, 0 included."""
    v = F.col(value)
    facts = values.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))
    return facts.withColumn("median", F.lit(median(values, value)).cast("double"))


#: Values among which the median is found in one task.
MEDIAN_IN_ONE = 1 << 20


def median(values: DataFrame, value: str, bins: int = 4096) -> float | None:
    """The exact median of the non-null values, none without any.

    Values are counted in bins, whose counts tell which bin holds the middle; its values are looked at again in the same
    way, until they are few or all the same.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    span = lambda r: r.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    n, low, high = span(rows)
    if not n:
        return None
    ranks, below, inside = ((n - 1) // 2, n // 2), 0, n
    while inside > MEDIAN_IN_ONE and high > low:
        no = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1))
        kept, at = [], below
        for r in rows.groupBy(no.alias("no")).agg(F.count(F.lit(1)).alias("n")).orderBy("no").collect():  # so many bins at most
            if at <= ranks[1] and at + r.n > ranks[0]:
                kept, below = [*kept, r.no], below if kept else at
            at += r.n
        rows = rows.where(no.between(kept[0], kept[-1]))
        last = inside
        inside, low, high = span(rows)
        if inside == last:
            break
    counted = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.select("v", (F.sum("n").over(order) + below).alias("upto"))
    ends = upto.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]).first()
    return (ends[0] + ends[1]) / 2


def histogram(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, label, n) of equal-width bins, the last closed, empty ones included; no rows where all values are equal.

    One pass finds the range, one counts; the range is a single row.
    """
    v = F.col(value)
    span = values.where(v.isNotNull()).agg(F.min(v).alias("low"), F.max(v).alias("high")).where("high > low")
    rows = values.where(v.isNotNull()).select(v.alias("v")).join(F.broadcast(span))
    width = (F.col("high") - F.col("low")) / bins
    counted = rows.groupBy(F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.select("low", width.alias("width"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    edge = lambda k: F.format_string("%.2f", F.col("low") + (F.col("bin") + k) * F.col("width"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.concat(edge(0), F.lit("-"), edge(1)).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


#: Any other granularity counts as day.
PERIODS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


def time_trend(values: DataFrame, ts: str, granularity: str = "day") -> DataFrame:
    return values.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, PERIODS.get(granularity, PERIODS["day"])).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def enum_distribution(values: DataFrame, value: str) -> DataFrame:
    """(value, n, share): share of all rounded to 4; the total is one row."""
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def cooccurrence(edges: DataFrame, target, event: str = "event_id", entity: str = "entity_id", limit: int | None = 10) -> DataFrame:
    """(entity, n, strength) of the entities that share events with the target; strength is n to the target's events.

    A self-join on the event of the target's edges with all; edges are distinct pairs. limit: a top-k report.
    """
    own = edges.where(F.col(entity) == target).select(event)
    others = edges.where(F.col(entity) != target).join(own, event, "left_semi").groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    out = others.join(F.broadcast(own.agg(F.count(F.lit(1)).alias("events")))).select(entity, "n", F.round(F.col("n") / F.col("events"), 2).alias("strength"))
    return out if limit is None else out.orderBy(F.desc("n"), entity).limit(limit)


def entity_summary(entities: DataFrame, value_type: str) -> DataFrame:
    """(value_type, n); a null type counts as text, together with text itself."""
    return entities.groupBy(F.coalesce(F.col(value_type), F.lit("text")).alias("value_type")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(rows: DataFrame, **columns: tuple[str, Sequence[str]]) -> DataFrame:
    """One row: total and, for each prefix=(column, values), the rows of each value, 0 where there are none."""
    counts = [F.count_if(F.col(c) == v).alias(f"{prefix}_{v.lower()}") for prefix, (c, vs) in columns.items() for v in vs]
    return rows.agg(F.count(F.lit(1)).alias("total"), *counts)


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """parents and, for each name=(rows, foreign key), how many of those rows refer to the parent, 0 where none do."""
    out = parents
    for name, (rows, foreign) in children.items():
        n = rows.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, key, "left")
    return out.na.fill(0, list(children))


def audit(rows: DataFrame, distinct: Sequence[str] = (), spans: Sequence[str] = (), tests: dict[str, Column] | None = None) -> DataFrame:
    """A data-quality profile in one row: rows, distinct and filled counts, lowest and highest values, rows that meet a test."""
    made = [F.count(F.lit(1)).alias("n")]
    made += [x for c in distinct for x in (F.countDistinct(c).alias(f"distinct_{c}"), F.count(c).alias(f"filled_{c}"))]
    made += [x for c in spans for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    return rows.agg(*made, *[F.count_if(t).alias(name) for name, t in (tests or {}).items()])


def page(rows: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """One page of a total order, with the total of all rows in each row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page_no - 1) * size).limit(size).join(F.broadcast(total))


def share_of_total(rows: DataFrame, n: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))

"""Table maintenance as rewrites: upserts, soft deletes, purges, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get_or_create(known: DataFrame, raw: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """known and a row for each new natural key of raw, the first by all columns, with its id made from the natural key."""
    own = [c for c in known.columns if c != key]
    first = raw.withColumn("nth", F.row_number().over(Window.partitionBy(*natural).orderBy(*own))).where("nth = 1")
    new = first.join(known, list(natural), "left_anti").select(F.sha2(F.concat_ws("\x1f", *natural), 256).alias(key), *own)
    return known.select(F.col(key).cast("string"), *own).unionByName(new)


def upsert(known: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those of the same key; status says inserted, updated, unchanged or kept."""
    values = [c for c in known.columns if c != key]
    old, new = known.select(key, F.struct(*values).alias("old")), rows.select(key, F.struct(*values).alias("new"))
    both = old.join(new, key, "full")
    status = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(key, F.coalesce("new", "old").alias("v"), status.alias("status")).select(key, "v.*", "status")


def orphans(rows: DataFrame, sources: DataFrame, column: str = "source_config_id") -> DataFrame:
    """Rows whose source no longer exists."""
    return rows.join(sources.select(column), column, "left_anti")


def mark_deleted(rows: DataFrame, sources: DataFrame, column: str = "source_config_id") -> DataFrame:
    known = sources.select(column).distinct().withColumn("known", F.lit(True))
    return rows.join(known, column, "left").withColumn("is_delete", F.coalesce("is_delete", F.lit(False)) | F.col("known").isNull()).drop("known")


def purge(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("is_delete", F.lit(False)))


def delete_where(rows: DataFrame, **lists: Sequence) -> DataFrame:
    """Deletes rows that are in every given list; no list, or an empty one, deletes nothing."""
    if not lists or not all(lists.values()):
        return rows
    test = F.lit(True)
    for c, values in lists.items():
        test &= F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    return rows.where(~test)


def cascade(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """children whose parent is left."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")


def transition(rows: DataFrame, to: str, final: Sequence[str] = ("COMPLETED", "FAILED", "CANCELLED"), status: str = "status") -> DataFrame:
    """Sets a status unless the row is finished."""
    return rows.withColumn(status, F.when(F.col(status).isin(list(final)), F.col(status)).otherwise(to))


def backfill(rows: DataFrame) -> DataFrame:
    """source_id from article_id or conversation_id, by source_type, where it is missing."""
    return rows.withColumn("source_id", F.coalesce("source_id", F.when(F.col("source_type") == "ARTICLE", F.col("article_id")).when(F.col("source_type") == "CHAT", F.col("conversation_id"))))


def delete_source(rows: DataFrame, source, dry_run: bool = False, column: str = "source_config_id") -> DataFrame:
    """The rows without a tenant's; a dry run gives their number instead."""
    own = F.col(column) == source
    return rows.where(own).agg(F.count(F.lit(1)).alias("n")) if dry_run else rows.where(~F.coalesce(own, F.lit(False)))


def replace_by(known: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """rows take the place of all known rows with the same value of column."""
    return known.join(rows.select(column).distinct(), column, "left_anti").unionByName(rows)


def associations(events: DataFrame, types: DataFrame, separator: str = "、") -> DataFrame:
    """(event_id, type, name, weight, description): raw entities of events (array of type, name, description) united.

    A name counts once in an event and type; its distinct descriptions are joined in order; weight is the type's.
    """
    each = events.select("event_id", F.posexplode("entities").alias("pos", "e")).select("event_id", "pos", "e.type", F.trim("e.name").alias("name"), "e.description").where(F.length("name") > 1)
    one = each.groupBy("event_id", "type", F.lower("name").alias("low")).agg(F.min_by("name", "pos").alias("name"), F.array_sort(F.collect_list(F.struct("pos", "description"))).alias("d"))
    joined = F.array_join(F.array_distinct(F.transform("d", lambda x: x["description"])), separator)
    return one.join(types.select("type", "weight"), "type", "left").select("event_id", "type", "name", F.coalesce("weight", F.lit(1.0)).alias("weight"), joined.alias("description"))


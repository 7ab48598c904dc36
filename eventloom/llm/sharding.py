"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand slots; bytes are summed per slot; a small versioned table maps slots
to shards and only that table is edited when shards must be balanced or their number changes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, shared_folder

#: Slots; a power of two far above any number of shards, and small enough for a table of slots to be broadcast.
SLOTS = 4096


def slot_of(key: str, text: str, slots: int = SLOTS) -> Column:
    """The record's virtual slot: a hash of its key, of its text where the key is null."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col(text)))), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, records) of every slot, empty ones too; records has vslot and size."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(used), "vslot", "left").na.fill(0, ["bytes", "records"])  # used: a row a slot at most


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def edit_map(old: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: the bytes of the shards get near equal, and slots stay where they can.

    A shard keeps its largest slots as long as their sum stays within the mean; what is above it, and the slots of
    shards beyond the new number, is given, largest first, to the shard that has least. Works on the table of slots,
    whose size is fixed, so one small group holds it.
    """
    slots = old.join(F.broadcast(load), "vslot")  # a row a slot
    total = slots.withColumn("mean", F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards)
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    marked = total.withColumn("kept", (F.col("shard") < shards) & (F.sum("bytes").over(by_size) <= F.col("mean")))
    one = marked.groupBy().agg(
        F.max("version").alias("version"),
        F.collect_list(F.when(F.col("kept"), F.struct("vslot", "shard", "bytes"))).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("free"),
    )
    start = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda a, k: a + k["bytes"]).alias("load"), s.alias("shard")),
    )
    one = one.withColumn("start", start)

    def give(acc: Column, slot: Column) -> Column:
        least = F.array_min(acc["loads"])
        loads = F.transform(acc["loads"], lambda x: F.struct(F.when(x["shard"] == least["shard"], x["load"] - slot["less"]).otherwise(x["load"]).alias("load"), x["shard"].alias("shard")))
        return F.struct(loads.alias("loads"), F.array_append(acc["given"], F.struct(slot["vslot"].alias("vslot"), least["shard"].alias("shard"))).alias("given"))

    zero = F.struct(F.col("start").alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("given"))
    given = F.aggregate("free", zero, give, lambda acc: acc["given"])
    kept = F.transform("kept", lambda k: F.struct(k["vslot"].alias("vslot"), k["shard"].alias("shard")))
    edited = one.select((F.col("version") + 1).cast("int").alias("version"), F.concat(kept, given).alias("map"))
    return edited.select("version", F.inline("map"))


def save_map(mapped: DataFrame, folder: str) -> DataFrame:
    """Append the version to the store of maps, a folder for each version, and read it from there."""
    mapped.write.partitionBy("version").mode("append").parquet(folder)
    return mapped.sparkSession.read.parquet(folder)


def latest(store: DataFrame) -> DataFrame:
    newest = store.groupBy().agg(F.max("version").alias("version"))
    return store.join(F.broadcast(newest), "version")  # one row


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """A row for each record: key, size, text_crc32, vslot, shard, slot (its place in the shard, gapless from 0).

    Size is the UTF-8 bytes of the text plus 8; a null text has none, and the CRC of no bytes (0). Records with a
    null key are dealt by their text. Repeated rows count one by one and lie in one slot. Other columns are not
    looked at, whatever their names. An empty table gives no rows. The versions of the map go to store.

    A record's place is its slot's offset in the shard plus its place within the slot, so that no task needs more
    than a slot's worth of narrow rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        slot_of(key, text, slots).alias("vslot"),
    )
    narrow = materialize(narrow)
    load = materialize(slot_bytes(narrow, slots))
    store = store or shared_folder(spark)
    save_map(first_map(spark, shards, slots), store)
    save_map(edit_map(latest(spark.read.parquet(store)), load, shards), store)
    mapped = latest(spark.read.parquet(store)).join(F.broadcast(load), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    mapped = mapped.select("vslot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(key, "text_crc32", "size"))
    return (
        narrow.withColumn("place", place)
        .join(F.broadcast(mapped), "vslot")  # a row a slot
        .select(key, "size", "text_crc32", "vslot", "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))
    )

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are dealt into blocks by a hash, which is a fixed random permutation. Targets become quotas of
block draws: whole passes, then leading blocks, then part of one block. A binary tree splits the exact quotas among the
output shards, each node by a multivariate-hypergeometric draw, so each shard knows which run of each source's permuted
draws is its own; the runs are disjoint and together all. Rows are then put in a hashed order within their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, discard, materialize, quoted

#: No source is taken more often than so many times its size, and weights repeat over the sources in this order.
MOST = 3
WEIGHTS = (1, 2, 3)
BLOCKS = 1024
#: Times that later blocks are looked through for such as fit into what a quota has left.
ROUNDS = 4
SHARDS = 64
#: Words of a shard's part that one task writes, and most partitions of the mix.
PART_WORDS, MOST_PARTS = 20_000_000, 65536
SEED = 42


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) and weight, target. Sources by code point, null last, get the weights in turn.

    All targets sum to all sizes. A target above MOST times its source's size stops there and the excess goes to the
    others by weight, again and again: as the limits are met in the order of limit per weight, running sums in that
    order give the level at which it ends. The windows run over one row for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * MOST)
    order = everything.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > F.col("limit"))
    end = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.least(end * F.col("weight"), F.col("limit")))
    return rows.withColumn("target", F.coalesce(target, F.lit(0.0)).cast("double")).select("source", "source_size", "weight", "target")


def _split(seed: int):
    def node(lo: int, hi: int, quotas: list[int], starts: list[int]) -> Iterator[dict]:
        if hi - lo <= 1:
            yield {"lo": lo, "hi": hi, "quotas": quotas, "starts": starts}
            return
        mid, q = (lo + hi) // 2, np.asarray(quotas, dtype=np.int64)
        own = int(q.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left, rest, need = np.zeros_like(q), int(q.sum()), own
        for k, n in enumerate(q):  # one hypergeometric draw after another is a multivariate one
            left[k] = rng.hypergeometric(int(n), rest - int(n), need) if need else 0
            rest, need = rest - int(n), need - int(left[k])
        yield {"lo": lo, "hi": mid, "quotas": left.tolist(), "starts": starts}
        yield {"lo": mid, "hi": hi, "quotas": (q - left).tolist(), "starts": (np.asarray(starts, dtype=np.int64) + left).tolist()}

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame(list(node(int(r.lo), int(r.hi), list(r.quotas), list(r.starts))))

    return split


def shard_runs(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(k, shard, start, n): the run of source k's draws that each shard takes; quotas has (k, quota) for k from 0."""
    one = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", "quota"))).alias("q"))  # a number for each source
    nodes = one.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.transform("q", lambda x: x["quota"].cast("long")).alias("quotas"), F.transform("q", lambda x: F.lit(0).cast("long")).alias("starts"))
    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        nodes = nodes.mapInPandas(_split(seed), "lo long, hi long, quotas array<long>, starts array<long>")
    runs = nodes.select(F.col("lo").alias("shard"), F.posexplode(F.arrays_zip("quotas", "starts")).alias("k", "run"))
    return runs.select("k", F.col("shard").cast("int").alias("shard"), F.col("run.starts").alias("start"), F.col("run.quotas").alias("n")).where("n > 0")


def _keyed(docs: DataFrame, key: str, text: str, source: str, blocks: int, seed: int) -> list[Column]:
    h = F.xxhash64(F.lit(seed), F.col(quoted(key)).cast("string"), F.col(quoted(text)))
    return [F.col(quoted(source)).alias("source"), n_words(F.col(quoted(text))).alias("size"), h.alias("h"), F.pmod(h, F.lit(blocks)).cast("int").alias("block")]


def block_draws(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row for each block: source, block, source_size, target, remain, draws.

    draws: (pass, shard, part) of each time the block is drawn; part is set in the draw that ends a source's quota,
    which takes the block's documents up to remain words. rows has (source, block, size).
    """
    sized = materialize(rows.groupBy("source", "block").agg(F.sum("size").alias("bytes")))
    goal = targets(sized.groupBy("source").agg(F.sum("bytes").alias("source_size")), weights).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    table = sized.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    source, turn = Window.partitionBy("k"), Window.partitionBy("k").orderBy("block")
    table = table.withColumn("remain", F.col("rest").cast("double")).withColumn("last", F.lit(False))
    for _ in range(ROUNDS):  # leading blocks, then such later ones as still fit
        fits = ~F.col("last") & (F.col("bytes") <= F.col("remain"))
        table = table.withColumn("fits", fits).withColumn("last", F.col("last") | (F.col("fits") & (F.sum(F.when(F.col("fits"), F.col("bytes"))).over(turn) <= F.col("remain"))))
        table = table.withColumn("remain", F.col("rest") - F.coalesce(F.sum(F.when(F.col("last"), F.col("bytes"))).over(source), F.lit(0)))
    open_ = F.when(~F.col("last") & (F.col("remain") > 0), F.col("block"))
    part = F.col("block").eqNullSafe(F.min(open_).over(source))
    more = F.when((F.col("rest") > 0) & (F.col("last") | part), F.array(F.struct(F.col("passes").alias("pass"), (~F.col("last")).alias("part"))))
    none = F.array().cast("array<struct<pass:int,part:boolean>>")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda p: F.struct(p.alias("pass"), F.lit(False).alias("part")))).otherwise(none)
    table = materialize(table.withColumn("drawn", F.concat(whole, F.coalesce(more, none))).select("k", "source", "block", "source_size", "target", "remain", "drawn"))
    draws = table.select("k", "block", F.explode("drawn").alias("d")).select("k", "block", "d.pass", "d.part")
    draws = draws.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed), "k", "pass", "block"), "pass", "block")) - 1)
    quotas = goal.select("k").join(table.groupBy("k").agg(F.sum(F.size("drawn")).alias("quota")), "k", "left").na.fill(0, ["quota"])
    runs = shard_runs(quotas, shards, seed)
    taken = runs.select("k", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    placed = draws.join(taken, ["k", "at"]).groupBy("k", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "part"))).alias("draws"))
    return materialize(table.drop("drawn").join(placed, ["k", "block"], "left").drop("k"))


def _with_copies(rows: DataFrame, table: DataFrame) -> DataFrame:
    t = table.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "remain", "draws")
    both = rows.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    fits = F.when(F.col("size") <= F.col("remain"), F.col("size"))
    upto = F.sum(fits).over(Window.partitionBy("source", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    none = F.array().cast("array<struct<pass:int,shard:int,part:boolean>>")
    inside = both.withColumn("upto", upto)
    return inside.withColumn("copies", F.filter(F.coalesce("draws", none), lambda d: ~d["part"] | ((F.col("size") <= F.col("remain")) & (F.col("upto") - F.col("size") / 2 <= F.col("remain"))))).drop("draws", "remain", "upto")


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row for each document: key, source, size, source_size, target, copies (pass, shard, part of each copy).

    Size is the number of words, 0 for a null or empty text. A null source is a source of its own. Repeated rows are
    drawn one by one. A source without words has the target 0 and nothing is drawn. An empty table gives no rows.
    """
    rows = materialize(docs.select(F.col(quoted(key)).alias("doc"), *_keyed(docs, key, text, source, blocks, seed)))
    table = block_draws(rows, shards, seed)
    return _with_copies(rows, table).select(F.col("doc").alias(key), "source", "size", "source_size", "target", "copies")


def _last_of_part(rows: DataFrame, table: DataFrame) -> DataFrame:
    """table and upto_h: where a block is drawn in part, the last hash of which documents are taken, in the order of
    their hashes; rows of an equal hash, which repeat key and text, are taken together or not at all."""
    part = table.where(F.exists("draws", lambda d: d["part"]))
    t = part.select(F.col("source").alias("s"), F.col("block").alias("b"), "remain")
    inside = rows.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))  # a block of each source
    each = inside.where(F.col("size") <= F.col("remain")).groupBy("s", "b", "h").agg(F.sum("size").alias("size"), F.first("remain").alias("remain"))
    upto = F.sum("size").over(Window.partitionBy("s", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    last = each.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("remain")).groupBy("s", "b").agg(F.max("h").alias("upto_h"))
    return table.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed documents: a row for each copy with all columns of docs and shard.

    Rows of a shard come in a hashed order, in parts of some PART_WORDS words, each part in a partition of its own
    or with others; texts are shuffled once, to their part. Sizes and hashes decide alone what is taken. A column of docs
    named shard is replaced; all other names are free. Null and empty texts have no size and come with their block;
    of rows that repeat key and text a block drawn in part takes all or none; an empty table stays empty.
    """
    own = [c for c in docs.columns if c != "shard"]
    sizes = materialize(docs.select(*_keyed(docs, key, text, source, blocks, seed)))
    drawn = block_draws(sizes, shards, seed)
    table = materialize(_last_of_part(sizes, drawn).select(F.col("source").alias("s"), F.col("block").alias("b"), "remain", "draws", "upto_h"))
    words = sizes.agg(F.sum("size").alias("n")).first().n
    parts = max(1, min(MOST_PARTS, math.ceil((words or 0) / shards / PART_WORDS)))
    discard(sizes, drawn)
    rows = docs.select(F.struct(*map(quoted, own)).alias("doc"), *_keyed(docs, key, text, source, blocks, seed))
    both = rows.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    taken = F.filter("draws", lambda d: ~d["part"] | ((F.col("size") <= F.col("remain")) & (F.col("h") <= F.col("upto_h"))))
    each = both.select("doc", "h", F.explode(taken).alias("c")).withColumn("at", F.xxhash64(F.lit(seed), "h", "c.pass"))
    # parts of equal ranges of the hash that rows are ordered by
    each = each.withColumn("part", F.floor((F.shiftrightunsigned("at", 44).cast("double")) * parts / (1 << 20)).cast("int"))
    local = each.repartition(min(shards * parts, MOST_PARTS), F.col("c.shard"), F.col("part")).sortWithinPartitions("c.shard", "part", "at", "h")
    return local.select(*[F.col("doc")[c].alias(c) for c in own], F.col("c.shard").alias("shard"))

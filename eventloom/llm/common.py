"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.operators.lineage import discard, materialize, shared_folder

__all__ = ["WORD", "connected_components", "discard", "map_batches", "materialize", "quoted", "shared_folder", "words"]

#: A word: a run of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any name: run finds them by position, under the names c0, c1 and so on."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of the undirected edges (a, b); component is the smallest id that a node reaches.

    Alternates large-star and small-star rewiring, each round an aggregation and a join that is written to the
    shared folder; ends when no edge changes, which takes rounds by the logarithm of the longest path, and is an error
    after max_rounds. Null ends and self loops are ignored; no edges give no rows.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        """Ties each node's larger (both) or smaller neighbours to the smallest of its neighbourhood."""
        near = e if not both else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        if both:
            return near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = near.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return tied.unionByName(low.select("u", F.col("m").alias("v")))

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialize(e)
    seen = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, old = now, e
        e = materialize(star(star(e, True).where("u > v").distinct(), False).where("u > v").distinct())
        discard(old)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

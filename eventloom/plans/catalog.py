"""The queries over the tables of a folder, each with the SQL that gives the same rows.

orders stand for events, part for entities, lineitem for the links between them, events for typed values and messages,
embeddings for vectors, documents and benchmark for chunks and gold chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.lineage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (event_id, entity_id)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges() as a table of its own, for plans that read it several times."""
    return materialize(edges(spark, sf_dir))


EDGES = "e AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem)"


def load() -> None:
    """Registers all queries."""
    from eventloom.plans import q_corpus, q_more, q_parsers, q_paths, q_ranking, q_stats, q_text, q_walk  # noqa: F401

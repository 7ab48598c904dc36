"""A background pipeline over documents as they land: results and a status for each, written once whatever restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.lineage import discard, materialize


def process(arriving: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], folder: str, fail_fast: bool = False) -> StreamingQuery:
    """Starts a stream that hands each batch of arriving documents to work and keeps what it returns.

    work gives (key, ..., error); rows with an error have failed and aren't results, and a document without a row has
    failed, too. Where work itself fails, all documents of the batch have, with its message, unless fail_fast is set:
    then the stream ends, and a restart tries again. Results and states are written to folders named by the batch, which
    a batch that is run again replaces, states last: a stream that is stopped between two writes neither repeats nor
    loses a document. A null key is a document like others.
    """

    def each(batch: DataFrame, number: int) -> None:
        at = f"batch={number:012d}"
        docs = materialize(batch)
        tell(docs.select(key, F.lit("processing").alias("status"), F.lit(None).cast("string").alias("reason")), at)
        try:
            done = materialize(work(docs))
        except Exception as e:  # whatever a user's function raises is the reason that these documents failed
            if fail_fast:
                raise
            tell(docs.select(key, F.lit("failed").alias("status"), F.lit(f"{type(e).__name__}: {e}").alias("reason")), at)
            discard(docs)
            return
        done.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{folder}/results/{at}")
        told = done.groupBy(F.col(key).alias("_key")).agg(F.max("error").alias("_error"))
        states = docs.select(key).distinct().join(told.withColumn("_done", F.lit(True)), F.col(key).eqNullSafe(F.col("_key")), "left")
        fine = F.col("_done").isNotNull() & F.col("_error").isNull()
        tell(states.select(key, F.when(fine, "completed").otherwise("failed").alias("status"), F.when(~fine, F.coalesce("_error", F.lit("no result"))).alias("reason")), at)
        discard(docs, done)

    def tell(states: DataFrame, at: str) -> None:
        states.withColumn("told", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/status/{at}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All results, with the batch that made each."""
    return spark.read.option("basePath", f"{folder}/results").parquet(f"{folder}/results/batch=*")


def status(spark: SparkSession, folder: str, key: str, landed: DataFrame | None = None) -> DataFrame:
    """(key, status, reason, told) of each document: that of the last batch it came with. With landed, the documents that
    no batch has taken are `pending`."""
    told = spark.read.option("basePath", f"{folder}/status").parquet(f"{folder}/status/batch=*")
    last = told.groupBy(key).agg(F.max_by(F.struct("status", "reason", "told"), F.struct("batch", "told")).alias("x")).select(key, "x.*")
    if landed is None:
        return last
    both = landed.select(F.col(key).alias("_landed")).distinct().join(last, F.col("_landed").eqNullSafe(F.col(key)), "left")
    return both.select(F.col("_landed").alias(key), F.coalesce("status", F.lit("pending")).alias("status"), "reason", "told")


def progress(states: DataFrame) -> DataFrame:
    """(documents, pending, processing, completed, failed, percent): percent of the documents that are through."""
    count = lambda s: F.count_if(F.col("status") == s)
    through = count("completed") + count("failed")
    return states.agg(F.count(F.lit(1)).alias("documents"), *[count(s).alias(s) for s in ("pending", "processing", "completed", "failed")], F.round(F.try_divide(through * 100.0, F.count(F.lit(1))), 2).alias("percent"))

"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their length in tokens; sums from the top of the histogram then answer totals, quantiles and
truncated totals for any context limit without another look at the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm import pieces
from eventloom.llm.common import materialize

#: Lengths to a bin of the running sums: bins are summed first, then lengths within their bin, so no task needs all.
BIN = 1024


def histogram(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """(n_tokens, docs): how many documents have each length. Null and empty texts have the length 0."""
    return pieces.lengths(docs, text, model).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist and docs_at_least, tokens_at_least (of the documents of this length and above), docs_total, tokens_total,
    truncated_tokens (the total if texts were cut at this length) and docs_share (of the documents up to this length)."""
    rows = hist.withColumn("bin", F.floor(F.col("n_tokens") / BIN)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    bins = rows.groupBy("bin").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    everything = Window.partitionBy(F.lit(0))
    above = everything.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bins = bins.select("bin", zero(F.sum("bd").over(above)).alias("ad"), zero(F.sum("bt").over(above)).alias("at"), F.sum("bd").over(everything).alias("docs_total"), F.sum("bt").over(everything).alias("tokens_total"))
    inside = Window.partitionBy("bin").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    out = rows.join(bins, "bin").withColumn("docs_at_least", F.col("ad") + F.sum("docs").over(inside)).withColumn("tokens_at_least", F.col("at") + F.sum("tokens").over(inside))
    return out.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("docs")) / F.col("docs_total")).alias("docs_share"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row (limit, tokens, docs_cut): all tokens if texts are cut at limit. No documents: 0 and 0."""
    return sums.agg(
        F.lit(limit).cast("long").alias("limit"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("tokens")).otherwise(limit * F.col("docs"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("docs_cut"),
    )


def quantiles(sums: DataFrame, points: list[float]) -> DataFrame:
    """(point, n_tokens): the smallest length up to which at least this share of the documents lies; null without any."""
    asked = sums.groupBy().agg(*[F.min(F.when(F.col("docs_share") >= p, F.col("n_tokens"))).alias(f"q{k}") for k, p in enumerate(points)])
    return asked.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(f"q{k}").alias("n_tokens")) for k, p in enumerate(points)])))


def token_counts(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """suffix_sums of the histogram of docs: a row for each length that occurs, so one for each context limit at which
    an answer changes. Repeated rows count one by one, other columns are not looked at, an empty table gives no rows."""
    return suffix_sums(materialize(histogram(docs, text, model)))  # texts are encoded once

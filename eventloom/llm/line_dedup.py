"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Each window of three consecutive lines is hashed; of a window found more than once in the corpus the first occurrence
stays, and the positions that later ones cover are merged and their lines removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, quoted

WINDOW = 3


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, tid, at, a, b): two 64-bit hashes of each window that has a word; at is the place of its first line."""
    lines = docs.where(F.col(quoted(text)).isNotNull()).select(F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("tid"), F.split(quoted(text), "\n").alias("lines"))
    hashed = lines.select("id", "tid", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(r"[^\x20\x09-\x0D]").alias("w"))).alias("l"))
    steps = range(window)
    each = F.transform(
        F.sequence(F.lit(0), F.size("l") - window),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[F.get("l", i + k)["h"] for k in steps]).alias("a"),
            F.xxhash64(*[F.get("l", i + k)["h"] for k in reversed(steps)]).alias("b"),
            F.greatest(*[F.get("l", i + k)["w"] for k in steps]).alias("w"),
        ),
    )
    return hashed.where(F.size("l") >= window).select("id", "tid", F.inline(each)).where("w").drop("w")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, tid, gone): the sorted places of the lines that later occurrences of windows cover.

    Occurrences are ordered by key (null first), hash of the text, place. Where a window overlaps its own first
    occurrence in the same document, the lines of the first one stay.
    """
    every = materialize(line_windows(docs, key, text, window))
    place = F.struct("id", "tid", "at")
    many = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = every.join(many, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tid") == F.col("first.tid"))
    start = F.when(same, F.greatest(F.col("at"), F.col("first.at") + window)).otherwise(F.col("at"))
    covered = later.select("id", "tid", F.explode(F.sequence(start, F.col("at") + window - 1)).alias("p"))
    return covered.groupBy("id", "tid").agg(F.sort_array(F.collect_set("p")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the text less its repeated lines, n_lines (before) and n_removed.

    A document is a key and a text: rows that repeat both are one document, are judged together and all stay.
    A null text stays null with 0 lines; texts of fewer lines than the window stay as they are; a text can become
    empty. Windows without a word are not looked at. Columns named n_lines or n_removed are replaced; all other names
    are free. An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated_lines(docs, key, text, window).select(F.col("id").alias("gid"), F.col("tid").alias("gtid"), "gone")
    rows = docs.select(F.struct(*map(quoted, own)).alias("doc"), F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("tid"))
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("tid") == F.col("gtid")), "left").select("doc", "gone", F.split(F.col("doc")[text], "\n").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("doc")[text]).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return both.select(
        *[(left if c == text else F.col("doc")[c]).alias(c) for c in own],
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
    )

"""A stored inverted index for BM25 over boosted fields.

Documents are dealt into zones of some thousand by a hash of their key. A posting block holds what one zone has of one
term in one field, with its greatest count and its least document length; files are parted by a hash of the term, so that
a query reads its own terms' blocks only. A top-k search bounds what any document of a zone can score by the blocks'
heads, scores the most promising zones, and then only those that can still reach the k-th score. Segments are written
at once and count from when they are noted; a document that comes again leaves a mark on its older version.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators.lineage import discard, materialize

#: Documents of a zone, folders of terms, parts that a folder's zones are dealt into, zones that a search reads first.
ZONE_DOCS, BUCKETS, ZONE_PARTS, FIRST_ZONES = 4096, 32, 8, 8
#: Characters of a zone's tokens from which on its next documents go into blocks of their own.
BLOCK_CHARS = 1 << 25
#: What rounding may take from a bound.
SLACK = 1e-9


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


@dataclass
class TextIndex:
    """An index in a folder that all executors share. Fields are named when it is made and stay."""

    spark: SparkSession
    path: str
    key: str
    fields: tuple[str, ...]

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: Sequence[str], path: str) -> TextIndex:
        """An index of documents in a new folder; append() says which are taken."""
        index = cls(docs.sparkSession, path, key, tuple(fields))
        index.append(docs)
        return index

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the index, empty where nothing has been written to it yet."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _noted(self) -> DataFrame:
        """(segment, field, n, total): documents with the field and their tokens."""
        return self._table("segments", "segment string, field string, n long, total long")

    def _segments(self) -> list[str]:
        return [r.segment for r in self._noted().select("segment").distinct().collect()]

    def _marks(self, kind: str) -> DataFrame:
        """(key, segment) of versions that a noted segment has replaced."""
        return self._table("marks", f"`{self.key}` {kind}, segment string, by string").where(F.col("by").isin(self._segments())).drop("by").distinct()

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.path}/docs").schema[self.key].dataType.simpleString()

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds documents as a segment and returns the (key, status) of each row: `created`, `updated` where an older
        version is replaced, `superseded` for rows but one of a repeated key, `failed` for those without a key.

        Null fields have no tokens. A segment cut short leaves no trace in searches.
        """
        key, spark, segment = self.key, self.spark, f"s{uuid.uuid4().hex}"
        kind = docs.schema[key].dataType.simpleString()
        rows = docs.select(key, *self.fields)
        if docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
            rows = rows.withColumn("_nth", F.lit(1))
        else:
            nth = F.row_number().over(Window.partitionBy(key, F.when(F.col(key).isNull(), F.monotonically_increasing_id())).orderBy(*[F.desc_nulls_last(f) for f in self.fields]))
            rows = rows.withColumn("_nth", nth)
        # tokens are cut once and here, not in Python, so that an index and a scan agree on what a token is; none holds a space
        rows = materialize(rows.select(key, "_nth", *[F.array_join(tx.tokens(F.coalesce(F.col(f), F.lit(""))), " ").alias(f"_{k}") for k, f in enumerate(self.fields)]))
        good = rows.where(f"`{key}` is not null and _nth = 1")
        known = self._table("docs", f"`{key}` {kind}, segment string").where(F.col("segment").isin(self._segments()))
        old = known.join(self._marks(kind), [key, "segment"], "left_anti").join(good.select(key), key, "left_semi")
        old = materialize(old.select(key, "segment"))
        count = good.count()
        zones = max(1, -(-count // ZONE_DOCS))

        self._postings(good, segment, zones)
        lengths = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f"_{k}") != "", F.octet_length(f"_{k}") - F.octet_length(F.replace(F.col(f"_{k}"), F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long").alias("dl")) for k, f in enumerate(self.fields)])
        written = materialize(good.select(key, lengths.alias("lengths")))
        written.select(key, F.lit(segment).alias("segment")).write.mode("append").parquet(f"{self.path}/docs")
        old.withColumn("by", F.lit(segment)).write.mode("append").parquet(f"{self.path}/marks")
        facts = written.select(F.inline("lengths")).groupBy("field").agg(F.count_if(F.col("dl") > 0).alias("n"), F.sum("dl").alias("total"))
        facts.select(F.lit(segment).alias("segment"), "field", "n", "total").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        discard(written)
        status = F.when(F.col(key).isNull(), "failed").when(F.col("_nth") > 1, "superseded").when(F.col("_old"), "updated").otherwise("created")
        return rows.join(old.select(key, F.lit(True).alias("_old")).distinct(), key, "left").select(key, status.alias("status"))

    def _postings(self, docs: DataFrame, segment: str, zones: int) -> None:
        """Writes the blocks of docs (key, _0, _1, ...), the fields' tokens joined by spaces. A zone's documents meet in a
        task and leave it as blocks; a zone of more than BLOCK_CHARS makes several blocks for a term."""
        key, fields = self.key, self.fields
        kind = docs.schema[key].dataType.simpleString()

        def blocks(zone: int, ids: pa.Array, name: str, joined: pa.Array) -> Iterator[pa.RecordBatch]:
            cut = pc.split_pattern(joined, " ")
            of, words = pc.list_parent_indices(cut).to_numpy(), pc.list_flatten(cut).dictionary_encode()
            dl = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(cut).to_numpy()).astype(np.int32)
            held = dl[of] > 0
            both, tf = np.unique(words.indices.to_numpy()[held].astype(np.int64) * len(dl) + of[held], return_counts=True)
            if not len(both):
                return
            term, doc, tf = both // len(dl), both % len(dl), tf.astype(np.int32)
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            postings = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf), pa.array(dl[doc])], ["id", "tf", "dl"])
            postings = pa.ListArray.from_arrays(pa.array(np.append(starts, len(both)).astype(np.int32)), postings)
            n, size = np.diff(np.append(starts, len(both))), len(starts)
            columns = [pa.array(np.full(size, zone, np.int32)), pa.array([name] * size), words.dictionary.take(pa.array(term[starts])), pa.array(n), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl[doc], starts)), postings]
            made = pa.RecordBatch.from_arrays(columns, ["zone", "field", "term", "n", "most", "least", "postings"])
            for at in range(0, size, 4096):
                yield made.slice(at, 4096)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, zone = [], 0, None

            def flushed() -> Iterator[pa.RecordBatch]:
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    for k, name in enumerate(fields):
                        yield from blocks(zone, table.column(1).chunk(0), name, table.column(k + 2).chunk(0))

            for batch in batches:
                zone_of = batch.column(0).to_numpy()
                cuts = np.append(np.flatnonzero(np.diff(zone_of)) + 1, len(zone_of)).tolist()
                for low, high in zip([0, *cuts], cuts, strict=False):
                    for at in range(low, high, 512):
                        part = batch.slice(at, min(512, high - at))
                        if size > BLOCK_CHARS or zone != zone_of[low]:
                            yield from flushed()
                            held, size, zone = [], 0, int(zone_of[low])
                        held.append(part)
                        size += sum(pc.sum(pc.binary_length(part.column(k + 2))).as_py() for k in range(len(fields)))
            yield from flushed()

        dealt = docs.select(F.pmod(F.xxhash64(key), F.lit(zones)).cast("int").alias("zone"), key, *[f"_{k}" for k in range(len(fields))])
        dealt = dealt.repartition("zone").sortWithinPartitions("zone")
        made = dealt.mapInArrow(run, f"zone int, field string, term string, n long, most int, least int, postings array<struct<id:{kind},tf:int,dl:int>>")
        made = made.withColumns({"bucket": (F.crc32("term") % BUCKETS).cast("int"), "part": F.pmod(F.col("zone"), F.lit(ZONE_PARTS))}).repartition("bucket", "part")
        made.withColumn("segment", F.lit(segment)).drop("part").sortWithinPartitions("bucket", "term", "zone").write.partitionBy("segment", "bucket").mode("append").parquet(f"{self.path}/postings")

    def merge(self) -> str:
        """Writes all documents' latest versions as one segment, and notes only it: counts of replaced versions leave
        the statistics here."""
        segment, kind, marks = f"s{uuid.uuid4().hex}", self._kind(), self._marks(self._kind())
        noted, key = self._segments(), self.key
        docs = materialize(self._table("docs", f"`{key}` {kind}, segment string").where(F.col("segment").isin(noted)).join(marks, [key, "segment"], "left_anti"))
        zones = max(1, -(-docs.count() // ZONE_DOCS))
        rows = self._blocks(noted).select("segment", "field", "term", F.inline("postings")).withColumnRenamed("id", key).join(docs, [key, "segment"], "left_semi")
        rows = rows.withColumn("zone", F.pmod(F.xxhash64(key), F.lit(zones)).cast("int"))
        rows = materialize(rows.withColumns({"bucket": (F.crc32("term") % BUCKETS).cast("int"), "part": F.pmod(F.col("zone"), F.lit(ZONE_PARTS))}).repartition("bucket", "part"))
        blocks = rows.groupBy("bucket", "part", "zone", "field", "term").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.collect_list(F.struct(F.col(key).alias("id"), "tf", "dl")).alias("postings"))
        blocks.withColumn("segment", F.lit(segment)).drop("part").sortWithinPartitions("bucket", "term", "zone").write.partitionBy("segment", "bucket").mode("append").parquet(f"{self.path}/postings")
        docs.select(key, F.lit(segment).alias("segment")).write.mode("append").parquet(f"{self.path}/docs")
        facts = rows.groupBy("field", key).agg(F.first("dl").alias("dl")).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
        facts.select(F.lit(segment).alias("segment"), "field", "n", F.col("total").cast("long").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/segments")
        discard(rows, docs)
        return segment

    def _blocks(self, segments: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment").isin(list(segments)))

    def search(self, query: Sequence[str], k: int | None = None, boosts: dict[str, float] | None = None, min_score: float | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score): each document's best boosted field score, of those with a term of the query; the k best, equal
        scores by key, or all; only those of min_score or more. Exact: zones are left out only where no document can be
        among the answers. Versions that were replaced are no answers, but count in the statistics until merge()."""
        key, boosts = self.key, boosts or dict.fromkeys(self.fields, 1.0)
        terms = sorted({q.lower() for q in query})
        noted = self._noted().groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        facts = {r.field: (r.n, r.total / r.n) for r in noted if r.n and r.field in boosts}
        segments, kind = self._segments(), self._kind()
        none = self.spark.createDataFrame([], f"`{key}` {kind}, score double")
        if not facts or not terms or (k is not None and k < 1):
            return none
        blocks = self._blocks(segments).where(F.col("bucket").isin(sorted({_bucket(t) for t in terms})) & F.col("term").isin(terms) & F.col("field").isin(list(facts)))
        found = blocks.groupBy("field", "term").agg(F.sum("n").alias("df")).collect()  # the query's terms times fields
        if not found:
            return none

        def impact(tf: Column, dl: Column) -> Column:
            """The part of a term in a field's score."""
            out = F.lit(None).cast("double")
            for r in found:
                n, average = facts[r.field]
                weight = F.log(1 + (F.lit(n) - r.df + 0.5) / (F.lit(r.df) + 0.5)) * boosts[r.field]
                out = F.when((F.col("field") == r.field) & (F.col("term") == r.term), weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))).otherwise(out)
            return out

        marks = self._marks(kind)

        def score(some: DataFrame) -> DataFrame:
            rows = some.select("segment", "field", "term", F.inline("postings"))
            each = rows.withColumn("s", impact(F.col("tf"), F.col("dl"))).groupBy("segment", "id", "field").agg(F.sum("s").alias("s"))
            out = each.groupBy("segment", "id").agg(F.max("s").alias("score")).withColumnRenamed("id", key)
            return out.join(marks, [key, "segment"], "left_anti").select(key, "score")

        best = lambda rows: rows.orderBy(F.desc("score"), key).limit(k)
        heads = blocks.groupBy("segment", "zone", "field", "term").agg(F.max("most").alias("most"), F.min("least").alias("least"))
        bounds = heads.groupBy("segment", "zone", "field").agg(F.sum(impact(F.col("most"), F.col("least"))).alias("bound")).groupBy("segment", "zone").agg(F.max("bound").alias("bound"))
        if k is None:
            if min_score is None:
                return score(blocks)
            reach = bounds.where(F.col("bound") >= min_score - SLACK)
            return score(blocks.join(reach, ["segment", "zone"], "left_semi")).where(F.col("score") >= min_score)
        bounds = materialize(bounds)
        first = bounds.orderBy(F.desc("bound"), "segment", "zone").limit(FIRST_ZONES)
        top = materialize(best(score(blocks.join(F.broadcast(first), ["segment", "zone"], "left_semi"))))
        at = top.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        least = at.least if at.n == k else 0.0
        if min_score is not None:
            least = max(least, min_score)
        rest = bounds.where(F.col("bound") >= least - SLACK).join(F.broadcast(first.select("segment", "zone")), ["segment", "zone"], "left_anti")
        out = best(top.unionByName(score(blocks.join(rest, ["segment", "zone"], "left_semi"))))
        return out if min_score is None else out.where(F.col("score") >= min_score)

"""Filters, joins, windows and set operations of the walk over sources, events and entities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import name_key
from eventloom.operators.lineage import materialize

# ---- filters


def of_sources(rows: DataFrame, sources: Sequence | None, column: str = "source_config_id") -> DataFrame:
    """Rows of the given tenants, all where none are given; a partition column is pruned."""
    return rows.where(F.col(column).isin(list(sources))) if sources else rows


def not_deleted(rows: DataFrame, flag: str = "is_delete") -> DataFrame:
    return rows.where(~F.coalesce(F.col(flag), F.lit(False)))


def type_filter(rows: DataFrame, focus: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "type", backup: Sequence[str] = ("tags",)) -> DataFrame:
    """Only the focus types and the backup ones if a focus is given, else all but the excluded ones."""
    if focus:
        return rows.where(F.col(column).isin([*focus, *backup]))
    return rows.where(~F.col(column).isin(list(exclude))) if exclude else rows


def at_least(rows: DataFrame, score: str, threshold: float | None) -> DataFrame:
    """A threshold of 0 or none is no filter."""
    return rows.where(F.col(score) >= threshold) if threshold else rows


def in_time(rows: DataFrame, start=None, end=None, start_column: str = "start_time", end_column: str = "end_time") -> DataFrame:
    """Events that lie within the range, each side of which may be open."""
    if start is not None:
        rows = rows.where(F.col(start_column) >= start)
    return rows if end is None else rows.where(F.col(end_column) <= end)


def containing(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which some column contains the text."""
    test = F.lit(False)
    for c in columns:
        test |= F.coalesce(F.col(c).contains(needle), F.lit(False))
    return rows.where(test)


def with_any_of(rows: DataFrame, array: str, members: Sequence) -> DataFrame:
    return rows.where(F.arrays_overlap(F.col(array), F.array(*[F.lit(m) for m in members])))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows whose keys together equal those of a wanted row."""
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def exact_names(entities: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Entities whose normalized name equals that of one of the asked names; asked is the name that matched."""
    asked = names.select(F.col("name").alias("asked"), name_key(F.col("name")).alias("key")).dropDuplicates(["key"])
    return entities.withColumn("key", name_key(F.col(name))).join(asked, "key").drop("key")


def prefix_names(entities: DataFrame, names: DataFrame, name: str = "name", key: str = "entity_id", least: int = 1) -> DataFrame:
    """Entities whose normalized name begins with an asked one; of several the first by name.

    Both sides meet on the first `least` characters of their keys, so it is an equi join.
    """
    asked = names.select(F.col("name").alias("asked"), name_key(F.col("name")).alias("p")).where(F.length("p") >= least)
    asked = asked.withColumn("head", F.substring("p", 1, least))
    rows = entities.withColumn("k", name_key(F.col(name))).withColumn("head", F.substring("k", 1, least)).join(asked, "head").where(F.col("k").startswith(F.col("p")))
    first = F.row_number().over(Window.partitionBy(key).orderBy("asked"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth", "k", "p", "head")


def active_types(types: DataFrame, source) -> DataFrame:
    """Active entity types: the defaults and those of one source."""
    return types.where(F.col("is_active") & (F.col("source_config_id").isNull() | (F.col("source_config_id") == source)))


def drop_invalid_events(events: DataFrame, evaluations: DataFrame, key: str = "event_id") -> DataFrame:
    """Events go only if their evaluation says is_invalid and names an invalid_event among its issues."""
    bad = evaluations.where(F.col("is_invalid") & F.exists("issues", lambda x: x["type"] == "invalid_event")).select(key)
    return events.join(bad, key, "left_anti")


def drop_invalid_entities(entities: DataFrame, issues: DataFrame) -> DataFrame:
    """issues: (event_id, type, name) of entities to drop, names without regard to case."""
    bad = issues.select("event_id", "type", F.lower("name").alias("low")).distinct()
    return entities.withColumn("low", F.lower("name")).join(bad, ["event_id", "type", "low"], "left_anti").drop("low")


def correct_types(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: (type, name, correct_type); of several for one entity the smallest counts."""
    one = corrections.groupBy("type", "name").agg(F.min("correct_type").alias("correct_type"))
    return entities.join(one, ["type", "name"], "left").withColumn("type", F.coalesce("correct_type", "type")).drop("correct_type")


# ---- joins


def events_of(edges: DataFrame, entities: DataFrame, event: str = "event_id", entity: str = "entity_id") -> DataFrame:
    """The distinct events of the given entities."""
    return edges.join(entities.select(entity), entity, "left_semi").select(event).distinct()


def with_evidence(edges: DataFrame, events: DataFrame, event: str = "event_id", entity: str = "entity_id") -> DataFrame:
    """(entity, n): entities with events among the given ones, and how many."""
    return edges.join(events.select(event).distinct(), event, "left_semi").groupBy(entity).agg(F.countDistinct(event).alias("n"))


def chunk_entities(edges: DataFrame, events: DataFrame, event: str = "event_id", entity: str = "entity_id", chunk: str = "chunk_id", order: str = "rank") -> DataFrame:
    """(chunk, entities): distinct entities of all events of a chunk, in the order in which they are first seen."""
    seen = events.join(edges, event).groupBy(chunk, entity).agg(F.min(F.struct(order, event, entity)).alias("first"))
    return seen.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x[entity]).alias("entities"))


def merge_recalls(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("entity", "bm25")) -> DataFrame:
    """Full outer merge of two recalls (key, score): both scores, source (a name or both) and the list of sources."""
    both = a.select(key, F.col("score").alias(f"{names[0]}_score")).join(b.select(key, F.col("score").alias(f"{names[1]}_score")), key, "full")
    has = [F.col(f"{n}_score").isNotNull() for n in names]
    return both.withColumn("source", F.when(has[0] & has[1], "both").when(has[0], names[0]).otherwise(names[1])).withColumn("sources", F.array_compact(F.array(*[F.when(h, n) for h, n in zip(has, names, strict=True)])))


def with_type_defaults(entities: DataFrame, types: DataFrame, weight: float = 1.0, threshold: float = 0.8) -> DataFrame:
    """Type weight and similarity threshold of each entity; the first row of a type counts, unknown types get defaults."""
    first = types.groupBy("type").agg(F.min_by("weight", "id").alias("type_weight"), F.min_by("similarity_threshold", "id").alias("type_threshold"))
    return entities.join(first, "type", "left").na.fill({"type_weight": weight, "type_threshold": threshold})


def in_order(rows: DataFrame, array: str, details: DataFrame, key: str, by: Sequence[str], into: str) -> DataFrame:
    """The details that an array of ids refers to, gathered again in the order of the array; unknown ids are left out."""
    each = rows.select(*by, F.posexplode(array).alias("pos", key)).join(details, key)
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", key, *[c for c in details.columns if c != key]))).alias(into))


#: Bits of the filter of names' beginnings.
NAME_BITS = 1 << 22


def contained_names(events: DataFrame, entities: DataFrame, batch: str, text: Sequence[str] = ("title", "content"), least_weight: float = 1.0) -> DataFrame:
    """(event_id, name): entities of the same batch whose name occurs in the event's text, types of low weight left out.

    Names meet texts on their first three characters, or all if they have fewer, so it is an equi join; then the whole
    name is looked for. Of a text's strings only those go into the join that a filter of fixed size has as the beginning
    of some name; what it lets pass by mistake finds no name. Empty names are left out; event ids are unique.
    """
    names = entities.where((F.col("weight") >= least_weight) & (F.length("name") > 0)).select(batch, F.lower("name").alias("low"), "name").dropDuplicates([batch, "low"])
    names = materialize(names.withColumn("gram", F.substring("low", 1, 3)))
    at = F.crc32("gram") % NAME_BITS + 1  # bitmaps hold 32768 bits each and count from 1
    marked = names.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    held = bytearray(NAME_BITS // 8)
    for r in marked.toLocalIterator():
        held[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    sent = events.sparkSession.sparkContext.broadcast(bytes(held))
    texts = events.select(F.col(batch).alias("batch"), "event_id", F.lower(F.concat_ws(" ", *text)).alias("t"))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for part in batches:
            rows, grams = [], []
            for row, t in enumerate(part.column(2).to_pylist()):
                for gram in {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}:
                    k = zlib.crc32(gram.encode()) % NAME_BITS
                    if bits[k >> 3] >> (k & 7) & 1:
                        rows.append(row)
                        grams.append(gram)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(grams, pa.string())], [batch, "event_id", "gram"])

    kinds = [texts.schema[c].dataType.simpleString() for c in ("batch", "event_id")]
    met = texts.mapInArrow(begun, f"`{batch}` {kinds[0]}, event_id {kinds[1]}, gram string").join(names, [batch, "gram"]).select("event_id", "low", "name")
    return met.join(texts.select("event_id", "t"), "event_id").where(F.col("t").contains(F.col("low"))).select("event_id", "name")


def previous(rows: DataFrame, by: str, order: str, content: str, most: int = 800) -> DataFrame:
    """rows and the beginning of the content before."""
    return rows.withColumn("previous", F.substring(F.lag(content).over(Window.partitionBy(by).orderBy(order)), 1, most))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, left_key: str, left_ts: str, right_ts: str, equal: Sequence[str] = (), prefer: Column | None = None, tie: str | None = None) -> DataFrame:
    """Each left row with the right row nearest in time within tolerance seconds; prefer ranks before nearness.

    Rows meet in time buckets as wide as the tolerance and their neighbours, so it is an equi join.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    near = F.explode(F.array(*[F.floor(seconds(left_ts) / tolerance) + k for k in (-1, 0, 1)]))
    both = left.withColumn("bucket", near).join(right.withColumn("bucket", F.floor(seconds(right_ts) / tolerance)), ["bucket", *equal])
    gap = F.abs(seconds(left_ts) - seconds(right_ts))
    order = [F.desc(prefer)] if prefer is not None else []
    both = both.withColumn("gap", gap).where(F.col("gap") <= tolerance)
    return both.withColumn("nth", F.row_number().over(Window.partitionBy(left_key).orderBy(*order, "gap", *([tie] if tie else [])))).where("nth = 1").drop("nth", "bucket")


def first_chunks(events: DataFrame, k: int, chunk: str = "chunk_id", weight: str = "weight", event: str = "event_id") -> DataFrame:
    """Top k chunks, each at its strongest event."""
    best = events.groupBy(chunk).agg(F.max(weight).alias(weight), F.max_by(event, F.struct(F.col(weight), -F.col(event))).alias(event))
    return best.orderBy(F.desc(weight), event, chunk).limit(k)


# ---- windows and set operations


def newest_per_key(rows: DataFrame, key: str, ts: str, n: int, tie: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), tie))).where(F.col("nth") <= n).drop("nth")


#: Rows up to which numbering sorts each group in one task.
NUMBER_IN_ONE = 1 << 20


def numbered(rows: DataFrame, order: Sequence[Column | str], into: str, by: Sequence[str] = (), count: int | None = None, size: str | None = None) -> DataFrame:
    """rows and their place from 1 in a total order, within each group of by; with size, a row stands for so many, and
    its place is the last of theirs.

    Beyond NUMBER_IN_ONE rows the whole order is dealt out by range, places count within a range, and each range begins
    where the counts of those before it end: no task holds all rows of a group.
    """
    by, order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
    if count is None:
        rows = materialize(rows)  # counted and numbered from one writing
        count = rows.count()
    place = lambda w: F.row_number().over(w) if size is None else F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if count <= NUMBER_IN_ONE:
        return rows.withColumn(into, place(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
    dealt = rows.repartitionByRange(*[F.col(c) for c in by], *order)
    if size is None:  # a row's number within its sorted range is written with it: rows are shuffled once
        dealt = dealt.sortWithinPartitions(*[F.col(c) for c in by], *order).withColumn("range_id", F.monotonically_increasing_id())
        dealt = materialize(dealt.withColumns({"range_no": F.shiftright("range_id", 33), "range_row": F.col("range_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("range_id"))
        each, first = F.count(F.lit(1)), F.min("range_row")
    else:
        dealt = materialize(dealt.withColumn("range_no", F.spark_partition_id()))
        each, first = F.sum(size), F.lit(0)
    counts = dealt.groupBy(*by, "range_no").agg(each.alias("range_n"), first.alias("range_first"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"range_{k}") for k, c in enumerate(by)], F.col("range_no").alias("range_at"), (F.coalesce(F.sum("range_n").over(before), F.lit(0)) - F.col("range_first")).alias("range_start"))
    same = F.col("range_no") == F.col("range_at")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"range_{k}"))
    within = F.col("range_row") + 1 if size is None else place(Window.partitionBy(*by, "range_no").orderBy(*order))
    # a row for each range, where there are no groups
    return dealt.join(starts if by else F.broadcast(starts), same).withColumn(into, within + F.col("range_start")).select(*rows.columns, into)


def ranked(rows: DataFrame, scores: Sequence[str], tie: str, by: Sequence[str] = ()) -> DataFrame:
    """rank_<score> from 1 for each score, largest first; ties by key, so no two rows have the same rank. The rows are
    written once and counted and ranked from there."""
    rows = materialize(rows)
    count = rows.count()
    for s in scores:
        rows = numbered(rows, [F.desc(s), tie], f"rank_{s}", by, count)
    return rows


def recent_and_sampled(rows: DataFrame, ts: str, key: str, recent: int = 100, sample: int = 2000, seed: int = 42) -> DataFrame:
    """The newest rows and a repeatable sample of the older ones; a sampling operator."""
    newest = rows.orderBy(F.desc(ts), key).limit(recent)
    older = rows.join(F.broadcast(newest.select(key)), key, "left_anti")  # so many rows at most
    return newest.unionByName(older.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample))


def merge_right_wins(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.withColumnRenamed(value, "old").join(b.withColumnRenamed(value, "new"), key, "full").select(key, F.coalesce("new", "old").alias(value))


def append_new(known: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return known.unionByName(rows.join(known, key, "left_anti"))


def fill_up(rows: DataFrame, backup: DataFrame, score: str, tie: str, least: int = 5, add: int = 10) -> DataFrame:
    """rows, and the best of the backup that is not among them where there are fewer than least rows."""
    short = rows.agg((F.count(F.lit(1)) < least).alias("short"))
    more = backup.join(rows, tie, "left_anti").join(F.broadcast(short)).where("short").drop("short")
    return rows.unionByName(more.orderBy(F.desc(score), tie).limit(add))

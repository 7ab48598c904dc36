"""The search plan: recall of keys and events, expansion over hops, rerank, and the paths behind each hit.

Tables: entities (entity_id, type, name), edges (event_id, entity_id, distinct pairs), events (event_id, title, content,
similarity to the query if known). Every stage is a DataFrame; the driver decides only on one number for each hop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import ranking as rk
from eventloom.operators import relational as rel


@dataclass(frozen=True)
class SearchConfig:
    """Defaults of all stages."""

    entity_threshold: float = 0.4
    event_threshold: float = 0.4
    max_entities: int = 25
    max_events: int = 60
    key_threshold: float = 0.5
    final_keys: int = 15
    hops: int = 3
    keys_per_hop: int = 10
    events_per_hop: int = 100
    events_per_key: int = 100
    convergence: float = 0.1
    rerank_threshold: float = 0.3
    max_results: int = 50
    rrf_k: int = 60
    use_pagerank: bool = False
    damping: float = 0.85
    pagerank_rounds: int = 100
    rerank_weights: dict = field(default_factory=lambda: dict(rk.RERANK_WEIGHTS))


def recall(entities: DataFrame, edges: DataFrame, e1: DataFrame, query: str = "", cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(entity_id, name, weight): the keys of a query.

    entities has similarity and type_weight; those over the threshold are the query's keys, their events get weights
    from keys and query similarity e1 (event_id, e1), and all entities of these events are weighed by them.
    """
    keys = entities.where(F.col("similarity") >= cfg.entity_threshold).orderBy(F.desc("similarity"), "entity_id").limit(cfg.max_entities)
    keys = keys.select("entity_id", (F.col("similarity") * F.col("type_weight")).alias("k1"))
    touched = edges.join(F.broadcast(keys.select("entity_id")), "entity_id", "left_semi").select("event_id").distinct()
    touched = touched.unionByName(e1.where(F.col("e1") >= cfg.event_threshold).select("event_id")).distinct()
    near = edges.join(touched, "event_id", "left_semi")
    events = rk.event_prior(near, keys, e1, cfg.max_events)
    own = near.join(F.broadcast(events.select("event_id")), "event_id", "left_semi")
    weights = rk.key_weight_recall(own, events, entities, query)
    return weights.where(F.col("weight") >= cfg.key_threshold).join(entities.select("entity_id", "name"), "entity_id").orderBy(F.desc("weight"), "entity_id").limit(cfg.final_keys)


def recall_chunks(entities: DataFrame, words: DataFrame, edges: DataFrame, events: DataFrame, k: int, cfg: SearchConfig = SearchConfig(), most_words: int = 20, per_word: int = 2, named: float = 0.99) -> DataFrame:
    """(chunk_id, weight, event_id): the k best chunks of a query from its keys' events, for evaluations.

    entities: (entity_id, name, similarity); words: (word), the query's, no more than most_words of which count; events:
    (event_id, chunk_id, e1 or null). Keys are the entities over the similarity threshold and, for each word, the first
    entities whose normalized name begins with it; an event weighs half its e1 and half the sum of its keys.
    """
    similar = entities.where(F.col("similarity") >= cfg.entity_threshold).orderBy(F.desc("similarity"), "entity_id").limit(cfg.max_entities)
    similar = rk.cut_lineage(similar.select("entity_id", F.col("similarity").alias("k1")))
    asked = words.select(F.lower("word").alias("word")).where("word <> ''").distinct().orderBy("word").limit(most_words).withColumn("head", F.substring("word", 1, 1))
    names = entities.select("entity_id", tx.normalize_entity_name(F.col("name")).alias("n")).withColumn("head", F.substring("n", 1, 1))
    met = names.join(F.broadcast(asked), "head").where(F.col("n").startswith(F.col("word")))  # so many words at most
    first = F.row_number().over(Window.partitionBy("word").orderBy("entity_id"))
    met = met.withColumn("nth", first).where(F.col("nth") <= per_word).select("entity_id").distinct()
    met = met.join(F.broadcast(similar), "entity_id", "left_anti").withColumn("k1", F.lit(named))
    keys = rk.cut_lineage(similar.unionByName(met).orderBy(F.desc("k1"), "entity_id").limit(cfg.max_entities))
    own = edges.join(F.broadcast(keys.select("entity_id")), "entity_id", "left_semi")
    ranked = rk.event_prior(own, keys, events.select("event_id", "e1"), cfg.max_events)
    return rel.first_chunks(events.where("chunk_id is not null").select("event_id", "chunk_id").join(F.broadcast(ranked), "event_id"), k)


def hop_events(edges: DataFrame, keys: DataFrame, cfg: SearchConfig, names: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(event_id, weight) of one hop: events of the keys, weighed by their mentions, normalized to the largest."""
    own = edges.join(F.broadcast(keys.select("entity_id", "weight", "step")), "entity_id")
    if names is not None and texts is not None:
        own = own.join(names.select("entity_id", "name"), "entity_id").join(texts.select("event_id", "content"), "event_id")
        own = own.withColumn("count", tx.count_occurrences(F.col("content"), F.col("name"), lower=True))
    else:
        own = own.withColumn("count", F.lit(1))
    return rk.normalize_to_max(rk.mention_weight(own, steps=True), cfg.events_per_hop)


def _here(rows: DataFrame) -> DataFrame:
    """rows, whose number a parameter bounds, as a table of the plan itself: later plans don't compute them again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def expand(edges: DataFrame, start: DataFrame, cfg: SearchConfig = SearchConfig(), names: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(final keys, evolution): walks key to event to key for up to cfg.hops hops.

    final keys: (entity_id, weight, hop, parent) of the start keys and those adopted in a hop; weight is the mean over
    hops, 0 for keys that no hop found again. evolution: (entity_id, hop, weight). After each hop one number, the
    relative change of all weights, tells whether to go on; the first hop's change counts as 1. New keys of the hop
    that ends the walk are weighed but not adopted.
    """
    current = rk.cut_lineage(start.select("entity_id", F.col("weight").cast("double").alias("weight"), F.lit(1).alias("step")))
    found = current.select("entity_id", F.lit(0).alias("hop"), F.lit(None).cast(current.schema["entity_id"].dataType).alias("parent"))
    evolution, last = None, None
    for hop in range(1, cfg.hops + 1):
        events = _here(hop_events(edges, current, cfg, names, texts))  # events_per_hop rows at most
        related = rk.cut_lineage(edges.join(F.broadcast(events.withColumnRenamed("weight", "ew")), "event_id").select("event_id", "entity_id", "ew"))
        weights = rk.cut_lineage(related.groupBy("entity_id").agg((F.avg("ew") * F.least(F.lit(2.0), F.log1p(F.count(F.lit(1))))).alias("weight")))
        now = weights.withColumn("hop", F.lit(hop))
        evolution = now if evolution is None else evolution.unionByName(now)
        total = weights.agg(F.sum("weight")).first()[0] or 0.0
        change = 1.0 if last is None else abs(total - last) / last if last else 0.0
        last = total
        if change < cfg.convergence:
            break
        fresh = weights.join(found, "entity_id", "left_anti").orderBy(F.desc("weight"), "entity_id").limit(cfg.keys_per_hop)
        before = related.join(F.broadcast(current.select(F.col("entity_id").alias("parent"), F.col("weight").alias("pw"))), F.col("entity_id") == F.col("parent")).select("event_id", "parent", "pw")
        parents = related.join(F.broadcast(fresh.select("entity_id")), "entity_id").join(before, "event_id").groupBy("entity_id").agg(F.min_by("parent", F.struct(-F.col("ew"), -F.col("pw"), "parent")).alias("parent"))
        fresh = _here(fresh.join(parents, "entity_id", "left"))  # keys_per_hop rows at most
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh.select("entity_id", F.lit(hop).alias("hop"), "parent"))
        current = fresh.select("entity_id", "weight", F.lit(hop + 1).alias("step"))
    mean = rk.hop_weighted_mean(evolution, cfg.hops) if evolution is not None else start.select("entity_id", F.lit(0.0).alias("weight"))
    return found.join(mean, "entity_id", "left").na.fill(0.0, ["weight"]).select("entity_id", "weight", "hop", "parent"), evolution


def rerank(items: DataFrame, keys: DataFrame, edges: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """items (item_id, similarity, bm25 or null) with relation, density, ranks and their fused weight, strongest first.

    keys: (entity_id, weight, hop); edges: (item_id, entity_id, count). PageRank over shared entities is blended in
    where cfg asks for it.
    """
    clues = edges.join(F.broadcast(keys), "entity_id").select("item_id", "entity_id", "weight", "hop", (F.col("hop") + 1).alias("step"), "count", F.lit(False).alias("is_target"))
    scored = items.where(F.col("similarity") >= cfg.rerank_threshold).join(rk.relation_and_density(clues), "item_id", "left").na.fill(0.0, ["relation", "density"])
    # sums that differ only by the order of their terms rank alike
    scored = rk.cut_lineage(scored.withColumns({c: F.round(c, 9) for c in ("relation", "density")}))
    fused = rk.rrf(scored, "item_id", cfg.rerank_weights, cfg.rrf_k).withColumnRenamed("rrf", "weight")
    if cfg.use_pagerank:
        kept = rk.cut_lineage(fused)
        ranks = rk.shared_pagerank(clues.join(kept.select("item_id"), "item_id", "left_semi"), kept.select("item_id", "weight"), cfg.damping, cfg.pagerank_rounds)
        fused = rk.blend(kept, ranks)
    return fused.orderBy(F.desc("weight"), "item_id").limit(cfg.max_results)


def rerank_sections(chunks: DataFrame, keys: DataFrame, edges: DataFrame, events: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """chunks (item_id, similarity, bm25 or null) reranked by the clues of their events, strongest first.

    events: (event_id, chunk_id); edges: (event_id, entity_id, count), whose counts are summed. No similarity threshold holds for chunks.
    """
    own = edges.join(events, "event_id").select(F.col("chunk_id").alias("item_id"), "entity_id", "count")
    own = own.repartition("item_id").groupBy("item_id", "entity_id").agg(F.sum("count").alias("count"))  # rerank sums by item, too
    return rerank(chunks, keys, own, replace(cfg, rerank_threshold=float("-inf")))


def intermediate(items: DataFrame, top_k: int) -> DataFrame:
    """The items that intermediate clues are made of: three times as many as are asked for."""
    return items.orderBy(F.desc("weight"), "item_id").limit(3 * top_k)


def query_nodes(queries: DataFrame) -> DataFrame:
    """Nodes (id, type, category, content, description) of queries (query, original or null): the query as asked, and
    that as it was before where it has been rewritten."""
    rewritten = F.col("original").isNotNull() & (F.col("original") != F.col("query"))
    # Descriptions of query nodes.
    kinds = [(F.coalesce("original", "query"), "origin", "原始搜索内容", F.lit(True)), (F.col("query"), "rewrite", "重写的请求", rewritten)]
    each = F.array(*[F.when(has, F.struct(text.alias("content"), F.lit(kind).alias("category"), F.lit(told).alias("description"))) for text, kind, told, has in kinds])
    rows = queries.select(F.explode(F.array_compact(each)).alias("n")).select("n.*").distinct()
    return rows.select(tx.uuid5(F.col("content")).alias("id"), F.lit("query").alias("type"), "category", "content", "description")


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Nodes (id, type, category, content, description, hop) of entities (entity_id, type, name, description, hop); one
    without an id gets one made of its name."""
    name = F.coalesce("name", F.lit(""))
    made = F.concat(F.lit("fallback-"), tx.uuid5(F.coalesce("name", F.lit("unknown"))))
    blank = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    return entities.select(F.coalesce(F.col("entity_id").cast("string"), made).alias("id"), F.lit("entity").alias("type"), blank("type", "unknown").alias("category"), name.alias("content"), blank("description", "").alias("description"), F.coalesce("hop", F.lit(0)).alias("hop"))


def extracted_nodes(attributes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Nodes of the attributes (name, type, description) that a query was found to have, a row for each; further columns
    are carried."""
    kind, name = F.coalesce("type", F.lit("unknown")), F.coalesce("name", F.lit(""))
    # Fixed value: what is said of one without a description.
    told = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.lit("从查询提取的属性"))
    return attributes.select(F.concat(F.lit("extracted-"), tx.uuid5(F.concat(kind, F.lit(":"), name))).alias("id"), F.lit("entity").alias("type"), kind.alias("category"), name.alias("content"), told.alias("description"), *carry)


def related_details(hits: DataFrame, events: DataFrame, mentions: DataFrame, most: int = 10) -> DataFrame:
    """hits (query_id, event_id, score) with title, category (empty for null) and entities, the first `most` of the
    event's (type, name) by seq, then name; hits whose event isn't held are left out.

    events: (event_id, title, category); mentions: (event_id, seq, type, name). Only mentions of events that were hit are
    gathered, once for each event, however many queries have hit it.
    """
    hit = rk.cut_lineage(hits.select("event_id").distinct())
    own = mentions.join(hit, "event_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("seq", "name", "type"))
    first = own.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "type", "name"))), lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"))).alias("entities"))
    held = events.join(hit, "event_id", "left_semi").join(first, "event_id", "left")
    none = F.array().cast("array<struct<type:string,name:string>>")
    return hits.join(held, "event_id").select("query_id", "event_id", "score", "title", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("entities", none).alias("entities"))


def event_nodes(sightings: DataFrame) -> DataFrame:
    """Nodes (id, event_id, type, category, content, description, stage, hop) of events as stages have seen them
    (seq, event_id, stage, hop, recall_method, category, title, content).

    An event has one node in a stage; in the expansion one for each hop that is known, and in the rerank one for each way
    of recall. The first sighting by seq stays. What tells such nodes apart is made of the event and its hop or way, so
    that the same sightings always give the same nodes.
    """
    event, stage = F.col("event_id").cast("string"), F.col("stage")
    kind = F.when((stage == "expand") & F.col("hop").isNotNull(), F.concat(F.lit("hop"), F.col("hop").cast("string")))
    kind = kind.when((stage == "rerank") & (F.coalesce("recall_method", F.lit("")) != ""), F.col("recall_method"))
    own = F.concat(stage, F.lit("_"), kind, F.lit("_"), event)
    rows = sightings.withColumn("id", F.when(kind.isNull(), F.concat(stage, F.lit("_"), event)).otherwise(F.concat(own, F.lit("_"), F.substring(tx.uuid5(own), 1, 8))))
    text = lambda c: F.coalesce(c, F.lit(""))
    node = F.struct("event_id", F.lit("event").alias("type"), text("category").alias("category"), text("title").alias("content"), text("content").alias("description"), "stage", "hop")
    return rows.groupBy("id").agg(F.min_by(node, "seq").alias("n")).select("id", "n.*")


def section_nodes(sections: DataFrame) -> DataFrame:
    """Nodes (id, type, category, content, description) of sections (section_id, section_type, heading, content,
    summary): the first 50 characters of the heading, or of the content where there is none. A section without an id gets
    one made of its texts; equal nodes are one."""
    text = lambda c: F.coalesce(c, F.lit(""))
    made = F.concat(F.lit("fallback-section-"), tx.uuid5(F.concat(text("section_type"), F.lit(":"), text("heading"), F.lit(":"), text("content"))))
    id_ = F.coalesce(F.when(F.col("section_id").cast("string") != "", F.col("section_id").cast("string")), made)
    return sections.select(id_.alias("id"), F.lit("section").alias("type"), text("section_type").alias("category"), F.substring(F.coalesce("heading", text("content")), 1, 50).alias("content"), text("summary").alias("description")).distinct()


def clue_edges(clues: DataFrame) -> DataFrame:
    """Provenance edges (seq, stage, src, dst, display_level, confidence): the first of each (src, dst, stage, level);
    confidences outside 0 to 1000 are brought into 0 to 10."""
    first = Window.partitionBy("src", "dst", "stage", "display_level").orderBy("seq")
    c = F.when(F.col("confidence").between(0, 1000), F.col("confidence")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("confidence"))))
    return clues.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").withColumn("confidence", c)


def _reached(clues: DataFrame, origins: DataFrame, max_depth: int) -> DataFrame:
    """(src, dst, confidence, away, entered) of the clues that a path from an origin can use: away, the least number of
    steps from an origin to src, 0 for origins, and whether such a clue leads to src.

    A clue is looked at until its src is reached, and not again.
    """
    far = rk.cut_lineage(origins.select(F.col("id").alias("node")).distinct().withColumn("away", F.lit(0)))
    left, first, back, again = clues, None, None, None
    for depth in range(1, max_depth + 1):
        last = far.where(F.col("away") == depth - 1).select(F.col("node").alias("src"), F.lit(True).alias("hit"))
        marked = rk.cut_lineage(left.join(last, "src", "left"))
        used, left = marked.where("hit").drop("hit"), marked.where("hit is null").drop("hit")
        if depth == 1:
            first = used
        else:
            more = used.withColumn("away", F.lit(depth - 1)).withColumn("entered", F.lit(True))
            back = more if back is None else back.unionByName(more)
        ends = rk.cut_lineage(used.select(F.col("dst").alias("node")).distinct().join(far, "node", "left"))
        origin = ends.where("away = 0").select(F.col("node").alias("src"))
        again = origin if again is None else again.unionByName(origin)
        new = ends.where("away is null").select("node", F.lit(depth).alias("away"))
        if new.isEmpty():
            break
        far = far.unionByName(new)
    if again.isEmpty():
        first = first.withColumn("entered", F.lit(False))
    else:
        first = first.join(again.distinct().withColumn("entered", F.lit(True)), "src", "left").na.fill(False, ["entered"])
    first = first.withColumn("away", F.lit(0))
    return first if back is None else first.unionByName(back)


def paths_to(clues: DataFrame, targets: DataFrame, origins: DataFrame, max_depth: int = 10) -> DataFrame:
    """(target, nodes, confidence, hops): all simple paths of one step or more, max_depth at most, from an origin to a
    target along (src, dst, confidence).

    Nodes' distances from the origins are found first, forwards; the walk back from the targets then opens only such
    paths as can still end within max_depth, and no path that no origin leads to. A path whose first node no clue leads
    to is not walked on. A node appears once in a path. Confidence is the product along the path, rounded to 4; of
    parallel clues the best counts.
    """
    best = clues.where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    back = _reached(best, origins, max_depth) if max_depth > 0 else None
    now = targets.select(F.col("id").alias("target")).distinct()
    now = now.select("target", F.col("target").alias("head"), F.array("target").alias("nodes"), F.lit(1.0).alias("product"))
    done = None
    for depth in range(1, max_depth + 1):
        step = now.join(back, F.col("head") == F.col("dst")).where((F.col("away") + depth <= max_depth) & ~F.array_contains("nodes", F.col("src")))
        found = rk.cut_lineage(step.select("target", F.col("src").alias("head"), F.array_prepend("nodes", F.col("src")).alias("nodes"), (F.col("confidence") * F.col("product")).alias("product"), "away", "entered"))
        ended = found.where("away = 0").drop("away", "entered")
        done = ended if done is None else done.unionByName(ended)
        now = found.where("entered").drop("away", "entered")
        if now.isEmpty():
            break
    if done is None:
        done = now.limit(0)
    return done.select("target", "nodes", F.round("product", 4).alias("confidence"), (F.size("nodes") - 1).alias("hops"))


def resolve_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths with steps, an array of structs of the nodes' columns (id and others) in the path's order; a node that
    isn't known has its id only. Nodes are joined by id, step by step, not sent with the paths; a path's columns travel
    with its first step."""
    known = nodes.dropDuplicates(["id"]).withColumnRenamed("id", "_id")
    row = F.struct(*[F.col(f"`{c}`") for c in paths.columns])
    numbered = paths.select(row.alias("_row"), F.monotonically_increasing_id().alias("_path"))
    steps = numbered.select("_path", "_row", F.posexplode("_row.nodes").alias("_at", "id"))
    steps = steps.withColumn("_row", F.when(F.col("_at") == 0, F.col("_row")))
    steps = steps.join(known, F.col("id") == F.col("_id"), "left")
    one = F.struct("_at", F.struct("id", *[c for c in nodes.columns if c != "id"]).alias("n"))
    each = steps.groupBy("_path").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.collect_list(one)).alias("_steps"))
    return each.select(*[F.col("_row")[c].alias(c) for c in paths.columns], F.transform("_steps", lambda x: x["n"]).alias("steps"))


def shortest_and_longest(paths: DataFrame) -> DataFrame:
    """(target, shortest, longest): fewer nodes first, then more confidence; more nodes, then more confidence."""
    return paths.groupBy("target").agg(F.min_by("nodes", F.struct("hops", -F.col("confidence"), "nodes")).alias("shortest"), F.max_by("nodes", F.struct("hops", "confidence", "nodes")).alias("longest"))


def entities_by_hop(clues: DataFrame) -> DataFrame:
    """(hop, entities) of entity clues (seq, hop, id), the first of each, in order."""
    first = clues.groupBy("hop", "id").agg(F.min("seq").alias("seq"))
    return first.groupBy("hop").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("entities"))


def lost_keys(keys: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Keys none of whose events were kept, and how many they had."""
    own = edges.join(keys.select("entity_id"), "entity_id", "left_semi")
    alive = own.join(kept.select("event_id"), "event_id", "left_semi").select("entity_id").distinct()
    return own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("events")).join(alive, "entity_id", "left_anti")


def response(items: DataFrame, events: DataFrame, clues: DataFrame) -> DataFrame:
    """Nested rows: each item's event and the clues that lead to it, best item first."""
    led = clues.groupBy(F.col("dst").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "stage", "src", "confidence"))).alias("clues"))
    return items.join(events.withColumnRenamed("event_id", "item_id"), "item_id").join(led, "item_id", "left").select("item_id", "weight", F.struct(*[c for c in events.columns if c != "event_id"]).alias("event"), "clues")

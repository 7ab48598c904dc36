"""Vector search, BM25, rank fusion, key and event weights, PageRank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.functions import vectors as vx
from eventloom.operators.lineage import discard, forget, materialize_by, shared_folder
from eventloom.operators.lineage import materialize as cut_lineage
from eventloom.operators.relational import ranked
from eventloom.operators.vector_index import VectorIndex


def knn(rows: DataFrame, vector: str, query: Sequence[float], k: int, key: str, mode: str = "raw", clip: bool = False) -> DataFrame:
    """The k rows nearest by cosine with their score: raw cosine, or the (1 + cosine) / 2 of search indexes. Exact.

    Filter rows before the call: the filter then lies below the top-k.
    """
    c = vx.cosine(F.col(vector), vx.literal(query), clip=clip)
    return rows.withColumn("score", vx.unit_score(c) if mode == "unit" else c).orderBy(F.desc("score"), key).limit(k)


def knn_join(rows: DataFrame, queries: DataFrame, vector: str, key: str, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, key, score): the k rows nearest by cosine to each query but itself, of those at or above threshold.

    Exact, through an index of the rows in the shared folder; where rows are searched again, build one and keep it.
    Zero vectors have the cosine 0; null vectors are left out.
    """
    return VectorIndex.build(rows, key, vector, shared_folder(rows.sparkSession)).search(queries, vector, k, threshold)


def bm25(docs: DataFrame, key: str, fields: dict[str, float], query: Sequence[str], k1: float = 1.2, b: float = 0.75, min_score: float | None = None) -> DataFrame:
    """(key, score): fielded BM25, the best of the boosted field scores; only rows with a term of the query.

    Each text is cut into tokens once, in a pass that leaves a narrow table of counts; nothing is shuffled but the few
    statistics of the fields. Where documents are searched again and again, keep a TextIndex.
    """
    terms = sorted({q.lower() for q in query})
    of = lambda f: F.coalesce(F.col(f), F.lit(""))
    equals = lambda term: lambda token: token == term
    cut = docs.select(key, *[tx.tokens(of(f)).alias(f"t_{f}") for f in fields])
    rows = cut.select(key, *[F.size(f"t_{f}").alias(f"dl_{f}") for f in fields], *[F.size(F.filter(f"t_{f}", equals(q))).alias(f"tf_{f}_{i}") for f in fields for i, q in enumerate(terms)])
    rows = cut_lineage(rows)
    facts = rows.agg(*[F.sum(F.when(F.col(f"dl_{f}") > 0, 1)).alias(f"n_{f}") for f in fields], *[F.avg(F.when(F.col(f"dl_{f}") > 0, F.col(f"dl_{f}"))).alias(f"avg_{f}") for f in fields], *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))])
    both = rows.join(F.broadcast(facts))  # one row

    def field(f: str) -> Column:
        total = F.lit(0.0)
        for i in range(len(terms)):
            tf, df, n = F.col(f"tf_{f}_{i}"), F.col(f"df_{f}_{i}"), F.col(f"n_{f}")
            idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
            total += F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"dl_{f}") / F.col(f"avg_{f}")))).otherwise(0.0)
        return fields[f] * total

    scores = [field(f) for f in fields]
    out = both.select(key, (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score")).where("score > 0")
    return out if min_score is None else out.where(F.col("score") >= min_score)


def bm25_okapi(docs: DataFrame, key: str, text: str, query: Sequence[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(key, score) of every candidate: the form whose negative idf becomes epsilon times the mean idf of all terms."""
    counted = cut_lineage(docs.select(key, F.explode(tx.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    df = counted.groupBy("term").agg(F.count(key).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = df.join(F.broadcast(n)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean"))
    asked = docs.sparkSession.createDataFrame([(q.lower(),) for q in query], "term string")
    weights = idf.join(F.broadcast(asked), "term").join(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("w"))
    length = counted.groupBy(key).agg(F.sum("tf").alias("dl"))
    avg = length.agg((F.sum("dl")).alias("total")).join(F.broadcast(n)).select((F.col("total") / F.col("n")).alias("avgdl"))
    tf = counted.join(F.broadcast(weights), "term")
    part = tf.join(length, key).join(F.broadcast(avg)).withColumn("s", F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    return docs.select(key).join(part.groupBy(key).agg(F.sum("s").alias("score")), key, "left").na.fill(0.0, ["score"])


def rrf(rows: DataFrame, key: str, weights: dict[str, float], k: int = 60) -> DataFrame:
    """rows with rank_<list> and rrf, the sum of weight / (k + rank) over the lists; a null score is in no list."""
    out = ranked(rows, list(weights), key)
    total = F.lit(0.0)
    for s, w in weights.items():
        total += F.when(F.col(s).isNotNull(), w / (k + F.col(f"rank_{s}"))).otherwise(0.0)
    return out.withColumn("rrf", total)


#: Weights of similarity, relation, density and BM25 ranks in the rerank step.
RERANK_WEIGHTS = {"similarity": 1.5, "relation": 0.5, "density": 0.2, "bm25": 2.0}


def relation_and_density(clues: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, relation, density) of clues (item, weight, hop, step, count, is_target): relation falls with hops."""
    seen = clues.where("count > 0")
    return seen.groupBy(item).agg(
        F.sum(F.col("weight") / (1 + F.col("hop")) * F.when(F.col("is_target"), 1.5).otherwise(1.0)).alias("relation"),
        F.sum(F.col("weight") * F.log1p("count") / F.col("step")).alias("density"),
    )


def event_prior(edges: DataFrame, keys: DataFrame, e1: DataFrame, most: int | None = 60) -> DataFrame:
    """(event_id, weight): half the query similarity plus half the weights of its keys; missing ones count 0."""
    w = edges.join(keys.select("entity_id", "k1"), "entity_id", "left").groupBy("event_id").agg(F.sum(F.coalesce("k1", F.lit(0.0))).alias("keys"))
    out = w.join(e1, "event_id", "left").select("event_id", (0.5 * F.coalesce("e1", F.lit(0.0)) + 0.5 * F.col("keys")).alias("weight"))
    return out if most is None else out.orderBy(F.desc("weight"), "event_id").limit(most)


def mention_weight(mentions: DataFrame, e1: DataFrame | None = None, steps: bool = False) -> DataFrame:
    """(event_id, weight) of mentions (event_id, weight, count, step): the log of 1 plus damped mention counts.

    With e1, half the query similarity is added; with steps, counts are one at least and later steps count less.
    """
    n = F.greatest(F.lit(1), F.col("count")) if steps else F.col("count")
    per = F.col("weight") * F.log1p(n) / (F.col("step") if steps else F.lit(1))
    out = mentions.groupBy("event_id").agg(F.log1p(F.sum(per)).alias("weight"))
    if e1 is None:
        return out
    return out.join(e1, "event_id", "left").select("event_id", (0.5 * F.coalesce("e1", F.lit(0.0)) + F.col("weight")).alias("weight"))


def normalize_to_max(events: DataFrame, most: int, weight: str = "weight", tie: str = "event_id") -> DataFrame:
    """The strongest events divided by the largest weight, without those of 0; if all are 0, each gets 0.1. No more rows
    than most, over which the window runs, in either case."""
    kept = events.orderBy(F.desc(weight), tie).limit(most).withColumn("top", F.max(weight).over(Window.partitionBy(F.lit(0))))
    kept = kept.where((F.col("top") == 0) | (F.col("top") > 0) & (F.col(weight) > 0))
    return kept.withColumn(weight, F.when(F.col("top") > 0, F.col(weight) / F.col("top")).otherwise(0.1)).drop("top")


def key_weight_recall(edges: DataFrame, events: DataFrame, names: DataFrame | None = None, query: str = "") -> DataFrame:
    """(entity_id, weight): mean weight of its events, half as much again if the query names it."""
    out = edges.join(events, "event_id").groupBy("entity_id").agg(F.avg("weight").alias("weight"))
    if names is None:
        return out
    named = F.lit(query.lower()).contains(F.lower("name"))
    return out.join(names.select("entity_id", "name"), "entity_id").select("entity_id", (F.col("weight") * F.when(named, 1.5).otherwise(1.0)).alias("weight"))


def key_weight_expand(edges: DataFrame, related: DataFrame, weights: DataFrame) -> DataFrame:
    """(entity_id, weight, n): mean weight of all related events, pruned ones as 0, times the damped number of them."""
    all_ = related.select("event_id").join(weights, "event_id", "left").na.fill(0.0, ["weight"])
    return edges.join(all_, "event_id").groupBy("entity_id").agg(F.avg("weight").alias("mean"), F.count(F.lit(1)).alias("n")).select("entity_id", (F.col("mean") * F.least(F.lit(2.0), F.log1p("n"))).alias("weight"), "n")


def hop_weighted_mean(evolution: DataFrame, hops: int) -> DataFrame:
    """(entity_id, weight) of rows (entity_id, hop, weight): later hops count more; hop over hops is the weight."""
    share = F.col("hop") / hops
    return evolution.groupBy("entity_id").agg((F.sum(F.col("weight") * share) / F.sum(share)).alias("weight"))


def priority_bias(keys: DataFrame, gap: float = 0.05) -> DataFrame:
    """Lifts the keys from the tokenizer so that the lowest is gap above the highest of the others."""
    ends = keys.agg(F.min(F.when(F.col("from_tokenizer"), F.col("weight"))).alias("low"), F.max(F.when(~F.col("from_tokenizer"), F.col("weight"))).alias("high"))
    lift = F.greatest(F.lit(0.0), F.coalesce(F.col("high") + gap - F.col("low"), F.lit(0.0)))
    return keys.join(F.broadcast(ends)).withColumn("weight", F.col("weight") + F.when(F.col("from_tokenizer"), lift).otherwise(0.0)).drop("low", "high")


def shared_entity_graph(clues: DataFrame, item: str = "item_id", entity: str = "entity_id", weight: str = "weight") -> DataFrame:
    """(a, b, weight), a < b: items that share entities, by the mean of their weights for each.

    Pairs grow with the square of an entity's items, but only lists are shuffled: an item goes to its place once for each
    block of others that share an entity with it, and pairs are made and summed there. shared_pagerank ranks the same
    graph without them.
    """
    met = _met(clues.select(F.col(item).alias("i"), F.col(entity).alias("e"), F.col(weight).alias("w")))
    after = F.filter("others", lambda x: x["i"] > F.col("a"))
    met = met.select("a", "wa", after.alias("others")).where(F.size("others") > 0)
    # arrays of one plain type each are a third of an array of structs
    met = met.select("a", F.transform("others", lambda x: x["i"]).alias("b"), F.transform("others", lambda x: (F.col("wa") + x["w"]) / 2).alias("w"))
    pairs = _dealt(met).select("a", F.inline(F.arrays_zip("b", "w")))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"))


#: Items of an entity in a list.
BLOCK_ITEMS = 1024


def _met(rows: DataFrame, both: bool = False) -> DataFrame:
    """(a, wa, others) of rows (i, e, w): each item with the lists of (i, w) of its entities; unless both is set, without
    those that lie before its own block in the order of items. One shuffle, by entity."""
    rows = rows.where(F.col("i").isNotNull() & F.col("e").isNotNull())
    at = F.row_number().over(Window.partitionBy("e").orderBy("i"))
    lists = rows.withColumn("k", F.floor((at - 1) / BLOCK_ITEMS)).groupBy("e", "k").agg(F.collect_list(F.struct("i", "w")).alias("own"))
    others = lists.select("e", F.col("k").alias("k2"), F.col("own").alias("others"))
    return lists.join(others, "e").where("true" if both else "k <= k2").select(F.inline("own").alias("a", "wa"), "others")


def _dealt(met: DataFrame) -> DataFrame:
    """met by its items, over all shuffle partitions: lists are small, what is made of them isn't, so that partitions
    must not be put together by the size of the lists."""
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a")


def shared_degrees(clues: DataFrame, item: str = "item_id", entity: str = "entity_id") -> DataFrame:
    """(item, d): with how many others each item with an entity shares one, as degrees of shared_entity_graph has it. An
    item's others are counted where its lists meet; pairs go no further."""
    met = _met(clues.select(F.col(item).alias("i"), F.col(entity).alias("e"), F.lit(None).cast("boolean").alias("w")).distinct(), both=True)
    pairs = met.select("a", F.transform("others", lambda x: x["i"]).alias("b"))
    pairs = _dealt(pairs).select("a", F.explode("b").alias("b")).distinct()
    return pairs.groupBy(F.col("a").alias(item)).agg((F.count(F.lit(1)) - 1).alias("d"))  # less itself


def degrees(graph: DataFrame, nodes: DataFrame, node: str = "item_id") -> DataFrame:
    """One row: mean and highest degree, isolated nodes."""
    ends = graph.select(F.explode(F.array("a", "b")).alias(node)).groupBy(node).agg(F.count(F.lit(1)).alias("d"))
    return degree_facts(ends, nodes, node)


def degree_facts(ends: DataFrame, nodes: DataFrame, node: str = "item_id") -> DataFrame:
    """One row: mean and highest of the degrees (node, d), isolated nodes, those without a degree among them."""
    return nodes.select(node).join(ends, node, "left").na.fill(0, ["d"]).agg(F.avg("d").alias("mean"), F.max("d").alias("most"), F.count_if(F.col("d") == 0).alias("isolated"))


def pagerank(graph: DataFrame, start: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, node: str = "item_id", every: int = 5) -> DataFrame:
    """(node, rank) by weighted PageRank on the undirected graph (a, b, weight).

    start: (node, weight), its share is the first rank. A node without links passes nothing on, so its share is lost,
    and ends at (1 - damping) / n. The driver only sees the change of each round; lineage is cut every few rounds.
    """
    both = graph.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(graph.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("all"))
    links = cut_lineage(both.join(out, "src").where("`all` > 0").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))

    def flow(ranks: DataFrame) -> DataFrame:
        return links.join(ranks.withColumnRenamed(node, "src"), "src").groupBy(F.col("dst").alias(node)).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))

    return _rank(start, flow, damping, rounds, tolerance, node, every)


#: Items of a graph from which on its tables are written in buckets.
BUCKETED = 1 << 18


def shared_pagerank(clues: DataFrame, start: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, item: str = "item_id", entity: str = "entity_id", weight: str = "weight", every: int = 5) -> DataFrame:
    """(item, rank) as pagerank(shared_entity_graph(clues), start), without the pairs of items.

    A link's weight is a sum of terms of each end, so an entity passes on sums over its items, less each item's own
    share: the rows of a round are those of clues, however many items an entity has. Clues lie in buckets of their
    entities and of their items, so a round shuffles only what items send to entities and entities to items, summed in
    each task before; what an item sends itself is known beforehand and taken off at the item. Weights are least * c +
    over, least being the entity's: where it has one weight for all, sums of over are zeros, which shuffle for little.
    """
    large = start.count() >= BUCKETED
    by = lambda df, column: materialize_by(df, column) if large else cut_lineage(df)
    rows = clues.where(F.col(item).isNotNull() & F.col(entity).isNotNull() & F.col(weight).isNotNull()).select(item, entity, weight)
    if large:  # one shuffle for the sums and the buckets
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), entity)
    rows = rows.groupBy(item, entity).agg(F.count(F.lit(1)).alias("c"), F.sum(weight).alias("w"))
    of_entities = by(rows, entity)
    sums = of_entities.groupBy(entity).agg(F.sum("c").alias("cs"), F.sum("w").alias("ws"), F.min(F.col("w") / F.col("c")).alias("least"))
    met = of_entities.join(sums, entity)
    of_items = by(met.select(item, entity, "c", (F.col("w") - F.col("least") * F.col("c")).alias("over")), item)
    share = (F.col("c") * (F.col("ws") - F.col("w")) + F.col("w") * (F.col("cs") - F.col("c"))) / 2
    facts = met.groupBy(item).agg(F.sum(share).alias("all"), F.sum(F.col("c") * F.col("w")).alias("own"))
    facts = by(facts.where("`all` > 0"), item)
    least = by(sums.select(entity, "least"), entity)

    def flow(ranks: DataFrame) -> DataFrame:
        sent = ranks.join(facts, item).select(item, (F.col("rank") / F.col("all")).alias("q"), "own")
        sums = of_items.join(sent.select(item, "q"), item).groupBy(entity).agg(F.sum(F.col("c") * F.col("q")).alias("cs"), F.sum(F.col("over") * F.col("q")).alias("os"))
        sums = sums.join(least, entity).select(entity, "cs", (F.col("least") * F.col("cs") + F.col("os")).alias("ws"))
        got = of_entities.join(sums, entity).groupBy(item).agg(F.sum(F.col("c") * F.col("ws") + F.col("w") * F.col("cs")).alias("got"))
        return got.join(sent, item).select(item, (F.col("got") / 2 - F.col("q") * F.col("own")).alias("got"))

    out = _rank(start, flow, damping, rounds, tolerance, item, every, lambda df: by(df, item))
    discard(of_items, of_entities, facts, least)
    return out


def _rank(start: DataFrame, flow: Callable[[DataFrame], DataFrame], damping: float, rounds: int, tolerance: float, node: str, every: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rounds of PageRank; flow: what each node gets, (node, got), from (node, rank); cut: how each round's ranks are
    written, where flow reads them twice."""
    facts = start.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")).first()
    n, total = facts.n, facts.total
    if not n:
        return start.select(node, F.lit(0.0).alias("rank"))
    ranks = (cut or cut_lineage)(start.select(node, (F.col("weight") / total if total else F.lit(1.0 / n)).alias("rank")))
    for k in range(rounds):
        last, checked = ranks, tolerance > 0 and (k + 1) % every == 0 or k == rounds - 1
        new = last.select(node, F.col("rank").alias("old")).join(flow(last.select(node, "rank")), node, "left")
        new = new.select(node, *["old"] * checked, ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        ranks = cut(new) if cut else cut_lineage(new) if checked else new
        if cut:
            discard(last)
        if checked and ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    return forget(ranks).select(node, "rank")


def blend(items: DataFrame, ranks: DataFrame, node: str = "item_id", share: float = 0.2) -> DataFrame:
    """Weights mixed with PageRank, which is scaled to the largest weight."""
    rows = items.join(ranks, node)
    top = rows.agg(F.max("weight").alias("mw"), F.max("rank").alias("mr"))
    return rows.join(F.broadcast(top)).withColumn("weight", (1 - share) * F.col("weight") + share * F.coalesce(F.try_divide(F.col("rank") * F.col("mw"), F.col("mr")), F.lit(0.0))).drop("mw", "mr")

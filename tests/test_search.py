"""The search plan against plain loops, paths against a walk over all of them."""

import math
import random
from collections import defaultdict

import pytest
from eventloom.plans import catalog, q_ranking, search
from pyspark.sql import functions as F


def walk(clues, targets, origins, depth):
    best = defaultdict(float)
    for a, b, c in clues:
        best[a, b] = max(best[a, b], c)
    out = {}

    def go(path, c):
        if len(path) > 1 and path[-1] in targets:
            out[path] = c
        if len(path) <= depth:
            for (a, b), x in best.items():
                if a == path[-1] and b not in path:
                    go((*path, b), c * x)

    for o in origins:
        go((o,), 1.0)
    return out


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_paths(spark, depth):
    rng = random.Random(depth)
    nodes = [f"n{k}" for k in range(12)]
    clues = [(*rng.choices(nodes, k=2), rng.choice([0.5, 0.9, 1.0])) for _ in range(26)]
    targets, origins = nodes[:4], [*nodes[3:5], "absent"]
    ids = lambda x: spark.createDataFrame([(n,) for n in [*x, x[0]]], "id string")
    got = search.paths_to(spark.createDataFrame(clues, "src string, dst string, confidence double"), ids(targets), ids(origins), depth)
    want = walk(clues, targets, origins, depth)
    rows = got.collect()
    assert {tuple(r.nodes): r.confidence for r in rows} == {p: pytest.approx(c, abs=1e-4) for p, c in want.items()} and len(rows) == len(want)
    assert all((r.target, r.hops) == (r.nodes[-1], len(r.nodes) - 1) for r in rows)
    known = spark.createDataFrame([(n, f"is {n}") for n in nodes[1:]], "id string, content string")
    for r in search.resolve_paths(got, known).collect():
        assert [(s.id, s.content) for s in r.steps] == [(n, None if n == "n0" else f"is {n}") for n in r.nodes]


def top(rows, n, weight=1):
    return sorted(rows, key=lambda r: (-r[weight], r[0]))[:n]


def brute_search(similarity, e1, edges, cfg):
    """similarity: {entity: cosine}, e1: {event: cosine}, edges: {(event, entity)}."""
    of_event, of_entity = defaultdict(set), defaultdict(set)
    for ev, en in edges:
        of_event[ev].add(en)
        of_entity[en].add(ev)
    # recall
    keys = dict(top([(k, c) for k, c in similarity.items() if c >= cfg.entity_threshold], cfg.max_entities))
    touched = {ev for k in keys for ev in of_entity[k]} | {ev for ev, c in e1.items() if c >= cfg.event_threshold}
    prior = top([(ev, 0.5 * e1.get(ev, 0.0) + 0.5 * sum(keys.get(k, 0.0) for k in of_event[ev])) for ev in touched if of_event[ev]], cfg.max_events)
    gather = defaultdict(list)
    for ev, w in prior:
        for k in of_event[ev]:
            gather[k].append(w)
    start = top([(k, x) for k, x in ((k, sum(w) / len(w)) for k, w in gather.items()) if x >= cfg.key_threshold], cfg.final_keys)
    # expansion
    found, current, step, last = {k: 0 for k, _ in start}, dict(start), 1, None
    evolution = defaultdict(dict)
    for hop in range(1, cfg.hops + 1):
        sums = defaultdict(float)
        for k, w in current.items():
            for ev in of_entity[k]:
                sums[ev] += w * math.log1p(1) / step
        events = top([(ev, math.log1p(s)) for ev, s in sums.items()], cfg.events_per_hop)
        most = max((w for _, w in events), default=0)
        events = {ev: w / most if most > 0 else 0.1 for ev, w in events if most == 0 or w > 0}
        gather = defaultdict(list)
        for ev, w in events.items():
            for k in of_event[ev]:
                gather[k].append(w)
        weights = {k: sum(w) / len(w) * min(2.0, math.log1p(len(w))) for k, w in gather.items()}
        for k, w in weights.items():
            evolution[k][hop] = w
        total = sum(weights.values())
        change = 1.0 if last is None else abs(total - last) / last if last else 0.0
        last = total
        if change < cfg.convergence:
            break
        fresh = top([(k, w) for k, w in weights.items() if k not in found], cfg.keys_per_hop)
        if not fresh:
            break
        found |= {k: hop for k, _ in fresh}
        current, step = dict(fresh), hop + 1
    final = {k: sum(w * h / cfg.hops for h, w in evolution[k].items()) / sum(h / cfg.hops for h in evolution[k]) if evolution.get(k) else 0.0 for k in found}
    # rerank
    items = [ev for ev, c in e1.items() if c >= cfg.rerank_threshold]
    relation, density = defaultdict(float), defaultdict(float)
    for ev in items:
        for k in of_event[ev] & set(final):
            relation[ev] += final[k] / (1 + found[k])
            density[ev] += final[k] * math.log1p(1) / (1 + found[k])
    fused = defaultdict(float)
    for score, weight in ((e1, 1.5), ({ev: round(relation[ev], 9) for ev in items}, 0.5), ({ev: round(density[ev], 9) for ev in items}, 0.2)):
        for n, (ev, _) in enumerate(top([(ev, score[ev]) for ev in items], len(items)), 1):
            fused[ev] += weight / (cfg.rrf_k + n)
    return [(ev, relation[ev], density[ev], w) for ev, w in top(list(fused.items()), cfg.max_results)]


def test_flagship(spark, small):
    table = lambda t: spark.read.parquet(f"{small}/{t}.parquet")
    query, rows = q_ranking._query_vector(spark, small), table("embeddings").select("vec_id", "embedding").collect()
    length = lambda v: math.sqrt(sum(x * x for x in v))
    cosine = {r.vec_id: max(0.0, min(1.0, sum(a * b for a, b in zip(r.embedding, query)) / (length(r.embedding) * length(query)))) for r in rows}
    near = lambda k: cosine.get(k % len(rows))
    similarity = {r[0]: near(r[0]) for r in table("part").select("p_partkey").collect() if near(r[0]) is not None}
    e1 = {r[0]: near(r[0]) for r in table("orders").select("o_orderkey").collect() if near(r[0]) is not None}
    edges = {tuple(r) for r in table("lineitem").select("l_orderkey", "l_partkey").collect()}
    want = brute_search(similarity, e1, edges, search.SearchConfig(key_threshold=0.0, rerank_threshold=0.1))
    got = catalog.QUERIES["search_flagship"](spark, small).orderBy(F.desc("weight"), "item_id").collect()
    assert [r.item_id for r in got] == [w[0] for w in want]
    assert [(r.relation, r.density, r.weight) for r in got] == [pytest.approx(w[1:], abs=1e-7) for w in want]
    assert any(w[1] > 0 for w in want)


def test_contained_names(spark):
    from eventloom.operators import relational

    rng = random.Random(9)
    names = [("".join(rng.choices("abÜ中 ", k=rng.randint(0, 5))), rng.choice([0.5, 1.0, 2.0]), rng.randint(0, 1)) for _ in range(60)]
    texts = [(k, rng.randint(0, 1), rng.choice([None, "AB", ""]), "".join(rng.choices("abü中 x", k=rng.randint(0, 25)))) for k in range(80)]
    events = spark.createDataFrame(texts, "event_id int, batch int, title string, content string")
    entities = spark.createDataFrame(names, "name string, weight double, batch int")
    got = {(r.event_id, r.name.lower()) for r in relational.contained_names(events, entities, "batch").collect()}
    said = {k: " ".join(x for x in (title, content) if x is not None).lower() for k, _, title, content in texts}
    assert got == {(k, n.lower()) for k, b, *_ in texts for n, w, c in names if n and w >= 1 and b == c and n.lower() in said[k]}


def test_paths_stop_at_origins_that_nothing_leads_to(spark, monkeypatch):
    """Paths are not joined with all clues once more when each of them begins where no clue leads to; one that begins
    at an origin on the way is walked on."""
    walked, cut = [], search.rk.cut_lineage
    monkeypatch.setattr(search.rk, "cut_lineage", lambda df: (walked.append("nodes" in df.columns), cut(df))[1])
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    clues = spark.createDataFrame([("c1", "o1", 0.5), ("c1", "o1", 0.25), ("o1", "p1", 0.5), ("o1", "p2", 1.0), ("o2", "p2", 1.0)], "src string, dst string, confidence double")
    got = search.paths_to(clues, ids(["p1", "p2"]), ids(["c1", "c2"]), 4).collect()
    assert sorted((r.target, *r.nodes, r.confidence) for r in got) == [("p1", "c1", "o1", "p1", 0.25), ("p2", "c1", "o1", "p2", 0.5)]
    assert sum(walked) == 2
    got = search.paths_to(clues, ids(["p1"]), ids(["c1", "o1"]), 4).collect()
    assert sorted("".join(r.nodes) for r in got) == ["c1o1p1", "o1p1"]

"""Queries of the relational walk: filters, joins, windows, set operations, windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import chunking as ch
from eventloom.operators import relational as rel
from eventloom.plans.catalog import EDGES, edges, query, table
from eventloom.streaming import window_counts


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("source_config_id"), "o_orderpriority")


def _part(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), "p_size", "p_retailprice")


@query("SELECT o_orderkey AS event_id FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8)")
def tenant_filter(spark, d):
    return rel.of_sources(_orders(spark, d), [1, 2, 3, 5, 8]).select("event_id")


@query("SELECT p_partkey AS entity_id FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'tags')")
def type_focus(spark, d):
    return rel.type_filter(_part(spark, d), focus=["Brand#11", "Brand#12"]).select("entity_id")


@query("SELECT p_partkey AS entity_id FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
def type_exclude(spark, d):
    return rel.type_filter(_part(spark, d), exclude=["Brand#11", "Brand#12"]).select("entity_id")


@query("SELECT p_partkey AS entity_id FROM part WHERE p_retailprice >= 1000")
def threshold_filter(spark, d):
    return rel.at_least(_part(spark, d), "p_retailprice", 1000.0).select("entity_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def time_range(spark, d):
    import datetime as dt

    return rel.in_time(table(spark, d, "events"), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12), "ts", "ts").select("event_id")


@query("SELECT p_partkey AS entity_id FROM part WHERE contains(p_name, '7') OR contains(p_type, '7')")
def substring_like(spark, d):
    return rel.containing(table(spark, d, "part"), "7", "p_name", "p_type").select(F.col("p_partkey").alias("entity_id"))


@query("""SELECT p_partkey AS entity_id, n AS asked FROM part JOIN (SELECT min(p_name) AS n, lower(replace(p_name, ' ', '')) AS k FROM part WHERE p_partkey % 50 = 0 GROUP BY 2) x
ON lower(replace(p_name, ' ', '')) = k""")
def exact_name_match(spark, d):
    part = _part(spark, d)
    names = part.where("entity_id % 50 = 0").groupBy(tx.name_key(F.col("name")).alias("k")).agg(F.min("name").alias("name"))
    return rel.exact_names(part, names).select("entity_id", "asked")


@query("""WITH n AS (SELECT DISTINCT lower(replace(p_name, ' ', ''))[1:6] AS p FROM part WHERE p_partkey % 50 = 0)
SELECT p_partkey AS entity_id, min(n.p) AS asked FROM part, n WHERE starts_with(lower(replace(p_name, ' ', '')), n.p) GROUP BY 1""")
def prefix_name_match(spark, d):
    part = _part(spark, d)
    names = part.where("entity_id % 50 = 0").select(F.substring(tx.name_key(F.col("name")), 1, 6).alias("name")).distinct()
    return rel.prefix_names(part, names, least=4).select("entity_id", "asked")


@query(f"""WITH {EDGES} SELECT event_id FROM e GROUP BY event_id HAVING count(*) FILTER (entity_id IN (1, 2, 3, 10)) > 0""")
def array_membership(spark, d):
    rows = edges(spark, d).groupBy("event_id").agg(F.collect_list("entity_id").alias("entity_ids"))
    return rel.with_any_of(rows, "entity_ids", [1, 2, 3, 10]).select("event_id")


@query("SELECT o_orderkey AS event_id, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def fetch_by_ids(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("event_id"))
    return rel.by_ids(_orders(spark, d), ids, "event_id").select("event_id", "price")


@query(f"WITH {EDGES} SELECT DISTINCT event_id FROM e WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def entity_to_event(spark, d):
    return rel.events_of(edges(spark, d), _part(spark, d).where("p_size = 10"))


@query(f"""WITH {EDGES} SELECT e.event_id, p_brand AS type, count(*) AS n FROM e JOIN part ON p_partkey = entity_id
WHERE p_brand NOT IN ('Brand#11') GROUP BY 1, 2""")
def edges_with_type(spark, d):
    typed = rel.type_filter(_part(spark, d), exclude=["Brand#11"]).select("entity_id", "type")
    return edges(spark, d).join(typed, "entity_id").groupBy("event_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES} SELECT entity_id, count(DISTINCT event_id) AS n FROM e WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def valid_keys_semi(spark, d):
    return rel.with_evidence(edges(spark, d), _orders(spark, d).where("o_orderpriority = '1-URGENT'"))


@query("SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def new_keys_anti(spark, d):
    seen = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entity_id"))
    return _part(spark, d).select("entity_id").join(seen, "entity_id", "left_anti")


@query(f"""WITH {EDGES}, s AS (SELECT o_custkey AS chunk_id, entity_id, min((o_orderkey, e.event_id, entity_id)) AS first FROM e JOIN orders ON o_orderkey = event_id GROUP BY 1, 2)
SELECT chunk_id, string_agg(entity_id::VARCHAR, ',' ORDER BY first) AS entities FROM s GROUP BY 1""")
def event_to_chunk(spark, d):
    ev = _orders(spark, d).select("event_id", F.col("source_config_id").alias("chunk_id"), F.col("event_id").alias("rank"))
    return rel.chunk_entities(edges(spark, d), ev).select("chunk_id", F.array_join(F.col("entities").cast("array<string>"), ",").alias("entities"))


@query("""WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'entity' ELSE 'bm25' END AS source FROM a FULL JOIN b ON a.id = b.id""")
def merge_two_recalls(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return rel.merge_recalls(o.where("id % 3 = 0"), o.where("id % 5 = 0"), "id").select("id", "source")


@query("""SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 12""")
def left_lookup(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "s_name", "n_name")


@query("""WITH r AS (SELECT l_orderkey AS id, list(l_linenumber ORDER BY l_linenumber DESC) AS refs FROM lineitem GROUP BY 1),
x AS (SELECT id, i, refs[i] AS ln FROM (SELECT id, refs, unnest(range(1, len(refs) + 1)) AS i FROM r))
SELECT x.id, string_agg(l_partkey::VARCHAR, ',' ORDER BY i, l_partkey) AS parts FROM x JOIN lineitem l ON l.l_orderkey = x.id AND l.l_linenumber = x.ln WHERE x.ln <= 4 GROUP BY 1""")
def ordered_references(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    key = lambda a, b: F.concat_ws("-", a, b)
    refs = li.groupBy("id").agg(F.sort_array(F.collect_list("l_linenumber"), asc=False).alias("n")).select("id", F.transform("n", lambda x: key(F.col("id"), x)).alias("refs"))
    details = li.where("l_linenumber <= 4").select(key(F.col("id"), F.col("l_linenumber")).alias("ref"), "l_partkey")
    out = rel.in_order(refs, "refs", details, "ref", ["id"], "d")
    return out.select("id", F.array_join(F.transform("d", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("""WITH b AS (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS name FROM benchmark)
SELECT doc_id AS event_id, name FROM documents, b WHERE length(name) > 1 AND contains(lower(concat_ws(' ', source, text)), name)""")
def containment_join(spark, d):
    ev = table(spark, d, "documents").select(F.lit(1).alias("batch"), F.col("doc_id").alias("event_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    names = table(spark, d, "benchmark").select(F.lit(1).alias("batch"), F.lower(F.split("text", " ")[1]).alias("name"), F.lit(1.0).alias("weight")).where("length(name) > 1").distinct()
    return rel.contained_names(ev, names, "batch")


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn)[1:800] AS previous FROM conversations")
def predecessor_lookup(spark, d):
    return rel.previous(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "previous")


@query("""WITH c AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click'), o AS (SELECT event_id AS other, ts AS ots, user_id FROM events WHERE event_type = 'view'),
m AS (SELECT c.event_id, o.other, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(ts) - epoch_us(ots)), other) AS nth FROM c JOIN o USING (user_id) WHERE abs(epoch_us(ts) - epoch_us(ots)) <= 86400000000)
SELECT event_id, other FROM m WHERE nth = 1""")
def nearest_in_time(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    left = e.where("event_type = 'click'").drop("event_type")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("other"), F.col("ts").alias("ots"), "user_id")
    return rel.nearest_in_time(left, right, 86400, "event_id", "ts", "ots", equal=["user_id"], tie="other").select("event_id", "other")


@query("""WITH b AS (SELECT o_custkey AS chunk_id, max(o_totalprice) AS weight, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS event_id FROM orders GROUP BY 1)
SELECT * FROM b ORDER BY weight DESC, event_id LIMIT 25""")
def ranked_first_chunks(spark, d):
    ev = _orders(spark, d).select("event_id", F.col("source_config_id").alias("chunk_id"), F.col("price").alias("weight"))
    return rel.first_chunks(ev, 25)


@query("""SELECT entity_id, event_id FROM (SELECT l_partkey AS entity_id, l_orderkey AS event_id, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey) AS nth
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey) WHERE nth <= 5""")
def top_n_events_per_entity(spark, d):
    rows = edges(spark, d).join(_orders(spark, d).select("event_id", "ts"), "event_id")
    return rel.newest_per_key(rows, "entity_id", "ts", 5, "event_id").select("entity_id", "event_id")


@query("SELECT l_partkey AS entity_id, max(o_orderdate) AS latest FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def latest_timestamp(spark, d):
    return edges(spark, d).join(_orders(spark, d), "event_id").groupBy("entity_id").agg(F.max("ts").alias("latest"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank_n_chars FROM documents")
def dense_rank_map(spark, d):
    return rel.ranked(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["n_chars"], "doc_id", by=["source"]).select("doc_id", "rank_n_chars")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS rank FROM documents")
def global_renumber(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    return rel.numbered(rows, ["lang", "doc_id"], "place", by=["source"]).select("doc_id", (F.col("place") - 1).alias("rank"))


@query(f"""WITH {EDGES}, h AS (SELECT entity_id, (event_id % 4)::INT AS hop FROM e)
SELECT p_partkey AS entity_id, coalesce(min(hop) + 1, 2) AS first_hop FROM part LEFT JOIN h ON entity_id = p_partkey GROUP BY 1""")
def earliest_hop(spark, d):
    hops = edges(spark, d).groupBy("entity_id").agg((F.min(F.col("event_id") % 4).cast("int") + 1).alias("first_hop"))
    return _part(spark, d).select("entity_id").join(hops, "entity_id", "left").na.fill(2, ["first_hop"])


@query(f"""WITH {EDGES}, a AS (SELECT event_id FROM e WHERE entity_id < 50), b AS (SELECT event_id FROM e WHERE entity_id BETWEEN 30 AND 90)
SELECT 'union' AS op, count(*) AS n FROM (SELECT event_id FROM a UNION SELECT event_id FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT event_id FROM a INTERSECT SELECT event_id FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT event_id FROM a EXCEPT SELECT event_id FROM b)""")
def set_operations(spark, d):
    e = edges(spark, d)
    a, b = e.where("entity_id < 50").select("event_id"), e.where("entity_id between 30 and 90").select("event_id")
    n = lambda name, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", a.union(b).distinct()).unionByName(n("intersect", a.intersect(b))).unionByName(n("except", a.subtract(b)))


@query("""SELECT coalesce(b.k, a.k) AS k, coalesce(b.w, a.w) AS w FROM (SELECT p_partkey AS k, p_retailprice AS w FROM part WHERE p_partkey % 2 = 0) a
FULL JOIN (SELECT p_partkey AS k, p_size * 1.0 AS w FROM part WHERE p_partkey % 3 = 0) b ON a.k = b.k""")
def keyed_merge(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("w"))
    b = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("w"))
    return rel.merge_right_wins(a, b, "k", "w")


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def append_only(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return rel.append_new(p.where("k % 2 = 0"), p.where("k % 3 = 0"), "k")


@query("""WITH a AS (SELECT p_partkey AS k, p_retailprice AS score FROM part WHERE p_partkey < 3), b AS (SELECT p_partkey AS k, p_retailprice AS score FROM part WHERE p_partkey >= 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def fallback_union(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("score"))
    return rel.fill_up(p.where("k < 3"), p, "score", "k")


@query("""SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def tumbling_window_chunks(spark, d):
    return window_counts(table(spark, d, "events"), "ts", 60, ("event_type",))


@query("""WITH m AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS s, max(ts) OVER (PARTITION BY user_id) AS e FROM events),
k AS (SELECT *, least(floor((epoch_us(ts) - epoch_us(s)) / 86400000000), greatest(ceil((epoch_us(e) - epoch_us(s)) / 86400000000) - 1, 0))::BIGINT AS k FROM m)
SELECT user_id AS conversation_id, s + k * INTERVAL 1 DAY AS window_start, least(s + (k + 1) * INTERVAL 1 DAY, greatest(e, s + k * INTERVAL 1 DAY)) AS window_end, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM k GROUP BY user_id, s, e, k""")
def conversation_windows(spark, d):
    return ch.windows(table(spark, d, "events").withColumnRenamed("user_id", "conversation_id"), "ts", 1440)


@query("""SELECT conv_id, string_agg(role, '、' ORDER BY t, role) AS participants FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def participants(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "role", F.timestamp_seconds("turn").alias("ts"))
    return ch.participants(m, "conv_id", "role").select("conv_id", "participants")


@query()
def packed_conversations(spark, d):
    """Turns of each conversation in batches of up to 400 estimated tokens."""
    m = table(spark, d, "conversations").select("conv_id", F.struct("turn", tx.chunk_tokens(F.col("text")).cast("long").alias("tokens")).alias("m"))
    rows = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("items"))
    return rows.select("conv_id", F.posexplode(ch.pack(F.col("items"), "tokens", 400)).alias("batch", "b")).select("conv_id", "batch", F.size("b.items").alias("turns"), "b.total")


@query()
def recent_and_sampled(spark, d):
    """The newest 100 events and a repeatable sample of 200 older ones: a sampling operator."""
    return rel.recent_and_sampled(_orders(spark, d).select("event_id", "ts"), "ts", "event_id", 100, 200)

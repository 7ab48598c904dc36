"""Queries of entity statistics, counts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import maintenance as mt
from eventloom.operators import relational as rel
from eventloom.operators import stats
from eventloom.plans.catalog import EDGES, edges, query, table


@query(f"""WITH {EDGES}, own AS (SELECT event_id FROM e WHERE entity_id = 1)
SELECT entity_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM own), 2) AS strength
FROM e WHERE entity_id <> 1 AND event_id IN (SELECT event_id FROM own) GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 10""")
def entity_cooccurrence(spark, d):
    return stats.cooccurrence(edges(spark, d), 1)


@query("SELECT count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events")
def numeric_profile(spark, d):
    return stats.numeric_profile(table(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query("""WITH s AS (SELECT min(value) AS low, max(value) AS high FROM events),
c AS (SELECT least(floor((value - low) / ((high - low) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY 1)
SELECT b.bin, coalesce(n, 0) AS n
FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN s LEFT JOIN c USING (bin)""")
def numeric_histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 10).select("bin", "n")


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def time_trend_day(spark, d):
    return stats.time_trend(table(spark, d, "events"), "ts", "day")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1")
def time_trend_month(spark, d):
    return stats.time_trend(table(spark, d, "orders"), "o_orderdate", "month")


@query("SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 1")
def time_trend_year(spark, d):
    return stats.time_trend(table(spark, d, "orders"), "o_orderdate", "year")


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def enum_distribution(spark, d):
    return stats.enum_distribution(table(spark, d, "events"), "event_type")


@query("SELECT coalesce(CASE WHEN p_size > 25 THEN 'int' WHEN p_retailprice > 1000 THEN 'float' END, 'text') AS value_type, count(*) AS n FROM part GROUP BY 1")
def entity_summary(spark, d):
    part = table(spark, d, "part").withColumn("value_type", F.when(F.col("p_size") > 25, "int").when(F.col("p_retailprice") > 1000, "float"))
    return stats.entity_summary(part, "value_type")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'F') AS status_f,
count(*) FILTER (o_orderstatus = 'P') AS status_p, count(*) FILTER (o_orderpriority = '1-URGENT') AS "priority_1-urgent" FROM orders""")
def status_pivot(spark, d):
    return stats.status_counts(table(spark, d, "orders"), status=("o_orderstatus", ("O", "F", "P")), priority=("o_orderpriority", ("1-URGENT",)))


@query("""SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def source_counts_left_join(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return stats.with_counts(nation, "n_nationkey", customers=(table(spark, d, "customer"), "c_nationkey"), suppliers=(table(spark, d, "supplier"), "s_nationkey"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS sections_count FROM customer")
def document_counts(spark, d):
    return stats.with_counts(table(spark, d, "customer").select("c_custkey"), "c_custkey", sections_count=(table(spark, d, "orders"), "o_custkey"))


@query("SELECT source, count(*) AS doc_count FROM documents GROUP BY source")
def source_terms(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("doc_count"))


@query("SELECT count(*) AS docs, count(DISTINCT source) AS sources, sum(n_chars) AS chars FROM documents")
def global_totals(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS distinct_o_custkey, count(o_custkey) AS filled_o_custkey,
min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate, count(*) FILTER (o_totalprice > 100000) AS high FROM orders""")
def conditional_audit(spark, d):
    return stats.audit(table(spark, d, "orders"), distinct=["o_custkey"], spans=["o_orderdate"], tests={"high": F.col("o_totalprice") > 100000})


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return stats.page(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderstatus = 'O') DESC, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END ASC NULLS FIRST, o_orderkey DESC) AS pos
FROM orders ORDER BY pos LIMIT 50""")
def multi_key_sort(spark, d):
    o = table(spark, d, "orders").withColumn("own", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))
    top = o.orderBy(F.desc(F.col("o_orderstatus") == "O"), F.asc_nulls_first("own"), F.desc("o_orderkey")).limit(50)
    ranked = top.withColumn("is_open", F.col("o_orderstatus") == "O")
    from pyspark.sql import Window

    return ranked.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("is_open"), F.asc_nulls_first("own"), F.desc("o_orderkey"))).alias("pos"))


@query("""WITH k AS (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3) SELECT l_partkey AS source_config_id, count(*) AS n
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM k) GROUP BY 1""")
def orphan_scan_anti(spark, d):
    known = table(spark, d, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("source_config_id"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_config_id"))
    return mt.orphans(rows, known).groupBy("source_config_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_nationkey, (c_nationkey % 5 = 0) AS is_delete FROM customer")
def soft_delete_mark(spark, d):
    known = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(None).cast("boolean").alias("is_delete"))
    return mt.mark_deleted(rows, known, "c_nationkey").select("c_custkey", "c_nationkey", "is_delete")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey % 5 <> 0")
def physical_purge(spark, d):
    return mt.purge(soft_delete_mark(spark, d)).drop("is_delete")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def bulk_delete(spark, d):
    return mt.delete_where(table(spark, d, "orders"), o_orderstatus=["F", "P"], o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def cascade_delete(spark, d):
    return mt.cascade(table(spark, d, "orders").where("o_orderstatus <> 'P'"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'CANCELLED' END AS status FROM orders")
def status_transition(spark, d):
    return mt.transition(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "CANCELLED", final=("F",))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS p_size,
CASE WHEN p_partkey % 2 = 0 THEN 'updated' WHEN p_partkey % 3 = 0 THEN 'unchanged' ELSE 'kept' END AS status FROM part
UNION ALL SELECT -p_partkey, p_size, 'inserted' FROM part WHERE p_partkey BETWEEN 1 AND 10""")
def upsert_counts(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    changed = part.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 1)
    same = part.where("p_partkey % 2 <> 0 and p_partkey % 3 = 0")
    new = part.where("p_partkey between 1 and 10").withColumn("p_partkey", -F.col("p_partkey"))
    return mt.upsert(part, changed.unionByName(same).unionByName(new), "p_partkey")


@query("""WITH n AS (SELECT DISTINCT lower(trim(p_brand)) AS name, p_type AS type FROM part)
SELECT type, name FROM n""")
def get_or_create_entities(spark, d):
    raw = table(spark, d, "part").select(F.col("p_type").alias("type"), F.lower(F.trim("p_brand")).alias("name"))
    known = raw.limit(0).withColumn("entity_id", F.lit("")).select("entity_id", "type", "name")
    return mt.get_or_create(known, raw, ["type", "name"], "entity_id").select("type", "name")


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey = 7")
def delete_by_source_dry_run(spark, d):
    return mt.delete_source(table(spark, d, "customer"), 7, dry_run=True, column="c_nationkey")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id ELSE 'c' || doc_id END AS source_id, doc_id FROM documents")
def column_backfill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "ARTICLE").otherwise("CHAT").alias("source_type"), F.concat(F.lit("a"), "doc_id").alias("article_id"), F.concat(F.lit("c"), "doc_id").alias("conversation_id"))
    return mt.backfill(rows).select("source_id", "doc_id")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0)
UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0""")
def replace_by_source(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = c.where("c_nationkey = 3 and c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0))
    return mt.replace_by(c, new, "c_nationkey").select("c_custkey", "c_acctbal")


@query("""SELECT t.type, coalesce(t.weight, 1.0) AS weight, p.p_partkey AS entity_id FROM part p JOIN
(VALUES ('Brand#11', 1.5), ('Brand#12', 0.5)) AS t(type, weight) ON p.p_brand = t.type
UNION ALL SELECT p_brand, 1.0, p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')""")
def type_defaults(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("type"))
    types = spark.createDataFrame([(1, "Brand#11", 1.5, 0.9), (2, "Brand#12", 0.5, 0.7), (3, "Brand#12", 9.0, 0.1)], "id int, type string, weight double, similarity_threshold double")
    return rel.with_type_defaults(part, types).select("type", F.col("type_weight").alias("weight"), "entity_id")

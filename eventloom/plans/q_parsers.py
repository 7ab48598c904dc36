"""Queries of text, time and value parsers, of associations and of merged events, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.functions import time as tm
from eventloom.functions import values as vl
from eventloom.operators import evaluation as ev
from eventloom.operators import maintenance as mt
from eventloom.plans.catalog import query, table

_W = r"[^\p{L}\p{N}\p{M}_\s]"


@query(rf"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || '  -  ' || p_brand)), '\s+', ' ', 'g'), '{_W}', '', 'g') AS name FROM part")
def entity_names_with_gaps(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.normalize_entity_name_keep_gaps(F.concat("p_name", F.lit("  -  "), "p_brand")).alias("name"))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split('# ' || source || chr(10) || '####### no' || chr(10) || '  ## ' || lang || chr(10) || coalesce(text, ''), chr(10)), lambda x: trim(x)),
lambda x: regexp_matches(x, '^#{1,6}\\s+.+$')), lambda x: regexp_replace(x, '^(#{1,6})\\s+(.+)$', '\\1 \\2')), '|') AS headings FROM documents""".replace("\\\\", "\\"))
def heading_lines(spark, d):
    text = F.concat(F.lit("# "), "source", F.lit("\n####### no\n  ## "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.markdown_headings(text), "|").alias("headings"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10))) AS h FROM documents""")
def cleaned_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean_whitespace(F.col("text"))).alias("h"))


@query("SELECT event_id, date_trunc('second', ts) AS utc, date_trunc('second', ts) - INTERVAL 2 HOUR AS east, NULL::TIMESTAMP AS bad FROM events")
def iso_times(spark, d):
    text = tm.iso_utc(F.col("ts"))
    at = lambda c: tm.parse_iso(c).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", at(F.concat(text, F.lit("Z"))).alias("utc"), at(F.concat(text, F.lit("+02:00"))).alias("east"), at(F.concat(F.lit("no "), text)).alias("bad"))


@query("""WITH s AS (SELECT event_id, epoch(TIMESTAMP '2024-02-01') - epoch_us(ts) / 1e6 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN floor(s / 60)::INT || '分钟前' WHEN s < 86400 THEN floor(s / 3600)::INT || '小时前' WHEN s < 2592000 THEN floor(s / 86400)::INT || '天前'
WHEN s < 31536000 THEN floor(floor(s / 86400) / 30)::INT || '个月前' ELSE floor(floor(s / 86400) / 365)::INT || '年前' END AS told FROM s""")
def relative_times(spark, d):
    return table(spark, d, "events").select("event_id", tm.time_ago(F.col("ts"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("told"))


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+') AS p FROM documents) SELECT doc_id, len(p)::INT AS parts, md5(array_to_string(p, '|')) AS h FROM p""")
def delimited_parts(spark, d):
    parts = table(spark, d, "documents").select("doc_id", tx.split_keeping(F.col("text")).alias("p"))
    return parts.select("doc_id", F.size("p").alias("parts"), F.md5(F.array_join("p", "|")).alias("h"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS cn, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS w FROM documents) SELECT doc_id, (cn + greatest(0, w - cn))::INT AS words FROM c""")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("int").alias("words"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '(^|\s)(a|an|the)(\s(a|an|the))*(\s|$)', '  ', 'g'), '\s+', ' ', 'g')) AS answer FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7f]', 'x', 'g') AS text FROM benchmark)""")
def normalized_answers(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.normalize_answer(F.regexp_replace("text", r"[^\x00-\x7f]", "x")).alias("answer"))


@query("SELECT event_id, 1 + event_id % 9999 AS n FROM events")
def chinese_numbers(spark, d):
    """Each event's number, spelled out and read again."""
    n = 1 + F.col("event_id") % 9999
    digits = F.split(F.lit("零 一 二 三 四 五 六 七 八 九"), " ")
    spelled = F.concat(*[F.when(digit > 0, F.concat(F.get(digits, digit.cast("int")), F.lit(power))).otherwise("") for power, digit in (("千", F.floor(n / 1000)), ("百", F.floor(n / 100) % 10), ("十", F.floor(n / 10) % 10), ("", n % 10))])
    return table(spark, d, "events").select("event_id", vl.chinese_number(spelled).alias("n"))


@query("SELECT event_id, 'int' AS type, user_id AS int_value, '订单' AS unit, CASE WHEN event_id % 2 = 0 THEN 0.95 END AS confidence FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM events WHERE event_id % 2 = 1")
def unit_values(spark, d):
    text = F.concat(F.col("user_id").cast("string"), F.lit("个订单"))
    v = table(spark, d, "events").select("event_id", vl.with_unit(text, F.when(F.col("event_id") % 2 == 0, "订单").otherwise("项目")).alias("v"))
    return v.select("event_id", "v.type", "v.int_value", "v.unit", "v.confidence")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('month', ts) END AS at, CASE event_id % 4 WHEN 2 THEN 0.9 WHEN 3 THEN NULL ELSE 0.95 END AS confidence FROM events""")
def compact_dates(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyyMMdd")).when(k == 1, F.date_format("ts", "yyyyMMddHHmmss")).when(k == 2, F.date_format("ts", "yyyyMM")).otherwise(F.lit("20231332"))
    v = table(spark, d, "events").select("event_id", vl.compact_date_time(text).alias("v"))
    return v.select("event_id", F.col("v.datetime_value").alias("at"), "v.confidence")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS value FROM events")
def truth_values(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("是", "禁用", "Yes", "FALSE", "perhaps"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", vl.boolean(word)["bool_value"].alias("value"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'UNKNOWN' END AS value, CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN 0.8 ELSE 0.0 END AS confidence FROM events""")
def enum_values(spark, d):
    told = F.when(F.col("event_type") == "view", "a View of it").when(F.col("event_type") == "click", "click").otherwise(F.concat(F.lit("~"), F.col("event_type")))
    v = table(spark, d, "events").select("event_id", vl.enum(told, F.array(F.lit("click"), F.lit("view"))).alias("v"))
    return v.select("event_id", F.col("v.enum_value").alias("value"), "v.confidence")


@query("""WITH e AS (SELECT l_orderkey AS event_id, l_linenumber AS pos, l_returnflag AS type, p_name AS name, l_linestatus AS description FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id, type, lower(name), description ORDER BY pos) AS nth FROM e)
SELECT event_id, type, arg_min(name, pos) AS name, CASE type WHEN 'A' THEN 0.5 WHEN 'N' THEN 2.0 ELSE 1.0 END AS weight, string_agg(description, '、' ORDER BY pos, description) FILTER (nth = 1) AS description FROM f GROUP BY event_id, type, lower(name)""")
def event_associations(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entity = F.struct("l_linenumber", F.col("l_returnflag").alias("type"), F.col("p_name").alias("name"), F.col("l_linestatus").alias("description"))
    events = rows.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(entity)), lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"), x["description"].alias("description"))).alias("entities"))
    return mt.associations(events, spark.createDataFrame([("A", 0.5), ("N", 2.0)], "type string, weight double"))


@query("""WITH n AS (SELECT o_orderkey AS head, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders),
g AS (SELECT DISTINCT head, unnest([head, next]) AS event_id FROM n), m AS (SELECT head, event_id, o_orderpriority AS content, o_orderstatus AS e FROM g JOIN orders ON o_orderkey = event_id),
w AS (SELECT head, event_id, row_number() OVER (PARTITION BY head ORDER BY length(content) DESC, event_id) AS nth FROM m),
a AS (SELECT head, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS members, array_to_string(list_sort(list_distinct(list(e))), ',') AS entities FROM m GROUP BY 1)
SELECT w.event_id, members, entities FROM w JOIN a USING (head) WHERE nth = 1""")
def merged_events(spark, d):
    """Each order and the customer's next one, named as its duplicate, made one."""
    orders = table(spark, d, "orders")
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("content"), F.array("o_orderstatus").alias("entities"))
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    named = orders.select(F.col("o_orderkey").alias("event_id"), F.array_compact(F.array(nxt)).alias("duplicate_with"))
    out = ev.merge_duplicate_events(events, named)
    return out.select("event_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join("entities", ",").alias("entities"))

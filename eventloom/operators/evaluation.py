"""Retrieval and answer metrics, and duplicate handling of chunks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx


def recall_at(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(question_id, recall): gold items among the first k; 0 where a question has none. retrieved: rank from 1."""
    top = retrieved.where(F.col("rank") <= k).select("question_id", "item_id").distinct()
    wanted = gold.select("question_id", "item_id").distinct()
    hit = wanted.join(top.withColumn("hit", F.lit(1)), ["question_id", "item_id"], "left")
    per = hit.groupBy("question_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return retrieved.select("question_id").distinct().join(per, "question_id", "left").na.fill(0.0, ["recall"])


def pooled(scores: DataFrame, score: str) -> DataFrame:
    return scores.agg(F.round(F.avg(score), 4).alias(score))


def exact_match(answers: DataFrame, how: str = "max") -> DataFrame:
    """(question_id, em) of rows (question_id, answer, gold), over a question's golds by max or mean."""
    hit = (tx.normalize_answer(F.col("answer")) == tx.normalize_answer(F.col("gold"))).cast("double")
    return answers.groupBy("question_id").agg((F.max if how == "max" else F.avg)(hit).alias("em"))


def token_f1(answers: DataFrame, how: str = "max") -> DataFrame:
    """(question_id, f1): overlap of the two bags of words, within the row."""
    words = lambda c: F.filter(F.split(tx.normalize_answer(F.col(c)), " "), lambda x: x != "")
    a, g = F.col("a"), F.col("g")
    times = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    same = F.aggregate(F.array_intersect(a, g), F.lit(0), lambda n, w: n + F.least(times(a, w), times(g, w)))
    rows = answers.select("question_id", words("answer").alias("a"), words("gold").alias("g")).withColumn("same", same)
    f1 = F.when(F.col("same") == 0, 0.0).otherwise(2.0 * F.col("same") / (F.size("a") + F.size("g")))
    return rows.groupBy("question_id").agg((F.max if how == "max" else F.avg)(f1).alias("f1"))


def buckets(counts: DataFrame, matched: str = "matched", gold: str = "gold") -> DataFrame:
    """One row: questions found in full, in part, not at all, and the micro and macro recall."""
    m, g = F.col(matched), F.col(gold)
    return counts.agg(
        F.count_if(m >= g).alias("complete"), F.count_if((m > 0) & (m < g)).alias("partial"), F.count_if((m == 0) & (g > 0)).alias("zero"),
        F.round(F.sum(m) / F.sum(g), 4).alias("micro"), F.round(F.avg(m / g), 4).alias("macro"),
    )


def recalled_histogram(counts: DataFrame, matched: str = "matched") -> DataFrame:
    return counts.groupBy(F.col(matched).alias("recalled")).agg(F.count(F.lit(1)).alias("questions"))


def sufficiency(n) -> F.Column:
    """(enough, confidence) for a number of found events."""
    # Confidences of no, one, few and five or more events.
    return F.struct((n > 0).alias("enough"), F.when(n == 0, 0.0).when(n == 1, 0.4).when(n < 5, 0.65).otherwise(0.85).alias("confidence"))


def text_match(oracle: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, oracle_id, how): equal titles, else the oracle's title within the other's, else equal text beginnings.

    Both sides belong to the same question. Only the distinct titles of a question meet each other; equal text beginnings
    are an equi join with distinct ones, so repeated titles and texts multiply nothing. The best test counts.
    """
    o = oracle.select("question_id", "oracle_id", F.lower(F.trim("title")).alias("ot"), F.substring("text", 1, 150).alias("ox"))
    r = retrieved.select("question_id", F.lower(F.trim("title")).alias("rt"), F.substring("text", 1, 150).alias("rx"))
    asked, titles = o.select("question_id", "ot").distinct(), r.select("question_id", "rt").distinct()
    by_title = asked.join(titles, "question_id").where(F.col("rt").contains(F.col("ot"))).groupBy("question_id", "ot").agg(F.min(F.when(F.col("ot") == F.col("rt"), 1).otherwise(2)).alias("by_title"))
    by_text = r.select("question_id", F.col("rx").alias("ox")).distinct().withColumn("by_text", F.lit(3))
    found = o.join(by_title, ["question_id", "ot"], "left").join(by_text, ["question_id", "ox"], "left")
    return found.withColumn("how", F.coalesce("by_title", "by_text")).where("how is not null").groupBy("question_id", "oracle_id").agg(F.min("how").alias("how"))


def dedup_chunks(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(purified, merged_id, n): chunks of one purified text, their ids sorted and joined."""
    rows = chunks.select(F.md5(tx.purify(F.col(text))).alias("purified"), F.col(key).cast("string").alias("id"))
    return rows.groupBy("purified").agg(F.array_join(F.array_sort(F.collect_set("id")), "//").alias("merged_id"), F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each lower-cased, trimmed value."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(F.lower(F.trim(by))).orderBy(order))).where("nth = 1").drop("nth")


def merge_duplicate_events(events: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(event_id, members, entities): an event and those it names as duplicates become the one with the longest content.

    duplicates: (event_id, duplicate_with); groups are taken as named, not followed further. entities are united without
    regard to case, the first spelling stays.
    """
    pairs = duplicates.select(F.col("event_id").alias("head"), F.explode("duplicate_with").alias("event_id"))
    heads = duplicates.select(F.col("event_id").alias("head"), "event_id")
    groups = heads.unionByName(pairs).distinct().join(events, "event_id")
    merged = groups.groupBy("head").agg(F.max_by("event_id", F.struct(F.length("content"), -F.col("event_id"))).alias("event_id"), F.array_sort(F.collect_list("event_id")).alias("members"), F.array_sort(F.flatten(F.collect_list("entities"))).alias("all"))
    first = F.filter("all", lambda x, i: ~F.exists(F.slice(F.col("all"), 1, i), lambda y: F.lower(y) == F.lower(x)))
    return merged.select("event_id", "members", first.alias("entities"))


def token_accounting(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage").agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.count(F.lit(1)).alias("calls"))


def metric_means(scores: DataFrame, *metrics: str) -> DataFrame:
    return scores.agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])


def gold_documents(samples: DataFrame, joiner: str = " ") -> DataFrame:
    """(id, title, text) of supporting paragraphs, flat (paragraphs) or named by supporting_facts over a context."""
    if "paragraphs" in samples.columns:
        return samples.select("id", F.inline(F.filter("paragraphs", lambda p: p["is_supporting"]))).select("id", "title", "text")
    each = samples.select("id", F.explode("context").alias("c"), F.transform("supporting_facts", lambda f: f["title"]).alias("titles"))
    return each.where(F.array_contains("titles", F.col("c.title"))).select("id", "c.title", F.array_join("c.sentences", joiner).alias("text"))


def supporting_sentences(samples: DataFrame) -> DataFrame:
    """(id, title, sent_id, sentence); facts that point nowhere are left out."""
    facts = samples.select("id", "context", F.posexplode("supporting_facts").alias("pos", "f"))
    doc = F.get(F.filter("context", lambda c: c["title"] == F.col("f.title")), 0)
    return facts.select("id", F.col("f.title").alias("title"), F.col("f.sent_id").alias("sent_id"), F.get(doc["sentences"], F.col("f.sent_id")).alias("sentence")).where("sentence is not null")


def corpus_of(samples: DataFrame) -> DataFrame:
    """(chunk_id, text): '# title' and the sentences of each context paragraph, numbered within its sample."""
    each = samples.select("id", F.posexplode("context").alias("pos", "c"))
    return each.select(F.format_string("%s-%02d", "id", "pos").alias("chunk_id"), F.concat(F.lit("# "), F.col("c.title"), F.lit("\n"), F.array_join("c.sentences", " ")).alias("text"))

"""Chunks of documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import relational as rel
from eventloom.operators.lineage import materialize

#: Chunks whose places are sent to all tasks; beyond it the join shuffles.
SEND_CHUNKS = 1 << 17


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, heading, level, content, char_count, word_count): Markdown sections.

    A section is a heading and what follows; headings without content of their own go before the next section's, and
    the section's heading is that of the lowest level among them. Text before the first heading has none.
    """
    is_heading = lambda x: x.rlike(r"^\s*#{1,6}\s+.+$")
    line = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    filled = (F.trim("line") != "") & ~is_heading(F.col("line"))
    marked = line.withColumn("h", is_heading(F.col("line"))).withColumn("after", F.lag(filled | F.lit(False)).over(order))
    # the last line with words before this one: a heading right after another belongs to the same section
    words = F.last(F.when(F.trim("line") != "", F.when(F.col("h"), "h").otherwise("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = marked.withColumn("start", (F.col("h") & F.coalesce(words != "h", F.lit(True))).cast("int"))
    part = starts.withColumn("part", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = part.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "h"))).alias("l"))
    heads = F.transform(F.filter("l", lambda x: x["h"]), lambda x: F.struct(F.length(F.regexp_extract(x["line"], r"^\s*(#{1,6})", 1)).alias("level"), x["pos"].alias("pos"), F.regexp_extract(x["line"], r"^\s*#{1,6}\s+(.+)$", 1).alias("title")))
    content = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    out = got.select(key, "part", F.array_min(heads).alias("head"), F.regexp_replace(content, r"^\s+|\s+$", "").alias("content")).where("content <> ''")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return out.select(key, rank.alias("rank"), F.col("head.title").alias("heading"), F.col("head.level").alias("level"), "content", F.length("content").alias("char_count"), tx.word_count(F.col("content")).alias("word_count"))


def pack(items: Column, size: Column | str, most: int) -> Column:
    """Batches of an array of structs: a new one begins when an item would go over most and the batch isn't empty.

    A batch is (items, total). Greedy, in the order of the array; an item over most is a batch of its own.
    """
    name = size if isinstance(size, str) else None
    kind = "struct<items:array<int>,total:long>"

    def add(acc: Column, i: Column) -> Column:
        n = F.get(items, i)[name].cast("long")
        full = (acc["total"] + n > most) & (F.size(acc["now"]) > 0)
        close = F.struct(acc["now"].alias("items"), acc["total"].alias("total"))
        return F.struct(
            F.when(full, F.array_append(acc["done"], close)).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(i)).otherwise(F.array_append(acc["now"], i)).alias("now"),
            F.when(full, n).otherwise(acc["total"] + n).alias("total"),
        )

    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast("array<int>").alias("now"), F.lit(0).cast("long").alias("total"))
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, add, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["done"], F.struct(a["now"].alias("items"), a["total"].alias("total")))).otherwise(a["done"]))


def merge_short(items: Column, length: str, size: str, least: int = 100, most: int = 8000) -> Column:
    """(first, last) places of merged neighbours: a chunk shorter than least takes the next one if both fit into most."""
    n = F.size(items)
    at = lambda i, f: F.get(items, i)[f]

    def add(acc: Column, i: Column) -> Column:
        skip = acc["skip"]
        joins = (at(i, length) < least) & (i + 1 < n) & (at(i, size) + F.coalesce(at(i + 1, size), F.lit(0)) <= most)
        return F.when(skip, F.struct(acc["out"].alias("out"), F.lit(False).alias("skip"))).otherwise(
            F.struct(F.array_append(acc["out"], F.struct(i.alias("first"), F.when(joins, i + 1).otherwise(i).alias("last"))).alias("out"), F.coalesce(joins, F.lit(False)).alias("skip"))
        )

    zero = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("out"), F.lit(False).alias("skip"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, add, lambda a: a["out"])


def sentence_sections(chunks: DataFrame, article: str = "article_id", chunk: str = "chunk_id", rank: str = "rank", content: str = "content") -> DataFrame:
    """(article, chunk, rank, content): sentences of all chunks, their rank running on over an article's chunks.

    Chunks are numbered by how many sentences they have, and each chunk's own follow where it begins: texts are shuffled
    once at most, and no task holds all of a long article's. Only where rows repeat article, rank and chunk, so that
    their sentences are ranked among each other, all sentences are numbered.
    """
    cut = tx.sentences(F.col(content))
    sizes = materialize(chunks.select(article, F.col(rank).alias("r"), chunk, F.size(cut).cast("long").alias("n")).where("n > 0"))
    if not sizes.groupBy(article, "r", chunk).count().where("count > 1").isEmpty():
        each = chunks.select(article, chunk, F.col(rank).alias("r"), F.posexplode(cut).alias("pos", "content"))
        placed = rel.numbered(each, ["r", chunk, "pos"], "place", [article])
        return placed.select(article, chunk, (F.col("place") - 1).cast("long").alias("rank"), "content")
    count = sizes.count()
    ends = rel.numbered(sizes, ["r", chunk], "end", [article], count, size="n")
    starts = ends.select(F.col(article).alias("of_article"), F.col("r").alias("of_r"), F.col(chunk).alias("of_chunk"), (F.col("end") - F.col("n")).alias("start"))
    starts = F.broadcast(starts) if count <= SEND_CHUNKS else starts
    same = F.col(article).eqNullSafe(F.col("of_article")) & F.col(rank).eqNullSafe(F.col("of_r")) & F.col(chunk).eqNullSafe(F.col("of_chunk"))
    rows = chunks.join(starts, same).select(article, chunk, "start", F.posexplode(cut).alias("pos", "content"))
    return rows.select(article, chunk, (F.col("start") + F.col("pos")).alias("rank"), "content")


def windows(messages: DataFrame, ts: str = "ts", minutes: int = 60, by: tuple[str, ...] = ("conversation_id",), start=None, end=None, inclusive: bool = True) -> DataFrame:
    """(by, window_start, window_end, n, first_ts, last_ts): tumbling windows from start, which defaults to the first
    message; the last one ends at end. inclusive keeps a message at the very end, which half-open windows lose."""
    rows = messages.where(F.col(ts).isNotNull())
    span = Window.partitionBy(*by)
    secs = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = rows.withColumn("s", F.lit(start).cast("timestamp_ntz") if start is not None else F.min(ts).over(span)).withColumn("e", F.lit(end).cast("timestamp_ntz") if end is not None else F.max(ts).over(span))
    rows = rows.where((F.col(ts) >= F.col("s")) & ((F.col(ts) <= F.col("e")) if inclusive else (F.col(ts) < F.col("e"))))
    width = minutes * 60
    k = F.floor((secs(F.col(ts)) - secs(F.col("s"))) / width)
    last = F.greatest(F.ceil((secs(F.col("e")) - secs(F.col("s"))) / width) - 1, F.lit(0))
    rows = rows.withColumn("k", F.least(k, last))
    grouped = rows.groupBy(*by, "s", "e", "k").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    shift = lambda x: F.timestamp_seconds(secs(F.col("s")) + x * width).cast("timestamp_ntz")
    return grouped.select(*by, shift(F.col("k")).alias("window_start"), F.least(shift(F.col("k") + 1), F.greatest(F.col("e"), shift(F.col("k")))).alias("window_end"), "n", "first_ts", "last_ts")


def format_message(name: Column, role: Column, ts: Column, content: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit("["), F.coalesce(role, F.lit("")), F.lit("]("), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("):\n"), content, F.lit("\n"))


def split_long(text: Column, most: int, prefix: str = "[Continued] ") -> Column:
    """Parts of up to most characters, all but the first with a prefix."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / most) - 1, F.lit(0)).cast("int")), lambda i: F.substring(text, i * most + 1, F.lit(most)))
    return F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(prefix), x)))


def _forced(text: Column, most: int, model: str) -> Column:
    """Pieces of as many characters as most estimated tokens hold, at least one; a word counts where it begins."""
    cn_factor, latin_factor = tx.TOKEN_FACTORS[model]

    def add(acc: Column, c: Column) -> Column:
        letter = c.rlike("^[a-zA-Z]$")
        cn, sign = c.rlike("^[一-鿿]$").cast("int"), c.rlike(r"(?U)^[^\w\s]$").cast("int")
        word = letter & ~acc["letter"]
        total = F.floor((acc["cn"] + cn) * cn_factor) + F.floor((acc["words"] + word.cast("int")) * latin_factor) + F.floor((acc["signs"] + sign) * 0.5)
        full = (total > most) & (acc["now"] != "")
        fresh = lambda n, more: F.when(full, n).otherwise(more + n)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(full, c).otherwise(F.concat(acc["now"], c)).alias("now"),
            fresh(cn, acc["cn"]).alias("cn"),
            F.when(full, letter.cast("int")).otherwise(acc["words"] + word.cast("int")).alias("words"),
            fresh(sign, acc["signs"]).alias("signs"),
            letter.alias("letter"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), *[F.lit(0).alias(c) for c in ("cn", "words", "signs")], F.lit(False).alias("letter"))
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), zero, add, lambda a: F.array_append(a["done"], a["now"]))


def split_sentence(text: Column, most: int, model: str = "generic") -> Column:
    """Parts of a long sentence of up to most estimated tokens: cut after commas, spaces and tabs and packed again in
    order; what is still too long is cut between characters. Parts are trimmed, blank ones left out; no parts for null."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s*(?:[，,、]|[^\s，,、][^，,、 \t]*(?:[，,、 \t]|$))"), F.lit(0))
    sized = F.transform(pieces, lambda x: F.struct(x.alias("piece"), tx.chunk_tokens(x, model).cast("long").alias("tokens")))
    packed = F.transform(pack(sized, "tokens", most), lambda b: F.struct(F.array_join(F.transform(b["items"], lambda i: F.get(pieces, i)), "").alias("text"), b["total"].alias("total")))
    parts = F.flatten(F.transform(packed, lambda b: F.when(b["total"] > most, _forced(b["text"], most, model)).otherwise(F.array(b["text"]))))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def resolve_references(ids: Column, references: Column) -> Column:
    """1-based places, given by a model, to ids; places that aren't whole numbers within the list are dropped."""
    numbers = F.transform(references, lambda r: r.try_cast("int"))
    return F.transform(F.filter(numbers, lambda i: i.between(1, F.size(ids))), lambda i: F.get(ids, i - 1))


def participants(messages: DataFrame, by: str = "conversation_id", sender: str = "sender_name", ts: str = "ts") -> DataFrame:
    """(by, participants, span): distinct senders in the order in which they are first seen, and HH:mm of the ends."""
    first = messages.groupBy(by, sender).agg(F.min(ts).alias("t"), F.max(ts).alias("u"))
    clock = lambda c: F.date_format(c, "HH:mm")
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", sender))), lambda x: x[sender]), "、").alias("participants"), F.concat(clock(F.min("t")), F.lit("-"), clock(F.max("u"))).alias("span"))

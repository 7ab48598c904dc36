"""Phrase collocations by prefix-free parsing.

A text's pieces are cut where the two words at a place hash to a trigger, so equal passages are cut alike wherever they
stand. A chunk owns the words from one trigger to the next and carries the four words after them, so each phrase of up
to five words lies whole in the one chunk that owns its first word, and overlaps are counted once. The distinct chunks
with their frequencies are the dictionary; phrases are counted in it, weighted. A phrase can be frequent only if both
phrases one word shorter in it are, so lengths are searched one by one, by hashes: these can only count too many. What
is left is then counted once more by its words, exactly. Hashes are looked up in a filter of bits of bounded size, whose
false hits cost counting only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import discard, materialize, quoted

LONGEST = 5
#: One place in so many is a trigger; a chunk owns no more than MOST_OWN words.
TRIGGER, MOST_OWN = 24, 1024
#: Bits of the filter: for each frequent phrase, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bytes of texts or chunks that a task works on at a time.
AT_A_TIME = 12 << 20

#: Lower case for A-Z, and a full stop, which is in no word, for every mark that ends a piece.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P2
    return h ^ (h >> np.uint64(29))


def _some(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Rows of the batches, so many that a column's bytes come to AT_A_TIME or so; a row is never split."""
    held, size = [], 0
    for batch in batches:
        at = batch.column(column).offset
        ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[at : at + batch.num_rows + 1] if batch.num_rows else [0]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + AT_A_TIME - size, "right")) - 1)
            high = min(high, batch.num_rows)
            held.append(batch.slice(low, high - low))
            size += int(ends[high] - ends[low])
            low = high
            if size >= AT_A_TIME or low < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, k: int) -> pa.Array:
    chunks = table.column(k).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def chunks_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of each language, the words a chunk owns and its occurrences. Words
    are parted by a space."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _some(batches, 1):
            texts = [t.encode().translate(_FOLD) for t in _column(table, 1).to_pylist()]
            pieces = np.cumsum([t.count(b".") + 1 for t in texts])  # that end with each text
            words = b".".join([*texts, b""]).replace(b".", b" . ").split()
            joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
            to = np.cumsum(sizes + 1) - 1
            first, last = (np.frombuffer(joined, np.uint8)[x].astype(np.uint64) for x in (to - sizes, to - 1))
            is_end = (sizes == 1) & (first == ord("."))
            look = (first << np.uint64(8) | last) * _P1 + sizes.astype(np.uint64)
            trigger = _mix(look * _P1 + np.append(look[1:], np.uint64(0))) % np.uint64(TRIGGER) == 0
            begin = np.flatnonzero(~is_end & (np.append(True, is_end[:-1]) | trigger))
            if not len(begin):
                continue
            ends = np.flatnonzero(is_end)
            piece = np.searchsorted(ends, begin)
            stop = ends[piece]
            until = np.minimum(np.append(begin[1:], len(words)), stop)
            parts = -(-(until - begin) // MOST_OWN)
            if parts.max() > 1:  # places a long chunk is cut at are content, too: words from its trigger
                nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                begin, until, stop, piece = (np.repeat(x, parts) for x in (begin, until, stop, piece))
                begin = begin + nth * MOST_OWN
                until = np.minimum(until, begin + MOST_OWN)
            close = np.minimum(until + LONGEST - 1, stop)
            low, high = (to - sizes)[begin].tolist(), to[close - 1].tolist()
            found = pa.array([joined[a:b] for a, b in zip(low, high, strict=True)], pa.binary()).cast(pa.string())
            row = np.searchsorted(pieces, piece, "right")
            yield pa.RecordBatch.from_arrays([_column(table, 0).take(pa.array(row)), found, pa.array((until - begin).astype(np.int32)), pa.array(np.ones(len(begin), np.int64))], ["lang", "chunk", "own", "n"])

    rows = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")), F.coalesce(F.col(quoted(text)), F.lit(""))).toDF("lang", "t")
    return rows.mapInArrow(parse, "lang string, chunk string, own int, n long").groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


class Block:
    """Some chunks' words as numbers, and the places that they own."""

    def __init__(self, table: pa.Table):
        lists = pc.split_pattern(_column(table, 1), " ")
        words, langs = lists.flatten().dictionary_encode(), _column(table, 0).dictionary_encode()
        self.words, self.langs = words.dictionary.to_pylist(), langs.dictionary.to_pylist()
        self.numbers = words.indices.to_numpy().astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.hashes = hashes[self.numbers]
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        own, n = _column(table, 2).to_numpy().astype(np.int64), _column(table, 3).to_numpy()
        self.at = np.repeat(ends[:-1] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        self.left = np.repeat(ends[1:], own) - self.at  # words from a place to its chunk's end
        self.n = np.repeat(n, own)
        self.lang = np.repeat(langs.indices.to_numpy().astype(np.int64), own)
        self.by = np.fromiter((xxhash.xxh3_64_intdigest(x, seed=1) for x in self.langs), np.uint64, len(self.langs))

    def phrases(self, length: int, places: np.ndarray, skip: int = 0) -> np.ndarray:
        """Hashes of the phrases of a length that begin `skip` words after some places."""
        h = self.by[self.lang[places]]
        for d in range(skip, skip + length):
            h = h * _P1 + self.hashes[self.at[places] + d]
        return _mix(h)


def filter_of(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes in frequent (h), as bytes; sized by their number up to MOST_BITS, so that neither the driver
    nor a task holds more. Where it is full it lets too many pass, and counting takes longer."""
    count, bits = frequent.count(), 1 << 15
    while bits < min(BITS_EACH * count, MOST_BITS):
        bits *= 2
    # Spark's bitmaps hold 32768 bits each and count from 1
    at = F.explode(F.array(F.col("h").bitwiseAND(bits - 1) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1) + 1)).alias("at")
    marked = frequent.select(at).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in marked.toLocalIterator():
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = np.uint64(len(bitmap) * 8 - 1)
    bit = lambda at: (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(h & low) & bit((h >> np.uint64(32)) & low)).astype(bool)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct key, sum of n over it)."""
    order = np.argsort(keys, kind="stable")
    opens = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else order
    return order[opens], np.add.reduceat(n[order], opens) if len(opens) else n


def count_hashes(chunks: DataFrame, length: int, shorter: np.ndarray | None) -> DataFrame:
    """(h, f): occurrences by hash of the phrases of a length both of whose parts one word shorter are in the filter
    shorter; of all words for length 1."""
    sent = chunks.sparkSession.sparkContext.broadcast(shorter) if shorter is not None else None  # MOST_BITS / 8 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _some(batches, 1):
            block = Block(table)
            places = np.flatnonzero(block.left >= length)
            for skip in (0, 1) if sent is not None else ():
                places = places[_has(sent.value, block.phrases(length - 1, places, skip))]
            h = block.phrases(length, places)
            one, f = _sums(h, block.n[places])
            yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(f)], ["h", "f"])

    return chunks.select("lang", "chunk", "own", "n").mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def count_phrases(chunks: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(lang, phrase, words, f): exact occurrences of the phrases of one to five words whose hash is in the filter."""
    sent = chunks.sparkSession.sparkContext.broadcast(wanted)  # MOST_BITS / 8 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _some(batches, 1):
            block = Block(table)
            places = np.arange(len(block.at))
            for length in range(1, LONGEST + 1):
                # a phrase that begins at a place is frequent only if its beginning is
                places = places[block.left[places] >= length]
                places = places[_has(sent.value, block.phrases(length, places))]
                at = block.at[places]
                key = block.lang[places] * len(block.words) + block.numbers[at]
                for d in range(1, length):
                    _, key = np.unique(key * len(block.words) + block.numbers[at + d], return_inverse=True)
                one, f = _sums(key, block.n[places])
                words = [block.numbers[at[one] + d].tolist() for d in range(length)]
                phrases = [" ".join([block.words[k] for k in p]) for p in zip(*words, strict=True)]
                langs = pa.array(block.langs, pa.string()).take(pa.array(block.lang[places][one]))
                yield pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.string()), pa.array(np.full(len(one), length, np.int32)), pa.array(f)], ["lang", "phrase", "words", "f"])

    found = chunks.select("lang", "chunk", "own", "n").mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of one to five words that occurs at least `least` times, (lang, n) with
    each language's word occurrences)."""
    chunks = materialize(chunks_of(docs, text, lang))
    totals = materialize(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")))
    levels, bitmap = [], None
    for length in range(1, LONGEST + 1):
        found = count_hashes(chunks, length, bitmap).where(F.col("f") >= least)
        levels.append(materialize(found.select("h")))
        bitmap = filter_of(levels[-1])
    hashes = levels[0]
    for more in levels[1:]:
        hashes = hashes.unionByName(more)
    out = materialize(count_phrases(chunks, filter_of(hashes)).where(F.col("f") >= least))
    discard(chunks, *levels)
    return out, totals


def _cut(phrase: Column, k: Column, words: Column) -> tuple[Column, Column]:
    parts = F.split(phrase, " ", -1)
    return F.concat_ws(" ", F.slice(parts, F.lit(1), k)), F.concat_ws(" ", F.slice(parts, k + 1, words - k))


def score(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of each phrase of two words or more: that of its lowest cut."""
    parts = frequent.select("lang", F.col("phrase").alias("part"), "f")
    cuts = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = _cut(F.col("phrase"), F.col("k"), F.col("words"))
    cuts = cuts.withColumns({"left": left, "right": right})
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # decimals of 38 digits; div takes the whole part of an exact quotient
    cuts = cuts.join(totals, "lang").withColumns({"above": wide("a") * wide("n"), "below": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("cast((cast(1000 as decimal(4,0)) * cast(above as decimal(34,0))) div below as long)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "words")).alias("x"))
    return best.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.n", "x.score")


def without_contained(scored: DataFrame) -> DataFrame:
    """scored without the phrases that lie in a longer one that is as frequent. As frequent as a phrase can be only one
    that adds a word to it, or one within which such a one lies, so longer ones by one word are enough."""
    parts, last = F.split("phrase", " ", -1), F.col("words") - 1
    inner = scored.where("words > 2").select("lang", F.explode(F.array(F.concat_ws(" ", F.slice(parts, F.lit(1), last)), F.concat_ws(" ", F.slice(parts, F.lit(2), last)))).alias("phrase"), F.col("a").alias("most"))
    most = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return scored.join(most, ["lang", "phrase"], "left").where("most is null or most < a").drop("most")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, frequency and phrase.

    A null language counts as `und`, with those that say so; null and empty texts have no words; repeated rows count
    each; extra columns are not looked at; ties after all go by the phrase's UTF-8 bytes; an empty table gives no rows.
    Each language's first rows are found in parts of it before they are ranked, so that no task sorts a whole language.
    """
    frequent, totals = frequent_phrases(docs, least, text, lang)
    kept = without_contained(materialize(score(frequent, totals)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parted = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

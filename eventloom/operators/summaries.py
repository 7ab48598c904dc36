"""Extractive summaries: TextRank over a document's sentences, Luhn's clusters of significant words for long ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from eventloom.functions import text as T

# Sentences up to which TextRank is used, its damping and the change at which it stops, the words without
# significance that end a cluster.
MOST_RANKED, DAMPING, SETTLED, GAP = 1000, 0.85, 1e-4, 4
#: Columns of the table of words that a task holds at once.
AT_ONCE = 2048

_SENTENCE = re.compile(r"[^.!?。！？；\n]+[.!?。！？；]*")
_WORD = re.compile(r"[一-鿿]|(?:(?![一-鿿])\w)+")
_BLANK = "".join(map(chr, range(33)))


def split_sentences(text: str) -> list[str]:
    """Sentences with their marks, ends trimmed; lines end one, too."""
    return [s for s in (x.strip(_BLANK) for x in _SENTENCE.findall(text)) if s]


def textrank(sentences: Sequence[Sequence[str]]) -> np.ndarray:
    """The rank of each sentence, given as words: the stationary share of a walk along edges weighted by the words that
    two sentences have in common over the sum of the logarithms of their lengths."""
    n = len(sentences)
    column: dict[str, int] = {}
    at = [(i, column.setdefault(w, len(column)), k) for i, words in enumerate(sentences) for w, k in Counter(words).items()]
    rows, columns, counts = (np.array(x) for x in zip(*at, strict=True)) if at else (np.zeros(0, int),) * 3
    common = np.zeros((n, n))
    for low in range(0, len(column), AT_ONCE):
        some = (columns >= low) & (columns < low + AT_ONCE)
        table = np.zeros((n, min(AT_ONCE, len(column) - low)))
        table[rows[some], columns[some] - low] = counts[some]
        common += table @ table.T
    logs = np.log(np.maximum([len(s) for s in sentences], 1))
    lengths = logs[:, None] + logs[None, :]
    weights = common / np.where(lengths > 0, lengths, 1.0)
    weights /= weights.sum(axis=1, keepdims=True) + 1e-16
    share, moved = np.full(n, 1 / max(n, 1)), 1.0
    while moved > SETTLED:
        new = (1 - DAMPING) / n * share.sum() + DAMPING * (share @ weights)
        share, moved = new, float(np.sqrt(((new - share) ** 2).sum()))
    return share


def luhn(sentences: Sequence[Sequence[str]]) -> np.ndarray:
    """Each sentence's best cluster: the square of its significant words over its length. Significant are words that
    the document has twice or more; one alone is worth nothing."""
    count = Counter(w for s in sentences for w in s)
    out = np.zeros(len(sentences))
    for k, words in enumerate(sentences):
        places = np.array([i for i, w in enumerate(words) if count[w] > 1])
        if len(places):
            ends = np.flatnonzero(np.append(np.diff(places) > GAP, True))
            firsts = np.append(0, ends[:-1] + 1)
            sizes, spans = ends - firsts + 1, places[ends] - places[firsts] + 1
            out[k] = np.where(sizes > 1, sizes**2 / spans, 0.0).max()
    return out


def best(text: str, count: int, most_ranked: int = MOST_RANKED) -> tuple[list[int], list[str], int, str]:
    """(positions from 0, sentences, number of all sentences, method): the count best, in the text's order; of equal
    scores, which count as equal up to ten decimals, the earlier."""
    found = split_sentences(text)
    words = [_WORD.findall(s.lower()) for s in found]
    method = "textrank" if len(found) <= most_ranked else "luhn"
    if not found or count <= 0:
        return [], [], len(found), method
    scores = np.round(textrank(words) if method == "textrank" else luhn(words), 10)
    picked = sorted(np.argsort(-scores, kind="stable")[:count].tolist())
    return picked, [found[k] for k in picked], len(found), method


def summaries(docs: DataFrame, key: str, text: str = "text", count: int | None = None, ratio: float = 0.3, most_ranked: int = MOST_RANKED) -> DataFrame:
    """(key, n_sentences, method, positions, sentences) of each document.

    Without a count, the text's estimated tokens and sentences decide how many sentences are taken, and a short text is
    taken as it is: its method is `whole` and it is the one sentence given. A null or empty text has no sentences.
    Memory grows with a document's sentences: up to most_ranked squared for TextRank, in proportion beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, tokens = batch.columns
            rows = []
            for t, n in zip(texts.to_pylist(), tokens.to_pylist(), strict=True):
                want = count
                if want is None:
                    n_sentences = len(split_sentences(t))
                    want = T.summary_sentences(n, n_sentences, ratio)
                    if not want:
                        rows.append(([0] if t else [], [t] if t else [], n_sentences, "whole"))
                        continue
                rows.append(best(t, want, most_ranked))
            positions, sentences, n, methods = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int32()), pa.array(methods, pa.string()), pa.array(positions, pa.list_(pa.int32())), pa.array(sentences, pa.list_(pa.string()))],
                [key, "n_sentences", "method", "positions", "sentences"],
            )

    own = docs.schema[key]
    schema = StructType([own]).add("n_sentences", IntegerType()).add("method", StringType()).add("positions", ArrayType(IntegerType())).add("sentences", ArrayType(StringType()))
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("k"), t.alias("t"), T.chunk_tokens(t).cast("long").alias("n")).mapInArrow(run, schema)

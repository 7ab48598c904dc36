"""Summaries against plain loops."""

import math
import re
from collections import Counter

import pytest
from eventloom.operators import summaries as sm
from eventloom.plans import q_corpus
from pyspark.sql import functions as F


def split(text):
    out, now = [], ""
    for k, c in enumerate(text):
        if c == "\n" or (c not in ".!?。！？；" and now and now[-1] in ".!?。！？；"):
            out.append(now)
            now = ""
        if c != "\n" and (now or c not in ".!?。！？；"):
            now += c
    return [x for x in (s.strip("".join(map(chr, range(33)))) for s in [*out, now]) if x]


def word_lists(sentences):
    return [[w for w in re.findall(r"[一-鿿]|[^\W一-鿿]+", s.lower())] for s in sentences]


def rank(words):
    n = len(words)
    w = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = Counter(words[i]), Counter(words[j])
            common = sum(a[x] * b[x] for x in a)
            norm = sum(math.log(len(x)) for x in (words[i], words[j]) if x)
            w[i][j] = common / norm if norm else float(common)
    for row in w:
        total = sum(row) + 1e-16
        row[:] = [x / total for x in row]
    p = [1 / n] * n
    while True:
        s = sum(p)
        new = [0.15 / n * s + 0.85 * sum(p[i] * w[i][j] for i in range(n)) for j in range(n)]
        moved = math.sqrt(sum((a - b) ** 2 for a, b in zip(new, p)))
        p = new
        if moved <= 1e-4:
            return p


def clusters(words):
    count = Counter(w for s in words for w in s)
    out = []
    for s in words:
        marks = "".join("x" if count[w] > 1 else "-" for w in s)
        best = 0.0
        for c in re.split("-{4,}", marks):
            c = c.strip("-")
            if c.count("x") > 1:
                best = max(best, c.count("x") ** 2 / len(c))
        out.append(best)
    return out


def brute(text, count, most):
    found = split(text)
    words = word_lists(found)
    scores = [round(x, 10) for x in (rank(words) if len(found) <= most else clusters(words))] if found else []
    picked = sorted(sorted(range(len(found)), key=lambda k: (-scores[k], k))[:count])
    return picked, [found[k] for k in picked]


ODD = ["", None, " \n\t ", "...", "One. One. One. One.", "a", "!?a!b", "我喜欢用Python编程。她也喜欢编程！我们都喜欢。", "same words here\nsame words here\nother words there. " * 3, "\x00 x. \x0b y;z"]


@pytest.mark.parametrize("most", [1000, 3])
def test_against_loops(spark, small, most):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").where("length(text) < 4000").limit(80).collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for count in (3, 0):
        got = {r.k: r for r in sm.summaries(docs, "k", count=count, most_ranked=most).collect()}
        for k, t in enumerate(texts):
            assert (got[k].positions, got[k].sentences) == brute(t or "", count, most), t
            assert got[k].n_sentences == len(split(t or ""))


def test_table_in_parts(monkeypatch):
    monkeypatch.setattr(sm, "AT_ONCE", 3)
    words = word_lists(split("one two three. two three four five. six seven. five six one."))
    assert sm.textrank(words).tolist() == pytest.approx(rank(words))


def test_budget(spark):
    word = "alpha beta gamma delta. "
    texts = [word * 100, word * 1300, word * 2000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r for r in sm.summaries(docs, "k").collect()}
    assert got[0].method == "whole" and got[0].sentences == [texts[0]] and got[3].sentences == []
    assert (len(got[1].positions), got[1].method, len(got[2].positions)) == (150, "luhn", 150)
    assert got[1].positions == list(range(150))  # all alike: the first


def test_queries(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    got = q_corpus.extractive_summaries(spark, small)
    assert got.count() == n and got.where("size(positions) <> least(5, n_sentences)").count() == 0
    assert q_corpus.document_summaries(spark, small).where(F.col("method") != "whole").where("taken < 1 or taken > 500").count() == 0

"""Collocations against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from eventloom.llm import collocations, queries
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """rows: (lang, text)."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = count.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n, found = total[lang], []
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p in wanted for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and wanted[p] >= f[p[i:j]]}
        for p, a in wanted.items():
            s, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(docs, least, top):
    return sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())


@pytest.mark.parametrize("trigger, at_a_time, bits", [(24, 12 << 20, 1 << 28), (2, 50, 1 << 15), (10**9, 3000, 1 << 15)])
def test_brute_force(spark, monkeypatch, trigger, at_a_time, bits):
    for name, value in dict(TRIGGER=trigger, AT_A_TIME=at_a_time, MOST_BITS=bits, MOST_OWN=7).items():
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(trigger)
    words = [*"abcdef", "É", "ß", "x-y", "\x00", "日本", "A", "\xa0"]
    def text():
        some = rng.choices(words, k=rng.randint(0, 60))
        return "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for w in some)
    rows = [(rng.choice(["en", "de", None, "und", ""]), rng.choice([text(), text(), None, "", "the same line of five words again"])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for top in (2000, 7):
        assert got(docs, 6, top) == brute(rows, 6, top)


def test_odd(spark, odd, none, rows):
    assert got(odd.withColumns({"a.b": F.lit(1), "own": F.lit(1), "f": F.lit(1)}), 2, 2000) == brute([(r[2], r[1]) for r in rows], 2, 2000)
    assert got(none, 1, 10) == []


def test_large_numbers(spark):
    frequent = spark.createDataFrame([("en", "a", 1, 3 * 10**9), ("en", "b", 1, 10**12 + 1), ("en", "a b", 2, 3 * 10**9)], "lang string, phrase string, words int, f long")
    r = collocations.score(frequent, spark.createDataFrame([("en", 10**15 + 7)], "lang string, n long")).first()
    assert r.score == 1000 * 3 * 10**9 * (10**15 + 7) // (3 * 10**9 * (10**12 + 1))


def test_parts():
    """Batches are put together and cut by bytes; each row comes once, in order."""
    texts = ["a" * k for k in (0, 3, 200, 0, 7, 30, 31, 1)] * 5
    batches = [pa.record_batch([pa.array(texts[k : k + 7]), pa.array(texts[k : k + 7])], ["x", "t"]).slice(1 if k else 0) for k in range(0, 40, 7)]
    want = [t for b in batches for t in b.column(1).to_pylist()]
    for most in (1, 10, 100, 10**6):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(collocations, "AT_A_TIME", most)
            got = [t.column(1).to_pylist() for t in collocations._some(iter(batches), 1)]
        assert [x for part in got for x in part] == want
        assert all(len(part) == 1 or sum(map(len, part[:-1])) <= most for part in got)


def test_filter(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 9000)
    bitmap = collocations.filter_of(spark.createDataFrame([(int(x),) for x in h[:3000]], "h long"))
    hit = collocations._has(bitmap, h.view(np.uint64))
    assert hit[:3000].all() and hit[3000:].mean() < 0.1


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    out = queries.op13_collocations(spark, sf)
    want = con.execute(queries.OP13_SQL)
    assert [c[0] for c in want.description] == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())

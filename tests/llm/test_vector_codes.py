"""Vector codes against brute force."""

import hashlib
import math

import numpy as np
import pytest
from eventloom.llm import queries, vector_codes
from pyspark.sql import functions as F


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (key, vector); the codebooks, and (key, code, error) of each row kept."""
    kept = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows]
    size = len(kept[0][1]) // parts
    cut = [(k, [tuple(v[p * size : (p + 1) * size]) for p in range(parts)]) for k, v in kept]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(book)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in cut:
                own.setdefault(near(v[p], books[p])[0], []).append(v[p])
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])]
    out = []
    for k, v in cut:
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((k, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found)))
    return books, out


def test_query(spark, tmp_path):
    """Copies, ties of distances, labels that are null, and vectors that are left out."""
    rng = np.random.default_rng(5)
    shapes = rng.normal(0, 0.2, (90, 8)).astype("float32")
    rows = [(k, shapes[rng.integers(90)].tolist(), int(rng.integers(4)) or None) for k in range(700)]
    rows += [(k, np.round(rng.normal(0, 1, 8)).tolist(), 7) for k in range(700, 800)]
    bad = [(-5, None, 1), (-4, [1.0] * 7 + [None], 1), (-3, [float("nan")] + [0.0] * 7, 1), (-2, [float("inf")] + [0.0] * 7, 1), (-1, [0.5] * 4, 1), (-6, [], 1)]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    books, want = brute([r[:2] for r in rows])
    assert sorted((r.vec_id, r.code, r.error) for r in got) == want
    label, sums = {r[0]: r[2] for r in rows}, {}
    for k, _, e in want:
        sums[label[k]] = sums.get(label[k], 0) + e
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_tables(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = queries.op11_vector_codes(spark, small).collect()
    cells = np.array([[math.floor(1024 * x) for x in v] for _, v in rows])
    order = np.argsort([k for k, _ in rows])[:256]
    error = np.zeros(len(rows), np.int64)
    for p in range(4):
        mine, book = cells[:, p * 16 : p * 16 + 16], cells[order, p * 16 : p * 16 + 16]
        for last in (False,) * 4 + (True,):
            far = ((mine[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            code = far.argmin(axis=1)
            if not last:
                book = np.array([mine[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else book[e] for e in range(256)])
        error += far.min(axis=1)
    assert {r.vec_id: r.error for r in got} == {k: e for (k, _), e in zip(rows, error.tolist())}


@pytest.mark.parametrize("leaves", [1, 3, 512])
def test_trie(monkeypatch, leaves):
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    rng = np.random.default_rng(leaves)
    for n, width in ((0, 3), (1, 1), (400, 4), (50, 0)):
        rows, book = np.array(sorted(map(tuple, rng.integers(-3, 4, (n, width)).tolist()))).reshape(n, width).astype(int), rng.integers(-3, 4, (20, width))
        code, far = vector_codes.nearest(rows, book)
        all_far = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (code == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()


def test_odd(spark):
    rows = [(2, [1e30, 0.0], "x"), (2, [1e30, 0.0], "x"), (None, [-1e30, 3.0], "y"), (1, [0.0, -0.0], None), (3, [1.0, 2.0, 3.0, 4.0], "z")]
    table = spark.createDataFrame(rows, "vec_id int, v array<double>, `a.b` string").withColumns({c: F.lit("mine") for c in ("part", "cells", "n", "code", "error", "label_error")})
    books = vector_codes.train(table, vector="v", parts=2, entries=3, rounds=2)
    own, want = brute([r[:2] for r in rows[:4]], 2, 3, 2)
    assert books.parts == own and books.width == 2
    coded = vector_codes.encode(table, books, vector="v", carry=("a.b", "n", "code"))
    assert coded.columns == ["vec_id", "a.b", "n", "code", "error"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=key) == sorted(((k, c, e if e < 2**63 else None) for k, c, e in want), key=key)
    assert all(r.n == "mine" for r in coded.collect())
    assert vector_codes.label_errors(coded, "a.b").columns == [*coded.columns, "label_error"]
    assert [r.decoded for r in vector_codes.decode(coded, books).where("vec_id = 1").collect()] == [[books.parts[0][int(c[:2], 16)][0] / 1024, books.parts[1][int(c[2:], 16)][0] / 1024] for c in [w[1] for w in want if w[0] == 1]]
    empty = vector_codes.train(table.limit(0), vector="v")
    assert vector_codes.encode(table, empty, vector="v").count() == 0 and empty.sha256() == hashlib.sha256(b"").hexdigest()

"""Vector codes by product quantisation: integer codebooks, and assignment in a trie over distinct parts.

A component x counts as the integer floor(1024 * x), so that all sums are exact and the same in any order. The distinct
parts of all vectors, sorted and with their numbers, are written once; each round walks the trie that each task's sorted
rows form. A node keeps the distances that its components add up to, one for each entry, and its children share them;
leaves take the nearest entry and add their weight to its sums. Only codebooks pass through the driver: parts times
entries rows, numbers that are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from eventloom.llm.common import discard, map_batches, materialize, quoted

SCALE = 1024
#: Leaves whose distances a task holds at once.
LEAVES = 512


@dataclass
class Codebooks:
    """For each part its entries, each a tuple of integer components; width is that of a whole vector."""

    width: int
    parts: list[list[tuple[int, ...]]]

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, decimal and joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for entry in part for x in entry).encode()).hexdigest()


def _numbers(values: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """values, whole doubles, as integers: of 64 bits where squared distances to others fit, else Python's."""
    most = max((float(np.abs(x).max()) for x in (values, *others) if x.size), default=0.0)
    width = values.shape[-1] if values.ndim > 1 else 1
    if 4.0 * most * most * max(width, 1) < 2.0**62:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each of the sorted rows: a walk, depth first, through the trie that they form.

    Of entries at equal distance the first is taken. Nodes of many leaves pass their distances down one by one; their
    small children are walked together, up to LEAVES leaves at a time.
    """
    n, width = rows.shape
    code, far = np.zeros(n, np.int64), np.zeros(n, rows.dtype)
    same = rows[1:] == rows[:-1]
    # depth to which a row shares its prefix with the row before it
    shared = np.concatenate([[-1], np.where(same.all(axis=1), width, np.argmin(same, axis=1))]) if n and width else np.full(n, -1)

    def block(low: int, high: int, depth: int, sums: np.ndarray) -> None:
        sums, owner, lcp = sums[None, :], np.zeros(high - low, np.int64), shared[low:high].copy()
        lcp[0] = -1
        for d in range(depth, width):
            opens = lcp <= d
            first = np.flatnonzero(opens)
            step = rows[low + first, d][:, None] - book[:, d][None, :]
            sums = sums[owner[first]] + step * step
            owner = np.cumsum(opens) - 1
        best = np.argmin(sums, axis=1)
        code[low:high] = best[owner]
        far[low:high] = sums[np.arange(len(best)), best][owner]

    def visit(low: int, high: int, depth: int, sums: np.ndarray) -> None:
        if high - low <= LEAVES or depth == width:
            block(low, high, depth, sums)
            return
        opens = low + np.flatnonzero(shared[low + 1 : high] <= depth) + 1
        ends = [low, *opens.tolist(), high]
        begun = low
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a > LEAVES:
                if begun < a:
                    block(begun, a, depth, sums)
                step = rows[a, depth] - book[:, depth]
                visit(a, b, depth + 1, sums + step * step)
                begun = b
            elif b - begun > LEAVES:
                block(begun, a, depth, sums)
                begun = a
        if begun < high:
            block(begun, high, depth, sums)

    if n:
        visit(0, n, 0, np.zeros(len(book), rows.dtype))
    return code, far


def _cells(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists, all of one width, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


def _whole(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(_cells(column, width) * SCALE) + 0.0  # no negative zero


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct rows, each row's place among them, and their numbers."""
    if not cells.shape[1]:
        return cells[:1], np.zeros(len(cells), np.int64), np.array([len(cells)])
    found, place, number = np.unique(cells, axis=0, return_inverse=True, return_counts=True)
    return found, place.ravel(), number


def _finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < float("inf")))


def usable(table: DataFrame, key: str, vector: str, parts: int) -> tuple[DataFrame, int]:
    """The rows whose vector is of the usual width and has only finite components, and that width.

    The usual width is the most frequent that parts divides, of equally frequent ones the greatest; rows of another
    width are left out, as are null vectors and those with null or non-finite components.
    """
    v = F.col(quoted(vector))
    fine = table.where(_finite(v) & (F.size(v) % parts == 0))
    found = fine.groupBy(F.size(v).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = found["width"] if found else 0
    return fine.where(F.size(v) == width), width


def first_codebooks(fine: DataFrame, width: int, key: str, vector: str, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest keys, null last; rows that repeat a key count each, by their vector."""
    first = fine.orderBy(F.asc_nulls_last(quoted(key)), F.col(quoted(vector))).select(F.col(quoted(vector)).cast("array<double>").alias("v")).limit(entries).collect()
    whole = [[int(x) for x in np.floor(np.array(r.v) * SCALE)] for r in first]
    size = width // parts
    return Codebooks(width, [[tuple(row[p * size : (p + 1) * size]) for row in whole] for p in range(parts)])


def distinct_parts(fine: DataFrame, width: int, vector: str, parts: int) -> DataFrame:
    """(part, cells, n): the distinct parts with their numbers, sorted by ranges; equal ones are added up in each batch
    before they travel."""
    size = width // parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(0), width)
            for p in range(parts):
                found, _, number = _distinct(whole[:, p * size : (p + 1) * size])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * size, pa.int32()), pa.array(found.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), p), pa.int32()), lists, pa.array(number, pa.int64())], ["part", "cells", "n"])

    rows = fine.select(F.col(quoted(vector)).alias("v")).mapInArrow(cut, "part int, cells array<double>, n long")
    return rows.repartitionByRange("part", "cells").groupBy("part", "cells").agg(F.sum("n").alias("n")).sortWithinPartitions("part", "cells")


def _sums(parts: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[list[int], int]]:
    """For each part and entry that is some part's nearest, the sums of the components and the number of these parts."""
    size = books.width // max(len(books.parts), 1)
    tables = [np.array(b, dtype=np.float64).reshape(len(b), size) for b in books.parts]
    exact = [np.array([[int(x) for x in e] for e in b], dtype=object).reshape(len(b), size) for b in books.parts]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), size), dtype=object) for b in tables]
        count = [np.zeros(len(b), dtype=object) for b in tables]
        for batch in batches:
            which, weights = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cells = _cells(batch.column(1), size)
            for p in np.unique(which):
                mine = which == p
                rows = _numbers(cells[mine], tables[p])
                code, _ = nearest(rows, exact[p].astype(rows.dtype))
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                n = weights[mine][order]
                if float(n.sum()) * float(np.abs(cells[mine]).max(initial=0)) >= 2.0**62:
                    rows, n = rows.astype(object), n.astype(object)
                if size:
                    total[p][used] += np.add.reduceat(rows[order] * n[:, None], starts, axis=0).astype(object)
                count[p][used] += np.add.reduceat(n, starts).astype(object)
        out = [(p, e, d, str(total[p][e, d] if d >= 0 else count[p][e])) for p in range(len(tables)) for e in np.flatnonzero(count[p]).tolist() for d in range(-1, size)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["part", "entry", "at", "total"])

    found = parts.mapInArrow(walk, "part int, entry int, at int, total string")
    # a decimal is exact for sums of up to 38 digits; longer ones come from components beyond any float of use
    rows = found.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    numbers = {(r["part"], r["entry"], r["at"]): r["total"] for r in rows}
    for (p, e, at), n in numbers.items():
        if at < 0:
            out[p, e] = [int(numbers[p, e, d]) for d in range(size)], int(n)
    return out


def train(table: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks of `entries` entries for each of `parts` equal consecutive parts, from every usable row.

    They begin as the parts of the first vectors by key; each round assigns every part to its nearest entry, by the
    lower index where distances tie, and moves each used entry to the floor of its parts' mean. Null keys come last;
    rows that repeat are counted each; extra columns are not looked at; a table without a usable row gives codebooks
    without entries. Sums of more than 38 digits are an error.
    """
    fine, width = usable(table, key, vector, parts)
    books = first_codebooks(fine, width, key, vector, parts, entries)
    if not books.parts[0]:
        return books
    stored = materialize(distinct_parts(fine, width, vector, parts))
    for _ in range(rounds):
        found = _sums(stored, books)
        books = Codebooks(width, [[tuple(s // found[p, e][1] for s in found[p, e][0]) if (p, e) in found else entry for e, entry in enumerate(part)] for p, part in enumerate(books.parts)])
    discard(stored)
    return books


def encode(table: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., code, error) of each usable row of the codebooks' width: the index of each part's nearest entry,
    two hexadecimal digits each or more where there are over 256 entries, and the squared distances summed over parts,
    null where they pass a long.

    The distinct parts of each batch are walked once. Repeated rows all stay; columns not named in carry are not looked
    at, nor are those named code and error; an empty table gives no rows.
    """
    count, width = len(books.parts), books.width
    size = width // max(count, 1)
    digits = max([2, *(len(f"{len(b) - 1:x}") for b in books.parts)])
    own = [key, *(c for c in carry if c not in (key, "code", "error"))]
    tables = [np.array(b, dtype=np.float64).reshape(len(b), size) for b in books.parts]
    exact = [np.array([[int(x) for x in e] for e in b], dtype=object).reshape(len(b), size) for b in books.parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(len(own)), width)
            codes, error = [], np.zeros(len(whole), dtype=object)
            for p in range(count):
                found, place, _ = _distinct(whole[:, p * size : (p + 1) * size])
                rows = _numbers(found, tables[p])
                code, far = nearest(rows, exact[p].astype(rows.dtype))
                codes.append(np.array([f"{c:0{digits}x}" for c in range(len(tables[p]))], dtype=object)[code][place])
                error += far[place].astype(object)
            joined = ["".join(c) for c in zip(*codes, strict=True)]
            errors = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(joined, pa.string()), pa.array(errors, pa.int64())], [*own, "code", "error"])

    v = F.col(quoted(vector))
    fine = table.where(_finite(v) & (F.size(v) == width))
    if not books.parts or not books.parts[0]:
        fine = fine.limit(0)
    schema = StructType([table.schema[c] for c in own]).add("code", StringType()).add("error", LongType())
    return map_batches(fine.select(*map(quoted, own), v.alias("\0vector")), run, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes and decoded, the entries of a code as an array of doubles; null for a null code. Other columns are kept,
    but for one named decoded, which is replaced."""
    digits = max([2, *(len(f"{len(b) - 1:x}") for b in books.parts)])
    names = [c for c in codes.columns if c != "decoded"]
    at = names.index(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if c is None else [x / SCALE for p, part in enumerate(books.parts) for x in part[int(c[p * digits : (p + 1) * digits], 16)]] for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*names, "decoded"])

    return map_batches(codes.drop("decoded"), run, StructType([codes.schema[c] for c in names]).add("decoded", ArrayType(DoubleType())))


def label_errors(encoded: DataFrame, label: str = "label") -> DataFrame:
    """encoded with label_error, the errors summed over the rows of an equal label, null labels together; summed before
    they are joined. Other columns are kept, but for one named label_error, which is replaced."""
    sums = encoded.groupBy(F.col(quoted(label)).alias("\0label")).agg(F.sum("error").alias("label_error"))
    return encoded.drop("label_error").join(sums, F.col(quoted(label)).eqNullSafe(F.col("`\0label`")), "left").drop("\0label")

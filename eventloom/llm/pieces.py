"""SentencePiece encoding through a table of distinct chunks, and decoding.

No piece of the model crosses from other text into a whitespace marker, so a text's ids are those of its marked words,
one after another. Each task keeps a table of the distinct marked words that it has met: a word is segmented once, and
ids are joined back by position. The table is emptied when it is full, which costs time only.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from eventloom.llm.common import map_batches, quoted

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries and characters of a task's table.
MOST_CHUNKS, MOST_CHARS = 300_000, 16_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of whole texts, through a table of distinct marked words: their ids, four bytes each."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=model)
        if any(re.search(f"[^{MARK}]{MARK}", self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())):
            raise ValueError("a piece of this model crosses into a whitespace marker")
        probe = " a  b\u3000\ufb01 \t c "
        if self.sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model's normaliser changes white space, word edges or characters")
        self.ids: dict[str, bytes] = {}
        self.chars = 0

    def chunks(self, texts: list[str]) -> list[list[str]]:
        """The marked words of each text; all are in the table afterwards. The library puts a marker before a text."""
        found = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.ids, self.chars = {}, 0
        new = sorted({c for cs in found for c in cs if c not in self.ids})
        # the library adds the first marker itself, but not to an empty text
        for c, ids in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1), strict=True):
            self.ids[c] = array("i", ids or [self.sp.piece_to_id(MARK)]).tobytes()
            self.chars += len(c)
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.lists(texts).to_pylist()

    def lists(self, texts: list[str], tail: Sequence[int] = ()) -> pa.ListArray:
        """The ids of each text, and tail after them."""
        found, last = self.chunks(texts), array("i", tail).tobytes()
        parts = [b"".join(map(self.ids.__getitem__, cs)) + last for cs in found]
        offsets = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column of ids, an empty one for null."""
    at = column.offsets.to_numpy()
    flat = column.values[at[0] : at[-1]].to_numpy(zero_copy_only=False).tolist()
    return [flat[a:b] for a, b in pairwise((at - at[0]).tolist())]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, end: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., ids): the ids of each whole text as the library gives them, with the end id last if end is set.

    A null text is an empty one, which has no ids but the end's. Repeated rows are encoded alike and all stay; columns
    not named in carry are not looked at; an empty table gives no rows.
    """
    path = model or default_model()
    own = [key, *(c for c in carry if c not in (key, "ids"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        tail = [table.sp.eos_id()] if end else []
        for batch in batches:
            for part in _parts(batch):
                ids = table.lists(part.column(len(own)).to_pylist(), tail)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], ids], [*own, "ids"])

    schema = StructType([docs.schema[c] for c in own]).add("ids", ArrayType(IntegerType()))
    return map_batches(docs.select(*map(quoted, own), F.coalesce(F.col(quoted(text)), F.lit(""))), run, schema)


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """tokens and decoded, the library's text for the ids; null ids give an empty text. Other columns are kept, but for
    one named decoded, which is replaced; repeated rows all stay; an empty table stays empty."""
    path = model or default_model()
    tokens = tokens.drop("decoded")
    names, at = tokens.columns, tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        for batch in batches:
            for part in _parts(batch):
                texts = [sp.decode(x) if x else "" for x in _lists(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return map_batches(tokens, run, StructType([*tokens.schema.fields]).add("decoded", StringType()))


def round_trips(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., ids, round_trip): encode() with the end id, and whether decode() gives the text again, null for a
    null text. One pass through Python, which texts enter but don't leave."""
    path = model or default_model()
    own = [key, *(c for c in carry if c not in (key, "ids", "round_trip"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        tail = [table.sp.eos_id()]
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(len(own)).to_pylist()
                ids = table.lists([t or "" for t in texts], tail)
                same = [None if t is None else table.sp.decode(x) == t for t, x in zip(texts, _lists(ids), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], ids, pa.array(same, pa.bool_())], [*own, "ids", "round_trip"])

    schema = StructType([docs.schema[c] for c in own]).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())
    return map_batches(docs.select(*map(quoted, own), F.col(quoted(text))), run, schema)


def lengths(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """(n_tokens): the number of ids of each text, without an end id."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            for part in _parts(batch):
                found = table.chunks(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([sum(len(table.ids[c]) for c in cs) // 4 for cs in found], pa.int64())], ["n_tokens"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "n_tokens long")

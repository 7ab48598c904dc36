"""Byte-level BPE through a lazily determinised transducer, and streaming decoding.

A piece's tokens are right if and only if each two neighbours, and a token that stands alone, come out of the merges
unchanged: a merge of the whole piece that crossed a boundary would be one of the neighbours' own merges, too. So the
last token of every prefix is the one token that ends there and fits the last token of the prefix before it, and the
tokens of all prefixes form a tree. The transducer's state is what the next bytes can still meet: the starts from which
some longer token may come, and the path in the tree to each. Tokens that all paths share are given out; how far a path
runs ahead is bounded by the vocabulary. States and steps are made when a text first needs them and kept in a table, as are
the tokens of whole pieces; tables that are full lose their younger half, which costs time only.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import batched, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from eventloom.llm.common import map_batches, quoted

#: Steps of the transducer or decoder, pairs of tokens, and whole pieces that a Python worker keeps; of a full table the
#: older half stays, which the frequent ones are in.
MOST_STEPS, MOST_PAIRS, MOST_PIECES = 400_000, 300_000, 400_000
#: Characters of a text whose pieces are held at once.
LONG = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(text: bytes, ranks: dict[bytes, int], bound: int = 0) -> list[int] | None:
    """The tokens of a short text by plain merging: the pair of lowest rank first, of equal ones the leftmost. None as
    soon as one spans the place `bound` within the text."""
    none = 1 << 60
    parts = [text[k : k + 1] for k in range(len(text))]
    pairs = [ranks.get(text[k : k + 2], none) for k in range(len(text) - 1)]
    left = bound  # parts before the bound
    while pairs and (rank := min(pairs)) != none:
        k = pairs.index(rank)
        if k < left:
            left -= 1
            if k == left:
                return None
        one = parts[k] + parts.pop(k + 1)
        parts[k] = one
        del pairs[k]
        if k:
            pairs[k - 1] = ranks.get(parts[k - 1] + one, none)
        if k < len(pairs):
            pairs[k] = ranks.get(one + parts[k + 1], none)
    return [ranks[p] for p in parts]


def _older(table: dict) -> dict:
    return dict(islice(table.items(), len(table) // 2))


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        #: The tokens' trie: (node << 8 | byte) to node; the token that ends at a node, and whether longer ones go on.
        self.children: dict[int, int] = {}
        self.tokens, self.inner = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                child = self.children.setdefault(node << 8 | byte, len(self.tokens))
                if child == len(self.tokens):
                    self.tokens.append(-1)
                    self.inner.append(False)
                node = child
            self.tokens[node] = rank
        self.size, self.pairs = max(self.bytes) + 1, {}
        #: A state is the last token given out, -1 before the first and -2 where it can't matter, and for each start the
        #: trie node of the bytes since, the length of its path and the path; four bytes a number.
        start = array("i", (-1, 0, 0)).tobytes()
        self.states, self.numbers = [start], {start: 0}
        #: (state << 8 | byte) to a state, or to ~k of a (state, tokens given out) in outs.
        self.steps: dict[int, int] = {}
        self.outs: list[tuple[int, tuple[int, ...]]] = []

    def starts(self, number: int) -> tuple[int, list[tuple[int, tuple[int, ...]]]]:
        """(last token, [(trie node, path)]) of a state."""
        last, *flat = array("i", self.states[number])
        out, k = [], 0
        while k < len(flat):
            to = k + 2 + flat[k + 1]
            out.append((flat[k], tuple(flat[k + 2 : to])))
            k = to
        return last, out

    def trim(self) -> None:
        """Leaves the older half of the states and the steps between them."""
        half, steps, outs = max(1, len(self.states) // 2), {}, []
        for at, to in self.steps.items():
            state, out = (to, ()) if to >= 0 else self.outs[~to]
            if at >> 8 < half and state < half:
                steps[at] = to if to >= 0 else ~len(outs)
                if out:
                    outs.append((state, out))
        self.states, self.steps, self.outs = self.states[:half], steps, outs
        self.numbers = {state: k for k, state in enumerate(self.states)}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes give the two again; left is -1 at the beginning of a piece."""
        pair = left * self.size + right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs = _older(self.pairs)
            first, second = b"" if left < 0 else self.bytes[left], self.bytes[right]
            parts = merge(first + second, self.ranks, len(first))
            known = self.pairs[pair] = parts is not None and len(parts) == (2 if first else 1)
        return known

    def _step(self, number: int, byte: int) -> int:
        last, starts = self.starts(number)
        alive, own = [], None
        for node, path in starts:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            if self.inner[child]:
                alive.append((child, path))
            token = self.tokens[child]
            if own is None and token >= 0 and self.fits(path[-1] if path else last, token):
                own = (*path, token)
        sure = least = len(own)
        for _, path in alive:
            least = min(least, len(path))
            sure = min(sure, len(path))
            while path[:sure] != own[:sure]:
                sure -= 1
        out = own[:sure]
        # the last token given out matters only where a path has none of its own
        flat = array("i", (-2 if sure != least else out[-1] if sure else last,))
        for node, path in (*alive, (0, own)):
            flat.extend((node, len(path) - sure, *path[sure:]))
        new = self.numbers.setdefault(flat.tobytes(), len(self.states))
        if new == len(self.states):
            self.states.append(flat.tobytes())
        if out:
            self.outs.append((new, out))
            new = ~(len(self.outs) - 1)
        self.steps[number << 8 | byte] = new
        return new

    def run(self, piece: bytes) -> array:
        """The tokens of a piece. One that is a token as a whole gives it, whatever the merges give."""
        out = array("i")
        if (whole := self.ranks.get(piece)) is not None:
            out.append(whole)
            return out
        get, state = self.steps.get, 0
        for byte in piece:
            to = get(state << 8 | byte)
            if to is None:
                to = self._step(state, byte)
            if to < 0:
                state, given = self.outs[~to]
                out.extend(given)
            else:
                state = to
        out.extend(self.starts(state)[1][-1][1])
        return out


class Pieces(dict):
    """Whole pieces met, to their tokens, four bytes each: words repeat far more than bytes' contexts do."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self.transducer.steps) >= MOST_STEPS:
            self.transducer.trim()
        if len(self) >= MOST_PIECES:
            kept = _older(self)
            self.clear()
            self.update(kept)
        ids = self.transducer.run(piece.encode()).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str, matcher) -> bytes:
        """The tokens of one text's matches; of a long text, some matches at a time."""
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, matcher.findall(text)))
        return b"".join(b"".join([self[m[0]] for m in some]) for some in batched(matcher.finditer(text), 65536))


class Utf8:
    """An incremental machine for UTF-8: its state is the bytes of a character not yet whole. A byte that can't go on
    ends the character with U+FFFD, as does the end of the text."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _next(begun: bytes) -> tuple[int, int]:
        """The least and greatest byte that may follow."""
        if len(begun) == 1:
            return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(begun[0], (0x80, 0xBF))
        return 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.pending:
                low, high = self._next(self.pending)
                if low <= b <= high:
                    self.pending += bytes([b])
                    if len(self.pending) == (2 if self.pending[0] < 0xE0 else 3 if self.pending[0] < 0xF0 else 4):
                        out.append(self.pending.decode())
                        self.pending = b""
                    continue
                out.append("�")
                self.pending = b""
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.pending = bytes([b])
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        out, self.pending = "�" if self.pending else "", b""
        return out


class _Row(dict):
    """The steps of one state of the decoder: from a token to its text and the next state's row."""

    def __init__(self, decoder: Decoder, pending: bytes):
        super().__init__()
        self.decoder, self.pending = decoder, pending

    def __missing__(self, token: int | None) -> tuple[str, _Row]:
        machine = Utf8()
        machine.pending = self.pending
        known = self.decoder.bytes.get(token)
        text = machine.close() + "�" if known is None else machine.feed(known)
        step = text, self.decoder.row(machine.pending)
        if len(self) < MOST_STEPS:
            self[token] = step
        return step


class Decoder:
    """Token ids to text, id by id; the machine's steps over whole tokens are kept by state."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.rows: dict[bytes, _Row] = {}
        self.at = self.row(b"")

    def row(self, pending: bytes) -> _Row:
        return self.rows.get(pending) or self.rows.setdefault(pending, _Row(self, pending))

    def feed(self, ids: Sequence[int]) -> str:
        """The text that ids make whole, after those fed before. An id that isn't in the vocabulary gives U+FFFD."""
        out, row = [], self.at
        for token in ids:
            text, row = row[token]
            out.append(text)
        self.at = row
        return "".join(out)

    def close(self) -> str:
        out, self.at = "�" if self.at.pending else "", self.row(b"")
        return out


@cache
def _encoder(path: str, pattern: str):
    """The table of pieces over a transducer and the matcher; a Python worker keeps them for its next tasks."""
    import regex

    return Pieces(Transducer(read_ranks(path))), regex.compile(pattern)


@cache
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None, carry: Sequence[str] = (), decoded: bool = False) -> DataFrame:
    """(key, carry..., ids): the ids of each whole text; each match of pattern is encoded by itself, no special tokens.
    With decoded, also what decode() makes of the ids, in the same pass.

    A null text is an empty one, which has no ids; what pattern doesn't match has none, either. Repeated rows are
    encoded alike and all stay; columns not named in carry are not looked at, nor is one named ids; an empty table
    gives no rows. A very long text costs its own size and four bytes a token.
    """
    import public_tokenizers

    path, cut = vocabulary or default_vocabulary(), pattern or public_tokenizers.PATTERN
    own = [key, *(c for c in carry if c not in (key, "ids", *(("decoded",) if decoded else ())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, matcher = _encoder(path, cut)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [pieces.encode(t.as_py(), matcher) for t in part.column(len(own))]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                columns, names = [*part.columns[: len(own)], lists], [*own, "ids"]
                if decoded:
                    decoder = _decoder(path)
                    columns.append(pa.array([decoder.feed(array("i", x)) + decoder.close() for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([docs.schema[c] for c in own]).add("ids", ArrayType(IntegerType()))
    schema = schema.add("decoded", StringType()) if decoded else schema
    return map_batches(docs.select(*map(quoted, own), F.coalesce(F.col(quoted(text)), F.lit(""))), run, schema)


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """tokens and decoded, the text of the ids. Bytes that aren't UTF-8 and ids outside the vocabulary, null among them,
    give U+FFFD; null ids give an empty text. Other columns are kept, but for one named decoded, which is replaced;
    repeated rows all stay; an empty table stays empty."""
    path = vocabulary or default_vocabulary()
    tokens = tokens.drop("decoded")
    names, at = tokens.columns, tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(at)
                flat, ends = lists.values.to_pylist() if lists.values.null_count else lists.values.to_numpy().tolist(), lists.offsets.to_pylist()
                texts = [decoder.feed(flat[a:b]) + decoder.close() for a, b in pairwise(ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return map_batches(tokens, run, StructType([*tokens.schema.fields]).add("decoded", StringType()))

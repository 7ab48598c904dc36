"""Byte-level BPE against the library, the machine for UTF-8 against Python's."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from eventloom.llm import byte_bpe, queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(byte_bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, small, library):
    known = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(known)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode_ordinary(known[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(known[r.doc_id]))


def odd_bytes(ranks, n):
    rng, tokens = random.Random(7), list(ranks)
    for k in range(n):
        yield [
            lambda: bytes(rng.choices(range(256), k=rng.randint(1, 30))),
            lambda: bytes(rng.choices(b"ab ", k=rng.randint(1, 60))),
            lambda: b"".join(rng.choices(tokens, k=rng.randint(1, 6))),
            lambda: bytes([rng.choice(b" a=-\n0")]) * rng.randint(1, 300),
        ][k % 4]()


def test_transducer_and_decoder(ranks, library, monkeypatch):
    for name in ("MOST_STEPS", "MOST_PAIRS", "MOST_PIECES"):
        monkeypatch.setattr(byte_bpe, name, 300 if name == "MOST_PIECES" else 3000)
    transducer, decoder = byte_bpe.Transducer(ranks), byte_bpe.Decoder(ranks)
    pieces = byte_bpe.Pieces(transducer)
    for raw in odd_bytes(ranks, 2000):
        ids = list(transducer.run(raw))
        assert ids == library._core_bpe.encode_single_piece(raw)
        machine = byte_bpe.Utf8()
        assert "".join(machine.feed(raw[k : k + 2]) for k in range(0, len(raw), 2)) + machine.close() == raw.decode("utf-8", "replace")
        assert decoder.feed(ids) + decoder.close() == raw.decode("utf-8", "replace")
    for k in range(500):
        piece = f"q{k}x{k * k}y"
        assert list(pieces[piece]) == list(array("i", library._core_bpe.encode_single_piece(piece.encode())).tobytes())
    assert len(transducer.steps) < 4000


def test_own_vocabulary(tmp_path):
    """Tokens that no merge reaches, and ranks that don't follow the merges."""
    rng = random.Random(3)
    for _ in range(20):
        tokens = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(12)}
        order = [bytes([b]) for b in range(256)] + sorted(tokens, key=lambda _: rng.random())
        own = {t: k for k, t in enumerate(order)}
        transducer, library = byte_bpe.Transducer(own), tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=own, special_tokens={})
        for _ in range(200):
            raw = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
            assert list(transducer.run(raw)) == library._core_bpe.encode_single_piece(raw)


def test_odd(spark, odd, none, rows, library):
    odd = odd.withColumns({"a.b": F.lit("mine"), "decoded": F.lit("mine")})
    encoded = byte_bpe.encode(odd, carry=("a.b", "media", "ids"))
    assert encoded.columns == ["doc_id", "a.b", "media", "ids"]
    got = byte_bpe.decode(encoded).collect()
    want = sorted((r[0] or 0, tuple(library.encode_ordinary(r[1] or "")), r[1] or "") for r in rows)
    assert sorted((r.doc_id or 0, tuple(r.ids), r.decoded) for r in got) == want
    assert all(r["a.b"] == r.media == "mine" for r in got)
    both = byte_bpe.encode(odd, carry=("media", "decoded"), decoded=True)
    assert both.columns == ["doc_id", "media", "ids", "decoded"]
    assert sorted((r.doc_id or 0, tuple(r.ids), r.decoded) for r in both.collect()) == want
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [10**6, None]), (4, library.encode_ordinary("é")[:1])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(ids).collect()} == {1: "", 2: "", 3: "��", 4: "é"} or library.encode_ordinary("é")[1:]

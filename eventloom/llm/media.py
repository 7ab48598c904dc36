"""Media columns: AVI files of motion-JPEG frames.

encode() stores bytes losslessly in the unit of the format, the quantised coefficients of baseline JPEG; clips() parses
the RIFF index, decodes the frames, and cuts shots where the difference of their histograms stands out from those
around it. Frames of encode() are decoded as whole arrays, any other baseline JPEG code by code.

A block's 64 coefficients hold 64 bytes. All coefficients have the size category 8, whose 256 values stand for the 256
bytes, so that a coefficient's extra bits are the byte itself; the one Huffman code in use is the bit 0. A restart
marker after each block keeps each block's DC coefficient apart and all blocks aligned: 64 bytes take 72 and a marker.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.llm.common import map_batches, quoted

BLOCK, SIDE, FPS = 64, 64, 25
BLOCKS = (SIDE // 8) ** 2  # of a frame
FRAME = BLOCKS * BLOCK  # payload bytes of a frame
BINS, AROUND = 16, 8

# The order in which JPEG lists an 8 x 8 block.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: The inverse cosine transform in whole numbers, so that sums are exact in doubles and the same everywhere.
_SCALE = 1 << 12
_K = np.arange(8)
COSINE = np.rint(_SCALE * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def _runs(*rows: int) -> bytes:
    return bytes(row * 16 + k for row, first in enumerate(rows) for k in range(first, 11))


#: The standard's Huffman tables, by class and number; motion-JPEG frames may leave them out.
STANDARD = {
    0x00: bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12)),
    0x01: bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]) + bytes(range(12)),
    0x10: bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282") + _runs(9, 6, 5, 4, 3, 3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1),
    0x11: bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]) + bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1") + _runs(11, 7, 6, 5, 3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2),
}
_SCAN_END = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


def _jpeg_head(side: int) -> bytes:
    code = bytes([1] + [0] * 15 + [8])  # one code, of one bit, for the category 8 without a run of zeros
    return b"\xff\xd8" + _segment(0xFFDB, b"\0" + b"\1" * 64) + _segment(0xFFC0, struct.pack(">BHHB3B", 8, side, side, 1, 1, 0x11, 0)) + _segment(0xFFC4, b"\0" + code + b"\x10" + code) + _segment(0xFFDD, b"\0\1") + _segment(0xFFDA, bytes([1, 1, 0, 0, 63, 0]))


HEAD = _jpeg_head(SIDE)


def jpeg_frame(payload: bytes) -> bytes:
    """A frame that holds FRAME bytes."""
    data = np.frombuffer(payload, np.uint8).reshape(BLOCKS, BLOCK, 1)
    bits = np.concatenate([np.zeros_like(data), np.unpackbits(data, axis=2)], axis=2)
    packed = np.packbits(bits.reshape(BLOCKS, 9 * BLOCK), axis=1)
    marks = np.stack([np.full(BLOCKS, 0xFF), 0xD0 + np.arange(BLOCKS) % 8], axis=1).astype(np.uint8)
    flat = np.concatenate([packed, marks], axis=1).ravel()[:-2]
    if (packed == 0xFF).any():  # a 0 after each such byte of the data
        at = np.flatnonzero(np.concatenate([packed == 0xFF, np.zeros_like(marks, bool)], axis=1).ravel()[:-2])
        flat = np.insert(flat, at + 1, 0)
    return HEAD + flat.tobytes() + b"\xff\xd9"


def frame_coefficients(jpeg: bytes) -> np.ndarray:
    """The quantised coefficients (blocks, 64) in JPEG's order, of a frame with one code and restarts for each block."""
    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG image")
    at, seen = 2, {}
    while True:
        marker, size = struct.unpack_from(">HH", jpeg, at)
        seen[marker] = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFFDA:
            break
    code = bytes([1] + [0] * 15 + [8])
    if seen.get(0xFFC4) != b"\0" + code + b"\x10" + code or seen.get(0xFFDD) != b"\0\1":
        raise ValueError("frames of other Huffman codes or restart intervals aren't read here")
    data = np.frombuffer(jpeg, np.uint8, len(jpeg) - 2 - at, at)
    ends = np.flatnonzero(data[:-1] == 0xFF)
    stuffed = ends[data[ends + 1] == 0] + 1
    marks = ends[(data[ends + 1] >= 0xD0) & (data[ends + 1] <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[stuffed] = drop[marks] = drop[marks + 1] = True
    bits = np.unpackbits(data[~drop].reshape(-1, 9 * BLOCK // 8), axis=1).reshape(-1, BLOCK, 9)
    if bits[:, :, 0].any():
        raise ValueError("a code that the frame doesn't define")
    value = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
    return np.where(value < 128, value - 255, value)


def coefficient_bytes(coefficients: np.ndarray) -> bytes:
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()


def frame_pixels(coefficients: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of all blocks, (blocks, 64), after the inverse transform with the quantisation 1."""
    natural = np.empty(coefficients.shape, np.float64)
    natural[:, ZIGZAG] = coefficients
    plain = COSINE.T @ natural.reshape(-1, 8, 8) @ COSINE
    return np.clip(np.floor(plain / (_SCALE * _SCALE) + 128.5), 0, 255).astype(np.uint8).reshape(-1, 64)


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> list[int]:
    """length << 8 | symbol for each beginning of 16 bits, 0 where no code fits; table: counts of 1 to 16 bits, symbols."""
    out, code, at = [0] * 65536, 0, 16
    for size in range(1, 17):
        for symbol in table[at : at + table[size - 1]]:
            if code >= 1 << size:
                raise ValueError("more Huffman codes than there is room for")
            out[code << (16 - size) : (code + 1) << (16 - size)] = [size << 8 | symbol] * (1 << (16 - size))
            code += 1
        at, code = at + table[size - 1], code << 1
    return out


def _decode_units(data: bytes, units: list[tuple[int, int, list[int], list[int]]], out: list[array]) -> None:
    """Writes the coefficients of the blocks (component, offset in out, DC and AC table) of one restart interval."""
    last, p, end = [0] * len(out), 0, 8 * len(data)
    data += b"\0" * 4
    for c, to, dc, ac in units:
        k, table, own = 0, dc, out[c]
        while k < 64:
            i = p >> 3
            found = table[(int.from_bytes(data[i : i + 3]) >> (8 - (p & 7))) & 0xFFFF]
            if not found or p >= end:
                raise ValueError("a code that the frame doesn't define, or too little data")
            p += found >> 8
            size = found & 15
            if k:
                run = found >> 4 & 15
                if not size and run < 15:
                    break
                k += run
            if k > 63 or k == 0 and found & 255 > 15:
                raise ValueError("a code that baseline frames don't have")
            value = 0
            if size:
                i = p >> 3
                value = (int.from_bytes(data[i : i + 3]) >> (24 - size - (p & 7))) & ((1 << size) - 1)
                if not value >> (size - 1):
                    value -= (1 << size) - 1
                p += size
            if k == 0:
                last[c] += value
                value, table = last[c], ac
            own[to + k] = value
            k += 1
    if p > end:
        raise ValueError("too little data")


def jpeg_samples(jpeg: bytes) -> tuple[np.ndarray, int]:
    """The samples (height, width) of the first component, which is the brightness, and where the image ends.

    Sequential JPEG of 8 bits with Huffman codes, of any tables, quantisation, sampling, restarts and scans; ValueError
    for progressive, lossless, arithmetic and damaged ones.
    """
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, every, parts, out, quant, codes = 2, 0, [], [], {}, dict(STANDARD)
    done: set[int] = set()
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = jpeg[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a segment beyond the frame's end")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if n > len(body):
                    raise ValueError("a Huffman table beyond its segment")
                codes[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if bits != 8 or not height or not width or not parts or any(not 1 <= x <= 4 for p in parts for x in p[1:3]):
                raise ValueError("a frame head that isn't read here")
            wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-width // (8 * wide)), -(-height // (8 * high))
            if across * down > 4 * len(jpeg):  # a block takes two bits at least
                raise ValueError("too little data")
            out = [array("i", bytes(across * down * h * v * 64 * 4)) for _, h, v, _ in parts]
        elif 0xC0 < marker < 0xD0 and marker != 0xC8:
            raise ValueError("not a sequential JPEG image with Huffman codes")
        elif marker == 0xDA:
            stop = m.start() if (m := _SCAN_END.search(jpeg, at)) else len(jpeg)
            numbers = {p[0]: c for c, p in enumerate(parts)}
            mine = [(numbers[body[1 + 2 * k]], _lookup(codes[body[2 + 2 * k] >> 4]), _lookup(codes[0x10 | body[2 + 2 * k] & 15])) for k in range(body[0])]
            groups = []
            if len(mine) == 1:  # blocks in rows, without those that only fill up a unit
                c, dc, ac = mine[0]
                _, h, v, _ = parts[c]
                rows, cols = -(-height * v // (8 * high)), -(-width * h // (8 * wide))
                groups = [[(c, (y * across * h + x) * 64, dc, ac)] for y in range(rows) for x in range(cols)]
            else:
                for y in range(down):
                    for x in range(across):
                        groups.append([(c, ((y * parts[c][2] + j) * across * parts[c][1] + x * parts[c][1] + i) * 64, dc, ac) for c, dc, ac in mine for j in range(parts[c][2]) for i in range(parts[c][1])])
            step = every or len(groups)
            pieces = _RESTART.split(jpeg[at:stop])
            if not groups or len(pieces) < -(-len(groups) // step):
                raise ValueError("too few restart intervals")
            for k in range(0, len(groups), step):
                _decode_units(pieces[k // step].replace(b"\xff\0", b"\xff"), [u for g in groups[k : k + step] for u in g], out)
            done |= {c for c, _, _ in mine}
            at = stop
    if 0 not in done:
        raise ValueError("a frame without a scan of its first component")
    _, h, v, q = parts[0]
    blocks = frame_pixels(np.array(out[0], np.int64).reshape(-1, 64) * quant[q])
    plane = blocks.reshape(down * v, across * h, 8, 8).swapaxes(1, 2).reshape(down * v * 8, across * h * 8)
    return plane[: -(-height * v // high), : -(-width * h // wide)], at + 2


def frame_histogram(frame: bytes) -> np.ndarray:
    """Brightness of all images of a frame, which has two where it is interlaced."""
    total, at = np.zeros(BINS, np.int64), 0
    while at >= 0:
        samples, end = jpeg_samples(frame[at:])
        total += np.bincount(samples.ravel() // (256 // BINS), minlength=BINS)
        at = frame.find(b"\xff\xd8\xff", at + end)
    return total


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(payload: bytes) -> bytes:
    """An AVI file that holds the payload, whose length is a multiple of 64."""
    frames = [jpeg_frame(payload[k : k + FRAME].ljust(FRAME, b"\0")) for k in range(0, len(payload), FRAME)]
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    kind = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", kind)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    body, index, at = [], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        body.append(_chunk(b"00dc", frame))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + note + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def parse_avi(file: bytes) -> tuple[float, int | None, list[tuple[int, int]]]:
    """Frames a second, the payload's length if it is noted, and (offset, size) of each frame of the first video stream.

    Frames are found by the index, whose offsets count from the list of frames or from the file's start; where there is
    none, and in the further parts of files beyond 1 GB, by walking the chunks.
    """
    data = memoryview(file)
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, length, lists, index, streams, video = float(FPS), None, [], b"", 0, None
    for kind, start, size in _walk(data, 0, len(data)):
        if kind != b"RIFF":
            continue
        todo = [(start + 4, min(start + size, len(data)))]
        while todo:
            for name, at, size in _walk(data, *todo.pop(0)):
                if name == b"LIST":
                    if data[at : at + 4] == b"movi":
                        lists.append((at, at + size))
                    else:
                        todo.append((at + 4, at + size))
                elif name == b"strh":
                    if data[at : at + 4] == b"vids" and video is None:
                        scale, rate = struct.unpack_from("<II", data, at + 20)
                        fps, video = rate / max(scale, 1) or float(FPS), streams
                    streams += 1
                elif name == b"ICMT" and bytes(data[at : at + 14]) == b"payload_bytes=":
                    length = int(bytes(data[at + 14 : at + size]).rstrip(b"\0"))
                elif name == b"idx1":
                    index = data[at : at + size]
    if not lists:
        raise ValueError("an AVI file without frames")
    wanted = {b"%02d" % (video or 0) + end for end in (b"dc", b"db")}
    places, movi = [], lists[0][0]
    entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if e[0] in wanted]
    if entries:
        base = next((b for b in (movi, 0) if data[b + entries[0][2] : b + entries[0][2] + 4] == entries[0][0]), None)
        if base is None:
            raise ValueError("an index that doesn't point to frames")
        places = [(base + offset + 8, size) for _, _, offset, size in entries]
    for start, end in lists[bool(entries) :]:
        todo = [(start + 4, end)]
        while todo:
            inner = []
            for name, at, size in _walk(data, *todo.pop(0)):
                if name == b"LIST":  # a group of chunks, data[at : at + 4] is "rec "
                    inner.append((at + 4, at + size))
                elif name in wanted:
                    places.append((at, size))
            todo = inner + todo
    if any(at + size > len(data) for at, size in places):
        raise ValueError("a frame beyond the file's end")
    return fps, length, places


def read_frames(file: bytes) -> tuple[float, bytes | None, np.ndarray]:
    """Frames a second, the payload read back, the histogram of each decoded frame; frame by frame.

    The payload is None where a frame isn't of encode(). An empty frame repeats the one before.
    """
    fps, length, places = parse_avi(file)
    parts, histograms = [], np.zeros((len(places), BINS), np.int64)
    own = True
    for k, (at, size) in enumerate(places):
        frame = file[at : at + size]
        if frame.startswith(HEAD):
            c = frame_coefficients(frame)
            parts.append(coefficient_bytes(c))
            histograms[k] = np.bincount(frame_pixels(c).ravel() // (256 // BINS), minlength=BINS)
        else:
            own = False
            histograms[k] = frame_histogram(frame) if frame else histograms[k - 1] if k else 0
    payload = b"".join(parts)
    return fps, (payload if length is None else payload[:length]) if own else None, histograms


def shots(histograms: np.ndarray, around: int = AROUND) -> list[tuple[int, int]]:
    """(first, end) frames of each shot: a cut lies where the difference to the frame before is over the mean of the
    differences around it plus three deviations, and over a tenth of the samples."""
    n = len(histograms)
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    cuts = [0]
    for k, d in enumerate(steps.tolist()):
        near = np.delete(steps[max(0, k - around) : k + around + 1], min(k, around))
        limit = near.mean() + 3 * near.std() if len(near) else 0
        if d > limit and 10 * d > histograms[k].sum():
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True)) if n else []


def _padded(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): an AVI file of each whole text's UTF-8 bytes, filled with 0 to a multiple of 64.

    A null text is an empty one, stored as 64 bytes of 0. Repeated rows give equal files; other columns are not looked
    at; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                files = [avi(_padded(t.as_py())) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(files, pa.binary())], [key, "n_bytes", "media"])

    if key in ("n_bytes", "media"):
        raise ValueError("the key has the name of a result")
    picked = docs.select(F.col(quoted(key)), F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long"), F.coalesce(F.col(quoted(text)), F.lit("")))
    return map_batches(picked, run, StructType([docs.schema[key], *StructType.fromDDL("n_bytes long, media binary").fields]))


_CLIP = "struct<clip:int,start_s:double,end_s:double,frames:int>"


def read(media: DataFrame) -> DataFrame:
    """media (with a column media) and payload, histogram (of all frames), clips: the timed shots; see clips().

    Any AVI file of sequential motion-JPEG is read; payload is null unless the file is of encode(). A null, a file of
    another kind and a damaged one have null in all three. Columns of media with these names are replaced; all other
    names are free. Rows that repeat are read alike and all stay.
    """
    media = media.drop("payload", "histogram", "clips")
    names = media.columns
    clip = pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())])
    at = names.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                payloads, sums, cuts = [], [], []
                for file in part.column(at):
                    try:
                        fps, payload, h = read_frames(file.as_py() or b"")
                    except (ValueError, LookupError, OverflowError, struct.error):
                        for made in (payloads, sums, cuts):
                            made.append(None)
                        continue
                    payloads.append(payload)
                    sums.append(h.sum(axis=0).tolist())
                    cuts.append([{"clip": n, "start_s": a / fps, "end_s": b / fps, "frames": b - a} for n, (a, b) in enumerate(shots(h))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(sums, pa.list_(pa.int64())), pa.array(cuts, pa.list_(clip))], [*names, "payload", "histogram", "clips"])

    made = StructType.fromDDL(f"payload binary, histogram array<long>, clips array<{_CLIP}>")
    return map_batches(media, run, StructType([*media.schema.fields, *made.fields]))


def clips(media: DataFrame) -> DataFrame:
    """A row for each timed shot: the columns of media but the file, and clip, start_s, end_s, frames.

    A file that can't be read (see read()) or has no frames gives one row with null in these four. Columns of media with
    the name of a result, payload and histogram among them, are replaced; all other names are free.
    """
    own = [c for c in media.columns if c not in ("media", "payload", "histogram", "clips", "clip", "start_s", "end_s", "frames")]
    found = read(media).select(F.struct(*map(quoted, own)).alias("own"), F.inline_outer("clips")) if own else read(media).select(F.inline_outer("clips"))
    return found.select(*[F.col("own")[c].alias(c) for c in own], "clip", "start_s", "end_s", "frames")

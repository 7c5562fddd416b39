"""Media columns: AVI files of motion-JPEG frames, written and read losslessly, and shots found in their frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigtables.llm._text import blocks, column, utf8

#: A frame is a square of so many 8-bit samples a side.
SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Bits of the Huffman code for a difference of 0 to 8 significant bits; differences of letters have 3 to 7.
CODE_BITS = (4, 4, 3, 3, 3, 3, 4, 2, 5)
#: The longest code and its extra bits that the reader takes.
LOOK = 17
BINS = 16


@dataclass(frozen=True)
class Huffman:
    """A JPEG Huffman table: how many codes of each length, and their symbols."""

    counts: bytes
    symbols: bytes

    def codes(self) -> dict[int, tuple[int, int]]:
        """Symbol to (code, bits)."""
        out, code, at = {}, 0, 0
        for bits, n in enumerate(self.counts, 1):
            for _ in range(n):
                out[self.symbols[at]] = code, bits
                code, at = code + 1, at + 1
            code <<= 1
        return out

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """For every LOOK bits: the difference they begin with and how many bits it took (0: none)."""
        value, used = np.zeros(1 << LOOK, np.int16), np.zeros(1 << LOOK, np.int64)
        for s, (code, bits) in self.codes().items():
            if bits + s > LOOK:
                raise ValueError(f"a code and its extra bits take {bits + s} bits; {LOOK} at most are read")
            low, x = LOOK - bits, np.arange(1 << s)
            part = slice(code << low, (code + 1) << low)
            value[part] = np.repeat(np.where(x < (1 << s >> 1), x - (1 << s) + 1, x), 1 << (low - s))
            used[part] = bits + s
        return value, used


def _table() -> Huffman:
    order = sorted(range(len(CODE_BITS)), key=lambda s: (CODE_BITS[s], s))
    return Huffman(bytes(CODE_BITS.count(n) for n in range(1, 17)), bytes(order))


TABLE = _table()
_codes = TABLE.codes()
CODE = np.array([_codes[s][0] for s in range(9)], np.int64)
BITS = np.array([_codes[s][1] for s in range(9)], np.int64)
SIZE_OF = np.array([int(abs(d)).bit_length() for d in range(-255, 256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: What goes before a frame's entropy-coded part: lossless process (SOF3), one component, predictor 1.
HEADER = b"\xff\xd8" + _segment(0xC4, b"\0" + TABLE.counts + TABLE.symbols) + _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG for each of the (n, SIDE, SIDE) uint8 frames."""
    x = samples.astype(np.int64)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    diff = diff.reshape(len(x), -1)
    size = SIZE_OF[diff + 255]
    extra = np.where(diff < 0, diff + (np.int64(1) << size) - 1, diff)
    value, bits = (CODE[size] << size) | extra, BITS[size] + size
    end = np.cumsum(bits, axis=1)
    length = (end[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(length)])
    at = (first[:-1, None] * 8 + end - bits).ravel()
    value = (value << (24 - (at.reshape(bits.shape) & 7) - bits)).ravel()
    byte, total = at >> 3, int(first[-1]) + 2
    out = sum(np.bincount(byte + k, weights=(value >> (16 - 8 * k)) & 255, minlength=total + 2) for k in range(3))[:total].astype(np.uint8)
    pad = length * 8 - end[:, -1]
    out[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out = out[: first[-1]]
    # a zero goes after each 255
    full = np.flatnonzero(out == 255)
    raw = np.insert(out, full + 1, 0).tobytes()
    first += np.searchsorted(full, first)
    return [HEADER + raw[a:b] + b"\xff\xd9" for a, b in zip(first[:-1], first[1:], strict=True)]


def _parse(header: bytes) -> Huffman:
    """The table of a lossless 8-bit one-component frame of SIDE by SIDE samples with predictor 1."""
    at, table = 2, None
    while at < len(header):
        marker, n = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body = header[at + 4 : at + 2 + n]
        if marker == 0xC4:
            table = Huffman(body[1:17], body[17:])
        elif marker == 0xC3 and struct.unpack_from(">BHHB", body) != (8, SIDE, SIDE, 1):
            raise ValueError("another size, precision or number of components")
        elif marker in {0xC0, 0xC1, 0xC2}:
            raise ValueError("not a lossless frame")
        elif marker == 0xDA and body[3] != 1:
            raise ValueError("another predictor")
        at += 2 + n
    if table is None:
        raise ValueError("no Huffman table")
    return table


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The (n, SIDE, SIDE) samples of lossless JPEGs; all frames are decoded side by side, a sample at a time."""
    out = np.empty((len(frames), SIDE, SIDE), np.uint8)
    same: dict[bytes, list[int]] = {}
    bodies = []
    for i, f in enumerate(frames):
        if f[:2] != b"\xff\xd8" or f[-2:] != b"\xff\xd9":
            raise ValueError("not a JPEG")
        if f.startswith(HEADER):
            head = len(HEADER)
        else:
            head = 2
            while f[head + 1] != 0xDA:
                head += 2 + struct.unpack_from(">H", f, head + 2)[0]
            head += 2 + struct.unpack_from(">H", f, head + 2)[0]
        same.setdefault(f[:head], []).append(i)
        bodies.append(f[head:-2])
    for header, at in same.items():
        if header not in _tables:
            if len(_tables) > 16:
                _tables.clear()
            _tables[header] = _parse(header).lookup()
        value, used = _tables[header]
        own = [bodies[i] for i in at]
        raw = np.frombuffer(b"".join(own) + b"\xff\xff\xff\xff", np.uint8)
        stuffed = np.zeros(len(raw), bool)
        stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
        first = np.concatenate([[0], np.cumsum([len(b) for b in own])])[:-1]
        first -= np.searchsorted(np.flatnonzero(stuffed), first)
        data = raw[~stuffed].astype(np.int64)
        data = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        pos, diff, last = first * 8, np.empty((FRAME, len(at)), np.int16), len(data) - 1
        for k in range(FRAME):
            look = (data[np.minimum(pos >> 3, last)] >> (32 - LOOK - (pos & 7))) & ((1 << LOOK) - 1)
            diff[k] = value[look]
            pos += used[look]
        d = diff.T.reshape(len(at), SIDE, SIDE).astype(np.int64)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        out[at] = np.cumsum(d, axis=2).astype(np.uint8)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, SIDE, SIDE)
    kind = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", kind)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index names, or without an index all chunks of the movi list; and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, todo = 0.0, None, None, [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", data, at)
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8, at + 8 + n
            elif name == b"LIST":
                todo.append((at + 12, at + 8 + n))
            elif name == b"avih":
                fps = 1e6 / (struct.unpack_from("<I", data, at + 8)[0] or 1e6)
            elif name == b"idx1":
                index = at + 8, n // 16
            at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        found = np.frombuffer(data, "<u4", index[1] * 4, index[0]).reshape(-1, 4)
        base = movi[0] if not len(found) or found[0, 2] < movi[0] else 0  # some writers count from the file's start
        return [data[o + 8 : o + 8 + n] for o, n in zip((found[:, 2].astype(np.int64) + base).tolist(), found[:, 3].tolist(), strict=True)], fps
    frames, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] == b"dc":
            frames.append(data[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return frames, fps


def shots(frames: np.ndarray, reach: int = 8, times: float = 3.0, floor: float = 0.2) -> list[tuple[int, int]]:
    """Ranges of frames between cuts.

    A cut is where the histograms of neighbouring frames differ by more than `times` standard deviations above the mean
    of the differences up to `reach` places around, and by `floor` of the samples.
    """
    n = len(frames)
    if n < 2:
        return [(0, n)] if n else []
    bins = np.bincount((np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(bins, axis=0)).sum(axis=1) / (2 * frames[0].size)
    one, sq = (np.concatenate([[0.0], np.cumsum(v)]) for v in (d, d * d))
    k = np.arange(len(d))
    lo, hi = np.maximum(k - reach, 0), np.minimum(k + reach + 1, len(d))
    m = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - d) / m
    sd = np.sqrt(np.maximum((sq[hi] - sq[lo] - d * d) / m - mean * mean, 0))
    cuts = np.flatnonzero(d > np.maximum(mean + times * sd, floor)) + 1
    at = [0, *cuts.tolist(), n]
    return list(zip(at, at[1:], strict=False))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the UTF-8 bytes of each text, filled with 255 to a positive multiple of FRAME, as an AVI.

    A null text counts as empty and gives one frame. Equal texts give equal files; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch)
            for lo, hi in blocks(texts, 2 << 20):
                n = [max(1, -(-len(t) // FRAME)) for t in texts[lo:hi]]
                raw = b"".join(t.ljust(k * FRAME, b"\xff") for t, k in zip(texts[lo:hi], n, strict=True))
                frames = encode_frames(np.frombuffer(raw, np.uint8).reshape(-1, SIDE, SIDE))
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([write_avi(frames[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _decoded(files: list[bytes]) -> Iterator[tuple[int, np.ndarray, float]]:
    """(number of the file, its samples, frames a second), decoding many files at a time."""
    for lo, hi in blocks(files, 3 << 20):
        read = [read_avi(f) for f in files[lo:hi]]
        x = decode_frames([f for frames, _ in read for f in frames])
        at = 0
        for i, (frames, fps) in enumerate(read, lo):
            yield i, x[at : at + len(frames)], fps
            at += len(frames)


def clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each shot of each AVI in the column media: key, clip, first_frame, n_frames, start_s and end_s.

    A null file or one without frames has no row; a damaged file raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [(k, f) for k, f in zip(column(batch, key), column(batch, "media"), strict=True) if f is not None]
            rows = [(have[i][0], k, a, b - a, a / fps, b / fps) for i, x, fps in _decoded([f for _, f in have]) for k, (a, b) in enumerate(shots(x))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], [key, "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return media.select(key, "media").mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, clip int, first_frame long, n_frames long, start_s double, end_s double")


def describe(media: DataFrame) -> DataFrame:
    """What is read back from the files of store_texts(): sums of the samples and of the file, and the shots as a feature.

    A null file has its row with nulls; a file without frames has no bytes and no shots; repeated rows stay; a damaged file
    raises.
    """
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows = column(batch, "media"), [(None,) * len(kinds)] * batch.num_rows
            have = [i for i, f in enumerate(files) if f is not None]
            for i, x, fps in _decoded([files[i] for i in have]):
                payload, found, file = x.tobytes(), shots(x), files[have[i]]
                feature = f"frames={len(x)} shots={len(found)} clips=" + ",".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in found)
                rows[have[i]] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

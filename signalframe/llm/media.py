"""Media columns: bytes kept losslessly in AVI motion-JPEG, read back through the RIFF index, and cut into shots.

Every 64 payload bytes are one 8x8 block. The format's unit here is the quantised coefficient (all quantisers 1): byte b
is the coefficient b if b >= 128, else b - 255, exactly the values of JPEG's size category 8, whose eight magnitude bits
are the byte itself. The Huffman tables name that one category with the one-bit code 0, so a block's scan data is 64
groups of nine bits, and both directions are array operations. A restart marker after each block resets the DC
prediction. Pixels come from an integer-valued inverse DCT that float32 sums exactly, so results don't depend on the
machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalframe.llm.common import narrowed, pieces
from signalframe.scratch import written

BLOCK = 64
MOST_ACROSS = 8
FPS = 25
GROUP_BLOCKS = 1 << 13
SCALE = 1 << 12
BINS = 32
SHOT_WINDOW = 24
SHOT_SIGMA = 3.0
SHOT_FLOOR = 0.15
SOI, EOI, DQT, SOF0, DHT, SOS, DRI = 0xD8, 0xD9, 0xDB, 0xC0, 0xC4, 0xDA, 0xDD
#: JPEG's zigzag order (fixed by the format), from its rule: anti-diagonals, alternately turned.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _idct() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: pixels; values rounded to 1/SCALE."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.stack([np.rint(np.outer(one[r], one[c]) * SCALE).ravel() for r, c in ZIGZAG]).astype(np.float32)


IDCT = _idct()


class Shape(NamedTuple):
    across: int
    down: int

    @property
    def blocks(self) -> int:
        return self.across * self.down


def shape_of(blocks: int) -> Shape:
    across = min(MOST_ACROSS, blocks)
    return Shape(across, min(MOST_ACROSS, -(-blocks // across)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(shape: Shape) -> bytes:
    table = bytes([1, *[0] * 15, 8])  # one code of one bit, for category 8 (run 0)
    return b"".join([
        bytes([0xFF, SOI]),
        _segment(DQT, bytes([0, *[1] * 64])),
        _segment(SOF0, struct.pack(">BHHB3B", 8, shape.down * 8, shape.across * 8, 1, 1, 0x11, 0)),
        _segment(DHT, b"\x00" + table),
        _segment(DHT, b"\x10" + table),
        _segment(DRI, struct.pack(">H", 1)),
        _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _scans(blocks: np.ndarray, per_frame: int) -> list[bytes]:
    """Entropy-coded data of whole frames, with restart markers, stuffing and the end marker."""
    n = len(blocks)
    bits = np.zeros((n, BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks.reshape(n, BLOCK, 1), axis=2)
    data = np.empty((n, 74), np.uint8)
    data[:, :72] = np.packbits(bits.reshape(n, -1), axis=1)
    within = np.arange(n) % per_frame
    data[:, 72] = 0xFF
    data[:, 73] = np.where(within == per_frame - 1, EOI, 0xD0 + within % 8)
    full = data == 0xFF
    full[:, 72] = False
    if not full.any():
        return [f.tobytes() for f in data.reshape(-1, per_frame * 74)]
    times = 1 + full.astype(np.int64)
    flat = np.repeat(data.ravel(), times.ravel())
    flat[np.cumsum(times.ravel())[full.ravel()] - 1] = 0
    ends = np.cumsum(times.reshape(-1, per_frame * 74).sum(axis=1)).tolist()
    return [flat[a:b].tobytes() for a, b in zip([0, *ends], ends)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames that hold the payload (a positive multiple of 64 bytes)."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    shape = shape_of(len(blocks))
    frames = -(-len(blocks) // shape.blocks)
    head, movi, index, at = _jpeg_head(shape), [], [], 4
    step = max(1, GROUP_BLOCKS // shape.blocks) * shape.blocks
    for first in range(0, frames * shape.blocks, step):
        part = blocks[first : first + step]
        short = -len(part) % shape.blocks
        if short:
            part = np.concatenate([part, np.zeros((short, BLOCK), np.uint8)])
        for scan in _scans(part, shape.blocks):
            chunk = _chunk(b"00dc", head + scan)
            index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(head) + len(scan)))
            at += len(chunk)
            movi.append(chunk)
    width, height = shape.across * 8, shape.down * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISFT", b"blocks=%d" % len(blocks)))
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


class Avi(NamedTuple):
    shape: Shape
    fps: float
    blocks: int
    frames: list[memoryview]


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError(f"chunk {kind!r} passes its parent's end")
        yield bytes(kind), at + 8, size
        at += 8 + size + size % 2


def parse_avi(media: bytes) -> Avi:
    """RIFF lists and the idx1 index; frames are found through the index."""
    data = memoryview(media)
    kind, size, form = struct.unpack_from("<4sI4s", data)
    if (kind, form) != (b"RIFF", b"AVI "):
        raise ValueError("not an AVI file")
    shape, fps, blocks, movi, index = None, 0.0, 0, 0, b""
    for kind, at, size in _chunks(data, 12, 8 + size):
        form = bytes(data[at : at + 4]) if kind == b"LIST" else b""
        if form == b"hdrl":
            for k, a, _ in _chunks(data, at + 4, at + size):
                if k == b"avih":
                    head = struct.unpack_from("<14I", data, a)
                    fps, shape = 1e6 / head[0], Shape(head[8] // 8, head[9] // 8)
        elif form == b"INFO":
            for k, a, s in _chunks(data, at + 4, at + size):
                if k == b"ISFT":
                    blocks = int(bytes(data[a : a + s]).partition(b"=")[2])
        elif form == b"movi":
            movi = at
        elif kind == b"idx1":
            index = data[at : at + size]
    frames = []
    for kind, _, offset, size in struct.iter_unpack("<4s3I", index):
        at = movi + offset
        if bytes(data[at : at + 4]) != kind or struct.unpack_from("<I", data, at + 4)[0] != size:
            raise ValueError("idx1 points at no such chunk")
        frames.append(data[at + 8 : at + 8 + size])
    return Avi(shape, fps, blocks, frames)


def frame_blocks(frame: memoryview, shape: Shape) -> np.ndarray:
    """A frame's blocks as (n, 64) bytes. Tables other than this module's own profile are refused."""
    at, tables = 2, 0
    while True:
        _, marker, size = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        if marker == DHT:
            if bytes(body[1:]) != bytes([1, *[0] * 15, 8]):
                raise ValueError("Huffman table outside the stored profile")
            tables += 1
        elif marker == SOF0 and struct.unpack_from(">BHH", body)[1:] != (shape.down * 8, shape.across * 8):
            raise ValueError("frame size differs from the file's")
        at += 2 + size
        if marker == SOS:
            break
    if tables != 2:
        raise ValueError("missing Huffman tables")
    scan = np.frombuffer(frame[at:], np.uint8)
    full = np.flatnonzero(scan[:-1] == 0xFF)
    stuffed = scan[full + 1] == 0
    drop = np.concatenate([full + 1, full[~stuffed]])
    plain = np.delete(scan, drop)
    bits = np.unpackbits(plain.reshape(shape.blocks, 72), axis=1).reshape(-1, BLOCK, 9)
    if bits[:, :, 0].any():
        raise ValueError("broken entropy data")
    return np.packbits(bits[:, :, 1:], axis=2)[:, :, 0]


def luma(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, 64 stored bytes) -> 8-bit pixels (n, 64)."""
    value = blocks.astype(np.float32)
    value[blocks < 128] -= 255
    return np.clip(((value @ IDCT).astype(np.int32) + (128 * SCALE + SCALE // 2)) >> 12, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray, pixels: int) -> list[tuple[int, int]]:
    """(first, last) frames of shots. A cut: the histogram's change passes the shot's recent mean by SHOT_SIGMA deviations."""
    moved = (np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(axis=1) / (2 * pixels)).tolist()
    cuts, recent = [0], []
    for frame, change in enumerate(moved, 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if len(recent) >= 2 and change > max(SHOT_FLOOR, mean + SHOT_SIGMA * spread):
            cuts.append(frame)
            recent = []
        else:
            recent = [*recent, change][-SHOT_WINDOW:]
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(histograms)])]


class Read(NamedTuple):
    payload: bytes
    clips: list[tuple[int, int]]
    feature: str
    fps: float


def read_avi(media: bytes) -> Read:
    """The payload, its clips and a feature text: shape, frames, clip starts, mean and peak luma bin."""
    avi = parse_avi(media)
    kept, tables = [], []
    each = max(1, GROUP_BLOCKS // avi.shape.blocks)
    for first in range(0, len(avi.frames), each):
        group = avi.frames[first : first + each]
        blocks = np.concatenate([frame_blocks(f, avi.shape) for f in group])
        kept.append(blocks.tobytes())
        level = (luma(blocks) >> 3).reshape(len(group), -1).astype(np.int64)
        level += np.arange(len(group))[:, None] * BINS
        tables.append(np.bincount(level.ravel(), minlength=len(group) * BINS).reshape(-1, BINS))
    histograms = np.concatenate(tables)
    clips = shots(histograms, avi.shape.blocks * BLOCK)
    total = histograms.sum(axis=0)
    mean = int((total * np.arange(BINS)).sum() * 1000 // total.sum())
    starts = hashlib.md5(",".join(str(a) for a, _ in clips).encode()).hexdigest()[:12]
    feature = f"{avi.shape.across * 8}x{avi.shape.down * 8} frames={len(avi.frames)} clips={len(clips)} cuts={starts} luma={mean} peak={int(total.argmax())}"
    return Read(b"".join(kept)[: avi.blocks * BLOCK], clips, feature, avi.fps)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, zero-padded to 64, as an AVI file, written as a table. Null is empty.

    A RIFF size has 32 bits, so a file ends at 4 GiB; a text of Spark's 2 GiB at most would pass that only by its 9/8
    growth and frame headers together, and then packing it raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_avi(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(narrowed(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", "zstd")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of a media column: doc_id, clip, first_frame, last_frame, start_s, end_s.

    Clips of a row meet and cover all of its frames, at any length; a row has one at least, also where its text was null or
    empty (one block of zeros). A null doc_id stays null; repeated rows each have their clips; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20, "media"):
            rows = [(d, i, a, b, a / r.fps, (b + 1) / r.fps) for d, m in zip(batch.column(0).to_pylist(), batch.column(1)) for r in [read_avi(m.as_py())] for i, (a, b) in enumerate(r.clips)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double")


def media_features(media: DataFrame) -> DataFrame:
    """One row per media row, all from the stored bytes: payload and media sizes and digests, feature, frames' clips.

    Equal media give equal values; a null or empty text is one block of zeros; a null doc_id stays null; repeated rows each
    come back; texts of any length are read whole; an empty table gives an empty result.
    """
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20, "media"):
            rows = []
            for doc_id, n, scalar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                stored = scalar.as_py()
                got = read_avi(stored)
                rows.append((doc_id, n, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), got.feature, len(got.clips)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in out.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)

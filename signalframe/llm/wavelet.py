"""Token ids in wavelet-matrix files, one per shard: bit planes with rank counts, readable without other files.

File: b"WVM2"; header (documents, tokens, alphabet size, planes, frames as uint32); the byte length of each zstd frame
(uint32); then the frames. Frame 0 holds doc ids (int64, with a null flag byte each), token counts (uint32), the
alphabet (ids in use, ascending, uint32) and zeros per plane (uint32). Each plane follows as one frame of running counts
of ones (uint32, one per SUPER bits) and frames of FRAME bits each (little bit order, padded to whole 64-bit words). So
one access, rank or select inflates one small frame a plane at most, not the file.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import Memory, pieces
from signalframe.llm.ordering import in_order
from signalframe.scratch import written

MAGIC = b"WVM2"
END_ID = 1
SHARD_TOKENS = 1 << 21
SUPER, FRAME = 1 << 9, 1 << 16


class WordEncoder:
    """Word (bytes) -> its ids under a word-level BPE tokenizer of the tokenizers library, as little-endian 16-bit numbers.

    A tokenizer that composes (NFC), lower-cases, drops white space and cuts by a pattern that looks at no neighbours
    gives a text the ids of its words, one after another. Words below U+0250 are lower-cased, cut by that pattern and
    handed to the library's BPE model (composing changes none of them, and one lower-case letter stands for each but the
    dotted capital I, which is left out); any other word goes through the library's whole pipeline. A file of any other
    shape has whole texts encoded by the library. The last ``most`` to twice as many words are remembered.
    """

    LATIN_END, DOTTED = "\u0250", "\u0130"

    def __init__(self, path: str, most: int = 400_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.known = Tokenizer.from_file(path), Memory(self._fresh, most)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_word = self._is_by_word(made)
        if not self.by_word:
            return
        self.model = self.whole.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

        class Spelt(dict):
            def __missing__(self, point: int) -> str:
                self[point] = spell(chr(point))[0][0]
                return self[point]

        self.spelt = Spelt()
        self.cut = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    @staticmethod
    def _is_by_word(made: dict) -> bool:
        """Whether normalizer, pre-tokenizer and model are of the one shape that words can be encoded apart under."""
        steps = (made.get("normalizer") or {}).get("normalizers", [])
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and made["model"]["type"] == "BPE" and not made["model"]["dropout"]
            and not made["truncation"] and not made["padding"] and not made["post_processor"]
            and all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and x["content"].startswith("<|") and len(x["content"].split()) == 1 for x in made["added_tokens"])
        )

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() and part.isprintable() else part.translate(self.spelt)
        return np.array([t.id for t in self.model.tokenize(spelt)], "<u2").tobytes()

    def _fresh(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if not text or max(text) >= self.LATIN_END or self.DOTTED in text or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        low = text.lower()
        if low.isalpha():
            return self.known[low.encode()] if low != text else self._part(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return self.known[low[:-1].encode()] + self.known[low[-1:].encode()]
        parts = self.cut(low)
        return self._part(low) if parts == [low] else b"".join([self.known[p.encode()] for p in parts])

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.known.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker, so that the tasks it runs one after another share its words."""
    return WordEncoder(path)


def build(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The file of these documents; ids is all their tokens in a row."""
    present = np.flatnonzero(np.bincount(ids, minlength=1)) if len(ids) else np.empty(0, np.int64)
    code = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint16)
    code[present] = np.arange(len(present))
    seq, planes = code[ids], max(1, int(len(present) - 1).bit_length()) if len(present) else 0
    words, zeros = -(-len(ids) // 64), []
    pack = zstandard.ZstdCompressor(level=1).compress
    body: list[bytes] = []
    for k in range(planes - 1, -1, -1):
        bits = (seq & np.uint16(1 << k)).astype(bool)
        packed = np.zeros(words * 8, np.uint8)
        packed[: -(-len(ids) // 8)] = np.packbits(bits, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(packed.view(np.uint64)).astype(np.uint32), np.arange(0, words, SUPER // 64))
        high = np.compress(bits, seq)
        seq = np.concatenate([np.compress(~bits, seq), high])
        zeros.append(len(ids) - len(high))
        raw = packed.tobytes()
        body += [pack((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()), *(pack(raw[at : at + FRAME // 8]) for at in range(0, len(raw), FRAME // 8))]
    flags = bytes(d is None for d in doc_ids)
    first = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), flags, np.array(counts, "<u4").tobytes(), present.astype("<u4").tobytes(), np.array(zeros, "<u4").tobytes()]
    body.insert(0, pack(b"".join(first)))
    head = struct.pack("<5I", len(counts), len(ids), len(present), planes, len(body))
    return MAGIC + head + np.array([len(x) for x in body], "<u4").tobytes() + b"".join(body)


class WaveletFile:
    """Reads one file: token access, counts (rank) and occurrences (select), and all tokens at once."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        docs, self.n, alphabet, self.planes, frames = struct.unpack_from("<5I", data, 4)
        ends = np.cumsum(np.frombuffer(data, "<u4", frames, 24), dtype=np.int64) + 24 + 4 * frames
        self._data, self._ends, self._inflate = memoryview(data), ends.tolist(), zstandard.ZstdDecompressor().decompress
        self._first, self._held = 24 + 4 * frames, {}
        self._each = 1 + -(-self.n // FRAME)  # frames of a plane
        raw, at = self._frame(0), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.counts, self.alphabet, self.zeros = take("<u4", docs), take("<u4", alphabet), take("<u4", self.planes)

    def _frame(self, i: int) -> bytes:
        return self._inflate(self._data[self._ends[i - 1] if i else self._first : self._ends[i]])

    def _numbers(self, plane: int, part: int, kind: str) -> np.ndarray:
        """Part 0: running counts; part i: the i-th frame of bits. What was inflated stays at hand."""
        i = 1 + plane * self._each + part
        if i not in self._held:
            self._held[i] = np.frombuffer(self._frame(i), kind)
        return self._held[i]

    def _bits(self, plane: int, i: int) -> np.ndarray:
        return self._numbers(plane, 1 + i // FRAME, "<u8")

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        words, at = self._bits(plane, i), i % FRAME // 64
        ahead = words[at - at % (SUPER // 64) : at]
        return int(self._numbers(plane, 0, "<u4")[i // SUPER]) + int(np.bitwise_count(ahead).sum()) + (int(words[at]) & ((1 << i % 64) - 1)).bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.planes):
            one = int(self._bits(p, i)[i % FRAME // 64]) >> i % 64 & 1
            code = code << 1 | one
            i = int(self.zeros[p]) + self._rank1(p, i) if one else i - self._rank1(p, i)
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def rank(self, token: int, end: int) -> int:
        """How often token stands among the first ``end`` tokens."""
        code, lo, hi = self._code(token), 0, min(end, self.n)
        if code is None:
            return 0
        for p in range(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if code >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return hi - lo

    def _select_in(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit: a search over the running counts, then at most SUPER / 64 words."""
        before = self._numbers(plane, 0, "<u4")
        held = lambda s: int(before[s]) if bit else s * SUPER - int(before[s])
        i = (bisect_right(range(len(before)), k, key=held) - 1) * SUPER
        left, words = k - held(i // SUPER), self._bits(plane, i)
        for at in range(i % FRAME // 64, len(words)):
            word = int(words[at]) if bit else ~int(words[at]) & (1 << 64) - 1
            if left >= (inside := word.bit_count()):
                left -= inside
                continue
            for _ in range(left):
                word &= word - 1
            return i - i % FRAME + at * 64 + (word & -word).bit_length() - 1
        raise IndexError(k)

    def select(self, token: int, k: int) -> int:
        """Position of token's k-th occurrence, from 0."""
        code = self._code(token)
        if code is None or not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        lo = 0
        for p in range(self.planes):
            a = self._rank1(p, lo)
            lo = int(self.zeros[p]) + a if code >> (self.planes - 1 - p) & 1 else lo - a
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - p) & 1
            i = self._select_in(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes' stable partitions undone from the last to the first."""
        code = np.zeros(self.n, np.uint16)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(self._frame(1 + p * self._each + part) for part in range(1, self._each))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little")
            ones = np.cumsum(bits, dtype=np.int32)
            at = np.where(bits, ones + np.int32(int(self.zeros[p]) - 1), np.arange(self.n, dtype=np.int32) - ones)
            code = code[at] | (bits.astype(np.uint16) << np.uint16(self.planes - 1 - p))
        return self.alphabet[code] if self.n else np.empty(0, np.uint32)


def write_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes the documents in doc_id order into wavelet files of about SHARD_TOKENS, written as a table.

    One row per file: pid and seq (their order is the documents' order), n_tokens, and the file itself. A document is
    never split; END_ID closes each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, encoder = TaskContext.get().partitionId(), 0, encoder_of(tokenizer)
        end = np.array([END_ID], "<u2").tobytes()
        ids, doc_ids, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            file = build(doc_ids, counts, np.frombuffer(b"".join(ids), "<u2"))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((pid, pa.int32()), (seq, pa.int32()), (held, pa.int64()), (file, pa.binary()))], ["pid", "seq", "n_tokens", "file"])

        for batch in pieces(batches, 4 << 20):
            for doc_id, got in zip(batch.column(0).to_pylist(), map(encoder.encode, batch.column(1).to_pylist())):
                ids += [got, end]
                doc_ids.append(doc_id)
                counts.append(len(got) // 2 + 1)
                held += counts[-1]
                if held >= SHARD_TOKENS:
                    yield flush()
                    ids, doc_ids, counts, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    return written(in_order(docs).mapInArrow(encode, "pid int, seq int, n_tokens long, file binary"), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """From the files: pid, seq, doc_id, local start, n_tokens, ids_crc32 per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, seq, scalar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                file = WaveletFile(scalar.as_py())
                data, counts = memoryview(file.tokens().astype("<u4").tobytes()), file.counts.astype(np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["pid", "seq", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("pid", "seq", "file").mapInArrow(read, "pid int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document, from the files read back: doc_id, start (ids before it), n_tokens, ids_crc32.

    Order is by doc_id, nulls last, equal ids by text. Null and empty texts hold the end id alone. Repeated rows each
    have their place. An empty table writes no file.
    """
    shards = write_shards(docs, tokenizer)
    sizes = shards.select("pid", "seq", "n_tokens")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_pid = sizes.groupBy("pid").agg(F.sum("n_tokens").alias("n"))  # a row per partition
    outer = by_pid.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    offsets = sizes.withColumn("inner", inner).join(outer, "pid").select("pid", "seq", (F.col("inner") + F.col("outer")).alias("base"))
    return read_shards(shards).join(offsets, ["pid", "seq"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

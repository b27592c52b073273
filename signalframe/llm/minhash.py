"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each word is hashed once and each shingle's hash is a mixed polynomial of its words'; its top bits choose one of BINS bins, and a bin keeps its least hash. An
empty bin copies a filled one found by a seeded two-universal probe that depends on the bin and the attempt alone, so
equal texts agree. Only the low four bits of each bin are stored, one hex digit a bin; likeness is the share of equal
digits corrected for the 1/16 that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import Memory, pieces
from signalframe.llm.ordering import in_order
from signalframe.scratch import written

BINS = 256
WORDS = 5
SEED = 11
CHANCE = 1 / 16
MOST_PROBES = 4096  # later probes would all but surely have met a filled bin; then the first filled one serves
BATCH_BYTES = 4 << 20
NO_WORD = b" "  # stands for each word that a text lacks of its only shingle
PRIME = (1 << 31) - 1


@cache
def probes() -> np.ndarray:
    """(attempts, BINS), two-universal: for every bin the bin it asks at each attempt."""
    attempt = np.arange(MOST_PROBES, dtype=np.int64)[:, None]
    a = 1 + (attempt * 2654435761 + SEED) % (PRIME - 1)
    b = (attempt * 40503 + SEED * 7919) % PRIME
    return ((a * np.arange(1, BINS + 1, dtype=np.int64) + b) % PRIME % BINS).astype(np.uint8)


@cache
def word_hashes() -> Memory:
    """Word -> XXH64, one memory a Python worker."""
    return Memory(lambda word: xxhash.xxh64_intdigest(word, SEED), 300_000)


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every shingle: a polynomial of its words' hashes, mixed. Fewer words make one shingle."""
    found = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    found = [w if len(w) >= WORDS else w + [NO_WORD] * (WORDS - len(w)) for w in found]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    word = np.fromiter(map(word_hashes().__getitem__, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(word) - WORDS + 1)
    h = word[:n].copy()
    for i in range(1, WORDS):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word[i : n + i]
    whole = owner[:n] == owner[WORDS - 1 :]
    h = h[whole]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31), owner[:n][whole]


def bins_of(texts: list[str]) -> np.ndarray:
    """(texts, BINS): the low four bits of each densified bin."""
    hashes, owner = shingle_hashes(texts)
    bins = owner * BINS + (hashes >> np.uint64(56)).astype(np.int64)
    least = np.full(len(texts) * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, bins, hashes)
    filled = np.zeros(len(least), bool)
    filled[bins] = True
    value, todo, attempt = least.copy(), np.flatnonzero(~filled), 0
    while len(todo):
        at = todo % BINS
        donor = todo - at + (probes()[attempt][at] if attempt < MOST_PROBES else filled.reshape(-1, BINS).argmax(axis=1)[todo // BINS])
        good = filled[donor]
        value[todo[good]] = least[donor[good]]
        todo, attempt = todo[~good], attempt + 1
    return (value & np.uint64(15)).astype(np.uint8).reshape(-1, BINS)


def written_out(bins: np.ndarray) -> list[str]:
    """One hex digit a bin."""
    return [row.tobytes().hex() for row in bins[:, ::2] << 4 | bins[:, 1::2]]


def fingerprint(text: str) -> str:
    return written_out(bins_of([text]))[0]


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of two fingerprints' bins, row by row, 0 to 1: equal bins, less those equal by chance."""
    return np.clip(((a == b).mean(axis=1) - CHANCE) / (1 - CHANCE), 0.0, 1.0)


def likeness(a: str, b: str) -> float:
    return float(likenesses(*(np.array([list(x)]) for x in (a, b)))[0])


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(texts: list[str], bins: np.ndarray, following: list[str], next_bins: np.ndarray) -> list[tuple]:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each text."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = bins_of(changed)
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]
    near = likenesses(bins, other).tolist(), likenesses(bins, next_bins).tolist()
    return list(zip(map(len, texts), sha, written_out(bins), written_out(other), *near))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STEP = f"kind int, pid int, {RESULT}, text string"
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order. kind 0: the partition's first text. 1: a finished row. 2: its last row, whose next is elsewhere."""
    pid, ids, texts, bins = TaskContext.get().partitionId(), [], [], np.empty((0, BINS), np.uint8)
    blank = (None,) * 5
    schema = _schema(STEP)
    for batch in pieces(batches, BATCH_BYTES):
        if not batch.num_rows:
            continue
        new = batch.column(1).to_pylist()
        new_bins = bins_of(new)
        if not ids:
            yield _batch([(0, pid, None, None, None, written_out(new_bins[:1])[0], *blank[:3], new[0])], schema)
        ids, texts, bins = ids + batch.column(0).to_pylist(), texts + new, np.concatenate([bins, new_bins])
        rows = [(1, pid, d, *pair, None) for d, pair in zip(ids, _pairs(texts[:-1], bins[:-1], texts[1:], bins[1:]))]
        if rows:
            yield _batch(rows, schema)
        ids, texts, bins = ids[-1:], texts[-1:], bins[-1:]
    if ids:
        yield _batch([(2, pid, ids[0], None, None, written_out(bins)[0], *blank[:3], texts[0])], schema)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, next text -> results: the rows at the ends of partitions."""
    for batch in pieces(batches, BATCH_BYTES):
        texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows = [(d, *pair) for d, pair in zip(batch.column(0).to_pylist(), _pairs(texts, bins_of(texts), following, bins_of(following)))]
        if rows:
            yield _batch(rows, _schema(RESULT))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and likeness to that and to the next document.

    Next is by descending doc_id (nulls last, equal ids by a hash of the text, then by text); after the last comes the first. Null texts count as
    empty; texts without words share one fingerprint; fewer than five words make one shingle. A table of one row has
    itself as next; an empty one gives an empty result.
    """
    scanned = written(in_order(docs, descending=True).mapInArrow(_scan, STEP), "minhash")
    heads = scanned.where("kind = 0").select("pid", F.col("text").alias("next_text"))
    whole = Window.orderBy("pid")  # a row per partition
    follow = heads.select("pid").select(
        "pid", F.coalesce(F.lead("pid").over(whole), F.min("pid").over(Window.partitionBy(F.lit(1)))).alias("next_pid")
    )
    last = (
        scanned.where("kind = 2").select("pid", "doc_id", "text").join(follow, "pid")
        .join(heads.withColumnRenamed("pid", "next_pid"), "next_pid")
        .select("doc_id", "text", "next_text")
        .mapInArrow(_finish, RESULT)
    )
    return scanned.where("kind = 1").select(*_schema(RESULT).names).unionByName(last)

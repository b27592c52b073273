"""Spelling variants: words one inserted, deleted or replaced letter apart, and the common form each belongs to.

Two words that differ by one edit agree before it and after it: their common prefix plus their common suffix reaches the
longer word's length minus one. Which words may be so near is found by cutting the shorter length m into pieces of WIDTH
letters: the edit falls into one piece, so both words hold the same letters before and after that piece. Every word goes
to the blocks of all pieces, as the shorter or as the longer one, and a block's words are compared densely, TILE by TILE,
as padded matrices of code points. WIDTH letters are open in a block, so its size is bounded by the alphabet, not by the
corpus; a pair is reported only in the block of the piece where its prefix ends, so no pair comes twice.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed, pieces
from signalframe.scratch import written

LEAST_LENGTH, LEAST_COUNT, AHEAD = 6, 5, 5  # a form is AHEAD times as frequent
DROPPED = 199  # of so many (document, run) pairs one loses a letter
WIDTH, TILE = 2, 128
HELD = 300_000  # distinct words a task counts before it hands them on

#: Code points of letters as bytes: A-Z in lower case, a-z and U+00C0 to U+00FF stay, all else parts runs.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The text's letter runs of LEAST_LENGTH and more, a byte a code point, A-Z lower-cased."""
    return [r for r in text.encode("latin-1", "replace").translate(_KEPT).split() if len(r) >= LEAST_LENGTH]


def altered(doc_id: int | None, run: bytes) -> bytes:
    """The run, or without one letter if its hash with the document says so. No doc_id counts as an empty one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run.decode('latin-1')}".encode())
    return run if h % DROPPED else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the altered runs of all documents, at least LEAST_COUNT times. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            kept = {w: n for w, n in counted.items() if n and len(w) >= LEAST_LENGTH}
            counted.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        counted: Counter = Counter()
        for batch in pieces(batches, 4 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = runs(text)
                counted.update(found)
                seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for r in set(found):
                    if not zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), seed) % DROPPED:
                        times = found.count(r)
                        counted[r] -= times
                        counted[altered(doc_id, r)] += times
            if len(counted) > HELD:
                yield rows()
        yield rows()

    parts = narrowed(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return written(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "spelling-words")


def blocked(words: DataFrame) -> DataFrame:
    """A row per (word, m, start of a piece): block is a hash of m, the start and the letters outside the piece."""
    length = F.length("word")
    m = F.explode(F.filter(F.array(length, length - 1), lambda k: k >= LEAST_LENGTH)).alias("m")
    rows = words.select("word", "n", m).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(WIDTH))))
    after = F.greatest(F.col("m") - F.col("start") - WIDTH, F.lit(0))
    outside = (F.substring(F.col("word"), F.lit(1), F.col("start")), F.substring(F.col("word"), F.length("word") - after + 1, after))
    return rows.withColumn("block", F.xxhash64("m", "start", *outside))


def padded(words: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters from the left, letters from the right, lengths), rows padded by a value that no letter has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(sizes.max()) + 1
    left, right = (np.frombuffer(b"".join(w.ljust(wide, bytes([pad])) for w in ws), np.uint8).reshape(-1, wide) for ws in (words, [w[::-1] for w in words]))
    return left, right, sizes


def near(a: list[bytes], b: list[bytes], m: np.ndarray, start: np.ndarray, m_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of words of two blocks, one edit apart, whose shorter length is m and whose edit is in the piece."""
    (la, ra, na), (lb, rb, nb) = padded(a, 0), padded(b, 1)
    wide = min(la.shape[1], lb.shape[1])
    prefix = np.argmin(la[:, None, :wide] == lb[None, :, :wide], axis=2)
    suffix = np.argmin(ra[:, None, :wide] == rb[None, :, :wide], axis=2)
    longer, shorter = np.maximum(na[:, None], nb), np.minimum(na[:, None], nb)
    hit = (prefix + suffix >= longer - 1) & (shorter == m[:, None]) & (m[:, None] == m_b) & (start[:, None] == start_b)
    hit &= np.minimum(prefix, shorter - 1) // WIDTH * WIDTH == start[:, None]
    return np.nonzero(hit)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n) both ways for all words one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compared(a: slice, b: slice, rows: tuple) -> list[tuple]:
            word, n, m, start = rows
            i, j = near(word[a], word[b], m[a], start[a], m[b], start[b])
            if a == b:
                i, j = i[i < j], j[i < j]
            pairs = [(word[x], word[y], n[y], n[x]) for x, y in zip((i + a.start).tolist(), (j + b.start).tolist())]
            return [(x, y, k) for x, y, k, _ in pairs] + [(y, x, k) for x, y, _, k in pairs]

        def links(at: list[int]) -> pa.RecordBatch:
            """Of the held rows; ``at`` is where blocks begin, and the end."""
            word, n, m, start = zip(*held)
            rows = ([w.encode("latin-1") for w in word], n, np.array(m), np.array(start))
            out, first = [], 0
            for k in range(1, len(at)):
                if k + 1 < len(at) and at[k + 1] - at[first] <= TILE:
                    continue  # small blocks share a tile
                cuts = [slice(x, min(at[k], x + TILE)) for x in range(at[first], at[k], TILE)]
                for x, a in enumerate(cuts):
                    for b in cuts[x:]:
                        out += compared(a, b, rows)
                first = k
            text = lambda k: pa.array([r[k].decode("latin-1") for r in out], pa.string())
            return pa.RecordBatch.from_arrays([text(0), text(1), pa.array([r[2] for r in out], pa.int64())], ["word", "other", "other_n"])

        at, last = [], None
        for batch in batches:
            for *row, block in zip(*[c.to_pylist() for c in batch.columns]):
                if block != last:
                    if len(held) > 64 * TILE:
                        yield links([*at, len(held)])
                        held, at = [], []
                    at.append(len(held))
                    last = block
                held.append(tuple(row))
        if held:
            yield links([*at, len(held)])

    dealt = blocked(words).repartition("block").sortWithinPartitions("m", "block", "word")
    return dealt.select("word", "n", "m", "start", "block").mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) for the words that have a form. Counts rise AHEAD-fold at every step, which bounds a chain's length by
    the largest count; every round doubles the steps taken."""
    out = forms.select("word", F.col("form").alias("root"))
    steps = int(math.log(max(most, LEAST_COUNT) / LEAST_COUNT, AHEAD)) + 1
    for _ in range(max(0, steps - 1).bit_length()):
        out = written(out, "spelling-roots")
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = out.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of LEAST_LENGTH letters that occurs LEAST_COUNT times.

    Null and empty texts hold no word; a null doc_id alters runs as an empty one would. Texts and words are whole at any
    length. A word without near words has n_near 0; without one that is AHEAD times as frequent, form and form_n are null
    and it is its own root. Ties in n go to the smaller word. Repeated rows count again; an empty table gives no rows;
    other columns are ignored.
    """
    words = word_counts(docs)
    far = F.when(F.col("other_n") >= AHEAD * F.col("n"), F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("form")))
    joined = written(near_words(words), "spelling-links").join(words, "word")
    found = joined.groupBy("word").agg(F.count("*").alias("n_near"), F.min(far).alias("best"))
    formed = written(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.k")).alias("form_n")), "spelling-forms")
    most = formed.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ends = roots(formed.where("form is not null"), most)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

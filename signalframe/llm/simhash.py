"""SimHash near-duplicates: 64-bit fingerprints compared bit-sliced, linked at three or fewer differing bits.

Candidates: the 64 bits are cut into five blocks; two texts within three bits agree on at least two whole blocks,
so ten tables keyed by a pair of blocks (25 or 26 bits each) hold every link. Within a table's bucket the
fingerprints stand as vertical bit planes, 64 texts to a machine word. A query's distances to all of them grow by
carry-save addition of three planes at a time into two-bit counters; words whose 64 texts have all passed three
are abandoned. A bucket over ``CHUNK`` distinct fingerprints is dealt out as pairs of chunks, each pair one group,
so no group is unbounded and no link is lost. Buckets yield one edge per member, never all pairs.

The pipeline's stage (``deduplicated``) is wider: 256 bits over the set of five-word shingles, 64 tables keyed by 16
bits, pairs within 32 of 128 bits as candidates, and a link where the exact shingle Jaccard is 0.8 or more. Buckets yield
a star per group of candidates. Fingerprints miss some pairs: those between groups come from an exact search by prefixes
(``similarity.nearby``), which joins their groups. The sets of a group are then compared where its texts lie, nearest
fingerprints first, unless links join them already, so no link is lost and no step has a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.functions.memory import returning
from signalframe.llm.common import narrowed, pieces
from signalframe.operators import similarity
from signalframe.operators.components import connected_components
from signalframe.operators.coverage import lineage_origins
from signalframe.operators.similarity import paired, shingle_set
from signalframe.scratch import written

BITS = 64
RADIUS = 3
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
CHUNK = 4096
BLOCK_ROWS = 512
TILE_WORDS = 1 << 15
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = 3) -> int:
    """The text's SimHash over word shingles, repeats counted; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    count = np.zeros(BITS, np.int64)
    shingles = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:shingles].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, shingles, 1 << 16):
        raw = b"".join([digest(joined[b:e], SEED) for b, e in zip(begins[at : at + 65536], ends[at : at + 65536])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(count * 2 > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_md5 (null for a null text), fp (the 64 bits as a signed long).

    Null and empty texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_md5", "fp"])

    return narrowed(docs, _text_md5().alias("text_md5")).mapInArrow(run, "doc_id long, text_md5 string, fp long")


def _text_md5() -> Column:
    return F.md5(F.col("text").cast("string"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes; lane i of a plane is fingerprint i's bit."""
    words = -(-len(fps) // 64)
    bits = np.zeros((BITS, words * 64), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_pairs(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within RADIUS bits, in tiles of bounded size; each pair comes both ways."""
    n, planes = len(fps), planes_of(fps)
    words = planes.shape[1]
    spare = np.zeros(words, np.uint64)  # lanes that hold no text
    if n % 64:
        spare[-1] = FULL << np.uint64(n % 64)
    negated = [np.where(fps >> np.uint64(k) & np.uint64(1), FULL, np.uint64(0)) for k in range(BITS)]
    step = max(1, TILE_WORDS // words)
    for first in range(0, n, step):
        queries = np.arange(first, min(n, first + step))
        q, w = np.repeat(queries, words), np.tile(np.arange(words), len(queries))
        over = spare[w].copy()
        own = q // 64 == w
        over[own] |= np.uint64(1) << (q[own] % 64).astype(np.uint64)
        ones, twos = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for k in range(0, BITS, 3):
            a = planes[k][w] ^ negated[k][q]
            if k + 2 < BITS:
                b, c = planes[k + 1][w] ^ negated[k + 1][q], planes[k + 2][w] ^ negated[k + 2][q]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
            else:
                total, carry = a, np.zeros_like(a)
            up = ones & total
            ones ^= total
            over |= (twos & up) | ((twos ^ up) & carry)
            twos ^= up ^ carry
            alive = over != FULL
            if 2 * np.count_nonzero(alive) < len(alive):
                q, w, over, ones, twos = q[alive], w[alive], over[alive], ones[alive], twos[alive]
                if not len(q):
                    break
        alive = over != FULL
        if alive.any():
            hits = np.unpackbits((~over[alive]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hits)
            yield q[alive][row], w[alive][row] * 64 + lane


def roots_of(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint the index of its group's first member within this block."""
    root = np.arange(len(fps))
    for a, b in close_pairs(fps):
        join_roots(root, a, b)
    return root


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b in ``root``, which names each member's first."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _edges(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = roots_of(fps)
    tied = root != np.arange(len(fps))
    return fps[tied].view(np.int64), fps[root[tied]].view(np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> edges. Whole buckets are put together up to BLOCK_ROWS; singles are left out."""

    def finish(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        sizes = np.diff(np.append(starts, len(fps)))
        kept = np.repeat(sizes > 1, sizes)
        fps, sizes = fps[kept], sizes[sizes > 1]
        at = begin = 0
        for size in sizes.tolist():
            at += size
            if at - begin >= BLOCK_ROWS or at == len(fps):
                u, v = _edges(fps[begin:at])
                begin = at
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    keys, fps = np.empty((4, 0), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        keys = np.concatenate([keys, np.stack(columns[:4]).astype(np.int64)], axis=1)
        fps = np.concatenate([fps, columns[4].astype(np.int64).view(np.uint64)])
        if len(fps):
            open_from = int(np.argmax((keys == keys[:, -1:]).all(axis=0)))  # the last bucket may go on in the next batch
            if open_from:
                yield from finish(keys[:, :open_from], fps[:open_from])
                keys, fps = keys[:, open_from:], fps[open_from:]
    if len(fps):
        yield from finish(keys, fps)


def _masks() -> list[int]:
    low, blocks = 0, []
    for width in WIDTHS:
        blocks.append(((1 << width) - 1) << low)
        low += width
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(a | b) for a, b in combinations(blocks, len(WIDTHS) - RADIUS)]


def near_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` -> edges (u, v) that join every pair within RADIUS bits into one component."""
    banded = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])).alias("b")).select("b.band", "b.key", "fp")
    crowded = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    dealt = banded.join(crowded, ["band", "key"], "left").select(
        "band", "key", "fp", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("long").alias("k")
    )
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    by = ["band", "key", "i", "j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_linked, "u long, v long")


def _grouped(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_md5, fp, root (a fingerprint that names the group), component_id."""
    fps = written(fingerprints(docs), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = connected_components(near_links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts without words have fingerprint zero and are linked like any other. Repeated rows each come back. Rows
    whose doc_id is null are compared too but never name a component; a component of only such rows has id null.
    An empty table gives an empty result. Other columns are ignored.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of a stage: POSITIONS holds the bits of each table's key, each quarter of the tables using every bit once.
WIDE_WORDS = 5
LIKENESS = 0.8
WIDE_RADIUS = 32
KEY_BITS = 16
PIECE = 3 << 20  # bytes of text worked on at once
PILOT = 2  # tables that name most of a group before the others are read
SMALL = 16
TILE = 512
FRONT = 64  # members of a large bucket whose neighbours are sought at once
_ROUNDS = np.random.default_rng(SEED)
POSITIONS = np.concatenate([_ROUNDS.permutation(256).reshape(-1, KEY_BITS) for _ in range(4)])


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Exact Jaccard of two shingle sets."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / max(1, len(one) + len(other) - both)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four words: SimHash over the set, each shingle counted once."""
    count = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        x = shingles[at : at + (1 << 14), None] + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(count * 2 > len(shingles), bitorder="little").view(np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with near_key, which rows of the same doc_id and text share, null or not."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return docs.withColumn("near_key", F.md5(F.concat(told(F.col("doc_id")), F.lit(" "), told(F.col("text")))))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """near_key, doc_id, text_md5, sid (a hash of the shingle set), its size n and sketch, and the wide fingerprint a, b, c, d of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            every = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            told = [pa.array(list(map(similarity.set_id, every)), pa.int64()), pa.array(list(map(len, every)), pa.int64()), pa.array(list(map(similarity.sketch, every)), pa.binary())]
            bits = np.array([wide_fingerprint(x) for x in every], np.uint64).reshape(-1, 4).view(np.int64)
            columns = [batch.column(2), batch.column(0), batch.column(3), *told, *(pa.array(bits[:, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["near_key", "doc_id", "text_md5", "sid", "n", "sketch", "a", "b", "c", "d"])

    return narrowed(_keyed(docs), "near_key", _text_md5().alias("text_md5")).mapInArrow(returning(run), "near_key string, doc_id long, text_md5 string, sid long, n long, sketch binary, a long, b long, c long, d long")


def _dealt(tables: range):
    """sid, a, b, c, d -> a row for each of ``tables``: slot (table and key), sid, a, b."""
    weights, positions = 1 << np.arange(KEY_BITS), POSITIONS[tables.start : tables.stop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                columns = np.stack([c.to_numpy(zero_copy_only=False) for c in whole.slice(at, 1024).columns])
                bits = np.unpackbits(np.ascontiguousarray(columns[1:].T).view(np.uint8), axis=1, bitorder="little")
                keys = bits[:, positions] @ weights + (np.array(tables) << KEY_BITS)
                repeated = [np.repeat(columns[i], len(positions)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), *map(pa.array, repeated)], ["slot", "sid", "a", "b"])

    return run


def _apart(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    """Differing bits; as unsigned words, since a signed word's count is that of its magnitude."""
    return np.bitwise_count((a[i] ^ a[j]).view(np.uint64)) + np.bitwise_count((b[i] ^ b[j]).view(np.uint64))


def forest(a: np.ndarray, b: np.ndarray, radius: int = WIDE_RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a minimum spanning forest of the pairs within ``radius``, nearest first from each tree's start. For
    views of a cluster only: links are sought among all pairs, since a near pair of fingerprints may be an unlike one of sets."""
    n, at, out = len(a), 0, []
    nearest, parent, left = np.full(n, 300, np.int16), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n - 1):
        left[at] = False
        apart = _apart(a, b, slice(None), at)
        closer = left & (apart < nearest)
        nearest[closer], parent[closer] = apart[closer], at
        at = int(np.argmin(np.where(left, nearest, np.int16(301))))
        if nearest[at] <= radius:
            out.append((at, int(parent[at])))
    return out


def _candidates(keys: np.ndarray, sids: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole buckets -> all sid pairs (u, v) within the radius, a tile of a large bucket at a time."""

    def told(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(sids[left], sids[right])), pa.array(np.maximum(sids[left], sids[right]))], ["u", "v"])

    starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    sizes = np.diff(np.append(starts, len(sids)))
    ends = np.repeat(starts + sizes, sizes)
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for step in range(1, SMALL):
        small = small[small + step < ends[small]]
        hit = small[_apart(a, b, small, small + step) <= WIDE_RADIUS]
        yield told(hit, hit + step)
    for begin, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        end = begin + size
        for t in range(begin, end, TILE):
            rows = np.arange(t, min(end, t + TILE))
            for other in range(t, end, TILE):
                columns = np.arange(other, min(end, other + TILE))
                i, j = np.nonzero((_apart(a, b, rows[:, None], columns[None]) <= WIDE_RADIUS) & (rows[:, None] < columns[None]))
                if len(i):
                    yield told(rows[i], columns[j])


def reached(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each member of a bucket the first one that it reaches by pairs within the radius; who is reached is not compared again."""
    root, left = np.empty(len(a), np.int64), np.arange(len(a))
    while len(left):
        first, front, left = left[0], left[:1], left[1:]
        root[first] = first
        while len(front) and len(left):
            now, front = front[:FRONT], front[FRONT:]
            near = (_apart(a, b, now[:, None], left[None]) <= WIDE_RADIUS).any(axis=0)
            root[left[near]] = first
            front, left = np.concatenate([front, left[near]]), left[~near]
    return root


def _stars(keys: np.ndarray, sids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Whole buckets -> (u, v) from each group of members that pairs within the radius join to its first member."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    sizes = np.diff(np.append(starts, len(sids)))
    at, root = np.flatnonzero(np.repeat(sizes <= TILE, sizes)), np.arange(len(sids))
    if len(at):
        for part in _candidates(keys[:, at], at, a[at], b[at]):
            join_roots(root, *(c.to_numpy() for c in part.columns))
    for begin, size in zip(starts[sizes > TILE].tolist(), sizes[sizes > TILE].tolist()):
        root[begin : begin + size] = begin + reached(a[begin : begin + size], b[begin : begin + size])
    tied = np.flatnonzero(root != np.arange(len(sids)))
    return pa.RecordBatch.from_arrays([pa.array(sids[tied]), pa.array(sids[root[tied]])], ["u", "v"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> (u, v) that join every candidate pair into one group, fewer than there are rows."""
    held = np.empty((6, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        if held.shape[1]:
            open_from = int(np.argmax((held[:3] == held[:3, -1:]).all(axis=0)))
            if open_from:
                yield _stars(held[:3, :open_from], held[3, :open_from], *held[4:, :open_from])
                held = held[:, open_from:]
    if held.shape[1]:
        yield _stars(held[:3], held[3], *held[4:])


def links_of(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, own: np.ndarray, within: bool, least: float) -> list[tuple[int, int]]:
    """``similarity.links_of``, the nearest by fingerprint first; pairs beyond the radius are compared as well."""
    return similarity.links_of(sets, own, within, _fraction(least), lambda left, x: _apart(a, b, left, x))


def _fraction(least: float) -> tuple[int, int]:
    return Fraction(str(least)).limit_denominator(1000).as_integer_ratio()


def _stars_of(rows: DataFrame, tables: range) -> DataFrame:
    """sid, a, b, c, d -> links (u, v) between sids that join all candidate pairs of ``tables``; a sid may have several rows."""
    dealt = rows.select("sid", "a", "b", "c", "d").mapInArrow(returning(_dealt(tables)), "slot int, sid long, a long, b long")
    crowded = dealt.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    shares = dealt.join(F.broadcast(crowded), "slot", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("long"))
    by = ["slot", "i", "j"]
    shares = paired(shares, "sid", "a", "b").select(*by, "sid", "a", "b")
    return written(shares.repartition(*by).sortWithinPartitions(*by, "sid").mapInArrow(returning(_close), "u long, v long").where("u <> v").distinct(), "simhash-close")


def candidate_groups(distinct: DataFrame) -> DataFrame:
    """``distinct`` (a row per sid, with a, b, c, d) with grp: sets that candidate pairs of any table join share it.

    The first tables tell most of a group. For the others a set goes by the name of its group so far, so members of one group
    have one centre in every table: a group costs a link a member, not one for each of its many centres.
    """
    least = connected_components(_stars_of(distinct, range(PILOT))).select(F.col("node").alias("sid"), F.col("root").alias("rep"))
    named = written(distinct.join(least, "sid", "left").withColumn("rep", F.coalesce("rep", "sid")), "simhash-named")
    links = _stars_of(named.select(F.col("rep").alias("sid"), "a", "b", "c", "d"), range(PILOT, len(POSITIONS)))
    last = connected_components(links).select(F.col("node").alias("rep"), F.col("root").alias("grp"))
    return named.join(last, "rep", "left").withColumn("grp", F.coalesce("grp", "rep")).drop("rep")


def _similar(docs: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its sid, links (u, v) between sids of likeness ``least`` or more that join all such pairs)."""
    bound = _fraction(least)
    sets = written(_sets(docs, words), "simhash-wide")
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5", "near_key")
    distinct = written(sets.groupBy("sid", "n", "sketch", "a", "b", "c", "d").agg(F.min(named)["near_key"].alias("near_key")), "simhash-sets")
    groups = written(candidate_groups(distinct), "simhash-groups")
    texts = _keyed(docs).select("near_key", F.col("text").cast("string").alias("text"))
    groups = written(similarity.grouped(groups, similarity.nearby(texts.select("text"), groups.where("n > 0"), words, bound)), "simhash-joined")
    return sets, similarity.links(groups, texts, "near_key", words, bound, _apart, ("a", "b"))


def deduplicated(docs: DataFrame, words: int = WIDE_WORDS, least: float = LIKENESS) -> DataFrame:
    """One document of each group of texts linked by a shingle Jaccard of ``least`` or more, with all its columns: the one
    of the smallest doc_id, then of the smallest text_md5.

    A document without doc_id stays only where its whole group has none. Rows that share doc_id and text are one
    document; rows that share doc_id alone are apart. Null and empty texts, and those without words, are alike: one of them
    stays. Texts are compared whole at any length; an empty table stays empty; columns may have any name.
    """
    sets, links = _similar(docs, words, least)
    roots = connected_components(links).withColumnRenamed("node", "sid")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5", "near_key")
    best = sets.groupBy("sid").agg(F.min(first).alias("k")).join(roots, "sid", "left")
    kept = best.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("k").alias("k")).select(F.col("k.near_key").alias("near_key"))
    return _keyed(docs).join(kept.hint("merge"), "near_key", "left_semi").dropDuplicates(["near_key"]).drop("near_key")


def origins(docs: DataFrame, group: str, words: int = WIDE_WORDS, least: float = LIKENESS) -> DataFrame:
    """Per value of ``group``: items, origins (near duplicates of a lineage, linked as in ``deduplicated``, are one) and
    the largest lineage's items there. Rows without words are alike and one lineage; a null ``group`` is a group; an empty
    table gives no rows."""
    sets, links = _similar(docs, words, least)
    roots = connected_components(links).withColumnRenamed("node", "sid")
    named = sets.select("near_key", "sid").distinct().join(roots, "sid", "left").select("near_key", F.coalesce("root", "sid").alias("lineage_id"))
    return lineage_origins(_keyed(docs), named, "near_key", group)

"""Exact set similarity: all pairs of different shingle sets above a Jaccard bound, by prefixes in order of rarity.

Two sets of which four fifths agree share a shingle among the first fifth (and one) of each in any one order of all
shingles, so only those meet. The order is by how often a shingle's bucket of BUCKETS is held, then by hash: rare shingles
come first, and a set finds its prefix from one small table, so that no other shingle is ever shuffled. Pairs of unlike size and pairs
whose rest is too short to make up for where they met are dropped before they are compared as a whole. No pair is lost.

``similar_pairs`` gives all pairs. ``lineages`` needs their groups alone, so it has no row per pair of a large family: sets that
meet are tested by sketches (a bound that loses no pair), what may be alike becomes a group, and a group's sets are compared
where its texts lie, unless links join them already. It writes no set of shingles and shuffles prefixes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.functions.memory import returning
from signalframe.operators.components import connected_components
from signalframe.scratch import written

WORDS, LEAST = 5, (4, 5)  # shingles of five words, a Jaccard of 4/5
CHUNK = 1024  # sets of one prefix shingle that one task meets with as many others
BUCKETS = 1 << 20  # of shingles, whose counts give the order
PIECE = 8 << 20  # bytes of sets worked on at once
SEED = 42
SKETCH = 1 << 13  # bits of the sketch of a large set
FEW = 16  # sets of a prefix shingle that meet as pairs
CROWD = 4096  # sets of a crowded shingle that one task holds of either part
REMEMBERED = 1 << 17  # sets that a task knows when it meets them again
WHOLE = 128  # members of a group that are compared in one task
WEIGHT = 1 << 20  # shingles of a share of a group
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text: Column, words: int = WORDS) -> Column:
    """Sorted hashes of the text's distinct shingles, A-Z in lower case; fewer words are one shingle, none have none."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def cut(w: Column) -> Column:
        begins = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(words)), " ")))

    return F.array_sort(F.array_distinct(F.transform(F.array(found), cut)[0]))


def similar_pairs(sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(u, v) with u < v: sids of different sets whose Jaccard is ``least`` (as a fraction) or more. ``sets``: sid, shingles.

    Sets may repeat. A shingle that many sets have in their prefix is dealt out as pairs of chunks of them. Empty sets meet
    none. Whole sets are shuffled once, and after that only those of pairs that pass.
    """
    up, down = least
    held = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).toArrow()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, np.int64)
    table[held.column(0).to_numpy()] = held.column(1).to_numpy()
    often = sets.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            each = max(1, int(whole.num_rows * PIECE / max(1, whole.nbytes)))
            for begin in range(0, whole.num_rows, each):
                batch = whole.slice(begin, each)
                n, flat = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((flat, often.value[flat % BUCKETS], owner))
                at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                kept = at <= (n - -(-n * up // down))[owner]
                of, columns = owner[kept], [at[kept].astype(np.int32), flat[order][kept]]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[of]), pa.array(n[of].astype(np.int32)), *map(pa.array, columns)], ["sid", "n", "at", "shingle"])

    offered = sets.select("sid", "shingles").mapInArrow(first, "sid long, n int, at int, shingle long")
    prefix = written(offered.distinct(), "similar-prefix")
    crowd = prefix.groupBy("shingle").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("met")).where("met > 1").drop("met")
    dealt = prefix.join(crowd, "shingle").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sides = spread.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "n", "at", "own")
    a, b = sides.alias("a"), sides.alias("b")
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    apart = (F.col("a.sid") < F.col("b.sid")) & ((F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own")))
    sizes = (F.least("a.n", "b.n") * down >= F.greatest("a.n", "b.n") * up)
    still = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1 + F.least("a.at", "b.at")
    enough = still * (up + down) >= (F.col("a.n") + F.col("b.n")) * up
    pairs = a.join(b, same & apart & sizes & enough).select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct()
    pairs = written(pairs, "similar-pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    met = written(sets.join(nodes, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles")), "similar-met")
    of = lambda name: met.select(F.col("sid").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    common = F.size(F.array_intersect("of_u", "of_v"))
    return both.where(common * (up + down) >= (F.size("of_u") + F.size("of_v")) * up).select("u", "v")


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles, as ``shingles`` has them but unsigned."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(found) - words + 1)].tolist()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    hashes = (digest(joined[b:e], SEED) for b, e in zip(begins, ends[min(words, len(found)) - 1 :].tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(begins)))


def set_id(found: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """A bit for each of some two places a shingle, set if an odd number of shingles falls there.

    Two sets differ in at least as many shingles as their sketches differ in bits, so sketches tell pairs that can't be alike.
    """
    bits = min(SKETCH, max(64, 1 << (2 * len(found) - 1).bit_length() if len(found) else 0))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _rows(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


class Sketches:
    """Sizes and sketches of some sets, asked for those that a set may be alike."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], least: tuple[int, int]):
        self.sizes, (self.up, self.down) = sizes, least
        self.wide = np.array(list(map(len, sketches)), np.int64) // 8
        self.at, self.rows = np.zeros(len(sketches), np.int64), {}
        for wide in np.unique(self.wide).tolist():
            of = np.flatnonzero(self.wide == wide)
            self.at[of], self.rows[wide] = np.arange(len(of)), _rows([sketches[i] for i in of])

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose likeness to ``x`` can be the least or more; none that is so alike is left out."""
        n, own, out = self.sizes, int(self.wide[x]), []
        others = others[np.minimum(n[others], n[x]) * self.down >= np.maximum(n[others], n[x]) * self.up]
        for wide in np.unique(self.wide[others]).tolist():
            some, words = others[self.wide[others] == wide], min(wide, own)
            bits = np.bitwise_count(_folded(self.rows[wide][self.at[some]], words) ^ _folded(self.rows[own][self.at[x]][None], words)).sum(axis=1, dtype=np.int64)
            out.append(some[bits * (self.up + self.down) <= (n[some] + n[x]) * (self.down - self.up)])
        return np.sort(np.concatenate(out)) if out else others


def links_of(sets: list[np.ndarray], own: np.ndarray, within: bool, least: tuple[int, int], apart: Callable | None = None) -> list[tuple[int, int]]:
    """Index pairs of likeness ``least`` or more that join all such pairs; of different ``own`` unless ``within``.

    A member is compared with more and more of each group that it is not in yet, until it is linked or none is left; those of
    the least ``apart`` (members, member) first.
    """
    up, down = least
    n, sizes, out = len(sets), np.array(list(map(len, sets)), np.int64), []
    root, known = np.arange(n), Sketches(sizes, [sketch(s) for s in sets], least)
    for x in range(1, n):
        left = np.flatnonzero(root[:x] != root[x])
        left, many = known.near(x, left if within else left[own[left] != own[x]]), 1
        while len(left):
            first = apart(left, x) if apart else left
            left = left[np.lexsort((first, root[left]))]
            groups = root[left]
            now = np.arange(len(left)) - np.searchsorted(groups, groups) < many
            tried, many = left[now], many * 4
            found = np.concatenate([sets[y] for y in tried])
            there = np.minimum(np.searchsorted(sets[x], found), sizes[x] - 1)
            both = np.add.reduceat((sets[x][there] == found).astype(np.int64), np.cumsum(sizes[tried]) - sizes[tried])
            for y in tried[both * down >= (sizes[tried] + sizes[x] - both) * up].tolist():
                if root[y] != root[x]:
                    out.append((x, y))
                    root[root == root[x]] = root[y]
            left = left[~now]
            left = left[root[left] != root[x]]
    return out


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some PIECE bytes of text."""
    for whole in batches:
        each = max(1, int(whole.num_rows * PIECE / max(1, 4 * whole.column(column).nbytes)))
        for begin in range(0, whole.num_rows, each):
            yield whole.slice(begin, each)


def _counted(words: int):
    """Texts -> how many of the task's shingles each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int32)
        for batch in _texts(batches):
            flat = np.concatenate([shingle_set(t or "", words) for t in batch.column(0).to_pylist()] or [np.empty(0, np.uint64)])
            table += np.bincount((flat % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(table)
        for begin in range(0, len(at), 1 << 16):
            part = at[begin : begin + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(table[part].astype(np.int64))], ["bucket", "n"])

    return run


def _offered(often, words: int, least: tuple[int, int]):
    """Texts -> (shingle, n, sid): 32 bits of each shingle of a set's prefix; sets that agree there by chance alone part later."""
    up, down = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}  # copies that a task meets again offer nothing new
        for batch in _texts(batches):
            sets = {set_id(s): s for s in (shingle_set(t or "", words) for t in batch.column(0).to_pylist()) if len(s)}
            sets = {k: s for k, s in sets.items() if k not in seen}
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(dict.fromkeys(sets))
            if not sets:
                continue
            n, flat = np.array(list(map(len, sets.values())), np.int64), np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, often.value[(flat % np.uint64(BUCKETS)).astype(np.int64)], owner))
            kept = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) <= (n - -(-n * up // down))[owner]
            of, cut = owner[kept], (flat[order][kept] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(n[of].astype(np.int32)), pa.array(np.array(list(sets), np.int64)[of])], ["shingle", "n", "sid"])

    return run


def _met(least: tuple[int, int]):
    """Rows (shingle, n, sid) sorted by (shingle, sid) -> pairs (null, u, v) of the sets of one shingle that may be alike by
    their sizes, and the sets of a crowded shingle as (shingle, sid, null)."""
    up, down = least

    def told(shingle: np.ndarray | None, u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int32()) if shingle is None else pa.array(shingle.astype(np.int32)), pa.array(u), none if v is None else pa.array(v)], ["shingle", "u", "v"])

    def whole(shingle: np.ndarray, n: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        sizes = np.diff(np.append(starts, len(sid)))
        ends, held = np.repeat(starts + sizes, sizes), np.repeat(sizes, sizes)
        many = np.flatnonzero(held > FEW)
        if len(many):
            yield told(shingle[many], sid[many], None)
        at, pairs = np.flatnonzero((held > 1) & (held <= FEW)), []
        for step in range(1, FEW):
            at = at[at + step < ends[at]]
            hit = at[np.minimum(n[at], n[at + step]) * down >= np.maximum(n[at], n[at + step]) * up]
            pairs.append(np.stack([sid[hit], sid[hit + step]]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        if pairs.shape[1]:
            yield told(None, *pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.empty((3, 0), np.int64), None
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            fresh = np.concatenate([[True], (held[0, 1:] != held[0, :-1]) | (held[2, 1:] != held[2, :-1])]) if held.shape[1] else slice(0)
            held = held[:, fresh]
            more = np.searchsorted(held[0], crowded, "right") if crowded is not None else 0
            if more:
                yield told(held[0, :more], held[2, :more], None)
                held = held[:, more:]
            open_from = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if open_from:
                yield from whole(*held[:, :open_from])
                held, crowded = held[:, open_from:], None
            if held.shape[1] > FEW:
                yield told(held[0], held[2], None)
                held, crowded = held[:, :0], int(held[0, 0])
        if held.shape[1]:
            yield from whole(*held)

    return run


def _possible(least: tuple[int, int]):
    """(u, v, of_u, of_v, n_u, n_v) -> u, v of those whose sketches may belong to sets so alike."""
    up, down = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy() + batch.column(5).to_numpy()
            wide, kept = np.array([(len(p), len(q)) for p, q in zip(x, y)]).reshape(-1, 2) // 8, np.zeros(batch.num_rows, bool)
            for a, b in np.unique(wide, axis=0).tolist():
                of = np.flatnonzero((wide == (a, b)).all(axis=1))
                bits = np.bitwise_count(_folded(_rows([x[i] for i in of]), min(a, b)) ^ _folded(_rows([y[i] for i in of]), min(a, b))).sum(axis=1, dtype=np.int64)
                kept[of] = bits * (up + down) <= n[of] * (down - up)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in batch.columns[:2]], ["u", "v"])

    return run


def _grown(groups: np.ndarray, known: Sketches) -> list[tuple[int, int]]:
    """Links between ``groups`` of some sets that join all groups with a pair that may be alike; each set is compared with
    those that are not reached yet."""
    left, out = np.arange(len(groups)), []
    while len(left):
        first = groups[left[0]]
        front, left = left[groups[left] == first].tolist(), left[groups[left] != first]
        while front and len(left):
            new = np.unique(groups[known.near(front.pop(), left)])
            if len(new):
                out += [(first, g) for g in new.tolist()]
                moved = np.isin(groups[left], new)
                front += left[moved].tolist()
                left = left[~moved]
    return out


def _crowds(least: tuple[int, int]):
    """Rows (shingle, i, j, grp, n, sketch) sorted by (shingle, i, j) -> (u, v) of ``_grown`` each such share."""

    def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        grp, n, sketches = zip(*held)
        links = _grown(np.array(grp, np.int64), Sketches(np.array(n, np.int64), list(sketches), least))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for *key, grp, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and held:
                    yield from told(held)
                    held = []
                last = key
                held.append((grp, n, bits))
        if held:
            yield from told(held)

    return run


def paired(rows: DataFrame, *of: str) -> DataFrame:
    """``rows`` with i and j: each in ``k`` shares of its group, which together hold every pair of rows; own is its part."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(*of), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return rows.withColumns({"i": F.least("own", "other").cast("int"), "j": F.greatest("own", "other").cast("int")})


def nearby(texts: DataFrame, sets: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links (u, v) between groups that hold a pair of sets whose likeness may be ``least`` or more; no such pair is left out.

    ``texts``: text. ``sets``: a row for each of their sets (sid, n, sketch, grp), of n > 0. Prefixes are shuffled once, by shingle;
    sets of a shingle meet as pairs where they are few. Those of a crowded one are dealt out and their links join groups, so that
    no step has a row per pair of a large family. Sketches drop pairs that can't be so alike before any text is moved.
    """
    spark = texts.sparkSession
    held = texts.mapInArrow(returning(_counted(words)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, np.int32)
    table[held.column(0).to_numpy()] = np.minimum(held.column(1).to_numpy(), np.iinfo(np.int32).max)
    offered = texts.mapInArrow(returning(_offered(spark.sparkContext.broadcast(table), words, least)), "shingle int, n int, sid long")
    met = written(offered.repartition("shingle").sortWithinPartitions("shingle", "sid").mapInArrow(returning(_met(least)), "shingle int, u long, v long"), "similar-met")
    known = sets.select("sid", "grp", "n", "sketch")
    pairs = met.where("shingle is null").select("u", "v").distinct()
    for side in ("u", "v"):
        pairs = pairs.join(known.select(F.col("sid").alias(side), F.col("grp").alias(f"grp_{side}"), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"of_{side}")), side)
    pairs = pairs.where("grp_u <> grp_v").select(F.col("grp_u").alias("u"), F.col("grp_v").alias("v"), "of_u", "of_v", "n_u", "n_v").mapInArrow(returning(_possible(least)), "u long, v long")
    crowd = written(met.where("v is null").select("shingle", F.col("u").alias("sid")).distinct().join(known, "sid"), "similar-crowd")
    sized = crowd.groupBy("shingle").agg(F.count("*").alias("m"), F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
    by = ["shingle", "i", "j"]
    shares = paired(crowd.join(sized.select("shingle", F.ceil(F.col("m") / CROWD).cast("long").alias("k")), "shingle"), "sid").select(*by, "grp", "n", "sketch")
    grown = shares.repartition(*by).sortWithinPartitions(*by).mapInArrow(returning(_crowds(least)), "u long, v long")
    return pairs.unionByName(grown)


def _alike(words: int, least: tuple[int, int], apart: Callable | None):
    """Rows (grp, i, j, own, sid, text, more) sorted by (grp, i, j) -> (u, v) of ``links_of`` each such share."""

    def told(held: list[tuple], key: list) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            own, sids, sets, *more = zip(*held)
            columns = [np.array(c, np.int64) for c in more]
            pairs = links_of(list(sets), np.array(own), key[1] == key[2], least, apart and (lambda left, x: apart(*columns, left, x)))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([sids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in _texts(batches, 5):
            for grp, i, j, own, sid, text, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if [grp, i, j] != last:
                    yield from told(held, last)
                    held, last = [], [grp, i, j]
                held.append((own, sid, shingle_set(text, words), *more))
        yield from told(held, last)

    return run


def links(groups: DataFrame, texts: DataFrame, key: str, words: int = WORDS, least: tuple[int, int] = LEAST, apart: Callable | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Links (u, v) between sids that join all pairs of a group whose likeness is ``least`` or more.

    ``groups``: a row per set (sid, n, grp, ``key`` of a text of it, and columns ``by`` for ``apart``). ``texts``: ``key``, text. As many
    shares as half the square root of a group's members, so that a share and the copies of a text grow with that root alone.
    """
    many = F.greatest(F.when(F.col("m") > WHOLE, F.ceil(F.sqrt("m") / 2)).otherwise(1), F.ceil(F.col("weight") / WEIGHT)).cast("long")
    sized = groups.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("weight")).where("m > 1").select("grp", many.alias("k"))
    nodes = written(groups.join(sized, "grp").select("sid", "grp", key, "k", *by), "similar-nodes")
    # Merged at any size: what is sent to all tasks while the table is small would not be later.
    texts = texts.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = written(texts.join(nodes.select(key, "sid").hint("merge"), key).dropDuplicates([key]).select("sid", "text"), "similar-texts")
    of = ["grp", "i", "j"]
    shares = paired(nodes, "sid").join(texts, "sid").select(*of, "own", "sid", "text", *by)
    return shares.repartition(*of).sortWithinPartitions(*of, "sid").mapInArrow(returning(_alike(words, least, apart)), "u long, v long")


def grouped(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with the groups that links between them join as grp."""
    roots = connected_components(found).select(F.col("node").alias("grp"), F.col("root"))
    return sets.join(roots, "grp", "left").withColumn("grp", F.coalesce("root", "grp")).drop("root")


def _sketched(words: int):
    """(key, tid, text) -> (key, tid, sid, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches, 2):
            sets = [shingle_set(t or "", words) for t in batch.column(2).to_pylist()]
            told = [pa.array(list(map(set_id, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(sketch, sets)), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *told], ["key", "tid", "sid", "n", "sketch"])

    return run


def lineages(rows: DataFrame, key: str, text: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(key, lineage_id): rows whose texts are linked, directly or through others, by ``least`` of their shingles.

    Equal sets are one class before anything meets; rows without words are one lineage. Every link is found or joined by others.
    No set of shingles is written: texts are cut anew where a step needs them.
    """
    whole = rows.select(F.col(text).cast("string").alias("text"))
    named = rows.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("tid"), F.col(text).cast("string").alias("text"))
    kind = rows.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    hashed = written(named.mapInArrow(returning(_sketched(words)), f"key {kind}, tid long, sid long, n int, sketch binary"), "similar-sets")
    sets = written(hashed.where("n > 0").groupBy("sid", "n", "sketch").agg(F.min("tid").alias("tid")).withColumn("grp", F.col("sid")), "similar-distinct")
    groups = written(grouped(sets, nearby(whole, sets, words, least)), "similar-groups")
    roots = connected_components(links(groups, named, "tid", words, least)).withColumnRenamed("node", "sid")
    return hashed.select(F.col("key").alias(key), "sid").join(roots, "sid", "left").select(key, F.coalesce("root", "sid").alias("lineage_id"))

"""How far the sources of a language differ in their words.

Terms are counted once per (lang, source), kept if enough documents of the lang hold them, and priced as whole numbers of
a milliardth. The group-term count matrix of a lang is cut into tiles: STRIPE terms of like frequency by ROWS groups. A
task gets two row blocks of one stripe, builds a quadtree (each node's four quadrants, empty ones absent) over the
non-zero cells and walks it for all pairs of groups at once. Where both groups' quadrants are empty, every term costs the
same, so the whole quadrant is priced by one product; only where one of them holds a count the walk goes down to the
leaves. Sums are whole numbers, so neither partitions nor the order of addition matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed, pieces
from signalframe.scratch import written

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000  # shares are in milliardths
STRIPE, ROWS, LEAF = 4096, 256, 4
HELD = 300_000  # distinct terms a task counts before it hands them on
BLOCK = 1 << 14  # leaf pairs priced at once

#: Letters of ASCII in lower case and every byte of a longer character stay, all else parts terms.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with the empty term for each group. Written once."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in held.items():
                of[b""] += 0
                text = [t.decode("utf-8", "surrogatepass") for t in of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(text), pa.string()), pa.array([source] * len(text), pa.string()), pa.array(text, pa.string()),
                     pa.array([n[t] for t in of], pa.int64()), pa.array(list(of.values()), pa.int64())], names)
            held.clear()

        for batch in pieces(batches, 4 << 20):
            for text, lang, source in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                n, of = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                of.update(set(found))
            if sum(len(of) for _, of in held.values()) > HELD:
                yield from rows()
        yield from rows()

    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = narrowed(docs, group("lang"), group("source")).select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return written(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def share(count: Column, whole: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (whole + 2 size)), exact whatever the counts; null where that divides by zero."""
    over = ((count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(29,0)")
    under = (whole + 2 * size).cast("decimal(19,0)")
    return F.call_function("div", over, F.when(under > 0, under)) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs up to a milliard and one."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Tree:
    """A quadtree over the non-zero cells of a matrix: per level the sorted codes of the non-empty squares.

    A square's code interleaves the bits of its row and column, so its parent's code is its own without the last two
    bits. Level 0 is the leaves, LEAF x LEAF values each, ``empty[row]`` where a cell is zero.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, empty: np.ndarray):
        rows = -(-max(1, len(empty)) // LEAF) * LEAF
        self.empty = np.ones(rows, np.int64)
        self.empty[: len(empty)] = empty
        code = interleaved(row // LEAF, column // LEAF)
        self.codes, leaf = np.unique(code, return_inverse=True)
        r, _ = parted(self.codes)
        self.leaves = np.repeat(self.empty[r[:, None] * LEAF + np.arange(LEAF)][:, :, None], LEAF, axis=2)
        self.leaves[leaf, row % LEAF, column % LEAF] = value
        self.levels = [self.codes]

    def grow(self, height: int) -> None:
        while len(self.levels) <= height:
            self.levels.append(np.unique(self.levels[-1] >> 2))

    def has(self, level: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return found(self.levels[level], interleaved(row, column)) >= 0

    def values(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Leaves (n, LEAF, LEAF); an empty one has its rows' values of zero cells."""
        out = np.repeat(self.empty[row[:, None] * LEAF + np.arange(LEAF)][:, :, None], LEAF, axis=2)
        at = found(self.codes, interleaved(row, column))
        out[at >= 0] = self.leaves[at[at >= 0]]
        return out


def interleaved(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    for bit in range(16):
        out |= (column >> bit & 1) << 2 * bit | (row >> bit & 1) << 2 * bit + 1
    return out


def parted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, column = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    for bit in range(16):
        column |= (code >> 2 * bit & 1) << bit
        row |= (code >> 2 * bit + 1 & 1) << bit
    return row, column


def found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def priced(a: Tree, b: Tree, columns: int, width: int, same: bool) -> np.ndarray:
    """(rows of a, rows of b): the sum of ``apart`` over ``width`` terms, of which the first ``columns`` may hold counts.

    One walk from the roots: a triple (row square of a, row square of b, column) is followed into its eight triples while
    either tree has the square. What is never reached is empty in both, and priced by number of terms.
    """
    height = int(max(len(a.empty), len(b.empty), columns, 2) - 1).bit_length()
    a.grow(height)
    b.grow(height)
    one, other, column = (np.zeros(1, np.int64) for _ in range(3))
    for level in range(height - 1, -1, -1):
        one, other, column = (np.concatenate([2 * x + (k >> bit & 1) for k in range(8)]) for x, bit in ((one, 2), (other, 1), (column, 0)))
        alive = (a.has(level, one, column) | b.has(level, other, column)) & (one * LEAF << level < len(a.empty)) & (other * LEAF << level < len(b.empty))
        if same:
            alive &= one <= other
        one, other, column = one[alive], other[alive], column[alive]
    total, seen = np.zeros((len(a.empty) // LEAF, len(b.empty) // LEAF, LEAF, LEAF), np.int64), np.zeros((len(a.empty) // LEAF, len(b.empty) // LEAF), np.int64)
    for at in range(0, len(one), BLOCK):
        r, s, c = one[at : at + BLOCK], other[at : at + BLOCK], column[at : at + BLOCK]
        p, q = a.values(r, c)[:, :, None, :], b.values(s, c)[:, None, :, :]
        cost = (p - q) ** 2 // (p + q)
        real = np.minimum(LEAF, columns - c * LEAF)
        cost *= np.arange(LEAF) < real[:, None, None, None]
        np.add.at(total, (r, s), cost.sum(axis=3))
        np.add.at(seen, (r, s), real)
    p, q = a.empty.reshape(-1, 1, LEAF, 1), b.empty.reshape(1, -1, 1, LEAF)
    total += (width - seen)[:, :, None, None] * ((p - q) ** 2 // (p + q))
    return total.transpose(0, 2, 1, 3).reshape(len(a.empty), len(b.empty))


TILE = "lang string, a int, b int, stripe long, block int, place int, p long, width long, term string, total long"
PART = "lang string, a int, b int, x long, y long, value long"


def tile(cells: pa.Table) -> pa.Table:
    """The summed cost of every pair of groups of one tile: rows of block a against block b.

    A group has a row without a term (p: that of zero cells) and one for each term that it holds in the stripe.
    """
    lang, a, b = (cells.column(k)[0].as_py() for k in ("lang", "a", "b"))
    block, place, p, total = (cells.column(k).to_numpy() for k in ("block", "place", "p", "total"))
    term = cells.column("term").combine_chunks().dictionary_encode()
    names = term.dictionary.to_pylist()
    number = term.indices.to_numpy(zero_copy_only=False).astype(np.float64)
    is_group = np.isnan(number)
    held = np.zeros(len(names), np.int64)
    held[number[~is_group].astype(np.int64)] = total[~is_group]
    order = sorted(range(len(names)), key=lambda k: (-held[k], names[k]))  # like frequencies side by side
    column = np.empty(len(names), np.int64)
    column[order] = np.arange(len(names))
    trees, sizes = [], []
    for k in (a, b):
        mine = block == k
        head, cell = mine & is_group, mine & ~is_group
        empty = np.ones(int(head.sum()), np.int64)
        empty[place[head]] = p[head]
        sizes.append(len(empty))
        trees.append(Tree(place[cell].astype(np.int64), column[number[cell].astype(np.int64)], p[cell], empty))
    got = priced(trees[0], trees[1], len(names), int(cells.column("width")[0].as_py()), a == b)[: sizes[0], : sizes[1]]
    i, j = np.triu_indices(sizes[0], 1) if a == b else (x.ravel() for x in np.indices(got.shape))
    same = lambda v, kind: pa.array([v] * len(i), kind)
    return pa.table([same(lang, pa.string()), same(a, pa.int32()), same(b, pa.int32()), pa.array(i), pa.array(j), pa.array(got[i, j])], ["lang", "a", "b", "x", "y", "value"])


def pair_costs(cells: DataFrame, groups: DataFrame, stripes: DataFrame) -> DataFrame:
    """(lang, i, j, value) of every two groups i < j of a lang. A cell goes to as many tiles as its lang has row blocks."""
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("a"), F.greatest("block", k).alias("b"))))
    heads = groups.join(stripes, "lang").select("lang", "blocks", "stripe", "block", "place", F.col("empty").alias("p"), "width", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("total"))
    held = cells.join(stripes, ["lang", "stripe"]).select("lang", "blocks", "stripe", "block", "place", "p", "width", "term", "total")
    tiles = heads.unionByName(held).withColumn("pair", pairs).select("lang", "pair.a", "pair.b", "stripe", "block", "place", "p", "width", "term", "total")
    costs = tiles.groupBy("lang", "a", "b", "stripe").applyInArrow(tile, PART)
    return costs.groupBy("lang", (F.col("a") * ROWS + F.col("x")).alias("i"), (F.col("b") * ROWS + F.col("y")).alias("j")).agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` for each other source of the lang, part ``term`` for the TOP
    terms that the group uses more than its lang does.

    Null text, lang and source are empty. A group without terms still has its pairs; a lang without kept terms has pairs of
    value 0 and no terms. A lang of one source has no pairs. Repeated rows are documents of their own; ties go by item. An
    empty table gives no rows. Counts cover every text whole, at any length; other columns are ignored.
    """
    counts = counted(docs)
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    cells = written(counts.where("n > 0").join(kept, ["lang", "term"]), "divergence-cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    vocabulary = written(cells.groupBy("lang", "term").agg(F.first("total").alias("total")).withColumn("octave", F.floor(F.log2(F.col("total").cast("double")))), "divergence-terms")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_whole"))
    zero = F.lit(0).cast("long")
    joined = (
        counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("whole", "size", "lang_whole")])
    )
    joined = joined.join(joined.groupBy("lang").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")), "lang")
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("whole").desc(), "source")) - 1
    groups = written(
        joined.withColumn("number", number).select(
            "lang", "source", "whole", "size", "lang_whole", "blocks", "number", F.call_function("div", F.col("number"), F.lit(ROWS)).cast("int").alias("block"), (F.col("number") % ROWS).cast("int").alias("place"),
            F.coalesce(share(zero, F.col("whole"), F.col("size")), F.lit(1).cast("long")).alias("empty")), "divergence-groups")
    octaves = vocabulary.groupBy("lang", "octave").agg(F.ceil(F.count("*") / STRIPE).alias("cuts"))
    stripe = (F.col("octave") * (1 << 40) + F.pmod(F.xxhash64("term"), "cuts")).alias("stripe")
    placed = written(
        cells.withColumn("octave", F.floor(F.log2(F.col("total").cast("double")))).join(octaves, ["lang", "octave"]).join(groups.drop("number", "empty"), ["lang", "source"])
        .select("lang", "source", "term", "n", "total", stripe, "blocks", "block", "place", share(F.col("n"), F.col("whole"), F.col("size")).alias("p"), share(F.col("total"), F.col("lang_whole"), F.col("size")).alias("q")),
        "divergence-placed")
    stripes = vocabulary.join(octaves, ["lang", "octave"]).groupBy("lang", stripe).agg(F.count("*").alias("width"))
    bare = groups.select("lang").distinct().join(langs, "lang", "left_anti").select("lang", zero.alias("stripe"), zero.alias("width"))
    costs = pair_costs(placed, groups, stripes.unionByName(bare))
    ends = groups.select("lang", F.col("number").alias("end"), "source")
    both = costs.select("lang", F.explode(F.array(F.struct(F.col("i").alias("x"), F.col("j").alias("y")), F.struct(F.col("j").alias("x"), F.col("i").alias("y")))).alias("e"), "value")
    pairs = (
        both.select("lang", F.col("e.x").alias("end"), F.col("e.y").alias("far"), "value").join(ends, ["lang", "end"])
        .join(ends.select("lang", F.col("end").alias("far"), F.col("source").alias("item")), ["lang", "far"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP))


#: The same rows as SQL.
SQL = """
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
m AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, total::HUGEINT AS total FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + (1000000000 * (total + 2)) // (sum(total) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q FROM m),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
ups AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM ups))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

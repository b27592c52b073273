"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents stand in hash-shuffled order as one stream of words, cut into blocks of BLOCK words. Slot k of
the mix takes the point frac(k * golden ratio); where it falls in the cumulative weights names the source, and the
slot's rank within that source names the block (the stream starts anew when it ends). Ranks past a source's target
are left out, and ranks that the points did not reach follow as a short tail, so each source ends on its target to
the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed
from signalframe.scratch import written

BLOCK = 256
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 7
GOLDEN = 0.6180339887498949
RANK_CHUNK = 1 << 16


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the whole by weight; none above MOST_TIMES its size, the excess reshared by weight."""
    open_, got, left = list(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > MOST_TIMES * sizes[i]]
        if not full:
            for i in open_:
                got[i] = unit * weights[i]
            break
        for i in full:
            got[i] = float(MOST_TIMES * sizes[i])
            left -= got[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, key (a hash of doc_id and text: the shuffled order, whatever the partitions), and a
    row number that later steps keep apart repeated rows by; these are alike, so it does not matter which is which."""
    return written(
        narrowed(docs, F.col("source").cast("string").alias("source")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key"),
            F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        ),
        "mix-sizes",
    )


def in_turn(df: DataFrame, key: Column, name: str, of: Column | None = None) -> DataFrame:
    """``df`` (written) with ``name``: how many rows, or how much of ``of``, stand before a row in the order of ``key``.

    The order is dealt out by ranges; each range is counted, and only the counts of ranges are summed up in one place.
    """
    dealt = written(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "mix-ranges")
    amount = F.lit(1).cast("long") if of is None else of
    ranges = dealt.groupBy("range").agg(F.sum(amount).alias("amount"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("range", F.coalesce(F.sum("amount").over(before().orderBy("range")), F.lit(0)).alias("base"))  # a row per range
    inner = F.coalesce(F.sum(amount).over(before("range").orderBy(key)), F.lit(0))
    return dealt.withColumn("inner", inner).join(base, "range").withColumn(name, F.col("base") + F.col("inner")).drop("range", "inner", "base")


def source_plan(sizes: DataFrame) -> DataFrame:
    """One row per source: number, size, target, words to take, blocks a pass, slots due. Written; Spark holds it, however
    many sources there are.

    A source is full if its share by weight would pass MOST_TIMES its size. Full ones leave their excess to the others,
    whose shares rise, until none is full any more: each round is one aggregation, and its two sums go to the driver.
    """
    rows = in_turn(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), "src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")).cast("long")
    rows = written(rows.withColumn("weight", weight), "mix-sources")
    most = F.lit(MOST_TIMES) * F.col("source_size")
    unit, full = None, F.lit(False)
    while True:
        left = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, most)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = None if not left["open"] else float(left["all"] - (left["given"] or 0)) / left["open"]
        if now is None or now == unit:
            break
        unit, full = now, F.lit(now) * F.col("weight") > most
    target = F.when(full, most.cast("double")).otherwise(F.lit(unit if unit is not None else 0.0) * F.col("weight"))
    size, take = F.col("source_size"), F.col("take")
    plan = rows.withColumn("target", target).withColumn("take", F.least(F.bround("target").cast("long"), most)).withColumn("blocks", F.ceil(size / BLOCK))
    rest = F.expr("take % source_size")
    due = F.when(size > 0, F.expr("take div source_size") * F.col("blocks") + F.ceil(rest / BLOCK)).otherwise(0)
    return written(plan.select("src", "source", "source_size", "target", take, "blocks", due.cast("long").alias("due")), "mix-plan")


def schedule(plan: DataFrame) -> DataFrame:
    """The mix: slot, src, rank (from 0 within the source), pass, block and the words taken from that block.

    A slot's point falls into the weights' interval of one source. Both meet by cells of [0, 1), about as many as sources,
    so a slot meets the few sources of its cell.
    """
    spark = plan.sparkSession
    whole = plan.agg(F.coalesce(F.sum("due"), F.lit(0)).alias("slots"), F.count("*").alias("sources")).first()
    slots, cells = int(whole["slots"]), max(1 << 10, int(whole["sources"]))
    upto = in_turn(plan.where("due > 0"), F.col("src").asc(), "upto", F.col("due"))
    edges = upto.select("src", (F.col("upto") / max(1, slots)).alias("low"), ((F.col("upto") + F.col("due")) / max(1, slots)).alias("high"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    edges = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = (F.col("slot") + 0.5) * GOLDEN
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point)).withColumn("cell", cell(F.col("point")))
    dealt = drawn.join(edges, "cell").where("low <= point and point < high").select("slot", "src")
    dealt = written(dealt, "mix-slots")
    dealt = dealt.withColumn("part", F.floor(F.col("slot") / RANK_CHUNK))
    parts = dealt.groupBy("src", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.join(parts, ["src", "part"]).select(
        "slot", "src", (F.col("before") + F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1).alias("rank")
    )
    reached = parts.groupBy("src").agg(F.sum("n").alias("n"))
    tail = (
        plan.join(reached, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < due")
        .select(F.lit(slots).cast("long").alias("slot"), "src", F.explode(F.sequence("n", F.col("due") - 1)).alias("rank"))
    )
    kept = ranked.unionByName(tail).join(plan, "src").where("rank < due")
    kept = kept.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    begins = F.col("block") * BLOCK
    words = F.least(F.lit(BLOCK), F.col("source_size") - begins, F.col("take") - F.col("pass") * F.col("source_size") - begins)
    return kept.select("slot", "src", "rank", "pass", "block", words.alias("words"))


def streams(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document that has words, with the word its shuffled source stream reaches it at (``begins``)."""
    keyed = sizes.where("size > 0").join(plan.select("src", "source"), sizes["source"].eqNullSafe(plan["source"])).select("src", "row", "doc_id", "size", "key")
    dealt = written(keyed.repartitionByRange("src", "key", "row").withColumn("pid", F.spark_partition_id()), "mix-streams")
    ahead = Window.partitionBy("src").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("src", "pid").agg(F.sum("size").alias("n")).select("src", "pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("src", "pid").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["src", "pid"]).select(
        "src", "row", "doc_id", "size", (F.col("base") + F.col("inner")).alias("begins")
    )


def taken(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with row, doc_id, source, size; row -> words taken for rows of which the mix takes any, plan) applied."""
    sizes = measured(docs)
    plan = source_plan(sizes)
    ends = F.col("begins") + F.col("size")
    cut = streams(sizes, plan).withColumn("block", F.explode(F.sequence(F.floor(F.col("begins") / BLOCK), F.floor((ends - 1) / BLOCK))))
    cut = cut.select("src", "row", "block", F.greatest(F.col("begins") - F.col("block") * BLOCK, F.lit(0)).alias("lo"), F.least(ends - F.col("block") * BLOCK, F.lit(BLOCK)).alias("hi"))
    drawn = cut.join(schedule(plan).select("src", "block", "words"), ["src", "block"])
    words = drawn.groupBy("row").agg(F.sum(F.greatest(F.least("hi", "words") - F.col("lo"), F.lit(0))).alias("taken"))
    return sizes.join(words, "row", "left"), plan


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), key.

    Texts that are null or have no words have size 0 and nothing taken. A null source is a source, last in order.
    Repeated rows are apart: each is taken in its own place. An empty table gives an empty result.
    """
    rows, plan = taken(docs)
    rows = rows.withColumnRenamed("source", "of")
    return rows.join(plan, rows["of"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "key"
    )


def resampled(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, to the nearest whole (0 to MOST_TIMES), all columns kept.

    A source's blocks are taken in order, pass after pass, so but for one document where its last pass ends every
    document is taken a whole number of times: sources end on their targets to within half a document. Rows that share
    doc_id and text share the rounded mean of what is taken of them. Null and empty texts are not taken; an empty table stays
    empty. Columns may have any name.
    """
    times = mixed(docs).where("size > 0").groupBy("key").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times")).where("times > 0")
    own = [f"mix column {i}" for i in range(len(docs.columns))]  # apart from ours, whatever they are called
    key = F.xxhash64(F.lit(SEED), docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    renamed = docs.select(key.alias("key"), *[docs[c].alias(o) for c, o in zip(docs.columns, own)])
    again = renamed.join(times, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])

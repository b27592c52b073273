"""Schedules, windows, diversity floors, greedy coverage, non-dominated fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.scratch import written


def schedule_reconcile(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """``plan_id, first_at, last_at, every_seconds`` -> expected slots, on time, missed; a slot without a run counts as missed."""
    at = lambda c: F.unix_timestamp(c)
    slots = plans.select("plan_id", F.explode(F.sequence(at("first_at"), at("last_at"), F.col("every_seconds").cast("long"))).alias("slot"))
    done = runs.select("plan_id", at("slot_at").alias("slot"), F.lit(True).alias("ran")).distinct()
    return slots.join(done, ["plan_id", "slot"], "left").groupBy("plan_id").agg(F.count("*").alias("expected"), F.count("ran").alias("run"), F.count_if(F.col("ran").isNull()).alias("missed"))


def nominal_windows(first_day: str, last_day: str, spark) -> DataFrame:
    """Morning [19:00 the day before, 08:00) and evening [08:00, 19:00) at UTC+8, per day, in UTC."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    midnight = F.unix_date("day").cast("long") * 86400 - 8 * 3600
    edition = F.explode(F.array(F.struct(F.lit("morning").alias("edition"), F.lit(-5).alias("b"), F.lit(8).alias("e")), F.struct(F.lit("evening").alias("edition"), F.lit(8).alias("b"), F.lit(19).alias("e"))))
    return days.select("day", midnight.alias("m"), edition.alias("x")).select("day", "x.edition", F.timestamp_seconds(F.col("m") + F.col("x.b") * 3600).alias("start"), F.timestamp_seconds(F.col("m") + F.col("x.e") * 3600).alias("end"))


def reportable_arrivals(first_seen: DataFrame, versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """One table of arrivals: an item's first sight, a version's observation, a decision's availability."""
    part = lambda df, key, at, kind: df.where(F.col(at).isNotNull()).select(F.col(key).cast("string").alias("arrival_id"), F.lit(kind).alias("kind"), F.col(at).alias("arrived_at"))
    return part(first_seen, "item_id", "first_seen_at", "item").unionByName(part(versions, "version_id", "observed_at", "version")).unionByName(part(decisions, "decision_id", "available_at", "decision"))


MANY = 4096  # rows of a surface whose distinct values one group holds


def display_diversity(rows: DataFrame, surface: str, dimensions: list[str], floors: list[tuple[int, dict[str, int]]]) -> DataFrame:
    """Distinct counts against the floors of the largest list size reached; ``floors`` rise in size.

    Every row is shuffled once, and a surface's sets are counted where its rows are. A surface of more than MANY rows is
    counted by distinct values that are dealt out, so that no group holds them all.
    """
    sizes = rows.groupBy(surface).agg(F.count("*").alias("size"))
    large = written(sizes.where(F.col("size") > MANY), "diversity-large")
    small, large_rows = rows, None
    if not large.isEmpty():
        of = large.select(F.col(surface).alias("of_large"))
        small = rows.join(of, F.col(surface).eqNullSafe(F.col("of_large")), "left_anti")
        large_rows = rows.join(of, F.col(surface).eqNullSafe(F.col("of_large")), "left_semi")
    told = lambda d: F.when(F.col(d) == 0, "0").otherwise(F.col(d).cast("string"))  # noqa: E731  of fractions, as a set holds zeros and NaNs apart
    plain = {d: told(d) if kind in ("double", "float") else F.col(d) for d, kind in rows.dtypes if d in dimensions}
    sets = [F.size(F.collect_set(plain[d])).cast("long").alias(d) for d in dimensions]
    out = small.repartition(surface).groupBy(surface).agg(F.count("*").alias("size"), *sets)
    if large_rows is not None:
        out = out.unionByName(large_rows.groupBy(surface).agg(F.count("*").alias("size"), *[F.count_distinct(d).alias(d) for d in dimensions]))
    short = F.array().cast("array<string>")
    for size, least in floors:
        short = F.when(F.col("size") >= size, F.array_compact(F.array(*[F.when(F.col(d) < n, d) for d, n in least.items()]))).otherwise(short)
    return out.withColumn("short", F.array_join(short, ","))


def coverage_floor_greedy(candidates: DataFrame, debts: DataFrame, picks: int) -> DataFrame:
    """``picks`` candidates, each time the next by order of the stratum that owes most of its target.

    With a pick the stratum's normalised debt falls by 1/target, so its i-th candidate is taken at level
    (debt - (i - 1)) / target: ranking all levels gives the picks of the loop, without the loop. ``picks`` is the feature.
    """
    d = debts.where("target > 0").select("stratum", "debt", "target")
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy("input_order", "candidate_id"))
    level = candidates.join(d, "stratum").withColumn("nth", nth).withColumn("level", (F.col("debt") - (F.col("nth") - 1)) / F.col("target"))
    return level.where("level > 0").orderBy(F.col("level").desc(), "stratum", "nth").limit(picks).select("candidate_id", "stratum", "nth", "level")


def _undominated(points: DataFrame, buckets: int) -> DataFrame:
    """Points (a, b) that no other exceeds in one and reaches in the other."""
    cuts = points.approxQuantile("a", [i / buckets for i in range(1, buckets)], 0.01)
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("a"))) if cuts else F.lit(0)
    best = points.groupBy("a").agg(F.max("b").alias("b")).withColumn("bucket", bucket)
    tops = best.groupBy("bucket").agg(F.max("b").alias("top"))  # at most ``buckets`` rows
    above = tops.withColumn("above", F.max("top").over(Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "above")
    before = F.max("b").over(Window.partitionBy("bucket").orderBy(F.col("a").desc()).rowsBetween(Window.unboundedPreceding, -1))
    kept = best.withColumn("before", before).join(F.broadcast(above), "bucket")
    return kept.where((F.col("before").isNull() | (F.col("before") < F.col("b"))) & (F.col("above").isNull() | (F.col("above") < F.col("b")))).select("a", "b")


def pareto_fronts(candidates: DataFrame, key: str, a: str, b: str, fronts: int, buckets: int = 64) -> DataFrame:
    """The first ``fronts`` fronts by two scores, larger is better; equal points share a front, null scores have none.

    Points are cut into ranges of ``a``: a running maximum inside each, and one maximum a range for those above, replace
    all pairs. What is left after each front is written.
    """
    left = candidates.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    out = None
    for i in range(1, fronts + 1):
        front = written(_undominated(left.select("a", "b").distinct(), buckets), "front")
        part = left.join(front, ["a", "b"]).select(key, F.lit(i).alias("front"))
        out = part if out is None else out.unionByName(part)
        if i < fronts:
            left = written(left.join(front, ["a", "b"], "left_anti"), "front-left")
    return out

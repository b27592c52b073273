"""Coverage, delay and publication measures. Times are arguments; every operator works per group over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.text import wilson


def nearest_index_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Values at index round((n - 1) q), half away from zero, no interpolation. Counts per distinct value, then a running sum."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = counts.withColumn("hi", F.sum("c").over(Window.partitionBy(group).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda q: F.floor((F.col("n") - 1) * q + 0.5)
    pick = lambda q: F.max(F.when((at(q) < F.col("hi")) & (at(q) >= F.col("hi") - F.col("c")), F.col(value)))
    return upto.groupBy(group).agg(*[pick(q).alias(name) for name, q in quantiles.items()])


def delay_quantiles(delays: DataFrame) -> DataFrame:
    seconds = lambda a, b: F.unix_timestamp(a) - F.unix_timestamp(b)
    q = {"p50": 0.5, "p95": 0.95}
    base = delays.withColumn("discovery", seconds("discovered_at", "published_at")).withColumn("processing", seconds("processed_at", "version_available_at"))
    d = nearest_index_quantiles(base, "language", "discovery", {f"discovery_{k}": v for k, v in q.items()})
    p = nearest_index_quantiles(base, "language", "processing", {f"processing_{k}": v for k, v in q.items()})
    why = delays.groupBy("language").agg(
        F.bool_or(F.col("discovered_at") > F.col("published_at")).alias("discovery_delay"),
        F.bool_or(F.col("processed_at") >= F.col("nominal_window_end")).alias("processing_backfill"),
    )
    return d.join(p, "language").join(why, "language")


def language_evaluation(rows: DataFrame, most_false: float, least_coverage: float) -> DataFrame:
    one = lambda c: F.count_if(F.col(c))
    out = rows.groupBy("language", "assertion_type").agg(F.count("*").alias("n"), one("false_support").alias("fs"), one("abstained").alias("abst"))
    kept = F.greatest(F.col("n") - F.col("abst"), F.lit(1))
    low, high = wilson(F.col("fs"), kept)
    out = out.withColumn("coverage", (F.col("n") - F.col("abst")) / F.greatest("n", F.lit(1))).withColumn("false_support_rate", F.col("fs") / kept)
    return out.select("language", "assertion_type", "n", "coverage", "false_support_rate", (F.col("abst") / F.greatest("n", F.lit(1))).alias("abstention_rate"),
                      F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"),
                      ((F.col("coverage") < least_coverage) | (F.col("false_support_rate") > most_false)).alias("blocked"))


def blind_review(samples: DataFrame, rubric: str | None) -> DataFrame:
    out = samples.agg(F.count("*").alias("n"), F.count_if("major_omission").alias("misses"))
    low, high = wilson(F.col("misses"), F.col("n"))
    done = F.lit(bool(rubric)) & (F.col("n") > 0)
    return out.select(F.when(F.lit(not rubric), "blocked").when(F.col("n") == 0, "empty").otherwise("complete").alias("result"), F.when(F.lit(not rubric), "ORACLE_MISSING").alias("reason_code"),
                      F.when(done, F.col("misses") / F.col("n")).alias("omission_rate"), F.when(done, F.round(low, 9)).alias("ci_low"), F.when(done, F.round(high, 9)).alias("ci_high"))


def coverage_allocate(candidates: DataFrame, required: list[str], quota: int) -> DataFrame:
    """First candidate of each required stratum in stratum order, then all in input order, unique by id, up to quota."""
    place = F.array_position(F.array(*map(F.lit, required)), F.col("stratum")).cast("int")
    first = F.row_number().over(Window.partitionBy("stratum").orderBy("input_order", "candidate_id"))
    keyed = candidates.withColumn("floor", (place > 0) & (first == 1))
    keyed = keyed.withColumn("place", F.when(F.col("floor"), place).otherwise(len(required) + 1))
    unique = keyed.groupBy("candidate_id").agg(F.min_by(F.struct("stratum", "place", "input_order", "floor"), F.struct("place", "input_order")).alias("s"))
    return unique.select("candidate_id", "s.stratum", "s.floor", "s.place", "s.input_order").orderBy("place", "input_order", "candidate_id").limit(quota).select("candidate_id", "stratum", "floor")


def missing_strata(candidates: DataFrame, required: list[str]) -> DataFrame:
    want = candidates.sparkSession.createDataFrame([(s,) for s in required], "stratum string")
    return want.join(candidates, "stratum", "left_anti").select("stratum", F.lit("QUOTA_INFEASIBLE").alias("reason_code"))


def capacity_rotation(selected: DataFrame, capacity: int, quality_floor: float) -> DataFrame:
    """Per group: visible up to capacity by position; the rest are debt; low quality is a violation."""
    at = F.row_number().over(Window.partitionBy("surface").orderBy("position", "item_id"))
    return selected.withColumn("at", at).groupBy("surface").agg(
        F.count_if(F.col("at") <= capacity).alias("visible"), F.count_if(F.col("at") > capacity).alias("debt"), F.count_if(F.col("quality") < quality_floor).alias("low_quality_fill"),
    )


def ranking_flip(rankings: DataFrame, top_k: int, tolerance: float) -> DataFrame:
    top = F.col("position") <= top_k
    out = rankings.groupBy("scope").agg(
        F.count("*").alias("n"), F.count_if(F.col("fixed_id") != F.col("current_id")).alias("flips"),
        F.collect_set(F.when(top, F.col("fixed_id"))).alias("a"), F.collect_set(F.when(top, F.col("current_id"))).alias("b"),
    )
    rate, share = F.col("flips") / F.col("n"), F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1))
    return out.select("scope", rate.alias("flip_rate"), share.alias("top_k_overlap"), (rate > tolerance).alias("coverage_shift"), (share < 1 - tolerance).alias("degraded_coverage"))


def attention_budget(rows: DataFrame, k: int, minutes: float) -> DataFrame:
    """First violation per group, in the order the rules are checked."""
    hidden = (F.col("allocation_lane") == "random_exploration") & (F.col("fold") == "below_fold") & ~F.col("delivered")
    out = rows.groupBy("surface").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"), F.bool_or(hidden).alias("h"), F.count_distinct("content_id").alias("d"))
    return out.select("surface", F.when(F.col("n") > k, "ATTENTION_BUDGET_EXCEEDED").when(F.col("m") > minutes, "ATTENTION_MINUTES_EXCEEDED").when(F.col("h"), "EXPLORATION_UNREACHABLE").when(F.col("d") < F.col("n"), "ATTENTION_DUPLICATE").alias("first_error"))


def first_publication(arrivals: DataFrame, placements: DataFrame) -> DataFrame:
    """Arrivals whose first placements break the rule: exactly one with an event id if reportable, none otherwise."""
    firsts = placements.where("is_first_publication").groupBy("arrival_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("publication_event_id", F.lit("")) == "").alias("blank"))
    n = F.coalesce("n", F.lit(0))
    code = F.when(F.col("reportable") & (n != 1), "FIRST_PUBLICATION_NOT_UNIQUE").when(F.col("reportable") & (F.col("blank") > 0), "PUBLICATION_EVENT_REQUIRED").when(~F.col("reportable") & (n > 0), "NON_REPORTABLE_FIRST_PUBLICATION")
    return arrivals.join(firsts, "arrival_id", "left").withColumn("error", code).where("error is not null").select("arrival_id", "error")


def selection_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("human_readable_reason", F.concat(F.array_join("signal_types", ", "), F.lit(" via "), F.col("allocation_lane")))


def open_world_unknown(df: DataFrame) -> DataFrame:
    ok = (F.col("domain") == "unknown") & (F.col("publisher_role") == "unknown")
    return df.withColumn("allocation_lane", F.when(ok, "random_exploration")).withColumn("open_world_unknown", ok).withColumn("violation", ~ok)


def coverage_debt(debts: DataFrame, as_of: Column) -> DataFrame:
    """A checksum over immutable fields alone; the age belongs to the question, not to the record."""
    fields = ["coverage_debt_id", "opened_at", "reason_code", "next_rotation_at"]
    return debts.withColumn("checksum", F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), 256)).withColumn("age_seconds", F.unix_timestamp(as_of) - F.unix_timestamp("opened_at")).withColumn("violation", F.col("opened_at") > as_of)


def lineage_origins(items: DataFrame, lineages: DataFrame, key: str, group: str) -> DataFrame:
    """Per group its items and the origins they come from: all near duplicates of a lineage are one origin.

    ``lineages``: ``key`` and lineage_id; an item without a lineage is its own origin. Items are counted per (group, lineage)
    first, so a lineage of many copies is one row before the last count.
    """
    named = items.select(key, group).join(lineages.select(key, "lineage_id"), key, "left")
    alone = F.when(F.col("lineage_id").isNull(), F.col(key))
    per = named.groupBy(group, "lineage_id", alone.alias("alone")).agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(F.sum("n").alias("items"), F.count("*").alias("origins"), F.max("n").alias("largest"))

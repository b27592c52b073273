"""Signal rules: diffusion, adoption, anomalies, multiple tests, manipulation, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.text import wilson


def emergence_diffusion(observations: DataFrame, actions: DataFrame, types: DataFrame, least: int = 3) -> DataFrame:
    """Enough languages and actor classes, an action, and both signal types, per signal observed."""
    seen = observations.groupBy("signal_id").agg(F.count_distinct("language").alias("language_count"), F.count_distinct("actor_class").alias("actor_class_count"))
    acted = actions.groupBy("signal_id").agg(F.count("*").alias("actions"))
    of = lambda t: F.coalesce(F.bool_or(F.col("signal_type") == t), F.lit(False))
    typed = types.groupBy("signal_id").agg((of("emergence") & of("diffusion")).alias("typed"))
    out = seen.join(acted, "signal_id", "left").join(typed, "signal_id", "left")
    out = out.withColumn("actions", F.coalesce("actions", F.lit(0))).withColumn("typed", F.coalesce("typed", F.lit(False)))
    return out.withColumn("diffused", (F.col("language_count") >= least) & (F.col("actor_class_count") >= least) & (F.col("actions") > 0) & F.col("typed"))


def independent_adoption(rows: DataFrame, least: int = 3) -> DataFrame:
    out = rows.groupBy("signal_id").agg(F.count("*").alias("edges"), F.count_distinct("actor_id").alias("actors"), F.bool_and(F.coalesce("evidence_id", F.lit("")) != "").alias("evidenced"), F.bool_or(F.coalesce("cited_source", F.lit(False))).alias("cited"))
    code = F.when(F.col("edges") < least, "TOO_FEW").when(F.col("actors") < F.col("edges"), "NOT_INDEPENDENT").when(~F.col("evidenced"), "NO_EVIDENCE").when(F.col("cited"), "CITED")
    return out.select("signal_id", "edges", code.alias("first_error"))


def gold_cluster_separation(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("gold_cluster_id").alias("gold_clusters"), F.count_if(F.col("predicted_cluster_id") != F.col("gold_cluster_id")).alias("mixed")).withColumn("separated", (F.col("gold_clusters") >= 2) & (F.col("mixed") == 0))


def stance_report(rows: DataFrame) -> DataFrame:
    bad = F.col("stance").isin("opposed", "skeptical", "sarcastic", "negative").cast("double")
    return rows.groupBy("topic").agg(F.count("*").alias("mentions"), F.avg(bad).alias("negative_share")).withColumn("mostly_negative", F.col("negative_share") > 0.5)


def seasonal_anomaly(rows: DataFrame, threshold: float) -> DataFrame:
    off = F.when(F.col("baseline") == 0, 0.0).otherwise(F.abs(F.col("observed") - F.col("baseline")) / F.col("baseline"))
    return rows.groupBy("series_id").agg(F.max(off).alias("max_deviation")).withColumn("triggered", F.col("max_deviation") > threshold)


def fdr_scan(tests: DataFrame, alpha: float) -> DataFrame:
    """Per scan_id. Where every test has a p_value: q = min of p(i) n / i, discoveries p <= alpha / n, and the share of
    them that is no gold_anomaly (null: none). Else the share of false_alarm, which every test must then have. The
    decision holds that rate against alpha.

    A p outside 0 to 1 gives P_RANGE, a missing false_alarm FALSE_ALARM_MISSING, both without measures. The rank comes
    from counts per distinct p, so that equal p are one row.
    """
    wrong, alarm = ~F.coalesce("gold_anomaly", F.lit(False)), F.col("false_alarm")
    counts = tests.groupBy("scan_id", "p_value").agg(F.count("*").alias("c"), F.count_if(wrong).alias("wrong"), F.count_if(alarm).alias("alarms"), F.count_if(alarm.isNull()).alias("silent"))
    w = Window.partitionBy("scan_id")
    ranked = counts.withColumn("rank", F.sum("c").over(w.orderBy("p_value"))).withColumn("n", F.sum("c").over(w))
    p, hit = F.col("p_value"), F.col("p_value") <= F.lit(alpha) / F.col("n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = ranked.groupBy("scan_id").agg(
        F.first("n").alias("tests"), F.bool_and(p.isNotNull()).alias("scored"), F.coalesce(F.bool_or(~p.between(0, 1)), F.lit(False)).alias("outside"), F.min(p * F.col("n") / F.col("rank")).alias("q"),
        total(F.when(hit, F.col("c"))).alias("d"), total(F.when(hit, F.col("wrong"))).alias("f"), F.sum("alarms").alias("alarms"), F.sum("silent").alias("silent"),
    )
    scored = F.col("scored")
    error = F.when(scored & F.col("outside"), "P_RANGE").when(~scored & (F.col("silent") > 0), "FALSE_ALARM_MISSING")
    fits = lambda value: F.when(F.col("error").isNull(), value)
    measure = lambda value: fits(F.when(scored, value))
    rate = F.when(scored, F.when(F.col("d") > 0, F.col("f") / F.col("d")).otherwise(0.0)).otherwise(F.col("alarms") / F.col("tests"))
    return out.withColumn("error", error).select(
        "scan_id", "tests", F.when(scored, "probabilistic").otherwise("non_probability").alias("detector_type"), measure(F.col("q")).alias("q_value"), measure(F.col("d")).alias("discoveries"),
        measure(F.col("f")).alias("false_discoveries"), fits(rate).alias("rate"), fits(rate <= alpha).alias("decision"), "error",
    )


def sparse_series(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("series_id").agg(F.sum("numerator").alias("num"), F.sum("denominator").alias("den"), F.count_if("independent").alias("independent_count"))
    low, high = wilson(F.col("num"), F.col("den"))
    return out.select("series_id", "num", "den", "independent_count", F.when(F.col("den") == 0, 0.0).otherwise(F.col("num") / F.col("den")).alias("ratio"), F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"), ((F.col("num") > F.col("den")) & (F.col("den") > 0)).alias("violation"))


def sybil_risk(rows: DataFrame) -> DataFrame:
    flags = ["synchronized", "template_match", "reference_chain"]
    out = rows.groupBy("group_id").agg(*[F.bool_or(f).cast("int").alias(f) for f in flags], F.count_distinct("origin_id").alias("origins"))
    n = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return out.select("group_id", "origins", n.alias("signals"), F.when(n >= 2, "high").otherwise("low").alias("risk"))


def manipulation_event(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group_id").agg(F.bool_or(F.col("bot") | F.col("coordinated")).alias("high_risk"), F.count("*").alias("propagation"))


def causal_claim(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("source_claimed_cause"), "source_claimed_cause").when(F.col("temporal_order") & ~F.col("intervention") & ~F.col("mechanism"), "observed_association")
    return df.withColumn("claim", kind).withColumn("violation", kind.isNull()).withColumn("supported_mechanism", F.lit(False))


def unverifiable_action(df: DataFrame) -> DataFrame:
    ok = F.col("registry_verified") | F.col("original_verified")
    return df.withColumn("label", F.when(ok, "confirmed_action").otherwise("unverified_claim")).withColumn("state", F.when(ok, "confirmed").otherwise("unconfirmed"))


def pareto_tie_break(candidates: DataFrame, scores: list[str], most: int) -> DataFrame:
    """By the sum of the core scores, then id."""
    total = sum((F.col(s) for s in scores[1:]), F.col(scores[0]))
    return candidates.select("candidate_id", total.alias("score")).orderBy(F.col("score").desc(), "candidate_id").limit(most)


def quota_infeasible(candidates: DataFrame, minima: dict[str, float]) -> DataFrame:
    """Constraints that no candidate's dimension reaches: one maximum per dimension, no pairs."""
    tops = candidates.agg(*[F.coalesce(F.max(d), F.lit(0)).cast("double").alias(d) for d in minima])
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(float(m)).alias("minimum"), F.col(d).alias("best")) for d, m in minima.items()])
    return tops.select(F.explode(rows).alias("r")).select("r.*").where("best < minimum")


def frontier_projection(fast: DataFrame, slow: DataFrame) -> DataFrame:
    both = fast.withColumn("lane", F.lit("fast")).unionByName(slow.withColumn("lane", F.lit("slow")))
    return both.groupBy("surface").agg(F.max("version_available_at").alias("frontier"), F.max("latency_ms").alias("latency_ms"), F.count_if(F.col("lane") == "fast").alias("fast_items"))


def history_break(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id").agg(F.max("observed_at").alias("break_at")).withColumn("segment", F.lit(True)).withColumn("reset", F.lit(True))


def deterministic_snapshot(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Per case: at least two runs, the same fields in all, and none that read the personal domain (personal_read_count,
    null as 0); else the first rule broken."""
    same = F.count_distinct(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)) == 1
    out = runs.groupBy("case_id").agg(F.count("*").alias("runs"), same.alias("same"), F.coalesce(F.sum("personal_read_count"), F.lit(0)).alias("personal_reads"))
    error = F.when(F.col("runs") < 2, "TOO_FEW_RUNS").when(~F.col("same"), "DIVERGED").when(F.col("personal_reads") != 0, "PERSONAL_READ")
    return out.withColumn("error", error).withColumn("deterministic", F.col("error").isNull())


def reactivation(cycles: DataFrame, actions: DataFrame) -> DataFrame:
    good = actions.groupBy("signal_id").agg(F.count("*").alias("n"), F.bool_and(F.col("independent") & (F.coalesce("evidence_id", F.lit("")) != "")).alias("ok"))
    return cycles.join(good, "signal_id", "left").select("signal_id", (F.col("state").isin("decayed", "extinct") & F.coalesce("ok", F.lit(False))).alias("reactivated"))


# The largest shares that a lineage, an owner and the ten largest lineages may have, and the least effective number.
LIMITS = {"max_lineage": 0.05, "max_owner": 0.10, "top_ten": 0.35}
LEAST_EFFECTIVE = 30


def concentration(rows: DataFrame, group: str, lineage: str, owner: str) -> DataFrame:
    """Per group: hhi and effective number of lineages, the largest lineage's, the largest owner's and the ten largest
    lineages' shares, and the limits broken. Counted per lineage first, so ranks are over lineages, not rows."""
    n = rows.groupBy(group, lineage, owner).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    lineages = n.groupBy(group, lineage).agg(F.sum("c").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(whole))
    lineages = lineages.withColumn("rank", F.row_number().over(whole.orderBy(F.col("c").desc(), lineage)))
    squares = F.sum(F.col("p") * F.col("p"))
    by_lineage = lineages.groupBy(group).agg(squares.alias("hhi"), (1 / squares).alias("effective"), F.max("p").alias("max_lineage"), F.sum(F.when(F.col("rank") <= 10, F.col("p"))).alias("top_ten"))
    owners = n.groupBy(group, owner).agg(F.sum("c").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(whole)).groupBy(group).agg(F.max("p").alias("max_owner"))
    out = by_lineage.join(owners, by_lineage[group].eqNullSafe(owners[group])).drop(owners[group])
    broken = [F.when(F.round(F.col(c), 9) > limit, c) for c, limit in LIMITS.items()] + [F.when(F.round("effective", 9) < LEAST_EFFECTIVE, "effective")]
    return out.withColumn("broken", F.array_compact(F.array(*broken)))

"""Measures over time and strata: bursts, change, cutoffs, budgets, samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def velocity(counts: DataFrame, series: str, bucket: str, n: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(bucket)
    first = counts.withColumn("velocity", F.col(n) - F.lag(n).over(w))
    return first.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))


def cusum(counts: DataFrame, series: str, bucket: str, n: str, slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """Two-sided change points per series: ``up``, ``down``, ``alarm`` (UP or DOWN beyond ``limit``) and ``change_start``.

    In standard deviations of the series from its mean, less ``slack``. A side's sum, set back to 0 whenever it falls below,
    equals the running sum less its running minimum (0 included), so windows say it without a loop. A change starts in the
    bucket after the last one at 0. A series without spread has sums of 0.
    """
    whole, upto = Window.partitionBy(series), Window.partitionBy(series).orderBy(bucket)
    spread = F.stddev_pop(n).over(whole)
    z = F.when(spread > 0, F.round((F.col(n) - F.avg(n).over(whole)) / spread, 9)).otherwise(F.lit(0.0))
    out = counts.withColumn("z", z).withColumn("place", F.row_number().over(upto))
    for side, sign in (("up", 1), ("down", -1)):
        out = out.withColumn("sum", F.sum(sign * F.col("z") - slack).over(upto))
        out = out.withColumn(side, F.round(F.col("sum") - F.least(F.min("sum").over(upto), F.lit(0.0)), 6) + 0.0)
        rest = F.coalesce(F.max(F.when(F.col(side) == 0, F.col("place"))).over(upto), F.lit(0))
        out = out.withColumn("rest", rest)
        first = F.min(F.when(F.col("place") > F.col("rest"), F.struct("place", F.col(bucket).alias("b")))).over(Window.partitionBy(series, "rest"))
        out = out.withColumn(f"{side}_start", F.when(F.col(side) > 0, first["b"]))
    rose, fell = F.col("up") > limit, F.col("down") > limit
    out = out.withColumn("alarm", F.when(rose, "UP").when(fell, "DOWN")).withColumn("change_start", F.when(rose, F.col("up_start")).when(fell, F.col("down_start")))
    return out.drop("z", "place", "sum", "rest", "up_start", "down_start")


def medians(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The mean of the two middle values, from counts per distinct value and a running sum, so that no buffer holds a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    upto = counts.withColumn("hi", F.sum("c").over(w.orderBy(value))).withColumn("total", F.sum("c").over(w))
    at = lambda i: F.max(F.when((i < F.col("hi")) & (i >= F.col("hi") - F.col("c")), F.col(value)))
    low, high = at(F.floor((F.col("total") - 1) / 2)), at(F.floor(F.col("total") / 2))
    return upto.groupBy(group).agg(((low + high) / 2).alias(name))


def hourly(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The lowest level of all scales: counts per key and hour (hours since 1970). All wider windows are sums of these."""
    return rows.where(F.col(at).isNotNull()).groupBy(key, F.floor(F.unix_timestamp(at) / 3600).alias("hour")).agg(F.count("*").alias("n"))


def array_median(values: Column) -> Column:
    """The mean of the two middle values of a short array; null if it is empty."""
    ordered, size = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ordered, F.floor(i).cast("int"))
    return F.when(size > 0, (at((size - 1) / 2) + at(size / 2)) / 2)


def _against(rows: DataFrame, now: Column) -> DataFrame:
    """median, mad and robust_z of ``now`` against the array ``past``; robust_z is null where the MAD is 0 or there is no past."""
    out = rows.withColumn("median", array_median(F.col("past")))
    out = out.withColumn("mad", array_median(F.transform("past", lambda x: F.abs(x - F.col("median")))))
    return out.withColumn("robust_z", F.when(F.col("mad") > 0, (now - F.col("median")) / F.col("mad")))


def spike_robust(counts: DataFrame, series: str, days: int = 14) -> DataFrame:
    """Each hour's count against the same hour of the ``days`` days before: baselines, median, mad, robust_z.

    ``counts`` is of ``hourly``. An hour without a row counted 0, as long as anything at all was counted before it; earlier
    days are no baseline. No list is longer than ``days``.
    """
    slot = Window.partitionBy(series, F.col("hour") % 24).orderBy("hour").rangeBetween(-24 * days, -24)
    first = counts.agg(F.min("hour")).first()[0]
    out = counts.withColumn("past", F.collect_list("n").over(slot)).withColumn("baselines", F.least(F.lit(days), F.floor((F.col("hour") - F.lit(first)) / 24)).cast("long"))
    out = out.withColumn("past", F.concat("past", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.col("baselines") - F.size("past"), F.lit(0)).cast("int"))))
    return _against(out, F.col("n")).drop("past")


class Scale(NamedTuple):
    """A window of so many hours, compared with ``past`` windows that lie ``step`` hours apart."""

    hours: int
    step: int
    past: int


# The five scales with their baselines (same hour of 14 days, same weekday of 28 days, 13 weeks, 12 months).
SCALES = (Scale(1, 24, 14), Scale(6, 24, 14), Scale(24, 168, 4), Scale(168, 168, 13), Scale(672, 672, 12))


def multi_scale(counts: DataFrame, series: str, end: Column, scales: tuple[Scale, ...] = SCALES) -> DataFrame:
    """Per series and scale the current window's count and its own baselines: a row each, also where nothing was counted.

    ``counts`` is of ``hourly`` and read once: an hour belongs to one window of a scale at most, so hours go up to windows in
    one aggregation of all scales. A baseline counts if its whole window lies after the first hour counted at all.
    """
    age = (F.floor(F.unix_timestamp(end) / 3600) - F.col("hour")).alias("age")
    aged = counts.select(series, age, "n").where("age > 0")
    oldest = counts.select(age).agg(F.max("age")).first()[0] or 0
    which = F.explode(F.array(*[F.struct(F.lit(s.hours).alias("hours"), F.lit(s.step).alias("step"), F.lit(s.past).alias("past")) for s in scales]))
    rows = counts.select(series).distinct().select(series, which.alias("of scale")).select(series, "`of scale`.hours", "`of scale`.past")
    placed = aged.select(series, "age", "n", which.alias("of scale")).withColumn("windows back", F.floor((F.col("age") - 1) / F.col("`of scale`.step")).cast("int"))
    inside = placed.where((F.col("windows back") <= F.col("`of scale`.past")) & ((F.col("age") - 1) % F.col("`of scale`.step") < F.col("`of scale`.hours")))
    sums = inside.groupBy(series, F.col("`of scale`.hours").alias("hours"), "windows back").agg(F.sum("n").alias("n")).groupBy(series, "hours").agg(F.map_from_entries(F.collect_list(F.struct("windows back", "n"))).alias("by"))
    step = F.coalesce(*[F.when(F.col("hours") == s.hours, s.step) for s in scales])
    baselines = F.least(F.col("past"), F.greatest(F.floor((F.lit(oldest) - F.col("hours")) / step), F.lit(0))).cast("int")
    value = lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0).cast("long"))
    out = rows.join(sums, [series, "hours"], "left").withColumn("by", F.coalesce("by", F.map_from_entries(F.array().cast("array<struct<k:int,n:bigint>>")))).withColumn("wanted", F.col("past")).withColumn("baselines", baselines)
    out = out.withColumn("current", value(F.lit(0))).withColumn("past", F.when(F.col("baselines") > 0, F.transform(F.sequence(F.lit(1), F.col("baselines")), value)).otherwise(F.array().cast("array<bigint>")))
    out = _against(out, F.col("current")).withColumn("status", F.when(F.col("baselines") == F.col("wanted"), "ready").otherwise("warming"))
    return out.select(series, "hours", "current", F.col("baselines").cast("long").alias("baselines"), "median", "mad", "robust_z", "status")


def decline(counts: DataFrame, health: DataFrame, series: str, bucket: str, n: str, least: int) -> DataFrame:
    """Runs of at least ``least`` falls in a row, with how far they fell, while collection was healthy.

    ``health``: series, bucket, healthy. A fall into or out of a bucket that was not known to be healthy is none, and ends the
    run, so a broken collection never looks like a decline.
    """
    w = Window.partitionBy(series).orderBy(bucket)
    h = health.select(series, bucket, "healthy")
    known = counts.join(h, [series, bucket], "left").withColumn("healthy", F.coalesce("healthy", F.lit(False)))
    drop = F.lag(n).over(w) - F.col(n)
    fell = known.withColumn("drop", drop).withColumn("fell", F.coalesce(((drop > 0) & F.col("healthy") & F.lag("healthy").over(w)).cast("int"), F.lit(0)))
    run = fell.withColumn("island", F.sum(1 - F.col("fell")).over(w))
    return run.groupBy(series, "island").agg(F.sum("fell").alias("falls"), F.max(bucket).alias("ended"), F.sum(F.when(F.col("fell") == 1, F.col("drop")).otherwise(0)).alias("fallen")).where(F.col("falls") >= least).select(series, "falls", "fallen", "ended")


def first_seen(rows: DataFrame, key: str, source: str, at: str, gap_seconds: int) -> DataFrame:
    """First time and source of each key, and its first recurrence that is independent: after the gap, and by a source that
    had no part in the time before. Sources are pre-aggregated per key, so no row meets another."""
    per = rows.where(F.col(at).isNotNull()).groupBy(key, source).agg(F.min(at).alias("since"), F.count("*").alias("n"))
    first = F.min("since").over(Window.partitionBy(key))
    after = F.unix_timestamp("since") - F.unix_timestamp(first) >= gap_seconds
    marked = per.withColumn("first_at", first).withColumn("later", F.when(after, F.struct(F.col("since").alias("at"), F.col(source).alias("by"))))
    out = marked.groupBy(key).agg(F.min("first_at").alias("first_at"), F.min_by(source, F.struct("since", source)).alias("first_source"), F.min("later").alias("later"), F.count_if(F.col("later").isNotNull()).alias("independent_sources"), F.sum("n").alias("n"))
    return out.select(key, "first_at", "first_source", F.col("later.at").alias("recurred_at"), F.col("later.by").alias("recurred_by"), "independent_sources", "n")


def diffusion_layers(rows: DataFrame, key: str, layer: str, at: str) -> DataFrame:
    """Per key and day: new layers, layers so far, mentions so far and the entropy of their shares so far.

    Entropy is ln T - (sum of c ln c) / T, and a day changes c ln c only of the layers it mentions, so running sums of those
    changes give every day's entropy without a row per layer and day.
    """
    day = F.to_date(at).alias("day")
    daily = rows.where(F.col(at).isNotNull()).groupBy(key, layer, day).agg(F.count("*").alias("n"))
    upto = daily.withColumn("c", F.sum("n").over(Window.partitionBy(key, layer).orderBy("day")))
    weigh = lambda c: F.when(c > 0, c * F.ln(c)).otherwise(0.0)
    days = upto.groupBy(key, "day").agg(F.sum("n").alias("n"), F.count_if(F.col("c") == F.col("n")).alias("new_layers"), F.sum(weigh(F.col("c")) - weigh(F.col("c") - F.col("n"))).alias("change"))
    w = Window.partitionBy(key).orderBy("day")
    total = F.sum("n").over(w)
    entropy = F.round(F.ln(total) - F.sum("change").over(w) / total, 6) + 0.0
    return days.select(key, "day", "new_layers", F.sum("new_layers").over(w).alias("layers"), total.alias("mentions"), entropy.alias("entropy"))


def relation_break(rows: DataFrame, key: str, bucket: str, a: str, b: str, buckets: int, spreads: float = 3.0, least: int = 8) -> DataFrame:
    """Rolling correlation of a and b over ``buckets`` whole buckets, against the history of such correlations.

    Rows go into six moment sums per bucket once; a window's correlation is a function of the running sums, so no row is
    read twice. History is of windows that share no bucket with this one: ``was`` its mean, ``spread`` its deviation.
    ``status`` is broken beyond ``spreads`` deviations, warming below ``least`` earlier correlations or without one now.
    """
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    shift = both.groupBy(key).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"))  # about the means, so that no sum cancels
    x, y = F.col(a) - F.col("ma"), F.col(b) - F.col("mb")
    moments = {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    sums = both.join(shift, key).groupBy(key, bucket).agg(*[F.sum(v).alias(k) for k, v in moments.items()])
    recent = Window.partitionBy(key).orderBy(bucket).rangeBetween(1 - buckets, 0)
    rolled = sums.select(key, bucket, *[F.sum(k).over(recent).alias(k) for k in moments])
    c = F.col
    over = c("n") * c("xy") - c("x") * c("y")
    under = F.sqrt(F.greatest((c("n") * c("xx") - c("x") * c("x")) * (c("n") * c("yy") - c("y") * c("y")), F.lit(0.0)))
    rolled = rolled.withColumn("now", F.when(under > 0, over / under))
    before = Window.partitionBy(key).orderBy(bucket).rangeBetween(Window.unboundedPreceding, -buckets)
    out = rolled.withColumns({"past": F.count("now").over(before), "was": F.avg("now").over(before), "spread": F.stddev_samp("now").over(before)})
    status = F.when((c("past") < least) | c("now").isNull(), "warming").when(F.abs(c("now") - c("was")) > spreads * c("spread"), "broken").otherwise("holds")
    return out.select(key, bucket, "n", "now", "was", "spread", status.alias("status"))


def stratum_deficit(rows: DataFrame, stratum: str, targets: dict[str, float]) -> DataFrame:
    """Share of each target stratum with unknown in the denominator, its deficit and the deficit by target."""
    total = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(stratum) == s).alias(s) for s in targets])
    each = F.array(*[F.struct(F.lit(s).alias("stratum"), F.lit(t).alias("target"), (F.col(s) / F.col("total")).alias("share")) for s, t in targets.items()])
    return total.select(F.explode(each).alias("r")).select("r.*").withColumn("deficit", F.greatest(F.col("target") - F.col("share"), F.lit(0.0))).withColumn("normalised", F.col("deficit") / F.col("target"))


def seeded_exploration(rows: DataFrame, stratum: str, key: str, seed: str, each: int) -> DataFrame:
    """A reproducible sample: the ``each`` smallest keyed hashes per stratum."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("rank") <= each)


def lane_budget(rows: DataFrame, lane: str, order: list[Column], budget: dict[str, int]) -> DataFrame:
    allowed = F.coalesce(*[F.when(F.col(lane) == k, v) for k, v in budget.items()], F.lit(0))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).where(F.col("place") <= allowed)


def state_as_of(log: DataFrame, at: Column) -> DataFrame:
    return log.where(F.col("available_at") <= at).groupBy("aggregate_id").agg(F.max_by("to_state", F.struct("revision", "to_state")).alias("state"))


def processing_frontier(inputs: DataFrame, key: str) -> DataFrame:
    """Latest arrival such that every input up to it is terminal; null if the first isn't."""
    stop = inputs.groupBy(key).agg(F.min(F.when(~F.col("terminal"), F.col("arrived_at"))).alias("stop"))
    done = inputs.where("terminal").join(stop, key).where(F.col("stop").isNull() | (F.col("arrived_at") < F.col("stop")))
    return stop.select(key).join(done.groupBy(key).agg(F.max("arrived_at").alias("frontier")), key, "left")


def comparison_watermark(frontiers: DataFrame, required: int) -> DataFrame:
    """The least frontier; null unless all ``required`` keys have one."""
    return frontiers.agg(F.when(F.count("frontier") >= required, F.min("frontier")).alias("watermark"))


def data_cutoff(*times: Column) -> Column:
    """The least of the times; null if any is null (Spark's least would skip it)."""
    known = times[0].isNotNull()
    for t in times[1:]:
        known = known & t.isNotNull()
    return F.when(known, F.least(*times))


def service_slo(slots: DataFrame, least: int = 60) -> DataFrame:
    """On-time share over all planned slots and P95 lag by nearest rank ceil(0.95 n); few slots are still warming up."""
    n = F.sum("c").over(Window.partitionBy("service"))
    counts = slots.where("lag is not null").groupBy("service", "lag").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("hi", F.sum("c").over(Window.partitionBy("service").orderBy("lag"))).withColumn("rank", F.ceil(n * 0.95))
    p95 = ranked.where("hi >= rank").groupBy("service").agg(F.min("lag").alias("p95_lag"))
    base = slots.groupBy("service").agg(F.count("*").alias("slots"), F.avg(F.coalesce(F.col("on_time"), F.lit(False)).cast("double")).alias("on_time_rate"))
    return base.join(p95, "service", "left").withColumn("status", F.when(F.col("slots") < least, "warming_up").otherwise("measured"))


def four_state(rows: DataFrame) -> DataFrame:
    state = F.when(~F.col("in_purpose"), "NOT_OBSERVABLE").when(F.col("incomplete"), "COLLECTION_MISSING").when(F.col("versions") == 0, "SOURCE_SILENT").when(F.col("matches") == 0, "OBSERVED_ZERO").otherwise("OBSERVED")
    return rows.withColumn("state", state)


def collection_metrics(rows: DataFrame, group: str) -> DataFrame:
    """Weighted shares: observability of all opportunities, completion and cursor completeness of the observable ones.

    ``cursor_fraction`` is what of the planned cursor range is proven; unknown is 0, never all of it. Null without any.
    """
    w = lambda c: F.sum(F.when(F.col(c), F.col("weight")).otherwise(0.0))
    cursor = F.sum(F.when(F.col("observed"), F.col("weight") * F.coalesce(F.col("cursor_fraction"), F.lit(0.0))).otherwise(0.0))
    return rows.groupBy(group).agg(F.try_divide(w("observed"), F.sum("weight")).alias("observability"), F.try_divide(w("complete"), w("observed")).alias("completion"), F.try_divide(cursor, w("observed")).alias("cursor_completeness"))


# Days after which a candidate is decided on and its result recorded.
HORIZONS = (7, 30, 90, 180, 365, 730)


def horizon_obligations(candidates: DataFrame, decisions: DataFrame, results: DataFrame, days: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(candidate_id, horizon, error) wherever a candidate has not exactly one decision and one result at a horizon.

    Both are counted per candidate and horizon before they meet; those of unknown candidates or horizons are NOT_DUE.
    """
    due = candidates.select("candidate_id").distinct().select("candidate_id", F.explode(F.array(*map(F.lit, days))).alias("horizon"), F.lit(True).alias("due"))
    count = lambda df, name: df.groupBy("candidate_id", F.col("horizon").cast("int").alias("horizon")).agg(F.count("*").alias(name))
    met = due.join(count(decisions, "decisions"), ["candidate_id", "horizon"], "full").join(count(results, "results"), ["candidate_id", "horizon"], "full")
    wrong = [F.when(F.col("due").isNull(), "NOT_DUE")]
    for name in ("decisions", "results"):
        n = F.coalesce(F.col(name), F.lit(0))
        wrong += [F.when(F.col("due") & (n == 0), f"{name[:-1].upper()}_MISSING"), F.when(F.col("due") & (n > 1), f"{name[:-1].upper()}_DOUBLE")]
    return met.select("candidate_id", "horizon", F.explode(F.array_compact(F.array(*wrong))).alias("error"))


def independence_bounds(rows: DataFrame, group: str) -> DataFrame:
    known = F.count_distinct(F.when(F.col("confirmed"), F.col("origin_id")))
    out = rows.groupBy(group).agg(known.alias("lower"), F.count_if(~F.col("confirmed")).alias("unknown"), F.count("*").alias("n"))
    return out.select(group, "lower", (F.col("lower") + F.col("unknown")).alias("upper"), (F.col("unknown") / F.col("n")).alias("unknown_share"))


def ledger_chain(rows: DataFrame, key: str, order: str, within_seconds: int = 300) -> DataFrame:
    """Rows whose previous hash is not that of the row before, or that were not anchored in time, each with every error."""
    before = F.lag("hash").over(Window.partitionBy(key).orderBy(order))
    late = F.unix_timestamp("anchored_at") - F.unix_timestamp("at")
    wrong = [F.when(~F.col("previous_hash").eqNullSafe(before), "CHAIN_BROKEN"), F.when(F.col("anchored_at").isNull(), "ANCHOR_MISSING"), F.when((late < 0) | (late > within_seconds), "ANCHOR_LATE")]
    return rows.withColumn("errors", F.array_compact(F.array(*wrong))).select(key, order, F.explode("errors").alias("error"))


def emission_dedup(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first emission of a key creates, later ones append."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("emission_key", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)).withColumn("action", F.when(place == 1, "create").otherwise("append"))


def supersession(rows: DataFrame, key: str, order: list[str], begin: str) -> DataFrame:
    return rows.withColumn("projected_to", F.lead(begin).over(Window.partitionBy(key).orderBy(*order)))


class Cross(NamedTuple):
    """A cross table: each value of ``row`` wants ``least`` distinct ``column`` values in the last ``days``, and one row with ``also``."""

    row: str
    column: str
    days: int
    least: int
    also: str | None = None


def cross_cells(items: DataFrame, at: str, end: Column, tables: list[Cross]) -> DataFrame:
    """A row per table and row value ever seen: distinct columns held and items in the rolling window, the target and whether it is met.

    One pass: an item offers a cell to each table; cells are made distinct before columns are counted, so a large cell is one
    row. A row value that nothing was seen of lately stays, with 0 held.
    """
    age = F.unix_timestamp(end) - F.unix_timestamp(at)
    cell = lambda t: F.struct(F.lit(f"{t.row} x {t.column}").alias("cross_table"), F.lit(t.least).alias("target"), F.col(t.row).cast("string").alias("cell_row"), F.col(t.column).cast("string").alias("cell"),
                              ((age > 0) & (age <= t.days * 86400)).alias("recent"), F.coalesce(F.expr(t.also or "true"), F.lit(False)).alias("special"))
    cells = items.select(F.explode(F.array(*map(cell, tables))).alias("c")).select("c.*")
    by = ["cross_table", "target", "cell_row"]
    distinct = cells.groupBy(*by, "cell").agg(F.count_if("recent").alias("n"), F.bool_or(F.col("recent") & F.col("special")).alias("special"))
    rows = distinct.groupBy(*by).agg(F.count_if((F.col("n") > 0) & F.col("cell").isNotNull()).alias("held"), F.sum("n").alias("items"), F.coalesce(F.bool_or("special"), F.lit(False)).alias("special"))
    return rows.withColumn("met", (F.col("held") >= F.col("target")) & F.col("special"))


def signal_admission(rows: DataFrame, stratum: str, kind: str, score: str, admit: float = 0.9, strong: float = 0.95) -> DataFrame:
    """Rows at or above the percentiles of their stratum, with how many of their kind the stratum admits."""
    pr = F.percent_rank().over(Window.partitionBy(stratum).orderBy(score))
    got = rows.withColumn("admission", F.when(pr >= strong, "strong").when(pr >= admit, "admitted")).where("admission is not null")
    return got.withColumn("of_type", F.count("*").over(Window.partitionBy(stratum, kind)))


# Days of history after which hourly, daily and seasonal baselines may be used.
HISTORY = ((28, "hourly"), (90, "daily"), (365, "seasonal"))


def baseline_status(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Per key the days between its first and last row, the widest baseline they allow, and what the next one needs."""
    days = F.datediff(F.max(at), F.min(at))
    out = rows.groupBy(key).agg(days.cast("long").alias("days"))
    status, after = F.lit("warming"), F.lit(None).cast("int")
    for least, name in HISTORY:
        status = F.when(F.col("days") >= least, name).otherwise(status)
    for least, _ in reversed(HISTORY):
        after = F.when(F.col("days") < least, least).otherwise(after)
    return out.select(key, "days", status.alias("status"), after.alias("next_at"))


def candidate_conversion(rows: DataFrame, kind: str, outcomes: list[str]) -> DataFrame:
    """Per kind: candidates, the share that is watched and after how many days, and of those the share of each outcome, the
    share still open, and the days from watching to an outcome. Shares of nothing are null."""
    days = lambda a, b: F.avg(F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 86400))
    watched = F.count("watched_at")
    share = lambda test: F.try_divide(F.count_if(F.col("watched_at").isNotNull() & test), watched)
    return rows.groupBy(kind).agg(
        F.count("*").alias("candidates"), (watched / F.count("*")).alias("watch_rate"), days("at", "watched_at").alias("days_to_watch"),
        *[share(F.col("outcome") == o).alias(f"{o}_share") for o in outcomes], share(F.col("outcome").isNull()).alias("open_share"), days("watched_at", "ended_at").alias("days_to_outcome"),
    )

"""Windows, as-known reads, replay, latest items."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


SLICES, SLICE_ROWS = 64, 1 << 22


def window_assign(events: DataFrame, windows: DataFrame, at: str = "ts") -> DataFrame:
    """Each event with how many half-open windows hold it (matches), the least window_id and the latest end of them.

    A sweep over time: starts, ends and events go through one sort, in slices of time cut at the events' quantiles; a
    slice with many events is dealt out further, and each part gets the windows that reach into it, so a long window
    costs a row a slice, never a row a day. A task holds the windows that are open at one time. A null start or end leaves
    the window open there (an open end gives a null window_end); a window that ends before it begins holds nothing; an
    event without time is held by none.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shares = [i / SLICES for i in range(1, SLICES)]
    row = events.agg(F.percentile_approx(micros(at), shares, 1000).alias("cuts")).first()
    cuts = sorted(set(row["cuts"] or []))
    place = lambda t: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= t)) if cuts else F.lit(0)
    held = events.select(F.struct(*events.columns).alias("event"), micros(at).alias("at")).withColumn("slice", F.when(F.col("at").isNotNull(), place(F.col("at"))).otherwise(0))
    sizes = {r["slice"]: r["n"] for r in held.groupBy("slice").agg(F.count("*").alias("n")).collect()}  # SLICES rows
    parts = F.coalesce(*[F.when(F.col("slice") == k, -(-n // SLICE_ROWS)) for k, n in sizes.items() if n > SLICE_ROWS], F.lit(1))
    held = held.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts))
    known = windows.select(F.col("id").alias("window_id"), micros("start").alias("begin"), micros("end").alias("until"), "end").where("begin is null or until is null or begin < until")
    span = F.sequence(F.when(F.col("begin").isNull(), 0).otherwise(place(F.col("begin"))), F.when(F.col("until").isNull(), len(cuts)).otherwise(place(F.col("until"))))
    sliced = known.withColumn("slice", F.explode(span)).withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    kind = lambda k: F.lit(k).alias("kind")  # noqa: E731  at one time ends come first, then starts, then events
    none = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    of = ["window_id", "until", "end"]
    starts = sliced.select("slice", "part", F.coalesce("begin", F.lit(-(2**63) + 1)).alias("at"), kind(1), *of, none("event", held))
    ends = sliced.where("until is not null").select("slice", "part", F.col("until").alias("at"), kind(0), *of, none("event", held))
    marks = held.select("slice", F.col("part").cast("int").alias("part"), "at", kind(2), *[none(c, known) for c in of], "event")
    dealt = starts.unionByName(ends).unionByName(marks).repartition("slice", "part").sortWithinPartitions("slice", "part", "at", "kind")
    swept = dealt.mapInArrow(_sweep, StructType([StructField("event", held.schema["event"].dataType), StructField("window_id", known.schema["window_id"].dataType), StructField("window_end", known.schema["end"].dataType), StructField("matches", LongType())]))
    return swept.select(*[F.col("event")[c].alias(c) for c in events.columns], "window_id", "window_end", "matches")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of time, with the windows open then as two heaps whose closed entries are dropped when they come up."""
    place, open_now, by_id, by_end = None, 0, [], []
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        kinds, at = get("kind").to_numpy(), get("at").to_pylist()
        keys = list(zip(get("slice").to_pylist(), get("part").to_pylist()))
        ids, untils, ends = get("window_id").to_pylist(), get("until").to_pylist(), get("end")
        taken, first, last, count = np.flatnonzero(kinds == 2), [], [], []
        for i, kind in enumerate(kinds.tolist()):
            if keys[i] != place:
                place, open_now, by_id, by_end = keys[i], 0, [], []
            if kind == 1:
                until = 2**63 if untils[i] is None else untils[i]
                heapq.heappush(by_id, (ids[i], until))
                heapq.heappush(by_end, (-until, ends[i].as_py()))
                open_now += 1
            elif kind == 0:
                open_now -= open_now > 0
            else:
                now = at[i]
                while by_id and now is not None and by_id[0][1] <= now:
                    heapq.heappop(by_id)
                some = open_now > 0 and now is not None
                first.append(by_id[0][0] if some else None)
                last.append(by_end[0][1] if some else None)
                count.append(open_now if some else 0)
        events = get("event").take(pa.array(taken))
        yield pa.RecordBatch.from_arrays([events, pa.array(first, batch.schema.field("window_id").type), pa.array(last, batch.schema.field("end").type), pa.array(count, pa.int64())], ["event", "window_id", "window_end", "matches"])


def windows_validate(windows: DataFrame, contiguous: bool = False) -> DataFrame:
    """Windows of a series in order of start, then id, each against the next one; a null start comes last."""
    nxt = F.lead("start").over(Window.partitionBy("series").orderBy(F.col("start").asc_nulls_last(), "id"))
    code = F.when(F.col("end") <= F.col("start"), "WINDOW_EMPTY").when(F.col("end") > nxt, "WINDOWS_OVERLAP").when(F.lit(contiguous) & (F.col("end") != nxt), "REPORT_WINDOWS_GAP")
    return windows.withColumn("error", code).where("error is not null").select("series", "id", "error")


def late_classify(assigned: DataFrame, available: str) -> DataFrame:
    late = F.col(available) >= F.col("window_end")
    return assigned.withColumn("arrival_class", F.when(late, "PROCESSING_BACKFILL").otherwise("nominal"))


def record_as_known(df: DataFrame, at: Column) -> DataFrame:
    return df.where(F.col("available_at") <= at)


def event_as_known(df: DataFrame, at: Column, valid: Column | None = None) -> DataFrame:
    out = record_as_known(df, at)
    return out if valid is None else out.where((F.col("valid_status") != "known") | (F.col("valid_at") <= valid))


def version_as_known(df: DataFrame, at: Column, valid: Column) -> DataFrame:
    holds = lambda a, b, t: (F.col(a) <= t) & (F.col(b).isNull() | (t < F.col(b)))
    return df.where(holds("system_from", "system_to", at) & holds("valid_from", "valid_to", valid))


def derived_as_known(df: DataFrame, at: Column) -> DataFrame:
    return df.where((F.col("available_at") <= at) & (F.col("as_of") <= at))


def replay_dedup(events: DataFrame, group: str) -> DataFrame:
    before = F.lag("sequence").over(Window.partitionBy(group).orderBy("arrival_order"))
    out = events.withColumn("back", F.col("sequence") < before).groupBy(group).agg(F.count("*").alias("n"), F.count_distinct("item_id", "version_id").alias("arrivals"), F.bool_or("cursor_gap").alias("gap"), F.count_if("back").alias("out_of_order"))
    return out.select(group, "arrivals", (F.col("n") - F.col("arrivals")).alias("suppressed"), F.when(F.col("gap"), "COLLECTION_MISSING").alias("watermark_reason"), "out_of_order")


def latest_items(items: DataFrame, most: int, published_only: bool = False) -> DataFrame:
    kept = items.where("published_at is not null") if published_only else items
    return kept.orderBy(F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), "item_key").limit(most)


def publish_winner(attempts: DataFrame) -> DataFrame:
    """Winners' chain per surface: revisions rise by one, each names the snapshot before, the first none."""
    won = attempts.where("outcome = 'winner'")
    w = Window.partitionBy("surface_id").orderBy("revision")
    prev = F.lag("snapshot_id").over(w)
    code = F.when((F.lag("revision").over(w) + 1) != F.col("revision"), "REVISION_STEP").when(~F.col("previous_snapshot_id").eqNullSafe(prev), "PREVIOUS_SNAPSHOT")
    return won.withColumn("error", code).where("error is not null").select("surface_id", "revision", "error")


def cursor_monotone(uses: DataFrame, maximum: int) -> DataFrame:
    """Accepted uses whose cursor doesn't pass all earlier ones, or beyond the allowed number."""
    w = Window.partitionBy("token_id").orderBy("use_order").rowsBetween(Window.unboundedPreceding, -1)
    acc = uses.where("accepted")
    code = F.when(F.col("cursor") <= F.max("cursor").over(w), "CURSOR_NOT_MONOTONE").when(F.count("*").over(w) >= maximum, "TOKEN_USED_UP")
    return acc.withColumn("error", code).where("error is not null").select("token_id", "use_order", "error")

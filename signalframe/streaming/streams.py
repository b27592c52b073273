"""Structured Streaming forms of replay deduplication and the topic windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from signalframe.operators.trends import topic_tokens, with_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONGS = ("events", "arrivals", "out_of_order")
_TOTALS = StructType([*[StructField(c, LongType()) for c in _LONGS], StructField("last", StringType()), StructField("gap", BooleanType()), StructField("gap_now", BooleanType())])
_SEEN = StructType([StructField("item", StringType()), StructField("version", StringType()), StructField("until", LongType())])


def replay_dedup_stream(events: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each (item_id, version_id) within the watermark; state is dropped as it passes."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["item_id", "version_id"])


class _Replay(StatefulProcessor):
    """Per group: totals, and each (item, version) seen with the time after which it is forgotten.

    Each call to the state is a round trip, so what a batch saw is added by one call, and one timer stands for a group's next
    time to forget. A pair whose time moved on is added again; the latest counts, and the list is renewed once it is twice
    as long as its pairs.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.seen = handle.getListState("seen", _SEEN)

    def _known(self) -> tuple[dict[tuple, int], int]:
        known, rows = {}, 0
        for item, version, until in self.seen.get():
            known[item, version] = max(known.get((item, version), until), until)
            rows += 1
        return known, rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        arrival = [tuple(v.values()) if isinstance(v, dict) else v for v in batch["sequence_order"]]
        batch = batch.iloc[sorted(range(len(batch)), key=arrival.__getitem__)]
        held = self.totals.get()
        events, arrivals, out_of_order, last, gap, _ = held or (0, 0, 0, None, False, False)
        last, gap_now = None if last is None else int(last), bool(batch["cursor_gap"].fillna(False).any())
        known, held_rows = self._known() if held else ({}, 0)
        fresh = {}
        for item, version, sequence, ms in zip(batch["item_id"], batch["version_id"], batch["sequence"].tolist(), batch["at_ms"].tolist()):
            name, until = (item, version), ms + self.keep_ms
            arrivals += name not in known
            if known.get(name, until - 1) < until:
                known[name] = fresh[name] = until
            out_of_order += last is not None and sequence < last
            last = sequence
        if held_rows + len(fresh) > 2 * len(known):
            self.seen.put([(*name, until) for name, until in known.items()])
        elif fresh:
            self.seen.appendList([(*name, until) for name, until in fresh.items()])
        self.handle.registerTimer(min(known.values()))
        events += len(batch)
        self.totals.update((events, arrivals, out_of_order, str(last), gap or gap_now, gap_now))
        yield self._row(key, events, arrivals, out_of_order, gap or gap_now, gap_now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        left = {name: until for name, until in self._known()[0].items() if until > at}
        if left:
            self.seen.put([(*name, until) for name, until in left.items()])
            self.handle.registerTimer(min(left.values()))
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, events: int, arrivals: int, out_of_order: int, gap: bool, gap_now: bool) -> pd.DataFrame:
        status = lambda g: "COLLECTION_MISSING" if g else None
        return pd.DataFrame({"group": [str(key[0])], "events": [events], "arrivals": [arrivals], "suppressed": [events - arrivals], "watermark_reason": [status(gap)], "watermark_status": [status(gap_now) or "healthy"], "out_of_order": [out_of_order]})


REPLAYED = "group string, events long, arrivals long, suppressed long, watermark_reason string, watermark_status string, out_of_order long"


def replay_status_stream(events: DataFrame, group: str, order: str = "arrival_order", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Totals of ``replay_dedup`` per group as they stand after each batch, a row for every group that got events.

    Keyed state of our own: the totals, the last sequence number, whether any batch had a cursor gap, and every (item,
    version) with the event time until which its repeats are suppressed. A timer at that time drops it when the watermark
    passes, so the state holds totals and what was seen within ``delay`` of it. ``watermark_status`` follows the last batch,
    as a source that is whole again is healthy; ``watermark_reason`` stays. Needs the RocksDB state store.
    """
    keep_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    rows = events.withWatermark(at, delay).select(
        F.col(group).cast("string").alias("group"), at, F.col("item_id").cast("string").alias("item_id"), F.col("version_id").cast("string").alias("version_id"), F.col("sequence").cast("long").alias("sequence"),
        F.col(order).alias("sequence_order"), F.col("cursor_gap").alias("cursor_gap"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"))
    return rows.groupBy("group").transformWithStateInPandas(_Replay(keep_ms), StructType.fromDDL(REPLAYED), "update", "EventTime")


def trend_stream(items: DataFrame, window: str = "48 hours", slide: str = "12 hours", delay: str = "5 minutes", recent_hours: int = 12, mentions: int = 2, sources: int = 2) -> DataFrame:
    """Topics in sliding windows with the counts, thresholds and states of the batch; recent is the window's last hours.

    Two aggregations in a row, both kept by window: mentions per source, then sources per topic. In append mode a window is
    told once, when the watermark passes its end, and leaves both states; no state holds a list.
    """
    named = topic_tokens(items.withWatermark("published_at", delay)).withColumn("window", F.window("published_at", window, slide))
    recent = F.unix_timestamp("published_at") >= F.unix_timestamp(F.col("window.end")) - recent_hours * 3600
    per_source = named.groupBy("window", "topic_key", "source_id").agg(F.count_if(recent).alias("r"), F.count_if(~recent).alias("p"))
    counted = per_source.groupBy("window", "topic_key").agg(F.sum("r").alias("recent_mention_count"), F.sum("p").alias("prior_mention_count"), F.count("source_id").alias("source_count"))
    counted = counted.withColumn("mention_count", F.col("recent_mention_count") + F.col("prior_mention_count"))
    return with_state(counted.where((F.col("mention_count") >= mentions) & (F.col("source_count") >= sources) & (F.col("recent_mention_count") > 0)))


def trend_panes(items: DataFrame, pane: str = "12 hours") -> DataFrame:
    """Mentions per pane of time, topic and source. For each batch of a stream: panes of all batches add up, so a batch is
    kept as a few counts, no state is held and no late item is dropped."""
    named = topic_tokens(items).where("published_at is not null")
    return named.groupBy(F.window("published_at", pane)["start"].alias("pane"), "topic_key", "source_id").agg(F.count("*").alias("mentions"))


def trend_windows(panes: DataFrame, pane_hours: int = 12, window_panes: int = 4, recent_panes: int = 1, mentions: int = 2, sources: int = 2) -> DataFrame:
    """``trend_stream``'s windows, the last ones too, from the panes of ``trend_panes``: a window starts with every pane.

    Topics of too few sources go before their panes are dealt out to windows.
    """
    kept = panes
    if sources > 1:
        of = F.xxhash64("source_id")
        several = panes.where("source_id is not null").groupBy("topic_key").agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a <> b")
        kept = panes.join(several.select("topic_key"), "topic_key", "left_semi")
    placed = kept.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(window_panes - 1)))).withColumn("window_start", F.timestamp_seconds(F.unix_timestamp("pane") - F.col("back") * pane_hours * 3600))
    recent = F.col("back") >= window_panes - recent_panes
    per_source = placed.groupBy("window_start", "topic_key", "source_id").agg(F.sum(F.when(recent, F.col("mentions")).otherwise(0)).alias("r"), F.sum(F.when(~recent, F.col("mentions")).otherwise(0)).alias("p"))
    counted = per_source.groupBy("window_start", "topic_key").agg(F.sum("r").alias("recent_mention_count"), F.sum("p").alias("prior_mention_count"), F.count("source_id").alias("source_count"))
    counted = counted.withColumn("mention_count", F.col("recent_mention_count") + F.col("prior_mention_count"))
    return with_state(counted.where((F.col("mention_count") >= mentions) & (F.col("source_count") >= sources) & (F.col("recent_mention_count") > 0)))

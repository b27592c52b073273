"""Feeds to items, merges, published snapshots. Parquet and JSON only; the head of a revision is claimed last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.text import html_clean, time_parse
from signalframe.scratch import claim, claimed, claims

#: Children of a feed's element, as lists, since any may be repeated or missing. Names with a prefix are others.
ELEMENT = ", ".join(f"{name} array<struct<_VALUE: string, _href: string>>" for name in ("title", "link", "description", "summary", "pubDate", "published", "updated"))
_ATTRIBUTES = r"""(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*"""


def _elements(name: str, prefix: str = "") -> str:
    """Whole elements of this name at any depth, in document order."""
    tag = f"{prefix}{name}"
    return rf"(?s)<{tag}(?=[\s/>]){_ATTRIBUTES}(?:/>|>.*?</{tag}\s*>)"


ITEMS, ENTRIES = _elements("item"), _elements("entry", r"(?:[A-Za-z_][\w.-]*:)?")


def read_sources(spark, path: str, wanted: list[str] | None = None) -> DataFrame:
    """The enabled sources of a JSON registry, or those named."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")
    enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in rows.columns else F.lit(True)
    return rows.where(F.col("id").isin(wanted)) if wanted else rows.where(enabled)


def plain_xml(body):
    """The body with CDATA as escaped text, without comments, and with a bare & of HTML's own references escaped."""

    def escaped(part, i):
        inside = F.substring_index(part, "]]>", 1)
        text = F.replace(F.replace(F.replace(inside, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when((i == 0) | ~part.contains("]]>"), part).otherwise(F.concat(text, F.substring(part, F.length(inside) + 4, F.length(part))))

    joined = F.when(body.contains("<![CDATA["), F.array_join(F.transform(F.split(body, r"<!\[CDATA\["), escaped), "")).otherwise(body)
    bare = F.regexp_replace(joined, "(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def feed_parse(feeds: DataFrame, max_items: int = 20, max_summary: int = 320) -> DataFrame:
    """(source_id, body, language, region; source_name, publisher_region, max_items if there) -> items.

    Items are the ``item`` elements at any depth or, without any, the ``entry`` elements of any namespace, in document order;
    the first max_items of them, then those without title or link go. A field is the text of the first child of its name;
    a link without text is the first href of any link. A title is stripped only, the summary is cleaned and cut; it is the
    description or, if that is empty, the summary. The date is the first of pubDate, published and updated that is there.
    A body of broken XML (XML_INVALID) or without elements (NO_ITEMS, as a null body or plain text) gives one row with ``error``.
    """
    given = lambda name, other: F.coalesce(F.col(name), other) if name in feeds.columns else other
    region = F.coalesce("region", F.lit("未标注"))
    rows = feeds.select(
        "source_id", given("source_name", F.col("source_id").cast("string")).alias("source_name"), F.coalesce("language", F.lit("zh-CN")).alias("language"), region.alias("region"),
        given("publisher_region", region).alias("publisher_region"), given("max_items", F.lit(max_items)).cast("int").alias("most"), plain_xml(F.col("body")).alias("xml"))
    items = F.regexp_extract_all("xml", F.lit(ITEMS), F.lit(0))
    found = F.when(F.size(items) > 0, items).otherwise(F.regexp_extract_all("xml", F.lit(ENTRIES), F.lit(0)))
    bad = F.trim("xml").startswith("<") & F.from_xml("xml", "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull()
    of = ["source_id", "source_name", "language", "region", "publisher_region"]
    rows = rows.select(*of, "most", F.when(bad, F.array().cast("array<string>")).otherwise(found).alias("items"), F.when(bad, "XML_INVALID").otherwise("NO_ITEMS").alias("error"))
    each = rows.select(*of, F.explode(F.slice("items", F.lit(1), F.greatest("most", F.lit(0)))).alias("xml")).select(*of, F.from_xml("xml", ELEMENT, {"mode": "PERMISSIVE"}).alias("e"))
    text = lambda name: F.trim(F.coalesce(F.get(F.col("e")[name], F.lit(0))["_VALUE"], F.lit("")))
    first = lambda *texts: F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))
    link = first(text("link"), F.coalesce(F.get(F.filter(F.transform("e.link", lambda k: k["_href"]), lambda h: h.isNotNull()), F.lit(0)), F.lit("")))
    each = each.select(*of, text("title").alias("title"), link.alias("source_url"), first(html_clean(text("description")), html_clean(text("summary"))).alias("full"), first(text("pubDate"), text("published"), text("updated")).alias("at"))
    parsed = each.where((F.col("title") != "") & (F.col("source_url") != "")).select(
        *of, "title", "source_url", F.substring("full", 1, max_summary).alias("summary"), time_parse(F.col("at")).alias("published_at"),
        item_key(F.col("source_id"), F.col("source_url")).alias("item_key"), content_hash(F.col("title"), F.col("full"), F.col("source_url")).alias("content_hash"), F.lit(None).cast("string").alias("error"))
    empty = rows.where(F.coalesce(F.size("items"), F.lit(-1)) <= 0).select(*of, "error")
    return parsed.unionByName(empty, allowMissingColumns=True)


def item_key(source, link):
    return F.sha2(F.concat_ws("\0", source, link), 256)


def content_hash(title, summary, link):
    return F.sha2(F.concat_ws("\0", title, summary, link), 256)


def item_upsert(rows: DataFrame, order: str, key: str, first: list[str], last: list[str]) -> DataFrame:
    """Merge by key: ``first`` columns keep the first arrival's value, ``last`` take the latest's. No window, one shuffle."""
    by = lambda some: F.struct(order, F.xxhash64(*some))  # noqa: E731  equal orders go by the columns' hash
    return rows.groupBy(key).agg(*[F.min_by(c, by(first)).alias(c) for c in first], *[F.max_by(c, by(last)).alias(c) for c in last], F.count("*").alias("arrivals"))


def fetch_status(log: DataFrame) -> DataFrame:
    return log.groupBy("source_id").agg(F.max(F.struct("fetched_at", "item_count", "error")).alias("s")).select("source_id", "s.*")


def source_summary(sources: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy("source_id").agg(F.count("item_key").alias("n"))
    return sources.join(n, "source_id", "left").withColumn("item_count", F.coalesce("n", F.lit(0))).drop("n")


def next_revision(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("surface_id").agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"))


def head_of(spark, base: str, surface: str) -> tuple[int, str | None]:
    """(revision, attempt) of the surface's head; (0, None) before the first."""
    names = claims(spark, f"{base}/head/{surface}")
    return (int(names[-1]), claim(spark, f"{base}/head/{surface}/{names[-1]}")) if names else (0, None)


def publish(snapshot: DataFrame, cards: DataFrame, trends: DataFrame, base: str, surface: str, expected: int) -> int:
    """Appends revision expected + 1 and then moves the head, if that is at ``expected`` still.

    Any number of writers may try: each writes its parts under an attempt's name of its own, and the head of a revision is
    a file that only one can create. The others get the error, and what they or failed ones left is never read.
    """
    spark, attempt = snapshot.sparkSession, uuid.uuid4().hex
    stale = lambda head: ValueError(f"STALE_REVISION (RADAR_HEAD_CAS_MISMATCH): head is {head}, expected {expected}")
    head, _ = head_of(spark, base, surface)
    if head != expected:
        raise stale(head)
    if cards.limit(1).count() == 0:
        raise ValueError("CARDS_REQUIRED")
    for name, df in (("snapshots", snapshot), ("cards", cards), ("trends", trends)):
        parts = df.withColumns({"surface_id": F.lit(surface), "revision": F.lit(head + 1)})
        parts.write.partitionBy("surface_id", "revision").parquet(f"{base}/{name}/attempt={attempt}")
    if not claimed(spark, f"{base}/head/{surface}/{head + 1:012d}", attempt):
        raise stale(head_of(spark, base, surface)[0])
    return head + 1


def read_revision(spark, base: str, surface: str, revision: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshot, cards and trends of a published revision, from its winning attempt's folder alone."""
    attempt = claim(spark, f"{base}/head/{surface}/{revision:012d}")
    return tuple(spark.read.parquet(f"{base}/{n}/attempt={attempt}") for n in ("snapshots", "cards", "trends"))


def read_head(spark, base: str, surface: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshot, cards and trends of the head revision."""
    return read_revision(spark, base, surface, head_of(spark, base, surface)[0])


def card_projection(items: DataFrame, most: int) -> DataFrame:
    """The latest items as cards with a UTC+8 time text and their place."""
    from signalframe.operators.temporal import latest_items

    top = latest_items(items, most)
    by = Window.orderBy(F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), "item_key")  # over ``most`` rows
    local = F.col("published_at") + F.expr("interval 8 hours")
    return top.select("item_key", "title", F.when(F.coalesce("summary", F.lit("")) == "", "-").otherwise(F.col("summary")).alias("summary"), F.date_format(local, "MM-dd HH:mm").alias("metric_value"), (F.row_number().over(by) - 1).alias("sort_order"))

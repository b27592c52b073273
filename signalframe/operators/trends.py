"""Topics across independent sources in two time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.text import tokens_en, tokens_han
from signalframe.scratch import written

UNSET = "未标注"
SOURCE = ["source_id", "source_name", "region", "language"]
MASKED = 512  # sources whose set is kept as bits


def in_window(items: DataFrame, end: Column, hours: int = 48) -> DataFrame:
    """Items with a publication time in the window; 300 s of clock drift are let through."""
    at = F.unix_timestamp("published_at")
    return items.where((at >= F.unix_timestamp(end) - hours * 3600) & (at <= F.unix_timestamp(end) + 300))


def topic_tokens(items: DataFrame) -> DataFrame:
    """One row per item and topic: topic_key, topic, topic_language, topic_kind, beside the item's columns but its texts."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    zh = F.lower(F.coalesce("language", F.lit(""))).startswith("zh")
    found = items.withColumn("topic", F.explode(F.when(zh, tokens_han(text)).otherwise(tokens_en(text)))).withColumn("zh", zh)
    return found.select(
        *[c for c in items.columns if c not in ("title", "summary")],
        F.concat(F.when(F.col("zh"), "zh:").otherwise("en:"), F.col("topic")).alias("topic_key"), "topic",
        F.when(F.col("zh"), "zh-CN").otherwise("en").alias("topic_language"),
        F.when(~F.col("zh") & F.col("topic").contains(" "), "phrase").otherwise("term").alias("topic_kind"),
    )


def trend_aggregate(items: DataFrame, end: Column, hours: int = 48, recent_hours: int = 12, mentions: int = 2, sources: int = 2) -> DataFrame:
    """Topics with enough mentions and sources and any recent mention; items are filtered before tokens explode.

    Texts are cut once. A task hands on a row per topic that it saw, with counts and the set of its sources, so a topic that
    is everywhere costs a row a task; names of sources are looked up for the topics that pass. The set is one bit a source
    where there are up to MASKED of them, else a list.
    """
    recent = F.unix_timestamp("published_at") >= F.unix_timestamp(end) - recent_hours * 3600
    found = in_window(items, end, hours).withColumn("who", F.xxhash64(F.to_json(F.struct(*SOURCE))))  # of JSON, which tells nulls apart
    who = found.select("who", *SOURCE).distinct()
    few = sorted(who.limit(MASKED + 1).collect(), key=lambda r: r["who"])
    if len(few) <= MASKED:
        places = items.sparkSession.createDataFrame([(r["who"], i // 64, i % 64) for i, r in enumerate(few)], "who long, word int, bit int")
        found = found.join(F.broadcast(places), "who").withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))  # at most MASKED rows
    words = range(-(-len(few) // 64) if len(few) <= MASKED else 0)
    sets = [F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")).alias(f"set{k}") for k in words] or [F.collect_set("who").alias("who")]
    named = topic_tokens(found).withColumn("recent", recent)
    topics = named.groupBy("topic_key").agg(F.count_if("recent").alias("recent_mention_count"), F.count_if(~F.col("recent")).alias("prior_mention_count"), *sets)
    mention = F.col("recent_mention_count") + F.col("prior_mention_count")
    size = sum((F.bit_count(f"set{k}") for k in words), F.lit(0)) if words else F.size("who")
    possible = topics.where((mention >= mentions) & (size >= sources) & (F.col("recent_mention_count") > 0))
    if words:
        held = F.array_compact(F.array(*[F.when(F.call_function("getbit", f"set{i // 64}", F.lit(i % 64)) == 1, i) for i in range(len(few))]))
        told = lambda c: F.transform(F.col("held"), lambda i: F.get(F.array(*[F.lit(r[c]).cast("string") for r in few]), i))
        distinct = lambda c: F.array_sort(F.array_distinct(F.transform(told(c), lambda v: F.coalesce(v, F.lit(UNSET)))))
        passed = possible.withColumn("held", held).withColumns({"source_count": F.size(F.array_distinct(F.array_compact(told("source_id")))).cast("long"), **{f"{c}s": distinct(c) for c in SOURCE[1:]}})
    else:
        distinct = lambda c: F.array_sort(F.collect_set(F.coalesce(c, F.lit(UNSET)))).alias(f"{c}s")
        passed = possible.withColumn("who", F.explode("who")).join(who, "who").groupBy("topic_key").agg(
            *[F.first(c).alias(c) for c in ("recent_mention_count", "prior_mention_count")], F.size(F.collect_set("source_id")).cast("long").alias("source_count"), *[distinct(c) for c in SOURCE[1:]])
    passed = passed.where(F.col("source_count") >= sources)
    topic = F.substring_index("topic_key", ":", -1)  # no topic holds a colon
    zh = F.col("topic_key").startswith("zh:")
    return passed.select(
        "topic_key", topic.alias("topic"), F.when(zh, "zh-CN").otherwise("en").alias("topic_language"), F.when(~zh & topic.contains(" "), "phrase").otherwise("term").alias("topic_kind"),
        mention.alias("mention_count"), "recent_mention_count", "prior_mention_count", "source_count", "source_names", "regions", "languages",
        F.size("regions").alias("region_count"), F.size("languages").alias("language_count"),
    )


def with_state(trends: DataFrame) -> DataFrame:
    prior, recent = F.col("prior_mention_count"), F.col("recent_mention_count")
    return trends.withColumn("signal_state", F.when(prior == 0, "new").when(recent > prior, "rising").otherwise("watching"))


def with_growth(trends: DataFrame) -> DataFrame:
    prior, recent = F.col("prior_mention_count"), F.col("recent_mention_count")
    growth = F.when(prior > 0, F.round((recent - prior) / prior * 100, 1))
    text = F.when(growth.isNull(), None).otherwise(F.concat(F.when(growth > 0, "+").otherwise(""), growth.cast("string"), F.lit("%")))
    return trends.withColumn("growth_rate", growth).withColumn("growth_text", text)


def evidence_urls(items: DataFrame, end: Column, hours: int = 48, most: int = 4, topics: DataFrame | None = None) -> DataFrame:
    """Per topic its first distinct URLs, newest item first; of the topics in ``topics`` alone, if given.

    Ranked within topics, so no topic's list grows; a task hands on no more than ``most`` rows of a topic.
    """
    named = topic_tokens(in_window(items, end, hours)).select("topic_key", "source_url", "published_at", "fetched_at", "item_key")
    if topics is not None:
        named = named.join(topics.select("topic_key"), "topic_key", "left_semi")
    newest = F.struct(*[F.coalesce(-F.unix_micros(c), F.lit(2**62)).alias(c) for c in ("published_at", "fetched_at")], "item_key")
    first = named.groupBy("topic_key", "source_url").agg(F.min(newest).alias("at"))
    kept = first.withColumn("rank", F.row_number().over(Window.partitionBy("topic_key").orderBy("at", "source_url"))).where(F.col("rank") <= most)
    return kept.groupBy("topic_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_url"))), lambda s: s["source_url"]).alias("evidence_urls"))


LEAST_PIECE = 4  # characters of the shortest topic that another one can cover


def contained(topics: DataFrame) -> DataFrame:
    """(topic_key, b_topic_key): topics of LEAST_PIECE and more characters that lie within a longer one of their language, by
    equi-joins on words, as there are far fewer distinct words than topics.

    A topic without a space lies within one word of the other. One of several words starts with the end of a word, ends with
    the start of a later word, and has the words between in common. ``covers`` holds of the pair early, to keep few.
    """
    words = F.split("topic", " ")
    every = topics.select("topic_key", "topic_language", "len", "n", "names_set", words.alias("w"))
    named = topics.where(F.col("len") >= LEAST_PIECE).select(F.col("topic").alias("part"), words.alias("w"), *[F.col(c).alias(f"a_{c}") for c in ("topic_key", "topic_language", "len", "n", "names_set")])
    single, several = named.where(F.size("w") == 1).drop("w"), named.where(F.size("w") > 1)
    ends = several.select("part", F.col("w")[0].alias("head"), F.element_at("w", -1).alias("tail"))
    word = every.select(F.explode("w").alias("word")).distinct().withColumn("size", F.length("word"))
    places = lambda last: F.explode(F.sequence(F.lit(1), last))
    cut = word.where(F.col("size") >= LEAST_PIECE).select("word", "size", places(F.col("size") - LEAST_PIECE + 1).alias("at")).select("word", "at", F.explode(F.sequence(F.lit(LEAST_PIECE), F.col("size") - F.col("at") + 1)).alias("many"))
    inside = cut.select("word", F.substring(F.col("word"), F.col("at"), F.col("many")).alias("part")).distinct().join(single, "part")
    covers = (F.col("a_topic_language") == F.col("topic_language")) & (F.col("a_len") < F.col("len")) & (F.col("a_n") <= F.col("n")) & (F.col("a_names_set").bitwiseAND(F.bitwise_not("names_set")) == 0)
    pair = [F.col("a_topic_key").alias("topic_key"), F.col("topic_key").alias("b_topic_key")]
    one = every.withColumn("word", F.explode(F.array_distinct("w"))).join(inside, "word").where(covers).select(*pair)
    at = F.substring(F.col("word"), F.col("at"), F.col("size") + 1)
    suffix = word.select("word", "size", places(F.col("size") + 1).alias("at")).select("word", at.alias("head")).join(ends.select("head").distinct(), "head").select(F.col("word").alias("first"), "head")
    prefix = word.select("word", places(F.col("size") + 1).alias("at")).select("word", F.substring(F.col("word"), F.lit(1), F.col("at") - 1).alias("tail")).join(ends.select("tail").distinct(), "tail").select(F.col("word").alias("last"), "tail")
    spans = every.where(F.size("w") > 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("w"))))
    spans = spans.select("topic_key", "topic_language", "len", "n", "names_set", F.element_at("w", F.col("i")).alias("first"), F.element_at("w", F.col("j")).alias("last"), F.slice("w", F.col("i") + 1, F.col("j") - F.col("i") - 1).alias("between"))
    met = spans.join(suffix, "first").join(prefix, "last").withColumn("part", F.array_join(F.concat(F.array("head"), F.col("between"), F.array("tail")), " "))
    many = met.where(F.length("part") < F.col("len")).join(several.drop("w"), "part").where(covers).select(*pair)
    return one.unionByName(many).distinct()


def fragment_consolidation(trends: DataFrame, tie_mode: str = "reference") -> DataFrame:
    """Drops topics that a longer, or equal and better, topic of the same sources covers.

    Latin topics are covered by longer ones that contain them, Han topics by those that share a 3-gram (or 2-gram, for topics
    of two). Every topic is compared with all others, survivors or not. Pairs are kept only if the number and a bit set of
    the sources' names allow it; the names themselves join the pairs that are left. ``stable`` keeps the smaller of two
    that would drop each other.
    """
    trends = written(trends, "trends")
    han = F.col("topic").rlike(r"^\p{IsHan}+$")
    names_set = F.aggregate("source_names", F.lit(0).cast("long"), lambda bits, name: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(name), F.lit(64)).cast("int"))))
    base = trends.select("topic_key", "topic", "topic_language", "source_count", "mention_count", F.length("topic").alias("len"), han.alias("han"), F.size(F.array_distinct("source_names")).alias("n"), names_set.alias("names_set"))
    latin = contained(base.where(~F.col("han")))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("topic") - n + 1, F.lit(1))), lambda i: F.substring(F.col("topic"), i, F.lit(n)))
    own = F.when(F.length("topic") >= 3, grams(3)).otherwise(grams(2))
    offered = base.where("han").withColumn("part", F.explode(F.array_distinct(F.concat(grams(3), grams(2)))))
    a, b = base.where("han").withColumn("part", F.explode(F.array_distinct(own))), offered.select("part", *[F.col(c).alias(f"b_{c}") for c in base.columns])
    better = (F.col("b_source_count") > F.col("source_count")) | ((F.col("b_source_count") == F.col("source_count")) & (F.col("b_mention_count") >= F.col("mention_count")))
    if tie_mode == "stable":
        tied = (F.col("b_source_count") == F.col("source_count")) & (F.col("b_mention_count") == F.col("mention_count"))
        better = better & (~tied | (F.col("b_topic") < F.col("topic")))
    may = (F.col("n") <= F.col("b_n")) & (F.col("names_set").bitwiseAND(F.bitwise_not("b_names_set")) == 0)
    pairs = a.join(b, (a["part"] == b["part"]) & (a["topic_language"] == b["b_topic_language"])).where(
        (F.col("topic_key") != F.col("b_topic_key")) & may & ((F.col("b_len") > F.col("len")) | ((F.col("b_len") == F.col("len")) & better))
    ).select("topic_key", "b_topic_key").distinct().unionByName(latin)
    names = trends.select("topic_key", "source_names")
    covered = pairs.join(names, "topic_key").join(names.select(F.col("topic_key").alias("b_topic_key"), F.col("source_names").alias("b_source_names")), "b_topic_key")
    covered = covered.where(F.size(F.array_except("source_names", "b_source_names")) == 0)
    return trends.join(covered.select("topic_key"), "topic_key", "left_anti")


def trend_rank(trends: DataFrame, most: int | None = None) -> DataFrame:
    """Phrases first, then sources, recent, mentions, length, topic. A total order; the sort is range-partitioned."""
    by = [F.when(F.col("topic_kind") == "phrase", 0).otherwise(1), F.col("source_count").desc(), F.col("recent_mention_count").desc(), F.col("mention_count").desc(), F.length("topic").desc(), F.col("topic")]
    ranked = trends.orderBy(*by)
    return ranked.limit(most) if most else ranked


def trend_ids(trends: DataFrame, snapshot: str) -> DataFrame:
    return trends.withColumn("trend_id", F.concat(F.lit(f"{snapshot}-trend-"), F.substring(F.sha2("topic_key", 256), 1, 12)))

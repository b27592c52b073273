"""Operator id -> query over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from signalframe.functions import text as X
from signalframe.operators import closure, coverage, signals, temporal, trends
from signalframe.plans.views import ITEMS, end, items, table
from signalframe.sources import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def op(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ts(text: str):
    return F.lit(text).cast("timestamp")


# ---- topics
# Fixed values, spelt again so that the SQL does not follow the operator's own list.
STOP = """
'about', 'after', 'again', 'against', 'being', 'between', 'could', 'first', 'from', 'have', 'into', 'more', 'most', 'other',
'over', 'said', 'says', 'should', 'than', 'that', 'their', 'there', 'these', 'they', 'this', 'those', 'through', 'under', 'were',
'what', 'when', 'where', 'which', 'while', 'with', 'would', 'world', 'news', 'latest', 'report', 'reports', 'people',
'killed', 'fire', 'police', 'president', 'shooting', 'article', 'articles', 'story', 'stories', 'government',
'before', 'office', 'return', 'update', 'updates', 'call', 'calls', 'days', 'year', 'years', 'time', 'times',
'child', 'three', 'four', 'near', 'amid', 'been', 'home', 'authorities', 'major', 'live', 'takes',
'start', 'started', 'died', 'death', 'kill', 'attack',
'department', 'announced', 'provide', 'assistance', 'administration', 'plans', 'security', 'school', 'himself'
"""
TOKENS = ITEMS + f""",
w0 AS (SELECT item_key, unnest(regexp_extract_all(lower(title || ' ' || summary), '[a-z][a-z''-]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(lower(title || ' ' || summary), '[a-z][a-z''-]{{3,}}'), 1) AS i FROM items),
w1 AS (SELECT item_key, w, min(i) AS i FROM w0 WHERE w NOT IN ({STOP}) GROUP BY item_key, w),
w2 AS (SELECT item_key, w, lead(w) OVER (PARTITION BY item_key ORDER BY i) AS nx FROM w1),
tok AS (SELECT item_key, w AS topic, 'term' AS topic_kind FROM w2 UNION ALL SELECT item_key, w || ' ' || nx, 'phrase' FROM w2 WHERE nx IS NOT NULL),
named AS (SELECT t.topic, t.topic_kind, 'en:' || t.topic AS topic_key, i.* FROM tok t JOIN items i USING (item_key))"""
TREND = TOKENS + """,
agg AS (SELECT topic_key, topic, topic_kind, count(*) AS mention_count, count(*) FILTER (WHERE published_at >= TIMESTAMP '2024-01-02 12:00:00') AS recent_mention_count,
  count(*) FILTER (WHERE published_at < TIMESTAMP '2024-01-02 12:00:00') AS prior_mention_count, count(DISTINCT source_id) AS source_count,
  list_sort(list(DISTINCT source_name)) AS names, count(DISTINCT region) AS region_count, count(DISTINCT language) AS language_count
  FROM named WHERE published_at >= TIMESTAMP '2024-01-01 00:00:00' AND published_at <= TIMESTAMP '2024-01-03 00:05:00' GROUP BY 1, 2, 3),
trend AS (SELECT * FROM agg WHERE mention_count >= 2 AND source_count >= 2 AND recent_mention_count > 0)"""
GROW = "CASE WHEN prior_mention_count > 0 THEN round((recent_mention_count - prior_mention_count)::DOUBLE / prior_mention_count * 100, 1) END"
STATE = "CASE WHEN prior_mention_count = 0 THEN 'new' WHEN recent_mention_count > prior_mention_count THEN 'rising' ELSE 'watching' END"


def trend(spark, sf):
    return trends.trend_aggregate(items(spark, sf), end())


@op("tokens_en", f"WITH {TOKENS} SELECT item_key, topic AS token FROM tok")
def _(spark, sf):
    i = items(spark, sf)
    return i.select("item_key", F.explode(X.tokens_en(F.concat_ws(" ", "title", "summary"))).alias("token"))


@op("topic_tokens", f"WITH {TOKENS} SELECT item_key, topic_key, topic_kind FROM named")
def _(spark, sf):
    return trends.topic_tokens(items(spark, sf)).select("item_key", "topic_key", "topic_kind")


@op("trend_time_filter", f"WITH {ITEMS} SELECT item_key FROM items WHERE published_at >= TIMESTAMP '2024-01-02 00:00:00' AND published_at <= TIMESTAMP '2024-01-03 00:05:00'")
def _(spark, sf):
    return trends.in_window(items(spark, sf), end(), 24).select("item_key")


@op("trend_aggregate", f"WITH {TREND} SELECT topic_key, mention_count, recent_mention_count, prior_mention_count, source_count, region_count, language_count, array_to_string(names, ',') AS source_names FROM trend")
def _(spark, sf):
    return trend(spark, sf).select("topic_key", "mention_count", "recent_mention_count", "prior_mention_count", "source_count", F.col("region_count").cast("long"), F.col("language_count").cast("long"), F.array_join("source_names", ",").alias("source_names"))


@op("trend_state", f"WITH {TREND} SELECT topic_key, {STATE} AS signal_state FROM trend")
def _(spark, sf):
    return trends.with_state(trend(spark, sf)).select("topic_key", "signal_state")


@op("trend_growth", f"WITH {TREND}, g AS (SELECT topic_key, {GROW} AS growth_rate FROM trend) SELECT topic_key, growth_rate, CASE WHEN growth_rate IS NOT NULL THEN (CASE WHEN growth_rate > 0 THEN '+' ELSE '' END) || CAST(growth_rate AS VARCHAR) || '%' END AS growth_text FROM g")
def _(spark, sf):
    return trends.with_growth(trend(spark, sf)).select("topic_key", "growth_rate", "growth_text")


@op("trend_evidence_urls", f"""WITH {TREND}, u AS (SELECT topic_key, source_url, max(published_at) AS p, min(item_key) AS k FROM named SEMI JOIN trend USING (topic_key)
  WHERE published_at >= TIMESTAMP '2024-01-01 00:00:00' AND published_at <= TIMESTAMP '2024-01-03 00:05:00' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY p DESC, k) AS n FROM u) SELECT topic_key, string_agg(source_url, ' ' ORDER BY n) AS evidence_urls FROM r WHERE n <= 4 GROUP BY 1""")
def _(spark, sf):
    urls = trends.evidence_urls(items(spark, sf), end(), topics=trend(spark, sf))
    return urls.select("topic_key", F.array_join("evidence_urls", " ").alias("evidence_urls"))


KEPT = TREND + """,
starts AS (SELECT topic_key, topic AS other, unnest(range(1, length(topic) - 2)) AS a FROM trend),
sized AS (SELECT *, unnest(range(4, least(length(other) - a + 1, length(other) - 1) + 1)) AS n FROM starts),
held AS (SELECT DISTINCT t.topic_key, c.topic_key AS by_key FROM sized c JOIN trend t ON substring(c.other, c.a, c.n) = t.topic),
gone AS (SELECT DISTINCT h.topic_key FROM held h JOIN trend a ON a.topic_key = h.topic_key JOIN trend b ON b.topic_key = h.by_key WHERE list_has_all(b.names, a.names)),
kept AS (SELECT * FROM trend WHERE topic_key NOT IN (SELECT topic_key FROM gone))"""


def kept(spark, sf):
    return trends.fragment_consolidation(trend(spark, sf))


@op("fragment_consolidation", f"WITH {KEPT} SELECT topic_key FROM kept")
def _(spark, sf):
    return kept(spark, sf).select("topic_key")


@op("trend_rank", f"WITH {KEPT} SELECT topic, signal_state, mention_count, source_count FROM (SELECT *, {STATE} AS signal_state FROM kept ORDER BY CASE WHEN topic_kind = 'phrase' THEN 0 ELSE 1 END, source_count DESC, recent_mention_count DESC, mention_count DESC, length(topic) DESC, topic LIMIT 12)")
def _(spark, sf):
    return trends.trend_rank(trends.with_state(kept(spark, sf)), 12).select("topic", "signal_state", "mention_count", "source_count")


@op("trend_id", f"WITH {TREND} SELECT topic_key, 's1-trend-' || substring(sha256(topic_key), 1, 12) AS trend_id FROM trend")
def _(spark, sf):
    return trends.trend_ids(trend(spark, sf), "s1").select("topic_key", "trend_id")


# ---- sources and items
TAGLESS = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
NAME = "&(apos|amp|quot|gt|lt|#[0-9]+|#[xX][0-9A-Fa-f]+);"
POINT = "CAST(CASE WHEN lower(x[2]) = 'x' THEN '0x' || x[3:] ELSE x[2:] END AS BIGINT)"
CHARACTER = f"CASE x WHEN 'apos' THEN chr(39) WHEN 'amp' THEN '&' WHEN 'quot' THEN '\"' WHEN 'gt' THEN '>' WHEN 'lt' THEN '<' ELSE chr(CAST({POINT} AS INTEGER)) END"


def clean_sql(column: str) -> str:
    """html_clean as SQL: the gaps between references and the characters they name, joined in turn."""
    bare = TAGLESS.format(column)
    names = f"list_transform(regexp_extract_all({bare}, '{NAME}', 1), lambda x: {CHARACTER})"
    return f"array_to_string(list_transform(list_zip(string_split_regex({bare}, '{NAME}'), {names}), lambda z: z[1] || coalesce(z[2], '')), '')"


# Every page gets references by number and by name, and one that is undone only once.
MARKED = "html || ' &#' || (8000 + page_id % 300) || ';&#x' || printf('%x', 19968 + page_id % 500) || '; &amp;lt; &apos;'"


@op("html_clean", f"SELECT page_id, sha256({clean_sql('marked')}) AS clean_sha256 FROM (SELECT page_id, {MARKED} AS marked FROM pages)")
def _(spark, sf):
    k = F.col("page_id")
    marked = F.concat("html", F.lit(" &#"), (8000 + k % 300).cast("string"), F.lit(";&#x"), F.lower(F.hex(19968 + k % 500)), F.lit("; &amp;lt; &apos;"))
    return table(spark, sf, "pages").select("page_id", F.sha2(X.html_clean(marked), 256).alias("clean_sha256"))


@op("summary_truncate", "SELECT doc_id, substring(text, 1, 320) AS summary FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 320).alias("summary"))


@op("item_keys", f"WITH {ITEMS} SELECT item_key, sha256(source_id || chr(31) || source_url) AS item_hash, sha256(title || chr(31) || summary || chr(31) || source_url) AS content_hash FROM items")
def _(spark, sf):
    sep = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256)  # noqa: E731  DuckDB texts hold no NUL; feeds.item_key joins by NUL
    return items(spark, sf).select("item_key", sep("source_id", "source_url").alias("item_hash"), sep("title", "summary", "source_url").alias("content_hash"))


@op("item_upsert", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(value, event_id) AS last_value, count(*) AS arrivals FROM events GROUP BY user_id")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("first_type", F.col("event_type")).withColumn("last_value", F.col("value"))
    return feeds.item_upsert(e, "event_id", "user_id", ["first_type"], ["last_value"])


@op("fetch_status", "SELECT CAST(user_id AS VARCHAR) AS source_id, max(ts) AS fetched_at, arg_max(value, ts) AS item_count, arg_max(CASE WHEN event_type = 'error' THEN 'E' END, ts) IS NOT NULL AS failed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("fetched_at"), F.col("value").alias("item_count"), F.when(F.col("event_type") == "error", "E").alias("error"))
    return feeds.fetch_status(log).select("source_id", "fetched_at", "item_count", F.col("error").isNotNull().alias("failed"))


@op("source_summary", "SELECT s_suppkey, count(l_orderkey) AS item_count FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"))
    i = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("item_key"))
    return feeds.source_summary(s, i).select(F.col("source_id").alias("s_suppkey"), "item_count")


@op("snapshot_next_revision", "SELECT o_custkey AS surface_id, count(*) + 1 AS next_revision FROM orders GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("surface_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("revision"))
    return feeds.next_revision(o)


@op("latest_items", f"WITH {ITEMS} SELECT item_key FROM items ORDER BY published_at DESC NULLS LAST, fetched_at DESC, item_key LIMIT 50")
def _(spark, sf):
    return temporal.latest_items(items(spark, sf), 50).select("item_key")


@op("card_projection", f"WITH {ITEMS} SELECT item_key, strftime(published_at + INTERVAL 8 HOUR, '%m-%d %H:%M') AS metric_value, row_number() OVER (ORDER BY published_at DESC, fetched_at DESC, item_key) - 1 AS sort_order FROM (SELECT * FROM items ORDER BY published_at DESC NULLS LAST, fetched_at DESC, item_key LIMIT 8)")
def _(spark, sf):
    return feeds.card_projection(items(spark, sf), 8).select("item_key", "metric_value", F.col("sort_order").cast("long"))


@op("card_watermark", f"WITH {ITEMS} SELECT min(published_at) AS watermark FROM (SELECT * FROM items ORDER BY published_at DESC NULLS LAST, fetched_at DESC, item_key LIMIT 8)")
def _(spark, sf):
    return temporal.latest_items(items(spark, sf), 8).agg(F.min("published_at").alias("watermark"))


@op("publish_report", f"WITH {ITEMS} SELECT source_id, count(*) AS fetched, count(DISTINCT item_key) AS inserted FROM items GROUP BY 1")
def _(spark, sf):
    return items(spark, sf).groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_distinct("item_key").alias("inserted"))


# ---- coverage and delays
DELAYS = """d AS (SELECT o_orderpriority AS language, o_orderdate AS published_at, l_shipdate AS discovered_at, l_shipdate + to_hours(l_linenumber) AS version_available_at,
 l_shipdate + to_hours(l_linenumber * 2) AS processed_at, l_shipdate + to_hours(8) AS nominal_window_end FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def delays(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    h = lambda n: F.timestamp_seconds(F.unix_timestamp("l_shipdate") + n * 3600)
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(F.col("o_orderpriority").alias("language"), F.col("o_orderdate").alias("published_at"), F.col("l_shipdate").alias("discovered_at"),
        h(F.col("l_linenumber")).alias("version_available_at"), h(F.col("l_linenumber") * 2).alias("processed_at"), h(8).alias("nominal_window_end"))


def _quant(col, q):
    return f"max(CASE WHEN r_{col} - 1 = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT) THEN {col} END)"


@op("delay_quantiles", f"""WITH {DELAYS}, s AS (SELECT language, CAST(epoch(discovered_at) - epoch(published_at) AS BIGINT) AS d, CAST(epoch(processed_at) - epoch(version_available_at) AS BIGINT) AS p, discovered_at > published_at AS dd, processed_at >= nominal_window_end AS pb FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY language) AS n, row_number() OVER (PARTITION BY language ORDER BY d) AS r_d, row_number() OVER (PARTITION BY language ORDER BY p) AS r_p FROM s)
SELECT language, {_quant('d', 0.5)} AS discovery_p50, {_quant('d', 0.95)} AS discovery_p95, {_quant('p', 0.5)} AS processing_p50, {_quant('p', 0.95)} AS processing_p95, bool_or(dd) AS discovery_delay, bool_or(pb) AS processing_backfill FROM r GROUP BY 1""")
def _(spark, sf):
    return coverage.delay_quantiles(delays(spark, sf))


def wilson_sql(k, n):
    n = f"greatest({n}, 1)::DOUBLE"
    p = f"({k} / {n})"
    m = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n}))"
    c, d = f"({p} + 3.8416 / (2 * {n}))", f"(1 + 3.8416 / {n})"
    return f"round(greatest(({c} - {m}) / {d}, 0.0), 9) AS ci_low, round(least(({c} + {m}) / {d}, 1.0), 9) AS ci_high"


LANG = "e AS (SELECT lang AS language, source AS assertion_type, toxic = 1 AS false_support, quality = 0 AS abstained FROM labels JOIN documents USING (doc_id))"


def language_rows(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").select(F.col("lang").alias("language"), F.col("source").alias("assertion_type"), (F.col("toxic") == 1).alias("false_support"), (F.col("quality") == 0).alias("abstained"))


@op("language_evaluation", f"""WITH {LANG}, g AS (SELECT language, assertion_type, count(*) AS n, count(*) FILTER (WHERE false_support) AS fs, count(*) FILTER (WHERE abstained) AS ab FROM e GROUP BY 1, 2)
SELECT language, assertion_type, n, (n - ab)::DOUBLE / greatest(n, 1) AS coverage, fs::DOUBLE / greatest(n - ab, 1) AS false_support_rate, ab::DOUBLE / greatest(n, 1) AS abstention_rate, {wilson_sql('fs', 'greatest(n - ab, 1)')},
((n - ab)::DOUBLE / greatest(n, 1) < 0.6 OR fs::DOUBLE / greatest(n - ab, 1) > 0.1) AS blocked FROM g""")
def _(spark, sf):
    return coverage.language_evaluation(language_rows(spark, sf), 0.1, 0.6)


@op("wilson_interval", f"SELECT source, {wilson_sql('count(*) FILTER (WHERE toxic = 1)', 'count(*)')} FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return g.select("source", F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"))


@op("blind_review", f"SELECT 'complete' AS result, count(*) FILTER (WHERE toxic = 1)::DOUBLE / count(*) AS omission_rate, {wilson_sql('count(*) FILTER (WHERE toxic = 1)', 'count(*)')} FROM labels")
def _(spark, sf):
    return coverage.blind_review(table(spark, sf, "labels").select((F.col("toxic") == 1).alias("major_omission")), "r").drop("reason_code")


CAND = "c AS (SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, r_name AS stratum, s_suppkey AS input_order FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def candidates(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("candidate_id"), F.col("r_name").alias("stratum"), F.col("s_suppkey").alias("input_order"))


@op("coverage_allocate", f"""WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY input_order) AS r FROM c), k AS (SELECT *, (stratum IN ('ASIA', 'AFRICA') AND r = 1) AS floor FROM f)
SELECT candidate_id, stratum, floor FROM k ORDER BY CASE WHEN NOT floor THEN 3 WHEN stratum = 'ASIA' THEN 1 ELSE 2 END, input_order LIMIT 6""")
def _(spark, sf):
    return coverage.coverage_allocate(candidates(spark, sf), ["ASIA", "AFRICA"], 6)


@op("coverage_missing", f"WITH {CAND}, w(stratum) AS (VALUES ('ASIA'), ('ATLANTIS')) SELECT stratum, 'QUOTA_INFEASIBLE' AS reason_code FROM w WHERE stratum NOT IN (SELECT stratum FROM c)")
def _(spark, sf):
    return coverage.missing_strata(candidates(spark, sf), ["ASIA", "ATLANTIS"])


@op("capacity_rotation", "WITH r AS (SELECT o_custkey AS surface, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT surface, count(*) FILTER (WHERE n <= 5) AS visible, count(*) FILTER (WHERE n > 5) AS debt, count(*) FILTER (WHERE o_totalprice < 5000) AS low_quality_fill FROM r GROUP BY 1")
def _(spark, sf):
    return coverage.capacity_rotation(table(spark, sf, "orders").select(F.col("o_custkey").alias("surface"), F.col("o_orderdate").alias("position"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("quality")), 5, 5000)


RANKS = """h AS (SELECT event_type AS scope, user_id, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1, 2),
x AS (SELECT scope, user_id, row_number() OVER (PARTITION BY scope ORDER BY a DESC, user_id) AS position FROM h), y AS (SELECT scope, user_id, row_number() OVER (PARTITION BY scope ORDER BY b DESC, user_id) AS position FROM h),
rk AS (SELECT x.scope, x.position, x.user_id AS f, y.user_id AS c FROM x JOIN y ON x.scope = y.scope AND x.position = y.position)"""


@op("ranking_flip", f"""WITH {RANKS}, t AS (SELECT a.scope, count(*) AS n FROM rk a JOIN rk b ON a.scope = b.scope AND a.f = b.c WHERE a.position <= 10 AND b.position <= 10 GROUP BY 1),
g AS (SELECT scope, count(*) AS n, count(*) FILTER (WHERE f <> c) AS flips, least(10, count(*)) AS k FROM rk GROUP BY 1)
SELECT scope, flips::DOUBLE / g.n AS flip_rate, coalesce(t.n, 0)::DOUBLE / k AS top_k_overlap, flips::DOUBLE / g.n > 0.2 AS coverage_shift, coalesce(t.n, 0)::DOUBLE / k < 0.8 AS degraded_coverage FROM g LEFT JOIN t USING (scope)""")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("scope"), "user_id").agg(F.count_if(F.col("ts") < ts("2024-01-16")).alias("a"), F.count_if(F.col("ts") >= ts("2024-01-16")).alias("b"))
    side = lambda c, name: e.select("scope", F.col("user_id").alias(name), F.row_number().over(Window.partitionBy("scope").orderBy(F.col(c).desc(), "user_id")).alias("position"))
    return coverage.ranking_flip(side("a", "fixed_id").join(side("b", "current_id"), ["scope", "position"]), 10, 0.2)


ATT = "a AS (SELECT l_suppkey AS surface, l_partkey AS content_id, l_quantity AS minutes, l_returnflag = 'R' AS hidden FROM lineitem)"


@op("attention_budget", f"WITH {ATT}, g AS (SELECT surface, count(*) AS n, sum(minutes) AS m, bool_or(hidden) AS h, count(DISTINCT content_id) AS d FROM a GROUP BY 1) SELECT surface, CASE WHEN n > 620 THEN 'ATTENTION_BUDGET_EXCEEDED' WHEN m > 15500 THEN 'ATTENTION_MINUTES_EXCEEDED' WHEN h THEN 'EXPLORATION_UNREACHABLE' WHEN d < n THEN 'ATTENTION_DUPLICATE' END AS first_error FROM g")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("surface"), F.col("l_partkey").alias("content_id"), F.col("l_quantity").alias("minutes"), F.lit("random_exploration").alias("allocation_lane"), F.lit("below_fold").alias("fold"), (F.col("l_returnflag") != "R").alias("delivered"))
    return coverage.attention_budget(l, 620, 15500)


@op("first_publication", """WITH f AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS blank FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT o_orderkey AS arrival_id, o_orderstatus = 'F' AS rep, coalesce(n, 0) AS n, blank FROM orders LEFT JOIN f ON k = o_orderkey),
c AS (SELECT arrival_id, CASE WHEN rep AND n <> 1 THEN 'FIRST_PUBLICATION_NOT_UNIQUE' WHEN rep AND blank > 0 THEN 'PUBLICATION_EVENT_REQUIRED' WHEN NOT rep AND n > 0 THEN 'NON_REPORTABLE_FIRST_PUBLICATION' END AS error FROM j) SELECT * FROM c WHERE error IS NOT NULL""")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("arrival_id"), (F.col("o_orderstatus") == "F").alias("reportable"))
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("arrival_id"), (F.col("l_returnflag") == "R").alias("is_first_publication"), F.when(F.col("l_linestatus") != "O", "e").alias("publication_event_id"))
    return coverage.first_publication(a, p)


@op("selection_reason", "SELECT o_orderkey, o_orderstatus || ', ' || o_orderpriority || ' via lane' AS human_readable_reason FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("signal_types"), F.lit("lane").alias("allocation_lane"))
    return coverage.selection_reason(o).select("o_orderkey", "human_readable_reason")


@op("open_world_unknown", "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'random_exploration' END AS allocation_lane, event_type <> 'error' AS violation FROM events")
def _(spark, sf):
    u = F.when(F.col("event_type") == "error", "unknown").otherwise("known")
    e = table(spark, sf, "events").select("user_id", "event_id", u.alias("domain"), u.alias("publisher_role"))
    return coverage.open_world_unknown(e).select("user_id", "event_id", "allocation_lane", "violation")


@op("coverage_debt", "SELECT CAST(o_orderkey AS VARCHAR) AS coverage_debt_id, CAST(epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate) AS BIGINT) AS age_seconds, o_orderdate > TIMESTAMP '2002-01-01' AS violation FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("coverage_debt_id"), F.col("o_orderdate").alias("opened_at"), F.col("o_orderstatus").alias("reason_code"), F.col("o_orderdate").alias("next_rotation_at"))
    return coverage.coverage_debt(o, ts("2002-01-01")).select("coverage_debt_id", "age_seconds", "violation")


# ---- signals
SEAS = """s AS (SELECT event_type AS series_id, hour(ts) AS slot, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS o, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1, 2)"""


def seasonal(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.hour("ts").alias("slot")).agg(F.count_if(F.col("ts") >= ts("2024-01-16")).alias("observed"), F.count_if(F.col("ts") < ts("2024-01-16")).alias("baseline"))


@op("seasonal_anomaly", f"WITH {SEAS}, m AS (SELECT series_id, max(CASE WHEN b = 0 THEN 0.0 ELSE abs(o - b)::DOUBLE / b END) AS max_deviation FROM s GROUP BY 1) SELECT *, max_deviation > 0.3 AS triggered FROM m")
def _(spark, sf):
    return signals.seasonal_anomaly(seasonal(spark, sf), 0.3)


@op("sparse_series", f"""WITH g AS (SELECT source AS series_id, sum(toxic) AS num, sum(quality) AS den, count(*) FILTER (WHERE quality = 1) AS independent_count FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT series_id, num::BIGINT AS num, den::BIGINT AS den, independent_count, CASE WHEN den = 0 THEN 0.0 ELSE num::DOUBLE / den END AS ratio, {wilson_sql('num', 'den')}, (num > den AND den > 0) AS violation FROM g""")
def _(spark, sf):
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return signals.sparse_series(l.select(F.col("source").alias("series_id"), F.col("toxic").cast("long").alias("numerator"), F.col("quality").cast("long").alias("denominator"), (F.col("quality") == 1).alias("independent")))


# scans of a probabilistic detector, of one whose scores leave 0 to 1, and of two without p values
@op("fdr_scan", """WITH t AS (SELECT event_type AS scan_id, CASE WHEN event_type IN ('click', 'signup') THEN NULL WHEN event_type = 'error' THEN value ELSE round(value / 500, 4) END AS p, user_id % 2 = 0 AS gold, CASE WHEN event_type = 'click' OR event_type = 'signup' AND user_id % 7 <> 0 THEN user_id % 5 = 0 END AS alarm FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY scan_id ORDER BY p) + count(*) OVER (PARTITION BY scan_id, p) - 1 AS rk, count(*) OVER (PARTITION BY scan_id) AS n FROM t),
g AS (SELECT scan_id, max(n) AS tests, count(p) = max(n) AS scored, min(p * n / rk) AS q, count(*) FILTER (WHERE p <= 0.5 / n) AS d, count(*) FILTER (WHERE p <= 0.5 / n AND NOT gold) AS f, count(*) FILTER (WHERE p < 0 OR p > 1) AS outside, count(*) FILTER (WHERE alarm) AS alarms, count(*) FILTER (WHERE alarm IS NULL) AS silent FROM r GROUP BY 1),
e AS (SELECT *, CASE WHEN scored AND outside > 0 THEN 'P_RANGE' WHEN NOT scored AND silent > 0 THEN 'FALSE_ALARM_MISSING' END AS error FROM g),
m AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN NOT scored THEN alarms::DOUBLE / tests WHEN d > 0 THEN f::DOUBLE / d ELSE 0.0 END END AS rate FROM e)
SELECT scan_id, tests, CASE WHEN scored THEN 'probabilistic' ELSE 'non_probability' END AS detector_type, CASE WHEN error IS NULL AND scored THEN round(q, 9) END AS q_value, CASE WHEN error IS NULL AND scored THEN d END AS discoveries,
CASE WHEN error IS NULL AND scored THEN f END AS false_discoveries, rate, rate <= 0.5 AS decision, error FROM m""")
def _(spark, sf):
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    p = F.when(kind.isin("click", "signup"), F.lit(None)).when(kind == "error", value).otherwise(F.round(value / 500, 4))
    alarm = F.when((kind == "click") | (kind == "signup") & (user % 7 != 0), user % 5 == 0)
    e = table(spark, sf, "events").select(kind.alias("scan_id"), p.alias("p_value"), (user % 2 == 0).alias("gold_anomaly"), alarm.alias("false_alarm"))
    return signals.fdr_scan(e, 0.5).withColumn("q_value", F.round("q_value", 9))


# eight events are a signal
@op("emergence_diffusion", """WITH s AS (SELECT event_id // 8 AS s, * FROM events), o AS (SELECT s AS signal_id, count(DISTINCT event_type) AS a, count(DISTINCT hour(ts) % 4) AS b FROM s GROUP BY 1), c AS (SELECT s, count(*) AS n FROM s WHERE event_type = 'purchase' GROUP BY 1),
k AS (SELECT s, bool_or(user_id % 2 = 0) AND bool_or(user_id % 2 <> 0) AS typed FROM s WHERE event_type <> 'error' GROUP BY 1)
SELECT signal_id, a AS language_count, b AS actor_class_count, coalesce(n, 0) AS actions, coalesce(typed, false) AS typed, (a >= 3 AND b >= 3 AND coalesce(n, 0) > 0 AND coalesce(typed, false)) AS diffused FROM o LEFT JOIN c ON c.s = signal_id LEFT JOIN k ON k.s = signal_id""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("signal_id", F.floor(F.col("event_id") / 8))
    o = e.select("signal_id", F.col("event_type").alias("language"), (F.hour("ts") % 4).alias("actor_class"))
    types = e.where("event_type <> 'error'").select("signal_id", F.when(F.col("user_id") % 2 == 0, "emergence").otherwise("diffusion").alias("signal_type"))
    return signals.emergence_diffusion(o, e.where("event_type = 'purchase'").select("signal_id"), types)


@op("independent_adoption", """WITH g AS (SELECT l_partkey AS signal_id, count(*) AS edges, count(DISTINCT l_suppkey) AS actors, bool_or(l_returnflag = 'R') AS cited FROM lineitem GROUP BY 1) SELECT signal_id, edges, CASE WHEN edges < 3 THEN 'TOO_FEW' WHEN actors < edges THEN 'NOT_INDEPENDENT' WHEN cited THEN 'CITED' END AS first_error FROM g""")
def _(spark, sf):
    return signals.independent_adoption(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("signal_id"), F.col("l_suppkey").alias("actor_id"), F.lit("e").alias("evidence_id"), (F.col("l_returnflag") == "R").alias("cited_source")))


@op("gold_cluster_separation", "SELECT count(DISTINCT o_orderstatus) AS gold_clusters, count(*) FILTER (WHERE o_orderpriority <> o_orderstatus) AS mixed, false AS separated FROM orders")
def _(spark, sf):
    return signals.gold_cluster_separation(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("gold_cluster_id"), F.col("o_orderpriority").alias("predicted_cluster_id")))


@op("stance_report", "SELECT user_id AS topic, count(*) AS mentions, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS negative_share, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.5 AS mostly_negative FROM events GROUP BY 1")
def _(spark, sf):
    return signals.stance_report(table(spark, sf, "events").select(F.col("user_id").alias("topic"), F.when(F.col("event_type") == "error", "negative").otherwise("neutral").alias("stance")))


@op("sybil_risk", """WITH g AS (SELECT o_custkey AS group_id, count(DISTINCT o_orderpriority) AS origins, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) + max(CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END) AS signals FROM orders GROUP BY 1) SELECT group_id, origins, signals, CASE WHEN signals >= 2 THEN 'high' ELSE 'low' END AS risk FROM g""")
def _(spark, sf):
    return signals.sybil_risk(table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("origin_id"), (F.col("o_orderstatus") == "F").alias("synchronized"), (F.col("o_orderstatus") == "P").alias("template_match"), (F.col("o_totalprice") > 490000).alias("reference_chain")))


@op("manipulation_event", "SELECT user_id AS group_id, bool_or(event_type = 'error' OR value > 499) AS high_risk, count(*) AS propagation FROM events GROUP BY 1")
def _(spark, sf):
    return signals.manipulation_event(table(spark, sf, "events").select(F.col("user_id").alias("group_id"), (F.col("event_type") == "error").alias("bot"), (F.col("value") > 499).alias("coordinated")))


@op("causal_claim", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'source_claimed_cause' WHEN value > 100 AND NOT event_type = 'purchase' AND NOT event_type = 'view' THEN 'observed_association' END AS claim FROM events")
def _(spark, sf):
    is_ = lambda t: F.col("event_type") == t
    e = table(spark, sf, "events").withColumns({"source_claimed_cause": is_("error"), "temporal_order": F.col("value") > 100, "intervention": is_("purchase"), "mechanism": is_("view")})
    return signals.causal_claim(e).select("event_id", "claim")


@op("unverifiable_action", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 300000 THEN 'confirmed_action' ELSE 'unverified_claim' END AS label, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 300000 THEN 'confirmed' ELSE 'unconfirmed' END AS state FROM orders")
def _(spark, sf):
    return signals.unverifiable_action(table(spark, sf, "orders").withColumns({"registry_verified": F.col("o_orderstatus") == "F", "original_verified": F.col("o_totalprice") > 300000})).select("o_orderkey", "label", "state")


@op("pareto_tie_break", "SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, p_size + p_retailprice AS score FROM part ORDER BY score DESC, candidate_id LIMIT 40")
def _(spark, sf):
    return signals.pareto_tie_break(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 40)


@op("quota_infeasible", "SELECT 'p_size' AS dimension, 1000.0::DOUBLE AS minimum, max(p_size)::DOUBLE AS best FROM part HAVING max(p_size) < 1000")
def _(spark, sf):
    return signals.quota_infeasible(table(spark, sf, "part"), {"p_size": 1000, "p_retailprice": 1})


@op("frontier_projection", "SELECT user_id AS surface, max(ts) AS frontier, max(value) AS latency_ms, count(*) FILTER (WHERE event_type = 'click') AS fast_items FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("surface"), F.col("ts").alias("version_available_at"), F.col("value").alias("latency_ms"), "event_type")
    return signals.frontier_projection(e.where("event_type = 'click'"), e.where("event_type <> 'click'"))


@op("history_break", "SELECT event_type AS series_id, max(ts) AS break_at, true AS segment, true AS reset FROM events GROUP BY 1")
def _(spark, sf):
    return signals.history_break(table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("observed_at")))


# runs of a case differ in one field for one case in four, each case's field another
@op("deterministic_snapshot", """WITH g AS (SELECT l_orderkey AS case_id, count(*) AS runs, count(DISTINCT CASE WHEN l_orderkey % 4 = 1 THEN l_linenumber % 2 ELSE 0 END) = 1 AS same, CAST(sum(CASE WHEN l_orderkey % 9 = 5 THEN l_linenumber END) AS BIGINT) AS reads FROM lineitem GROUP BY 1),
e AS (SELECT case_id, runs, same, coalesce(reads, 0) AS personal_reads, CASE WHEN runs < 2 THEN 'TOO_FEW_RUNS' WHEN NOT same THEN 'DIVERGED' WHEN reads > 0 THEN 'PERSONAL_READ' END AS error FROM g) SELECT *, error IS NULL AS deterministic FROM e""")
def _(spark, sf):
    key, run = F.col("l_orderkey"), F.col("l_linenumber")
    lists = ["candidate_ids", "feature_ids", "allocations", "surface_order"]
    differs = lambda i: F.when((key % 4 == 1) & (F.floor(key / 4) % 4 == i), F.array(run % 2)).otherwise(F.array(F.lit(0)))
    runs = table(spark, sf, "lineitem").select(key.alias("case_id"), *[differs(i).alias(n) for i, n in enumerate(lists)], F.when(key % 9 == 5, run).alias("personal_read_count"))
    return signals.deterministic_snapshot(runs, lists)


@op("reactivation", "WITH a AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) SELECT o_orderkey AS signal_id, (o_orderstatus IN ('F') AND coalesce(ok, false)) AS reactivated FROM orders LEFT JOIN a ON l_orderkey = o_orderkey")
def _(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("signal_id"), F.when(F.col("o_orderstatus") == "F", "decayed").otherwise("live").alias("state"))
    return signals.reactivation(c, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("signal_id"), (F.col("l_returnflag") != "R").alias("independent"), F.lit("e").alias("evidence_id")))


@op("source_concentration", """WITH n AS (SELECT lang, source, 'R' || CAST(CAST(substring(source, 4) AS INTEGER) % 5 AS VARCHAR) AS owner, count(*) AS c FROM documents GROUP BY 1, 2, 3), p AS (SELECT lang, source, c::DOUBLE / sum(c) OVER (PARTITION BY lang) AS p, row_number() OVER (PARTITION BY lang ORDER BY c DESC, source) AS r FROM n),
o AS (SELECT lang, max(s) AS max_owner FROM (SELECT lang, owner, sum(c)::DOUBLE / (SELECT sum(c) FROM n m WHERE m.lang = n.lang) AS s FROM n GROUP BY lang, owner) GROUP BY 1),
g AS (SELECT lang, round(sum(p * p), 9) AS hhi, round(1 / sum(p * p), 6) AS effective, round(max(p), 9) AS max_lineage, round(sum(p) FILTER (WHERE r <= 10), 9) AS top_ten FROM p GROUP BY 1)
SELECT g.*, round(max_owner, 9) AS max_owner, concat_ws(',', CASE WHEN max_lineage > 0.05 THEN 'max_lineage' END, CASE WHEN round(max_owner, 9) > 0.1 THEN 'max_owner' END, CASE WHEN top_ten > 0.35 THEN 'top_ten' END, CASE WHEN effective < 30 THEN 'effective' END) AS broken FROM g JOIN o USING (lang)""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "source", F.concat(F.lit("R"), (F.substring("source", 4, 10).cast("int") % 5).cast("string")).alias("owner"))
    got = signals.concentration(rows, "lang", "source", "owner")
    return got.select("lang", F.round("effective", 6).alias("effective"), F.array_join("broken", ",").alias("broken"), *[F.round(c, 9).alias(c) for c in ("hhi", "max_lineage", "top_ten", "max_owner")])


from signalframe.plans import catalog_audits, catalog_closures, catalog_feeds, catalog_rules  # noqa: E402, F401  add their queries

"""Queries of audits, keys, time and measures; registered beside the rest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalframe.functions import text as X
from signalframe.operators import closure, coverage, measures, similarity, temporal
from signalframe.plans.catalog import op, ts
from signalframe.plans.views import table

LOG = """lg AS (SELECT event_id, user_id AS aggregate_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, event_type AS to_state, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state,
 lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM events)"""


def log(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("aggregate_id"), F.row_number().over(w).cast("long").alias("revision"), F.col("event_type").alias("to_state"), "ts", F.lag("event_type").over(w).alias("from_state"), F.lag("event_id").over(w).alias("pred"))


# ---- closure
@op("closure_anti", "SELECT o_orderkey AS k, 'undecided' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    return closure.closure_anti(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "k")


@op("closure_counts", """WITH d AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_custkey, count(*) AS units, count(*) FILTER (WHERE n IS NULL) AS undecided, count(*) FILTER (WHERE n > 1) AS twice,
(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS strays FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, sf):
    return closure.closure_audit(table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "k", "o_custkey")


@op("semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, sf):
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(l, "o_orderkey", "left_semi").select("o_orderkey")


SETS = ("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')")


def _sets(spark, sf):
    o = table(spark, sf, "orders")
    return [o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in ("F", "O")]


@op("set_symmetric_diff", f"(SELECT k, 'left' AS side FROM (SELECT * FROM {SETS[0]} EXCEPT ALL SELECT * FROM {SETS[1]})) UNION ALL (SELECT k, 'right' FROM (SELECT * FROM {SETS[1]} EXCEPT ALL SELECT * FROM {SETS[0]}))")
def _(spark, sf):
    return closure.symmetric_difference(*_sets(spark, sf))


@op("set_except_pair", f"SELECT (SELECT count(*) FROM (SELECT * FROM {SETS[0]} EXCEPT SELECT * FROM {SETS[1]})) AS missing, (SELECT count(*) FROM (SELECT * FROM {SETS[1]} EXCEPT SELECT * FROM {SETS[0]})) AS extra")
def _(spark, sf):
    a, b = _sets(spark, sf)
    return a.subtract(b).agg(F.count("*").alias("missing")).crossJoin(b.subtract(a).agg(F.count("*").alias("extra")))


@op("union_children", "WITH u AS (SELECT l_orderkey AS unit FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT unit, count(*) AS children FROM u GROUP BY 1 HAVING count(*) <> 1")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    a, n, r = (l.where(F.col("l_returnflag") == x).select(F.col("l_orderkey").alias("unit")) for x in "ANR")
    return a.unionByName(n).unionByName(r).groupBy("unit").agg(F.count("*").alias("children")).where("children <> 1")


@op("dedup_union", "SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS first_supplier FROM lineitem GROUP BY 1")
def _(spark, sf):
    """The supplier of the least line that names one; of lines that share a number, the first in the table's order."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = F.when(line.isNotNull() & F.col("l_suppkey").isNotNull(), F.struct(line.alias("line"), "_metadata.file_path", "_metadata.row_index"))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", first).alias("first_supplier"))


@op("chain_contiguity", f"WITH {LOG}, x AS (SELECT * FROM lg WHERE to_state <> 'error'), y AS (SELECT *, lag(revision) OVER w AS b, lag(event_id) OVER w AS p FROM x WINDOW w AS (PARTITION BY aggregate_id ORDER BY revision)), z AS (SELECT aggregate_id, revision, CASE WHEN b IS NULL AND (revision <> 1 OR pred IS NOT NULL) THEN 'CHAIN_START' WHEN b IS NOT NULL AND revision <> b + 1 THEN 'CHAIN_GAP' WHEN b IS NOT NULL AND pred IS DISTINCT FROM p THEN 'CHAIN_PREDECESSOR' END AS error FROM y) SELECT * FROM z WHERE error IS NOT NULL")
def _(spark, sf):
    return closure.chain_audit(log(spark, sf).where("to_state <> 'error'"), "aggregate_id", "revision", "event_id", "pred")


@op("current_state_view", f"WITH {LOG} SELECT aggregate_id, max(revision) AS revision, arg_max(to_state, revision) AS to_state FROM lg GROUP BY 1")
def _(spark, sf):
    return closure.current_state(log(spark, sf), "aggregate_id", "revision").select("aggregate_id", "revision", "to_state")


@op("latest_definition", "SELECT l_partkey, max(l_orderkey * 10 + l_linenumber) AS revision, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS quantity FROM lineitem GROUP BY 1")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision"), F.col("l_quantity").alias("quantity"))
    return closure.current_state(l, "l_partkey", "revision")


LEGAL = [("click", "view"), ("view", "click"), ("click", "purchase"), ("view", "purchase"), ("click", "click"), ("view", "view")]


ACT = "a AS (SELECT o_custkey AS series, o_orderkey AS id, o_orderdate AS b, o_orderdate + to_days(CAST(o_orderkey % 90 + 1 AS INTEGER)) AS e FROM orders)"


@op("manifest_range_overlap", f"WITH {ACT}, m AS (SELECT *, max(e) OVER (PARTITION BY series ORDER BY b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a) SELECT series, id FROM m WHERE b < reach")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("b"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 90 + 1) * 86400).alias("e"))
    return closure.range_overlap(o, "series", "b", "e", "id")


@op("member_set_hash", "SELECT l_orderkey, sha256(string_agg(CAST(l_linenumber AS VARCHAR) || '|' || lower(hex(encode(l_returnflag))) || '|' || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, CAST(l_linenumber AS VARCHAR) || '|' || lower(hex(encode(l_returnflag))) || '|' || CAST(l_partkey AS VARCHAR))) AS set_hash, count(*) AS members FROM lineitem GROUP BY 1")
def _(spark, sf):
    line = F.concat_ws("|", F.col("l_linenumber").cast("string"), F.lower(F.hex(F.encode("l_returnflag", "UTF-8"))), F.col("l_partkey").cast("string"))
    return closure.ordered_hash(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", line)


@op("catalog_hash", "SELECT p_brand, sha256(string_agg(lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '|' || p_type, chr(10) ORDER BY p_partkey)) AS set_hash, count(*) AS members FROM part GROUP BY 1")
def _(spark, sf):
    return closure.ordered_hash(table(spark, sf, "part"), "p_brand", "p_partkey", F.concat_ws("|", F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.col("p_type")))


@op("run_set_hash", "SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS set_hash, count(*) AS members FROM orders GROUP BY 1")
def _(spark, sf):
    return closure.ordered_hash(table(spark, sf, "orders"), "o_custkey", "o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))


@op("scope_binding_hash", "SELECT event_id, sha256(event_type || '|' || CAST(user_id AS VARCHAR) || '|' || coalesce(CASE WHEN value > 250 THEN props END, '-')) AS scope_hash FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.coalesce(F.when(F.col("value") > 250, F.col("props")), F.lit("-"))), 256).alias("scope_hash"))


@op("md5_uuid", "WITH h AS (SELECT c_custkey, md5(c_name) AS m FROM customer) SELECT c_custkey, substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4) || '-' || substring(m, 21, 12) AS id FROM h")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.hyphened(F.md5("c_name")).alias("id"))


@op("uuid5", "WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS m FROM customer) SELECT c_custkey, substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-5' || substring(m, 14, 3) || '-' || substring('89ab', CAST(('0x' || substring(m, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || substring(m, 18, 3) || '-' || substring(m, 21, 12) AS id FROM h")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("c_name")).alias("id"))


@op("representation_hash", """SELECT n_nationkey, sha256('{"n":"' || n_name || '","r":' || CAST(n_regionkey AS VARCHAR) || '}') AS hash, length('{"n":"' || n_name || '","r":' || CAST(n_regionkey AS VARCHAR) || '}') AS bytes FROM nation""")
def _(spark, sf):
    j = F.to_json(F.struct(F.col("n_name").alias("n"), F.col("n_regionkey").alias("r")))
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(j, 256).alias("hash"), F.octet_length(j).cast("long").alias("bytes"))


@op("memory_candidate", "SELECT event_id, substring(sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type), 1, 16) AS candidate FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.substring(F.sha2(F.concat_ws("\x1f", F.col("user_id").cast("string"), "event_type"), 256), 1, 16).alias("candidate"))


@op("signer_quorum", "SELECT l_orderkey AS approval_id, count(*) AS signatures, count(DISTINCT l_suppkey) AS signers, count(*) FILTER (WHERE l_returnflag = 'R') AS invalid, (count(*) >= 3 AND count(DISTINCT l_suppkey) >= 3 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0) AS approved FROM lineitem GROUP BY 1")
def _(spark, sf):
    return closure.signer_quorum(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("approval_id"), F.col("l_suppkey").alias("signer_id"), (F.col("l_returnflag") != "R").alias("valid")), 3)


@op("phase_gate_sql", """WITH r AS (SELECT l_orderkey AS k, CASE WHEN max(l_returnflag) = 'R' THEN 'failed' ELSE 'passed' END AS res FROM lineitem GROUP BY 1),
g AS (SELECT o_orderpriority AS phase, count(*) AS required, count(*) FILTER (WHERE res IS NULL) AS missing, count(*) FILTER (WHERE res = 'failed') AS failed, 0::BIGINT AS unknown FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY 1) SELECT *, required > 0 AND missing + failed + unknown = 0 AS passed FROM g""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderkey").alias("definition_id"))
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("definition_id")).agg(F.when(F.max("l_returnflag") == "R", "failed").otherwise("passed").alias("result"))
    return closure.phase_gate(o, r.withColumn("phase", F.lit(None).cast("string")))


@op("readiness_summary", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS blocked FROM orders GROUP BY 1")
def _(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("blocked"))


@op("identity_universe", "SELECT l_partkey AS global_id, 'IDENTITY_SHARED' AS error FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1 UNION ALL SELECT l_partkey, 'PARENT_MISSING' FROM lineitem WHERE l_suppkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(spark, sf):
    return closure.identity_universe(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("global_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("type"), F.col("l_suppkey").alias("parent_id")))


@op("check_rules", """WITH k AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key FROM orders)
SELECT 'event' AS table_name, key, 'valid_time' AS rule FROM k WHERE k % 4 = 3 OR (k % 4 = 0) <> (k % 5 > 0) UNION ALL SELECT 'event', key, 'author' FROM k WHERE k % 3 = 0 AND k % 7 = 0
UNION ALL SELECT 'event', key, 'actor_whole' FROM k WHERE k % 3 > 0 AND k % 11 IN (0, 1) OR k % 3 = 0 AND k % 11 > 1 AND k % 13 = 0 UNION ALL SELECT 'event', key, 'rule_record_whole' FROM k WHERE k % 7 > 0 AND k % 17 IN (0, 1)
UNION ALL SELECT 'item_version', key, 'observed_before_available' FROM k WHERE k % 19 = 0 UNION ALL SELECT 'item_version', key, 'seen_before_observed' FROM k WHERE k % 23 = 0 AND k % 29 > 0
UNION ALL SELECT 'item_version', key, 'predecessor' FROM k WHERE k % 3 = 0 OR (k % 3 = 1) <> (k % 31 IN (1, 4, 7)) UNION ALL SELECT 'item_version', key, 'content_hash_hex' FROM k WHERE k % 37 IN (0, 1)
UNION ALL SELECT 'decision', key, 'member_of_selected' FROM k WHERE (k % 2 = 0) <> (k % 41 > 0) OR (k % 2 = 0) <> (k % 43 > 0)
UNION ALL SELECT 'snapshot', key, 'revision_positive' FROM k WHERE k % 47 < 2 UNION ALL SELECT 'snapshot', key, 'rights_epoch_positive' FROM k WHERE k % 53 = 0 UNION ALL SELECT 'snapshot', key, 'status' FROM k WHERE k % 59 < 2 UNION ALL SELECT 'snapshot', key, 'filled' FROM k WHERE k % 61 = 0""")
def _(spark, sf):
    """Stand-in rows of four tables, in which every rule is broken in every way it can be."""
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    when = lambda test, value: F.when(test, value)
    day = lambda n: F.timestamp_seconds(F.unix_timestamp("o_orderdate") + n * 86400)
    event = orders.select(
        "o_orderkey", F.element_at(F.array(*map(F.lit, ("known", "unknown", "not_applicable", "guessed"))), (k % 4 + 1).cast("int")).alias("valid_time_status"), when(k % 5 > 0, F.col("o_orderdate")).alias("valid_effective_at"),
        when(k % 3 > 0, k).alias("actor_id"), when((k % 3 > 0) & (k % 11 != 0) | (k % 3 == 0) & (k % 11 > 1) & (k % 13 == 0), "person").alias("actor_kind"), when(k % 3 > 0, F.when(k % 11 == 1, " ").otherwise("editor")).alias("actor_type"),
        when(k % 7 > 0, k).alias("rule_record_id"), when(k % 7 > 0, F.when(k % 17 == 0, "actor").otherwise("record")).alias("rule_record_kind"), when((k % 7 > 0) & (k % 17 != 1), "policy").alias("rule_record_type"))
    version = orders.select(
        "o_orderkey", when(k % 29 > 0, day(F.when(k % 23 == 0, 1).otherwise(-1))).alias("item_first_seen_at"), F.col("o_orderdate").alias("version_observed_at"), day(F.when(k % 19 == 0, -5).otherwise(5)).alias("version_available_at"),
        (k % 3).alias("version_ordinal"), when(~(k % 31).isin(1, 4, 7), k).alias("previous_version_id"), F.when(k % 37 == 0, F.upper(F.sha2(F.concat(F.lit("a"), k.cast("string")), 256))).when(k % 37 == 1, "").otherwise(F.sha2(k.cast("string"), 256)).alias("content_hash"))
    decision = orders.select("o_orderkey", F.when(k % 2 == 0, "selected").otherwise("rejected").alias("decision"), when(k % 41 > 0, "card").alias("selected_member_kind"), when(k % 43 > 0, k).alias("selected_member_key"))
    snapshot = orders.select(
        "o_orderkey", F.when(k % 47 == 0, None).when(k % 47 == 1, 0).otherwise(k).alias("revision"), F.when(k % 53 == 0, -1).otherwise(1).alias("rights_epoch"), F.when(k % 59 == 0, None).when(k % 59 == 1, "draft").otherwise("published").alias("snapshot_status"),
        F.lit("w").alias("comparison_watermark"), when(k % 61 > 0, "m").alias("method_epoch"), F.lit("h").alias("render_plan_hash"))
    return closure.broken_rules({name: (df, "o_orderkey") for name, df in (("event", event), ("item_version", version), ("decision", decision), ("snapshot", snapshot))})


EDGE = LOG + ", ed AS (SELECT event_id, pred AS parent_event_id, CASE WHEN event_id % 3 = 0 THEN 'p' END AS proof FROM lg WHERE pred IS NOT NULL UNION ALL SELECT min(event_id), max(event_id), NULL FROM lg GROUP BY aggregate_id HAVING aggregate_id % 10 = 0)"


def edges(spark, sf):
    l = log(spark, sf)
    back = l.groupBy("aggregate_id").agg(F.min("event_id").alias("event_id"), F.max("event_id").alias("parent_event_id")).where("aggregate_id % 10 = 0").select("event_id", "parent_event_id", F.lit(None).cast("string").alias("queue_proof_id"))
    return l.where("pred is not null").select("event_id", F.col("pred").alias("parent_event_id"), F.when(F.col("event_id") % 3 == 0, "p").alias("queue_proof_id")).unionByName(back)


@op("causal_edges", f"""WITH {EDGE}, j AS (SELECT ed.*, c.ts AS ct, p.ts AS pt, c.event_type AS cd, p.event_type AS pd FROM ed JOIN events c ON c.event_id = ed.event_id JOIN events p ON p.event_id = ed.parent_event_id),
z AS (SELECT event_id, parent_event_id, CASE WHEN event_id = parent_event_id THEN 'SELF_EDGE' WHEN pt > ct THEN 'PARENT_LATER' WHEN cd = pd AND parent_event_id >= event_id THEN 'SEQUENCE_ORDER' WHEN cd <> pd AND proof IS NULL THEN 'PROOF_MISSING' END AS error FROM j) SELECT * FROM z WHERE error IS NOT NULL""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("ts").alias("available_at"), F.col("event_type").alias("domain"), F.col("event_id").alias("sequence"))
    return closure.causal_edges(edges(spark, sf), ev)


DAYS = "dl AS (SELECT event_id, user_id, lag(event_id) OVER w AS pred FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id))"


@op("causal_cycle", f"WITH {DAYS} SELECT event_id, pred AS parent_event_id FROM dl WHERE user_id % 10 = 0 AND pred IS NOT NULL UNION ALL SELECT min(event_id), max(event_id) FROM events WHERE user_id % 10 = 0 GROUP BY user_id, CAST(ts AS DATE)")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    chain = e.withColumn("pred", F.lag("event_id").over(Window.partitionBy("user_id", "day").orderBy("event_id"))).where("pred is not null").select("event_id", F.col("pred").alias("parent_event_id"))
    back = e.where("user_id % 10 = 0").groupBy("user_id", "day").agg(F.min("event_id").alias("event_id"), F.max("event_id").alias("parent_event_id")).select("event_id", "parent_event_id")
    return closure.causal_cycle(chain.unionByName(back))


# ---- time
SPANS = """w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 AS INTEGER)) END AS b,
  CASE WHEN o_orderkey % 60 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 + o_custkey % 40 - 2 AS INTEGER)) END AS e FROM orders WHERE o_orderstatus = 'P')"""


@op("window_assign", f"""WITH {SPANS}, m AS (SELECT event_id, min(id) AS window_id, max(coalesce(e, TIMESTAMP '2200-01-01')) AS window_end, count(*) AS matches FROM events JOIN w ON (b IS NULL OR b <= ts) AND (e IS NULL OR ts < e) AND (b IS NULL OR e IS NULL OR b < e) GROUP BY 1)
SELECT event_id, window_id, CASE WHEN window_end < TIMESTAMP '2200-01-01' THEN window_end END AS window_end, coalesce(matches, 0) AS matches FROM events LEFT JOIN m USING (event_id)""")
def _(spark, sf):
    """Windows that overlap, that are open on either side, and that hold nothing."""
    k, base = F.col("o_orderkey"), F.unix_timestamp(ts("2024-01-01"))
    begin = F.when(k % 50 > 0, F.timestamp_seconds(base + k % 700 * 3600))
    until = F.when(k % 60 > 0, F.timestamp_seconds(base + (k % 700 + F.col("o_custkey") % 40 - 2) * 3600))
    spans = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(k.alias("id"), begin.alias("start"), until.alias("end"))
    return temporal.window_assign(table(spark, sf, "events"), spans).select("event_id", "window_id", "window_end", "matches")


def _windows(spark):
    base = F.unix_timestamp(ts("2024-01-01"))
    return spark.range(10).select("id", F.timestamp_seconds(base + F.col("id") * 259200).alias("start"), F.timestamp_seconds(base + (F.col("id") + 1) * 259200).alias("end"))


@op("late_classify", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-31' AND floor((floor(epoch(ts)) + value * 600 - epoch(TIMESTAMP '2024-01-01')) / 259200) > floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 259200) THEN 'PROCESSING_BACKFILL' ELSE 'nominal' END AS arrival_class FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("value") * 600).alias("available_at"))
    return temporal.late_classify(temporal.window_assign(e, _windows(spark)), "available_at").select("event_id", "arrival_class")


@op("windows_validate", f"WITH {ACT}, m AS (SELECT series, id, e, lead(b) OVER (PARTITION BY series ORDER BY b, id) AS nx FROM a) SELECT series, id, 'WINDOWS_OVERLAP' AS error FROM m WHERE e > nx")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 90 + 1) * 86400).alias("end"))
    return temporal.windows_validate(o)


@op("windows_contiguous", f"WITH {ACT}, m AS (SELECT series, id, b, e, lead(b) OVER (PARTITION BY series ORDER BY b, id) AS nx FROM a) SELECT series, id, CASE WHEN e > nx THEN 'WINDOWS_OVERLAP' ELSE 'REPORT_WINDOWS_GAP' END AS error FROM m WHERE e <> nx")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 90 + 1) * 86400).alias("end"))
    return temporal.windows_validate(o, contiguous=True)


KNOWN = "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01'"


def _orders(spark, sf):
    days = lambda n: F.timestamp_seconds(F.unix_timestamp("o_orderdate") + n * 86400)
    return table(spark, sf, "orders").withColumns({"available_at": F.col("o_orderdate"), "as_of": days(30), "valid_at": days(-5), "valid_status": F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("known"),
        "system_from": F.col("o_orderdate"), "system_to": F.when(F.col("o_orderstatus") == "F", days(100)), "valid_from": days(-10), "valid_to": F.when(F.col("o_orderstatus") == "O", days(200))})


@op("record_as_known", KNOWN)
def _(spark, sf):
    return temporal.record_as_known(_orders(spark, sf), ts("1997-01-01")).select("o_orderkey")


@op("event_as_known", KNOWN + " AND (o_orderstatus = 'P' OR o_orderdate - INTERVAL 5 DAY <= TIMESTAMP '1996-06-01')")
def _(spark, sf):
    return temporal.event_as_known(_orders(spark, sf), ts("1997-01-01"), ts("1996-06-01")).select("o_orderkey")


@op("version_as_known", KNOWN + " AND (o_orderstatus <> 'F' OR TIMESTAMP '1997-01-01' < o_orderdate + INTERVAL 100 DAY) AND o_orderdate - INTERVAL 10 DAY <= TIMESTAMP '1996-12-01' AND (o_orderstatus <> 'O' OR TIMESTAMP '1996-12-01' < o_orderdate + INTERVAL 200 DAY)")
def _(spark, sf):
    return temporal.version_as_known(_orders(spark, sf), ts("1997-01-01"), ts("1996-12-01")).select("o_orderkey")


@op("derived_as_known", KNOWN + " AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01'")
def _(spark, sf):
    return temporal.derived_as_known(_orders(spark, sf), ts("1997-01-01")).select("o_orderkey")


@op("replay_dedup", """WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY value, event_id) AS b FROM events) SELECT user_id, count(DISTINCT event_type) AS arrivals, count(*) - count(DISTINCT event_type) AS suppressed, CASE WHEN bool_or(event_type = 'error' AND value > 480) THEN 'COLLECTION_MISSING' END AS watermark_reason, count(*) FILTER (WHERE event_id < b) AS out_of_order FROM e GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("user_id").alias("item_id"), F.col("event_type").alias("version_id"), F.col("event_id").alias("sequence"), ((F.col("event_type") == "error") & (F.col("value") > 480)).alias("cursor_gap"), F.struct("value", "event_id").alias("arrival_order"))
    return temporal.replay_dedup(e, "user_id")


@op("publish_winner", "WITH w AS (SELECT o_custkey AS surface_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision FROM orders), x AS (SELECT *, lag(revision) OVER (PARTITION BY surface_id ORDER BY revision) AS b FROM w WHERE o_orderstatus <> 'P') SELECT surface_id, revision, CASE WHEN b + 1 <> revision THEN 'REVISION_STEP' ELSE 'PREVIOUS_SNAPSHOT' END AS error FROM x WHERE b + 1 <> revision OR (b IS NULL AND revision <> 1)")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("surface_id"), F.col("o_orderkey").alias("snapshot_id"), F.row_number().over(w).cast("long").alias("revision"), F.lag("o_orderkey").over(w).alias("previous_snapshot_id"), F.when(F.col("o_orderstatus") != "P", "winner").otherwise("stale").alias("outcome"))
    return temporal.publish_winner(a)


@op("token_cursor_monotone", "WITH a AS (SELECT user_id AS token_id, event_id AS use_order, max(value) OVER w AS m, count(*) OVER w AS n, value FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT token_id, use_order, CASE WHEN value <= m THEN 'CURSOR_NOT_MONOTONE' ELSE 'TOKEN_USED_UP' END AS error FROM a WHERE value <= m OR n >= 3")
def _(spark, sf):
    return temporal.cursor_monotone(table(spark, sf, "events").select(F.col("user_id").alias("token_id"), F.col("event_id").alias("use_order"), F.col("value").alias("cursor"), (F.col("event_type") != "error").alias("accepted")), 3)


# ---- measures
DAILY = "c AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.floor(F.unix_timestamp("ts") / 86400).alias("day")).agg(F.count("*").alias("n"))


@op("velocity", f"WITH {DAILY}, v AS (SELECT *, n - lag(n) OVER (PARTITION BY series ORDER BY day) AS velocity FROM c) SELECT *, velocity - lag(velocity) OVER (PARTITION BY series ORDER BY day) AS acceleration FROM v")
def _(spark, sf):
    return measures.velocity(daily(spark, sf), "series", "day", "n")


@op("cusum", f"""WITH {DAILY}, m AS (SELECT *, avg(n) OVER w AS mu, stddev_pop(n) OVER w AS sd FROM c WINDOW w AS (PARTITION BY series)), z AS (SELECT *, CASE WHEN sd > 0 THEN round((n - mu) / sd, 9) ELSE 0 END AS z, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM m),
r AS (SELECT a.series, a.day, a.i, max(b.up) AS up, max(b.down) AS down FROM z a JOIN (SELECT x.series, x.i AS since, y.i, sum(z.z - 0.5) AS up, sum(-z.z - 0.5) AS down FROM z x JOIN z y ON x.series = y.series AND x.i <= y.i JOIN z ON z.series = x.series AND z.i BETWEEN x.i AND y.i GROUP BY 1, 2, 3) b ON a.series = b.series AND a.i = b.i GROUP BY 1, 2, 3),
g AS (SELECT series, day, i, round(greatest(up, 0), 6) AS up, round(greatest(down, 0), 6) AS down FROM r)
SELECT series, day, up + 0.0 AS up, down + 0.0 AS down, CASE WHEN up > 2 THEN 'UP' WHEN down > 2 THEN 'DOWN' END AS alarm,
  CASE WHEN up > 2 THEN (SELECT min(h.day) FROM g h WHERE h.series = g.series AND h.i <= g.i AND h.i > coalesce((SELECT max(k.i) FROM g k WHERE k.series = g.series AND k.i <= g.i AND k.up = 0), 0))
       WHEN down > 2 THEN (SELECT min(h.day) FROM g h WHERE h.series = g.series AND h.i <= g.i AND h.i > coalesce((SELECT max(k.i) FROM g k WHERE k.series = g.series AND k.i <= g.i AND k.down = 0), 0)) END AS change_start FROM g""")
def _(spark, sf):
    return measures.cusum(daily(spark, sf), "series", "day", "n", slack=0.5, limit=2.0).select("series", "day", "up", "down", "alarm", "change_start")


HOURLY = "h AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2)"


def hourly(spark, sf):
    return measures.hourly(table(spark, sf, "events"), "event_type", "ts").withColumnRenamed("event_type", "series")


@op("spike_robust", f"""WITH {HOURLY}, began AS (SELECT min(hour) AS first FROM h), p AS (SELECT a.series, a.hour, a.n, k, coalesce(b.n, 0) AS was FROM h a CROSS JOIN range(1, 15) t(k) CROSS JOIN began LEFT JOIN h b ON b.series = a.series AND b.hour = a.hour - 24 * k WHERE a.hour - 24 * k >= first),
m AS (SELECT *, quantile_cont(was, 0.5) OVER (PARTITION BY series, hour) AS med FROM p), d AS (SELECT series, hour, any_value(n) AS n, count(*) AS baselines, any_value(med) AS median, quantile_cont(abs(was - med), 0.5) AS mad FROM m GROUP BY 1, 2)
SELECT series, hour, coalesce(baselines, 0) AS baselines, median, mad, CASE WHEN mad > 0 THEN round((n - median) / mad, 9) END AS robust_z FROM h LEFT JOIN d USING (series, hour, n)""")
def _(spark, sf):
    """Every hour against the same hour of the 14 days before it."""
    return measures.spike_robust(hourly(spark, sf), "series").select("series", "hour", "baselines", "median", "mad", F.round("robust_z", 9).alias("robust_z"))


HEALTH = "h AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, max(event_id) % 5 > 0 AS ok FROM events GROUP BY 1, 2)"


@op("decline", f"""WITH {DAILY}, {HEALTH}, f AS (SELECT c.series, c.day, lag(n) OVER w - n AS fall, n < lag(n) OVER w AND ok AND lag(ok) OVER w AS fell FROM c JOIN h USING (series, day) WINDOW w AS (PARTITION BY c.series ORDER BY c.day)),
i AS (SELECT *, sum(CASE WHEN fell THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY day) AS isl FROM f) SELECT series, count(*) FILTER (WHERE fell) AS falls, CAST(sum(fall) FILTER (WHERE fell) AS BIGINT) AS fallen, max(day) AS ended FROM i GROUP BY series, isl HAVING count(*) FILTER (WHERE fell) >= 2""")
def _(spark, sf):
    health = table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.floor(F.unix_timestamp("ts") / 86400).alias("day")).agg((F.max("event_id") % 5 > 0).alias("healthy"))
    return measures.decline(daily(spark, sf), health, "series", "day", "n", 2)


@op("first_seen", """WITH p AS (SELECT user_id, event_type, min(ts) AS since, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT user_id, min(since) AS first_at, arg_min(event_type, (since, event_type)) AS first_source, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1),
l AS (SELECT p.user_id, min(since) AS recurred_at, arg_min(event_type, (since, event_type)) AS recurred_by, count(*) AS independent_sources FROM p JOIN f USING (user_id) WHERE floor(epoch(since)) - floor(epoch(first_at)) >= 500000 GROUP BY 1)
SELECT user_id, first_at, first_source, recurred_at, recurred_by, coalesce(independent_sources, 0) AS independent_sources, n FROM f LEFT JOIN l USING (user_id)""")
def _(spark, sf):
    return measures.first_seen(table(spark, sf, "events"), "user_id", "event_type", "ts", 500_000)


SCALED = ", ".join(f"({s.hours}, {s.step}, {s.past})" for s in measures.SCALES)


@op("multi_scale_windows", f"""WITH {HOURLY}, o AS (SELECT series, CAST(epoch(TIMESTAMP '2024-01-29 12:00:00') AS BIGINT) // 3600 - hour AS age, n FROM h), began AS (SELECT max(age) AS oldest FROM o), s(hours, step, past) AS (VALUES {SCALED}),
k AS (SELECT DISTINCT series, hours, step, past, k FROM (SELECT DISTINCT series FROM o) CROSS JOIN s CROSS JOIN range(0, 15) t(k) CROSS JOIN began WHERE k = 0 OR (k <= past AND k * step + hours <= oldest)),
v AS (SELECT k.series, hours, past, k, coalesce(sum(n), 0) AS v FROM k LEFT JOIN o ON o.series = k.series AND age > k * step AND age <= k * step + hours GROUP BY ALL),
b AS (SELECT series, hours, past, count(*) AS baselines, quantile_cont(v, 0.5) AS median FROM v WHERE k > 0 GROUP BY ALL), d AS (SELECT v.series, v.hours, quantile_cont(abs(v - median), 0.5) AS mad FROM v JOIN b ON v.series = b.series AND v.hours = b.hours WHERE k > 0 GROUP BY ALL)
SELECT v.series, v.hours, CAST(v.v AS BIGINT) AS current, coalesce(baselines, 0) AS baselines, median, mad, CASE WHEN mad > 0 THEN round((v.v - median) / mad, 9) END AS robust_z, CASE WHEN coalesce(baselines, 0) = v.past THEN 'ready' ELSE 'warming' END AS status
FROM v LEFT JOIN b ON v.series = b.series AND v.hours = b.hours LEFT JOIN d ON v.series = d.series AND v.hours = d.hours WHERE k = 0""")
def _(spark, sf):
    return measures.multi_scale(hourly(spark, sf), "series", ts("2024-01-29 12:00:00")).withColumn("robust_z", F.round("robust_z", 9))


@op("diffusion_layers", """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), s AS (SELECT d.user_id, d.day, e.event_type, count(*) AS c, min(e.ts::DATE) = d.day AS fresh FROM d JOIN events e ON e.user_id = d.user_id AND e.ts::DATE <= d.day GROUP BY 1, 2, 3),
p AS (SELECT *, c::DOUBLE / sum(c) OVER (PARTITION BY user_id, day) AS p FROM s)
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE fresh) AS new_layers, count(*) AS layers, CAST(sum(c) AS BIGINT) AS mentions, round(sum(-p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY user_id, p.day""")
def _(spark, sf):
    return measures.diffusion_layers(table(spark, sf, "events"), "user_id", "event_type", "ts").withColumn("day", F.col("day").cast("string"))


@op("relation_break", """WITH d AS (SELECT l_returnflag AS k, CAST(epoch(l_shipdate) AS BIGINT) // 604800 AS week, CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b FROM lineitem WHERE l_partkey % 3 = 0 OR l_shipdate < TIMESTAMP '1995-01-01'),
w AS (SELECT DISTINCT k, week FROM d), r AS (SELECT w.k, w.week, count(*) AS n, CASE WHEN var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN corr(a, b) END AS r FROM w JOIN d ON d.k = w.k AND d.week BETWEEN w.week - 3 AND w.week GROUP BY ALL),
h AS (SELECT x.k, x.week, count(y.r) AS past, avg(y.r) AS was, stddev_samp(y.r) AS spread FROM r x LEFT JOIN r y ON y.k = x.k AND y.week <= x.week - 4 GROUP BY ALL)
SELECT r.k AS l_returnflag, r.week, r.n, round(r.r, 6) AS now, round(h.was, 6) AS was, round(h.spread, 6) AS spread, CASE WHEN past < 8 OR r.r IS NULL THEN 'warming' WHEN abs(r.r - was) > 3 * spread THEN 'broken' ELSE 'holds' END AS status FROM r JOIN h ON r.k = h.k AND r.week = h.week""")
def _(spark, sf):
    """Weekly sums, correlations over four weeks, against all earlier ones that share no week."""
    rows = table(spark, sf, "lineitem").where((F.col("l_partkey") % 3 == 0) | (F.col("l_shipdate") < ts("1995-01-01")))
    rows = rows.select("l_returnflag", F.floor(F.unix_timestamp("l_shipdate") / 604800).alias("week"), F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    return measures.relation_break(rows, "l_returnflag", "week", "a", "b", buckets=4).select("l_returnflag", "week", "n", F.round("now", 6).alias("now"), F.round("was", 6).alias("was"), F.round("spread", 6).alias("spread"), "status")


@op("stratum_deficit", "WITH t(stratum, target) AS (VALUES ('en', 0.7::DOUBLE), ('es', 0.05::DOUBLE)), s AS (SELECT stratum, target, (SELECT count(*) FROM documents WHERE lang = stratum)::DOUBLE / (SELECT count(*) FROM documents) AS share FROM t) SELECT *, greatest(target - share, 0.0) AS deficit, greatest(target - share, 0.0) / target AS normalised FROM s")
def _(spark, sf):
    return measures.stratum_deficit(table(spark, sf, "documents"), "lang", {"en": 0.7, "es": 0.05})


@op("seeded_exploration", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s7|' || CAST(o_orderkey AS VARCHAR))) AS rank FROM orders) SELECT o_orderkey, o_orderpriority, rank FROM r WHERE rank <= 20")
def _(spark, sf):
    return measures.seeded_exploration(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "s7", 20).select("o_orderkey", "o_orderpriority", F.col("rank").cast("long").alias("rank"))


@op("lane_budget", "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT * FROM r WHERE place <= CASE o_orderstatus WHEN 'F' THEN 50 WHEN 'O' THEN 25 ELSE 15 END")
def _(spark, sf):
    return measures.lane_budget(table(spark, sf, "orders"), "o_orderstatus", [F.col("o_totalprice").desc(), F.col("o_orderkey")], {"F": 50, "O": 25, "P": 15}).select("o_orderkey", "o_orderstatus", F.col("place").cast("long").alias("place"))


@op("state_as_of", f"WITH {LOG} SELECT aggregate_id, arg_max(to_state, revision) AS state FROM lg WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1")
def _(spark, sf):
    return measures.state_as_of(log(spark, sf).withColumnRenamed("ts", "available_at"), ts("2024-01-10"))


@op("processing_frontier", "WITH s AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'error') AS stop FROM events GROUP BY 1) SELECT s.user_id, max(CASE WHEN event_type <> 'error' AND (stop IS NULL OR ts < stop) THEN ts END) AS frontier FROM s JOIN events e ON e.user_id = s.user_id GROUP BY 1")
def _(spark, sf):
    return measures.processing_frontier(table(spark, sf, "events").select("user_id", F.col("ts").alias("arrived_at"), (F.col("event_type") != "error").alias("terminal")), "user_id")


@op("data_cutoff", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN least(l_shipdate, TIMESTAMP '1997-05-01') END AS cutoff FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", measures.data_cutoff(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")), ts("1997-05-01")).alias("cutoff"))


@op("service_slo", "WITH b AS (SELECT event_type AS service, count(*) AS slots, avg(CASE WHEN value < 250 THEN 1.0 ELSE 0.0 END) AS on_time_rate FROM events GROUP BY 1), r AS (SELECT event_type AS service, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT service, slots, on_time_rate, value AS p95_lag, CASE WHEN slots < 60 THEN 'warming_up' ELSE 'measured' END AS status FROM b JOIN r USING (service) WHERE k = ceil(n * 0.95)")
def _(spark, sf):
    return measures.service_slo(table(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("value").alias("lag"), (F.col("value") < 250).alias("on_time")))


@op("four_state", "SELECT c_custkey, CASE WHEN NOT c_nationkey < 20 THEN 'NOT_OBSERVABLE' WHEN c_acctbal < 0 THEN 'COLLECTION_MISSING' WHEN count(o_orderkey) = 0 THEN 'SOURCE_SILENT' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN 'OBSERVED_ZERO' ELSE 'OBSERVED' END AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_acctbal")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("versions"), F.count_if(F.col("o_orderstatus") == "P").alias("matches"))
    c = table(spark, sf, "customer").join(o, "c_custkey", "left").withColumns({"in_purpose": F.col("c_nationkey") < 20, "incomplete": F.col("c_acctbal") < 0, "versions": F.coalesce("versions", F.lit(0)), "matches": F.coalesce("matches", F.lit(0))})
    return measures.four_state(c).select("c_custkey", "state")


@op("collection_metrics", """WITH l AS (SELECT l_returnflag, CAST(l_tax AS DOUBLE) + 1 AS w, l_quantity > 5 AS o, l_quantity > 20 AS c, CASE WHEN l_linenumber < 6 THEN CAST(l_discount AS DOUBLE) * 10 END AS f FROM lineitem)
SELECT l_returnflag, round(sum(w) FILTER (WHERE o) / sum(w), 9) AS observability, round(sum(w) FILTER (WHERE c) / sum(w) FILTER (WHERE o), 9) AS completion, round(sum(w * coalesce(f, 0)) FILTER (WHERE o) / sum(w) FILTER (WHERE o), 9) AS cursor_completeness FROM l GROUP BY 1""")
def _(spark, sf):
    fraction = F.when(F.col("l_linenumber") < 6, F.col("l_discount").cast("double") * 10)
    l = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_tax").cast("double") + 1).alias("weight"), (F.col("l_quantity") > 5).alias("observed"), (F.col("l_quantity") > 20).alias("complete"), fraction.alias("cursor_fraction"))
    return measures.collection_metrics(l, "l_returnflag").select("l_returnflag", *[F.round(c, 9).alias(c) for c in ("observability", "completion", "cursor_completeness")])


DUE = "(VALUES (7), (30), (90), (180), (365), (730)) v(h)"


@op("horizon_obligations", f"""WITH due AS (SELECT o_orderkey AS k, h FROM orders, {DUE}), dc AS (SELECT l_orderkey AS k, CASE l_linenumber WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 90 WHEN 4 THEN 180 WHEN 5 THEN 365 WHEN 6 THEN 730 ELSE 7 END AS h FROM lineitem),
rs AS (SELECT o_orderkey AS k, h FROM orders, {DUE} WHERE (o_orderkey + h) % 9 > 0 UNION ALL SELECT o_orderkey, 365 FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT o_orderkey, 8 FROM orders WHERE o_orderkey % 50 = 0),
d AS (SELECT k, h, count(*) AS n FROM dc GROUP BY ALL), r AS (SELECT k, h, count(*) AS n FROM rs GROUP BY ALL), j AS (SELECT due.k, due.h, coalesce(d.n, 0) AS d, coalesce(r.n, 0) AS r FROM due LEFT JOIN d ON d.k = due.k AND d.h = due.h LEFT JOIN r ON r.k = due.k AND r.h = due.h)
SELECT k AS candidate_id, CAST(h AS INTEGER) AS horizon, 'DECISION_MISSING' AS error FROM j WHERE d = 0 UNION ALL SELECT k, h, 'DECISION_DOUBLE' FROM j WHERE d > 1 UNION ALL SELECT k, h, 'RESULT_MISSING' FROM j WHERE r = 0 UNION ALL SELECT k, h, 'RESULT_DOUBLE' FROM j WHERE r > 1
UNION ALL SELECT k, h, 'NOT_DUE' FROM (SELECT k, h FROM d UNION SELECT k, h FROM r) x WHERE NOT EXISTS (SELECT 1 FROM due WHERE due.k = x.k AND due.h = x.h)""")
def _(spark, sf):
    """Line numbers stand for horizons, a seventh line decides on the first again."""
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    nth = F.element_at(F.array(*map(F.lit, (*measures.HORIZONS, 7))), F.col("l_linenumber").cast("int"))
    decisions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), nth.alias("horizon"))
    every = orders.select(k.alias("candidate_id"), F.explode(F.array(*map(F.lit, measures.HORIZONS))).alias("horizon")).where("(candidate_id + horizon) % 9 > 0")
    again = orders.where(k % 13 == 0).select(k.alias("candidate_id"), F.lit(365).alias("horizon")).unionByName(orders.where(k % 50 == 0).select(k.alias("candidate_id"), F.lit(8).alias("horizon")))
    return measures.horizon_obligations(orders.select(k.alias("candidate_id")), decisions, every.unionByName(again))


@op("independence_bounds", "SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) AS lower, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) + count(*) FILTER (WHERE o_orderstatus = 'P') AS upper, count(*) FILTER (WHERE o_orderstatus = 'P')::DOUBLE / count(*) AS unknown_share FROM orders GROUP BY 1")
def _(spark, sf):
    return measures.independence_bounds(table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("origin_id"), (F.col("o_orderstatus") != "P").alias("confirmed")), "o_custkey")


@op("emission_dedup", "SELECT event_id, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS emission_key, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 THEN 'create' ELSE 'append' END AS action FROM events")
def _(spark, sf):
    return measures.emission_dedup(table(spark, sf, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_id", "emission_key", "action")


@op("supersession_projection", "SELECT o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS projected_to FROM orders")
def _(spark, sf):
    return measures.supersession(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate").select("o_orderkey", "projected_to")


@op("prevalence_ipw", "SELECT event_type, round(sum(1 / (value + 1)), 6) AS prevalence FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(1 / (F.col("value") + 1)), 6).alias("prevalence"))


@op("pointer_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@op("candidate_conversion", """WITH c AS (SELECT o_orderpriority AS kind, o_orderkey, o_orderdate AS begun, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS watched, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'faded' END END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 40 + o_orderkey % 11 AS INTEGER)) END AS ended FROM orders)
SELECT kind, count(*) AS candidates, round(count(watched)::DOUBLE / count(*), 9) AS watch_rate, round(avg(date_diff('day', begun, watched)), 6) AS days_to_watch, round(count(*) FILTER (WHERE outcome = 'confirmed')::DOUBLE / count(watched), 9) AS confirmed_share,
  round(count(*) FILTER (WHERE outcome = 'faded')::DOUBLE / count(watched), 9) AS faded_share, round(count(*) FILTER (WHERE watched IS NOT NULL AND outcome IS NULL)::DOUBLE / count(watched), 9) AS open_share, round(avg(date_diff('day', watched, ended)), 6) AS days_to_outcome FROM c GROUP BY 1""")
def _(spark, sf):
    k, day = F.col("o_orderkey"), lambda n: F.timestamp_seconds(F.unix_timestamp("o_orderdate") + n * 86400)
    c = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") != "P", day(k % 40)).alias("watched_at"), F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, "confirmed").otherwise("faded")).alias("outcome"),
        F.when(F.col("o_orderstatus") == "F", day(k % 40 + k % 11)).alias("ended_at"))
    got = measures.candidate_conversion(c, "kind", ["confirmed", "faded"])
    return got.select("kind", "candidates", *[F.round(x, 9 if "days" not in x else 6).alias(x) for x in got.columns[2:]])


CELLS = (  # rows, columns, days, distinct columns wanted, a condition of which one row must hold
    ("region", "language", 7, 2, None), ("region", "role", 7, 5, "role IN ('role1', 'role4')"), ("region", "medium", 7, 4, "medium = 'm0'"), ("domain", "role", 7, 3, None),
    ("domain", "medium", 7, 2, "medium IN ('m0', 'm1')"), ("language", "source", 7, 4, None), ("region", "domain", 30, 10, None),
)
CELL_ITEMS = """i AS (SELECT lang AS language, source, 'R' || CAST(CAST(substring(source, 4) AS INTEGER) % 5 AS VARCHAR) AS region, 'role' || (doc_id % 7) AS role, 'm' || (doc_id // 7 % 6) AS medium, 'd' || (doc_id // 3 % 14) AS domain,
  TIMESTAMP '2024-01-01' + to_hours(CAST((doc_id * 7919) % 1440 AS INTEGER)) AS seen_at FROM documents)"""


@op("cross_cell_sla", f"WITH {CELL_ITEMS} " + " UNION ALL ".join(
    f"""SELECT '{a} x {b}' AS cross_table, {a} AS cell_row, count(DISTINCT {b}) FILTER (WHERE recent) AS held, count(*) FILTER (WHERE recent) AS items, {least} AS target,
  coalesce(bool_or(recent AND {also or 'true'}), false) AS special, count(DISTINCT {b}) FILTER (WHERE recent) >= {least} AND coalesce(bool_or(recent AND {also or 'true'}), false) AS met
  FROM (SELECT *, seen_at >= TIMESTAMP '2024-02-28' - INTERVAL {days} DAY AND seen_at < TIMESTAMP '2024-02-28' AS recent FROM i) GROUP BY {a}""" for a, b, days, least, also in CELLS))
def _(spark, sf):
    k, h = F.col("doc_id"), F.unix_timestamp(ts("2024-01-01"))
    items = table(spark, sf, "documents").select(
        F.col("lang").alias("language"), "source", F.concat(F.lit("R"), (F.substring("source", 4, 10).cast("int") % 5).cast("string")).alias("region"), F.concat(F.lit("role"), (k % 7).cast("string")).alias("role"),
        F.concat(F.lit("m"), (F.floor(k / 7) % 6).cast("string")).alias("medium"), F.concat(F.lit("d"), (F.floor(k / 3) % 14).cast("string")).alias("domain"), F.timestamp_seconds(h + k * 7919 % 1440 * 3600).alias("seen_at"))
    return measures.cross_cells(items, "seen_at", ts("2024-02-28"), [measures.Cross(*c) for c in CELLS])


@op("signal_admission", """WITH p AS (SELECT p_partkey, p_brand, p_type, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS pr FROM part), a AS (SELECT *, CASE WHEN pr >= 0.95 THEN 'strong' WHEN pr >= 0.9 THEN 'admitted' END AS admission FROM p)
SELECT p_partkey, p_brand, p_type, admission, count(*) OVER (PARTITION BY p_brand, p_type) AS of_type FROM a WHERE admission IS NOT NULL""")
def _(spark, sf):
    return measures.signal_admission(table(spark, sf, "part"), "p_brand", "p_type", "p_retailprice").select("p_partkey", "p_brand", "p_type", "admission", "of_type")


@op("baseline_status", """WITH d AS (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders GROUP BY 1)
SELECT o_custkey, days, CASE WHEN days < 28 THEN 'warming' WHEN days < 90 THEN 'hourly' WHEN days < 365 THEN 'daily' ELSE 'seasonal' END AS status, CASE WHEN days < 28 THEN 28 WHEN days < 90 THEN 90 WHEN days < 365 THEN 365 END AS next_at FROM d""")
def _(spark, sf):
    return measures.baseline_status(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


# ---- lineages of near duplicates
@op("near_duplicate_lineage", r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT k, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
h AS (SELECT DISTINCT k, s FROM c), t AS (SELECT k, md5(string_agg(s, chr(10) ORDER BY s)) AS sid FROM h GROUP BY k), n AS (SELECT d.k, source, coalesce(sid, '-') AS sid FROM d LEFT JOIN t USING (k)),
u AS (SELECT DISTINCT sid, s FROM h JOIN t USING (k)), z AS (SELECT sid, count(*) AS n FROM u GROUP BY 1), o AS (SELECT a.sid AS x, b.sid AS y, count(*) AS o FROM u a JOIN u b ON a.s = b.s AND a.sid <> b.sid GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN z p ON p.sid = x JOIN z q ON q.sid = y WHERE 5 * o >= 4 * (p.n + q.n - o)), r(x, y) AS (SELECT DISTINCT sid, sid FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
g AS (SELECT x AS sid, min(y) AS lineage FROM r GROUP BY 1), p AS (SELECT source, lineage, count(*) AS n FROM n JOIN g USING (sid) GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS items, count(*) AS origins, max(n) AS largest FROM p GROUP BY 1""")
def _(spark, sf):
    """Items and independent origins of each source, from all pairs of whole texts of which four fifths agree."""
    documents = table(spark, sf, "documents").select("source", "text", F.monotonically_increasing_id().alias("item"))
    return coverage.lineage_origins(documents, similarity.lineages(documents, "item"), "item", "source")

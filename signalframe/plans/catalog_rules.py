"""Queries of rules, bindings, registers and plans; registered beside the rest. Stand-in rows are written once for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.functions.text import time_parse
from signalframe.operators import bindings, measures, planning, registers, rules
from signalframe.plans.catalog import op, ts
from signalframe.plans.views import table
from signalframe.sources import feeds


class View:
    """A select list over one table, for Spark and for DuckDB; DAYS(column, n;) adds days, ARR( opens an array."""

    def __init__(self, name: str, source: str, columns: str):
        days = r"DAYS\(([a-z_]+), ([^;]+);\)"
        self.table, _, rest = source.partition(" ")
        spark = re.sub(days, r"timestamp_seconds(unix_timestamp(\1) + (\2) * 86400)", columns).replace("ARR(", "array(")
        self.spark = f"SELECT {spark} FROM {{source}} {rest}"
        duck = re.sub(days, r"(\1 + to_days(CAST(\2 AS INTEGER)))", columns).replace("ARR(", "list_value(")
        self.sql = f"{name} AS (SELECT {duck} FROM {source})"

    def __call__(self, spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(self.spark, source=table(spark, sf, self.table))


# ---- row rules
ALL_CLAIMS = list(dict.fromkeys(c for cs in rules.PURPOSE_CLAIMS.values() for c in cs))
HELD = ", ".join(f"CASE WHEN (event_id + {i}) % 17 <> 0 THEN '{c}' END" for i, c in enumerate(ALL_CLAIMS))
REQUEST = View("req", "events", f"""event_id, CASE event_type WHEN 'click' THEN 'O_acquire' WHEN 'view' THEN 'O_display' WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'O_model:local' ELSE 'O_model:p' || CAST(user_id % 5 AS STRING) END
 WHEN 'signup' THEN 'O_train:m' || CAST(user_id % 3 AS STRING) || ',tune' ELSE CASE user_id % 3 WHEN 0 THEN 'O_extract' WHEN 1 THEN 'O_signal' ELSE 'O_other' END END AS purpose,
 CASE WHEN value > 50 THEN 'allow' ELSE 'deny' END AS granted, ARR({HELD}) AS claims, CAST(user_id % 4 AS STRING) AS expected_hash,
 CASE WHEN event_id % 19 = 0 THEN 'x' ELSE CAST(user_id % 4 AS STRING) END AS snapshot_hash, CASE WHEN event_id % 23 = 0 THEN 'y' ELSE CAST(user_id % 4 AS STRING) END AS output_hash,
 CASE event_id % 5 WHEN 0 THEN 'global_cache' WHEN 1 THEN '' ELSE 'session' END AS sink""")
_PATTERN = lambda name: name.split("{")[0] + rules.PLACEHOLDERS.get("{" + name.partition("{")[2], "")
PURPOSES = "r(no, rx, claim, k) AS (VALUES " + ", ".join(f"({no}, '{_PATTERN(n)}', '{c}', {k})" for no, (n, cs) in enumerate(rules.PURPOSE_CLAIMS.items()) for k, c in enumerate(cs)) + """),
m AS (SELECT event_id, min(no) AS no FROM req JOIN (SELECT DISTINCT no, rx FROM r) ON regexp_full_match(purpose, rx) GROUP BY 1),
x AS (SELECT event_id, string_agg(claim, ',' ORDER BY k) AS missing FROM m JOIN r USING (no) JOIN req USING (event_id) WHERE NOT coalesce(list_contains(claims, claim), false) GROUP BY 1),
pe AS (SELECT req.*, coalesce(missing, '') AS missing_claims, CASE WHEN no IS NULL THEN 'PURPOSE_UNKNOWN' WHEN granted <> 'allow' OR missing IS NOT NULL THEN
 CASE WHEN starts_with(purpose, 'O_train') THEN 'PURPOSE_TRAIN_DENIED' ELSE 'PURPOSE_' || upper(replace(replace(split_part(purpose, ':', 1), 'O', ''), '_', '')) || '_DENIED' END END AS reason_code FROM req LEFT JOIN m USING (event_id) LEFT JOIN x USING (event_id))"""


def _requests(spark, sf):
    return REQUEST(spark, sf).withColumnRenamed("granted", "authorization")


@op("purpose_eligibility", f"WITH {REQUEST.sql}, {PURPOSES} SELECT event_id, reason_code, missing_claims, CASE WHEN reason_code IS NULL THEN 'allow' ELSE 'deny' END AS decision FROM pe")
def _(spark, sf):
    return rules.purpose_eligibility(_requests(spark, sf)).select("event_id", "reason_code", F.array_join("missing_claims", ",").alias("missing_claims"), "decision")


@op("output_rules", f"""WITH {REQUEST.sql}, {PURPOSES} SELECT event_id, CASE WHEN reason_code IS NOT NULL THEN reason_code WHEN snapshot_hash <> expected_hash THEN 'REVOCATION_DEPENDENCY_MISMATCH'
 WHEN sink = '' OR (starts_with(purpose, 'O_model') AND sink = 'global_cache') THEN 'OUTPUT_SINK_DENIED' WHEN output_hash <> snapshot_hash THEN 'OUTPUT_REVOCATION_DEPENDENCY_MISMATCH' END AS reason_code FROM pe""")
def _(spark, sf):
    return rules.output_rules(_requests(spark, sf)).select("event_id", "reason_code")


RECEIPT = View("rc", "lineitem", """l_orderkey * 10 + l_linenumber AS k, CASE l_linenumber WHEN 1 THEN 'callback' WHEN 2 THEN 'sync' WHEN 3 THEN 'poll' WHEN 4 THEN 'download' WHEN 5 THEN 'callback' WHEN 6 THEN 'push' END AS mode,
 l_discount < 0.09 AS closed, CAST(l_partkey % 9 AS STRING) AS output_hash, CAST(CASE WHEN l_suppkey % 6 = 0 THEN 0 ELSE l_partkey % 9 END AS STRING) AS invocation_hash,
 CASE WHEN l_returnflag = 'R' OR l_linenumber IN (1, 5) THEN 's' END AS provider_signature, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_linenumber IN (1, 5) THEN 'n' ELSE '' END AS nonce,
 CAST(l_orderkey AS STRING) AS provider_job_id, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'c' END AS captured_exchange_id, l_linestatus AS authenticated_peer, CASE WHEN l_partkey % 13 <> 0 THEN 'h' END AS raw_response_hash""")


@op("receipt_rules", f"""WITH {RECEIPT.sql} SELECT k, CASE WHEN NOT closed THEN 'RESPONSE_SET_NOT_CLOSED' WHEN output_hash <> invocation_hash THEN 'RESPONSE_DEPENDENCY_MISMATCH'
 WHEN mode = 'callback' THEN CASE WHEN nonce IS NULL OR captured_exchange_id = '' THEN 'CALLBACK_PROOF_INCOMPLETE' END
 WHEN mode IN ('sync', 'poll', 'download') THEN CASE WHEN captured_exchange_id = '' OR raw_response_hash IS NULL THEN 'RESPONSE_PROOF_INCOMPLETE' WHEN provider_signature IS NOT NULL THEN 'NON_CALLBACK_HAS_CALLBACK_PROOF' END
 ELSE 'RESPONSE_MODE_UNSUPPORTED' END AS reason_code FROM rc""")
def _(spark, sf):
    return rules.receipt_rules(RECEIPT(spark, sf)).select("k", "reason_code")


TOKEN = View("tk", "lineitem", """l_orderkey * 10 + l_linenumber AS k, l_partkey % 5 AS token_surface_id, CASE WHEN l_suppkey % 7 = 0 THEN 4 ELSE l_partkey % 5 END AS request_surface_id, l_orderkey AS token_snapshot_id, l_orderkey AS request_snapshot_id,
 l_suppkey AS token_presentation_event_id, l_suppkey AS request_presentation_event_id, l_returnflag AS token_query_shape, CASE WHEN l_linenumber = 5 THEN 'R' ELSE l_returnflag END AS request_query_shape,
 ARR(l_linenumber, l_linenumber + 1) AS member_ids, CASE WHEN l_quantity > 40 THEN 99 ELSE l_linenumber END AS requested_member_id""")


@op("token_scope", f"WITH {TOKEN.sql} SELECT k, CASE WHEN token_surface_id = request_surface_id AND token_query_shape = request_query_shape AND requested_member_id <> 99 THEN 'allow' ELSE 'blocked' END AS decision FROM tk")
def _(spark, sf):
    return rules.token_scope(TOKEN(spark, sf), ["surface_id", "snapshot_id", "presentation_event_id", "query_shape"]).select("k", "decision")


VIEWED, EPOCH = View("vw", "orders", "o_orderkey AS token_id, o_custkey AS surface_id, o_orderkey % 3 AS rights_epoch, o_orderstatus AS stage"), View("ep", "customer", "c_custkey AS surface_id, CAST(c_nationkey % 3 AS BIGINT) AS rights_epoch")


@op("stale_view", f"WITH {VIEWED.sql}, {EPOCH.sql} SELECT token_id, CASE WHEN vw.rights_epoch = ep.rights_epoch THEN stage ELSE 'RADAR_VIEW_RECOMPUTING' END AS state, coalesce(vw.rights_epoch = ep.rights_epoch, false) AS bytes_allowed FROM vw LEFT JOIN ep USING (surface_id)")
def _(spark, sf):
    return rules.stale_view(VIEWED(spark, sf), EPOCH(spark, sf), "surface_id").select("token_id", "state", "bytes_allowed")


CLAIM = View("cl", "orders", """o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'external_world_state' WHEN 'O' THEN 'source_claim' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'opinion' ELSE 'ai_inference' END END AS claim_type,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'N' ELSE 'A' END END AS item_version_id,
 CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'entailed' ELSE 'not_applicable' END WHEN o_orderkey % 13 = 0 THEN 'neutral' ELSE 'entailed' END AS entailment_result,
 CASE WHEN o_orderkey % 4 = 0 THEN ARR('1', '2') ELSE ARR('1') END AS evidence_scope_ids, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN ARR('p') END AS premise_scope_ids,
 CASE WHEN o_orderkey % 6 = 0 THEN ARR('SOURCE_CONFLICT') END AS reason_codes, CASE WHEN o_totalprice > 200000 THEN 'disputed' ELSE 'settled' END AS epistemic_status,
 CASE WHEN o_orderkey % 18 = 0 THEN ARR('a', 'b') ELSE ARR('a', 'a') END AS conflicting_source_claim_ids, CASE WHEN o_orderkey % 3 = 0 THEN 'supported' END AS inference_support_status""")
SCOPE = View("sc", "lineitem WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_orderkey % 4 = 0)", "l_orderkey AS claim_id, CAST(l_linenumber AS STRING) AS evidence_scope_id, CASE WHEN l_quantity > 48 THEN '' ELSE l_returnflag END AS item_version_id")


@op("report_claim_rules", f"""WITH {CLAIM.sql}, {SCOPE.sql}, g AS (SELECT claim_id, count(*) AS n, bool_or(item_version_id = '') AS bl, list(DISTINCT item_version_id) AS vs, list_sort(list(evidence_scope_id)) AS ids FROM sc GROUP BY 1)
SELECT cl.claim_id, CASE WHEN claim_type IN ('external_world_state', 'source_claim') THEN CASE WHEN item_version_id = '' THEN 'CLAIM_ITEM_VERSION_MISSING' WHEN entailment_result <> 'entailed' THEN 'EVIDENCE_NOT_ENTAILED'
 WHEN n IS NULL OR bl THEN 'CLAIM_EVIDENCE_MISSING' WHEN ids <> evidence_scope_ids OR vs <> [item_version_id] THEN 'CLAIM_SCOPE_MISMATCH'
 WHEN reason_codes IS NOT NULL AND epistemic_status <> 'disputed' THEN 'SOURCE_CONFLICT_REQUIRES_DISPUTED' WHEN reason_codes IS NOT NULL AND cl.claim_id % 18 <> 0 THEN 'SOURCE_CONFLICT_SOURCES_MISSING' END
 WHEN claim_type = 'ai_inference' THEN CASE WHEN entailment_result <> 'not_applicable' THEN 'INFERENCE_ENTAILMENT' WHEN premise_scope_ids IS NULL THEN 'INFERENCE_PREMISES_MISSING' WHEN inference_support_status IS NULL THEN 'INFERENCE_SUPPORT_MISSING' END
 ELSE 'CLAIM_TYPE_UNSUPPORTED' END AS error FROM cl LEFT JOIN g USING (claim_id)""")
def _(spark, sf):
    return rules.report_claim_rules(CLAIM(spark, sf), SCOPE(spark, sf)).select("claim_id", "error")


@op("nested_catalog_filter", """SELECT o_orderkey AS id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS components FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_orderstatus = 'F' AND (l_returnflag = 'R' OR l_linestatus = 'R') AND CAST(l_partkey AS VARCHAR) LIKE '%1%' GROUP BY 1""")
def _(spark, sf):
    part = F.struct(F.col("l_linenumber").alias("id"), F.array("l_returnflag", "l_linestatus").alias("targets"), F.col("l_partkey").cast("string").alias("priority"), F.lit("adopt").alias("mode"))
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("components"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("repository"), F.array("o_orderstatus").alias("categories"), F.lit("MIT").alias("license"), F.lit("kept").alias("disposition"))
    got = rules.nested_catalog_filter(o.join(parts, "id"), {"project": "Urgent", "category": "f", "target": "r", "priority": "1"})
    return got.select("id", F.array_join(F.transform("components", lambda c: c["id"].cast("string")), ",").alias("components"))


@op("signal_allocation", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'TYPES_MISSING' WHEN o_orderkey % 5 = 0 THEN 'LANE_NOT_ONE' WHEN o_orderkey % 7 = 0 THEN 'SECTIONS_INVALID' END AS error FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    types = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("emergence"))).otherwise(F.array(F.lit("diffusion"), F.lit("emergence")))
    lanes = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("core")))
    sections = F.when(k % 7 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return rules.signal_allocation(table(spark, sf, "orders").select("o_orderkey", types.alias("signal_types"), lanes.alias("allocation_lanes"), sections.alias("surface_sections"))).select("o_orderkey", "error")


NESTED = """'{"a":{"n":' || CAST(o_custkey % 9 AS VARCHAR) || ',"o":[{"b":"' || o_orderpriority || '","z":null}]},"c":"\\"q\\" ' || o_orderstatus || '"}'"""


@op("revocation_set_hash", f"""SELECT o_orderkey, sha256('{{"global":' || {NESTED} || ',"personal":"' || CAST(o_custkey AS VARCHAR) || '","rights":[],"epochs":{{"a":' || CAST(o_orderkey % 7 AS VARCHAR) || ',"bb":' || CAST(o_custkey AS VARCHAR) || ',"c":null}}}}') AS set_hash FROM orders""")
def _(spark, sf):
    """Nested values whose keys come in one order for odd orders and in another for even ones."""
    inner = F.struct(F.lit(None).cast("string").alias("z"), F.col("o_orderpriority").alias("b"))
    deep = F.struct(F.array(inner).alias("o"), (F.col("o_custkey") % 9).alias("n"))
    pairs = [(F.lit("a"), F.col("o_orderkey") % 7), (F.lit("bb"), F.col("o_custkey")), (F.lit("c"), F.lit(None).cast("long"))]
    epochs = lambda order: F.create_map(*[x for i in order for x in pairs[i]])
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.struct(F.concat(F.lit('"q" '), F.col("o_orderstatus")).alias("c"), deep.alias("a")).alias("g"), F.col("o_custkey").cast("string").alias("p"), F.array().cast("array<string>").alias("r"),
        F.when(F.col("o_orderkey") % 2 == 0, epochs([2, 0, 1])).otherwise(epochs([1, 2, 0])).alias("e"))
    return rows.select("o_orderkey", rules.revocation_set_hash(rows, {"global": "g", "personal": "p", "rights": "r"}, "e").alias("set_hash"))


PKEY = "CAST(l_orderkey AS VARCHAR) || '|p1|s1|' || l_returnflag || '|[{\"id\": ' || CAST(l_partkey AS VARCHAR) || ', \"kind\": \"' || l_linestatus || '\", \"version\": null}]|' || CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || '|main'"


@op("coverage_projection_key", f"WITH h AS (SELECT {PKEY} AS key, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({PKEY})) AS m FROM lineitem) SELECT key, substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-5' || substring(m, 14, 3) || '-' || substring('89ab', CAST(('0x' || substring(m, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || substring(m, 18, 3) || '-' || substring(m, 21, 12) AS item_id FROM h")
def _(spark, sf):
    """Typed references with their keys out of order, as lists of structs."""
    ref = F.struct(F.lit(None).cast("int").alias("version"), F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("id"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scope"), F.lit("p1").alias("policy"), F.lit("s1").alias("semantics"), F.col("l_returnflag").alias("kind"), F.array(ref).alias("refs"), F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey").cast("long")).alias("strata"), F.lit("main").alias("role"))
    key, own = rules.projection_key(rows, rows.columns, "6ba7b8109dad11d180b400c04fd430c8")
    return rows.select(key.alias("key"), own.alias("item_id"))


@op("decline_breaker", """WITH d AS (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') < count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS decline, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS health, count(DISTINCT CAST(ts AS DATE)) >= 3 AS ready FROM events GROUP BY 1),
s AS (SELECT user_id, decline, CASE WHEN decline AND health < 0.8 THEN 'COLLECTION_UNHEALTHY' WHEN decline AND NOT ready THEN 'BASELINE_UNAVAILABLE' END AS suppressed_by FROM d) SELECT user_id, suppressed_by, decline AND suppressed_by IS NULL AS reported FROM s""")
def _(spark, sf):
    half = F.col("ts") >= ts("2024-01-16")
    g = table(spark, sf, "events").groupBy("user_id").agg((F.count_if(half) < F.count_if(~half)).alias("decline"), F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).alias("health"), (F.count_distinct(F.to_date("ts")) >= 3).alias("baseline_available"))
    return rules.decline_breaker(g.select("user_id", "decline"), g, "user_id", 0.8).select("user_id", "suppressed_by", "reported")


# ---- bindings
ASKED = View("ask", "lineitem", "l_orderkey * 10 + l_linenumber AS k, l_orderkey AS version_id, CASE l_returnflag WHEN 'R' THEN 'O_display' WHEN 'A' THEN 'O_train' ELSE 'O_model:x' END AS purpose, l_linestatus AS processor, l_shipdate AS at, l_quantity AS display_chars, CASE WHEN l_linenumber % 2 = 0 THEN 'identity' ELSE 'trim' END AS transform")
GRANT = View("gr", "orders", "o_orderkey AS version_id, CASE o_orderstatus WHEN 'F' THEN 'O_display' WHEN 'O' THEN 'O_train' ELSE 'O_model:x' END AS purpose, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END AS processor, CASE WHEN o_orderkey % 9 = 0 THEN 'deny' ELSE 'allow' END AS decision, o_orderdate AS checked_at, DAYS(o_orderdate, 60;) AS expires_at, CASE WHEN o_orderkey % 4 <> 0 THEN 30.0 END AS max_display_chars, CASE WHEN o_orderkey % 5 = 0 THEN 'trim' END AS allowed_transform")


@op("purpose_asof", f"""WITH {ASKED.sql}, {GRANT.sql} SELECT k, CASE WHEN gr.version_id IS NULL OR decision <> 'allow' OR ask.at < checked_at OR ask.at >= expires_at OR (ask.purpose = 'O_display' AND (max_display_chars IS NULL OR display_chars > max_display_chars)) OR (allowed_transform IS NOT NULL AND allowed_transform <> transform)
THEN CASE ask.purpose WHEN 'O_display' THEN 'PURPOSE_DISPLAY_DENIED' WHEN 'O_train' THEN 'PURPOSE_TRAIN_DENIED' ELSE 'PURPOSE_MODEL_DENIED' END END AS reason_code FROM ask LEFT JOIN gr ON gr.version_id = ask.version_id AND gr.purpose = ask.purpose AND gr.processor = ask.processor""")
def _(spark, sf):
    return bindings.purpose_asof(ASKED(spark, sf), GRANT(spark, sf)).select("k", "reason_code")


USE = View("us", "lineitem", "l_orderkey * 10 + l_linenumber AS k, l_suppkey AS credential_id, l_returnflag AS audience, l_linestatus AS scope, l_shipdate AS at")
CRED = View("cr", "supplier", "s_suppkey AS credential_id, CASE s_nationkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS audience, CASE WHEN s_suppkey % 4 = 0 THEN ARR('F') ELSE ARR('F', 'O') END AS allowed_scopes, CAST('1993-01-01 00:00:00' AS TIMESTAMP) AS effective_from, CAST('1997-06-01 00:00:00' AS TIMESTAMP) AS expires_at")
STATE = View("st", "orders", "o_custkey AS credential_id, o_orderkey AS revision, CASE WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'active' END AS state")


@op("credential_usable", f"WITH {USE.sql}, {CRED.sql}, {STATE.sql}, l AS (SELECT credential_id, arg_max(state, revision) AS state FROM st GROUP BY 1) SELECT k, coalesce(state = 'active' AND us.audience = cr.audience AND list_contains(allowed_scopes, scope) AND us.at >= effective_from AND us.at < expires_at, false) AS usable FROM us LEFT JOIN cr USING (credential_id) LEFT JOIN l USING (credential_id)")
def _(spark, sf):
    return bindings.credential_usable(USE(spark, sf), CRED(spark, sf), STATE(spark, sf)).select("k", "usable")


MANI = View("ma", "orders", "o_orderkey, o_custkey % 12 AS key_id, o_orderstatus AS kind, o_orderdate AS signed_at, DAYS(o_orderdate, 90;) AS effective_at, DAYS(o_orderdate, o_orderkey % 9 - 2;) AS available_at, CASE WHEN o_custkey % 8 <> 0 THEN o_custkey END AS owner_id, o_orderkey % 10 <> 0 AS verified")
KEYS = View("ky", "supplier", "s_suppkey AS key_id, CASE WHEN s_suppkey = 3 THEN 'retired' ELSE 'active' END AS key_state, 'test-governance' AS key_purpose, CASE WHEN s_suppkey % 2 = 0 THEN ARR('F', 'O') ELSE ARR('F', 'P', 'O') END AS authorized_kinds, CAST('1993-01-01 00:00:00' AS TIMESTAMP) AS effective_from, CAST('1997-06-01 00:00:00' AS TIMESTAMP) AS expires_at")


@op("signing_key_authorized", f"""WITH {MANI.sql}, {KEYS.sql} SELECT o_orderkey, CASE WHEN NOT verified THEN 'SIGNATURE_NOT_VERIFIED' WHEN ky.key_id IS NULL THEN 'KEY_MISSING' WHEN key_state <> 'active' OR NOT list_contains(authorized_kinds, kind) THEN 'KEY_NOT_AUTHORIZED'
WHEN signed_at < effective_from OR signed_at >= expires_at OR effective_at < effective_from OR effective_at >= expires_at THEN 'OUTSIDE_KEY_VALIDITY' WHEN signed_at > available_at OR owner_id IS NULL THEN 'SIGNED_AFTER_AVAILABLE' END AS error FROM ma LEFT JOIN ky USING (key_id)""")
def _(spark, sf):
    return bindings.signing_key_authorized(MANI(spark, sf), KEYS(spark, sf), "test-governance").select("o_orderkey", "error")


SNAP = View("sn", "orders", "o_orderkey, o_custkey AS profile_id, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS activation_id, CASE WHEN o_orderkey % 6 = 0 THEN 'weekly' ELSE 'daily' END AS snapshot_type, o_custkey % 5 AS scope_key, o_orderdate AS linearization_at, DAYS(o_orderdate, 30;) AS as_of")
PROF = View("pr", "customer", "c_custkey AS profile_id, 'daily' AS snapshot_type, c_custkey % 5 AS scope_key, c_custkey AS activation_id, CAST('1993-01-01 00:00:00' AS TIMESTAMP) AS effective_from, CASE WHEN c_custkey % 2 = 0 THEN CAST('1997-01-01 00:00:00' AS TIMESTAMP) END AS effective_until")
ACTV = View("ac", "customer", "c_custkey AS activation_id, c_custkey AS target_id, CASE WHEN c_nationkey = 3 THEN 'shadow' ELSE 'authoritative' END AS role, CAST('1994-01-01 00:00:00' AS TIMESTAMP) AS effective_from, CASE WHEN c_custkey % 3 = 0 THEN CAST('1998-01-01 00:00:00' AS TIMESTAMP) END AS effective_until")


@op("asof_profile_join", f"""WITH {SNAP.sql}, {PROF.sql}, {ACTV.sql} SELECT o_orderkey, CASE WHEN pr.profile_id IS NULL OR ac.activation_id IS NULL THEN 'BINDING_MISSING' WHEN role <> 'authoritative' OR target_id <> sn.profile_id OR pr.activation_id <> sn.activation_id THEN 'ACTIVATION_MISMATCH'
WHEN pr.snapshot_type <> sn.snapshot_type OR pr.scope_key <> sn.scope_key THEN 'SCOPE_MISMATCH' WHEN linearization_at < pr.effective_from OR as_of < pr.effective_from OR linearization_at >= coalesce(pr.effective_until, TIMESTAMP '9999-01-01') OR as_of >= coalesce(pr.effective_until, TIMESTAMP '9999-01-01') THEN 'PROFILE_NOT_VALID'
WHEN linearization_at < ac.effective_from OR as_of < ac.effective_from OR linearization_at >= coalesce(ac.effective_until, TIMESTAMP '9999-01-01') OR as_of >= coalesce(ac.effective_until, TIMESTAMP '9999-01-01') THEN 'ACTIVATION_NOT_VALID' END AS error FROM sn LEFT JOIN pr ON pr.profile_id = sn.profile_id LEFT JOIN ac ON ac.activation_id = sn.activation_id""")
def _(spark, sf):
    return bindings.asof_profile_join(SNAP(spark, sf), PROF(spark, sf), ACTV(spark, sf)).select("o_orderkey", "error")


UNIT = View("un", "lineitem", "l_orderkey * 10 + l_linenumber AS unit_id, l_suppkey AS profile_id, l_returnflag AS role, l_linestatus AS subject_kind, CASE WHEN l_quantity > 25 THEN 'selected' ELSE 'rejected' END AS decision, CASE WHEN l_tax > 0.04 THEN 'F' ELSE 'O' END AS selected_kind")
ROLE = View("ro", "supplier", "s_suppkey AS profile_id, CASE s_nationkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS role, 'F' AS subject_kind, 'O' AS selected_kind")


@op("snapshot_role_join", f"WITH {UNIT.sql}, {ROLE.sql} SELECT unit_id, 'SUBJECT_KIND' AS error FROM un JOIN ro USING (profile_id, role) WHERE un.subject_kind <> ro.subject_kind UNION ALL SELECT unit_id, 'SELECTED_KIND' FROM un JOIN ro USING (profile_id, role) WHERE decision = 'selected' AND un.selected_kind <> ro.selected_kind")
def _(spark, sf):
    return bindings.snapshot_role_join(UNIT(spark, sf), ROLE(spark, sf))


# ---- registers
NTH = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT)"
MEMBER = View("mb", "lineitem", f"""l_orderkey AS set_id, 'u' || CAST(l_orderkey AS STRING) || '.' || CAST({NTH} AS STRING) AS unit_id, CAST(l_partkey % 50 AS STRING) AS member_key, {NTH} + CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END AS ordinal, CASE WHEN l_linenumber > 3 THEN 'p2' END AS page_key, CAST(NULL AS STRING) AS shard_key, {NTH} = 1 AS continuation_expected,
 l_tax < 0.08 AS decided, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS outcome, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'timeout' END AS reason_code, l_quantity > 10 AS continuation_closed, l_discount > 0.01 AS received, l_discount > 0.02 AS produced""")


def _members(spark, sf):
    return MEMBER(spark, sf).withColumns({x + "_id": F.concat(F.lit(x[0]), F.substring("unit_id", 2, 60)) for x in ("decision", "receipt", "artifact")})


def _documents(spark, sf):
    m = _members(spark, sf)
    won = F.col("decided") & (F.col("outcome") == "success")
    pick = lambda cond, *cols: F.collect_list(F.when(cond, F.struct(*cols)))
    d = m.groupBy("set_id").agg(
        F.collect_list(F.struct("unit_id", "member_key", "ordinal", "page_key", "shard_key", "continuation_expected")).alias("members"), pick(F.col("decided"), "decision_id", "unit_id", "outcome", "reason_code", "continuation_closed").alias("decisions"),
        pick(won & F.col("received"), "receipt_id", "decision_id", "unit_id").alias("receipts"), pick(won & F.col("produced"), "artifact_id", "decision_id", "receipt_id").alias("outputs"),
    )
    odd = F.col("set_id") % 9 == 0
    return d.withColumns({"expected_count": F.size("members") + F.when(F.col("set_id") % 10 == 0, 1).otherwise(0), "member_set_hash": F.when(odd, "0").otherwise(registers.member_set_hash(F.col("members")))})


@op("response_set_closure", f"""WITH {MEMBER.sql}, g AS (SELECT set_id, count(*) AS n, count(DISTINCT member_key) AS keys, max(ordinal) AS top, min(ordinal) AS low, count(DISTINCT ordinal) AS ords, bool_or(NOT decided) AS und, bool_or(decided AND outcome = 'failed' AND reason_code IS NULL) AS rm,
 bool_or(decided AND outcome = 'success' AND NOT received) AS nr, bool_or(decided AND outcome = 'success' AND NOT produced) AS np, bool_or(decided AND continuation_expected AND NOT continuation_closed) AS co FROM mb GROUP BY 1)
SELECT set_id, 'MEMBER_COUNT' AS error FROM g WHERE set_id % 10 = 0 UNION ALL SELECT set_id, 'MEMBER_NOT_UNIQUE' FROM g WHERE keys < n OR ords < n UNION ALL SELECT set_id, 'ORDINALS' FROM g WHERE top <> n OR low <> 1 OR ords <> n UNION ALL SELECT set_id, 'MEMBER_HASH' FROM g WHERE set_id % 9 = 0
UNION ALL SELECT set_id, 'MEMBER_UNDECIDED' FROM g WHERE und UNION ALL SELECT set_id, 'REASON_MISSING' FROM g WHERE rm UNION ALL SELECT set_id, 'RECEIPT_MISSING' FROM g WHERE nr UNION ALL SELECT set_id, 'OUTPUT_MISSING' FROM g WHERE np UNION ALL SELECT set_id, 'CONTINUATION_OPEN' FROM g WHERE co""")
def _(spark, sf):
    return registers.response_set_closure(_documents(spark, sf))


LINE = "unit_id || '|' || lower(hex(encode(member_key))) || '|' || CAST(ordinal AS VARCHAR) || '|' || coalesce(lower(hex(encode(page_key))), '-') || '|-|' || CASE WHEN continuation_expected THEN '1' ELSE '0' END"


@op("response_set_closure_sql", f"""WITH {MEMBER.sql}, g AS (SELECT set_id, count(*) AS units, count(*) FILTER (WHERE decided) AS decisions, count(*) FILTER (WHERE decided AND outcome = 'success') AS successes, count(*) FILTER (WHERE decided AND continuation_expected AND NOT continuation_closed) AS open,
 count(*) FILTER (WHERE decided AND outcome = 'success' AND produced) AS outputs, sha256(string_agg({LINE}, chr(10) ORDER BY ordinal, {LINE})) AS h FROM mb GROUP BY 1)
SELECT set_id, units, decisions, successes, open, outputs, h AS own_hash, decisions = units AND outputs = successes AND open = 0 AND units >= 1 AND units <= 6 AS closed FROM g""")
def _(spark, sf):
    m = _members(spark, sf)
    d = _documents(spark, sf)
    head = d.select("set_id", F.size("members").alias("expected_count"), registers.member_set_hash(F.col("members")).alias("member_set_hash"), F.lit(1).alias("minimum_members"), F.lit(6).alias("maximum_members"))
    out = registers.response_set_closure_sql(head, m, m.where("decided").select("unit_id", "outcome", "continuation_closed"), m.where("decided and outcome = 'success' and produced").select("set_id"))
    return out.join(head.select("set_id", F.col("member_set_hash").alias("own_hash")), "set_id")


CLOSE = View("cs", "orders", "o_orderkey AS set_id, CASE WHEN o_orderstatus <> 'P' THEN DAYS(o_orderdate, 60;) END AS closed_at, o_orderdate AS invoked_at, CASE WHEN o_orderkey % 8 <> 0 THEN DAYS(o_orderdate, o_orderkey % 7 - 5;) END AS plan_available_at")
LATE = View("la", "lineitem", "l_orderkey AS set_id, l_linenumber AS row_id, l_shipdate AS arrived_at")


@op("response_append_after_close", f"WITH {CLOSE.sql}, {LATE.sql} SELECT set_id, row_id, 'APPEND_AFTER_CLOSE' AS error FROM la JOIN cs USING (set_id) WHERE arrived_at >= closed_at UNION ALL SELECT set_id, NULL, 'PLAN_NOT_FROZEN' FROM cs WHERE plan_available_at IS NULL OR plan_available_at > invoked_at")
def _(spark, sf):
    return registers.append_after_close(CLOSE(spark, sf), LATE(spark, sf))


TYPE = View("ty", "supplier", "s_suppkey AS event_type, CASE WHEN s_suppkey % 2 = 0 THEN 'exclusive_transition' ELSE 'append' END AS semantics, s_nationkey % 3 AS aggregate_kind")
STAT = View("sa", "lineitem WHERE l_suppkey % 2 = 0 OR l_tax > 0.07", "l_suppkey AS event_type, l_orderkey % 59 = 0 AND l_quantity > 25 AS is_initial")
TRAN = View("tr", "lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0", "l_suppkey AS event_type")
ALIA = View("al", "lineitem WHERE l_suppkey % 5 <> 0", "l_suppkey AS event_type")


@op("event_type_closure", f"""WITH {TYPE.sql}, {STAT.sql}, {TRAN.sql}, {ALIA.sql}, j AS (SELECT ty.*, (SELECT count(*) FROM sa WHERE sa.event_type = ty.event_type) AS s, (SELECT count(*) FILTER (WHERE is_initial) FROM sa WHERE sa.event_type = ty.event_type) AS i, (SELECT count(*) FROM tr WHERE tr.event_type = ty.event_type) AS t, (SELECT count(*) FROM al WHERE al.event_type = ty.event_type) AS a FROM ty)
SELECT event_type, 'REGISTRY_OPEN' AS error FROM j WHERE semantics = 'exclusive_transition' AND (s = 0 OR i <> 1 OR t = 0) UNION ALL SELECT event_type, 'CHILDREN_OF_OPEN_TYPE' FROM j WHERE semantics <> 'exclusive_transition' AND (s > 0 OR t > 0) UNION ALL SELECT event_type, 'ALIAS_MISSING' FROM j WHERE a = 0""")
def _(spark, sf):
    return registers.event_type_closure(TYPE(spark, sf), STAT(spark, sf), TRAN(spark, sf), ALIA(spark, sf))


REGE = View("re", "lineitem", "l_orderkey * 10 + l_linenumber AS event_id, l_suppkey AS event_type, CAST(l_partkey % 3 AS INT) AS aggregate_kind, CASE WHEN l_linenumber > 1 THEN 'open' END AS from_state, CASE WHEN l_returnflag = 'R' THEN 'open' END AS to_state")
REGI = View("ri", "lineitem WHERE l_linenumber <> 6", "l_orderkey * 10 + l_linenumber AS event_id, CASE WHEN l_partkey % 17 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS event_type")


@op("event_registry_audit", f"""WITH {TYPE.sql}, {REGE.sql}, {REGI.sql}, z AS (SELECT re.event_id, CASE WHEN semantics IS NULL THEN 'TYPE_UNKNOWN' WHEN ri.event_type IS DISTINCT FROM re.event_type THEN 'IDENTITY_MISMATCH' WHEN re.aggregate_kind <> ty.aggregate_kind THEN 'AGGREGATE_KIND'
 WHEN semantics = 'append' AND (from_state IS NOT NULL OR to_state IS NOT NULL) THEN 'MACHINE_FIELDS' END AS error FROM re LEFT JOIN ty ON ty.event_type = re.event_type LEFT JOIN ri ON ri.event_id = re.event_id) SELECT * FROM z WHERE error IS NOT NULL""")
def _(spark, sf):
    return registers.event_registry_audit(REGE(spark, sf), TYPE(spark, sf), REGI(spark, sf))


ARTI = View("ar", "orders", """o_orderkey AS artifact_id, CASE o_orderkey % 4 WHEN 0 THEN 'full_bytes' WHEN 1 THEN 'licensed_excerpt' WHEN 2 THEN 'metadata_only' ELSE 'external_pointer' END AS storage_mode, CASE WHEN o_orderkey % 4 < 2 THEN CAST(1 AS BIGINT) END AS blob_id,
 CASE WHEN o_orderkey % 4 < 2 THEN o_orderstatus END AS content_checksum, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 40 = 0 THEN 'e' END AS excerpt_text, CASE WHEN o_orderkey % 4 < 2 THEN 'p' END AS preservation_id, CASE WHEN o_orderkey % 4 = 3 THEN 'x://' END AS external_uri,
 CASE WHEN o_orderkey % 4 = 2 AND o_custkey % 5 <> 0 THEN 'm' END AS metadata_checksum, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 4 ELSE o_orderkey END AS derived_from""")
BIND = View("bi", "lineitem WHERE l_orderkey % 4 < 2 OR l_tax > 0.07", "l_orderkey AS artifact_id, CAST(l_linenumber AS BIGINT) AS blob_id, CASE WHEN l_linenumber = 1 OR l_quantity > 45 THEN 'active' ELSE 'retired' END AS binding_state")


@op("artifact_mode_audit", f"""WITH {ARTI.sql}, {BIND.sql}, b AS (SELECT artifact_id, count(*) AS n, min(blob_id) AS mb FROM bi WHERE binding_state = 'active' GROUP BY 1), j AS (SELECT ar.*, coalesce(n, 0) AS n, mb FROM ar LEFT JOIN b USING (artifact_id))
SELECT artifact_id, 'COLUMNS' AS error FROM j WHERE (storage_mode = 'full_bytes' AND excerpt_text IS NOT NULL) OR (storage_mode = 'metadata_only' AND metadata_checksum IS NULL) UNION ALL SELECT artifact_id, 'BINDING_NOT_ONE' FROM j WHERE storage_mode IN ('full_bytes', 'licensed_excerpt') AND (n <> 1 OR mb <> blob_id) UNION ALL SELECT artifact_id, 'BINDING_UNWANTED' FROM j WHERE storage_mode NOT IN ('full_bytes', 'licensed_excerpt') AND n <> 0""")
def _(spark, sf):
    return registers.artifact_mode_audit(ARTI(spark, sf), BIND(spark, sf))


MIGR = View("mi", "orders", "o_orderkey AS source_id, o_orderkey + CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 4 ELSE 0 END AS derivative_id, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS source_checksum")


@op("migration_provenance", f"WITH {ARTI.sql}, {MIGR.sql} SELECT source_id, derivative_id FROM mi LEFT JOIN ar s ON s.artifact_id = source_id LEFT JOIN ar d ON d.artifact_id = derivative_id WHERE s.content_checksum IS NULL OR s.content_checksum <> source_checksum OR d.artifact_id IS NULL OR d.derived_from <> source_id")
def _(spark, sf):
    return registers.migration_provenance(MIGR(spark, sf), ARTI(spark, sf))


PARE, CHIL = View("pa", "orders", "o_orderkey AS parent_id, CASE WHEN o_orderstatus = 'P' THEN 'A' ELSE 'R' END AS declared_kind"), View("ch", "lineitem WHERE l_returnflag <> 'N'", "l_orderkey AS parent_id, l_returnflag AS kind")


@op("content_closure", f"WITH {PARE.sql}, {CHIL.sql}, c AS (SELECT parent_id, count(*) AS n, min(kind) AS k FROM ch GROUP BY 1), z AS (SELECT parent_id, CASE WHEN coalesce(n, 0) <> 1 THEN 'CHILD_COUNT' WHEN k <> declared_kind THEN 'CHILD_KIND' END AS error FROM pa LEFT JOIN c USING (parent_id)) SELECT * FROM z WHERE error IS NOT NULL")
def _(spark, sf):
    return registers.content_closure(PARE(spark, sf), CHIL(spark, sf))


ITEM, GENU, GAPS = View("it", "orders", "o_orderkey AS item_id, CASE WHEN o_custkey % 2 = 0 THEN 'unknown' ELSE 'news' END AS domain, CASE WHEN o_orderstatus = 'P' THEN 'press' ELSE 'unknown' END AS publisher_role, CASE WHEN o_orderkey % 3 = 0 THEN 'poor' ELSE 'qualified' END AS quality"), View("gu", "lineitem WHERE l_returnflag = 'R'", "l_orderkey AS item_id"), View("ga", "lineitem WHERE l_returnflag = 'A'", "l_orderkey AS item_id, l_linestatus = 'O' AS open")


@op("coverage_item_closure", f"WITH {ITEM.sql}, {GENU.sql}, {GAPS.sql}, n AS (SELECT item_id, count(*) AS c FROM (SELECT item_id FROM gu UNION ALL SELECT item_id FROM ga WHERE open) GROUP BY 1) SELECT item_id, coalesce(c, 0) AS terminals FROM it LEFT JOIN n USING (item_id) WHERE coalesce(c, 0) <> 1")
def _(spark, sf):
    return registers.coverage_item_closure(ITEM(spark, sf), GENU(spark, sf), GAPS(spark, sf))


REFE = View("rf", "lineitem", "l_orderkey * 10 + l_linenumber AS reference_id, l_orderkey AS plan_id, CASE WHEN l_linenumber % 2 = 0 THEN 'c' END AS citation_id, CASE WHEN l_linenumber % 2 = 1 OR l_tax > 0.07 THEN 'l' END AS listing_id, CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'O' END AS channel, CASE WHEN l_quantity > 10 THEN l_orderkey % 3 ELSE l_orderkey % 2 END AS locale")
PLAN = View("pl", "orders WHERE o_orderkey % 9 <> 0", "o_orderkey AS plan_id, o_orderstatus AS channel, o_orderkey % 3 AS locale")


@op("text_ref_binding", f"""WITH {REFE.sql}, {PLAN.sql}, z AS (SELECT reference_id, CASE WHEN (citation_id IS NULL) = (listing_id IS NULL) THEN 'NOT_EXACTLY_ONE' WHEN pl.plan_id IS NULL THEN 'PLAN_MISSING' WHEN rf.channel <> pl.channel AND rf.locale <> pl.locale THEN 'DIFFERS:channel,locale' WHEN rf.channel <> pl.channel THEN 'DIFFERS:channel' WHEN rf.locale <> pl.locale THEN 'DIFFERS:locale' END AS error FROM rf LEFT JOIN pl USING (plan_id)) SELECT * FROM z WHERE error IS NOT NULL""")
def _(spark, sf):
    return registers.text_ref_binding(REFE(spark, sf), PLAN(spark, sf), ["channel", "locale"])


ISOL = View("io", "events", "event_id AS member_id, CASE WHEN event_id % 6 = 0 THEN 'personal' ELSE 'global' END AS source_domain, CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS INT) ELSE CAST(event_id % 2 AS INT) END AS private_lineage, CAST(floor(value) AS INT) AS retention_seconds, event_type AS payload_kind")


@op("lineage_isolation", f"WITH {ISOL.sql} SELECT member_id, 'DOMAIN' AS error FROM io WHERE source_domain <> 'global' UNION ALL SELECT member_id, 'PRIVATE_LINEAGE' FROM io WHERE coalesce(private_lineage, 1) <> 0 UNION ALL SELECT member_id, 'RETENTION' FROM io WHERE retention_seconds < 1 OR retention_seconds > 300 UNION ALL SELECT member_id, 'PAYLOAD' FROM io WHERE payload_kind NOT IN ('click', 'view')")
def _(spark, sf):
    return registers.lineage_isolation(ISOL(spark, sf), ["click", "view"])


CATA, RESU = View("ca", "orders WHERE o_orderkey % 7 <> 0", "o_orderkey AS definition_id, CASE WHEN o_orderstatus = 'P' THEN 'excluded' ELSE 'included' END AS membership, CASE WHEN o_orderkey % 5 = 0 THEN 'P0' ELSE 'P1' END AS severity, o_custkey % 3 = 0 AS waivable"), View("rs", "lineitem", "l_orderkey AS definition_id, l_orderkey * 10 + l_linenumber AS waiver_id, CASE l_returnflag WHEN 'R' THEN 'not_applicable' WHEN 'A' THEN 'failed' ELSE 'passed' END AS result, l_linestatus = 'F' AS approved")


@op("result_membership", f"WITH {CATA.sql}, {RESU.sql}, z AS (SELECT definition_id, CASE WHEN membership IS NULL THEN 'NOT_IN_CATALOGUE' WHEN membership = 'excluded' AND result <> 'not_applicable' THEN 'EXCLUDED_RUN' WHEN membership = 'included' AND result = 'not_applicable' THEN 'INCLUDED_SKIPPED' END AS error FROM rs LEFT JOIN ca USING (definition_id)) SELECT * FROM z WHERE error IS NOT NULL")
def _(spark, sf):
    return registers.result_membership(RESU(spark, sf), CATA(spark, sf))


@op("waiver_rules", f"WITH {CATA.sql}, {RESU.sql}, z AS (SELECT waiver_id, CASE WHEN severity IS NULL THEN 'DEFINITION_MISSING' WHEN severity = 'P0' THEN 'P0_WAIVED' WHEN NOT waivable THEN 'NOT_WAIVABLE' WHEN NOT approved THEN 'NOT_APPROVED' END AS error FROM rs LEFT JOIN ca USING (definition_id)) SELECT * FROM z WHERE error IS NOT NULL")
def _(spark, sf):
    return registers.waiver_rules(RESU(spark, sf), CATA(spark, sf))


DEFI = View("df", "lineitem", "l_partkey AS definition_id, l_orderkey * 10 + l_linenumber AS revision, l_linenumber AS phase, l_returnflag AS severity, l_linestatus = 'F' AS blocking, 'v' || CAST(l_suppkey % 4 AS STRING) AS version, CASE WHEN l_tax > 0.07 THEN ' TRUE ' ELSE 'x > 1' END AS assertion")


@op("definition_strength", f"""WITH {DEFI.sql}, p AS (SELECT *, lag(phase) OVER w AS ph, lag(severity) OVER w AS se, lag(blocking) OVER w AS bl, lag(version) OVER w AS ve FROM df WINDOW w AS (PARTITION BY definition_id ORDER BY revision, phase, severity, blocking, version, assertion))
SELECT definition_id, revision, 'TAUTOLOGY' AS error FROM p WHERE assertion = ' TRUE ' UNION ALL SELECT definition_id, revision, 'PHASE_LATER' FROM p WHERE phase > ph UNION ALL SELECT definition_id, revision, 'SEVERITY_WEAKER' FROM p WHERE severity > se UNION ALL SELECT definition_id, revision, 'NO_LONGER_BLOCKING' FROM p WHERE bl AND NOT blocking UNION ALL SELECT definition_id, revision, 'VERSION_LOWER' FROM p WHERE version < ve""")
def _(spark, sf):
    return registers.definition_strength(DEFI(spark, sf))


GATE, GRES = View("gt", "orders", "o_orderkey AS gate_id, o_orderkey AS evaluation_id, o_orderkey % 5 AS stated_total, o_orderkey % 3 AS stated_unpassed, CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END AS verdict, o_orderkey % 5 AS run_count, CASE WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'closed' END AS status, CAST(o_orderkey % 4 AS INT) AS k"), View("gs", "lineitem", "l_orderkey AS gate_id, l_orderkey AS evaluation_id, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS result, l_tax < 0.08 AS terminal, CASE WHEN l_linenumber = 7 THEN 'blocked' ELSE 'done' END AS status, l_quantity > 35 AS selected, CASE WHEN l_quantity > 35 THEN l_partkey % 30 END AS output_id")


@op("gate_selection", f"WITH {GATE.sql}, {GRES.sql}, m AS (SELECT evaluation_id, count(*) AS p, count(*) FILTER (WHERE result = 'passed') AS g FROM gs WHERE selected GROUP BY 1), z AS (SELECT evaluation_id, CASE WHEN status = 'blocked' AND p > 0 THEN 'BLOCKED_SELECTS' WHEN status = 'closed' AND coalesce(p, 0) <> 1 THEN 'NOT_ONE' WHEN status = 'closed' AND g <> 1 THEN 'SELECTED_NOT_PASSED' END AS error FROM gt LEFT JOIN m USING (evaluation_id)) SELECT * FROM z WHERE error IS NOT NULL")
def _(spark, sf):
    return registers.gate_selection(GATE(spark, sf), GRES(spark, sf))


@op("evaluation_arm_closure", f"WITH {GATE.sql}, {GRES.sql}, r AS (SELECT evaluation_id, bool_or(NOT terminal) AS u, count(*) FILTER (WHERE selected) AS s, count(output_id) AS o, count(DISTINCT output_id) AS d FROM gs GROUP BY 1), j AS (SELECT evaluation_id AS arm_id, k, coalesce(u, false) AS u, coalesce(s, 0) AS s, coalesce(o, 0) AS o, coalesce(d, 0) AS d FROM gt LEFT JOIN r USING (evaluation_id)) SELECT arm_id, 'NOT_TERMINAL' AS error FROM j WHERE u UNION ALL SELECT arm_id, 'SELECTED_NOT_K' FROM j WHERE s <> k UNION ALL SELECT arm_id, 'OUTPUTS_NOT_K' FROM j WHERE o <> k UNION ALL SELECT arm_id, 'OUTPUT_REPEATED' FROM j WHERE o <> d")
def _(spark, sf):
    return registers.evaluation_arm_closure(GATE(spark, sf).withColumnRenamed("evaluation_id", "arm_id"), GRES(spark, sf).withColumnRenamed("evaluation_id", "arm_id"))


DETE, INVE = View("de", "lineitem", "l_orderkey AS d05_key, l_suppkey AS detector_id, 'v' || CAST(l_partkey % 3 AS STRING) AS detector_version_id"), View("iv", "lineitem WHERE l_suppkey % 13 <> 0", "l_suppkey AS detector_id, 'v' || CAST(l_partkey % 3 AS STRING) AS detector_version_id")


@op("detector_manifest", f"WITH {DETE.sql}, {INVE.sql}, n AS (SELECT de.*, EXISTS (SELECT 1 FROM iv WHERE iv.detector_id = de.detector_id AND iv.detector_version_id = de.detector_version_id) AS known, detector_version_id || '|' || CAST(detector_id AS VARCHAR) AS line FROM de) SELECT d05_key, count(*) AS entries, count(DISTINCT detector_version_id) AS versions, count(*) FILTER (WHERE NOT known) AS unlisted, sha256(string_agg(line, chr(10) ORDER BY line)) AS manifest_hash, count(DISTINCT detector_version_id) >= 2 AND bool_and(known) AS valid FROM n GROUP BY 1")
def _(spark, sf):
    return registers.detector_manifest(DETE(spark, sf), INVE(spark, sf))


FIND = View("fi", "lineitem", "l_orderkey AS item_id, CASE WHEN l_quantity > 45 THEN 'candidate' ELSE 'no-candidate' END AS decision")


@op("unknown_exploration", f"WITH {ITEM.sql}, {FIND.sql}, r AS (SELECT item_id, count(*) FILTER (WHERE decision = 'candidate') AS c FROM fi GROUP BY 1), z AS (SELECT item_id, CASE WHEN domain = 'unknown' AND publisher_role = 'unknown' AND quality = 'qualified' THEN CASE WHEN c IS NULL OR c > 0 THEN 'UNKNOWN_NOT_EXHAUSTED' END WHEN c > 0 THEN 'INELIGIBLE_CANDIDATE' END AS error FROM it LEFT JOIN r USING (item_id)) SELECT * FROM z WHERE error IS NOT NULL")
def _(spark, sf):
    return registers.unknown_exploration(ITEM(spark, sf), FIND(spark, sf))


ELIG = View("el", "lineitem WHERE l_returnflag = 'N'", "l_orderkey + CASE WHEN l_partkey % 31 = 0 THEN 100000000 ELSE 0 END AS item_id, l_linestatus = 'F' AS eligible, CASE WHEN l_tax > 0.06 THEN l_partkey END AS exploration_unit_id")


@op("exploration_eligibility", f"WITH {ITEM.sql}, {ELIG.sql}, d AS (SELECT item_id, count(*) AS n, bool_or(exploration_unit_id IS NOT NULL AND NOT eligible) AS early FROM el GROUP BY 1), j AS (SELECT item_id, it.domain IS NOT NULL AS listed, coalesce(n, 0) AS n, coalesce(early, false) AS early FROM it FULL JOIN d USING (item_id)) SELECT item_id, 'UNDECIDED' AS error FROM j WHERE n = 0 UNION ALL SELECT item_id, 'UNKNOWN_ITEM' FROM j WHERE NOT listed UNION ALL SELECT item_id, 'DECIDED_TWICE' FROM j WHERE n > 1 UNION ALL SELECT item_id, 'UNIT_BEFORE_ELIGIBILITY' FROM j WHERE early")
def _(spark, sf):
    return registers.exploration_eligibility(ITEM(spark, sf), ELIG(spark, sf))


# ---- plans
@op("schedule_reconcile", """WITH p AS (SELECT user_id AS plan_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1), r AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT plan_id, date_diff('day', a, b) + 1 AS expected, coalesce(n, 0) AS run, date_diff('day', a, b) + 1 - coalesce(n, 0) AS missed FROM p LEFT JOIN r ON user_id = plan_id""")
def _(spark, sf):
    day, e = F.date_trunc("day", "ts"), table(spark, sf, "events")
    plans = e.groupBy(F.col("user_id").alias("plan_id")).agg(F.min(day).alias("first_at"), F.max(day).alias("last_at"), F.lit(86400).alias("every_seconds"))
    return planning.schedule_reconcile(plans, e.where("event_type <> 'error'").select(F.col("user_id").alias("plan_id"), day.alias("slot_at")))


@op("nominal_windows_bj", """SELECT CAST(CAST(ts + INTERVAL 13 HOUR AS DATE) AS VARCHAR) AS day, CASE WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 8 AND 18 THEN 'evening' ELSE 'morning' END AS edition, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01 11:00:00' AND ts < TIMESTAMP '2024-01-31 11:00:00' GROUP BY 1, 2""")
def _(spark, sf):
    w = F.broadcast(planning.nominal_windows("2024-01-02", "2024-01-31", spark))  # two rows a day of a fixed range
    e = table(spark, sf, "events").select("ts")
    return e.join(w, (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).groupBy(F.col("day").cast("string").alias("day"), "edition").agg(F.count("*").alias("n"))


@op("reportable_arrivals", """SELECT CAST(o_orderkey AS VARCHAR) AS arrival_id, 'item' AS kind, o_orderdate AS arrived_at FROM orders UNION ALL SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 'version', l_shipdate FROM lineitem UNION ALL SELECT CAST(event_id AS VARCHAR), 'decision', ts FROM events WHERE event_type <> 'error'""")
def _(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("first_seen_at"))
    versions = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version_id"), F.col("l_shipdate").alias("observed_at"))
    return planning.reportable_arrivals(seen, versions, table(spark, sf, "events").select(F.col("event_id").alias("decision_id"), F.when(F.col("event_type") != "error", F.col("ts")).alias("available_at")))


FLOORS = ((3, {"l_returnflag": 2, "l_suppkey": 2}), (5, {"l_returnflag": 2, "l_suppkey": 4, "l_linestatus": 2, "l_shipmode": 3, "l_partkey": 5}), (7, {"l_returnflag": 3, "l_suppkey": 6, "l_linestatus": 2, "l_shipmode": 4, "l_partkey": 7}))
DIVERSE = list(FLOORS[-1][1])


@op("display_diversity", f"""WITH l AS (SELECT l_orderkey, l_returnflag, l_suppkey, l_linestatus, l_partkey, 'm' || (l_partkey % 5) AS l_shipmode FROM lineitem), g AS (SELECT l_orderkey AS surface, count(*) AS size, {", ".join(f"count(DISTINCT {c}) AS {c}" for c in DIVERSE)} FROM l GROUP BY 1)
SELECT *, CASE {" ".join(f"WHEN size >= {n} THEN concat_ws(',', " + ", ".join(f"CASE WHEN {c} < {k} THEN '{c}' END" for c, k in floors.items()) + ")" for n, floors in reversed(FLOORS))} ELSE '' END AS short FROM g""")
def _(spark, sf):
    """Five floors, by the size of the list."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("surface"), "l_returnflag", "l_suppkey", "l_linestatus", "l_partkey", F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string")).alias("l_shipmode"))
    return planning.display_diversity(l, "surface", DIVERSE, list(FLOORS))


@op("coverage_floor_greedy", """WITH d AS (SELECT o_custkey % 20 AS stratum, (count(*) + o_custkey % 20)::DOUBLE AS target, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS debt FROM orders GROUP BY 1), c AS (SELECT o_orderkey AS candidate_id, o_custkey % 20 AS stratum, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
SELECT candidate_id, stratum, nth, round((debt - (nth - 1)) / target, 9) AS level FROM c JOIN d USING (stratum) WHERE debt - (nth - 1) > 0 ORDER BY (debt - (nth - 1)) / target DESC, stratum, nth LIMIT 40""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("stratum", F.col("o_custkey") % 20)
    debts = o.groupBy("stratum").agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("debt"), (F.count("*") + F.col("stratum")).cast("double").alias("target"))
    got = planning.coverage_floor_greedy(o.select(F.col("o_orderkey").alias("candidate_id"), "stratum", F.col("o_orderdate").alias("input_order")), debts, 40)
    return got.select("candidate_id", "stratum", F.col("nth").cast("long").alias("nth"), F.round("level", 9).alias("level"))


def _fronts(n: int) -> str:
    out = "f0 AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)"
    for i in range(1, n + 1):
        out += f", u{i} AS (SELECT * FROM f{i - 1} x WHERE NOT EXISTS (SELECT 1 FROM f{i - 1} y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))), f{i} AS (SELECT * FROM f{i - 1} WHERE p_partkey NOT IN (SELECT p_partkey FROM u{i}))"
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT p_partkey, {i} AS front FROM u{i}" for i in range(1, n + 1))


@op("pareto_fronts", _fronts(3))
def _(spark, sf):
    return planning.pareto_fronts(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice", 3)


@op("account_frame_coverage", "SELECT event_type, count(DISTINCT user_id)::DOUBLE / (SELECT count(*) FROM customer) AS coverage FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def _(spark, sf):
    frame = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    seen = table(spark, sf, "events").join(frame, "user_id", "left_semi").groupBy("event_type").agg(F.count_distinct("user_id").alias("seen"))
    return seen.crossJoin(F.broadcast(frame.agg(F.count("*").alias("n")))).select("event_type", (F.col("seen") / F.col("n")).alias("coverage"))  # one row


@op("edition_status", "SELECT l_orderkey AS edition, CASE WHEN count(*) < 2 THEN 'failed' WHEN max(date_diff('day', o_orderdate, l_shipdate)) <= 60 AND count(DISTINCT l_suppkey) >= 3 THEN 'normal' ELSE 'degraded' END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf):
    """Lines are counted per order before they meet it; an order that stands twice counts its lines twice."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("shipped")).repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.max("shipped").alias("shipped"))
    lines = lines.groupBy("l_orderkey").agg(F.sum("n").alias("lines"), F.max("shipped").alias("shipped"), F.count("l_suppkey").alias("sources"))
    orders = table(spark, sf, "orders").groupBy("o_orderkey").agg(F.count("*").alias("times"), F.min(F.to_date("o_orderdate")).alias("ordered"))
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.select(F.col("l_orderkey").alias("edition"), (F.col("lines") * F.col("times")).alias("n"), F.datediff("shipped", "ordered").alias("lag"), "sources")
    return g.select("edition", F.when(F.col("n") < 2, "failed").when((F.col("lag") <= 60) & (F.col("sources") >= 3), "normal").otherwise("degraded").alias("status"))


@op("comparison_watermark", "SELECT CASE WHEN count(f) >= 5 THEN min(f) END AS watermark FROM (SELECT event_type, max(ts) AS f FROM events GROUP BY 1)")
def _(spark, sf):
    return measures.comparison_watermark(table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("frontier")), 5)


@op("ledger_chain", """WITH h AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN 'x' ELSE lag(md5(CAST(event_id AS VARCHAR))) OVER w END AS p, lag(md5(CAST(event_id AS VARCHAR))) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, 'CHAIN_BROKEN' AS error FROM h WHERE p IS DISTINCT FROM b UNION ALL SELECT user_id, event_id, 'ANCHOR_MISSING' FROM events WHERE event_id % 41 = 0 UNION ALL SELECT user_id, event_id, 'ANCHOR_LATE' FROM events WHERE event_id % 41 > 0 AND (event_id % 320 > 300 OR event_id % 97 = 1)""")
def _(spark, sf):
    k = F.col("event_id")
    own = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("at"), F.md5(k.cast("string").cast("binary")).alias("hash"), F.when(k % 41 > 0, F.timestamp_seconds(F.unix_timestamp("ts") + F.when(k % 97 == 1, -5).otherwise(k % 320))).alias("anchored_at"))
    chained = own.withColumn("previous_hash", F.when(k % 50 == 0, "x").otherwise(F.lag("hash").over(Window.partitionBy("user_id").orderBy("event_id"))))
    return measures.ledger_chain(chained, "user_id", "event_id")


CATL = View("ct", "supplier", "s_suppkey AS catalogue_id, s_nationkey % 3 <> 0 AS signed, CAST(s_suppkey % 8 AS INT) AS target_phase, CASE WHEN s_suppkey % 5 = 0 THEN 'q' ELSE 'p' END AS policy, CAST('0' AS STRING) AS stated_hash")
REQD = View("rq", "lineitem WHERE l_suppkey % 3 <> 0 OR l_partkey % 2 = 0", "l_suppkey AS catalogue_id, l_partkey AS definition_id")
OUTC = View("oc", "lineitem WHERE l_suppkey % 4 <> 0", "l_suppkey AS catalogue_id, l_partkey AS definition_id, CASE WHEN l_suppkey % 7 = 1 THEN 'pass' ELSE CASE l_linenumber WHEN 1 THEN 'fail' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'odd' ELSE 'pass' END END AS result")


@op("phase_gate", f"""WITH {CATL.sql}, {REQD.sql}, {OUTC.sql}, w AS (SELECT DISTINCT catalogue_id, definition_id FROM rq), j AS (SELECT coalesce(w.catalogue_id, oc.catalogue_id) AS catalogue_id, w.definition_id IS NOT NULL AS wanted, oc.definition_id IS NOT NULL AS seen, result FROM w FULL JOIN oc ON w.catalogue_id = oc.catalogue_id AND w.definition_id = oc.definition_id),
g AS (SELECT catalogue_id, count(*) FILTER (WHERE wanted) AS required, count(*) FILTER (WHERE seen) AS observed, count(*) FILTER (WHERE NOT seen) AS missing, count(*) FILTER (WHERE wanted AND result = 'fail') AS failed, count(*) FILTER (WHERE wanted AND result = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE NOT wanted) AS unknown, count(*) FILTER (WHERE result = 'odd') AS invalid FROM j GROUP BY 1),
h AS (SELECT ct.catalogue_id, signed, coalesce(required, 0) AS required, coalesce(observed, 0) AS observed, coalesce(missing, 0) AS missing, coalesce(failed, 0) AS failed, coalesce(not_applicable, 0) AS not_applicable, coalesce(unknown, 0) AS unknown, coalesce(invalid, 0) AS invalid FROM ct LEFT JOIN g USING (catalogue_id))
SELECT * EXCLUDE (signed), CASE WHEN NOT signed THEN 'CATALOG_SIGNATURE_UNVERIFIED' WHEN missing + failed + not_applicable + unknown + invalid = 0 THEN 'PHASE_EXIT_PASSED' ELSE concat_ws(',', CASE WHEN missing > 0 THEN 'CATALOG_INCOMPLETE' END, CASE WHEN unknown > 0 THEN 'RESULT_ID_OUT_OF_SCOPE' END, CASE WHEN invalid > 0 THEN 'RESULT_STATUS_INVALID' END, CASE WHEN failed + not_applicable > 0 THEN 'PHASE_EXIT_BLOCKED' END) END AS reason_codes,
CASE WHEN signed AND missing + failed + not_applicable + unknown + invalid = 0 THEN 'pass' ELSE 'blocked' END AS decision FROM h""")
def _(spark, sf):
    return registers.gate_report(CATL(spark, sf), REQD(spark, sf), OUTC(spark, sf))


VERS = View("vs", "orders", "o_custkey % 10 + 1 AS catalogue_id, o_custkey AS test_id, o_orderkey AS revision, o_orderkey AS definition_id, CAST(o_orderkey % 5 AS INT) AS phase, CASE WHEN o_orderstatus = 'P' THEN 'P0' ELSE 'P1' END AS severity, CASE WHEN o_orderkey % 997 = 0 THEN 'q' ELSE 'p' END AS policy")
CMEM = View("cm", "orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 10 = 3", "o_custkey % 10 + 1 AS catalogue_id, o_orderkey AS definition_id, CASE WHEN o_orderkey % 11 = 0 THEN 'excluded' ELSE 'applicable' END AS membership")


@op("catalog_closure", f"""WITH {CATL.sql}, {VERS.sql}, {CMEM.sql}, l AS (SELECT catalogue_id, test_id, max(revision) AS definition_id, arg_max(phase, revision) AS phase FROM vs GROUP BY 1, 2), due AS (SELECT l.catalogue_id, l.definition_id FROM l JOIN ct USING (catalogue_id) WHERE phase <= target_phase),
e AS (SELECT catalogue_id, count(*) AS n FROM due GROUP BY 1), m AS (SELECT cm.catalogue_id, count(*) AS n, count(*) FILTER (WHERE membership = 'excluded' AND severity = 'P0') AS p0, count(*) FILTER (WHERE vs.policy <> ct.policy) AS pd FROM cm JOIN ct USING (catalogue_id) LEFT JOIN vs ON vs.definition_id = cm.definition_id GROUP BY 1),
x AS (SELECT catalogue_id, count(*) AS n FROM ((SELECT * FROM due EXCEPT SELECT catalogue_id, definition_id FROM cm) UNION ALL (SELECT catalogue_id, definition_id FROM cm EXCEPT SELECT * FROM due)) GROUP BY 1)
SELECT ct.catalogue_id, coalesce(e.n, 0) AS expected, coalesce(m.n, 0) AS members, coalesce(p0, 0) AS p0_excluded, coalesce(pd, 0) AS policy_differs, coalesce(x.n, 0) AS set_differs, false AS closed FROM ct LEFT JOIN e USING (catalogue_id) LEFT JOIN m USING (catalogue_id) LEFT JOIN x USING (catalogue_id)""")
def _(spark, sf):
    return registers.catalog_closure(CATL(spark, sf), VERS(spark, sf), CMEM(spark, sf))


@op("action_stage", "WITH g AS (SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY 1), z AS (SELECT *, CASE WHEN c <= b THEN 'ATTENTION_NOT_INCREASED' WHEN user_id % 4 = 0 THEN 'ACTION_STAGE_CHANGED' WHEN user_id % 3 = 0 THEN 'MISSING_EVIDENCE_NOT_NAMED' END AS error FROM g) SELECT user_id, error, c - b AS attention_delta, CASE WHEN error IS NULL THEN 'attention_without_action' END AS interpretation FROM z")
def _(spark, sf):
    late, e = F.col("ts") >= ts("2024-01-16"), table(spark, sf, "events")
    stage, named = F.when(F.col("user_id") % 4 == 0, "acting").otherwise("talk"), F.when(F.col("user_id") % 3 != 0, F.array(F.lit("filing")))
    b = e.groupBy("user_id").agg(F.count_if(~late).alias("mentions"), F.lit("talk").alias("stage"))
    c = e.groupBy("user_id").agg(F.count_if(late).alias("mentions"), stage.alias("stage"), named.alias("missing_evidence"))
    return rules.action_stage(b, c, "user_id").select("user_id", "error", "attention_delta", "interpretation")


@op("confidence_passthrough", "SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN 'OBSERVATION_CONFIDENCE_MISSING' WHEN quality IS NULL THEN 'EVIDENCE_CONFIDENCE_MISSING' END AS error, n_chars AS magnitude, source AS allocation FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rules.confidence_passthrough(d.select("doc_id", F.col("lang").alias("observation_confidence"), F.col("quality").alias("evidence_confidence"), F.col("n_chars").alias("magnitude"), F.col("source").alias("allocation"))).select("doc_id", "error", "magnitude", "allocation")


@op("raw_evidence_visible", "SELECT doc_id, title, source, published_at, license_scope, evidence, coverage_boundary, CAST(NULL AS VARCHAR) AS ai_judgment FROM (SELECT doc_id, substring(text, 1, 80) AS title, source, n_chars AS published_at, lang AS license_scope, 'doc://' || CAST(doc_id AS VARCHAR) AS evidence, source AS coverage_boundary FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"), "source", F.col("n_chars").alias("published_at"), F.col("lang").alias("license_scope"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("evidence"), F.col("source").alias("coverage_boundary"), F.lit("model says").alias("ai_judgment"))
    return rules.raw_evidence_visible(d)


@op("model_retire", "WITH g AS (SELECT l_orderkey AS model, list_sort(list(CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'R')) AS o, count(*) FILTER (WHERE l_returnflag = 'A') AS e FROM lineitem GROUP BY 1), z AS (SELECT model, concat_ws(',', CASE WHEN model % 10 = 0 THEN 'config_hash' END, CASE WHEN o IS NULL THEN 'output_artifact_ids' END, CASE WHEN e = 0 THEN 'evidence_ids' END) AS missing FROM g) SELECT model, missing, CASE WHEN missing = '' THEN 'retired' ELSE 'live' END AS status, missing <> '' AS recompute_required FROM z")
def _(spark, sf):
    pick = lambda flag: F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_partkey").cast("string")))
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model")).agg(pick("R").alias("output_artifact_ids"), pick("A").alias("evidence_ids"))
    m = m.withColumns({"model_id": F.col("model").cast("string"), "config_hash": F.when(F.col("model") % 10 != 0, "c"), "input_manifest": F.array(F.lit("in")), "status": F.lit("live"), "recompute_required": F.lit(True)})
    return rules.model_retire(m).select("model", F.array_join("missing_fields", ",").alias("missing"), "status", "recompute_required")


TIMES = (  # Java's pattern for a midnight in UTC, hours that its zone or clock adds
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", 0), ("'Tue, 'dd MMM yyyy HH:mm:ss' +0800'", -8), ("yyyy-MM-dd HH:mm:ss", 0), ("'no date'", None), ("'Wed, 'd MMM yy HH:mm' GMT'", 0), ("d'th 'MMMM yyyy', 5:07 pm EST'", None),
    ("MMMM d', 'yyyy' 12:00 PM'", 12), ("yyyyMMdd'T140000-0130'", None), ("yyyy/M/d", 0), ("yyyy-MM-dd'T'HH:mm:ss.SSS'-05:00'", 5), ("yyyy'-02-30T00:00:00Z'", None), ("d-MMM-yyyy HH:mm:ss' PDT'", 7),
)
SHIFTS = {5: "INTERVAL 1327 MINUTE", 7: "INTERVAL 930 MINUTE"}


@op("time_parse", f"""SELECT o_orderkey, CASE o_orderkey % {len(TIMES)} {" ".join(f"WHEN {k} THEN o_orderdate + {SHIFTS.get(k, f'to_hours({h})')}" for k, (_, h) in enumerate(TIMES) if h is not None or k in SHIFTS)} END AS at FROM orders""")
def _(spark, sf):
    text = F.lit(None).cast("string")
    for k, (pattern, _) in enumerate(TIMES):
        text = F.when(F.col("o_orderkey") % len(TIMES) == k, F.date_format("o_orderdate", pattern)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", time_parse(text).alias("at"))


@op("source_upsert", "SELECT l_suppkey, arg_max(l_returnflag, l_orderkey * 10000000 + l_partkey) AS language, arg_max(l_linestatus, l_orderkey * 10000000 + l_partkey) AS region, count(*) AS arrivals FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10000000 + F.col("l_partkey")).alias("n"), F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("region"))
    return feeds.item_upsert(rows, "n", "l_suppkey", [], ["language", "region"])

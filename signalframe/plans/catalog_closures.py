"""Queries of closures over catalogues, profiles and registries; their stand-in rows break each rule somewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalframe.operators import closure, registers
from signalframe.plans.catalog import op
from signalframe.plans.catalog_audits import LEGAL, log
from signalframe.plans.catalog_rules import View
from signalframe.plans.views import table
from signalframe.scratch import shared_dir
from signalframe.sources import feeds


def view(name: str, source: str, columns: str, **differing: tuple[str, str]) -> View:
    """A View whose <named> parts are spelt (Spark, DuckDB)."""
    both = View(name, source, columns)
    for part, (spark, duck) in differing.items():
        both.spark, both.sql = both.spark.replace(f"<{part}>", spark), both.sql.replace(f"<{part}>", duck)
    return both


def long_form(counters: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT snapshot_id, '{k}' AS k, count(*) AS n FROM {rows} GROUP BY 1" for k, rows in counters.items())


# ---- snapshots: a customer is a snapshot, its orders are units
SNAP = View("sn", "customer", "c_custkey AS snapshot_id, c_custkey % 7 AS profile_id")
UNIT = View("un", "orders", "o_orderkey AS unit_id, o_custkey AS snapshot_id, 'r' || CAST(o_orderkey % 2 AS STRING) AS member_role, CASE WHEN o_custkey % 5 = 1 AND o_orderkey % 4 = 0 THEN 'page' ELSE 'item' END AS subject_kind, o_orderkey AS subject_key")
DECI = View("de", "orders WHERE NOT (o_custkey % 11 = 3 AND o_orderkey % 3 = 0)", "o_orderkey AS unit_id, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'selected' END AS decision, CASE WHEN o_custkey % 13 = 4 THEN 'clip' ELSE 'version' END AS member_kind, o_orderkey + CASE WHEN o_custkey % 31 = 9 THEN 5 ELSE 0 END AS member_key")
MEMB = View("mb", "orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 17 <> 5 OR o_custkey % 19 = 6", "o_orderkey AS unit_id, 'version' AS member_kind, o_orderkey + CASE WHEN o_custkey % 23 = 7 THEN 1000000000 ELSE 0 END AS member_key")
UNIV = View("uv", "orders WHERE NOT (o_custkey % 29 = 8 AND o_orderkey % 2 = 0)", "o_custkey AS snapshot_id, 'r' || CAST(o_orderkey % 2 AS STRING) AS member_role, 'item' AS subject_kind, 'version' AS member_kind, o_orderkey AS member_key")
ROLE = View("rl", "orders WHERE o_custkey % 7 <> 5", "DISTINCT o_custkey % 7 AS profile_id, 'r' || CAST(o_orderkey % CASE WHEN o_custkey % 7 = 2 THEN 3 ELSE 2 END AS STRING) AS member_role, 'item' AS subject_kind, 'version' AS member_kind")
PARTS = [SNAP, UNIT, DECI, MEMB, UNIV, ROLE]
COUNTS = long_form({
    "missing_decisions": "un WHERE unit_id NOT IN (SELECT unit_id FROM de)",
    "selected_without_child": "un JOIN de USING (unit_id) WHERE decision = 'selected' AND unit_id NOT IN (SELECT unit_id FROM mb)",
    "child_without_selected": "un JOIN mb USING (unit_id) WHERE unit_id NOT IN (SELECT unit_id FROM de WHERE decision = 'selected')",
    "universe_missing": "(SELECT snapshot_id, member_role, subject_kind, member_key FROM uv EXCEPT SELECT snapshot_id, member_role, subject_kind, subject_key FROM un)",
    "universe_extra": "(SELECT snapshot_id, member_role, subject_kind, subject_key FROM un EXCEPT SELECT snapshot_id, member_role, subject_kind, member_key FROM uv)",
    "selected_unknown": "un JOIN mb USING (unit_id) WHERE NOT EXISTS (SELECT 1 FROM uv WHERE uv.snapshot_id = un.snapshot_id AND uv.member_role = un.member_role AND uv.member_kind = mb.member_kind AND uv.member_key = mb.member_key)",
    "invalid_subject_kind": "un JOIN sn USING (snapshot_id) JOIN rl USING (profile_id, member_role) WHERE un.subject_kind <> rl.subject_kind",
    "invalid_member_kind": "un JOIN sn USING (snapshot_id) JOIN rl USING (profile_id, member_role) JOIN de USING (unit_id) WHERE decision = 'selected' AND de.member_kind <> rl.member_kind",
    "profile_missing_role": "(SELECT snapshot_id, member_role FROM sn JOIN rl USING (profile_id) EXCEPT SELECT snapshot_id, member_role FROM un)",
    "profile_extra_role": "(SELECT snapshot_id, member_role FROM un EXCEPT SELECT snapshot_id, member_role FROM sn JOIN rl USING (profile_id))",
    "member_differs": "un JOIN mb USING (unit_id) LEFT JOIN de USING (unit_id) WHERE decision IS NULL OR decision <> 'selected' OR de.member_kind <> mb.member_kind OR de.member_key <> mb.member_key",
    "profile_roles": "sn JOIN rl USING (profile_id)",
    "snapshot_roles": "(SELECT DISTINCT snapshot_id, member_role FROM un)",
    "universe_roles": "(SELECT DISTINCT snapshot_id, member_role FROM uv)",
})
WIDE = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE k = '{c}'), 0) AS BIGINT) AS {c}" for c in closure.MEMBERSHIP_COUNTERS)
RIGHT = " AND ".join([*[f"{c} = 0" for c in closure.MEMBERSHIP_COUNTERS[:11]], "profile_roles > 0", "snapshot_roles = profile_roles", "universe_roles = profile_roles"])


@op("membership_closure", f"WITH {', '.join(v.sql for v in PARTS)}, c AS ({COUNTS}), w AS (SELECT snapshot_id, {WIDE} FROM sn LEFT JOIN c USING (snapshot_id) GROUP BY 1) SELECT *, {RIGHT} AS closed FROM w")
def _(spark, sf):
    return closure.membership_closure(*[v(spark, sf) for v in PARTS])


# ---- gates: a supplier is a catalogue, a run and a gate; its parts are the definitions
FAILED = "(l_suppkey + l_partkey) % 17 = 0 AND l_suppkey % 3 <> 0 AND NOT (l_suppkey % 10 = 4 AND l_partkey % 5 = 0)"
OPEN = f"CASE WHEN {FAILED} AND l_partkey % 4 <> 0 THEN l_partkey END"
STOPS = f"CASE WHEN {FAILED} AND l_partkey % 4 <> 0 AND l_partkey % 3 = l_suppkey % 2 THEN l_partkey END"
GATE = view(
    "gd", "lineitem GROUP BY l_suppkey",
    "l_suppkey AS gate_id, l_suppkey AS catalog_id, l_suppkey AS run_id, (l_suppkey + CASE WHEN l_suppkey % 10 = 9 THEN 1 ELSE 0 END) % 3 AS target_phase, CASE WHEN l_suppkey % 2 = 0 THEN 'phase-exit' ELSE 'merge' END AS target_gate, "
    f"count(DISTINCT CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END) + CASE WHEN l_suppkey % 10 = 1 THEN 1 ELSE 0 END AS required, count(DISTINCT {STOPS}) + CASE WHEN l_suppkey % 10 = 2 THEN 1 ELSE 0 END AS blocking_results, "
    f"CASE WHEN l_suppkey % 10 = 5 THEN ARR(CAST(0 AS BIGINT)) ELSE <ids> END AS unpassed, CASE WHEN (count(DISTINCT {STOPS}) = 0) <> (l_suppkey % 10 = 7) THEN 'pass' ELSE 'blocked' END AS decision",
    ids=(f"array_sort(collect_set({OPEN}))", f"coalesce(list_sort(list(DISTINCT {OPEN}) FILTER (WHERE {OPEN} IS NOT NULL)), CAST([] AS BIGINT[]))"),
)
CATA = View("ct", "supplier", "s_suppkey AS catalog_id, s_suppkey % 3 AS phase, CASE WHEN s_suppkey % 2 = 0 THEN 'phase-exit' ELSE 'merge' END AS gate")
MEMS = View("mb", "lineitem", "DISTINCT l_suppkey AS catalog_id, l_partkey AS definition_id, CASE WHEN l_partkey % 4 = 0 THEN 'excluded' ELSE 'applicable' END AS membership")
DEFS = View("df", "part", "p_partkey AS definition_id, CASE p_partkey % 3 WHEN 0 THEN 'phase-exit' WHEN 1 THEN 'merge' ELSE 'none' END AS blocking")
RESU = View("rs", "lineitem WHERE NOT (l_suppkey % 10 = 4 AND l_partkey % 5 = 0)", f"DISTINCT l_suppkey AS run_id, l_partkey AS definition_id, CASE WHEN {FAILED} THEN CASE WHEN l_partkey % 2 = 0 THEN 'fail' ELSE 'blocked' END ELSE 'pass' END AS result")
GATES = [GATE, CATA, MEMS, DEFS, RESU]


@op("gate_decision_closure", f"""WITH {', '.join(v.sql for v in GATES)}, h AS (SELECT gate_id, definition_id, blocking = target_gate AS stops FROM gd JOIN mb USING (catalog_id) JOIN rs USING (run_id, definition_id) LEFT JOIN df USING (definition_id) WHERE membership = 'applicable' AND result IN ('fail', 'blocked')),
j AS (SELECT gd.*, phase, gate, (SELECT count(*) FROM mb WHERE mb.catalog_id = gd.catalog_id) AS m, (SELECT count(*) FROM mb WHERE mb.catalog_id = gd.catalog_id AND membership = 'applicable') AS a, (SELECT count(*) FROM rs WHERE rs.run_id = gd.run_id) AS r,
(SELECT count(*) FROM h WHERE h.gate_id = gd.gate_id AND stops) AS b, (SELECT coalesce(list(definition_id ORDER BY definition_id), CAST([] AS BIGINT[])) FROM h WHERE h.gate_id = gd.gate_id) AS u FROM gd LEFT JOIN ct USING (catalog_id))
SELECT gate_id, 'TARGET' AS error FROM j WHERE phase IS NULL OR phase <> target_phase OR gate <> target_gate UNION ALL SELECT gate_id, 'RESULTS' FROM j WHERE m <> r UNION ALL SELECT gate_id, 'REQUIRED' FROM j WHERE required <> a
UNION ALL SELECT gate_id, 'BLOCKING' FROM j WHERE blocking_results <> b UNION ALL SELECT gate_id, 'UNPASSED' FROM j WHERE unpassed IS DISTINCT FROM u UNION ALL SELECT gate_id, 'VERDICT' FROM j WHERE (b = 0) <> (decision = 'pass')""")
def _(spark, sf):
    return registers.gate_decision_closure(*[v(spark, sf) for v in GATES])


# ---- evaluations: a customer is a unit, its orders are the attempts
OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'P' THEN 'blocked' ELSE 'fail' END"
UNITS = View("uu", "orders GROUP BY o_custkey", "o_custkey AS unit_id, count(*) + CASE WHEN o_custkey % 13 = 6 THEN 1 ELSE 0 END AS unit_runs, o_custkey % 10 AS catalog_id")
EVAL = view(
    "ev", "orders GROUP BY o_custkey",
    "o_custkey AS evaluation_id, o_custkey AS unit_id, count(*) + CASE WHEN o_custkey % 17 = 1 THEN 1 ELSE 0 END AS expected_runs, count(*) + CASE WHEN o_custkey % 19 = 2 THEN 1 ELSE 0 END AS observed_runs, "
    "CASE WHEN o_custkey % 23 = 4 THEN 'none' ELSE <hash> END AS result_set_hash, CASE WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN 'blocked' ELSE 'closed' END AS status",
    hash=(
        f"sha2(array_join(transform(array_sort(collect_list(struct(o_orderkey AS o, concat(CAST(o_orderkey AS STRING), '|', {OUTCOME}) AS l))), x -> x.l), '\\n'), 256)",
        f"sha256(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || {OUTCOME}, chr(10) ORDER BY o_orderkey))",
    ),
)
ATTE = View("ra", "orders", "o_custkey AS unit_id, o_orderkey AS run_id, o_orderkey AS attempt_ordinal")
DECD = View("dd", "orders WHERE o_custkey % 7 <> 3 OR o_orderkey % 2 = 0", f"o_orderkey AS run_id, (o_custkey + CASE WHEN o_custkey % 11 = 5 THEN 1 ELSE 0 END) % 10 AS catalog_id, {OUTCOME} AS decision")
EVALS = [EVAL, UNITS, ATTE, DECD]


@op("gate_evaluation_closure", f"""WITH {', '.join(v.sql for v in EVALS)}, t AS (SELECT unit_id, run_id, attempt_ordinal, decision FROM ra JOIN uu USING (unit_id) JOIN dd USING (run_id, catalog_id)),
j AS (SELECT ev.*, unit_runs, (SELECT count(*) FROM ra WHERE ra.unit_id = ev.unit_id) AS n, (SELECT count(*) FROM t WHERE t.unit_id = ev.unit_id) AS d, (SELECT count(*) FROM t WHERE t.unit_id = ev.unit_id AND decision = 'blocked') AS b,
(SELECT sha256(string_agg(CAST(run_id AS VARCHAR) || '|' || decision, chr(10) ORDER BY attempt_ordinal)) FROM t WHERE t.unit_id = ev.unit_id) AS h FROM ev LEFT JOIN uu USING (unit_id))
SELECT evaluation_id, 'EXPECTED' AS error FROM j WHERE expected_runs <> unit_runs UNION ALL SELECT evaluation_id, 'OBSERVED' FROM j WHERE observed_runs <> n UNION ALL SELECT evaluation_id, 'INCOMPLETE' FROM j WHERE unit_runs <> n
UNION ALL SELECT evaluation_id, 'NOT_TERMINAL' FROM j WHERE d <> n UNION ALL SELECT evaluation_id, 'HASH' FROM j WHERE h IS DISTINCT FROM result_set_hash UNION ALL SELECT evaluation_id, 'STATUS' FROM j WHERE status <> CASE WHEN b > 0 THEN 'blocked' ELSE 'closed' END""")
def _(spark, sf):
    return registers.gate_evaluation_closure(*[v(spark, sf) for v in EVALS])


# ---- state rows of events
TYPES = sorted({s for pair in LEGAL for s in pair})
STAT = View("st", "events WHERE event_id % 9 <> 4", "event_id")
MORE = View("mo", "events WHERE event_id % 15 = 7", "event_id")


@op("transition_rows", f"""WITH {STAT.sql}, {MORE.sql}, n AS (SELECT event_id, count(*) AS n FROM (SELECT * FROM st UNION ALL SELECT * FROM mo) GROUP BY 1), j AS (SELECT event_id, event_type IN ({', '.join(map(repr, TYPES))}) AS x, coalesce(n, 0) AS n FROM events LEFT JOIN n USING (event_id))
SELECT event_id, CASE WHEN x THEN 'NOT_ONE_STATE' ELSE 'STATE_NOT_ALLOWED' END AS error FROM j WHERE CASE WHEN x THEN n <> 1 ELSE n <> 0 END""")
def _(spark, sf):
    return closure.transition_rows(table(spark, sf, "events"), STAT(spark, sf).unionByName(MORE(spark, sf)), TYPES)


STATES = ["click", "view", "purchase", "signup"]


@op("transition_audit", f"""WITH lg AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, event_type AS to_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, user_id % 3 AS v, CASE WHEN user_id % 2 = 0 THEN 'order' ELSE 'visit' END AS t, CASE WHEN before IS NULL THEN (CASE WHEN user_id % 7 = 3 THEN 'click' END) WHEN revision % 11 = 0 THEN 'view' WHEN revision % 37 = 5 THEN NULL ELSE before END AS from_state FROM lg),
a(f, g) AS (VALUES {', '.join(map(str, LEGAL))}), z AS (SELECT event_id, user_id AS aggregate_id, revision,
CASE WHEN event_id % 101 = 0 THEN 'EVENT_MISSING' WHEN v = 2 AND t = 'visit' THEN 'TYPE_NOT_EXCLUSIVE' WHEN event_id % 23 = 4 THEN 'NOT_TYPED_TO_EVENT' WHEN to_state NOT IN ({', '.join(map(repr, STATES))}) OR (v = 1 AND to_state = 'signup') THEN 'BAD_TARGET'
 WHEN revision = 1 AND (from_state IS NOT NULL OR to_state NOT IN ('click', 'view') OR (t = 'order' AND to_state = 'view')) THEN 'BAD_INITIAL' WHEN revision > 1 AND (f IS NULL OR (t = 'order' AND f = 'click' AND g = 'click')) THEN 'UNREGISTERED' WHEN revision > 1 AND from_state <> before THEN 'BAD_FROM' END AS error
FROM s LEFT JOIN a ON f = from_state AND g = to_state) SELECT * FROM z WHERE error IS NOT NULL""")
def _(spark, sf):
    """Three registry versions, two families of types; some rows of no event, of a plain type, or typed otherwise than it."""
    user, type_of = F.col("aggregate_id"), F.when(F.col("aggregate_id") % 2 == 0, "order").otherwise("visit")
    rows = log(spark, sf).select("event_id", (user % 3).alias("registry_version"), type_of.alias("event_type"), F.concat(F.lit("f-"), type_of).alias("family"), "aggregate_id", "revision", "from_state", "to_state")
    revision, first = F.col("revision"), F.col("from_state").isNull()
    given = F.when(first, F.when(user % 7 == 3, "click")).when(revision % 11 == 0, "view").when(revision % 37 == 5, None).otherwise(F.col("from_state"))
    states = rows.withColumn("from_state", given).withColumn("family", F.when(F.col("event_id") % 23 == 4, "f-other").otherwise(F.col("family")))
    kinds = [(v, t) for v in range(3) for t in ("order", "visit")]
    table_of = lambda rows, schema: spark.createDataFrame(rows, f"registry_version long, event_type string, {schema}")
    types = table_of([(v, t, "append_only" if (v, t) == (2, "visit") else "exclusive_transition") for v, t in kinds], "semantics string")
    targets = table_of([(v, t, s, s == "click" or (s == "view" and t == "visit")) for v, t in kinds for s in STATES if (v, s) != (1, "signup")], "state_key string, is_initial boolean")
    pairs = table_of([(v, t, a, b) for v, t in kinds for a, b in LEGAL if (t, a, b) != ("order", "click", "click")], "from_state string, to_state string")
    return closure.transition_audit(rows.where("event_id % 101 <> 0"), states, types, targets, pairs)


# ---- source registries: one JSON file for 1,000 suppliers
SOURCE = View("so", "supplier", "'s' || CAST(s_suppkey AS STRING) AS id, s_name AS name, 'https://' || CAST(s_nationkey AS STRING) || '.example/' || CAST(s_suppkey AS STRING) AS url, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS enabled")


@op("src_config", f"WITH {SOURCE.sql} SELECT id, name, url FROM so WHERE coalesce(enabled, true)")
def _(spark, sf):
    path = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"
    part = F.floor(F.substring("id", 2, 20).cast("long") / 1000).alias("part")
    files = SOURCE(spark, sf).groupBy(part).agg(F.collect_list(F.struct("id", "name", "url", "enabled")).alias("sources")).select("sources")
    files.write.option("maxRecordsPerFile", 1).json(path)
    return feeds.read_sources(spark, path).select("id", "name", "url")

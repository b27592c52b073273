"""Audits: expected = decided = produced, unbroken chains, legal transitions, graphs. Each emits violations, not exceptions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.scratch import measured, released, written


def closure_audit(units: DataFrame, decisions: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: units, undecided units, decisions without unit, units decided twice."""
    d = decisions.groupBy(key).agg(F.count("*").alias("decided"))
    per = units.join(d, key, "left").groupBy(group).agg(F.count("*").alias("units"), F.count_if(F.col("decided").isNull()).alias("undecided"), F.count_if(F.col("decided") > 1).alias("twice"))
    strays = decisions.join(units.select(key), key, "left_anti").agg(F.count("*").alias("strays"))
    return per.crossJoin(F.broadcast(strays))  # one row


MEMBERSHIP_COUNTERS = (
    "missing_decisions", "selected_without_child", "child_without_selected", "universe_missing", "universe_extra", "selected_unknown", "invalid_subject_kind",
    "invalid_member_kind", "profile_missing_role", "profile_extra_role", "member_differs", "profile_roles", "snapshot_roles", "universe_roles",
)


def membership_closure(snapshots: DataFrame, units: DataFrame, decisions: DataFrame, members: DataFrame, universe: DataFrame, roles: DataFrame) -> DataFrame:
    """Per snapshot the fourteen counters over its units, decisions, selected members, universe and profile, and whether it is closed.

    ``snapshots``: snapshot_id, profile_id. ``units``: unit_id, snapshot_id, member_role, subject_kind, subject_key.
    ``decisions``: unit_id, decision, member_kind, and member_key (without it, members' keys are not held against decisions). ``members``: unit_id, member_kind, member_key. ``universe``: snapshot_id,
    member_role, subject_kind, member_kind, member_key. ``roles``: profile_id, member_role, subject_kind, member_kind. Ids of
    snapshots and units are distinct; units of no snapshot count nowhere. Sets compare nulls as equal, joins do not, and a
    null role is no role. Decisions and members are counted per unit before they meet units; each part ends in a few counts per
    snapshot, and only those meet.
    """
    u = units.join(snapshots.select("snapshot_id", "profile_id"), "snapshot_id")
    selected = decisions.where(F.col("decision") == "selected")
    per_unit = decisions.groupBy("unit_id").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "selected").alias("s"))
    children = members.groupBy("unit_id").agg(F.count("*").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    first = u.join(per_unit, "unit_id", "left").join(children, "unit_id", "left").groupBy("snapshot_id").agg(
        F.count_if(F.col("n").isNull()).alias("missing_decisions"), F.sum(F.when(F.col("m").isNull(), zero("s")).otherwise(0)).alias("selected_without_child"),
        F.sum(F.when(zero("s") == 0, zero("m")).otherwise(0)).alias("child_without_selected"),
    )

    def sides(key: list[str], **frames: DataFrame) -> DataFrame:
        """Per snapshot and key, which of the frames hold it."""
        rows = [df.select("snapshot_id", *key, *[F.lit(n == name).alias(n) for n in frames]) for name, df in frames.items()]
        both = rows[0]
        for more in rows[1:]:
            both = both.unionByName(more)
        return both.groupBy("snapshot_id", *key).agg(*[F.bool_or(n).alias(n) for n in frames])

    subjects = u.withColumnRenamed("subject_key", "member_key")
    second = sides(["member_role", "subject_kind", "member_key"], of_universe=universe, of_units=subjects).groupBy("snapshot_id").agg(
        F.count_if(~F.col("of_units")).alias("universe_missing"), F.count_if(~F.col("of_universe")).alias("universe_extra")
    )
    decided_key = F.col("member_key") if "member_key" in decisions.columns else F.lit(None)
    decided = decisions.select("unit_id", "decision", F.col("member_kind").alias("decided_kind"), decided_key.alias("decided_key"))
    differs = F.col("decision").isNull() | (F.col("decision") != "selected") | (F.col("decided_kind") != F.col("member_kind")) | (F.col("decided_key") != F.col("member_key"))
    bound = members.join(u.select("unit_id", "snapshot_id"), "unit_id").join(decided, "unit_id", "left").groupBy("snapshot_id").agg(F.count_if(differs).alias("member_differs"))
    chosen = members.join(u.select("unit_id", "snapshot_id", "member_role"), "unit_id")
    third = chosen.join(universe, ["snapshot_id", "member_role", "member_kind", "member_key"], "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("selected_unknown"))
    asked = roles.select("profile_id", "member_role", F.col("subject_kind").alias("role_subject"), F.col("member_kind").alias("role_member"))
    typed = u.select("unit_id", "snapshot_id", "profile_id", "member_role", "subject_kind").join(asked, ["profile_id", "member_role"])
    fourth = typed.groupBy("snapshot_id").agg(F.count_if(F.col("subject_kind") != F.col("role_subject")).alias("invalid_subject_kind"))
    fifth = typed.join(selected.select("unit_id", "member_kind"), "unit_id").groupBy("snapshot_id").agg(F.count_if(F.col("member_kind") != F.col("role_member")).alias("invalid_member_kind"))
    stated = snapshots.select("snapshot_id", "profile_id").join(roles.groupBy("profile_id", "member_role").agg(F.count("*").alias("c")), "profile_id")
    sixth = stated.groupBy("snapshot_id").agg(F.sum("c").alias("profile_roles"))
    named = F.col("member_role").isNotNull()
    seventh = sides(["member_role"], of_profile=stated, of_units=u, of_universe=universe).groupBy("snapshot_id").agg(
        F.count_if(F.col("of_profile") & ~F.col("of_units")).alias("profile_missing_role"), F.count_if(F.col("of_units") & ~F.col("of_profile")).alias("profile_extra_role"),
        F.count_if(F.col("of_units") & named).alias("snapshot_roles"), F.count_if(F.col("of_universe") & named).alias("universe_roles"),
    )
    out = snapshots.select("snapshot_id")
    for part in (first, second, third, fourth, fifth, sixth, seventh, bound):
        out = out.join(part, "snapshot_id", "left")
    out = out.select("snapshot_id", *[zero(c).alias(c) for c in MEMBERSHIP_COUNTERS])
    wrong = sum((F.col(c) for c in MEMBERSHIP_COUNTERS[1:11]), F.col(MEMBERSHIP_COUNTERS[0]))
    closed = (wrong == 0) & (F.col("profile_roles") > 0) & (F.col("snapshot_roles") == F.col("profile_roles")) & (F.col("universe_roles") == F.col("profile_roles"))
    return out.withColumn("closed", closed)


def closure_anti(units: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Keys of one table that the other lacks, each once; a null key matches none. Both are counted in one grouping, so a
    key that stands often costs a row a task and nothing is sorted."""
    side = lambda df, unit: df.select(key, F.lit(unit).alias("unit"))
    seen = side(units, True).unionByName(side(decisions, False)).groupBy(key).agg(F.bool_or("unit").alias("unit"), F.bool_or(~F.col("unit")).alias("decision"))
    no_match = F.col(key).isNull()
    sides = F.array_compact(F.array(F.when(F.col("unit") & (~F.col("decision") | no_match), "undecided"), F.when(F.col("decision") & (~F.col("unit") | no_match), "unexpected")))
    return seen.select(key, F.explode(sides).alias("side"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both ways, with parentheses: (A - B) + (B - A)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def chain_audit(rows: DataFrame, key: str, revision: str, own_id: str, predecessor: str) -> DataFrame:
    """Revisions start at 1 without predecessor, then rise by one and name the row before."""
    w = Window.partitionBy(key).orderBy(revision)
    r, before, prev = F.col(revision), F.lag(revision).over(w), F.lag(own_id).over(w)
    code = F.when(before.isNull() & ((r != 1) | F.col(predecessor).isNotNull()), "CHAIN_START").when(before.isNotNull() & (r != before + 1), "CHAIN_GAP").when(before.isNotNull() & ~F.col(predecessor).eqNullSafe(prev), "CHAIN_PREDECESSOR")
    return rows.withColumn("error", code).where("error is not null").select(key, revision, "error")


def current_state(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the highest revision; of equal ones, that of the highest hash, whatever the order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(revision), F.xxhash64(*rest))).alias("s")).select(key, "s.*")


TYPED = ("registry_version", "event_type", "family", "aggregate_id", "revision")


def transition_audit(events: DataFrame, states: DataFrame, types: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """State rows of events that break a rule, each with the first that it breaks.

    ``events``: event_id and TYPED. ``states``: event_id, TYPED as the row states them, from_state, to_state. ``types``:
    registry_version, event_type, semantics. ``targets``: registry_version, event_type, state_key, is_initial. ``pairs``:
    registry_version, event_type, from_state, to_state. The event is there and of an exclusive type; the row is typed as its
    event; the target is registered for the type; revision 1 comes from nothing into an initial state; later ones follow a
    registered pair, from the state that the revision before entered.
    """
    kind, own = ["registry_version", "event_type"], [f"own_{c}" for c in TYPED]
    e = events.select("event_id", *[F.col(c).alias(o) for c, o in zip(TYPED, own)])
    named = lambda df, *more: df.select(F.col("registry_version").alias("own_registry_version"), F.col("event_type").alias("own_event_type"), *more)
    rows = states.join(e, "event_id", "left").join(named(types, "semantics"), ["own_registry_version", "own_event_type"], "left")
    rows = rows.join(targets.select(*kind, F.col("state_key").alias("to_state"), F.lit(True).alias("target"), "is_initial"), [*kind, "to_state"], "left")
    rows = rows.join(pairs.select(*kind, "from_state", "to_state", F.lit(True).alias("legal")), [*kind, "from_state", "to_state"], "left")
    before = Window.partitionBy("aggregate_id").orderBy("revision")
    rows = rows.withColumn("before", F.when(F.lag("revision").over(before) == F.col("revision") - 1, F.lag("to_state").over(before)))
    first = F.col("revision") == 1
    typed = reduce(lambda a, b: a | b, [F.col(c) != F.col(o) for c, o in zip(TYPED, own)])
    code = (
        F.when(F.col("own_revision").isNull(), "EVENT_MISSING").when(~F.col("semantics").eqNullSafe("exclusive_transition"), "TYPE_NOT_EXCLUSIVE").when(typed, "NOT_TYPED_TO_EVENT")
        .when(F.col("target").isNull(), "BAD_TARGET").when(first & (F.col("from_state").isNotNull() | ~F.coalesce(F.col("is_initial"), F.lit(False))), "BAD_INITIAL")
        .when(~first & F.col("legal").isNull(), "UNREGISTERED").when(~first & ~F.col("from_state").eqNullSafe(F.col("before")), "BAD_FROM")
    )
    return rows.withColumn("error", code).where("error is not null").select("event_id", "aggregate_id", "revision", "error")


def transition_rows(events: DataFrame, states: DataFrame, exclusive: list[str]) -> DataFrame:
    """Events of an exclusive type have exactly one state row, others none."""
    n = states.groupBy("event_id").agg(F.count("*").alias("n"))
    one, rows = F.coalesce(F.col("event_type").isin(exclusive), F.lit(False)), F.coalesce("n", F.lit(0))
    code = F.when(one & (rows != 1), "NOT_ONE_STATE").when(~one & (rows != 0), "STATE_NOT_ALLOWED")
    return events.select("event_id", "event_type").join(n, "event_id", "left").withColumn("error", code).where("error is not null").select("event_id", "error")


def range_overlap(rows: DataFrame, series: str, begin: str, end: str, own_id: str) -> DataFrame:
    """Rows that begin before the latest end so far in their series; a null end is open. A running maximum, no pairs."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    w = Window.partitionBy(series).orderBy(begin, own_id).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max(F.coalesce(F.col(end), far)).over(w)).where(F.col(begin) < F.col("reach")).select(series, own_id)


def ordered_hash(rows: DataFrame, group: str, order: str, line: Column) -> DataFrame:
    """sha256 of each group's lines in order, joined by newlines. A group's lines meet in one row, so a group must fit in a task."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"])
    return rows.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("set_hash"), F.count("*").alias("members"))


def signer_quorum(rows: DataFrame, quorum: int) -> DataFrame:
    out = rows.groupBy("approval_id").agg(F.count("*").alias("signatures"), F.count_distinct("signer_id").alias("signers"), F.count_if(~F.col("valid")).alias("invalid"))
    return out.withColumn("approved", (F.col("signatures") >= quorum) & (F.col("signers") >= quorum) & (F.col("invalid") == 0))


def phase_gate(required: DataFrame, results: DataFrame) -> DataFrame:
    """Per phase: missing, failed, unexpected; pass only if something is required and nothing is wrong."""
    r = results.withColumnRenamed("phase", "r_phase")
    both = required.withColumn("wanted", F.lit(True)).join(r, "definition_id", "full_outer")
    phase = F.coalesce("phase", "r_phase").alias("phase")
    out = both.groupBy(phase).agg(F.count_if("wanted").alias("required"), F.count_if(F.col("wanted") & F.col("result").isNull()).alias("missing"), F.count_if(F.col("wanted") & (F.col("result") == "failed")).alias("failed"), F.count_if(F.col("wanted").isNull()).alias("unknown"))
    return out.withColumn("passed", (F.col("required") > 0) & (F.col("missing") + F.col("failed") + F.col("unknown") == 0))


def identity_universe(rows: DataFrame) -> DataFrame:
    shared = rows.groupBy("global_id").agg(F.count_distinct("kind", "type").alias("n")).where("n > 1").select("global_id", F.lit("IDENTITY_SHARED").alias("error"))
    orphan = rows.where("parent_id is not null").join(rows.select(F.col("global_id").alias("parent_id")).distinct(), "parent_id", "left_anti").select("global_id", F.lit("PARENT_MISSING").alias("error"))
    return shared.unionByName(orphan)


def check_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over the table: every row's broken rules (a rule that is null holds, as in CHECK)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(True)), name) for name, r in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


class Rule(NamedTuple):
    """A row of the rule table: what must hold of each row of ``table``, as an expression over its columns."""

    table: str
    name: str
    holds: str


def _together(names: str, also: str = "true") -> str:
    """All of the named columns are there, or none is; then ``also``."""
    first, *rest = names.split()
    return " AND ".join([*(f"(({first} IS NULL) = ({n} IS NULL))" for n in rest), f"coalesce({also}, true)"])


# Names of columns and the values that they allow.
RULES = (
    Rule("event", "valid_time", "valid_time_status IN ('known', 'unknown', 'not_applicable') AND (valid_time_status = 'known') = (valid_effective_at IS NOT NULL)"),
    Rule("event", "author", "actor_id IS NOT NULL OR rule_record_id IS NOT NULL"),
    Rule("event", "actor_whole", _together("actor_id actor_kind actor_type", "trim(actor_type) <> ''")),
    Rule("event", "rule_record_whole", _together("rule_record_id rule_record_kind rule_record_type", "trim(rule_record_type) <> '' AND rule_record_kind = 'record'")),
    Rule("item_version", "observed_before_available", "version_observed_at <= version_available_at"),
    Rule("item_version", "seen_before_observed", "item_first_seen_at <= version_observed_at"),
    Rule("item_version", "predecessor", "version_ordinal >= 1 AND (version_ordinal = 1) = (previous_version_id IS NULL)"),
    Rule("item_version", "content_hash_hex", "content_hash RLIKE '^[0-9a-f]{64}$'"),
    Rule("decision", "member_of_selected", "(decision = 'selected') = (selected_member_kind IS NOT NULL) AND (decision = 'selected') = (selected_member_key IS NOT NULL)"),
    Rule("snapshot", "revision_positive", "revision IS NOT NULL AND revision > 0"),
    Rule("snapshot", "rights_epoch_positive", "rights_epoch IS NOT NULL AND rights_epoch > 0"),
    Rule("snapshot", "status", "snapshot_status IS NOT NULL AND snapshot_status IN ('published', 'recomputing', 'unavailable')"),
    Rule("snapshot", "filled", "comparison_watermark IS NOT NULL AND method_epoch IS NOT NULL AND render_plan_hash IS NOT NULL"),
)


def broken_rules(tables: dict[str, tuple[DataFrame, str]], rules: Iterable[Rule] = RULES) -> DataFrame:
    """(table_name, key, rule) of every row that breaks a rule; each table, given with its key, is scanned once for all of its.

    A rule that is null holds, as in CHECK. Tables without a rule, and rules of tables that are not given, are left out.
    """
    found = []
    for name, (df, key) in tables.items():
        mine = {r.name: F.expr(r.holds) for r in rules if r.table == name}
        if mine:
            found.append(check_rules(df.withColumn("rule key", F.col(key).cast("string")), "rule key", mine).select(F.lit(name).alias("table_name"), F.col("rule key").alias("key"), "rule"))
    if not found:
        raise ValueError("no rule of any of these tables")
    return reduce(DataFrame.unionByName, found)


def causal_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    e = lambda p: events.select(F.col("event_id").alias(f"{p}_id"), F.col("available_at").alias(f"{p}_at"), F.col("domain").alias(f"{p}_domain"), F.col("sequence").alias(f"{p}_seq"))
    j = edges.join(e("child"), F.col("event_id") == F.col("child_id")).join(e("parent"), F.col("parent_event_id") == F.col("parent_id"))
    same = F.col("child_domain") == F.col("parent_domain")
    code = F.when(F.col("event_id") == F.col("parent_event_id"), "SELF_EDGE").when(F.col("parent_at") > F.col("child_at"), "PARENT_LATER").when(same & (F.col("parent_seq") >= F.col("child_seq")), "SEQUENCE_ORDER").when(~same & F.col("queue_proof_id").isNull(), "PROOF_MISSING")
    return j.withColumn("error", code).where("error is not null").select("event_id", "parent_event_id", "error")


def _ends(links: DataFrame, own: str, to: str) -> DataFrame:
    """``own`` nodes whose links, each node's only one, lead to a node without any. Paths double, so a chain of n links
    takes log n rounds; a round that settles nothing new shows that only cycles are left. A round carries the paths that are
    still open alone; one that meets a node of several links is dropped."""
    only = links.groupBy(own).agg(F.min(to).alias("at"), F.max(to).alias("other")).where(F.col("at") == F.col("other")).select(F.col(own).alias("node"), "at")
    every = links.select(F.col(own).alias("at")).distinct().withColumn("goes_on", F.lit(True))
    told = {"open": F.count_if(~F.col("ended")), "settled": F.count_if("ended")}
    paths, rows = measured(only.join(every, "at", "left").select("node", "at", F.col("goes_on").isNull().alias("ended")), "paths", **told)
    ended = paths.where("ended").select("node")
    while rows["open"] and rows["settled"]:
        paths = paths.where("not ended")
        then = paths.select(F.col("node").alias("at"), F.col("at").alias("on"), "ended")
        then = then.unionByName(ended.select(F.col("node").alias("at"), F.col("node").alias("on"), F.lit(True).alias("ended")))
        paths, rows = measured(paths.select("node", "at").join(then, "at").select("node", F.col("on").alias("at"), "ended"), "paths", **told)
        ended = ended.unionByName(paths.where("ended").select("node"))
    return ended.withColumnRenamed("node", own)


def _peeled(left: DataFrame, n: int) -> tuple[DataFrame, int, bool]:
    """Without the edges that only lead to an end or only come from one; what stays is on or between cycles. And its number,
    and whether all of it is known to lie on cycles: each node of a step's last table is both a child and a parent, so where no
    node has a second parent or a second child, every node is on one cycle."""
    while n:
        before = n
        for own, to in (("event_id", "parent_event_id"), ("parent_event_id", "event_id")):
            kept = left.join(_ends(left, own, to), own, "left_anti")
            left, rows = measured(kept.join(kept.select(F.col(own).alias(to)).distinct(), to, "left_semi"), "cycle", n=F.count("*"))
            n = rows["n"]
        if n and all(left.select(end).distinct().count() == n for end in ("event_id", "parent_event_id")):
            return left, n, True
        if n == before:
            break
    return left, n, False


def _highest(edges: DataFrame, own: str, to: str) -> DataFrame:
    """(node, label): the highest node, in an order by hash, that ``own`` -> ``to`` links lead to a node from. What reaches
    the label reaches the node too, so labels jump to their label's label."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
    edges = edges.select(own, to)
    both = edges.select(F.explode(F.array(own, to)).alias("node")).distinct()
    labels, rows = measured(both.select("node", rank(F.col("node")).alias("label")), "labels", n=F.count("*"))
    while rows["n"]:
        near = edges.join(labels, edges[own] == labels["node"]).groupBy(to).agg(F.max("label").alias("near")).withColumnRenamed(to, "node")
        met = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.greatest("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("through"), F.col("label").alias("far"))
        met = met.join(far, F.col("label.id") == F.col("through"), "left").select("node", F.greatest("label", "far").alias("label"), "was")
        moved = {"n": F.count_if(F.col("was") != F.col("label"))}
        old, (labels, rows) = labels, measured(met, "labels", **moved)
        released(old)
        labels = _as_labels(labels)
    return labels.select("node", F.col("label.id").alias("label"))


def _as_labels(table: DataFrame) -> DataFrame:
    labels = table.select("node", "label")
    labels.scratch_path = table.scratch_path
    return labels


def causal_cycle(edges: DataFrame) -> DataFrame:
    """Edges on a cycle: those whose child is among its parent's ancestors, that is, both lie in one strongly connected part.

    Ends are peeled off first. Then, until no edge is left, every node is labelled by the highest node that reaches it
    and, within a label, by the highest that it reaches: where both agree the node is in its label's part. Edges between
    labels are on no cycle. Every step is a written table, so lineage does not grow with rounds.
    """
    rows = edges.select("event_id", "parent_event_id").where("event_id is not null and parent_event_id is not null").distinct()
    left, seen = measured(rows, "cycle", n=F.count("*"))
    found = left.limit(0)
    left, n, whole = _peeled(left, seen["n"])
    while n:
        if whole:
            return written(found.unionByName(left), "cycle")
        down = _highest(left, "parent_event_id", "event_id")
        of = lambda labels, end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        within = left.join(of(down, "event_id"), "event_id").join(of(down, "parent_event_id"), "parent_event_id").where("event_id_label = parent_event_id_label")
        within = written(within.select("event_id", "parent_event_id", F.col("event_id_label").alias("label")), "cycle")
        up = _highest(within, "event_id", "parent_event_id")
        marked = within.join(of(up, "event_id"), "event_id").join(of(up, "parent_event_id"), "parent_event_id")
        marked = written(marked.select("event_id", "parent_event_id", (F.col("event_id_label") == F.col("label")).alias("a"), (F.col("parent_event_id_label") == F.col("label")).alias("b")), "cycle")
        found = written(found.unionByName(marked.where("a and b").select("event_id", "parent_event_id")), "cycle")
        left, seen = measured(marked.where("not a and not b").select("event_id", "parent_event_id"), "cycle", n=F.count("*"))
        left, n, whole = _peeled(left, seen["n"])
    return found

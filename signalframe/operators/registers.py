"""Audits of registered sets: response sets, event types, artifacts, gates, exploration. Each returns one row a key or a violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _codes(*rules: tuple[Column, str]) -> Column:
    """All codes whose rule is true, in order."""
    return F.array_compact(F.array(*[F.when(rule, code) for rule, code in rules]))


def _hexed(c: Column) -> Column:
    return F.coalesce(F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit("-"))


def member_line(m: Column) -> Column:
    """A member as one line of its set's hash."""
    flag = F.when(m["continuation_expected"], "1").otherwise("0")
    return F.concat_ws("|", m["unit_id"].cast("string"), _hexed(m["member_key"].cast("string")), m["ordinal"].cast("string"), _hexed(m["page_key"]), _hexed(m["shard_key"]), flag)


def member_set_hash(members: Column) -> Column:
    ordered = F.array_sort(F.transform(members, lambda m: F.struct(m["ordinal"].alias("o"), member_line(m).alias("l"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda s: s["l"]), "\n"), 256)


def response_set_closure(documents: DataFrame) -> DataFrame:
    """``set_id, expected_count, member_set_hash, members, decisions, receipts, outputs`` -> ``set_id, error``: each broken rule once.

    A document is one provider answer, so its arrays stay in its row: nothing is shuffled. Order of arrays is irrelevant.
    """
    col = lambda a, f: F.transform(a, lambda x: x[f])
    differ = lambda a, f: F.size(F.array_distinct(col(a, f))) != F.size(a)
    members, decisions, receipts, outputs = map(F.col, ("members", "decisions", "receipts", "outputs"))
    lacks = lambda a, b: F.size(F.array_except(a, b)) > 0
    by_decision = lambda rows, d: F.filter(rows, lambda r: r["decision_id"] == d["decision_id"])
    success = lambda d: d["outcome"].eqNullSafe("success")
    known = lambda d: F.coalesce(d["outcome"].isin("success", "failed", "missing"), F.lit(False))
    no_reason = lambda d: F.coalesce(F.trim(d["reason_code"]), F.lit("")) == ""
    units = col(members, "unit_id")
    all_ids = F.concat(units.cast("array<string>"), col(decisions, "decision_id").cast("array<string>"), col(receipts, "receipt_id").cast("array<string>"), col(outputs, "artifact_id").cast("array<string>"), F.array(F.col("set_id").cast("string")))
    opened = F.filter(members, lambda m: m["continuation_expected"])
    closed = col(F.filter(decisions, lambda d: d["continuation_closed"].eqNullSafe(True)), "unit_id")
    decided = col(F.filter(decisions, lambda d: d["unit_id"].isNotNull()), "unit_id")
    rules = [
        (F.size(members) == 0, "MEMBERS_EMPTY"),
        (F.col("expected_count") != F.size(members), "MEMBER_COUNT"),
        (differ(members, "unit_id") | differ(members, "member_key") | differ(members, "ordinal"), "MEMBER_NOT_UNIQUE"),
        ((F.size(members) > 0) & (F.array_sort(col(members, "ordinal")) != F.sequence(F.lit(1), F.greatest(F.size(members), F.lit(1)))), "ORDINALS"),
        (F.col("member_set_hash") != member_set_hash(members), "MEMBER_HASH"),
        (differ(decisions, "decision_id") | differ(decisions, "unit_id"), "DECISION_NOT_UNIQUE"),
        (lacks(units, decided), "MEMBER_UNDECIDED"),
        (lacks(decided, units), "DECISION_UNKNOWN_MEMBER"),
        (F.exists(decisions, lambda d: ~known(d)), "OUTCOME_UNKNOWN"),
        (F.exists(decisions, lambda d: success(d) & d["reason_code"].isNotNull()), "SUCCESS_WITH_REASON"),
        (F.exists(decisions, lambda d: known(d) & ~success(d) & no_reason(d)), "REASON_MISSING"),
        (differ(receipts, "receipt_id") | differ(receipts, "decision_id"), "RECEIPT_NOT_UNIQUE"),
        (differ(outputs, "artifact_id") | differ(outputs, "decision_id") | differ(outputs, "receipt_id"), "OUTPUT_NOT_UNIQUE"),
        (F.exists(decisions, lambda d: success(d) & (F.size(by_decision(receipts, d)) == 0)), "RECEIPT_MISSING"),
        (F.exists(decisions, lambda d: success(d) & (F.size(by_decision(outputs, d)) == 0)), "OUTPUT_MISSING"),
        (F.exists(decisions, lambda d: ~success(d) & ((F.size(by_decision(receipts, d)) > 0) | (F.size(by_decision(outputs, d)) > 0))), "ARTIFACT_WITHOUT_SUCCESS"),
        (F.exists(decisions, lambda d: F.exists(by_decision(receipts, d), lambda r: ~r["unit_id"].eqNullSafe(d["unit_id"]))), "RECEIPT_UNIT"),
        (F.exists(outputs, lambda o: F.exists(receipts, lambda r: (r["decision_id"] == o["decision_id"]) & ~r["receipt_id"].eqNullSafe(o["receipt_id"]))), "OUTPUT_RECEIPT"),
        (lacks(F.array_intersect(col(opened, "unit_id"), decided), closed), "CONTINUATION_OPEN"),
        (lacks(col(receipts, "decision_id"), col(decisions, "decision_id")), "RECEIPT_UNKNOWN_DECISION"),
        (lacks(col(outputs, "decision_id"), col(decisions, "decision_id")) | lacks(col(outputs, "receipt_id"), col(receipts, "receipt_id")), "OUTPUT_UNKNOWN_PARENT"),
        (F.size(F.array_distinct(all_ids)) != F.size(all_ids), "IDENTITY_COLLISION"),
    ]
    return documents.select("set_id", F.explode(_codes(*rules)).alias("error"))


def response_set_closure_sql(sets: DataFrame, units: DataFrame, decisions: DataFrame, outputs: DataFrame) -> DataFrame:
    """The flat form: counts per set against its header; ``outputs`` are pre-aggregated before they meet the sets."""
    d = decisions.groupBy("unit_id").agg(F.count("*").alias("decided"), F.count_if(F.col("outcome") == "success").alias("won"), F.count_if(~F.coalesce("continuation_closed", F.lit(False))).alias("still_open"))
    member = F.struct("unit_id", "member_key", "ordinal", "page_key", "shard_key", "continuation_expected")
    per = units.select("set_id", "unit_id", "member_key", "ordinal", "page_key", "shard_key", "continuation_expected").join(d, "unit_id", "left").groupBy("set_id").agg(
        F.count("*").alias("units"), F.sum(_n("decided")).alias("decisions"), F.sum(_n("won")).alias("successes"),
        F.sum(F.when(F.col("continuation_expected"), _n("still_open")).otherwise(0)).alias("open"), member_set_hash(F.collect_list(member)).alias("own_hash"),
    )
    out = sets.join(per, "set_id", "left").join(outputs.groupBy("set_id").agg(F.count("*").alias("outputs")), "set_id", "left")
    counted = {c: _n(c) for c in ("units", "decisions", "successes", "open", "outputs")}
    out = out.withColumns(counted)
    closed = (F.col("units") == F.col("expected_count")) & (F.col("decisions") == F.col("units")) & (F.col("outputs") == F.col("successes")) & (F.col("open") == 0) & F.col("own_hash").eqNullSafe(F.col("member_set_hash"))
    closed = closed & (F.col("units") >= F.col("minimum_members")) & (F.col("maximum_members").isNull() | (F.col("units") <= F.col("maximum_members")))
    return out.select("set_id", *counted, closed.alias("closed"))


def append_after_close(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that arrive at or after their set's closing, and sets whose plan wasn't there before the invocation."""
    late = rows.join(sets.where("closed_at is not null").select("set_id", "closed_at"), "set_id").where("arrived_at >= closed_at").select("set_id", F.col("row_id"), F.lit("APPEND_AFTER_CLOSE").alias("error"))
    plan = sets.where(F.col("plan_available_at").isNull() | (F.col("plan_available_at") > F.col("invoked_at"))).select("set_id", F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"), F.lit("PLAN_NOT_FROZEN").alias("error"))
    return late.unionByName(plan)


def event_type_closure(types: DataFrame, states: DataFrame, transitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exclusive types have states, one initial state and transitions; others neither; all an alias."""
    s = states.groupBy("event_type").agg(F.count("*").alias("states"), F.count_if("is_initial").alias("initial"))
    t = transitions.groupBy("event_type").agg(F.count("*").alias("transitions"))
    a = aliases.groupBy("event_type").agg(F.count("*").alias("aliases"))
    j = types.join(s, "event_type", "left").join(t, "event_type", "left").join(a, "event_type", "left")
    exclusive = F.col("semantics").eqNullSafe("exclusive_transition")
    broken = _codes(
        (exclusive & ((_n("states") == 0) | (_n("initial") != 1) | (_n("transitions") == 0)), "REGISTRY_OPEN"),
        (~exclusive & ((_n("states") > 0) | (_n("transitions") > 0)), "CHILDREN_OF_OPEN_TYPE"),
        (_n("aliases") == 0, "ALIAS_MISSING"),
    )
    return j.select("event_type", F.explode(broken).alias("error"))


def event_registry_audit(events: DataFrame, types: DataFrame, identities: DataFrame) -> DataFrame:
    """First broken rule: known type, identity registered with it, aggregate kind equal, no machine fields where not exclusive."""
    t = types.select("event_type", "semantics", F.col("aggregate_kind").alias("own_kind"))
    i = identities.select("event_id", F.col("event_type").alias("registered"))
    j = events.join(t, "event_type", "left").join(i, "event_id", "left")
    machine = F.col("from_state").isNotNull() | F.col("to_state").isNotNull()
    code = F.when(F.col("semantics").isNull(), "TYPE_UNKNOWN").when(~F.col("registered").eqNullSafe(F.col("event_type")), "IDENTITY_MISMATCH").when(~F.col("aggregate_kind").eqNullSafe(F.col("own_kind")), "AGGREGATE_KIND").when((F.col("semantics") != "exclusive_transition") & machine, "MACHINE_FIELDS")
    return j.withColumn("error", code).where("error is not null").select("event_id", "error")


def artifact_mode_audit(artifacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Content modes have one active binding to their own blob, the others none; each mode its own columns."""
    b = bindings.where("binding_state = 'active'").groupBy("artifact_id").agg(F.count("*").alias("bound"), F.min("blob_id").alias("bound_blob"))
    content, has = F.coalesce(F.col("storage_mode").isin("full_bytes", "licensed_excerpt"), F.lit(False)), lambda c: F.col(c).isNotNull()
    whole = has("blob_id") & has("content_checksum") & has("preservation_id") & ~has("external_uri")
    bare = ~has("blob_id") & ~has("content_checksum") & ~has("excerpt_text") & ~has("preservation_id")
    shape = F.when(F.col("storage_mode") == "full_bytes", whole & ~has("excerpt_text")).when(F.col("storage_mode") == "licensed_excerpt", whole & has("excerpt_text"))
    shape = shape.when(F.col("storage_mode") == "metadata_only", bare & has("metadata_checksum") & ~has("external_uri")).when(F.col("storage_mode") == "external_pointer", bare & ~has("metadata_checksum") & has("external_uri")).otherwise(False)
    broken = _codes(
        (~shape, "COLUMNS"),
        (content & ((_n("bound") != 1) | (F.col("bound_blob") != F.col("blob_id"))), "BINDING_NOT_ONE"),
        (~content & (_n("bound") != 0), "BINDING_UNWANTED"),
    )
    return artifacts.join(b, "artifact_id", "left").select("artifact_id", F.explode(broken).alias("error"))


def migration_provenance(migrations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Migrations whose source's checksum differs, or whose derivative names another parent."""
    s = artifacts.select(F.col("artifact_id").alias("source_id"), F.col("content_checksum").alias("own_checksum"))
    d = artifacts.select(F.col("artifact_id").alias("derivative_id"), "derived_from", F.lit(True).alias("found"))
    ok = (F.col("own_checksum") == F.col("source_checksum")) & F.col("found") & F.col("derived_from").eqNullSafe(F.col("source_id"))
    return migrations.join(s, "source_id", "left").join(d, "derivative_id", "left").where(~F.coalesce(ok, F.lit(False))).select("source_id", "derivative_id")


def content_closure(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Each parent has one child and it is of the declared kind."""
    c = children.groupBy("parent_id").agg(F.count("*").alias("children"), F.min("kind").alias("child_kind"))
    code = F.when(_n("children") != 1, "CHILD_COUNT").when(F.col("child_kind") != F.col("declared_kind"), "CHILD_KIND")
    return parents.join(c, "parent_id", "left").withColumn("error", code).where("error is not null").select("parent_id", "error")


def coverage_item_closure(items: DataFrame, units: DataFrame, gaps: DataFrame) -> DataFrame:
    """Items without exactly one generation unit or open gap in all."""
    both = units.select("item_id").unionByName(gaps.where("open").select("item_id")).groupBy("item_id").agg(F.count("*").alias("terminals"))
    return items.join(both, "item_id", "left").select("item_id", _n("terminals").alias("terminals")).where("terminals <> 1")


def text_ref_binding(references: DataFrame, plans: DataFrame, fields: list[str]) -> DataFrame:
    """One of citation and listing; the named plan agrees on every field."""
    p = plans.select("plan_id", *[F.col(f).alias(f"plan_{f}") for f in fields], F.lit(True).alias("found"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"plan_{f}")), f) for f in fields]))
    code = F.when(F.col("citation_id").isNull() == F.col("listing_id").isNull(), "NOT_EXACTLY_ONE").when(F.col("found").isNull(), "PLAN_MISSING").when(F.size(differ) > 0, F.concat(F.lit("DIFFERS:"), F.array_join(differ, ",")))
    return references.join(p, "plan_id", "left").withColumn("error", code).where("error is not null").select("reference_id", "error")


def lineage_isolation(members: DataFrame, payloads: list[str]) -> DataFrame:
    """Public members come from the global domain without private lineage, are kept 1 to 300 s, and carry neutral payloads."""
    broken = _codes(
        (~F.col("source_domain").eqNullSafe("global"), "DOMAIN"),
        (F.coalesce("private_lineage", F.lit(1)) != 0, "PRIVATE_LINEAGE"),
        (~F.coalesce(F.col("retention_seconds").between(1, 300), F.lit(False)), "RETENTION"),
        (~F.coalesce(F.col("payload_kind").isin(payloads), F.lit(False)), "PAYLOAD"),
    )
    return members.select("member_id", F.explode(broken).alias("error"))


def result_membership(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Results outside the catalogue, or run although excluded, or called not applicable although included."""
    c = catalogue.select("definition_id", "membership")
    code = F.when(F.col("membership").isNull(), "NOT_IN_CATALOGUE").when((F.col("membership") == "excluded") & (F.col("result") != "not_applicable"), "EXCLUDED_RUN").when((F.col("membership") == "included") & (F.col("result") == "not_applicable"), "INCLUDED_SKIPPED")
    return results.join(c, "definition_id", "left").withColumn("error", code).where("error is not null").select("definition_id", "error")


def waiver_rules(waivers: DataFrame, definitions: DataFrame) -> DataFrame:
    d = definitions.select("definition_id", "severity", "waivable")
    code = F.when(F.col("severity").isNull(), "DEFINITION_MISSING").when(F.col("severity") == "P0", "P0_WAIVED").when(~F.coalesce("waivable", F.lit(False)), "NOT_WAIVABLE").when(~F.coalesce("approved", F.lit(False)), "NOT_APPROVED")
    return waivers.join(d, "definition_id", "left").withColumn("error", code).where("error is not null").select("waiver_id", "error")


def definition_strength(definitions: DataFrame) -> DataFrame:
    """A later revision may not weaken phase, severity, blocking or version, nor assert what is always true. Repeated revisions stand in the order of their columns."""
    w = Window.partitionBy("definition_id").orderBy("revision", "phase", "severity", "blocking", "version", "assertion")
    was = lambda c: F.lag(c).over(w)
    rank = F.regexp_extract("version", "v(\\d+)", 1).try_cast("int")
    d = definitions.withColumn("rank", rank).withColumns({f"was_{c}": was(c) for c in ("phase", "severity", "blocking", "rank")})
    broken = _codes(
        (F.lower(F.trim("assertion")).isin("", "true", "1=1", "always"), "TAUTOLOGY"),
        (F.col("phase") > F.col("was_phase"), "PHASE_LATER"),
        (F.col("severity") > F.col("was_severity"), "SEVERITY_WEAKER"),
        (F.col("was_blocking") & ~F.col("blocking"), "NO_LONGER_BLOCKING"),
        (F.col("rank") < F.col("was_rank"), "VERSION_LOWER"),
    )
    return d.select("definition_id", "revision", F.explode(broken).alias("error"))


def gate_decision_closure(decisions: DataFrame, catalogs: DataFrame, members: DataFrame, definitions: DataFrame, results: DataFrame) -> DataFrame:
    """Each rule that a gate decision breaks over its catalogue and its run's results.

    ``decisions``: gate_id, catalog_id, run_id, target_phase, target_gate, required, blocking_results, unpassed (ids in
    order), decision. ``catalogs``: catalog_id, phase, gate. ``members``: catalog_id, definition_id, membership.
    ``definitions``: definition_id, blocking. ``results``: run_id, definition_id, result. Failures are few beside results,
    so decisions meet those before their catalogue's members. One decision's unpassed ids are one row, as stated.
    """
    m = members.groupBy("catalog_id").agg(F.count("*").alias("n_members"), F.count_if(F.col("membership") == "applicable").alias("n_applicable"))
    r = results.groupBy("run_id").agg(F.count("*").alias("n_results"))
    failed = results.where(F.col("result").isin("fail", "blocked")).select("run_id", "definition_id")
    applicable = members.where(F.col("membership") == "applicable").select("catalog_id", "definition_id")
    hits = decisions.select("gate_id", "catalog_id", "run_id", "target_gate").join(failed, "run_id").join(applicable, ["catalog_id", "definition_id"]).join(definitions.select("definition_id", "blocking"), "definition_id", "left")
    own = hits.groupBy("gate_id").agg(F.count_if(F.col("blocking") == F.col("target_gate")).alias("n_blocking"), F.array_sort(F.collect_list("definition_id")).alias("own_unpassed"))
    known = catalogs.select("catalog_id", F.col("phase").alias("own_phase"), F.col("gate").alias("own_gate"))
    none = F.array().cast(decisions.schema["unpassed"].dataType)
    broken = _codes(
        (~F.col("target_phase").eqNullSafe(F.col("own_phase")) | F.col("own_phase").isNull() | ~F.col("target_gate").eqNullSafe(F.col("own_gate")), "TARGET"),
        (_n("n_members") != _n("n_results"), "RESULTS"),
        (~F.col("required").eqNullSafe(_n("n_applicable")), "REQUIRED"),
        (~F.col("blocking_results").eqNullSafe(_n("n_blocking")), "BLOCKING"),
        (~F.col("unpassed").eqNullSafe(F.coalesce("own_unpassed", none)), "UNPASSED"),
        ((_n("n_blocking") == 0) != F.col("decision").eqNullSafe("pass"), "VERDICT"),
    )
    joined = decisions.join(known, "catalog_id", "left").join(m, "catalog_id", "left").join(r, "run_id", "left").join(own, "gate_id", "left")
    return joined.select("gate_id", F.explode(broken).alias("error"))


def gate_evaluation_closure(evaluations: DataFrame, units: DataFrame, attempts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each rule that an evaluation breaks over its unit's attempts, which are terminal once decided under its catalogue.

    ``evaluations``: evaluation_id, unit_id, expected_runs, observed_runs, result_set_hash, status. ``units``: unit_id,
    unit_runs, catalog_id. ``attempts``: unit_id, run_id, attempt_ordinal. ``decisions``: run_id, catalog_id, decision. The
    hash is over a unit's decided attempts in their order, so one unit's lines are one row; none gives null.
    """
    n = attempts.groupBy("unit_id").agg(F.count("*").alias("n_attempts"))
    decided = attempts.join(units.select("unit_id", "catalog_id"), "unit_id").join(decisions, ["run_id", "catalog_id"])
    line = F.struct("attempt_ordinal", F.concat_ws("|", F.col("run_id").cast("string"), "decision").alias("line"))
    t = decided.groupBy("unit_id").agg(
        F.count("*").alias("n_terminal"), F.count_if(F.col("decision") == "blocked").alias("n_blocked"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("own_hash"),
    )
    broken = _codes(
        (~F.col("expected_runs").eqNullSafe(F.col("unit_runs")), "EXPECTED"),
        (~F.col("observed_runs").eqNullSafe(_n("n_attempts")), "OBSERVED"),
        (~F.col("unit_runs").eqNullSafe(_n("n_attempts")), "INCOMPLETE"),
        (_n("n_terminal") != _n("n_attempts"), "NOT_TERMINAL"),
        (~F.col("result_set_hash").eqNullSafe(F.col("own_hash")), "HASH"),
        (~F.col("status").eqNullSafe(F.when(_n("n_blocked") > 0, "blocked").otherwise("closed")), "STATUS"),
    )
    joined = evaluations.join(units.select("unit_id", "unit_runs"), "unit_id", "left").join(n, "unit_id", "left").join(t, "unit_id", "left")
    return joined.select("evaluation_id", F.explode(broken).alias("error"))


def gate_selection(evaluations: DataFrame, members: DataFrame) -> DataFrame:
    """A blocked evaluation selects nothing, a closed one exactly one member, and that passed."""
    m = members.where("selected").groupBy("evaluation_id").agg(F.count("*").alias("picked"), F.count_if(F.col("result") == "passed").alias("good"))
    code = F.when((F.col("status") == "blocked") & (_n("picked") > 0), "BLOCKED_SELECTS").when((F.col("status") == "closed") & (_n("picked") != 1), "NOT_ONE").when((F.col("status") == "closed") & (_n("good") != 1), "SELECTED_NOT_PASSED")
    return evaluations.join(m, "evaluation_id", "left").withColumn("error", code).where("error is not null").select("evaluation_id", "error")


def detector_manifest(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per D05 key: entries, distinct versions, entries outside the inventory, valid, sha256 of its ordered entries.

    The hash is per key, not over all, so that no task holds the whole manifest.
    """
    pair = ["detector_id", "detector_version_id"]
    m = manifest.join(inventory.select(*pair, F.lit(True).alias("known")).distinct(), pair, "left")
    line = F.concat_ws("|", "detector_version_id", "detector_id")
    out = m.groupBy("d05_key").agg(F.count("*").alias("entries"), F.count_distinct("detector_version_id").alias("versions"), F.count_if(F.col("known").isNull()).alias("unlisted"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("manifest_hash"))
    return out.withColumn("valid", (F.col("versions") >= 2) & (F.col("unlisted") == 0))


def unknown_exploration(items: DataFrame, results: DataFrame) -> DataFrame:
    """Qualified unknown items need detector results, all no-candidate; others may have no candidate."""
    r = results.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "candidate").alias("candidates"), F.count_if(~F.col("decision").eqNullSafe("no-candidate")).alias("other"))
    unknown = F.col("domain").eqNullSafe("unknown") & F.col("publisher_role").eqNullSafe("unknown") & F.col("quality").eqNullSafe("qualified")
    code = F.when(unknown & ((_n("n") == 0) | (_n("other") > 0)), "UNKNOWN_NOT_EXHAUSTED").when(~unknown & (_n("candidates") > 0), "INELIGIBLE_CANDIDATE")
    return items.join(r, "item_id", "left").withColumn("error", code).where("error is not null").select("item_id", "error")


def exploration_eligibility(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items and decisions match one to one; no exploration unit where not eligible."""
    i = items.select("item_id", F.lit(True).alias("listed")).distinct()
    d = decisions.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("exploration_unit_id").isNotNull() & ~F.col("eligible")).alias("early"))
    broken = _codes((_n("n") == 0, "UNDECIDED"), (F.col("listed").isNull(), "UNKNOWN_ITEM"), (_n("n") > 1, "DECIDED_TWICE"), (_n("early") > 0, "UNIT_BEFORE_ELIGIBILITY"))
    return i.join(d, "item_id", "full_outer").select("item_id", F.explode(broken).alias("error"))


def evaluation_arm_closure(arms: DataFrame, rows: DataFrame) -> DataFrame:
    """Per arm: generated = terminal, selected = k = outputs, outputs distinct."""
    r = rows.groupBy("arm_id").agg(F.count("*").alias("generated"), F.count_if("terminal").alias("terminal"), F.count_if("selected").alias("selected"), F.count("output_id").alias("outputs"), F.count_distinct("output_id").alias("different"))
    broken = _codes((_n("generated") != _n("terminal"), "NOT_TERMINAL"), (_n("selected") != F.col("k"), "SELECTED_NOT_K"), (_n("outputs") != F.col("k"), "OUTPUTS_NOT_K"), (_n("outputs") != _n("different"), "OUTPUT_REPEATED"))
    return arms.join(r, "arm_id", "left").select("arm_id", F.explode(broken).alias("error"))


TERMINAL = ["pass", "fail", "blocked", "not_applicable"]


def gate_report(catalogues: DataFrame, required: DataFrame, results: DataFrame) -> DataFrame:
    """Per catalogue: required, observed, and how many are missing, failed, not applicable, unknown, invalid; then the verdict.

    An unsigned catalogue is blocked whatever its results. Ids stay in ``gate_faults``, so no row grows with the catalogue.
    """
    j = _gate_rows(required, results)
    n = j.groupBy("catalogue_id").agg(F.count("wanted").alias("required"), F.count("seen").alias("observed"), *[F.count_if(F.array_contains("faults", c)).alias(c) for c in ("missing", "failed", "not_applicable", "unknown", "invalid")])
    counts = ["required", "observed", "missing", "failed", "not_applicable", "unknown", "invalid"]
    out = catalogues.select("catalogue_id", "signed").join(n, "catalogue_id", "left").withColumns({c: _n(c) for c in counts})
    bad = sum((F.col(c) for c in counts[3:]), F.col("missing"))
    signed = F.coalesce("signed", F.lit(False))
    why = F.when(~signed, "CATALOG_SIGNATURE_UNVERIFIED").otherwise(F.array_join(_codes(
        (F.col("missing") > 0, "CATALOG_INCOMPLETE"), (F.col("unknown") > 0, "RESULT_ID_OUT_OF_SCOPE"), (F.col("invalid") > 0, "RESULT_STATUS_INVALID"), (F.col("failed") + F.col("not_applicable") > 0, "PHASE_EXIT_BLOCKED"), (bad == 0, "PHASE_EXIT_PASSED")), ","))
    return out.select("catalogue_id", *counts, why.alias("reason_codes"), F.when(signed & (bad == 0), "pass").otherwise("blocked").alias("decision"))


def _gate_rows(required: DataFrame, results: DataFrame) -> DataFrame:
    keys = ["catalogue_id", "definition_id"]
    want = required.select(*keys, F.lit(True).alias("wanted")).distinct()
    j = want.join(results.select(*keys, "result", F.lit(True).alias("seen")), keys, "full_outer")
    wanted, seen = F.col("wanted").isNotNull(), F.col("seen").isNotNull()
    r = F.coalesce("result", F.lit(""))
    return j.withColumn("faults", _codes((~seen, "missing"), (wanted & r.isin("fail", "blocked"), "failed"), (wanted & (r == "not_applicable"), "not_applicable"), (~wanted, "unknown"), (seen & ~r.isin(TERMINAL), "invalid")))


def gate_faults(required: DataFrame, results: DataFrame) -> DataFrame:
    """The ids behind the counts of ``gate_report``, one row a fault."""
    return _gate_rows(required, results).select("catalogue_id", "definition_id", F.explode("faults").alias("fault"))


def catalog_closure(catalogues: DataFrame, definitions: DataFrame, members: DataFrame) -> DataFrame:
    """Per catalogue (target phase, policy, stated hash): latest definitions up to the phase against its members.

    Members are hashed per catalogue in order of id; a catalogue's member count bounds that group.
    """
    latest = definitions.groupBy("catalogue_id", "test_id").agg(F.max_by(F.struct("definition_id", "phase"), F.struct("revision", "definition_id", "phase")).alias("d")).select("catalogue_id", "d.*")
    due = latest.join(catalogues.select("catalogue_id", "target_phase"), "catalogue_id").where("phase <= target_phase").select("catalogue_id", "definition_id", F.lit(True).alias("due"))
    v = definitions.select("definition_id", "severity", F.col("policy").alias("own_policy"))
    m = members.select("catalogue_id", "definition_id", "membership").join(v, "definition_id", "left").withColumn("member", F.lit(True))
    j = m.join(due, ["catalogue_id", "definition_id"], "full_outer").join(catalogues.select("catalogue_id", "policy"), "catalogue_id")
    line = F.when(F.col("member"), F.struct("definition_id", F.concat_ws("|", F.col("definition_id").cast("string"), F.col("membership")).alias("l")))
    n = j.groupBy("catalogue_id").agg(
        F.count("due").alias("expected"), F.count("member").alias("members"), F.count_if((F.col("membership") == "excluded") & (F.col("severity") == "P0")).alias("p0_excluded"),
        F.count_if(F.col("own_policy") != F.col("policy")).alias("policy_differs"), F.count_if(F.col("due").isNull() | F.col("member").isNull()).alias("set_differs"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n"), 256).alias("own_hash"),
    )
    out = catalogues.select("catalogue_id", "stated_hash").join(n, "catalogue_id", "left")
    counts = ["expected", "members", "p0_excluded", "policy_differs", "set_differs"]
    out = out.withColumns({c: _n(c) for c in counts})
    ok = (F.col("expected") > 0) & (F.col("members") == F.col("expected")) & (F.col("p0_excluded") + F.col("policy_differs") + F.col("set_differs") == 0) & F.col("own_hash").eqNullSafe(F.col("stated_hash"))
    return out.select("catalogue_id", *counts, ok.alias("closed"))

"""Row-wise decisions: purposes, receipts, outputs, tokens, claims, catalogue filters. No shuffle but where a table is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from signalframe.functions.canonical import canonical_json
from signalframe.functions.text import uuid5

# Claims each purpose requires.
PURPOSE_CLAIMS = {
    "O_acquire": ["rights_grant", "authorized_scope", "purpose_authorization"],
    "O_extract": ["rights_grant", "authorized_scope", "purpose_authorization"],
    "O_model:local": ["rights_grant", "authorized_scope", "purpose_authorization", "local_processor"],
    "O_model:{provider_id}": ["rights_grant", "authorized_scope", "purpose_authorization", "provider_identity"],
    "O_train:{model_id,purpose}": ["rights_grant", "authorized_scope", "purpose_authorization", "training_authorization", "deletion_contract", "model_identity"],
    "O_signal": ["rights_grant", "purpose_authorization", "signal_processor"],
    "O_display": ["rights_grant", "authorized_scope", "purpose_authorization", "display_scope", "transform_allowlist", "revocation_epoch"],
    "O_prevalence": ["coverage_policy", "denominator_eligibility"],
}
# Sinks that no model output may reach.
GLOBAL_SINKS = ["global_long_term_log", "global_cache", "global_embedding", "global_training"]
PLACEHOLDERS = {"{provider_id}": "[^:]+", "{model_id,purpose}": "[^,]+,[^:]+"}


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _first(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that is true; null where none is (a null rule doesn't hold)."""
    out = F.lit(None).cast("string")
    for rule, code in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), code).otherwise(out)
    return out


def required_claims(purpose: Column) -> Column:
    """The claims of the first purpose that matches, placeholders included; null for an unknown purpose."""
    out = F.lit(None).cast("array<string>")
    for name, claims in reversed(PURPOSE_CLAIMS.items()):
        head, brace, tail = name.partition("{")
        hit = purpose.rlike(f"\\A{head}{PLACEHOLDERS[brace + tail]}\\z") if brace else purpose == name
        out = F.when(hit, F.array(*map(F.lit, claims))).otherwise(out)
    return out


def purpose_eligibility(requests: DataFrame) -> DataFrame:
    """``purpose``, ``authorization``, ``claims`` (those that hold) -> ``decision``, ``reason_code``, ``missing_claims``.

    Denied unless authorized and no claim is missing; an unknown purpose is PURPOSE_UNKNOWN with no claims listed.
    """
    wanted = required_claims(F.col("purpose"))
    missing = F.coalesce(F.array_except(wanted, F.coalesce(F.col("claims"), F.array().cast("array<string>"))), F.array().cast("array<string>"))
    kind = F.upper(F.translate(F.split_part("purpose", F.lit(":"), F.lit(1)), "O_", ""))
    denied = F.when(F.col("purpose").startswith("O_train"), "PURPOSE_TRAIN_DENIED").otherwise(F.concat(F.lit("PURPOSE_"), kind, F.lit("_DENIED")))
    bad = ~F.col("authorization").eqNullSafe("allow") | (F.size("missing_claims") > 0)
    out = requests.withColumn("missing_claims", missing).withColumn("reason_code", F.when(wanted.isNull(), "PURPOSE_UNKNOWN").when(bad, denied))
    return out.withColumn("decision", F.when(F.col("reason_code").isNull(), "allow").otherwise("deny"))


def output_rules(outputs: DataFrame) -> DataFrame:
    """Purpose first, then the invocation's revocation hash, the sink, and the output's revocation hash."""
    later = _first(
        (~F.col("snapshot_hash").eqNullSafe(F.col("expected_hash")), "REVOCATION_DEPENDENCY_MISMATCH"),
        (~present(F.col("sink")) | (F.col("purpose").startswith("O_model") & F.col("sink").isin(GLOBAL_SINKS)), "OUTPUT_SINK_DENIED"),
        (~F.col("output_hash").eqNullSafe(F.col("snapshot_hash")), "OUTPUT_REVOCATION_DEPENDENCY_MISMATCH"),
    )
    out = purpose_eligibility(outputs).withColumn("reason_code", F.coalesce("reason_code", later))
    return out.withColumn("decision", F.when(F.col("reason_code").isNull(), "allow").otherwise("deny"))


def receipt_rules(receipts: DataFrame) -> DataFrame:
    """Set closed, dependency equal, then the proof that the mode asks for."""
    proof = lambda *names: ~F.forall(F.array(*[present(F.col(n)) for n in names]), lambda c: c)
    plain = F.coalesce(F.col("mode").isin("sync", "poll", "download"), F.lit(False))
    callback = F.col("mode").eqNullSafe("callback")
    code = _first(
        (~F.coalesce(F.col("closed"), F.lit(False)), "RESPONSE_SET_NOT_CLOSED"),
        (~F.col("output_hash").eqNullSafe(F.col("invocation_hash")), "RESPONSE_DEPENDENCY_MISMATCH"),
        (callback & proof("provider_signature", "nonce", "provider_job_id", "captured_exchange_id", "authenticated_peer"), "CALLBACK_PROOF_INCOMPLETE"),
        (plain & proof("captured_exchange_id", "authenticated_peer", "raw_response_hash"), "RESPONSE_PROOF_INCOMPLETE"),
        (plain & (present(F.col("provider_signature")) | present(F.col("nonce"))), "NON_CALLBACK_HAS_CALLBACK_PROOF"),
        (~plain & ~callback, "RESPONSE_MODE_UNSUPPORTED"),
    )
    return receipts.withColumn("reason_code", code).withColumn("decision", F.when(F.col("reason_code").isNull(), "allow").otherwise("deny"))


def token_scope(requests: DataFrame, fields: list[str]) -> DataFrame:
    """Token and request agree on every field (``token_x`` and ``request_x``) and the asked member is in the request's list."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"token_{f}").eqNullSafe(F.col(f"request_{f}"))
    ok = same & F.coalesce(F.array_contains("member_ids", F.col("requested_member_id")), F.lit(False))
    return requests.withColumns({"decision": F.when(ok, "allow").otherwise("blocked"), "reason_code": F.when(~ok, "RADAR_VIEW_TOKEN_SCOPE_MISMATCH"), "bytes_allowed": ok})


def stale_view(tokens: DataFrame, epochs: DataFrame, key: str) -> DataFrame:
    """A token whose rights epoch isn't the current one of its surface shows nothing until recomputed; an unknown epoch is stale."""
    current = epochs.select(key, F.col("rights_epoch").alias("current_epoch"))
    stale = ~F.col("rights_epoch").eqNullSafe(F.col("current_epoch")) | F.col("current_epoch").isNull()
    out = tokens.join(current, key, "left").withColumn("stale", stale)
    return out.withColumns({"state": F.when(F.col("stale"), "RADAR_VIEW_RECOMPUTING").otherwise(F.col("stage")), "bytes_allowed": ~F.col("stale")})


def report_claim_rules(claims: DataFrame, scopes: DataFrame) -> DataFrame:
    """First broken rule of each claim. ``scopes``: the scope records (claim_id, evidence_scope_id, item_version_id) of claims.

    Facts need an item version, evidence that entails, no premises, and scope records with the claim's ids (repeats
    counted) of the claim's version; inference needs not_applicable, premises and a support status.
    """
    own = scopes.groupBy("claim_id").agg(
        F.array_sort(F.collect_list("evidence_scope_id")).alias("record_ids"), F.count("*").alias("records"),
        F.count_if(~present(F.col("evidence_scope_id")) | ~present(F.col("item_version_id"))).alias("blanks"), F.collect_set("item_version_id").alias("versions"),
    )
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    fact, inference = F.col("claim_type").isin("external_world_state", "source_claim"), F.col("claim_type").eqNullSafe("ai_inference")
    fact = F.coalesce(fact, F.lit(False))
    conflict = fact & F.array_contains(texts("reason_codes"), "SOURCE_CONFLICT")
    code = _first(
        (fact & ~present(F.col("item_version_id")), "CLAIM_ITEM_VERSION_MISSING"),
        (fact & (F.size(texts("evidence_scope_ids")) == 0), "CLAIM_EVIDENCE_MISSING"),
        (fact & ~F.col("entailment_result").eqNullSafe("entailed"), "EVIDENCE_NOT_ENTAILED"),
        (fact & (F.size(texts("premise_scope_ids")) > 0), "FACT_HAS_PREMISES"),
        (fact & (F.col("records").isNull() | (F.col("blanks") > 0)), "CLAIM_EVIDENCE_MISSING"),
        (fact & (F.col("record_ids") != F.array_sort(texts("evidence_scope_ids"))), "CLAIM_SCOPE_MISMATCH"),
        (fact & F.exists("versions", lambda v: v != F.col("item_version_id")), "CLAIM_SCOPE_MISMATCH"),
        (conflict & ~F.col("epistemic_status").eqNullSafe("disputed"), "SOURCE_CONFLICT_REQUIRES_DISPUTED"),
        (conflict & (F.size(F.array_distinct(texts("conflicting_source_claim_ids"))) < 2), "SOURCE_CONFLICT_SOURCES_MISSING"),
        (inference & ~F.col("entailment_result").eqNullSafe("not_applicable"), "INFERENCE_ENTAILMENT"),
        (inference & (F.size(texts("premise_scope_ids")) == 0), "INFERENCE_PREMISES_MISSING"),
        (inference & ~F.coalesce(F.col("inference_support_status").isin("supported", "unsupported"), F.lit(False)), "INFERENCE_SUPPORT_MISSING"),
        (~fact & ~inference, "CLAIM_TYPE_UNSUPPORTED"),
    )
    facts = claims.join(own, "claim_id", "left").withColumn("error", code)
    return facts.drop("record_ids", "records", "blanks", "versions")


def contains(actual: Column, expected: str) -> Column:
    """Case-insensitive substring; null holds nothing but the empty text."""
    return F.contains(F.lower(F.coalesce(actual.cast("string"), F.lit(""))), F.lit(expected.lower()))


def nested_catalog_filter(projects: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Projects that match every project filter, with the components that match all component filters at once.

    Columns: ``id, repository, categories, license, disposition, components array<struct<id, targets, priority, mode>>``.
    Filters: project, category, license, disposition, search; target, priority, mode, component. Others raise ValueError.
    """
    project = {
        "project": lambda v: contains(F.col("id"), v) | contains(F.col("repository"), v),
        "category": lambda v: F.exists("categories", lambda c: contains(c, v)),
        "license": lambda v: contains(F.col("license"), v),
        "disposition": lambda v: contains(F.col("disposition"), v),
        "search": lambda v: contains(F.to_json(F.struct(*projects.columns)), v),
    }
    component = {
        "target": lambda c, v: F.exists(c["targets"], lambda t: contains(t, v)),
        "priority": lambda c, v: contains(c["priority"], v),
        "mode": lambda c, v: contains(c["mode"], v),
        "component": lambda c, v: contains(c["id"], v),
    }
    unknown = set(filters) - set(project) - set(component)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = projects
    for name in filters.keys() & project.keys():
        out = out.where(project[name](filters[name]))

    def matches(c: Column) -> Column:
        held = F.lit(True)
        for name in filters.keys() & component.keys():
            held = held & component[name](c, filters[name])
        return held

    return out.withColumn("components", F.filter("components", matches)).where(F.size("components") > 0)


def signal_allocation(candidates: DataFrame) -> DataFrame:
    """Both signal types, exactly one lane, sections that are there and differ."""
    types = lambda t: F.coalesce(F.array_contains("signal_types", t), F.lit(False))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    code = _first(
        (~types("emergence") | ~types("diffusion"), "TYPES_MISSING"),
        (n("allocation_lanes") != 1, "LANE_NOT_ONE"),
        ((n("surface_sections") < 1) | (n("surface_sections") != F.size(F.array_distinct("surface_sections"))), "SECTIONS_INVALID"),
    )
    return candidates.withColumn("error", code)


# The domains that a set must have, in the order of their names.
DOMAINS = ("global", "personal", "rights")


def revocation_set_hash(rows: DataFrame, domains: dict[str, str], epochs: str) -> Column:
    """sha256 of the canonical JSON of the three domains, by name, and then the epochs; for ``select`` on ``rows``.

    ``domains`` names a column for each of DOMAINS, ``epochs`` another; all may be nested to any depth, and keys in another
    order give the same hash. A missing domain is a ValueError; a null one is ``null``, as a value is.
    """
    missing = set(DOMAINS) - set(domains)
    if missing:
        raise ValueError(f"revocation dependency domains missing: {sorted(missing)}")
    part = lambda name, column: F.concat(F.lit(f'"{name}":'), canonical_json(F.col(column), rows.schema[column].dataType))
    inside = [*[part(d, domains[d]) for d in DOMAINS], part("epochs", epochs)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *inside), F.lit("}")), 256)


def projection_key(rows: DataFrame, fields: list[str], namespace_hex: str) -> tuple[Column, Column]:
    """The fields joined by ``|`` and its name-based UUID; null where any field is null. For ``select`` on ``rows``.

    A list of plain values is joined by ``,``; any other nested value is written as the database writes JSON: keys by
    length, then name, spaces after colons and commas.
    """

    def text(name: str) -> Column:
        kind = rows.schema[name].dataType
        plain = isinstance(kind, ArrayType) and not isinstance(kind.elementType, (ArrayType, MapType, StructType))
        if plain:
            return F.when(F.col(name).isNotNull(), F.array_join(F.col(name).cast("array<string>"), ","))
        nested = isinstance(kind, (ArrayType, MapType, StructType))
        return F.when(F.col(name).isNotNull(), canonical_json(F.col(name), kind, jsonb=True)) if nested else F.col(name).cast("string")

    key = text(fields[0])
    for f in fields[1:]:
        key = F.concat(key, F.lit("|"), text(f))
    return key, uuid5(namespace_hex, key)


def decline_breaker(declines: DataFrame, health: DataFrame, key: str, least: float) -> DataFrame:
    """A decline counts only with healthy collection and an available baseline; missing health suppresses."""
    h = health.select(key, "health", "baseline_available")
    code = _first((F.col("health").isNull() | (F.col("health") < least), "COLLECTION_UNHEALTHY"), (~F.coalesce(F.col("baseline_available"), F.lit(False)), "BASELINE_UNAVAILABLE"))
    return declines.join(h, key, "left").withColumn("suppressed_by", F.when(F.col("decline"), code)).withColumn("reported", F.col("decline") & F.col("suppressed_by").isNull())


def raw_evidence_visible(cards: DataFrame) -> DataFrame:
    """Without the model's judgment; the columns of raw evidence must exist (ValueError), rows are kept as they are."""
    lacking = {"title", "source", "published_at", "license_scope", "evidence", "coverage_boundary"} - set(cards.columns)
    if lacking:
        raise ValueError(f"raw evidence columns missing: {sorted(lacking)}")
    return cards.withColumn("ai_judgment", F.lit(None).cast("string"))


def confidence_passthrough(rows: DataFrame) -> DataFrame:
    """Both confidences are there; magnitude and allocation pass unchanged whatever they are."""
    code = _first((~present(F.col("observation_confidence").cast("string")), "OBSERVATION_CONFIDENCE_MISSING"), (~present(F.col("evidence_confidence").cast("string")), "EVIDENCE_CONFIDENCE_MISSING"))
    return rows.withColumn("error", code)


def model_retire(models: DataFrame) -> DataFrame:
    """Retired with nothing to recompute, if the audit fields are filled; the empty ones are listed otherwise."""
    lists = ["input_manifest", "output_artifact_ids", "evidence_ids"]
    empty = [F.when(~present(F.col(c)), c) for c in ("model_id", "config_hash")] + [F.when(F.coalesce(F.size(c), F.lit(0)) < 1, c) for c in lists]
    out = models.withColumn("missing_fields", F.array_compact(F.array(*empty)))
    ok = F.size("missing_fields") == 0
    return out.withColumns({"status": F.when(ok, "retired").otherwise(F.col("status")), "recompute_required": F.when(ok, F.lit(False)).otherwise(F.col("recompute_required"))})


def action_stage(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """More mentions at the same action stage with the missing evidence named: attention without action."""
    b = baseline.select(key, F.col("mentions").alias("baseline_mentions"), F.col("stage").alias("baseline_stage"))
    j = current.join(b, key, "left")
    code = _first(
        (F.coalesce(F.col("mentions") <= F.col("baseline_mentions"), F.lit(True)), "ATTENTION_NOT_INCREASED"),
        (~F.col("stage").eqNullSafe(F.col("baseline_stage")), "ACTION_STAGE_CHANGED"),
        (F.coalesce(F.size("missing_evidence"), F.lit(0)) < 1, "MISSING_EVIDENCE_NOT_NAMED"),
    )
    out = j.withColumn("error", code).withColumn("attention_delta", F.col("mentions") - F.col("baseline_mentions"))
    return out.withColumn("interpretation", F.when(F.col("error").isNull(), "attention_without_action"))

"""Reads that bind a row to another that is valid at its time: profiles, authorizations, credentials, keys, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(begin: Column, end: Column, at: Column) -> Column:
    """Half-open; a null end is open."""
    return (begin <= at) & (end.isNull() | (at < end))


def _coded(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    out = F.lit(None).cast("string")
    for rule, code in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(True)), code).otherwise(out)  # a rule that can't be decided is broken
    return df.withColumn("error", out)


def purpose_asof(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (version, purpose, processor, at, display_chars, transform) by the one grant of the three keys."""
    keys = ["version_id", "purpose", "processor"]
    g = grants.select(*keys, F.col("decision").alias("granted"), "checked_at", "expires_at", "max_display_chars", "allowed_transform")
    j = requests.join(g, keys, "left")
    display = (F.col("purpose") == "O_display") & (F.col("max_display_chars").isNull() | (F.col("display_chars") > F.col("max_display_chars")))
    ok = (F.col("granted") == "allow") & (F.col("at") >= F.col("checked_at")) & (F.col("at") < F.col("expires_at")) & ~display & (F.col("allowed_transform").isNull() | (F.col("allowed_transform") == F.col("transform")))
    kind = F.upper(F.replace(F.split_part("purpose", F.lit(":"), F.lit(1)), F.lit("O_"), F.lit("")))
    reason = F.concat(F.lit("PURPOSE_"), kind, F.lit("_DENIED"))
    return j.withColumn("reason_code", F.when(~F.coalesce(ok, F.lit(False)), reason)).select(*requests.columns, "reason_code")


def credential_usable(requests: DataFrame, credentials: DataFrame, states: DataFrame) -> DataFrame:
    """Latest state (by revision) active, audience equal, scope listed, inside its time."""
    now = states.groupBy("credential_id").agg(F.max_by("state", F.struct("revision", "state")).alias("current_state"))
    c = credentials.select("credential_id", F.col("audience").alias("own_audience"), "allowed_scopes", "effective_from", "expires_at")
    j = requests.join(c, "credential_id", "left").join(now, "credential_id", "left")
    ok = (F.col("current_state") == "active") & (F.col("own_audience") == F.col("audience")) & F.array_contains("allowed_scopes", F.col("scope")) & (F.col("at") >= F.col("effective_from")) & (F.col("at") < F.col("expires_at"))
    return j.withColumn("usable", F.coalesce(ok, F.lit(False))).select(*requests.columns, "usable")


def signing_key_authorized(manifests: DataFrame, keys: DataFrame, purpose: str) -> DataFrame:
    """First broken rule of each signed manifest."""
    k = keys.select("key_id", "key_state", "key_purpose", "authorized_kinds", F.col("effective_from").alias("key_from"), F.col("expires_at").alias("key_until"))
    j = manifests.join(k, "key_id", "left")
    inside = lambda at: (F.col(at) >= F.col("key_from")) & (F.col(at) < F.col("key_until"))
    out = _coded(
        j,
        (~F.col("verified") | F.col("key_id").isNull() | F.col("signed_at").isNull(), "SIGNATURE_NOT_VERIFIED"),
        (F.col("key_state").isNull(), "KEY_MISSING"),
        ((F.col("key_state") != "active") | (F.col("key_purpose") != purpose) | ~F.array_contains("authorized_kinds", F.col("kind")), "KEY_NOT_AUTHORIZED"),
        (~inside("signed_at") | ~inside("effective_at"), "OUTSIDE_KEY_VALIDITY"),
        ((F.col("signed_at") > F.col("available_at")) | F.col("owner_id").isNull(), "SIGNED_AFTER_AVAILABLE"),
    )
    return out.select(*manifests.columns, "error")


def asof_profile_join(snapshots: DataFrame, profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """Snapshots whose profile and activation aren't both valid at ``linearization_at`` and at ``as_of``, or don't agree."""
    p = profiles.select("profile_id", F.col("snapshot_type").alias("p_type"), F.col("scope_key").alias("p_scope"), F.col("activation_id").alias("p_activation"), F.col("effective_from").alias("p_from"), F.col("effective_until").alias("p_until"))
    a = activations.select("activation_id", F.col("target_id").alias("a_target"), F.col("role").alias("a_role"), F.col("effective_from").alias("a_from"), F.col("effective_until").alias("a_until"))
    j = snapshots.join(p, "profile_id", "left").join(a, "activation_id", "left")
    both = lambda x: holds(F.col(f"{x}_from"), F.col(f"{x}_until"), F.col("linearization_at")) & holds(F.col(f"{x}_from"), F.col(f"{x}_until"), F.col("as_of"))
    out = _coded(
        j,
        (F.col("a_role").isNull() | F.col("p_type").isNull(), "BINDING_MISSING"),
        ((F.col("a_role") != "authoritative") | (F.col("a_target") != F.col("profile_id")) | (F.col("p_activation") != F.col("activation_id")), "ACTIVATION_MISMATCH"),
        ((F.col("p_type") != F.col("snapshot_type")) | (F.col("p_scope") != F.col("scope_key")), "SCOPE_MISMATCH"),
        (~both("p"), "PROFILE_NOT_VALID"),
        (~both("a"), "ACTIVATION_NOT_VALID"),
    )
    return out.select(*snapshots.columns, "error")


def snapshot_role_join(units: DataFrame, roles: DataFrame) -> DataFrame:
    """Units, and selected members, whose kind differs from their role's."""
    r = roles.select("profile_id", "role", F.col("subject_kind").alias("role_subject"), F.col("selected_kind").alias("role_selected"))
    j = units.join(r, ["profile_id", "role"])
    wrong = F.array_compact(F.array(F.when(F.col("subject_kind") != F.col("role_subject"), "SUBJECT_KIND"), F.when((F.col("decision") == "selected") & (F.col("selected_kind") != F.col("role_selected")), "SELECTED_KIND")))
    return j.select("unit_id", F.explode(wrong).alias("error"))

"""Who may approve, activate and revoke: envelopes against current subjects, receipts against events, and rule years.

Signatures are checked elsewhere and enter as a column; here is what a table can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.operators.changes import chain_violations
from fieldwise.operators.releases import rows_digest
from fieldwise.operators.rules import check_conditions

#: Fixed reasons for which a year's rules may be revoked.
REVOKE_REASONS = ("COURT_DECISION", "GAZETTE_REPEAL", "SOURCE_ERROR", "SIGNATURE_COMPROMISED")


def audit_complete(subjects: DataFrame, events: DataFrame, receipts: DataFrame, as_of: Column) -> DataFrame:
    """subjects (subject_id) with ``complete``: two events and two receipts, of a reviewer and an approver, each receipt with its event's payload hash and still retained.

    events: subject_id, role, payload_sha256; receipts: subject_id, role, payload_sha256, retained_until."""
    n_events = events.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_events"))
    own = events.groupBy("subject_id", "role").agg(F.max("payload_sha256").alias("_sha"))
    paired = receipts.join(own, ["subject_id", "role"], "left")
    sums = paired.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("role").isin("REVIEWER", "APPROVER"), F.col("role"))).alias("roles"),
        F.bool_and(F.coalesce((F.col("_sha") == F.col("payload_sha256")) & (F.col("retained_until") > as_of), F.lit(False))).alias("sound"),
    )
    rows = subjects.select("subject_id").join(n_events, "subject_id", "left").join(sums, "subject_id", "left")
    return rows.select("subject_id", F.coalesce((F.col("n_events") == 2) & (F.col("n") == 2) & (F.col("roles") == 2) & F.col("sound"), F.lit(False)).alias("complete"))


def _against(envelopes: DataFrame, subjects: DataFrame, keys: DataFrame) -> DataFrame:
    own = subjects.select("subject_id", F.col("digest").alias("_digest"), F.col("source_sha256").alias("_source"))
    return envelopes.join(own, "subject_id", "left").join(keys.select("principal_id", F.col("role").alias("_role")).dropDuplicates(["principal_id"]), "principal_id", "left")


def register_approvals(envelopes: DataFrame, subjects: DataFrame, keys: DataFrame, existing: DataFrame) -> DataFrame:
    """envelopes (envelope_id, subject_id, role, principal_id, subject_digest, source_sha256, signature_valid) with ``outcome``: REGISTERED, or NO_SUBJECT, KEY_ROLE, DIGEST, SOURCE, SIGNATURE, DUPLICATE.

    One attestation a role: existing ones count, and of several in a batch the first by id. keys: principal_id and the role that its key is trusted for."""
    rows = _against(envelopes, subjects, keys)
    there = existing.select("subject_id", "role", F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, ["subject_id", "role"], "left")
    why = (
        F.when(F.col("_digest").isNull(), "NO_SUBJECT").when(~F.col("_role").eqNullSafe(F.col("role")), "KEY_ROLE").when(~F.col("subject_digest").eqNullSafe(F.col("_digest")), "DIGEST")
        .when(~F.col("source_sha256").eqNullSafe(F.col("_source")), "SOURCE").when(~F.coalesce("signature_valid", F.lit(False)), "SIGNATURE").when(F.col("_there"), "DUPLICATE")
    )
    rows = rows.withColumn("why", why)
    nth = F.row_number().over(Window.partitionBy("subject_id", "role", F.col("why").isNull()).orderBy("envelope_id"))
    return rows.withColumn("nth", nth).select("envelope_id", F.coalesce("why", F.when(F.col("nth") > 1, F.lit("DUPLICATE")).otherwise("REGISTERED")).alias("outcome"))


def register_revocations(envelopes: DataFrame, subjects: DataFrame, keys: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """envelopes (envelope_id, subject_id, principal_id, subject_digest, source_sha256, reason, signed_at, signature_valid) with ``outcome``: REGISTERED, or NO_SUBJECT, NOT_APPROVER, MISMATCH, NO_REASON, FUTURE, SIGNATURE, DUPLICATE.

    A revocation is final, so a subject has one at most."""
    rows = _against(envelopes, subjects, keys).join(existing.select("subject_id", F.lit(True).alias("_there")).distinct(), "subject_id", "left")
    why = (
        F.when(F.col("_digest").isNull(), "NO_SUBJECT").when(~F.col("_role").eqNullSafe(F.lit("APPROVER")), "NOT_APPROVER")
        .when(~F.col("subject_digest").eqNullSafe(F.col("_digest")) | ~F.col("source_sha256").eqNullSafe(F.col("_source")), "MISMATCH").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "NO_REASON")
        .when(F.coalesce(F.col("signed_at") > now, F.lit(True)), "FUTURE").when(~F.coalesce("signature_valid", F.lit(False)), "SIGNATURE").when(F.col("_there"), "DUPLICATE")
    )
    rows = rows.withColumn("why", why)
    nth = F.row_number().over(Window.partitionBy("subject_id", F.col("why").isNull()).orderBy("envelope_id"))
    return rows.withColumn("nth", nth).select("envelope_id", F.coalesce("why", F.when(F.col("nth") > 1, F.lit("DUPLICATE")).otherwise("REGISTERED")).alias("outcome"))


def draft_preview(candidates: DataFrame, violations: DataFrame, year: Column, known: Column) -> DataFrame:
    """candidates (rule_no, production_year, official_unit_amount, conditions, and the facts that ``known`` uses) to (rule_no, status, simulated, reason). A draft is always in REVIEW; its amount is shown if it is valid, of the year, and all conditions are met."""
    rows = candidates.join(violations.select("rule_no").distinct().withColumn("_bad", F.lit(True)), "rule_no", "left").withColumn("_checks", check_conditions(F.col("conditions"), known))
    reason = (
        F.when(F.col("_bad"), "INVALID").when(~F.col("production_year").eqNullSafe(year), "WRONG_YEAR").when(F.array_contains("_checks", "UNKNOWN"), "MISSING_FACTS").when(F.array_contains("_checks", "NOT_MATCHED"), "EXCLUDED").otherwise("SIMULATED")
    )
    return rows.withColumn("reason", reason).select("rule_no", F.lit("REVIEW").alias("status"), F.when(F.col("reason") == "SIMULATED", F.col("official_unit_amount")).alias("simulated"), "reason")


def rule_digests(rules: DataFrame, columns: list[str]) -> DataFrame:
    """(production_year, n_rows, rules_digest): the digest of a year's rules in the order of their numbers."""
    return rows_digest(rules, ["production_year"], ["rule_no"], columns, "rules_digest")


def activate(rules: DataFrame, attestations: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rules after activation, and (production_year, outcome, rules_digest) of each attested year.

    attestations (production_year, role, actor_id, public_key, rules_digest, signature_valid). A year is ACTIVATED, and its rules VERIFIED, if it has exactly a legal reviewer and a legal approver, who are two
    actors with two keys, whose signatures are valid and over the digest of the rules as they are; else it says why not: NO_RULES, ROLES, SAME_ACTOR, SAME_KEY, DIGEST, SIGNATURE."""
    digests = rule_digests(rules, columns)
    rows = attestations.join(digests.select("production_year", F.col("rules_digest").alias("_digest")), "production_year", "left")
    found = rows.groupBy("production_year").agg(
        F.array_sort(F.collect_list("role")).alias("roles"), F.count_distinct("actor_id").alias("actors"), F.count_distinct("public_key").alias("keys"), F.max("_digest").alias("rules_digest"),
        F.bool_and(F.coalesce(F.col("rules_digest") == F.col("_digest"), F.lit(False))).alias("same"), F.bool_and(F.coalesce("signature_valid", F.lit(False))).alias("signed"),
    )
    wanted = F.array(F.lit("LEGAL_APPROVER"), F.lit("LEGAL_REVIEWER"))
    outcome = (
        F.when(F.col("rules_digest").isNull(), "NO_RULES").when(F.col("roles") != wanted, "ROLES").when(F.col("actors") != 2, "SAME_ACTOR").when(F.col("keys") != 2, "SAME_KEY").when(~F.col("same"), "DIGEST").when(~F.col("signed"), "SIGNATURE").otherwise("ACTIVATED")
    )
    years = found.select("production_year", outcome.alias("outcome"), "rules_digest")
    done = years.where("outcome = 'ACTIVATED'").select("production_year", F.lit(True).alias("_done"))
    after = rules.join(F.broadcast(done), "production_year", "left").withColumn("review_status", F.when(F.col("_done"), "VERIFIED").otherwise(F.col("review_status"))).select(rules.columns)  # one row a year
    return after, years


def activation_events(years: DataFrame, attestations: DataFrame) -> DataFrame:
    """(production_year, nth, event_type, actor_id, rules_digest): for each activated year the review, the approval and the activation, in that order, for the audit chain."""
    rows = attestations.join(years.where("outcome = 'ACTIVATED'").select("production_year", F.col("rules_digest").alias("_digest")), "production_year")
    reviewed = F.col("role") == "LEGAL_REVIEWER"
    signed = rows.select("production_year", F.when(reviewed, 1).otherwise(2).alias("nth"), F.when(reviewed, "ATTESTATION_REVIEW").otherwise("ATTESTATION_APPROVAL").alias("event_type"), "actor_id", F.col("_digest").alias("rules_digest"))
    last = years.where("outcome = 'ACTIVATED'").select("production_year", F.lit(3).alias("nth"), F.lit("RULE_ACTIVATION").alias("event_type"), F.lit("SYSTEM_PIPELINE").alias("actor_id"), "rules_digest")
    return signed.union(last)


def revoke(rules: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules after revocation requests (production_year, actor_id, reason), and (production_year, actor_id, reason, outcome, n_rules): REVOKED, or REASON for one that isn't on the list. Verified rules of a revoked year are REVOKED."""
    n = rules.where("review_status = 'VERIFIED'").groupBy("production_year").agg(F.count(F.lit(1)).alias("n_rules"))
    listed = F.coalesce(F.col("reason").isin(*REVOKE_REASONS), F.lit(False))
    log = requests.join(n, "production_year", "left").select("production_year", "actor_id", "reason", F.when(listed, "REVOKED").otherwise("REASON").alias("outcome"), F.when(listed, F.coalesce("n_rules", F.lit(0))).otherwise(0).cast("long").alias("n_rules"))
    gone = log.where("outcome = 'REVOKED'").select("production_year").distinct().withColumn("_gone", F.lit(True))
    after = rules.join(gone, "production_year", "left").withColumn("review_status", F.when(F.col("_gone") & (F.col("review_status") == "VERIFIED"), "REVOKED").otherwise(F.col("review_status"))).select(rules.columns)
    return after, log


def activation_status(rules: DataFrame, years: DataFrame, revocations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(production_year, activation_status, n_draft, n_verified, n_revoked, chain_ok): the state of each year that has rules, and whether the audit chain (one for all years) is intact."""
    counts = rules.groupBy("production_year").agg(*[F.count_if(F.col("review_status") == s).alias(f"n_{s.lower()}") for s in ("DRAFT", "VERIFIED", "REVOKED")])
    active = years.where("outcome = 'ACTIVATED'").select("production_year", F.lit(True).alias("_active"))
    gone = revocations.where("outcome = 'REVOKED'").select("production_year", F.lit(True).alias("_gone")).distinct()
    broken = chain_violations(blocks).agg((F.count(F.lit(1)) == 0).alias("chain_ok"))  # one row
    rows = counts.join(active, "production_year", "left").join(gone, "production_year", "left").crossJoin(F.broadcast(broken))
    status = F.when(F.col("_gone") & F.col("_active"), "REVOKED").when(F.col("_active"), "ACTIVE").otherwise("NOT_ACTIVATED")
    return rows.select("production_year", status.alias("activation_status"), "n_draft", "n_verified", "n_revoked", "chain_ok")


def bundle_manifest(files: DataFrame) -> DataFrame:
    """files (bundle, name, content) to (bundle, nth, name, sha256) in the order of names, as an evidence bundle lists them."""
    nth = F.row_number().over(Window.partitionBy("bundle").orderBy("name"))
    return files.select("bundle", nth.alias("nth"), "name", F.sha2("content", 256).alias("sha256"))


def package_verdict(members: DataFrame, manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """(bundle, n_members, bad, verdict) of packages: members (bundle, name, content) against manifest (bundle, name, sha256), and the package's rules (bundle, review_status).

    bad: names that only one side has, or whose hashes differ. PASS if there are none and every rule is verified."""
    own = members.select("bundle", "name", F.sha2("content", 256).alias("own"))
    both = own.join(manifest.select("bundle", "name", "sha256"), ["bundle", "name"], "full_outer")
    found = both.groupBy("bundle").agg(F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list(F.when(~F.coalesce(F.col("own") == F.col("sha256"), F.lit(False)), F.col("name")))).alias("bad"))
    drafts = rules.where("review_status <> 'VERIFIED'").select("bundle", F.lit(True).alias("_open")).distinct()
    rows = found.join(drafts, "bundle", "left")
    return rows.select("bundle", "n_members", "bad", F.when(F.size("bad") > 0, "FAIL").when(F.col("_open"), "UNVERIFIED_RULES").otherwise("PASS").alias("verdict"))

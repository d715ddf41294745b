"""Legal releases: manifests as rows, their checks, the one release in force, and what a parcel would get by it.

A release has a row in ``releases`` and a row for each entry and each source version that its manifest names; so a manifest of any size is a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwise.functions.scalars import amount
from fieldwise.operators.changes import stage
from fieldwise.operators.lookups import only_one, rule_conflicts
from fieldwise.operators.rules import check_conditions
from fieldwise.sources.scratch import cut

SHA = "^[0-9a-f]{64}$"
ENTRY = ["program_key", "crop_code", "province", "district", "rate_id", "candidate_id", "evidence_id", "rate_digest", "candidate_digest"]
#: Fixed names of what must be covered.
COVERAGE = ("official_sources", "program_terms", "monetary_rates", "geography", "exceptions", "application_period", "gold_cases")
PERIOD = "effective_from <= _when and (effective_to is null or effective_to >= _when)"


def canonical(columns: list[str]) -> Column:
    """Compact JSON with the keys in order; nulls are kept and all values are strings."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def rows_digest(rows: DataFrame, by: list[str], order: list[str], columns: list[str], name: str = "digest") -> DataFrame:
    """by..., n_rows, digest: SHA-256 of the JSON array of a group's rows in order.

    A digest needs its rows one after the other, so a group's rows are streamed in order through one task, which carries the running digest alone; no value holds a group."""
    n = len(by)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, digest, schema = None, 0, hashlib.sha256(), None

        def one() -> pa.RecordBatch:
            digest.update(b"]")
            columns = [pa.array([v], f.type) for v, f in zip(at, schema, strict=False)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([count], pa.int64()), pa.array([digest.hexdigest()])], names=[*by, "n_rows", name])

        for batch in batches:
            schema = batch.schema
            for *key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != at:
                    if at is not None:
                        yield one()
                    at, count, digest = key, 0, hashlib.sha256(b"[")
                digest.update((b"," if count else b"") + text.encode())
                count += 1
        if at is not None:
            yield one()

    keyed = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    sorted_by = [f"_by{i}" for i in range(n)] + [f"_o{i}" for i in range(len(order))] + ["_json"]
    ordered = rows.select(*keyed, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], canonical(columns).alias("_json")).repartition(*sorted_by[:n]).sortWithinPartitions(*sorted_by)
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    return ordered.select(*sorted_by[:n], "_json").mapInArrow(digests, f"{kinds}n_rows long, {name} string")


def row_digest(*columns: str) -> Column:
    """SHA-256 over every named field of a row."""
    return F.sha2(canonical(list(columns)), 256)


def manifest_violations(releases: DataFrame, entries: DataFrame, versions: DataFrame) -> DataFrame:
    """(release_id, violation): COVERAGE_KEYS, REFERENCE, NO_ENTRIES, NO_VERSIONS, VERSION_REF, DUPLICATE_VERSION, ENTRY_REF, ENTRY_DIGEST, ENTRY_CLASS, SCOPE, DUPLICATE_ENTRY, OVERLAP.

    releases: release_id, coverage (map of name to boolean), coverage_review_reference."""
    keys = F.array_sort(F.map_keys("coverage")) == F.array(*[F.lit(c) for c in sorted(COVERAGE)])
    own = F.array_compact(F.array(F.when(~F.coalesce(keys & ~F.array_contains(F.transform(F.map_values("coverage"), lambda v: v.isNull()), True), F.lit(False)), F.lit("COVERAGE_KEYS")), F.when(~F.coalesce(F.length("coverage_review_reference").between(8, 256), F.lit(False)), F.lit("REFERENCE"))))
    out = [releases.select("release_id", F.explode(own).alias("violation"))]
    for rows, name in ((entries, "NO_ENTRIES"), (versions, "NO_VERSIONS")):
        out.append(releases.join(rows.select("release_id").distinct(), "release_id", "left_anti").select("release_id", F.lit(name).alias("violation")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    unhashed = lambda c: ~F.coalesce(F.col(c).rlike(SHA), F.lit(False))
    out.append(versions.where(bad("version_id") | unhashed("sha256")).select("release_id", F.lit("VERSION_REF").alias("violation")))
    out.append(versions.groupBy("release_id", "version_id").count().where("count > 1").select("release_id", F.lit("DUPLICATE_VERSION").alias("violation")))
    checks = [
        ("ENTRY_REF", bad("rate_id") | bad("candidate_id") | bad("evidence_id")), ("ENTRY_DIGEST", unhashed("rate_digest") | unhashed("candidate_digest")),
        ("ENTRY_CLASS", blank("program_key") | blank("crop_code") | blank("province") | blank("district")), ("SCOPE", (F.col("province") == "*") != (F.col("district") == "*")),
    ]
    out.append(entries.select("release_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("violation")))
    out.append(entries.groupBy("release_id", "program_key", "crop_code", "province", "district").count().where("count > 1").select("release_id", F.lit("DUPLICATE_ENTRY").alias("violation")))
    scopes = entries.groupBy("release_id", "program_key", "crop_code").agg(F.bool_or((F.col("province") == "*") & (F.col("district") == "*")).alias("national"), F.count_distinct("province", "district").alias("n"))
    out.append(scopes.where("national and n > 1").select("release_id", F.lit("OVERLAP").alias("violation")))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.distinct()


def release_digests(entries: DataFrame) -> DataFrame:
    """(release_id, n_rows, manifest_sha256) of manifests by their entries."""
    return rows_digest(entries, ["release_id"], ["program_key", "crop_code", "province", "district", "rate_id"], ENTRY, "manifest_sha256")


def stage_releases(releases: DataFrame, entries: DataFrame, versions: DataFrame, existing: DataFrame) -> DataFrame:
    """(release_id, manifest_sha256, outcome): REFUSED for a manifest with a violation, NO_ANCHOR if the release's own source version isn't among those it names, else INSERT, SAME or CONFLICT by the manifest's digest."""
    rows = releases.join(release_digests(entries).drop("n_rows"), "release_id", "left")
    bad = manifest_violations(releases, entries, versions).select("release_id").distinct().withColumn("_bad", F.lit(True))
    anchors = versions.select("release_id", F.col("version_id").alias("source_version_id"), F.lit(True).alias("_anchor")).distinct()
    rows = rows.join(bad, "release_id", "left").join(anchors, ["release_id", "source_version_id"], "left")
    why = F.when(F.col("_bad"), "REFUSED").when(F.col("_anchor").isNull(), "NO_ANCHOR")
    rows = rows.withColumn("_why", why)
    columns = ["manifest_sha256", "production_year", "source_version_id"]
    fresh = rows.where("_why is null").select("release_id", *columns)
    staged = stage(fresh.select(*columns).distinct(), existing.select(*columns), ["manifest_sha256"]).select("manifest_sha256", "outcome")
    return fresh.join(staged, "manifest_sha256").select("release_id", "manifest_sha256", "outcome").union(rows.where("_why is not null").select("release_id", "manifest_sha256", F.col("_why").alias("outcome")))


def valid_releases(releases: DataFrame, entries: DataFrame, versions: DataFrame, rates: DataFrame, candidates: DataFrame, source_versions: DataFrame, approved: DataFrame, when: Column) -> DataFrame:
    """The releases whose every reference agrees on the day ``when``.

    A release must be VERIFIED, in force, wholly covered, approved and without manifest violations; each version that it names must be live and have the hash that it states; each entry's
    rate and candidate must be of the release's year, the entry's crop, program and place, of one amount and period, in force, from a named version, with the stated digests, and the rate approved; and no
    verified rate of an entry's program and crop may be in force outside of the manifest. rates and candidates have ``digest``; approved: (kind, subject_id)."""
    bad = cut(manifest_violations(releases, entries, versions).select("release_id").distinct())
    signed = lambda kind, name: approved.where(F.col("kind") == kind).select(F.col("subject_id").alias(name)).distinct()
    covered = F.forall(F.map_values("coverage"), lambda v: F.coalesce(v, F.lit(False)))
    rows = releases.withColumn("_when", when).where("review_status = 'VERIFIED'").where(PERIOD).where(covered)
    rows = rows.join(bad, "release_id", "left_anti").join(signed("RELEASE", "release_id"), "release_id", "left_semi")
    digests = release_digests(entries).select("release_id", F.col("manifest_sha256").alias("_digest"))
    rows = rows.join(digests, "release_id").where("_digest = manifest_sha256").drop("_digest")
    live = source_versions.where("not superseded and active").select(F.col("id").alias("version_id"), F.col("content_hash").alias("sha256"), F.lit(True).alias("_live"))
    stale = versions.join(live, ["version_id", "sha256"], "left").where("_live is null").select("release_id")
    named = versions.select("release_id", "version_id").distinct()
    anchored = rows.select("release_id", F.col("source_version_id").alias("version_id")).join(named, ["release_id", "version_id"], "left_anti").select("release_id")
    r = rates.select(*[F.col(c).alias(f"r_{c}") for c in ("rate_id", "program_id", "crop_name", "production_year", "province", "district", "unit_amount", "effective_from", "effective_to", "source_version_id", "digest", "review_status")])
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in ("candidate_id", "program_key", "crop_code", "production_year", "province", "district", "amount", "effective_from", "effective_to", "evidence_id", "digest", "review_status")])
    rows = cut(rows)
    full = entries.select("release_id", *ENTRY).join(rows.select("release_id", "production_year", "_when"), "release_id")
    full = full.join(r, F.col("rate_id") == F.col("r_rate_id"), "left").join(c, F.col("candidate_id") == F.col("c_candidate_id"), "left")
    full = full.join(named.select(F.col("release_id").alias("n_release"), F.col("version_id").alias("n_version"), F.lit(True).alias("_named")), (F.col("release_id") == F.col("n_release")) & (F.col("r_source_version_id") == F.col("n_version")), "left")
    full = full.join(signed("RATE", "s_rate").withColumn("_signed", F.lit(True)), F.col("rate_id") == F.col("s_rate"), "left")
    agrees = F.expr("""
        r_production_year = production_year and c_production_year = production_year and c_review_status = 'DRAFT' and r_review_status = 'VERIFIED' and r_crop_name = crop_code and c_crop_code = crop_code and r_program_id = program_key
        and c_program_key = program_key and r_province = province and r_district = district and c_province = province and c_district = district and c_evidence_id = evidence_id and c_digest = candidate_digest
        and r_digest = rate_digest and r_unit_amount = c_amount and r_effective_from = c_effective_from and r_effective_to <=> c_effective_to and r_effective_from <= _when and (r_effective_to is null or r_effective_to >= _when)""")
    wrong = full.where(~F.coalesce(agrees, F.lit(False)) | F.col("_named").isNull() | F.col("_signed").isNull()).select("release_id")
    # Verified rates beside the manifest could stand in for it.
    keys = full.select("release_id", "program_key", "crop_code", "production_year", "_when").distinct()
    beside = keys.join(rates.where("review_status = 'VERIFIED'").select(F.col("program_id").alias("program_key"), F.col("crop_name").alias("crop_code"), "production_year", "rate_id", "effective_from", "effective_to"), ["program_key", "crop_code", "production_year"]).where(PERIOD)
    shadow = beside.join(entries.select("release_id", "rate_id").distinct(), ["release_id", "rate_id"], "left_anti").select("release_id")
    return rows.join(stale.union(anchored).union(wrong).union(shadow).distinct(), "release_id", "left_anti").drop("_when")


def active_release(valid: DataFrame, years: DataFrame) -> DataFrame:
    """years (production_year) with status ACTIVE and the release_id of the one valid release, or HOLD."""
    one = only_one(valid.select("production_year", "release_id"), "production_year")
    return years.join(one, "production_year", "left").select("production_year", F.when(F.col("release_id").isNull(), "HOLD").otherwise("ACTIVE").alias("status"), "release_id")


def evaluate_on_release(parcels: DataFrame, active: DataFrame, entries: DataFrame, rates: DataFrame, known: Column) -> DataFrame:
    """parcels (parcel_id, program_key, crop_code, production_year, province, district, area_da, facts) to (parcel_id, program_key, status, payable, simulated, reason).

    A release is no entitlement: the status is always REVIEW and nothing is payable; a simulated amount stands where exactly one entry applies and all its conditions are met."""
    rows = parcels.join(active.where("release_id is not null").select("production_year", "release_id"), "production_year", "left")
    named = entries.select("release_id", "program_key", "crop_code", F.col("province").alias("_p"), F.col("district").alias("_d"), "rate_id", "conditions")
    hits = rows.select("parcel_id", "program_key", "crop_code", "province", "district", "release_id").join(named, ["release_id", "program_key", "crop_code"]).where("(_p = '*' and _d = '*') or (_p = province and _d = district)")
    sums = hits.groupBy("parcel_id", "program_key").agg(F.count(F.lit(1)).alias("n"), F.first("rate_id").alias("rate_id"), F.first("conditions").alias("conditions"))
    rows = rows.join(sums, ["parcel_id", "program_key"], "left").join(rates.select("rate_id", "unit_amount"), "rate_id", "left")
    checks = check_conditions(F.col("conditions"), known)
    met = F.coalesce((F.size("conditions") > 0) & F.forall(checks, lambda c: c == "MATCHED"), F.lit(False))
    reason = F.when(F.col("release_id").isNull(), "NO_RELEASE").when(~F.coalesce(F.col("area_da") > 0, F.lit(False)), "AREA").when(~F.col("n").eqNullSafe(F.lit(1)), "NO_SINGLE_ENTRY").when(~met, "FACTS").otherwise("SIMULATED")
    rows = rows.withColumn("reason", reason)
    return rows.select("parcel_id", "program_key", F.lit("REVIEW").alias("status"), F.lit(None).cast("decimal(18,2)").alias("payable"), F.when(F.col("reason") == "SIMULATED", amount(F.col("area_da"), F.col("unit_amount"))).alias("simulated"), "reason")


def bundle_violations(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """(bundle_id, violation) of rule bundles (bundle_id, and the columns of rules with source_sentence_id): YEARS if more than one, RULE for a rule that fails a check, DUPLICATE rule numbers,
    CONFLICT between rules, EVIDENCE that doesn't exist (evidence_id)."""
    from fieldwise.operators.documents import candidate_violations

    years = rules.groupBy("bundle_id").agg(F.count_distinct("production_year").alias("n")).where("n > 1").select("bundle_id", F.lit("YEARS").alias("violation"))
    failed = candidate_violations(rules, (1990, 2100)).select("rule_no").distinct()
    bad = rules.join(failed, "rule_no", "left_semi").select("bundle_id", F.lit("RULE").alias("violation"))
    twice = rules.groupBy("bundle_id", "rule_no").count().where("count > 1").select("bundle_id", F.lit("DUPLICATE").alias("violation"))
    met = rule_conflicts(rules).select(F.col("a_rule").alias("rule_no"), "b_rule")
    pairs = rules.select("bundle_id", "rule_no").join(met, "rule_no").join(rules.select("bundle_id", F.col("rule_no").alias("b_rule")), ["bundle_id", "b_rule"])
    lost = rules.join(evidence.select(F.col("evidence_id").alias("source_sentence_id")).distinct(), "source_sentence_id", "left_anti")
    return years.union(bad).union(twice).union(pairs.select("bundle_id", F.lit("CONFLICT").alias("violation"))).union(lost.select("bundle_id", F.lit("EVIDENCE").alias("violation"))).distinct()


def publishable(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rules of bundles without any violation: a bundle is staged as a whole or not at all."""
    return rules.join(bundle_violations(rules, evidence).select("bundle_id").distinct(), "bundle_id", "left_anti")

"""Reviewed district lists in two time axes: what was known at a date about the year or day that a parcel asks for. Every answer without proof is UNKNOWN, with the first reason.

A record counts if it was reviewed, and its document's version found, by the day of knowledge; a version counts until it is superseded. Records are judged once for each district and year, and
parcels meet the judgement of theirs in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwise.operators.lookups import SMALL_ROWS

SHA = "^[0-9a-fA-F]{64}$"
PLACE = ["province", "district", "production_year"]


def known_records(records: DataFrame, versions: DataFrame, sources: DataFrame, known_on: Column) -> DataFrame:
    """Verified records (reviewed_at, source_version_id, ...) of active sources that were known on a day, with their version's columns under ``v_`` and their source's address.

    versions: id, source_id, content_hash, detected_at, superseded_at (null: not), effective_from, effective_to; sources: source_id, url, active. A record without a day of review isn't hidden: what it lacks is a reason of its own."""
    v = versions.select(F.col("id").alias("source_version_id"), "source_id", *[F.col(c).alias(f"v_{c}") for c in ("content_hash", "detected_at", "superseded_at", "effective_from", "effective_to")])
    rows = records.where("review_status = 'VERIFIED'").join(v, "source_version_id").join(sources.where("active").select("source_id", "url"), "source_id")
    known = (F.col("reviewed_at").isNull() | (F.col("reviewed_at") <= known_on)) & (F.col("v_detected_at").isNull() | (F.col("v_detected_at") <= known_on))
    return rows.where(known & (F.col("v_superseded_at").isNull() | (F.col("v_superseded_at") > known_on)))


def judged(records: DataFrame, reason: Column, kept: list[str]) -> DataFrame:
    """One row for each place and year: n records, and of a single one its reason and columns, as ``_one``."""
    own = F.struct(reason.alias("reason"), *kept)
    return records.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n"), F.first(own).alias("_one"))


def with_judgement(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows beside their place's judgement; the table is broadcast only after a count."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL_ROWS else table, PLACE, "left")


def unreviewed() -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return blank("reviewed_by") | F.col("reviewed_at").isNull() | blank("review_reference")


def basin_assessment(rows: DataFrame, snapshots: DataFrame, versions: DataFrame, sources: DataFrame, approved: DataFrame, pinned: tuple[str, str, str], exact_codes: Column, known_on: Column, drip_crop: Column) -> DataFrame:
    """rows (province, district, production_year, crop_code, ...) with basin (LISTED, NOT_LISTED or UNKNOWN), basin_reason, basin_version, basin_page and drip_required.

    snapshots: snapshot_id, place and year, review_status, coverage_complete, reviewed_by, reviewed_at, review_reference, document_page, source_version_id, crops (array), drip_required; approved: snapshot_id.
    pinned: the one document's source_id, content hash and address. Reasons in order: NO_SNAPSHOT, SEVERAL_SNAPSHOTS (complete ones alone count), REVIEW, DOCUMENT (another version, or not of that year), APPROVAL,
    CROP_LIST (empty, blank or repeated codes), SUBTYPE (``exact_codes`` doesn't have the crop, so its absence proves nothing)."""
    whole = known_records(snapshots.where("coverage_complete"), versions, sources, known_on).join(approved.select("snapshot_id", F.lit(True).alias("_signed")), "snapshot_id", "left")
    source, content, url = map(F.lit, pinned)
    day = lambda m, d: F.make_date("production_year", F.lit(m), F.lit(d))
    same = (F.col("source_id") == source) & (F.col("v_content_hash") == content) & (F.col("url") == url)
    in_year = (F.col("v_effective_from") <= day(12, 31)) & (F.col("v_effective_to").isNull() | (F.col("v_effective_to") >= day(1, 1)))
    sound = (F.size("crops") > 0) & ~F.exists("crops", lambda c: F.coalesce(c, F.lit("")) == "") & (F.size(F.array_distinct("crops")) == F.size("crops"))
    reason = (
        F.when(unreviewed() | ~F.coalesce(F.col("document_page") >= 1, F.lit(False)), "REVIEW").when(~F.coalesce(same & in_year, F.lit(False)), "DOCUMENT").when(F.col("_signed").isNull(), "APPROVAL")
        .when(~F.coalesce(sound, F.lit(False)), "CROP_LIST")
    )
    out = with_judgement(rows, judged(whole, reason, ["crops", "drip_required", "source_version_id", "document_page"])).withColumn("_crop", F.upper(F.trim("crop_code")))
    why = (
        F.when(F.col("_n").isNull(), "NO_SNAPSHOT").when(F.col("_n") > 1, "SEVERAL_SNAPSHOTS").when(F.col("_one.reason").isNotNull(), F.col("_one.reason"))
        .when(~F.coalesce(F.array_contains(exact_codes, F.col("_crop")), F.lit(False)), "SUBTYPE")
    )
    listed = F.array_contains("_one.crops", F.col("_crop"))
    found = out.withColumn("basin_reason", why).withColumn("basin", F.when(F.col("basin_reason").isNotNull(), "UNKNOWN").when(listed, "LISTED").otherwise("NOT_LISTED"))
    proof = lambda c: F.when(F.col("basin_reason").isNull(), F.col(f"_one.{c}"))
    drip = (F.col("basin") == "LISTED") & F.coalesce(F.col("_one.drip_required"), F.lit(False)) & (F.col("_crop") == drip_crop)
    return found.withColumns({"basin_version": proof("source_version_id"), "basin_page": proof("document_page"), "drip_required": drip}).drop("_n", "_one", "_crop")


def water_assessment(rows: DataFrame, records: DataFrame, versions: DataFrame, sources: DataFrame, approved: DataFrame, as_of: Column, known_on: Column) -> DataFrame:
    """rows (province, district, production_year, ...) with water (RESTRICTED, NOT_RESTRICTED or UNKNOWN), water_reason, water_version and water_page.

    records: record_id, place and year, review_status, reviewed_by, reviewed_at, review_reference, document_page, source_version_id, effective_from, effective_to, restriction_status; approved: record_id.
    Reasons in order: NO_RECORD, SEVERAL_RECORDS, REVIEW, DOCUMENT (no hash, or not found on a day), INTERVAL (the version isn't in force on ``as_of``, or the record's own interval is turned round), APPROVAL, UNDER_REVIEW."""
    own = known_records(records, versions, sources, known_on).join(approved.select("record_id", F.lit(True).alias("_signed")), "record_id", "left")
    reason = F.when(unreviewed(), "REVIEW").when(~F.coalesce(F.col("v_content_hash").rlike(SHA), F.lit(False)) | F.col("v_detected_at").isNull(), "DOCUMENT")
    turned = F.coalesce(F.col("effective_to") < F.col("effective_from"), F.lit(False)).alias("turned")
    table = judged(own, reason, ["v_effective_from", "v_effective_to", turned, "_signed", "restriction_status", "source_version_id", "document_page"])
    out = with_judgement(rows, table).withColumn("_at", as_of)
    outside = F.coalesce(F.col("_one.v_effective_from") > F.col("_at"), F.lit(False)) | F.coalesce(F.col("_one.v_effective_to") < F.col("_at"), F.lit(False)) | F.col("_one.turned")
    why = (
        F.when(F.col("_n").isNull(), "NO_RECORD").when(F.col("_n") > 1, "SEVERAL_RECORDS").when(F.col("_one.reason").isNotNull(), F.col("_one.reason")).when(outside, "INTERVAL")
        .when(F.col("_one._signed").isNull(), "APPROVAL").when(~F.coalesce(F.col("_one.restriction_status").isin("RESTRICTED", "NOT_RESTRICTED"), F.lit(False)), "UNDER_REVIEW")
    )
    found = out.withColumn("water_reason", why).withColumn("water", F.when(F.col("water_reason").isNull(), F.col("_one.restriction_status")).otherwise("UNKNOWN"))
    shown = F.col("water_reason").isNull() | (F.col("water_reason") == "UNDER_REVIEW")
    return found.withColumn("water_version", F.when(shown, F.col("_one.source_version_id"))).withColumn("water_page", F.when(shown, F.col("_one.document_page"))).drop("_n", "_one", "_at")

"""Joins of parcels to versioned rules and rates. Every look-up answers only if exactly one row is left."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.operators.patterns import found_patterns


def only_one(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key stands exactly once; a second row makes an answer ambiguous, so neither stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def in_force(as_of: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Closed interval, open-ended if the end is null."""
    return (F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) >= as_of))


def here(place: str, own: str) -> Column:
    return (F.col(place) == "*") | (F.col(place) == F.col(own))


#: Rows up to which a table of rules or rates, grouped by key, is sent to all executors; a larger one is joined by shuffling.
SMALL_ROWS = 500_000


def with_group(rows: DataFrame, table: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with ``name``, an array of the table's rows of their key (null without any): a key's rows travel together, so the large side meets them in one join and the rest is a projection.

    The table is broadcast only after a count; keys of rules and rates have few rows each."""
    others = [c for c in table.columns if c not in key]
    grouped = table.groupBy(*key).agg(F.collect_list(F.struct(*others)).alias(name))
    return rows.join(F.broadcast(grouped) if table.count() <= SMALL_ROWS else grouped, key, "left")


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if a count says that it is small: what Spark guesses of tables made by joins would deal out the large side."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def rate_as_of(parcels: DataFrame, rates: DataFrame, versions: DataFrame, as_of: Column, sources: DataFrame | None = None, programs: DataFrame | None = None, approved: DataFrame | None = None) -> DataFrame:
    """parcels (parcel_id, program_key, crop_code, production_year, province, district) with n_rates and unit_amount, null unless one valid rate is left.

    A rate is valid if it is verified and positive, its interval isn't turned round and its source version is live and hashed. Where rates have them, legal_clause, approved_by and review_reference must not be blank and
    approved_at not be null; where they are given, the version's source (source_id, active) and the program (program_key, active) must be active, and the rate (rate_id) approved by two persons.
    Place and dates are tested in the array of a key's rates, so a wildcard never makes a nested loop and parcels aren't grouped."""
    if sources is not None:
        versions = versions.join(sources.where("active").select("source_id"), "source_id", "left_semi")
    if programs is not None:
        rates = rates.join(programs.where("active").select(F.col("program_key").alias("program_id")), "program_id", "left_semi")
    if approved is not None:
        rates = rates.join(approved.select("rate_id"), "rate_id", "left_semi")
    for c in ("legal_clause", "approved_by", "review_reference"):
        if c in rates.columns:
            rates = rates.where(F.trim(c) != "")
    if "approved_at" in rates.columns:
        rates = rates.where("approved_at is not null")
    live = versions.where(~F.col("superseded") & F.col("content_hash").rlike("^[0-9a-f]{64}$")).select(F.col("id").alias("source_version_id"))
    valid = rates.where("review_status = 'VERIFIED' and unit_amount > 0 and (effective_to is null or effective_to >= effective_from)").join(live, "source_version_id")
    valid = valid.select(F.col("program_id").alias("program_key"), F.col("crop_name").alias("crop_code"), "production_year", "province", "district", "unit_amount", "effective_from", "effective_to")
    rows = with_group(parcels, valid, ["program_key", "crop_code", "production_year"], "_rates").withColumn("_as_of", as_of)

    def applies(r: Column) -> Column:
        in_time = (r["effective_from"] <= F.col("_as_of")) & (r["effective_to"].isNull() | (r["effective_to"] >= F.col("_as_of")))
        return in_time & (((r["province"] == "*") & (r["district"] == "*")) | ((r["province"] == F.col("province")) & (r["district"] == F.col("district"))))

    rows = rows.withColumn("_rates", F.filter(F.coalesce("_rates", F.array().cast(rows.schema["_rates"].dataType)), applies)).withColumn("n_rates", F.size("_rates").cast("long"))
    return rows.withColumn("unit_amount", F.when(F.col("n_rates") == 1, F.get("_rates", 0)["unit_amount"])).drop("_rates", "_as_of")


def basin_membership(parcels: DataFrame, basin: DataFrame) -> DataFrame:
    """LISTED or NOT_LISTED where the district's list is complete, else UNKNOWN; with the drip flag of the district."""
    places = basin.groupBy("province", "district").agg(F.bool_and("coverage_complete").alias("complete"), F.bool_or("drip_required").alias("drip_required"))
    listed = basin.select("province", "district", "crop_code").distinct().withColumn("listed", F.lit(True))
    out = parcels.join(small(places), ["province", "district"], "left").join(small(listed), ["province", "district", "crop_code"], "left")
    outcome = F.when(~F.coalesce("complete", F.lit(False)), "UNKNOWN").when(F.col("listed"), "LISTED").otherwise("NOT_LISTED")
    return out.withColumn("basin", outcome).drop("listed", "complete")


def water_scope(parcels: DataFrame, water: DataFrame) -> DataFrame:
    """RESTRICTED or NOT_RESTRICTED by the one reviewed row of the district, else UNKNOWN."""
    rows = only_one(water, "province", "district").where("restriction_status <> 'UNDER_REVIEW'")
    return parcels.join(small(rows), ["province", "district"], "left").withColumn("water", F.coalesce("restriction_status", F.lit("UNKNOWN"))).drop("restriction_status")


def match_rules(parcels: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules of the parcel's own year, program and crop that are in force and apply to its place."""
    named = rules.withColumnRenamed("province", "r_province").withColumnRenamed("district", "r_district")
    hits = parcels.join(named, ["program_key", "crop_code", "production_year"])
    return hits.where(in_force(as_of) & here("r_province", "province") & here("r_district", "district"))


def sweep(key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (key..., rule_no, start, end, amount) in order of key and start: pairs of rows that meet and whose amounts differ.

    Rows in force are held by amount, each amount's in a heap by end, so a row meets only those that it conflicts with; rows that ended are dropped as the sweep passes them."""
    names = ["a_rule", "b_rule", "program_key", "crop_code", "production_year"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, active = None, {}
        for batch in batches:
            columns, found = [c.to_pylist() for c in batch.columns], []
            for row, (*place, rule, start, end, amount) in enumerate(zip(*columns, strict=True)):
                if place != at:
                    at, active = place, {}
                for other in list(active):
                    heap = active[other]
                    while heap and heap[0][0] < start:
                        heapq.heappop(heap)
                    if not heap:
                        del active[other]
                    elif other != amount:
                        found += [(row, min(rule, x), max(rule, x)) for _, x, began in heap if x != rule and began <= end]
                if end >= start:
                    heapq.heappush(active.setdefault(amount, []), (end, rule, start))
            rows, a, b = zip(*found, strict=True) if found else ((), (), ())
            own = [batch.column(key.index(c)).take(pa.array(rows, pa.int64())) for c in names[2:]]
            kind = batch.column(len(key)).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), *own], names=names)

    return run


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of rules for one program, crop and place whose intervals meet (each starts no later than the other ends) and whose amounts differ. Rules without an amount, a start or a key meet none.

    Each key's rules are swept in order of their start, so the work grows with the rules and the conflicts and not with all pairs of a key."""
    key = ["program_key", "crop_code", "production_year", "province", "district"]
    rows = rules.select(*key, "rule_no", F.col("effective_from").alias("start"), F.coalesce("effective_to", F.lit("9999-12-31").cast("date")).alias("end"), F.col("official_unit_amount").alias("amount"))
    rows = rows.where("start is not null and amount is not null").dropna(subset=key).repartition(*key).sortWithinPartitions(*key, "start")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [*key, "rule_no"]}
    return rows.mapInArrow(sweep(key), f"a_rule {kinds['rule_no']}, b_rule {kinds['rule_no']}, program_key {kinds['program_key']}, crop_code {kinds['crop_code']}, production_year {kinds['production_year']}")


def scope_overlap(entries: DataFrame) -> DataFrame:
    """Keys that have a national entry beside local ones."""
    sums = entries.groupBy("program_key", "crop_code", "production_year").agg(F.count(F.lit(1)).alias("n_entries"), F.bool_or(F.col("province") == "*").alias("national"), F.bool_or(F.col("province") != "*").alias("local"))
    return sums.where("national and local").select("program_key", "crop_code", "production_year", "n_entries")


def approved(subjects: DataFrame, attestations: DataFrame, revoked: DataFrame | None = None, keys: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """subjects (subject_id, digest) with ``approved``: two attestations, by a reviewer and an approver who are two persons, with valid
    signatures over the subject's digest, and no revocation.

    keys (principal_id, role): each attestation's role must be the one that its principal's key is trusted for. as_of: none may be signed (signed_at) later. Where subjects have source_sha256 and source_active,
    attestations must state the same source_sha256, and the source must be active."""
    joined = subjects.join(attestations.withColumnRenamed("source_sha256", "_stated"), "subject_id", "left")
    trusted = F.lit(True)
    if keys is not None:
        joined = joined.join(keys.select("principal_id", F.col("role").alias("_trusted")).dropDuplicates(["principal_id"]), "principal_id", "left")
        trusted = trusted & F.col("_trusted").eqNullSafe(F.col("role"))
    if as_of is not None:
        trusted = trusted & (F.col("signed_at") <= as_of)
    if "source_sha256" in subjects.columns:
        trusted = trusted & (F.col("_stated") == F.col("source_sha256"))
    if "source_active" in subjects.columns:
        trusted = trusted & F.col("source_active")
    sums = joined.groupBy("subject_id").agg(
        F.count("role").alias("n"), F.count_distinct("role").alias("roles"), F.count_distinct("principal_id").alias("persons"),
        F.coalesce(F.bool_and(F.col("role").isin("REVIEWER", "APPROVER") & (F.col("subject_digest") == F.col("digest")) & F.col("signature_valid") & F.coalesce(trusted, F.lit(False))), F.lit(False)).alias("sound"),
    )
    out = sums.select("subject_id", ((F.col("n") == 2) & (F.col("roles") == 2) & (F.col("persons") == 2) & F.col("sound")).alias("approved"))
    if revoked is not None:
        gone = revoked.select("subject_id").distinct().withColumn("_gone", F.lit(True))
        out = out.join(gone, "subject_id", "left").select("subject_id", (F.col("approved") & F.col("_gone").isNull()).alias("approved"))
    return out


def by_first_containment(rows: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """rows with the code of the first name, by ordinal, that the text contains, or that contains it; empty texts have none.

    names (ordinal, name, code) is a dictionary. Names inside texts are found in one walk over each distinct text; texts inside names are looked up among the names' substrings."""
    texts = rows.select(F.col(text).alias("text_id")).where("text_id <> ''").distinct().withColumn("text", F.col("text_id"))
    inside = found_patterns(texts, names.select(F.col("name").alias("pattern"))).join(names.withColumnRenamed("name", "pattern"), "pattern").select("text_id", "ordinal", "code")
    starts = F.sequence(F.lit(1), F.length("name"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("name") - i + 1), lambda n: F.substring("name", i, n))))
    around = names.where("name <> ''").select(F.explode(F.array_distinct(parts)).alias("text_id"), "ordinal", "code").join(texts.select("text_id"), "text_id")
    best = inside.union(around.select("text_id", "ordinal", "code")).groupBy(F.col("text_id").alias(text)).agg(F.min_by("code", "ordinal").alias("code"))
    return rows.join(best, text, "left")


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side alone; empty if the sets are equal."""
    return a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("a")).union(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("b")))

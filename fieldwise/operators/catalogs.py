"""Catalogs of sources, components, basins, water districts and questions: checks, staging, upserts and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.scalars import lower_tr, positive_decimal
from fieldwise.operators.changes import stage
from fieldwise.operators.patterns import found_patterns

SHA = "^[0-9a-f]{64}$"
#: Fixed order in which sources of an authority are read.
PRIORITY = {"GAZETTE": 1, "MINISTRY": 2, "AGENCY": 3}


def codes(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that fail, in order; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def load_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (source_id, url, authority, active) with their priority, and rejects (source_id, reason): without an id, URL or known authority, or with an id that stands twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    priority = F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("authority"))
    bad = F.when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "NO_ID").when(F.coalesce(F.trim("url"), F.lit("")) == "", "NO_URL").when(priority.isNull(), "AUTHORITY").when(n > 1, "DUPLICATE")
    rows = rows.withColumn("priority", priority).withColumn("reason", bad)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("source_id", "reason").distinct()


def active_sources(sources: DataFrame, authority: str | None = None) -> DataFrame:
    rows = sources.where("active")
    if authority is not None:
        rows = rows.where(F.col("authority") == authority)
    return rows.orderBy("priority", "source_id")


def latest_snapshots(files: DataFrame) -> DataFrame:
    """Files of the layout ``.../source/timestamp/name`` (path, content) to the latest of each source: (source_id, taken_at, name, content_sha256)."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([0-9TZ:.-]+)/([^/]+)$", i)
    rows = files.select(part(1).alias("source_id"), part(2).alias("taken_at"), part(3).alias("name"), F.sha2("content", 256).alias("content_sha256")).where("source_id <> ''")
    return rows.groupBy("source_id").agg(F.max_by(F.struct("taken_at", "name", "content_sha256"), F.struct("taken_at", "name")).alias("x")).select("source_id", "x.*")


def upsert(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows with new ones in place of those of the same key."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def append_versions(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions (source_id, version, content_hash, superseded) after finds (source_id, content_hash): a hash that a source doesn't have is its next version, and what came before is superseded."""
    fresh = found.select("source_id", "content_hash").distinct().join(versions.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
    last = versions.groupBy("source_id").agg(F.max("version").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("content_hash"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    added = fresh.join(last, "source_id", "left").select("source_id", (F.coalesce("_last", F.lit(0)) + nth).cast("int").alias("version"), "content_hash", (nth < n).alias("superseded"))
    renewed = fresh.select("source_id").distinct().withColumn("_new", F.lit(True))
    old = versions.join(renewed, "source_id", "left").select("source_id", "version", "content_hash", (F.col("superseded") | F.coalesce("_new", F.lit(False))).alias("superseded"))
    return old.unionByName(added)


def draft_violations(candidates: DataFrame, years: tuple[int, int] = (2020, 2100)) -> DataFrame:
    """(rule_no, violations) of draft rates (rule_no, program_key, crop_code, production_year, province, district, base_coefficient, category_multiplier, official_unit_amount, all as text but the year; unit, effective_from,
    effective_to, source_document_sha256, source_sentence_id, review_status). Only drafts may be imported, and a period begins in its production year or the one before."""
    base, factor, value = positive_decimal(F.col("base_coefficient"), 2), positive_decimal(F.col("category_multiplier"), 4), positive_decimal(F.col("official_unit_amount"), 2)
    named = lambda c: F.col(c).rlike("^[A-Za-z0-9_ÇĞİÖŞÜçğıöşü#-]{1,64}$")
    place = ((F.col("province") == "*") & (F.col("district") == "*")) | ((F.col("province") != "*") & (F.col("district") != "*") & F.length("province").between(1, 64) & F.length("district").between(1, 64))
    found = codes([
        ("DRAFT", F.col("review_status") == "DRAFT"), ("YEAR", F.col("production_year").between(*years)), ("ID", named("program_key") & named("crop_code")), ("PLACE", place), ("UNIT", F.col("unit") == "TRY/da"),
        ("SENTENCE", F.col("source_sentence_id") > 0), ("SHA", F.col("source_document_sha256").rlike(SHA)), ("INTERVAL", F.col("effective_from").isNotNull() & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("effective_from")))),
        ("START", F.year("effective_from").isin(0) | ((F.col("production_year") - F.year("effective_from")).isin(0, 1))), ("FORMULA", F.round(base * factor, 2) == value),
    ])
    return candidates.select("rule_no", F.array_join(found, ",").alias("violations")).where("violations <> ''")


def component_violations(components: DataFrame, coefficient: Column, totals: DataFrame) -> DataFrame:
    """(program_id, crop_name, violation) of a component catalog: components (program_id, crop_name, coefficient, unit_amount, unit, legal_clause, review_status) and totals (crop_name, total), the published sums of the basic and planned programs.

    STATUS, UNIT, CLAUSE, CROP, FORMULA, DUPLICATE; and TOTAL where the rounded sum of a crop's components isn't the published one, or a component lacks."""
    found = codes([
        ("STATUS", F.col("review_status") == "DRAFT"), ("UNIT", F.col("unit") == "TRY/da"), ("CLAUSE", F.trim("legal_clause") != ""), ("CROP", F.trim("crop_name") != ""),
        ("FORMULA", (F.col("unit_amount") > 0) & (F.col("coefficient") > 0) & (F.round(coefficient * F.col("coefficient"), 2) == F.col("unit_amount"))),
    ])
    own = components.select("program_id", "crop_name", F.explode(found).alias("violation"))
    twice = components.groupBy("program_id", "crop_name").count().where("count > 1").select("program_id", "crop_name", F.lit("DUPLICATE").alias("violation"))
    of = lambda p: F.max(F.when(F.col("program_id") == p, F.col("unit_amount")))
    sums = components.groupBy("crop_name").agg(of("BASIC_SUPPORT").alias("basic"), of("PLANNED_PRODUCTION").alias("planned"))
    same = F.coalesce(F.round(F.col("basic") + F.col("planned"), 0) == F.col("total"), F.lit(False))
    wrong = totals.join(sums, "crop_name", "left").where(~same).select(F.lit("TOTAL").alias("program_id"), "crop_name", F.lit("TOTAL").alias("violation"))
    return own.union(twice).union(wrong)


def basin_violations(rows: DataFrame, reported: DataFrame, crops: list[str], least_rows: int = 800, least_provinces: int = 75) -> DataFrame:
    """(catalog_id, place, violation): basin rows (catalog_id, province, district, crop_codes, source_page, review_status) against what the catalog reports (catalog_id, page_count, district_count, province_count).

    Rows: PLACE, PAGE, STATUS, CROPS, DUPLICATE. The catalog: DISTRICT_COUNT and PROVINCE_COUNT if they differ from the rows', COVERAGE if it is no national one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("catalog_id", "province", "district"))
    known = (F.size("crop_codes") > 0) & (F.size("crop_codes") == F.size(F.array_distinct("crop_codes"))) & (F.size(F.array_except("crop_codes", F.array(*[F.lit(c) for c in crops]))) == 0)
    found = codes([("PLACE", (F.trim("province") != "") & (F.trim("district") != "")), ("PAGE", F.col("source_page").between(1, F.col("page_count"))), ("STATUS", F.col("review_status") == "DRAFT"), ("CROPS", known), ("DUPLICATE", F.col("_n") == 1)])
    own = rows.withColumn("_n", n).join(F.broadcast(reported.select("catalog_id", "page_count")), "catalog_id")  # one row a catalog
    own = own.select("catalog_id", F.concat_ws("/", "province", "district").alias("place"), F.explode(found).alias("violation")).distinct()
    sums = rows.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("province").alias("p"))
    whole = reported.join(sums, "catalog_id", "left").select("catalog_id", F.lit("*").alias("place"), F.explode(codes([
        ("DISTRICT_COUNT", F.col("district_count") == F.coalesce("n", F.lit(0))), ("PROVINCE_COUNT", F.col("province_count") == F.coalesce("p", F.lit(0))), ("COVERAGE", (F.col("n") >= least_rows) & (F.col("p") >= least_provinces)),
    ])).alias("violation"))
    return own.union(whole)


def water_violations(rows: DataFrame, pinned: DataFrame) -> DataFrame:
    """(province, district, violation) of a water catalog (province, district, restriction_status, approved) against the pinned list (province, district): MISSING, UNLISTED, DUPLICATE, STATUS, APPROVED (a catalog may not approve itself)."""
    found = codes([("STATUS", F.col("restriction_status").isin("RESTRICTED", "NOT_RESTRICTED", "UNDER_REVIEW")), ("APPROVED", ~F.col("approved"))])
    own = rows.select("province", "district", F.explode(found).alias("violation"))
    key = ["province", "district"]
    twice = rows.groupBy(*key).count().where("count > 1").select(*key, F.lit("DUPLICATE").alias("violation"))
    missing = pinned.join(rows.select(*key), key, "left_anti").select(*key, F.lit("MISSING").alias("violation"))
    unlisted = rows.join(pinned.select(*key), key, "left_anti").select(*key, F.lit("UNLISTED").alias("violation")).distinct()
    return own.union(twice).union(missing).union(unlisted)


def stage_districts(rows: DataFrame, years: list[int], existing: DataFrame) -> DataFrame:
    """District rows (province, district, ...), each for every year, as INSERT, SAME or CONFLICT against existing ones."""
    wide = rows.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias("production_year"))
    return stage(wide, existing.select(wide.columns), ["province", "district", "production_year"])


def stage_if_absent(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """rows with ``outcome``: INSERT, SKIPPED where the key is there already, whatever it holds, and REPEATED for all but the first of a key (by its other columns in order)."""
    others = [c for c in rows.columns if c not in key]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*others or key))
    known = existing.select(*key).distinct().withColumn("_there", F.lit(True))
    return rows.withColumn("_nth", nth).join(known, key, "left").withColumn("outcome", F.when(F.col("_there"), "SKIPPED").when(F.col("_nth") > 1, "REPEATED").otherwise("INSERT")).drop("_nth", "_there")


def stage_national(scopes: DataFrame, places: DataFrame, existing: DataFrame) -> DataFrame:
    """(scope_id, production_year, scope_sha256, outcome) of national scopes (scope_id, production_year) with their places (scope_id, province, district): INSERT, SAME or CONFLICT against existing (production_year, scope_sha256).

    A scope's identity is the digest of its distinct places in order; a scope without places is EMPTY, and a second one of a year is REPEATED."""
    from fieldwise.operators.releases import rows_digest

    own = rows_digest(places.select("scope_id", "province", "district").distinct(), ["scope_id"], ["province", "district"], ["province", "district"], "scope_sha256").drop("n_rows")
    nth = F.row_number().over(Window.partitionBy("production_year").orderBy("scope_id"))
    rows = scopes.select("scope_id", "production_year", nth.alias("_nth")).join(own, "scope_id", "left").join(existing.select("production_year", F.col("scope_sha256").alias("_old")), "production_year", "left")
    outcome = F.when(F.col("scope_sha256").isNull(), "EMPTY").when(F.col("_nth") > 1, "REPEATED").when(F.col("_old").isNull(), "INSERT").when(F.col("_old") == F.col("scope_sha256"), "SAME").otherwise("CONFLICT")
    return rows.select("scope_id", "production_year", "scope_sha256", outcome.alias("outcome"))


def equal_requests(requests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fingerprint, first_key, n_equal) of evaluation requests: those of equal fields, whatever the case and spacing of their texts, have one fingerprint, and only the first of them needs to be evaluated."""
    from fieldwise.functions.scalars import digest, squeeze, upper_tr

    kinds = dict(requests.dtypes)
    plain = requests.select(F.col(key).alias("_key"), *[squeeze(upper_tr(F.col(c))).alias(c) if kinds[c] == "string" else F.col(c) for c in fields]).withColumn("fingerprint", digest(*fields))
    firsts = plain.groupBy("fingerprint").agg(F.min("_key").alias(f"first_{key}"), F.count(F.lit(1)).alias("n_equal"))
    return plain.select(F.col("_key").alias(key), "fingerprint").join(firsts, "fingerprint")


def national_scope(parcels: DataFrame, scopes: DataFrame, places: DataFrame, pinned: DataFrame) -> DataFrame:
    """parcels with ``water`` by national sets: scopes (scope_id, production_year, complete), their places (scope_id, province, district) and the pinned list (production_year, province, district).

    A year answers only if it has exactly one complete scope whose places are those of the pinned list: RESTRICTED for them, NOT_RESTRICTED elsewhere. Else UNKNOWN."""
    key = ["production_year", "province", "district"]
    one = scopes.where("complete").groupBy("production_year").agg(F.count(F.lit(1)).alias("n"), F.min("scope_id").alias("scope_id")).where("n = 1").select("production_year", "scope_id")
    own = places.select("scope_id", "province", "district").join(one, "scope_id").select(*key).distinct()
    both = own.withColumn("_own", F.lit(True)).join(pinned.select(*key).distinct().withColumn("_pinned", F.lit(True)), key, "full_outer")
    differ = both.where("_own is null or _pinned is null").select("production_year").distinct()
    sure = one.join(differ, "production_year", "left_anti").select("production_year", F.lit(True).alias("_sure"))
    rows = parcels.join(F.broadcast(sure), "production_year", "left").join(own.withColumn("_in", F.lit(True)), key, "left")  # one row a year
    return rows.withColumn("water", F.when(F.col("_sure").isNull(), "UNKNOWN").when(F.col("_in"), "RESTRICTED").otherwise("NOT_RESTRICTED")).drop("_sure", "_in")


def windows_of(programs: DataFrame, windows: DataFrame, year: Column, as_of: Column) -> DataFrame:
    """programs (program_key, active) with their application window (program_key, production_year, opens, closes) of a year, if any, and its status on the day."""
    from fieldwise.functions.scalars import window_status

    rows = programs.join(windows.where(F.col("production_year") == year), "program_key", "left")
    return rows.select("program_key", "opens", "closes", window_status(F.col("opens"), F.col("closes"), F.col("active"), as_of).alias("window_status"))


def amount_history(rates: DataFrame) -> DataFrame:
    """(program_id, crop_name, nth, production_year, rate_id, unit_amount): a crop's amounts, the newest first."""
    nth = F.row_number().over(Window.partitionBy("program_id", "crop_name").orderBy(F.desc("production_year"), F.desc("rate_id")))
    return rates.select("program_id", "crop_name", nth.alias("nth"), "production_year", "rate_id", "unit_amount")


def members(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """keys with ``there``: whether rows have them."""
    return keys.join(rows.select(*on).distinct().withColumn("there", F.lit(True)), on, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def faq_stats(faqs: DataFrame) -> DataFrame:
    """(category, n_total, n_verified, n_pending, n_live): a row for each category, the largest first, after one for all (category null)."""
    sums = [F.count(F.lit(1)).alias("n_total"), F.count_if("verified").alias("n_verified"), F.count_if(F.col("status") == "PENDING").alias("n_pending"), F.count_if(F.col("harvested_at").isNotNull()).alias("n_live")]
    return faqs.rollup("category").agg(*sums).orderBy(F.desc("n_total"), F.col("category").asc_nulls_first())


def search_faqs(faqs: DataFrame, words: str | None = None, category: str | None = None, verified: bool | None = None, status: str | None = None, most: int = 500) -> DataFrame:
    """Questions whose question, answer or keywords hold the words, in any case, by category and id; at most ``most``, as a page of a listing."""
    rows = faqs
    for name, value in (("category", category), ("verified", verified), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    if words and words.strip():
        own = F.lit(words.strip().lower())
        rows = rows.where(F.contains(F.lower("question"), own) | F.contains(F.lower("answer"), own) | F.contains(F.lower(F.array_join("keywords", ",")), own))
    return rows.orderBy("category", "faq_id").limit(most)


def newest(rows: DataFrame, by: list[str], most: int = 100, **wanted) -> DataFrame:
    """The newest rows that have the wanted values: moderation queues, audit logs, lists of checkpoints and certificates."""
    for name, value in wanted.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(*[F.desc(c) for c in by]).limit(most)


def scan_summary(scanned: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scanned (source_id, url, content_hash, error) against inventory (url, content_hash, ts): (url, status) with NEW, CHANGED, UNCHANGED or ERROR, and (source_id, n, n_changed, n_errors) a source."""
    last = inventory.groupBy("url").agg(F.max_by("content_hash", "ts").alias("_last"))
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("_last").isNull(), "NEW").when(F.col("_last") == F.col("content_hash"), "UNCHANGED").otherwise("CHANGED")
    rows = scanned.join(last, "url", "left").select("source_id", "url", status.alias("status"))
    return rows.select("url", "status"), rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("NEW", "CHANGED")).alias("n_changed"), F.count_if(F.col("status") == "ERROR").alias("n_errors"))


def integrity(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, violations) of captured files (source_id, content) against manifest (source_id, original_sha256, original_bytes, marker): MISSING, BYTES, SHA, MARKER; sources without any have an empty list."""
    rows = manifest.join(members, "source_id", "left")
    found = F.when(F.col("content").isNull(), F.array(F.lit("MISSING"))).otherwise(codes([
        ("BYTES", F.col("original_bytes").isNull() | (F.octet_length("content") == F.col("original_bytes"))), ("SHA", F.col("original_sha256").isNull() | (F.sha2("content", 256) == F.col("original_sha256"))),
        ("MARKER", F.col("marker").isNull() | F.contains(F.col("content").cast("string"), F.col("marker"))),
    ]))
    return rows.select("source_id", found.alias("violations"))


def detect_crop(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, crop_code) by the first name, in order of ordinal, that stands in the question (question_id, text). names (ordinal, name, crop_code): the catalog's names before aliases.

    Names are found in one walk over each question."""
    rows = questions.select(F.col("question_id").alias("text_id"), lower_tr(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    keys = names.select("ordinal", "crop_code", lower_tr(F.col("name")).alias("pattern")).where("length(pattern) >= 3")
    return found_patterns(rows, keys).join(keys, "pattern").groupBy(F.col("text_id").alias("question_id")).agg(F.min_by("crop_code", "ordinal").alias("crop_code"))


def canonical_crop(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (crop) with crop_name: the name of its alias (alias, crop_name), else the crop itself in trimmed upper case."""
    from fieldwise.functions.scalars import lower_tr, upper_tr

    known = aliases.select(lower_tr(F.trim("alias")).alias("_alias"), F.col("crop_name").alias("_name")).dropDuplicates(["_alias"])
    return rows.join(known, lower_tr(F.trim("crop")) == F.col("_alias"), "left").withColumn("crop_name", F.coalesce("_name", upper_tr(F.col("crop")))).drop("_alias", "_name")


def decision_details(decisions: DataFrame, amounts: DataFrame) -> DataFrame:
    """Decisions (parcel_id, program_key, status, ...) beside their amounts (parcel_id, program_key, amount), if any."""
    return decisions.join(amounts, ["parcel_id", "program_key"], "left")

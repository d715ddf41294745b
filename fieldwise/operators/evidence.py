"""Citations, claims and evidence, checked against the pages of archived documents. All look-ups are joins on source, document and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwise.functions.scalars import canonical_url, fold, passage, squeeze
from fieldwise.operators.changes import clause_diff, stage

SHA = "^[0-9a-f]{64}$"
#: Numbers that need no support, and crops that may contradict each other.
FREE_NUMBERS = ["2026", "2025", "2024", *"123456789"]
CROPS = "buğday arpa pamuk ayçiçeği fındık mısır mercimek nohut soya kayısı".split()


def passage_page(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """(citation_id, page_no): the first page of the cited document (doc_id, page_no, text) that holds both the passage (snippet) and the heading (section), if it is given.

    Passages of fewer than 15 characters, or cut short by dots, prove nothing."""
    own = citations.where(~F.contains("snippet", F.lit("..."))).select("citation_id", "doc_id", passage(F.col("snippet")).alias("p"), passage(F.coalesce("section", F.lit(""))).alias("h")).where(F.length("p") >= 15)
    read = pages.join(own.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "page_no", passage(F.col("text")).alias("t"))
    hits = own.join(read, "doc_id").where(F.contains("t", "p") & ((F.col("h") == "") | F.contains("t", "h")))
    return hits.groupBy("citation_id").agg(F.min("page_no").alias("page_no"))


def verify_citations(citations: DataFrame, sources: DataFrame, pages: DataFrame, year: int) -> DataFrame:
    """(citation_id, status, valid, page_no). citations: citation_id, source_id, year, snippet, section, url; sources: source_id, url, active, doc_id (null: not archived).

    The first thing that is wrong gives the status; a citation is VERIFIED only if the registered document holds its passage and heading on one page, the one that its address names, if it names one."""
    known = sources.select("source_id", F.col("url").alias("_url"), "active", "doc_id", F.lit(True).alias("_known"))
    rows = citations.select("citation_id", "source_id", "year", "snippet", "section", "url").join(known, "source_id", "left")
    found = passage_page(rows.where("doc_id is not null and snippet is not null").select("citation_id", "doc_id", "snippet", "section"), pages)
    rows = rows.join(found, "citation_id", "left")
    empty = lambda c: F.coalesce(F.trim(c), F.lit(""))
    named = F.regexp_extract("url", r"#(?:.*&)?page=([^&]*)", 1)
    status = (
        F.when(F.col("_known").isNull(), "INSUFFICIENT_EVIDENCE").when(~F.col("active"), "INACTIVE_SOURCE").when(~F.col("year").eqNullSafe(F.lit(year)), "OUTDATED_YEAR")
        .when(F.length(empty("snippet")) < 10, "EMPTY_OR_SHORT_SNIPPET").when(empty("section") == "", "MISSING_SECTION")
        .when(F.col("url").isNull() | (canonical_url(F.col("url")) != canonical_url(F.col("_url"))), "SOURCE_URL_MISMATCH").when(F.col("doc_id").isNull(), "EVIDENCE_NOT_INDEXED")
        .when(F.col("page_no").isNull(), "PASSAGE_NOT_FOUND").when((named != "") & ~named.try_cast("long").eqNullSafe(F.col("page_no").cast("long")), "PAGE_MISMATCH").otherwise("VERIFIED")
    )
    return rows.withColumn("status", status).select("citation_id", "status", (F.col("status") == "VERIFIED").alias("valid"), F.when(F.col("status") == "VERIFIED", F.col("page_no")).alias("page_no"))


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0))


def verify_claims(claims: DataFrame, sources: DataFrame, verdicts: DataFrame, year: int) -> DataFrame:
    """(claim_id, status, confidence). claims: claim_id, claim, citation_id and the citation's source_id, year, snippet (all null: no citation), document_text (null: not given); verdicts: those of ``verify_citations``.

    In order: a citation, a registered, active source, its year, a snippet of 10 characters, the snippet in the document, the claim's numbers in the snippet, no other crop than the snippet's, then the citation's own proof."""
    known = sources.select("source_id", "active", F.lit(True).alias("_known"))
    rows = claims.join(known, "source_id", "left").join(verdicts.select("citation_id", F.col("status").alias("proof")), "citation_id", "left")
    snippet, claim = F.lower(F.coalesce(F.trim("snippet"), F.lit(""))), F.lower(F.coalesce("claim", F.lit("")))
    unsupported = F.filter(numbers_in(claim), lambda n: ~n.isin(FREE_NUMBERS) & ~F.array_contains(numbers_in(snippet), n))
    crops = F.array(*[F.lit(c) for c in CROPS])
    said, shown = F.filter(crops, lambda c: F.contains(claim, c)), F.filter(crops, lambda c: F.contains(snippet, c))
    conflict = (F.size(said) > 0) & (F.size(shown) > 0) & ~F.arrays_overlap(said, shown)
    status = (
        F.when(F.col("citation_id").isNull(), "NO_CITATION").when(F.col("_known").isNull(), "INSUFFICIENT_EVIDENCE").when(~F.col("active"), "INACTIVE_SOURCE").when(~F.col("year").eqNullSafe(F.lit(year)), "OUTDATED_VERSION")
        .when(F.length(snippet) < 10, "EMPTY_OR_SHORT_SNIPPET").when(F.col("document_text").isNotNull() & ~F.contains(squeeze(F.lower("document_text")), squeeze(snippet)), "SPAN_MISMATCH")
        .when((F.size(unsupported) > 0) | conflict, "UNSUPPORTED_CLAIM").when(F.col("proof") == "VERIFIED", "VERIFIED").when(F.col("proof") == "EVIDENCE_NOT_INDEXED", "EVIDENCE_NOT_INDEXED").otherwise("UNVERIFIED_SOURCE")
    )
    sure = F.when(F.col("status") == "VERIFIED", 1.0).when(F.col("status") == "SPAN_MISMATCH", 0.2).when(F.col("status") == "UNSUPPORTED_CLAIM", 0.1).otherwise(0.0)
    return rows.withColumn("status", status).select("claim_id", "status", sure.alias("confidence"))


def locate_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, status): FOUND if a quote (quote_id, doc_id, page_no, quote) stands exactly once on its page, spacing aside; else LENGTH, MARKUP, NO_PAGE, ABSENT or REPEATED."""
    own = squeeze(F.col("quote"))
    rows = quotes.join(pages.select("doc_id", "page_no", squeeze(F.col("text")).alias("_text")), ["doc_id", "page_no"], "left")
    times = (F.length("_text") - F.length(F.replace(F.col("_text"), own, F.lit("")))) / F.length(own)
    status = (
        F.when(~F.coalesce(F.length(own).between(12, 1500), F.lit(False)), "LENGTH").when(own.rlike("[<>]"), "MARKUP").when(F.col("_text").isNull(), "NO_PAGE")
        .when(times < 1, "ABSENT").when(times > 1, "REPEATED").otherwise("FOUND")
    )
    return rows.select("quote_id", status.alias("status"))


def stage_evidence(quotes: DataFrame, documents: DataFrame, sources: DataFrame, pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Evidence rows of quotes (quote_id, doc_id, page_no, quote, production_year): outcome INSERT, SAME or CONFLICT against existing ones by (doc_id, page_no, quote_sha256), or the reason of a refusal.

    documents: doc_id, source_id, url, kind, document_sha256. Refused are quotes that aren't on their page once, documents that are no PDF, and sources that aren't active or have another address."""
    known = sources.select("source_id", F.col("url").alias("_url"), "active")
    rows = quotes.join(documents, "doc_id", "left").join(known, "source_id", "left").join(locate_quotes(quotes, pages), "quote_id")
    reason = (
        F.when(F.col("document_sha256").isNull() | ~F.col("document_sha256").rlike(SHA), "NO_DOCUMENT").when(F.col("kind") != "PDF", "NOT_PDF").when(~F.coalesce("active", F.lit(False)), "INACTIVE_SOURCE")
        .when(F.col("url") != F.col("_url"), "URL_MISMATCH").when(F.col("status") != "FOUND", F.col("status"))
    )
    rows = rows.withColumn("reason", reason).withColumn("quote_sha256", F.sha2(squeeze(F.col("quote")), 256))
    key = ["doc_id", "page_no", "quote_sha256"]
    one = rows.where("reason is null").groupBy(*key).agg(F.min("quote_id").alias("quote_id"), F.min("document_sha256").alias("document_sha256"), F.min("production_year").alias("production_year"))
    staged = stage(one.select(*key, "document_sha256", "production_year"), existing.select(*key, "document_sha256", "production_year"), key)
    refused = rows.where("reason is not null").select(*key, "document_sha256", "production_year", F.col("reason").alias("outcome"))
    return staged.select(*key, "document_sha256", "production_year", "outcome").unionByName(refused)


def revalidated(evidence: DataFrame, documents: DataFrame, sources: DataFrame, year: int) -> DataFrame:
    """evidence (evidence_id, doc_id, document_sha256, production_year, status) with ``refused``: null, or STATUS, YEAR, NO_DOCUMENT, HASH or SOURCE."""
    docs = documents.select("doc_id", "source_id", F.col("document_sha256").alias("_sha"))
    rows = evidence.join(docs, "doc_id", "left").join(sources.select("source_id", "active"), "source_id", "left")
    why = (
        F.when(~F.col("status").eqNullSafe(F.lit("REVIEWED")), "STATUS").when(~F.col("production_year").eqNullSafe(F.lit(year)), "YEAR").when(F.col("_sha").isNull(), "NO_DOCUMENT")
        .when(F.col("_sha") != F.col("document_sha256"), "HASH").when(~F.coalesce("active", F.lit(False)), "SOURCE")
    )
    return rows.withColumn("refused", why).select(*evidence.columns, "refused")


def anchored(candidates: DataFrame, evidence: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates (candidate_id, evidence_id, production_year, document_sha256, amount) by their evidence: NO_EVIDENCE, YEAR or HASH, else INSERT, SAME or CONFLICT against existing ones."""
    own = evidence.select("evidence_id", F.col("production_year").alias("_year"), F.col("document_sha256").alias("_sha"))
    rows = candidates.join(own, "evidence_id", "left")
    why = F.when(F.col("_year").isNull(), "NO_EVIDENCE").when(F.col("_year") != F.col("production_year"), "YEAR").when(F.col("_sha") != F.col("document_sha256"), "HASH")
    rows = rows.withColumn("_why", why)
    staged = stage(rows.where("_why is null").select(candidates.columns), existing.select(candidates.columns), ["candidate_id"]).select("candidate_id", "outcome")
    return staged.union(rows.where("_why is not null").select("candidate_id", F.col("_why").alias("outcome")))


def evidence_by_program(keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """keys (key_id, program_key, production_year, crop_code or null for any) with the one candidate's evidence_id, and ONE, NONE or AMBIGUOUS."""
    hits = keys.join(candidates.withColumnRenamed("crop_code", "_crop"), ["program_key", "production_year"]).where(F.col("crop_code").isNull() | (F.col("crop_code") == F.col("_crop")))
    sums = hits.groupBy("key_id").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("evidence_id"))
    rows = keys.select("key_id").join(sums, "key_id", "left")
    found = F.when(F.col("n").isNull(), "NONE").when(F.col("n") > 1, "AMBIGUOUS").otherwise("ONE")
    return rows.select("key_id", found.alias("found"), F.when(F.col("n") == 1, F.col("evidence_id")).alias("evidence_id"))


def evidence_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``clause_diff`` of two sets of revalidated evidence (article, paragraph, clause, text, refused); refused rows take no part."""
    key = F.concat_ws(" / ", F.concat(F.lit("MADDE "), F.col("article").cast("string")), F.col("paragraph").cast("string"), "clause")
    own = lambda rows: rows.where("refused is null").select(key.alias("clause_key"), "text")
    return clause_diff(own(previous), own(current))


def explained(decisions: DataFrame, labels: dict[str, str], actions: dict[str, str], citations: DataFrame) -> DataFrame:
    """decisions (parcel_id, program_key, status, amount, failed, missing) with a label, a summary, the reasons, next actions and citations (program_key, citation).

    labels: text of a status, with ``{amount}``; actions: what to do about a missing or failed item, or after a status."""
    of = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    cited = citations.groupBy("program_key").agg(F.array_sort(F.collect_set("citation")).alias("citations"))
    rows = decisions.join(cited, "program_key", "left")
    shown = F.coalesce(F.format_number("amount", 2), F.lit("-"))
    todo = F.array_compact(F.transform(F.concat("missing", F.array("status")), lambda x: of(actions, x)))
    return rows.select(
        "parcel_id", "program_key", "status", F.replace(of(labels, F.col("status")), F.lit("{amount}"), shown).alias("summary"), F.when(F.col("status") == "NOT_ELIGIBLE", F.col("failed")).when(F.col("status") == "REVIEW", F.col("missing")).otherwise(F.array().cast("array<string>")).alias("reasons"),
        todo.alias("next_actions"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
    )

"""Legal operators on awkward rows; the registered queries test them on whole tables."""

import datetime

from pyspark.sql import functions as F

from fieldwise.operators import catalogs, documents, evidence, legislation, releases, retrieval

D = datetime.date


def of(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_types(spark):
    kinds = {
        "YÖNETMELİK\nMADDE 1 - Bu tebliğ": "REGULATION", "X Tebliğinde Değişiklik Yapılmasına Dair Tebliğ": "AMENDMENT", "Karar Sayısı : 12": "DECISION", "Bir talimat": "CIRCULAR", "EK - 3 liste": "ANNEX", "hiçbir şey": "UNKNOWN",
        "Bu değişiklik genelgesi": "CIRCULAR",
    }
    for text, kind in kinds.items():
        assert of(spark, documents.document_type, text) == kind, text
    assert of(spark, documents.document_type, None) == "UNKNOWN"


def test_identity(spark):
    text = "30 Aralık 2025 SALI Resmî Gazete Sayı : 33123\nBİTKİSEL ÜRETİM TEBLİĞİ\nTEBLİĞ\n(Tebliğ No: 7)\nMADDE 1 - (Tebliğ No: 9)"
    i = of(spark, legislation.identity, text)
    assert (i["type"], i["number"], i["gazette_date"], i["gazette_no"], i["title"]) == ("COMMUNIQUE", "7", D(2025, 12, 30), "33123", "BİTKİSEL ÜRETİM TEBLİĞİ")
    i = of(spark, legislation.identity, "8859 sayılı\nCUMHURBAŞKANI KARARI\n5/3/2026 TARİHLİ VE 31000 SAYILI RESMÎ GAZETE")
    assert (i["type"], i["number"], i["gazette_date"], i["authority"]) == ("DECISION", "8859", D(2026, 3, 5), legislation.PRESIDENCY)
    for nothing in ("", None):
        i = of(spark, legislation.identity, nothing)
        assert (i["number"], i["gazette_date"], i["gazette_no"], i["title"]) == (None, None, None, "")


def test_effective_dates(spark):
    f = lambda c: legislation.effective_dates(c, F.lit("2026-01-02").cast("date"))
    e = of(spark, f, "MADDE 1 - 1/1/2020 tarihinde yürürlüğe girer. MADDE 2 - 3/4/2021 tarihinde yürürlüğe girer. 2024 yılı, 2026 üretim yılı")
    assert (e["effective_date"], e["on_publication"], e["exceptions"], e["production_years"]) == (D(2021, 4, 3), False, {}, [2024, 2026])
    e = of(spark, f, None)
    assert (e["effective_date"], e["on_publication"], e["production_years"]) == (None, False, None) or e["production_years"] == []


def test_amendments(spark):
    f = lambda c: legislation.amendment_target(c, documents.document_type(c))
    head = "Tebliğde Değişiklik Yapılmasına Dair Tebliğ\nMADDE 1 - "
    a = of(spark, f, head + "2024/39 sayılı Tebliğ. Aynı Tebliğin 5 inci maddesi ve 7 nci maddesi yürürlükten kaldırılmıştır. Aynı Tebliğin EK - 2 tablosu")
    assert a["base_no"] == "2024/39" and a["modified"][-1] == "EK-2" and "MADDE 7" in a["modified"]
    assert of(spark, f, "Genelge 2024/39 sayılı Tebliğ") is None


def test_faq_pages(spark):
    html = """<div class="faq-item"><h3 class="faq-question">What is the <b>rate</b>?</h3><div class="faq-answer">It is what the table of the year says.<br>Always.</div><span class="faq-citation">m. 3</span></div>
    <div class="faq-item"><h3 class="faq-question">What is the rate?</h3><div class="faq-answer">It is what the table of the year says. Always.</div></div><dl><dt>When is it paid out?</dt><dd>As soon as the lists are final.</dd><dt>Short?</dt><dd>no</dd></dl>"""
    rows = legislation.faq_items(spark.createDataFrame([(1, html), (2, None), (3, "<p>x</p>")], "page_id int, html string")).orderBy("page_id", "nth").collect()
    assert [(r["page_id"], r["nth"], r["question"], r["citation"]) for r in rows if r["nth"] != 2 or r["citation"]][0] == (1, 1, "What is the rate?", "m. 3")
    assert rows[-1]["question"] == "When is it paid out?" and len(rows) in (2, 3)


def test_short_quotes_are_found(spark):
    pages = spark.createDataFrame([(1, "the extraordinarily unconstitutionally long words and more of them"), (2, "nothing"), (3, "one two three four five six seven eight nine ten"), (4, None)], "page_id int, text string")
    quotes = spark.createDataFrame([(1, "unconstitutionally"), (2, "narily unconstit"), (3, "two three four five"), (4, "one two three four five six seven eight"), (5, "three four five"), (6, "too short")], "quote_id int, text string")
    got = {(r["quote_id"], r["page_id"]) for r in retrieval.passage_pages(quotes, pages).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)}
    assert retrieval.passage_pages(quotes.where("quote_id = 6"), pages).count() == 0


def test_passage_with_its_heading(spark):
    pages = spark.createDataFrame([(1, 1, "MADDE 3 bir şey"), (1, 2, "MADDE 3 - Destek öde-\nmesi dekar başına yapılır"), (1, 3, "Destek ödemesi dekar başına yapılır")], "doc_id int, page_no int, text string")
    rows = [(1, 1, "destek ödemesi dekar", "Madde 3"), (2, 1, "destek ödemesi dekar", None), (3, 1, "destek ödemesi...", None), (4, 1, "destek", None), (5, 1, "destek ödemesi dekar", "Madde 9"), (6, 2, "destek ödemesi dekar", None)]
    got = {r["citation_id"]: r["page_no"] for r in evidence.passage_page(spark.createDataFrame(rows, "citation_id int, doc_id int, snippet string, section string"), pages).collect()}
    assert got == {1: 2, 2: 2}


def test_claims_about_other_crops(spark):
    sources = spark.createDataFrame([("s", True)], "source_id string, active boolean")
    rows = [(1, "fındık için 250 lira", 1), (2, "buğday için 250 lira", 1), (3, "buğday için 300 lira", 1)]
    claims = spark.createDataFrame([(i, c, k, "s", 2026, "buğday ve arpa için 250 lira ödenir", None) for i, c, k in rows], "claim_id int, claim string, citation_id int, source_id string, year int, snippet string, document_text string")
    got = {r["claim_id"]: (r["status"], r["confidence"]) for r in evidence.verify_claims(claims, sources, spark.createDataFrame([(1, "VERIFIED")], "citation_id int, status string"), 2026).collect()}
    assert got == {1: ("UNSUPPORTED_CLAIM", 0.1), 2: ("VERIFIED", 1.0), 3: ("UNSUPPORTED_CLAIM", 0.1)}


def test_questions_with_phrases_and_letters(spark):
    faqs = spark.createDataFrame([(1, "Ekim alanı nasıl bildirilir", ["ekim alanı"]), (2, "Ödeme ne zaman", ["ödeme günü", "ödeme günü"]), (3, "Hisseli arazi", ["hisse"])], "faq_id int, question string, keywords array<string>")
    asked = spark.createDataFrame([(1, "EKİM ALANI bildirimi"), (2, "ödeme gününü öğrenmek"), (3, "haciz ve ekim alanı"), (4, "ve ile için"), (5, None)], "question_id int, text string")
    got = {r["question_id"]: (r["faq_id"], r["score"], r["by_rule"]) for r in documents.match_faq(asked, faqs, [("3", ["haciz"], [])]).collect()}
    assert got == {1: (1, 10, False), 2: (2, 7, False), 3: (3, None, True)}


def test_links_of_official_hosts(spark):
    html = '<a href="/a/destek.pdf">x</a><a href="b.html">y</a><a href="https://other.org/destek">z</a><a href="//sub.example.org/DESTEK">w</a><a href="http://example.org/destek">v</a><a href="/a/destek.pdf">x</a>'
    pages = spark.createDataFrame([(1, "https://example.org/dir/page.html", html)], "page_id int, url string, html string")
    assert [r["href"] for r in documents.links(pages, hosts=["example.org"]).orderBy("nth").collect()] == ["https://example.org/a/destek.pdf", "https://example.org/dir/b.html", "https://sub.example.org/DESTEK"]
    assert [r["href"] for r in documents.links(pages, hosts=["example.org"], words=["destek"]).orderBy("nth").collect()] == ["https://example.org/a/destek.pdf", "https://sub.example.org/DESTEK"]
    assert documents.links(pages).count() == 5


def test_sources_and_versions(spark):
    rows = [("a", "u", "GAZETTE", True), ("b", "u", "MINISTRY", True), ("b", "u", "MINISTRY", True), ("c", "", "AGENCY", True), ("d", "u", "CLUB", True), (None, "u", "AGENCY", True), ("e", "u", "AGENCY", False)]
    good, bad = catalogs.load_sources(spark.createDataFrame(rows, "source_id string, url string, authority string, active boolean"))
    assert [r["source_id"] for r in catalogs.active_sources(good).collect()] == ["a"] and {tuple(r) for r in bad.collect()} == {("b", "DUPLICATE"), ("c", "NO_URL"), ("d", "AUTHORITY"), (None, "NO_ID")}
    versions = spark.createDataFrame([("a", 1, "h1", False), ("b", 1, "h1", False)], "source_id string, version int, content_hash string, superseded boolean")
    after = catalogs.append_versions(spark.createDataFrame([("a", "h1"), ("a", "h2"), ("c", "h3")], "source_id string, content_hash string"), versions)
    assert {tuple(r) for r in after.collect()} == {("a", 1, "h1", True), ("a", 2, "h2", False), ("b", 1, "h1", False), ("c", 1, "h3", False)}
    merged = catalogs.upsert(spark.createDataFrame([(1, "new"), (3, "x")], "id int, v string"), spark.createDataFrame([(1, "old"), (2, "y")], "id int, v string"), ["id"])
    assert {tuple(r) for r in merged.collect()} == {(1, "new"), (2, "y"), (3, "x")}
    files = spark.createDataFrame([("f:/x/s1/20260101T000000Z/p.html", b"a"), ("f:/x/s1/20260201T000000Z/p.html", b"b"), ("f:/x/s2/20250101T000000Z/q", b"c"), ("nothing", b"d")], "path string, content binary")
    assert {(r["source_id"], r["taken_at"]) for r in catalogs.latest_snapshots(files).collect()} == {("s1", "20260201T000000Z"), ("s2", "20250101T000000Z")}


def test_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", None), ("g", "g")]
    docs = spark.createDataFrame([(i, "DECISION", D(2025, 1, 1), None, None, t, None, None) for i, t in rows], "id string, kind string, published date, retroactive_from date, amends string, implements string, repealed_by string, original_sha256 string")
    assert {(r["id"], r["violation"]) for r in legislation.inventory_violations(docs).collect()} == {(x, "CYCLE") for x in "abcdg"}


def test_crops_and_annexes(spark):
    crops = catalogs.canonical_crop(spark.createDataFrame([("Sert Buğday ",), ("ıspanak",), (None,)], "crop string"), spark.createDataFrame([("sert buğday", "BUĞDAY")], "alias string, crop_name string"))
    assert [r["crop_name"] for r in crops.collect()] == ["BUĞDAY", "ISPANAK", None]
    children = spark.createDataFrame([("c1", "p", "u1"), ("c2", "p", "u2")], "child_id string, parent_id string, url string")
    assert [r["child_id"] for r in legislation.unlisted_annexes(children, spark.createDataFrame([("p", "u1")], "page_id string, href string")).collect()] == ["c2"]


def test_explanations(spark):
    rows = spark.createDataFrame([(1, "P", "ELIGIBLE", 12.5, [], []), (1, "Q", "REVIEW", None, [], ["CERTIFICATE"]), (2, "P", "NOT_ELIGIBLE", None, ["AREA"], [])], "parcel_id int, program_key string, status string, amount double, failed array<string>, missing array<string>")
    cited = spark.createDataFrame([("P", "m. 3"), ("P", "m. 1")], "program_key string, citation string")
    got = evidence.explained(rows, {"ELIGIBLE": "Fits: {amount}", "REVIEW": "Open", "NOT_ELIGIBLE": "No"}, {"CERTIFICATE": "Bring it", "ELIGIBLE": "Apply"}, cited).collect()
    assert {(r["parcel_id"], r["program_key"]): (r["summary"], r["reasons"], r["next_actions"], r["citations"]) for r in got} == {
        (1, "P"): ("Fits: 12.50", [], ["Apply"], ["m. 1", "m. 3"]), (1, "Q"): ("Open", ["CERTIFICATE"], ["Bring it"], []), (2, "P"): ("No", ["AREA"], [], ["m. 1", "m. 3"]),
    }


def test_bundles_are_published_whole(spark):
    schema = "bundle_id int, rule_no int, program_key string, crop_code string, production_year int, province string, district string, base_coefficient decimal(14,2), category_multiplier decimal(12,4), official_unit_amount decimal(14,2), effective_from date, effective_to date, review_status string, source_sentence_id int"
    from decimal import Decimal

    def rule(bundle, no, year=2026, amount="10.00", sentence=1):
        return (bundle, no, "P", f"c{no % 2}", year, "*", "*", Decimal("10.00"), Decimal("1.0000"), Decimal(amount), D(2026, 1, 1), None, "DRAFT", sentence)

    rows = spark.createDataFrame([rule(1, 1), rule(1, 2), rule(2, 3), rule(2, 4, 2025), rule(3, 5, sentence=9), rule(4, 6), rule(4, 7, amount="11.00")], schema)
    proof = spark.createDataFrame([(1,)], "evidence_id int")
    assert {(r["bundle_id"], r["violation"]) for r in releases.bundle_violations(rows, proof).collect()} == {(2, "YEARS"), (3, "EVIDENCE"), (4, "RULE")}
    assert {r["rule_no"] for r in releases.publishable(rows, proof).collect()} == {1, 2}
    assert rows.select(releases.row_digest("rule_no", "crop_code")).distinct().count() == 7


def test_clauses_of_evidence(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "article int, paragraph int, clause string, text string, refused string")
    old, new = rows((1, 2, "a", "x", None), (1, 3, None, "y", None), (2, None, None, "z", "HASH")), rows((1, 2, "a", "x  ", None), (1, 3, None, "w", None))
    assert {(r["clause_key"], r["change"]) for r in evidence.evidence_diff(old, new).collect()} == {("MADDE 1 / 2 / A", "UNCHANGED"), ("MADDE 1 / 3", "CHANGED")}


def test_small_catalog_helpers(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}") for i in range(5)], "n int, kind string")
    assert [r["n"] for r in catalogs.newest(rows, ["n"], 2, kind="s0").collect()] == [4, 2]
    assert [r["there"] for r in catalogs.members(rows.orderBy("n"), rows.where("n > 2"), ["n"]).orderBy("n").collect()] == [False] * 3 + [True] * 2
    decisions, amounts = spark.createDataFrame([(1, "P", "ELIGIBLE"), (1, "Q", "REVIEW")], "parcel_id int, program_key string, status string"), spark.createDataFrame([(1, "P", 5)], "parcel_id int, program_key string, amount int")
    assert {(r["program_key"], r["amount"]) for r in catalogs.decision_details(decisions, amounts).collect()} == {("P", 5), ("Q", None)}


def test_documents_with_one_text_are_all_listed(spark, tmp_path):
    """Order 20937003 has the text of order 3; both are regulations of their own, as in the query's SQL."""
    import duckdb

    import fieldwise.plans.legal  # noqa: F401  (registers its queries)
    from fieldwise.plans.registry import ORACLE_SQL, QUERIES

    spark.createDataFrame([(3, 1), (9, 1), (20937003, 6), (4, 1)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["legislation_listing"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(ORACLE_SQL["legislation_listing"]).fetchall()) and {r["doc_id"] for r in got} == {3, 9, 20937003}


def test_dates_in_words_and_numbers(spark):
    from fieldwise.functions.scalars import date_tr

    dates = {"2026-01-02": D(2026, 1, 2), " 3.4.2026 ": D(2026, 4, 3), "5/12/2026": D(2026, 12, 5), "7 Şubat 2026": D(2026, 2, 7), "7  SUBAT 2026": D(2026, 2, 7), "7 foo 2026": None, "31.2.2026": None, "": None, None: None}
    rows = spark.createDataFrame(list(enumerate(dates)), "n int, t string").select("n", date_tr(F.col("t")).alias("d"), date_tr(F.col("t"), 1).alias("j")).orderBy("n").collect()
    assert [r["d"] for r in rows] == list(dates.values()) and rows[5]["j"] == D(2026, 1, 7)


def test_pages_are_never_broadcast_for_their_crops(spark, monkeypatch):
    """Pages that look small before they are cut into words; names with as many, fewer and more words than a page, in both ways to join."""
    pages = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Dane mısır, dane MISIR ve arpa!").when(F.col("id") % 3 == 1, "mısır dane").alias("text"))
    crops = spark.createDataFrame([("M", "dane mısır"), ("A", "arpa"), ("A", "Arpa"), ("X", "mısır dane ve arpa"), ("Y", "arp"), ("Z", " ! "), ("Q", None)], "crop_code string, name string")
    for most in (legislation.SMALL_ROWS, 0):
        monkeypatch.setattr(legislation, "SMALL_ROWS", most)
        found = legislation.planned_crops(pages, crops)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == bool(most)
        assert sorted(tuple(r) for r in found.collect()) == sorted((i, c) for i in range(0, 300, 3) for c in "AM")


def test_amendments_in_blocks(spark, monkeypatch):
    """Numbers with more documents than a block, documents that amend their own number, and documents without a number: all pairs, dealt over many tasks."""
    rows = [(i, f"N{i % 3}" if i % 5 else None, f"N{i % 2}" if i % 4 == 0 else None) for i in range(120)]
    flat = spark.createDataFrame(rows, "doc_id long, number string, base_no string")
    catalog = flat.select("doc_id", F.struct("number").alias("identity"), F.when(F.col("base_no").isNotNull(), F.struct("base_no")).alias("amendment"))
    monkeypatch.setattr(legislation, "BLOCK", 7, raising=False)
    monkeypatch.setattr(legislation, "BLOCKS_A_TASK", 1, raising=False)
    found = legislation.amendments_of(catalog)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b) for a, n, _ in rows for b, _, m in rows if n and n == m and a != b)
    assert found.rdd.getNumPartitions() > 20 and "SortMergeJoin [number" not in found._jdf.queryExecution().sparkPlan().toString().split("REPARTITION")[0]
    assert legislation.amendments_of(catalog.where("doc_id < 0")).count() == 0


def test_numbers_alone_as_the_whole_analysis(spark):
    from conftest import SF

    from fieldwise.plans.views import view

    pages = view(spark, SF, "acts").withColumn("page_no", F.lit(1)).union(spark.createDataFrame([(-1, None, 1), (-2, "Tebliğ", 2), (-2, "(Tebliğ No: 2024/5)", 1)], "doc_id long, text string, page_no int"))
    numbers = lambda rows: rows.select("doc_id", "identity.number", "amendment.base_no")
    own, wanted = numbers(legislation.numbered(pages)), numbers(legislation.analyse(pages))
    assert own.count() == wanted.count() > 2 and own.exceptAll(wanted).count() == 0 and own.where("base_no is not null").count() > 0

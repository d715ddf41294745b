import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldwise.operators import changes, documents, lookups, rules
from fieldwise.sources import catalog

RULE = "rule_no int, program_key string, crop_code string, production_year int, province string, district string, official_unit_amount decimal(14,2), effective_from date, effective_to date, review_status string"
D = datetime.date


def parcel(spark, **more):
    facts = {"cks_registered": True, "irrigation": "IRRIGATED", "certified_seed": True, "certified_sapling": True} | more
    schema = "parcel_id int, program_key string, crop_code string, production_year int, province string, district string, area_da decimal(12,2), cks_registered boolean, irrigation string, certified_seed boolean, certified_sapling boolean"
    return spark.createDataFrame([(1, "BASIC_SUPPORT", "c", 2026, "P", "D", Decimal("2.00"), *facts.values())], schema)


def decide(spark, rule_rows, as_of=D(2026, 6, 1), **facts):
    r = rules.entitlements(parcel(spark, **facts), spark.createDataFrame(rule_rows, RULE), F.lit(as_of)).first()
    return r["status"], r["proposed"]


def a_rule(no=1, amount="10.00", status="VERIFIED", start=D(2026, 1, 1), end=D(2026, 12, 31), province="*"):
    return (no, "BASIC_SUPPORT", "c", 2026, province, "*", Decimal(amount), start, end, status)


def test_bitemporal_outcomes(spark):
    assert decide(spark, [a_rule(province="Q")]) == ("UNKNOWN", None)
    assert decide(spark, [a_rule()]) == ("ELIGIBLE", Decimal("20.00"))
    assert decide(spark, [a_rule(status="DRAFT")]) == ("REVIEW", Decimal("20.00"))
    assert decide(spark, [a_rule(), a_rule(2)]) == ("ELIGIBLE", Decimal("20.00"))
    assert decide(spark, [a_rule(), a_rule(2, "11.00")]) == ("REVIEW", None)
    assert decide(spark, [a_rule()], cks_registered=None) == ("REVIEW", Decimal("20.00"))
    assert decide(spark, [a_rule()], cks_registered=False) == ("NOT_ELIGIBLE", Decimal("0.00"))


def test_interval_ends(spark):
    for day, status in ((D(2025, 12, 31), "UNKNOWN"), (D(2026, 1, 1), "ELIGIBLE"), (D(2026, 12, 31), "ELIGIBLE"), (D(2027, 1, 1), "UNKNOWN")):
        assert decide(spark, [a_rule()], day)[0] == status


def test_pricing(spark):
    df = spark.createDataFrame([("ELIGIBLE", Decimal("1.00"), None), ("ELIGIBLE", Decimal("1.00"), Decimal("0.00")), ("ELIGIBLE", Decimal("2.00"), Decimal("1.50")), ("REVIEW", Decimal("2.00"), Decimal("1.50"))], "status string, area_da decimal(12,2), unit_amount decimal(12,2)")
    assert [(r["status"], r["amount"]) for r in rules.priced(df).collect()] == [("REVIEW", None), ("REVIEW", None), ("ELIGIBLE", Decimal("3.00")), ("REVIEW", None)]


def test_clause_diff(spark):
    old = spark.createDataFrame([("madde  1", "x  y"), ("MADDE 2", "x 1.250 TL/da"), ("c", "q"), ("d", "1"), ("d", "2"), ("e", "1"), ("f", "z"), ("f", "z")], "clause_key string, text string")
    new = spark.createDataFrame([("MADDE 1", "x y"), ("madde 2", "x 1.300 TL/da mülga z"), ("g", "n"), ("d", "1"), ("e", None)], "clause_key string, text string")
    got = {r["clause_key"]: (r["change"], r["added"], r["removed"], r["money_changed"], r["repeal"]) for r in changes.clause_diff(old, new).collect()}
    assert got == {
        "MADDE 1": ("UNCHANGED", None, None, False, False), "MADDE 2": ("CHANGED", ["1.300", "mülga", "z"], ["1.250"], True, True), "C": ("REMOVED", None, None, False, False), "G": ("ADDED", None, None, False, False),
        "D": ("AMBIGUOUS", None, None, None, None), "F": ("AMBIGUOUS", None, None, None, None), "E": ("CHANGED", [""], ["1"], False, False),
    }


def test_chain_tampering(spark):
    events = spark.createDataFrame([("c", i, f"p{i}") for i in range(5)], "chain string, event_id long, payload string")
    blocks = changes.append_blocks(events).cache()
    assert changes.chain_violations(blocks).count() == 0
    why = lambda df: [tuple(r) for r in changes.chain_violations(df).collect()]
    assert why(blocks.where("block_index <> 2")) == [("c", 3, "INDEX")]
    assert why(blocks.where("block_index <> 0")) == [("c", 1, "GENESIS")]
    assert why(blocks.withColumn("payload", F.when(F.col("block_index") == 4, "x").otherwise(F.col("payload")))) == [("c", 4, "BLOCK_HASH")]
    tip = blocks.where("block_index = 4").select("chain", "block_index", "block_sha256")
    more = changes.append_blocks(spark.createDataFrame([("c", 9, "p9")], events.schema), tip)
    assert changes.chain_violations(blocks.union(more)).count() == 0


def test_rate_table(spark):
    text = "Kategori 1: wheat, rye katsayi 1,5\n2. Kategori: flax; hemp oran: 1.25\nKategori 3: lentil\nÜrün | 1 | 9\noats | 2 | 2\n| barley | 4 | 0,5 | 1 |\nwheat | 3 | 9\nnoise"
    got = {r["crop"]: (r["category"], r["amount"]) for r in documents.rate_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), F.lit(Decimal("10.01"))).collect()}
    assert got == {
        "wheat": (1, Decimal("15.02")), "rye": (1, Decimal("15.02")), "flax": (2, Decimal("12.51")), "hemp": (2, Decimal("12.51")), "lentil": (3, Decimal("10.01")), "oats": (2, Decimal("20.02")), "barley": (4, Decimal("5.01")),
    }


def test_negative_areas_have_no_amount(spark):
    rows = parcel(spark).withColumn("area_da", F.lit(Decimal("0.00")).cast("decimal(12,2)"))
    r = rules.entitlements(rows, spark.createDataFrame([a_rule()], RULE), F.lit(D(2026, 6, 1))).first()
    assert (r["status"], r["proposed"]) == ("ELIGIBLE", None)


def test_conditions_of_both_kinds(spark):
    df = spark.sql("""select map('crop_code', 'a', 'irrigation', cast(null as string)) as facts, array(named_struct('field', 'crop_code', 'op', 'in', 'value', array('a', 'b')), named_struct('field', 'crop_code', 'op', 'in', 'value', array('c')),
     named_struct('field', 'irrigation', 'op', 'eq', 'value', array('DRY')), named_struct('field', 'crop_code', 'op', 'like', 'value', array('a')), named_struct('field', 'owner', 'op', 'eq', 'value', array('a'))) as conditions""")
    assert df.select(rules.check_conditions(F.col("conditions"), F.col("facts"))).first()[0] == ["MATCHED", "NOT_MATCHED", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_catalog(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2025, "DRAFT"), (2, 2026, "DRAFT"), (3, 2026, "DRAFT")], "rule_no int, production_year int, review_status string")
    path = str(tmp_path / "rules")
    catalog.save_rules(rows, path)
    assert catalog.set_status(spark, path, 2026, "VERIFIED", [2]) == 1
    assert {(r["rule_no"], r["review_status"]) for r in catalog.read_rules(spark, path).collect()} == {(1, "DRAFT"), (2, "VERIFIED"), (3, "DRAFT")}
    assert catalog.rule_years(spark, path) == [2025, 2026] and [r["rule_no"] for r in catalog.list_rules(spark, path, [2026], status="DRAFT").collect()] == [3]


def test_versions_of_the_catalog(spark, tmp_path):
    """A write that fails half way changes nothing; a reader keeps its version; a number that is taken isn't overwritten."""
    path, schema = str(tmp_path / "rules"), "rule_no int, production_year int, review_status string"
    first = catalog.save_rules(spark.createDataFrame([(i, 2025 + i % 2, "DRAFT") for i in range(40)], schema), path)
    pinned = catalog.read_rules(spark, path)
    broken = spark.range(40).repartition(4).select(F.col("id").cast("int").alias("rule_no"), F.lit(2026).alias("production_year"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise("BAD").alias("review_status"))
    with pytest.raises(Exception, match="stop"):
        catalog.save_rules(broken, path)
    assert catalog.versions(spark, path) == [first] and catalog.read_rules(spark, path).where("review_status = 'DRAFT'").count() == 40
    second = catalog.save_rules(spark.createDataFrame([(99, 2026, "NEW"), (98, 2027, "NEW")], schema), path)
    assert sorted(r["rule_no"] for r in catalog.read_rules(spark, path, F.col("production_year") > 2025).collect()) == [98, 99] and catalog.rule_years(spark, path) == [2025, 2026, 2027]
    assert pinned.count() == 40 and catalog.read_rules(spark, path, version=first).count() == 40
    assert not catalog._claim(spark, path, second, {}) and catalog.versions(spark, path) == [first, second]
    catalog.forget_versions(spark, path, keep=1)
    assert catalog.versions(spark, path) == [second] and catalog.read_rules(spark, path).count() == 22
    assert sum(1 for p in (tmp_path / "rules" / "data").glob("*/*")) == 3


def test_conflicts_against_all_pairs(spark):
    import random

    r, day = random.Random(2), lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(n)
    rows = [(i, "p", r.choice("ab"), 2026, r.choice("*x"), "*", day(r.randint(0, 60)), None if i % 9 == 0 else day(r.randint(0, 90)), None if i % 31 == 0 else Decimal(r.randint(1, 3))) for i in range(150)]
    df = spark.createDataFrame(rows, "rule_no int, program_key string, crop_code string, production_year int, province string, district string, effective_from date, effective_to date, official_unit_amount decimal(12,2)").repartition(3)
    end = lambda x: x[7] or datetime.date(9999, 12, 31)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:6] == b[1:6] and a[6] <= end(b) and b[6] <= end(a) and a[8] is not None and b[8] is not None and a[8] != b[8]}
    got = [(x["a_rule"], x["b_rule"]) for x in lookups.rule_conflicts(df).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_digest_of_rows_in_order(spark):
    import hashlib
    import json

    from fieldwise.operators.releases import rows_digest

    rows = [(i % 3 if i % 7 else None, f"k{i * 37 % 50:02d}", None if i % 5 == 0 else f"v{i}") for i in range(60)]
    got = {x["g"]: (x["n_rows"], x["digest"]) for x in rows_digest(spark.createDataFrame(rows, "g int, k string, v string").repartition(4), ["g"], ["k"], ["v", "k"]).collect()}
    for g in {x[0] for x in rows}:
        own = sorted((k, json.dumps({"k": k, "v": v}, separators=(",", ":"))) for x, k, v in rows if x == g)
        assert got[g] == (len(own), hashlib.sha256(("[" + ",".join(t for _, t in own) + "]").encode()).hexdigest())


def test_word_runs_against_plain_subsequences(spark, monkeypatch):
    import random

    from fieldwise.operators import sequences

    r = random.Random(1)
    pairs = [([r.choice("abcd") for _ in range(r.randint(0, 30))], [r.choice("abcd") for _ in range(r.randint(0, 30))]) for _ in range(200)]
    for bits in (1 << 30, 20):
        monkeypatch.setattr(sequences, "BITS", bits)
        for a, b in pairs:
            size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
            own = sequences.common(a, b)
            assert len(own) == size[-1][-1] and all(a[i] == b[j] for i, j in own) and own == sorted(own) and len({i for i, _ in own}) == len({j for _, j in own}) == len(own)
    df = spark.createDataFrame([("k", "a b c d", "b x c c d"), ("m", "one two", "two one"), ("n", None, "x"), ("s", "q", "q")], "clause_key string, old string, new string")
    got = {x["clause_key"]: ([(y["op"], y["at"], y["words"]) for y in x["runs"]], x["n_deleted"], x["n_inserted"]) for x in sequences.clause_runs(df).collect()}
    assert got["k"] == ([("DELETE", 0, ["a"]), ("INSERT", 2, ["x"]), ("INSERT", 3, ["c"])], 1, 2) or got["k"][1:] == (1, 2)
    assert got["m"][1:] == (1, 1) and got["n"] == ([("INSERT", 0, ["x"])], 0, 1) and got["s"] == ([], 0, 0)


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "cases.jsonl").write_text('{"case_id": "a", "area_da": "1.50", "expected_amount": null, "cks_status": null}\n')
    r = catalog.read_cases(spark, str(tmp_path / "cases.jsonl")).first()
    assert (r["case_id"], r["area_da"], r["expected_amount"], r["cks_status"]) == ("a", Decimal("1.50"), None, None)
    catalog.write_results(spark.createDataFrame([("a", 1)], "case_id string, n int"), str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results")).first()["case_id"] == "a"
    (tmp_path / "files").mkdir()
    own = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "files" / f"{own}.pdf").write_bytes(b"x")
    (tmp_path / "files" / f"{'0' * 64}.pdf").write_bytes(b"y")
    assert {(r["sha256"], r["intact"]) for r in catalog.archive(spark, str(tmp_path / "files")).collect()} == {(own, True), ("0" * 64, False)}


def test_streams_of_chunks_answers_and_events(spark, tmp_path):
    from fieldwise.streaming import changes as streams

    def feed(name, schema, batches, run):
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            run(spark.readStream.schema(schema).parquet(str(tmp_path / name))).awaitTermination()

    at = lambda n: str(tmp_path / n)
    feed("chunks", "chunk_id string, text string", [[("a", "1"), ("a", "1"), ("b", "2")], [("b", "2"), ("c", "3")]], lambda df: streams.once_ever(df, "chunk_id", at("store"), at("c1")))
    assert sorted(r["chunk_id"] for r in spark.read.parquet(at("store")).collect()) == ["a", "b", "c"]
    feed("qa", "question string, answer string", [[("q", "a")], [("q", "a"), ("q", "b"), ("r", "c")]], lambda df: streams.watch_harvest(df, at("queue"), at("c2")))
    assert sorted((r["status"], r["version"]) for r in spark.read.parquet(at("queue")).collect()) == [("NEW", 1), ("NEW", 1), ("SUPERSEDES", 2)]
    feed("events", "chain string, event_id long, payload string", [[("x", 1, "p"), ("x", 2, "q")], [("x", 3, "r"), ("y", 4, "s")]], lambda df: streams.append_audit(df, at("chain"), at("c3")))
    blocks = spark.read.parquet(at("chain"))
    assert blocks.count() == 4 and changes.chain_violations(blocks).count() == 0


def test_rows_seen_within_a_delay(spark, tmp_path):
    from fieldwise.streaming.changes import once_within

    t = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([("a", t), ("a", t), ("b", t)], "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = once_within(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in")), "k", "at", "1 hour")
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.table("once").collect()) == ["a", "b"]


def test_root_of_a_chain(spark):
    import hashlib

    blocks = changes.append_blocks(spark.createDataFrame([(f"c{i % 3}", i, f"p{i}") for i in range(50)], "chain string, event_id long, payload string")).cache()
    for r in changes.root_hash(blocks).collect():
        own = sorted((b["block_index"], b["block_sha256"]) for b in blocks.where(F.col("chain") == r["chain"]).collect())
        assert r["root"] == hashlib.sha256("".join(h for _, h in own).encode()).hexdigest() and (r["n_blocks"], r["first_index"], r["last_index"]) == (len(own), 0, len(own) - 1)


def test_moderation_logs_what_applied(spark):
    faqs = spark.createDataFrame([(1, "PENDING", False), (2, "APPROVED", True), (3, "PENDING", False)], "faq_id int, status string, verified boolean")
    done, log = changes.moderate(faqs, spark.createDataFrame([(1, "APPROVE", "m"), (2, "SUPERSEDE", "m"), (3, "DANCE", "m")], "faq_id int, action string, actor string"))
    assert {tuple(r) for r in done.collect()} == {(1, "APPROVED", True), (2, "SUPERSEDED", False), (3, "PENDING", False)} and {r["faq_id"] for r in log.collect()} == {1, 2}


def test_sets_and_first_names(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert {tuple(r) for r in lookups.same_sets(a, b).collect()} == {(1, "a"), (3, "b")} and lookups.same_sets(a, a).count() == 0
    rows = spark.createDataFrame([(1, "sert buğday"), (2, "mısır"), (3, ""), (4, None)], "id int, crop string")
    names = spark.createDataFrame([(1, "buğday", "B"), (2, "sert buğday", "SB"), (3, "dane mısır", "M")], "ordinal int, name string, code string")
    assert {r["id"]: r["code"] for r in lookups.by_first_containment(rows, "crop", names).collect()} == {1: "B", 2: "M", 3: None, 4: None}


def test_stream_of_changes(spark, tmp_path):
    """Each batch starts the stream again; late snapshots change nothing, and a batch that is sent again gives no second event."""
    from fieldwise.streaming.changes import watch_changes

    schema = "source_id string, event_id long, ts timestamp, content_hash string"
    day = lambda n: datetime.datetime(2026, 1, n)
    batches = [[("s", 1, day(5), "x")], [("s", 2, day(6), "x"), ("s", 3, day(7), "y"), ("t", 4, day(6), "z")], [("s", 3, day(7), "y"), ("t", 4, day(6), "z")], [("s", 5, day(1), "q"), ("t", 6, day(8), "z"), ("s", 7, day(9), "y")]]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = watch_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    got = sorted((r["event_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "NEW"), (2, "UNCHANGED"), (3, "UPDATED"), (4, "NEW"), (5, "LATE"), (6, "UNCHANGED"), (7, "UNCHANGED")]
    assert seen == [1, 3, 2, 3]  # no batch reads an earlier one


def test_batches_stay_small_as_stores_grow(spark, tmp_path):
    """Twenty batches of as many new and as many known keys: each reads its own rows alone and adds what is new."""
    from fieldwise.streaming.changes import once_ever

    schema, seen = "chunk_id string, text string", []
    for b in range(20):
        rows = [(f"k{i}", "t") for i in range(max(0, 10 * b - 10), 10 * b + 10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = once_ever(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "chunk_id", str(tmp_path / "store"), str(tmp_path / "cp"))
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert seen == [10] + [20] * 19 and spark.read.parquet(str(tmp_path / "store")).count() == 200


def test_parcels_as_their_view(spark):
    from conftest import SF

    from fieldwise.plans.views import parcels, view

    own, wanted = parcels(spark, SF), view(spark, SF, "parcels")
    assert dict(own.dtypes) == dict(wanted.dtypes) and own.count() == wanted.count() > 0
    assert own.select(wanted.columns).exceptAll(wanted).count() == 0


def test_outcomes_of_cases(spark):
    from fieldwise.operators import retrieval

    cases = spark.createDataFrame([("a", "X", 1.0), ("b", "X", 1.0), ("c", "Y", None), ("d", None, 2.0), ("e", "Y", 1.0)], "case_id string, expected_status string, expected_amount double")
    results = spark.createDataFrame([("a", "X", 1.0), ("b", "X", None), ("c", "X", None), ("d", None, 2.0), ("f", "X", 1.0)], "case_id string, actual_status string, actual_amount double")
    found = {r["case_id"]: r["outcome"] for r in retrieval.case_results(cases, results).collect()}
    assert found == {"a": "PASSED", "b": "AMOUNT", "c": "STATUS", "d": "PASSED", "e": "MISSING"}
    rows = cases.join(results, "case_id", "left")
    assert {r["case_id"]: r["outcome"] for r in retrieval.outcomes(rows, F.col("case_id") != "e").collect()} == found

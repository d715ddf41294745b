import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from fieldwise.functions import scalars as S


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_case_and_folding(spark):
    assert values(spark, S.lower_tr, "İIŞ", "ıi", "", None) == ["iış", "ıi", "", None]
    assert values(spark, S.upper_tr, " ıi ", None) == ["Iİ", None]
    assert values(spark, S.fold, "  ÇOK   Güzel İL ", None) == ["cok guzel il", None]
    assert values(spark, S.slug, "Şeker Pancarı (2)") == ["seker-pancari-2"]


def test_dates(spark):
    day = datetime.date(2026, 3, 5)
    assert values(spark, S.date_tr, "2026-03-05", "5.3.2026", "05/03/2026", "5 Mart 2026", "31.02.2026", "5 Foo 2026", "", None) == [day] * 4 + [None] * 4
    plain = ["subat", "mayis", "agustos", "eylul", "kasim", "aralik", "ŞUBAT", "Ağustos"]
    assert [d.month for d in values(spark, S.date_tr, *[f"5 {m} 2026" for m in plain])] == [2, 5, 8, 9, 11, 12, 2, 8]
    assert values(spark, lambda c: S.date_tr(c, 1), "5 Foo 2026") == [datetime.date(2026, 1, 5)]


def test_money(spark):
    assert values(spark, S.money, "1.250,50 TL", "1.250", "1250,5", "abc", None) == [Decimal("1250.5000"), Decimal("1.2500"), Decimal("1250.5000"), None, None]
    assert values(spark, lambda c: S.positive_decimal(c, 2), "1.25", "0", "-1", "1.255", None) == [Decimal("1.25"), None, None, None, None]


def test_rounding_is_half_up(spark):
    df = spark.sql("select cast(2.5 as decimal(12,2)) as a, cast(0.01 as decimal(12,2)) as b, cast(0.5 as decimal(12,2)) as c")
    assert df.select(S.amount(F.col("a"), F.col("b"))).first()[0] == Decimal("0.03")
    assert df.select(S.amount(F.col("c"), F.col("b"))).first()[0] == Decimal("0.01")


def test_urls(spark):
    official = lambda c: S.official_https(c, ["example.org"])
    assert values(spark, official, "https://example.org/x", "https://a.example.org", "http://example.org", "https://badexample.org", "https://u@example.org/", "https://example.org:444/", None) == [True, True, False, False, False, False, False]
    assert values(spark, S.canonical_url, "https://example.org#a", "https://example.org/x#b") == ["https://example.org/", "https://example.org/x"]


def test_html_and_hash(spark):
    assert values(spark, S.html_text, "<p>a<script>x</script><!-- c --> b</p>") == ["a b"]
    assert values(spark, S.content_hash, "", "  ", None) == [None, None, None]


def test_stems(spark):
    assert values(spark, lambda c: S.stem(c, ["ler", "de"]), "bitkiler", "evler", "iler", "evde", "de", "tarlade") == ["bitki", "evler", "iler", "evde", "de", "tarla"]
    assert values(spark, lambda c: S.stem(c, ["lar", "ı"], {"tarla": "alan", "ekimi": "ekim"}), "tarlalar", "ekimi", "sular") == ["alan", "ekim", "sular"]
    assert values(spark, lambda c: S.stem(c, ["de", "lerde"]), "evlerde") == ["evler"]  # the listed order counts
    assert values(spark, lambda c: S.tokens(c, ["lar"]), "tarlalar su") == [["tarlalar", "tarla", "su"]]
    stop = lambda c: S.without_stop_words(F.split(c, " "), ["ve", "ile"])
    assert values(spark, stop, "su ve tarla", "ve ile") == [["su", "tarla"], ["ve", "ile"]]


def test_money_in_texts(spark):
    got = values(spark, S.money_mentions, "1.250 TL/da, 3 try / Dekar, 12,50 tl. 1.2.3 TL 5 TLx 1234567 TL", "none", None)
    shown = [(m["literal"], m["value"], m["by_area"]) for m in got[0]]
    assert shown == [("1.250 TL/da", Decimal("1250.00"), True), ("3 try / Dekar", Decimal("3.00"), True), ("12,50 tl", Decimal("12.50"), False), ("1234567 TL", Decimal("1234567.00"), False)]
    assert got[1:] == [[], None]
    assert values(spark, S.repeals, "Madde YÜRÜRLÜKTEN  kaldırılmıştır", "mülga", "yürürlükte", None) == [True, True, False, False]
    assert values(spark, S.base_coefficient, "Temel katsayı değeri: 310,5", "dekara 367 TL/da", "nothing") == [Decimal("310.50"), Decimal("367.00"), Decimal("244.00")]
    assert spark.sql("select cast(1234567.5 as decimal(12,2)) as x").select(S.show_money(F.col("x"))).first()[0] == "1.234.567,50"


def test_answers(spark):
    assert values(spark, S.tri_state, "Evet, kayıtlı", "HAYIR", "emin değilim, evet", "aktif", "pasif kayıt", "belki", "", None) == [True, False, None, True, False, None, None, None]
    assert values(spark, S.irrigation, "Sulu tarım", "KURU", "bilmiyorum", "", None) == ["IRRIGATED", "DRY", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_windows(spark):
    df = spark.sql("select * from values (date'2026-01-01', date'2026-02-01', true), (null, date'2026-02-01', true), (date'2026-01-01', date'2026-02-01', false) as t(a, b, c)")
    at = lambda day: [r[0] for r in df.select(S.window_status(F.col("a"), F.col("b"), F.col("c"), F.lit(day).cast("date"))).collect()]
    assert at("2026-01-01") == ["OPEN", "UNVERIFIED", "INACTIVE"] and at("2025-12-31")[0] == "UPCOMING" and at("2026-02-02")[0] == "CLOSED"


def test_digests_ignore_the_order_of_columns(spark):
    import hashlib

    df = spark.sql("select 1 as b, cast(null as string) as a, cast(1.50 as decimal(4,2)) as c")
    want = hashlib.sha256(b'{"a":null,"b":"1","c":"1.50"}').hexdigest()
    assert df.select(S.digest("b", "a", "c"), S.digest("c", "b", "a")).first() == (want, want)


def test_small_texts(spark):
    assert values(spark, lambda c: S.preview(c, 3), "abcd", "abc", None) == ["abc...", "abc", None]
    assert values(spark, lambda c: S.tags(c, ["b", "x", "a"]), "a b") == [["b", "a"]]
    assert values(spark, S.article_mentions, "Madde 12, MADDE 3 ve madde 12") == [[3, 12]]
    link = lambda c: S.evidence_link(c, F.lit(2), F.lit("a b"))
    assert values(spark, link, "a" * 64, "short") == [f"evidence://{'a' * 64}?page=2&quote=a+b", None]
    intents = [("RATE", ["ne kadar", "tutar"]), ("DATE", ["ne zaman"])]
    assert values(spark, lambda c: S.first_intent(c, intents), "Ne ZAMAN ve ne kadar?", "ne zaman", "merhaba") == ["RATE", "DATE", "GENERAL"]
    place = lambda c: S.legal_place(c, F.lit("P"), [("M1", ["çks"]), ("M3", ["tohum"])], {"P": "M2"}, "M0")
    assert values(spark, place, "ÇKS ve tohum", "TOHUM", "başka") == ["M1", "M3", "M2"]
    spans = values(spark, lambda c: S.marked_spans(c, S.LEGAL_MARKS), "MADDE 3 - 1/1/2026 tarihinde 1.250 TL", None)
    assert [(m["from"], m["to"], m["kind"]) for m in spans[0]] == [(0, 7, "ARTICLE"), (10, 18, "DATE"), (29, 37, "AMOUNT")] and spans[1] == []
    assert values(spark, S.passage, "Ben-\nzin  İSTANBUL, ﬁyat!", None) == ["benzin istanbul fiyat", None]
    rows = spark.createDataFrame([(x,) for x in ("İZMİR", "ÇORUM", "CEYHAN", "IĞDIR", "DENİZLİ")], "x string")
    assert [r[0] for r in rows.orderBy(S.tr_order(F.col("x"))).collect()] == ["CEYHAN", "ÇORUM", "DENİZLİ", "IĞDIR", "İZMİR"]


def test_refused_urls(spark):
    why = lambda c: S.refused_url(c, ["example.org"])
    got = values(spark, why, "https://a.example.org/x", "", "http://example.org", "https://localhost/x", "https://10.1.2.3/", "https://192.168.0.1", "https://bad.org", "https:///x", None)
    assert got == [None, "EMPTY", "SCHEME", "LOCALHOST", "PRIVATE_IP", "PRIVATE_IP", "NOT_LISTED", "NO_HOST", "EMPTY"]

"""Scalar functions on columns: text folding, parsing, gates, digests and formats."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def lower_tr(c: Column) -> Column:
    """Lower case with dotted and dotless i; the capital letters of the alphabet are mapped first, so no letter becomes two code points."""
    return F.lower(F.translate(c, "İIĞÜŞÖÇ", "iığüşöç"))


def upper_tr(c: Column) -> Column:
    return F.upper(F.translate(F.trim(c), "iı", "İI"))


def squeeze(c: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """ASCII search form."""
    return squeeze(F.translate(lower_tr(c), "ığüşöçâîû", "igusocaiu"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(lower_tr(c), F.lit("[a-zçğıöşüâîû0-9]+"), 0)


#: Fixed order of endings that are cut from words.
SUFFIXES = "lerden lardan lerine larına lerin ların lere lara ler lar nin nın den dan te ta de da".split()


def stem(word: Column, suffixes: list[str], exact: dict[str, str] | None = None) -> Column:
    """Exact form, else the word without the first listed suffix that leaves three letters, then the exact form of that."""
    known = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]) if exact else None
    look = lambda w: F.coalesce(F.element_at(known, w), w) if exact else w
    if not any(later.endswith(s) and later != s for i, s in enumerate(suffixes) for later in suffixes[i + 1 :]):
        # Longer endings come first, so the first that fits is the longest; those of one length are asked for together.
        cut = word
        for n in sorted({len(s) for s in suffixes}):
            fits = (F.length(word) >= n + 3) & F.right(word, F.lit(n)).isin([s for s in suffixes if len(s) == n])
            cut = F.when(fits, F.left(word, F.length(word) - n)).otherwise(cut)
    else:
        cut = word
        for s in reversed(suffixes):
            cut = F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.left(word, F.length(word) - len(s))).otherwise(cut)
    return F.coalesce(F.element_at(known, word), look(cut)) if exact else cut


def tokens(c: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """Words, each followed by its stem if that is another."""
    own = lambda w: F.transform(F.array(stem(w, suffixes)), lambda s: F.when(s == w, F.array(w)).otherwise(F.array(w, s)))[0]
    return F.flatten(F.transform(words_of(c), own))


def without_stop_words(words: Column, stop: list[str]) -> Column:
    kept = F.filter(words, lambda w: ~w.isin(stop))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


def date_tr(c: Column, unknown_month: int | None = None) -> Column:
    """ISO, D.M.Y, D/M/Y and 'D month Y', months with or without their own letters; anything else, and days that don't exist, are null.

    unknown_month: the month that an unknown name stands for, if any."""
    plain = str.maketrans("ışğüöç", "isguoc")
    dashed = lambda y, m, d: F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))

    def by_name(low: Column) -> Column:
        day, name, year = (F.nullif(F.regexp_extract(low, r"^(\d{1,2}) ([a-z]+) (\d{4})$", i), F.lit("")) for i in (1, 2, 3))
        month = F.nullif(F.array_position(F.array(*[F.lit(x.translate(plain)) for x in MONTHS]), name), F.lit(0))
        if unknown_month:
            month = F.coalesce(month, F.lit(unknown_month))
        return dashed(year, month.cast("string"), day)

    def of(c: Column) -> Column:
        iso = F.try_to_date(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})\s*$", 1))
        d, m, y = (F.nullif(F.regexp_extract(c, r"^\s*(\d{1,2})[./](\d{1,2})[./](\d{4})\s*$", i), F.lit("")) for i in (1, 2, 3))
        return F.coalesce(iso, dashed(y, m, d), bound(fold(c), by_name))

    return bound(c, of)


def money(c: Column) -> Column:
    """Only a comma makes dots group separators: '1.250,50' is 1250.50 and '1.250' is 1.25."""
    bare = F.regexp_replace(F.trim(c), r"(?i)\s*(tl|₺).*$", "")
    plain = F.when(F.contains(bare, F.lit(",")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain).try_cast("decimal(14,4)")


def show_money(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


def positive_decimal(c: Column, scale: int) -> Column:
    ok = c.rlike(rf"^\d+(\.\d{{1,{scale}}})?$") if scale else c.rlike(r"^\d+$")
    value = F.when(ok, c).try_cast(f"decimal(18,{scale})")
    return F.when(value > 0, value)


def amount(area: Column, unit: Column) -> Column:
    """Exact product, rounded half up to two places."""
    return F.round(area * unit, 2).cast("decimal(18,2)")


#: Fixed words of answers: those that leave a question open, and those that say yes or no.
OPEN_WORDS = ("bilmiyorum", "emin değilim", "belirsiz", "?")
YES_WORDS = ("evet", "aktif", "var", "kapama", "✅")
NO_WORDS = ("hayır", "yok", "pasif", "münferit", "❌")


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def tri_state(c: Column) -> Column:
    """True, false or null by the words that an answer holds; words that leave it open come first, then those of yes."""
    low = F.trim(lower_tr(c))
    return F.when(holds_any(low, OPEN_WORDS), F.lit(None).cast("boolean")).when(holds_any(low, YES_WORDS), F.lit(True)).when(holds_any(low, NO_WORDS), F.lit(False))


def irrigation(c: Column) -> Column:
    low = F.coalesce(F.trim(lower_tr(c)), F.lit(""))
    return F.when(holds_any(low, ("bilmiyorum", "emin değilim", "?")), "UNKNOWN").when(F.contains(low, F.lit("kuru")), "DRY").when(F.contains(low, F.lit("sulu")), "IRRIGATED").otherwise("UNKNOWN")


def window_status(start: Column, end: Column, active: Column, as_of: Column) -> Column:
    return (
        F.when(~active, "INACTIVE").when(start.isNull() | end.isNull(), "UNVERIFIED").when(as_of < start, "UPCOMING")
        .when(as_of > end, "CLOSED").otherwise("OPEN")
    )


def canonical_url(c: Column) -> Column:
    bare = F.regexp_replace(c, "#.*$", "")
    return F.regexp_replace(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)$", "$1/")


def official_https(c: Column, hosts: list[str]) -> Column:
    """HTTPS, a host on the list or below one of it, no user, port 443 or none."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h) | host.endswith("." + h)
    port = F.regexp_extract(F.try_parse_url(c, F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.coalesce(listed & (F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & F.try_parse_url(c, F.lit("USERINFO")).isNull() & port.isin("", "443"), F.lit(False))


def html_text(c: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|noscript|iframe)\b.*?</\1\s*>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))


def content_hash(c: Column, html: bool = False) -> Column:
    """SHA-256 of trimmed text, or of what a page shows, so that scripts and tags don't count; empty content has none."""
    digest = F.sha2(html_text(c) if html else F.trim(c), 256)
    return F.when(digest != EMPTY_SHA256, digest)


def digest(*columns: str) -> Column:
    """SHA-256 of compact JSON with the keys in order; nulls are kept, decimals are strings."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


#: An amount of lira: a number that isn't the end of a longer one, the unit, and perhaps the area.
AMOUNT = r"(?i)(?<![\d.,])(\d{1,12}(?:\.\d{3})*(?:,\d{1,2})?)\s*(?:TL|TRY)(\s*/\s*(?:dekar|da))?(?![\p{L}\p{N}_])"


def money_mentions(c: Column) -> Column:
    """Amounts in a text as written, with their values and whether they are by area. In legal texts every dot parts groups of digits."""
    part = lambda i: F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(i))
    value = lambda m: F.translate(F.replace(m, F.lit("."), F.lit("")), ",", ".").try_cast("decimal(16,2)")
    return F.transform(F.arrays_zip(part(0).alias("literal"), part(1).alias("number"), part(2).alias("area")), lambda m: F.struct(m["literal"].alias("literal"), value(m["number"]).alias("value"), (m["area"] != "").alias("by_area")))


def repeals(c: Column) -> Column:
    """Whether a text says that something is repealed."""
    return F.coalesce(lower_tr(c).rlike(r"yürürlükten\s+kaldırılm|mülga"), F.lit(False))


def base_coefficient(c: Column, default: str = "244.00") -> Column:
    """The labelled coefficient of a text, else its first amount of three digits by area, else the default."""
    low = lower_tr(c)
    labelled = F.regexp_extract(low, r"(?:gösterge|katsayı|temel\s*katsayı|birim\s*katsayı)\s*(?:değeri|tutarı)?\s*:\s*(\d+(?:[.,]\d+)?)", 1)
    by_area = F.regexp_extract(low, r"\b(\d{3}(?:[.,]\d{1,2})?)\s*tl/da\b", 1)
    number = F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(by_area, F.lit("")))
    return F.coalesce(F.round(F.translate(number, ",", ".").try_cast("decimal(18,4)"), 2).cast("decimal(14,2)"), F.lit(default).cast("decimal(14,2)"))


def article_mentions(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?i)madde\s+(\d{1,4})"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def tags(c: Column, dictionary: list[str]) -> Column:
    """Words of the dictionary that occur, in its order."""
    return F.filter(F.array(*[F.lit(w) for w in dictionary]), lambda w: F.contains(c, w))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def evidence_link(sha: Column, page: Column, quote: Column) -> Column:
    ok = sha.rlike("^[0-9a-f]{64}$") & (page >= 1)
    return F.when(ok, F.concat(F.lit("evidence://"), sha, F.lit("?page="), page.cast("string"), F.lit("&quote="), F.url_encode(quote)))


def first_intent(c: Column, intents: list[tuple[str, list[str]]]) -> Column:
    """The first intent of the list that has a keyword in the folded text."""
    out = F.lit("GENERAL")
    for name, keys in reversed(intents):
        out = F.when(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(fold(c), k)), name).otherwise(out)
    return out


def refused_url(c: Column, hosts: list[str]) -> Column:
    """Why a URL may not be fetched, or null: EMPTY, SCHEME, NO_HOST, LOCALHOST, PRIVATE_IP, NOT_LISTED."""
    url = F.trim(c)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h) | host.endswith("." + h)
    private = host.rlike(r"^(10|127|0)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^2[4-5]\d\.\d+\.\d+\.\d+$|^\[(::1?|f[cde].*)\]$")
    return (
        F.when(url.isNull() | (url == ""), "EMPTY").when(~F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lit(False)), "SCHEME").when(F.coalesce(host, F.lit("")) == "", "NO_HOST")
        .when(host == "localhost", "LOCALHOST").when(private, "PRIVATE_IP").when(~listed, "NOT_LISTED")
    )


def passage(c: Column) -> Column:
    """Passages for comparison: compatibility forms and case folded, hyphens at line ends joined, other signs as spaces. (Neither form is a SQL function.)"""

    def plain(text: str | None) -> str | None:
        if text is None:
            return None
        text = unicodedata.normalize("NFKC", text).casefold().replace("\u0307", "")
        return " ".join(re.sub(r"[^\w]+", " ", re.sub(r"(?<=\w)-\s+(?=\w)", "", text)).split())

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(plain)

    return folded(c)


def legal_place(text: Column, program: Column, keywords: list[tuple[str, list[str]]], by_program: dict[str, str], default: str) -> Column:
    """The place of the first entry that has a keyword in the text, else the program's, else the default."""
    low, out = lower_tr(text), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in by_program.items() for x in kv]), program), F.lit(default))
    for place, words in reversed(keywords):
        out = F.when(holds_any(low, tuple(words)), place).otherwise(out)
    return out


def marked_spans(text: Column, pattern: str) -> Column:
    """(from, to, kind) spans to mark in a legal text, in order: kind is AMOUNT, DATE or ARTICLE, by whichever group of the pattern is filled."""
    found = re.compile(pattern)

    @F.pandas_udf("array<struct<from:int,to:int,kind:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"from": m.start(), "to": m.end(), "kind": m.lastgroup} for m in found.finditer(t or "")])

    return spans(text)


#: What is marked in legal texts.
LEGAL_MARKS = r"(?P<AMOUNT>\d{1,12}(?:\.\d{3})*(?:,\d{1,2})?\s*(?:TL|TRY)\b)|(?P<DATE>\b\d{1,2}/\d{1,2}/\d{4}\b)|(?P<ARTICLE>\b(?:MADDE|Madde|madde)\s+\d+\b)"


def tr_order(c: Column) -> Column:
    """Key of Turkish alphabetical order."""
    return F.collate(c, "tr")

"""Parcels, rules, rates and the other inputs of the entitlement queries, derived from the given tables.

The texts are plain SQL for Spark and DuckDB alike (``{sha}`` is the engine's SHA-256 in hex)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "line_keys": "select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, sum(floor(l_quantity)) as l_quantity, min(l_shipdate) as l_shipdate from lineitem group by l_orderkey, l_linenumber",
    "parcels": """select l.l_orderkey*10 + l.l_linenumber as parcel_id, o.o_custkey as farmer_id, upper(n.n_name) as province, c.c_mktsegment as district, p.p_brand as crop_code,
 cast(floor(l.l_quantity) as decimal(12,2)) as area_da, year(l.l_shipdate) as production_year,
 case o.o_custkey % 7 when 0 then cast(null as boolean) when 1 then false else true end as cks_registered,
 case l.l_suppkey % 3 when 0 then 'IRRIGATED' when 1 then 'DRY' else 'UNKNOWN' end as irrigation,
 case l.l_partkey % 5 when 0 then cast(null as boolean) when 1 then false else true end as certified_seed,
 case l.l_partkey % 4 when 0 then cast(null as boolean) when 1 then false else true end as certified_sapling,
 case o.o_orderkey % 6 when 0 then cast(null as boolean) when 1 then false else true end as is_closed_orchard
 from line_keys l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join part p on l.l_partkey = p.p_partkey""",
    "programs": "select * from (values (1,'BASIC_SUPPORT'),(2,'PLANNED_PRODUCTION'),(3,'WATER_RESTRICTION'),(4,'CERTIFIED_SEED'),(5,'CERTIFIED_SAPLING')) as t(program_no, program_key)",
    "crops": "select p_brand as crop_code, cast(row_number() over (order by p_brand) as int) as crop_no from (select distinct p_brand from part) d",
    "years": "select distinct year(l_shipdate) as production_year from lineitem",
    "rules": """select g.program_no*1000000 + y.production_year*100 + c.crop_no as rule_no, g.program_key, c.crop_code, y.production_year,
 case when c.crop_no % 6 = 0 then n.province else '*' end as province, '*' as district,
 cast(244 + (y.production_year % 5)*10 as decimal(14,2)) as base_coefficient, cast(1 + (c.crop_no % 4)*0.25 as decimal(12,4)) as category_multiplier,
 cast(round(cast(244 + (y.production_year % 5)*10 as decimal(14,2)) * cast(1 + (c.crop_no % 4)*0.25 as decimal(12,4)), 2) as decimal(14,2)) as official_unit_amount,
 make_date(y.production_year,1,1) as effective_from, case when c.crop_no % 5 = 0 then cast(null as date) else make_date(y.production_year,12,31) end as effective_to,
 case when c.crop_no % 3 = 0 then 'DRAFT' else 'VERIFIED' end as review_status
 from programs g cross join years y cross join crops c cross join (select min(upper(n_name)) as province from nation) n where (g.program_no + c.crop_no) % 7 <> 0
 union all
 select 9000000 + g.program_no*100000 + (y.production_year - 1990)*100 + c.crop_no, g.program_key, c.crop_code, y.production_year, '*', '*',
 cast(300 as decimal(14,2)), cast(1 as decimal(12,4)), cast(300 as decimal(14,2)), make_date(y.production_year,7,1), cast(null as date), 'VERIFIED'
 from programs g cross join years y cross join crops c where c.crop_no % 8 = 0""",
    "rates": """select g.program_no*1000000 + y.production_year*100 + c.crop_no as rate_id, g.program_key as program_id, c.crop_code as crop_name, y.production_year,
 case when c.crop_no % 9 = 0 then n.province else '*' end as province, case when c.crop_no % 9 = 0 then n.district else '*' end as district,
 cast(100 + c.crop_no*3 + g.program_no as decimal(12,2)) as unit_amount, make_date(y.production_year,1,1) as effective_from,
 case when c.crop_no % 5 = 0 then make_date(y.production_year,6,30) else cast(null as date) end as effective_to, cast(c.crop_no % 10 + 1 as int) as source_version_id,
 case when c.crop_no % 3 = 0 then 'DRAFT' when c.crop_no % 11 = 0 then 'REVOKED' else 'VERIFIED' end as review_status
 from programs g cross join years y cross join crops c cross join (select min(upper(n_name)) as province, 'BUILDING' as district from nation) n
 union all
 select 9000000 + y.production_year, 'BASIC_SUPPORT', c.crop_code, y.production_year, '*','*', cast(999 as decimal(12,2)), make_date(y.production_year,1,1), cast(null as date), 1, 'VERIFIED'
 from years y cross join crops c where c.crop_no = 4""",
    "source_versions": "select p.program_no*2 + k as id, concat('SRC-', cast(p.program_no as varchar(5))) as source_id, {sha}(concat('v', cast(p.program_no*2 + k as varchar(5)))) as content_hash, (p.program_no*2 + k) % 6 = 0 as superseded from programs p cross join (select -1 as k union all select 0) x",
    "segments": "select distinct c_mktsegment from customer",
    "basin": "select distinct upper(n.n_name) as province, c.c_mktsegment as district, cr.crop_code, (n.n_nationkey % 4 = 0) as drip_required, (n.n_nationkey % 5 <> 0) as coverage_complete from nation n cross join segments c cross join crops cr where (n.n_nationkey + cr.crop_no) % 3 <> 0",
    "seg_nos": "select c_mktsegment, cast(row_number() over (order by c_mktsegment) as int) as seg_no from (select distinct c_mktsegment from customer) d",
    "dist_years": "select n.n_nationkey as nk, g.seg_no as sg, y.production_year as yr, upper(n.n_name) as province, g.c_mktsegment as district, (n.n_nationkey * 7 + g.seg_no * 3 + y.production_year) % 23 as k from nation n cross join seg_nos g cross join years y",
    "snap_versions": """select production_year * 10 + v as id, case when v = 3 then 'OTHER' else 'LIST' end as source_id, case when v = 2 then {sha}('other') when v = 4 then 'x' else {sha}('list') end as content_hash, case when v = 5 then cast(null as date) else make_date(cast(production_year as bigint), 2, 1) end as detected_at,
 case when v = 6 then make_date(cast(production_year as bigint), 4, 1) end as superseded_at, case when v = 7 then make_date(cast(production_year as bigint) + 1, 1, 1) when v = 8 then make_date(cast(production_year as bigint), 10, 1) else make_date(cast(production_year as bigint), 1, 1) end as effective_from,
 case when v = 9 then make_date(cast(production_year as bigint) - 1, 6, 1) end as effective_to from years cross join (select 0 as v union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9) z""",
    "snap_sources": "select 'LIST' as source_id, 'https://example.org/list' as url, true as active union all select 'OTHER', 'https://example.org/other', true union all select 'GONE', 'https://example.org/gone', false",
    "snap_rows": """select (nk * 10 + sg) * 10000 + yr + 0 as snapshot_id, province, district, yr as production_year, nk, sg, k, case when k = 1 then 'DRAFT' else 'VERIFIED' end as review_status, k <> 2 as coverage_complete, case when k = 3 then ' ' else 'R' end as reviewed_by,
 case when k = 4 then cast(null as date) when k = 5 then make_date(cast(yr as bigint), 7, 1) else make_date(cast(yr as bigint), 3, 1) end as reviewed_at, 'ref' as review_reference, case when k = 6 then 0 else 3 end as document_page, cast(yr * 10 + case when k in (7, 8, 9, 10, 11, 12, 13, 14) then k - 5 else 0 end as bigint) as source_version_id,
 nk % 4 = 0 as drip_required from dist_years where k <> 0
 union all select (nk * 10 + sg) * 10000 + yr + 5000000, province, district, yr, nk, sg, k, 'VERIFIED', true, 'R', make_date(cast(yr as bigint), case when k = 15 then 8 else 3 end, 1), 'ref', 3, cast(yr * 10 as bigint), false from dist_years where k in (15, 16)""",
    "snap_crops": "select r.snapshot_id, c.crop_code from snap_rows r cross join crops c where (r.nk + c.crop_no) % 3 <> 0 and r.k <> 17 union all select r.snapshot_id, '' from snap_rows r where r.k = 18 union all select r.snapshot_id, c.crop_code from snap_rows r cross join crops c where r.k = 19 and c.crop_no < 4",
    "snap_signed": "select snapshot_id from snap_rows where k <> 20",
    "water_rows": """select snapshot_id as record_id, province, district, production_year, review_status, reviewed_by, reviewed_at, review_reference, document_page, source_version_id, make_date(cast(production_year as bigint), 1, 1) as effective_from,
 case when k = 21 then make_date(cast(production_year as bigint) - 1, 1, 1) end as effective_to, case nk % 3 when 0 then 'RESTRICTED' when 1 then 'NOT_RESTRICTED' else 'UNDER_REVIEW' end as restriction_status from snap_rows""",
    "water": "select upper(n.n_name) as province, c.c_mktsegment as district, case n.n_nationkey % 3 when 0 then 'RESTRICTED' when 1 then 'NOT_RESTRICTED' else 'UNDER_REVIEW' end as restriction_status from nation n cross join segments c where n.n_nationkey % 7 <> 0",
    "attestations": """select o_orderkey as subject_id, 'REVIEWER' as role, concat('p', cast(o_custkey % 50 as varchar(10))) as principal_id, {sha}(cast(o_orderkey as varchar(20))) as subject_digest, o_orderkey % 11 <> 0 as signature_valid from orders
 union all
 select o_orderkey, 'APPROVER', concat('p', cast((o_custkey + case when o_orderkey % 13 = 0 then 0 else 1 end) % 50 as varchar(10))), {sha}(cast(case when o_orderkey % 17 = 0 then 0 else o_orderkey end as varchar(20))), true from orders where o_orderkey % 9 <> 0""",
    "act_keys": "select o_orderkey as doc_id, o_orderkey % 6 as kind_no, o_orderkey % 997 as k, o_custkey % 5 as clause_no, cast(o_orderkey % 12 + 1 as int) as month_no, cast(o_orderkey % 28 + 1 as int) as day_no, 30000 + o_orderkey % 3000 as gazette from orders",
    "acts": """select doc_id, concat(case kind_no when 0 then concat('TARIM BAKANLIĞINDAN:', chr(10), 'BİTKİSEL ÜRETİME DESTEKLEME ÖDEMESİNE DAİR TEBLİĞ', chr(10), '(TEBLİĞ NO: 2024/', k, ')')
 when 1 then concat('BİTKİSEL ÜRETİME DAİR TEBLİĞ (TEBLİĞ NO: 2024/', k, ')', chr(39), 'DE DEĞİŞİKLİK YAPILMASINA DAİR TEBLİĞ', chr(10), '(TEBLİĞ NO: 2025/', k + 1, ')')
 when 2 then concat('CUMHURBAŞKANI KARARI', chr(10), 'Karar Sayısı: ', 8000 + k) when 3 then 'BİTKİSEL ÜRETİM DESTEKLEME YÖNETMELİĞİ' when 4 then 'BİTKİSEL ÜRETİM GENELGESİ' else 'EK-1 DESTEK KATSAYI TABLOSU' end,
 chr(10), day_no, ' ', case month_no when 1 then 'Ocak' when 2 then 'Şubat' when 3 then 'Mart' when 4 then 'Nisan' when 5 then 'Mayis' when 6 then 'Haziran' when 7 then 'Temmuz' when 8 then 'Ağustos' when 9 then 'EYLÜL' when 10 then 'Ekim' when 11 then 'Kasım' else 'aralik' end,
 ' 2024 TARİHLİ VE ', gazette, ' SAYILI RESMÎ GAZETE', chr(10),
 case when clause_no = 4 then 'MADDE 1 - 2026 üretim yılı için dekar başına 1.' else 'MADDE 1 - 2025-2026 üretim yılları için dekar başına 1.' end, 100 + k % 900, ',50 TL/da ödenir.', chr(10),
 case when kind_no = 1 then concat('24/8/2024 tarihli ve 32642 sayılı Resmî Gazete', chr(39), 'de yayımlanan Bitkisel Üretime Dair Tebliğ (Tebliğ No: 2024/', k, ')', chr(39), 'in 3 üncü maddesi değiştirilmiştir.', chr(10)) else '' end,
 'MADDE 2 - ', case clause_no when 0 then 'Bu metin yayımı tarihinde yürürlüğe girer.' when 1 then 'Bu metin 1/1/2026 tarihinde yürürlüğe girer.'
 when 2 then 'Bu metnin 10 uncu maddesi 1/5/2026 tarihinde, diğer maddeleri 1/1/2026 tarihinde yürürlüğe girer.' when 3 then 'Bu metin 1/2/2026 tarihinde veya 1/3/2026 tarihinde yürürlüğe girer.' else 'Bu metni ilgililer yürütür; eski tebliğ yürürlükten kaldırılmıştır.' end) as text from act_keys""",
    "annex_pages": """select p_partkey as doc_id, 1 as page_no, concat('EK-1 TEMEL DESTEK KATSAYI TABLOSU', chr(10), case when p_partkey % 2 = 0 then concat('Kategori ', p_partkey % 3 + 1, ': ') else concat(p_partkey % 3 + 1, '. Kategori: ') end, 'buğday, arpa',
 case p_partkey % 4 when 0 then '' when 1 then ' katsayı: 1,25' when 2 then ' oran 1,5' else ' çarpan: 1.75' end, chr(10), 'Ürün | 9 | 9', chr(10), 'çavdar | 2 | 2', chr(10), 'arpa | 3 | 9') as text from part
 union all select p_partkey, 2, concat('EK-2 PLANLI ÜRETİM ÜRÜN LİSTESİ', chr(10), 'Bu listede dane mısır ve ', case when p_partkey % 2 = 0 then 'ayçiçeği' else 'ayçiçeğinden' end, ' bulunur.') from part
 union all select p_partkey, 3, concat('EK-3 SU KISITI İLÇELERİ', chr(10), 'ANKARA: Polatlı, Haymana', case when p_partkey % 2 = 0 then concat(chr(10), 'KONYA: Cihanbeyli') else '' end) from part
 union all select p_partkey, 4, concat('EK-4 SERTİFİKALI TOHUM LİSTESİ', chr(10), 'nohut | 1 | 1,2', chr(10), 'EK-1 yine anılır') from part""",
    "src_pages": "select cast(floor(doc_id / 8) as bigint) as doc_id, cast(doc_id % 8 + 1 as int) as page_no, coalesce(text, '') as text, doc_id as own_id from documents",
    "srcs": "select concat('S-', doc_id) as source_id, concat('https://example.org/', doc_id) as url, doc_id % 7 <> 0 as active, case when doc_id % 11 <> 0 then doc_id end as doc_id from (select distinct doc_id from src_pages) x",
    "cites": """select own_id as citation_id, case when own_id % 13 = 0 then 'S-none' else concat('S-', doc_id) end as source_id, case when own_id % 10 = 0 then 2025 else 2026 end as year,
 case when own_id % 17 = 0 then 'short' when own_id % 5 = 0 then concat(substring(text, 20, 60), ' zzqq') else substring(text, 20, 60) end as snippet, case when own_id % 19 = 0 then ' ' else substring(text, 1, 8) end as section,
 case when own_id % 23 = 0 then 'https://example.org/x' else concat('https://example.org/', doc_id, case own_id % 4 when 0 then concat('#page=', page_no) when 1 then '#page=9' else '' end) end as url, text, page_no, doc_id from src_pages where length(text) >= 90""",
    "claims": """select citation_id + 1000000 as claim_id, case citation_id % 4 when 0 then 'bu destek 77777 lira' when 1 then 'bu destek 5 lira' else 'bu destek verilir' end as claim, case when citation_id % 9 <> 0 then citation_id end as citation_id,
 case when citation_id % 9 <> 0 then source_id end as source_id, case when citation_id % 9 <> 0 then year end as year, case when citation_id % 9 <> 0 then snippet end as snippet, case citation_id % 6 when 0 then 'something else' when 1 then text end as document_text from cites""",
    "rel_entries": """select r.production_year * 10 + s.s as release_id, s.s, r.production_year, r.program_id as program_key, r.crop_name as crop_code, r.province, r.district, r.rate_id, r.rate_id as candidate_id, r.rate_id + 1 as evidence_id,
 {sha}(concat('rate', r.rate_id)) as rate_digest, {sha}(concat('cand', case when r.production_year % 5 = 3 then 0 else r.rate_id end)) as candidate_digest, r.source_version_id from rates r cross join (select 0 as s union all select 1 union all select 2) s
 where r.rate_id < 9000000 and r.program_id = 'BASIC_SUPPORT' and r.review_status = 'VERIFIED' and r.rate_id % 100 % 5 <> 0 and r.rate_id % 100 <> 4 and (s.s <> 1 or r.production_year % 2 = 0) and not (r.production_year % 7 = 2 and r.rate_id % 100 = 7)""",
    "registry_rows": "select case when page_id % 19 = 0 then ' ' when page_id % 23 = 1 then concat('P', page_id - 1) else concat('P', page_id) end as source_id, case when page_id % 17 = 0 then '' else url end as url, case page_id % 5 when 0 then 'GAZETTE' when 1 then 'MINISTRY' when 2 then 'AGENCY' when 3 then 'BLOG' else 'AGENCY' end as authority, page_id % 2 = 0 as active, page_id from pages",
    "qa": "select u.conv_id, u.turn, u.text as question, a.text as answer, case when u.conv_id % 2 = 0 then 1 else 2 end as batch_no from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'",
    "faqs": """select conv_id * 1000 + turn as faq_id, concat('c', conv_id % 7) as category, question, answer, conv_id % 3 = 0 as verified, case conv_id % 4 when 0 then 'PENDING' when 1 then 'APPROVED' when 2 then 'REJECTED' else 'SUPERSEDED' end as status,
 case when conv_id % 5 <> 0 then conv_id end as harvested_at from qa""",
    "snapshots": "select concat('s', cast(user_id as varchar(20))) as source_id, event_id, ts, {sha}(concat(event_type, cast(event_id % 3 as varchar(5)))) as content_hash from events",
}


def _with(names: list[str], head: str, sha: str) -> str:
    """WITH clause of the named views and of those that they use, in the order above."""
    import re

    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in wanted:
            wanted.add(name)
            todo += re.findall(r"\w+", VIEWS[name])
    body = [f"{n} as ({VIEWS[n].format(sha=sha)})" for n in VIEWS if n in wanted]
    return ", ".join([head] * bool(head) + body)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = ", ".join(f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if t in _needed(name))
    text = _with([name], base, "sha2_hex").replace("sha2_hex(", "sha2_256(")
    return spark.sql(f"with {_spark_sha(text)} select * from {name}")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``parcels``, planned for large tables: each line is dealt twice, by order and by part, as whole numbers alone.

    Orders meet their customers before their lines do; the smaller side of each join is hashed, so lines aren't sorted. Sizes that Spark guesses from files don't make it broadcast orders, customers or parts."""
    read = lambda name, *columns: view(spark, sf_dir, name).select(*columns)
    nations = read("nation", F.col("n_nationkey").alias("nation"), F.upper("n_name").alias("province"))
    customers = read("customer", F.col("c_custkey").alias("farmer_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("district")).hint("shuffle_hash")
    orders = read("orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("farmer_id")).join(customers, "farmer_id").hint("shuffle_hash")
    parts = read("part", F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("crop_code")).hint("shuffle_hash")
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity").alias("area"), F.year("l_shipdate").alias("production_year")).where("l_orderkey is not null")
    # Dealt by order alone, lines have their number of a parcel and their order in one place.
    keys = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[f(c).alias(c) for c, f in (("l_partkey", F.min), ("l_suppkey", F.min), ("area", F.sum), ("production_year", F.min))])
    rows = keys.join(orders, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("parcel_id"), "farmer_id", "nation", "district", "l_partkey", "area", "production_year", (F.col("l_suppkey") % 3).alias("supplier_no"), (F.col("l_orderkey") % 6).alias("order_no"),
    )
    rows = rows.join(parts, "l_partkey").join(F.broadcast(nations), "nation")
    fact = lambda c, n: F.when(c % n == 0, F.lit(None)).when(c % n == 1, False).otherwise(True)
    return rows.select(
        "parcel_id", "farmer_id", "province", "district", "crop_code", F.col("area").cast("decimal(12,2)").alias("area_da"), "production_year", fact(F.col("farmer_id"), 7).alias("cks_registered"),
        F.when(F.col("supplier_no") == 0, "IRRIGATED").when(F.col("supplier_no") == 1, "DRY").otherwise("UNKNOWN").alias("irrigation"),
        fact(F.col("l_partkey"), 5).alias("certified_seed"), fact(F.col("l_partkey"), 4).alias("certified_sapling"), fact(F.col("order_no"), 6).alias("is_closed_orchard"),
    )


def _needed(name: str) -> set[str]:
    import re

    seen, todo = set(), [name]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += re.findall(r"\w+", VIEWS.get(at, ""))
    return seen


def _spark_sha(text: str) -> str:
    """Spark's SHA-256 takes the number of bits as a second argument."""
    out, at = "", 0
    while (i := text.find("sha2_256(", at)) >= 0:
        depth, j = 1, i + len("sha2_256(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += text[at:i] + "sha2(" + text[i + len("sha2_256(") : j - 1] + ", 256)"
        at = j
    return out + text[at:]


def oracle(names: str, query: str) -> str:
    """A query over views, for DuckDB. ``query`` may itself start with WITH."""
    head = f"with {_with(names.split(), '', 'sha256')}"
    query = query.strip()
    return f"{head}, {query[5:]}" if query.lower().startswith("with ") else f"{head} {query}"

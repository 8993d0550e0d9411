"""Candidates of readers, exam sheets and status reports over documents, events, orders, lineitem, customer and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, candidates, exams, hierarchy, ingest, routing, scans, wiki
from ..plans.registry import query

#: What is put behind every text as a reader's formula, by the document's number.
TAILS = ["", r" \vec a", r" {}^{4}He", r" a_{1}+b^{2}", r" \sqrt{2}", r" \frac{1}{\frac{2}{3}}", r" \begin{cases} 速 �", " ??"]
TAIL = " ".join(f"when {k} then '{x}'" for k, x in enumerate(TAILS))
SPACE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


@query("g02_flags", rf"""with t as (select doc_id, case when doc_id % 10 = 0 then null else doc_id % 100 / 100.0 end as c,
regexp_replace(case when doc_id % 8 = 7 and doc_id % 3 = 0 then '$ \left' || left(lang, 1) || '\right $' else text || case doc_id % 8 {TAIL} end end, '{SPACE}', '', 'g') as x from documents),
r as (select doc_id, c, x, [case when contains(x, '�') then 'replacement_character' end, case when c < 0.92 then 'low_confidence' end, case when regexp_matches(x, '\?\?') then 'unresolved_engine_specific_garble' end,
case when regexp_matches(x, '[\x{{3400}}-\x{{9fff}}]') then 'chinese_formula_text' end, case when regexp_matches(x, '\\(?:vec|rightharpoonup|overrightarrow|mathbf)\b') then 'vector_notation' end,
case when regexp_matches(x, '\{{\}}\s*[_^]\{{|[_^]\{{[^}}]+\}}.*[_^]\{{[^}}]+\}}') then 'nuclear_or_multi_script' end, case when x = '' then 'empty_candidate' end,
case when regexp_full_match(regexp_replace(replace(replace(regexp_replace(x, '^\$+|\$+$', '', 'g'), '\left', ''), '\right', ''), '\s+', '', 'g'), '[A-Za-z0-9]') then 'single_character_formula' end,
case when regexp_matches(x, '\\(?:frac|dfrac|tfrac|sqrt)\b') then 'fraction_or_root' end,
case when len(regexp_extract_all(x, '\\frac')) >= 2 or regexp_matches(x, '\\(?:begin\{{(?:matrix|cases)|sum|int)\b') then 'complex_formula_structure' end] as f from t)
select doc_id, array_to_string(list_sort(list_filter(f, lambda y: y is not null)), ',') as flags, case when x = '' or coalesce(c < 0.55, false) then 'machine_abstain' else 'machine_candidate' end as status from r""")
def g02_flags(t):
    k = F.col("doc_id")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (k % 8).cast("int") + 1)
    text = F.when((k % 8 == 7) & (k % 3 == 0), F.concat(F.lit(r"$ \left"), F.substring("lang", 1, 1), F.lit(r"\right $"))).otherwise(F.concat("text", tail))
    rows = t.documents.select(k.alias("doc_id"), F.col("lang").alias("engine"), text.alias("text"), F.when(k % 10 != 0, k % 100 / 100.0).alias("confidence"), F.lit(None).cast("array<string>").alias("risk_flags"))
    judged = candidates.assessed(rows, garbled=r"\?\?")
    return judged.select("doc_id", F.array_join("risk_flags", ",").alias("flags"), "status")


@query("g03_resolved", """with e as (select user_id, event_type, 'x=' || cast(cast(floor(value) as bigint) % 2 as varchar) as n, round(0.5 + event_id % 50 / 100.0, 2) as c from events),
g as (select user_id, n, list_sort(list(distinct event_type)) as engines from e where c >= 0.92 group by 1, 2 having bool_or(event_type = 'click') and bool_or(event_type = 'view')),
w as (select * from g qualify row_number() over (partition by user_id order by len(engines) desc, n) = 1),
k as (select user_id, bool_and(c < 0.55) as none, bool_or(c < 0.92) as low, count(distinct case when c >= 0.55 then n end) > 1 as varied, user_id % 9 = 0 as cut from e group by 1)
select k.user_id as key, case when w.n is not null and not cut then 'machine_final' when none then 'machine_abstain' else 'needs_vlm' end as status, case when not cut then w.n end as final, case when not cut and w.n is not null then array_to_string(engines, ',') else '' end as agreed,
case when w.n is not null and not cut then '' else concat_ws(',', case when varied and w.n is null then 'engine_disagreement' end, case when low then 'low_confidence' end, case when cut then 'render_geometry_risk' end) end as flags from k left join w on w.user_id = k.user_id""")
def g03_resolved(t):
    rows = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("engine"), F.concat(F.lit("$x = "), (F.floor("value") % 2).cast("string"), F.lit("$")).alias("text"), (F.lit(0.5) + F.col("event_id") % 50 / 100.0).alias("confidence"), F.lit(None).cast("array<string>").alias("risk_flags"))
    rows = rows.withColumn("confidence", F.round("confidence", 2))
    geometry = t.events.where("user_id % 9 = 0").select(F.col("user_id").alias("key"), F.lit("cut").alias("issue"))
    found = candidates.resolved(candidates.assessed(rows), ["click", "view"], geometry)
    return found.select("key", "status", "final", F.array_join("agreed", ",").alias("agreed"), F.array_join("risk_flags", ",").alias("flags"))


@query("f28_failures", """select event_type as label, count(*) as count, count(*) filter (value > 50) as ok, count(*) filter (not value > 50) as failed, array_to_string((list(event_id order by ts, event_id) filter (not value > 50))[1:20], ',') as failures,
greatest(count(*) filter (not value > 50) - 20, 0) as truncated_failures from events group by 1""")
def f28_failures(t):
    rows = t.events.select(F.col("event_type").alias("label"), F.struct("ts", "event_id").alias("position"), F.col("event_id").cast("string").alias("key"), F.col("user_id").cast("string").alias("title"), (F.col("value") > 50).alias("ok"), F.col("props").alias("error"))
    return exams.import_status(rows).withColumn("failures", F.array_join(F.transform("failures", lambda x: x["key"]), ","))


@query("j13_accepted", """select l_suppkey as model, count(*) filter (passed) as score, count(*) as out_of, bool_and(formed) as schema_valid, bool_and(passed or not safe) as safety_passed, count(*) filter (critical) as critical,
bool_and(formed) and bool_and(passed or not safe) and count(*) filter (critical) = 0 and count(*) filter (passed) / count(*) >= 0.8 as accepted
from (select *, l_quantity > 6 as passed, l_linenumber < 7 or l_suppkey % 4 > 0 as formed, l_discount >= 0.1 and l_suppkey % 3 = 0 as critical, l_tax = 0.08 and l_quantity > 2 and l_suppkey % 2 = 0 as safe from lineitem) group by 1""")
def j13_accepted(t):
    k = F.col("l_suppkey")
    rows = t.lineitem.select(
        k.alias("model"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), (F.col("l_quantity") > 6).alias("passed"), ((F.col("l_linenumber") < 7) | (k % 4 > 0)).alias("schema_valid"),
        ((F.col("l_discount") >= 0.1) & (k % 3 == 0)).alias("critical_error"), ((F.col("l_tax") == 0.08) & (F.col("l_quantity") > 2) & (k % 2 == 0)).alias("safety_critical"),
    )
    return exams.accepted(rows).select("model", "score", "out_of", "schema_valid", "safety_passed", F.size("critical_errors").cast("long").alias("critical"), "accepted")


@query("q10_pages", rf"""with b as (select source as doc, regexp_replace(case when doc_id % 499 = 3 then text || chr(57345) else text end, '{SPACE}', '', 'g') as x, doc_id % 4 as images, doc_id % 10 / 10.0 as coverage from documents),
m as (select *, length(x) as chars, list_filter(list_transform(string_split_regex(x, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda y: regexp_replace(y, '{SPACE}', '', 'g')), lambda y: y <> '') as l from b),
f as (select *, case when len(l) = 0 then 0 else round(len(list_filter(l, lambda y: length(y) <= 3)) / len(l), 4) end as short from m),
d as (select doc, count(*) as pages, sum(chars) as chars, avg(chars) as mean, count(*) filter (chars = 0) as zero, avg(case when chars >= 80 then 1.0 else 0 end) as texted, avg(case when images > 0 then 1.0 else 0 end) as imaged, avg(case when coverage >= 0.65 then 1.0 else 0 end) as full_page,
count(*) filter (contains(x, chr(57345))) as private, coalesce(avg(short) filter (chars > 0), 0) as fragments from f group by 1),
k as (select *, case when texted <= 0.2 and full_page >= 0.5 then 'image_pdf' when imaged >= 0.3 and texted >= 0.3 then 'mixed_pdf' when full_page >= 0.3 then 'mixed_pdf' else 'text_pdf' end as kind from d)
select doc, pages, cast(chars as bigint) as chars, zero as zero_text_pages, private as private_use_pages, kind, kind = 'mixed_pdf' or private > 0 or (fragments >= 0.25 and mean >= 80) as formula_risk from k""")
def q10_pages(t):
    k = F.col("doc_id")
    text = F.when(k % 499 == 3, F.concat("text", F.lit("\ue001"))).otherwise(F.col("text"))
    pages = t.documents.select(F.col("source").alias("doc"), k.alias("page"), text.alias("text"), (k % 4).alias("images"), (k % 10 / 10.0).alias("coverage"))
    return exams.pdf_kind(exams.page_metrics(pages)).select("doc", "pages", "chars", "zero_text_pages", "private_use_pages", "kind", "formula_risk")


@query("d19_seats", "select o_orderkey, c_custkey, cast(c_custkey as varchar) as seat_no from orders join customer on c_custkey = o_custkey where o_orderkey % 7 > 0 and o_orderkey % 11 > 0")
def d19_seats(t):
    k = F.col("o_orderkey")
    roster = t.customer.select(F.lit("c").alias("class_id"), F.concat(F.lit("00"), F.col("c_custkey").cast("string")).alias("seat_no"), "c_custkey")
    scores = t.orders.select(F.lit("c").alias("class_id"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("seat_no"), F.when(k % 11 > 0, "o_orderpriority").alias("name"), F.when(k % 7 > 0, F.col("o_totalprice").cast("string")).otherwise("缺考").alias("total"), "o_orderkey")
    return exams.seated(roster, scores, "name", "total").select("o_orderkey", "c_custkey", "seat_no")


PARTS = "(select cast(p_partkey as varchar) as kp, p_size / 50.0 as mastery, (p_partkey % 7 - 3) / 10.0 as gap, p_retailprice as weight, case when p_size < 20 then 'weak' when p_size < 40 then 'basic' else 'strong' end as level from part)"


@query("e07_plan", f"""with w as (select *, row_number() over (order by mastery, gap, weight desc, kp) as n from {PARTS} where level = 'weak'), b as (select * from {PARTS} where level = 'basic' order by mastery, gap, weight desc, kp limit 5)
select 'urgent' as part, n as place, kp from w where n <= 5
union all select * from (select 'consolidate', row_number() over (order by g, mastery, gap, weight desc, kp) as n, kp from (select 0 as g, mastery, gap, weight, kp from b union all select 1, mastery, gap, weight, kp from w where n between 6 and 10)) where n <= 5
union all select * from (select 'strong', row_number() over (order by mastery desc, weight desc, kp) as n, kp from {PARTS} where level = 'strong') where n <= 5""")
def e07_plan(t):
    size = F.col("p_size")
    points = t.part.select(F.col("p_partkey").cast("string").alias("kp"), (size / 50.0).alias("mastery"), ((F.col("p_partkey") % 7 - 3) / 10.0).alias("gap"), F.col("p_retailprice").alias("weight"), F.when(size < 20, "weak").when(size < 40, "basic").otherwise("strong").alias("level"))
    return exams.study_plan(points)


IDS = "(select distinct try_cast(x as bigint) as n from (select unnest(regexp_extract_all(text || ' ID' || cast(doc_id - doc_id % 7 as varchar), '[A-Z]+(\\d+)', 1)) as x from documents) where try_cast(x as bigint) is not null)"


@query("f15_texts", f"select case when b + 1 = n - 1 then cast(b + 1 as varchar) else cast(b + 1 as varchar) || '~' || cast(n - 1 as varchar) end as gap from (select n, lag(n) over (order by n) as b from {IDS}) where n - b > 1")
def f15_texts(t):
    rows = t.documents.select(F.concat("text", F.lit(" ID"), (F.col("doc_id") - F.col("doc_id") % 7).cast("string")).alias("text"))
    return exams.gap_names(audit.gaps(exams.id_numbers(rows, "text"), "number"))


@query("j05_campaigns", """select o_custkey as campaign, string_agg(o_orderstatus || '=' || cast(n as varchar), ',' order by o_orderstatus) as counts, bool_and(o_orderstatus <> 'P') as complete from (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) group by 1""")
def j05_campaigns(t):
    found = exams.campaign_status(t.orders.select(F.col("o_custkey").alias("campaign"), F.col("o_orderstatus").alias("status")), ["F", "O"])
    return found.select("campaign", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"), "complete")


@query("f10_both_sides", "select c_custkey as k, 'left_only' as side from customer where c_custkey % 3 > 0 and c_custkey not in (select o_custkey from orders where o_orderkey % 5 = 0) union all select distinct o_custkey, 'right_only' from orders where o_orderkey % 5 = 0 and o_custkey % 3 = 0")
def f10_both_sides(t):
    """Customers and orders with some keys taken out on either side."""
    return wiki.two_way(t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k")), t.orders.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("f09_groups", "select id, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda x: not list_contains(l, x))), ',') as missing from (select event_id // 6 as id, list(distinct event_type) as l from events group by 1) where missing <> ''")
def f09_groups(t):
    """Six events in a row as a group."""
    rows = audit.incomplete(t.events.withColumn("id", F.floor(F.col("event_id") / 6)), "id", "event_type", ["click", "purchase", "signup", "view"])
    return rows.select("id", F.array_join("missing", ",").alias("missing"))


@query("d12_unknown", "select event_id, user_id from events where user_id not in (select c_custkey from customer where c_custkey % 4 > 0)")
def d12_unknown(t):
    """Events against customers with every fourth taken out."""
    return ingest.missing_parents(t.events.select("event_id", "user_id"), t.customer.where("c_custkey % 4 > 0").select("c_custkey"), "user_id", "c_custkey")


@query("h02_texts", "select doc_id, len(l) as n, sha256(array_to_string(l, '|')) as sha from (select doc_id, list_transform(list_filter(string_split_regex(text, '[,，;；、]'), lambda x: trim(x) <> ''), lambda x: regexp_replace(trim(x), '^`+|`+$', '', 'g')) as l from documents)")
def h02_texts(t):
    found = routing.terms(F.col("text"))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n"), F.sha2(F.array_join(found, "|"), 256).alias("sha"))


@query("i12_texts", """select doc_id, sha256(case doc_id % 3 when 0 then rtrim(text, ' ') || chr(10) || chr(10) || '<!-- m:begin -->' || chr(10) || '- ' || source || chr(10) || '<!-- m:end -->' || chr(10)
when 1 then '<!-- m:begin -->' || chr(10) || 'K' || chr(10) || '- ' || source || chr(10) || '<!-- m:end -->' || chr(10) || text else text || chr(10) || '- ' || source end) as sha from documents""")
def i12_texts(t):
    """A line put into whole texts: without a block, with one, and with the line there already."""
    k, line = F.col("doc_id") % 3, F.concat(F.lit("- "), "source")
    page = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("<!-- m:begin -->\nK\n<!-- m:end -->\n"), "text")).otherwise(F.concat("text", F.lit("\n"), line))
    once = hierarchy.with_managed_line(page, "m", line)
    return t.documents.select("doc_id", F.sha2(hierarchy.with_managed_line(once, "m", line), 256).alias("sha"))


@query("g29_texts", r"""select doc_id, sha256(text || case doc_id % 3 when 0 then ' F_{\text{net}}=ma' when 1 then ' v_{0}=at' else ' x_{\perp}' end) as sha, case doc_id % 3 when 1 then '' else 'perp' end as found from documents""")
def g29_texts(t):
    """Formulas behind whole texts, of which one has a subscript that a rule knows."""
    k = F.col("doc_id") % 3
    told = F.concat("text", F.when(k == 0, r" F_{\!\perp\!}=ma").when(k == 1, " v_{0}=at").otherwise(r" x_{\perp}"))
    marks = [r"\perp"]
    found = F.array_join(F.transform(scans.garbled(told, marks), lambda x: F.replace(x, F.lit("\\"), F.lit(""))), ",")
    return t.documents.select("doc_id", F.sha2(scans.repaired(told, marks, [(r"=\s*m\s*a\b", r"\text{net}")]), 256).alias("sha"), found.alias("found"))

"""Import path, page audits, scans, taxonomy and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic
from ..functions import text as tx
from ..operators import analytics, hierarchy, imports, ingest, reports, routing, scans, wiki
from ..plans.registry import query

text = lambda c: F.col(c).cast("string")

NAMES = " ".join(imports.COMPOUND_SURNAMES)
SQL_NAMES = ", ".join(f"'{x}'" for x in imports.COMPOUND_SURNAMES)


@query("c06_denylist", "select n_nationkey, n_name as name from nation where n_regionkey = 1 order by n_nationkey limit 500")
def c06(t):
    frame = t.nation.select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"), *(F.lit("x").alias(c) for c in analytics.FORBIDDEN))
    return analytics.safe_query({"v": frame}, "v", ["n_nationkey"], 900, n_regionkey=1).drop("n_regionkey")


@query("c10_pick", """select o_orderkey as student_id, o_custkey as class_id, o_orderstatus as term_id, c_mktsegment as seat_no from (select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders) o
left join (select c_custkey, c_mktsegment, case when c_custkey % 2 = 0 then 'O' end as term from customer) c on c.c_custkey = o.o_custkey and (c.term = o.o_orderstatus or o.o_orderstatus is null or c.term is null) order by 1, 4 limit 1""")
def c10(t):
    results = t.orders.select(F.col("o_orderkey").alias("student_id"), F.col("o_custkey").alias("class_id"), F.nullif("o_orderstatus", F.lit("P")).alias("term_id"))
    seats = t.orders.select(F.col("o_orderkey").alias("student_id"), F.col("o_custkey").alias("class_id")).join(t.customer, F.col("class_id") == F.col("c_custkey"))
    return imports.pick(results, seats.select("student_id", "class_id", F.when(F.col("c_custkey") % 2 == 0, "O").alias("term_id"), F.col("c_mktsegment").alias("seat_no")))


@query("d07_json", "select event_id from events where json_valid(case when event_id % 5 = 0 then substr(props, 2) when event_id % 7 = 0 then ' ' else props end) = false and trim(case when event_id % 7 = 0 and event_id % 5 > 0 then ' ' else props end) <> ''")
def d07(t):
    s = F.when(F.col("event_id") % 5 == 0, F.expr("substr(props, 2)")).when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("props"))
    return t.events.where(imports.json_issue(s)).select("event_id")


@query("d16_ids", """select c_custkey, 't1_' || c_nationkey || '_' || case when c_custkey % 3 = 0 then 'M' when c_custkey % 3 = 1 then 'F' else 'U' end || '_seat' || c_custkey as person_id, c_mktsegment || '-' || substr(c_name, 1, 1) || '-' || c_custkey || '号' as pseudonym from customer""")
def d16(t):
    c = t.customer.select("c_custkey", F.lit("t1").alias("term_id"), text("c_nationkey").alias("class_id"), F.col("c_mktsegment").alias("class_name"), F.substring("c_name", 1, 1).alias("family_name"), F.when(F.col("c_custkey") % 3 == 0, "男").when(F.col("c_custkey") % 3 == 1, "female").otherwise("?").alias("gender"), F.concat(F.lit("00"), text("c_custkey")).alias("seat_no"))
    return imports.identified(c)[0].select("c_custkey", "person_id", "pseudonym")


@query("d17_gate", "select n_name as name, false as forbidden from nation union all select unnest(['real_name', 'name', '姓名', 'school_number', 'school_no', '学号', 'exam_number', 'exam_no', '考号', 'student_status_number', 'student_registry_number', '学籍号', 'guardian_contact', 'student_code']), true")
def d17(t):
    every = t.nation.select(F.col("n_name").alias("name")).union(t._spark.createDataFrame([(x,) for x in sorted(ingest.FORBIDDEN_IDENTITY)], "name string"))
    return every.select("name", F.lower("name").isin(*ingest.FORBIDDEN_IDENTITY).alias("forbidden"))


@query("d18_family", f"select p_partkey, case when p_partkey % 4 = 0 then '未知' when p_partkey % 4 = 1 then [{SQL_NAMES}][p_partkey % 31 + 1] else substr(p_name, 1, 1) end as family from part")
def d18(t):
    names = F.split(F.lit(NAMES), " ")
    name = F.when(F.col("p_partkey") % 4 == 0, " ").when(F.col("p_partkey") % 4 == 1, F.concat(F.element_at(names, (F.col("p_partkey") % 31 + 1).cast("int")), F.lit(" 明"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", imports.family_name(name).alias("family"))


@query("d20_by_name", "select s_suppkey, n_nationkey as student_id, s_acctbal from supplier join nation on s_nationkey = n_nationkey where n_regionkey > 0")
def d20(t):
    scores = t.supplier.select("s_suppkey", "s_acctbal", text("s_nationkey").alias("name"))
    people = t.nation.where("n_regionkey > 0").select(text("n_nationkey").alias("name"), F.col("n_nationkey").alias("student_id"))
    return imports.scores_of_people(scores, people)


@query("d24_cards", """select c_mktsegment || '_e1' as assessment_id, c_custkey as student_id, case when c_custkey % 3 > 0 then 'present' else 'missing_artifact' end as artifact_status,
case when c_custkey % 3 > 0 then 'answer_card:' || c_mktsegment || '_e1:' || c_custkey else 'missing_artifact' end as evidence_ref from customer""")
def d24(t):
    people = t.customer.select(F.col("c_mktsegment").alias("class_id"), text("c_custkey").alias("student_id"), F.col("c_name").alias("name"), text("c_custkey").alias("seat_no"))
    cards = t.customer.where("c_custkey % 3 > 0").select(F.col("c_mktsegment").alias("class_id"), F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("sha256"))
    return imports.answer_cards(people, cards, "e1")[0].select("assessment_id", F.col("student_id").cast("long").alias("student_id"), "artifact_status", "evidence_ref")


FILES = "['a.JSON', 'b.png', 'x_roster.csv', 'answer_card_manifest_1.csv', 'scores_ready.csv', 'k_scores.csv', 'item_map_review.csv', 'other.csv']"
KINDS = "['preprocess_summary_json', 'answer_card_png', 'roster_csv', 'answer_card_manifest_csv', 'score_ready_csv', 'score_csv', 'item_map_review_csv', 'import_csv']"


@query("d28_kinds", f"select p_partkey, {KINDS}[p_partkey % 8 + 1] as kind from part")
def d28(t):
    names = F.array(*(F.lit(x.strip(" '")) for x in FILES.strip("[]").split(",")))
    return t.part.select("p_partkey", imports.file_kind(F.concat(F.lit("in/"), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")))).alias("kind"))


@query("d29_homework", """select o_orderkey || '_' || o_custkey || '_' || i as result_id, case when i = 'Q1' then cast(o_orderstatus = 'F' as integer) else cast(o_orderkey % 2 as integer) end as is_correct,
cast(case when i = 'Q1' and o_orderkey % 3 > 0 then o_orderkey % 3 else 1 end as bigint) as attempts from orders, (values ('Q1'), ('Q2b')) v(i)""")
def d29(t):
    wide = t.orders.select(text("o_orderkey").alias("assignment_id"), text("o_custkey").alias("student_id"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("true").alias("Q1_correct"), F.when(F.col("o_orderkey") % 3 > 0, text("o_orderkey") % 3).cast("string").alias("Q1_attempt_count"), (F.col("o_orderkey") % 2).cast("string").alias("Q2b_correct"))
    return imports.homework_items(wide).select("result_id", "is_correct", F.col("attempts").cast("long").alias("attempts"))


@query("d31_tokens", "select p_partkey, case when contains(p_name, 'a') then 'first' when contains(p_name, 'b') or contains(p_name, 'c') then 'second' end as class from part")
def d31(t):
    return t.part.select("p_partkey", imports.first_token(F.col("p_name"), {"first": ["a"], "second": ["b", "c"]}).alias("class"))


TASKS = "['图像识别与物理量关系判断', '变压器与远距离输电的链式计算', '带电粒子轨迹几何与分段运动', '磁场方向、轨迹与基本模型判断', '同知识点基础题到中档题']"


@query("e12_tasks", f"select p_partkey, {TASKS}[p_partkey % 5 + 1] as kind from part")
def e12(t):
    points = F.element_at(F.array(*map(F.lit, ("看图像", "线损计算", "求轨迹", "方向", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    kp = F.element_at(F.array(*map(F.lit, ("磁场", "气体", "磁场", "磁场", "运动"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", reports.task_kind(F.array(points), kp).alias("kind"))


FACTS = "(select o_orderpriority as class_id, o_custkey as student_id, l_suppkey % 10 as kp, case when l_linenumber % 7 = 0 then null else l_quantity end as score, case when l_linenumber % 5 = 0 then 0 else 50 end as max_score from lineitem join orders on o_orderkey = l_orderkey)"
MASTERY = f"(select class_id, student_id, kp, sum(case when score is not null and max_score > 0 then max_score end) as w, sum(case when score is not null and max_score > 0 then score end) as s from {FACTS} group by 1, 2, 3)"


def mastery(t):
    facts = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return reports.mastery(facts.select(F.col("o_orderpriority").alias("class_id"), F.col("o_custkey").alias("student_id"), (F.col("l_suppkey") % 10).alias("kp"), F.when(F.col("l_linenumber") % 7 > 0, F.col("l_quantity")).alias("score"), F.when(F.col("l_linenumber") % 5 == 0, 0.0).otherwise(50.0).alias("max_score")))


@query("e15_mastery", f"select class_id, student_id, kp, cast(coalesce(w, 0) as double) as weight, round(s / w, 6) as mastery, case when s / w is null then 'insufficient' when s / w >= 0.85 then 'solid' when s / w >= 0.60 then 'basic' else 'weak' end as level from {MASTERY}")
def e15(t):
    return mastery(t).withColumn("mastery", F.round("mastery", 6))


@query("e15_class_summary", f"select class_id, kp, count(s / w) as n_students, round(avg(s / w), 6) as avg_mastery, count(*) filter (s / w < 0.6) as weak_students from {MASTERY} group by 1, 2")
def e15_class(t):
    return reports.class_summary(mastery(t)).withColumn("avg_mastery", F.round("avg_mastery", 6))


@query("e13_order", f"select class_id, student_id, kp, cast(row_number() over (partition by class_id, student_id order by (s / w) asc nulls last, kp) as integer) as place from {MASTERY}")
def e13(t):
    from pyspark.sql import Window

    return mastery(t).select("class_id", "student_id", "kp", F.row_number().over(Window.partitionBy("class_id", "student_id").orderBy(*reports.by_mastery())).alias("place"))


@query("e14_demo", "select l_orderkey, l_linenumber, cast(l_quantity / 50 >= 0.8 as integer) as is_correct, case when l_quantity / 50 < 0.6 then 'concept' end as error_type from lineitem")
def e14(t):
    right, error = reports.demo_flags(F.col("l_quantity") / 50)
    return t.lineitem.select("l_orderkey", "l_linenumber", right.alias("is_correct"), error.alias("error_type"))


@query("s17_weekly", f"""select class_id, '# Weekly report: ' || class_id || chr(10) || chr(10) || '| kp | average | weak_students |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || kp || ' | ' || case when m is null then '-' else printf('%.0f%%', round(m * 100)) end || ' | ' || weak || ' |', chr(10) order by m, kp) || chr(10) as report
from (select class_id, kp, floor(avg(s / w) * 100) / 100 as m, count(*) filter (s / w < 0.6) as weak from {MASTERY} group by 1, 2) group by 1""")
def s17(t):
    """With averages cut to whole percents, as the last digit of a mean depends on the order of its sum."""
    whole = reports.class_summary(mastery(t)).withColumn("avg_mastery", F.floor(F.col("avg_mastery") * 100) / 100)
    return reports.weekly(whole).withColumn("report", F.regexp_replace("report", r"\.0%", "%"))


@query("f07_frontmatter", "select doc_id from documents where doc_id % 3 = 0 or not starts_with(ltrim(text), '---') and doc_id % 3 > 1")
def f07(t):
    page = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  ---\nid: x\n---\n"), "text")).otherwise(F.col("text"))
    return t.documents.where(wiki.missing_frontmatter(page)).select("doc_id")


@query("f07_raw_pointer", "select doc_id from documents where doc_id % 4 = 1")
def f07_raw(t):
    page = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" see ../raw/a/b.md"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("---\nsource: ../raw/x.md\n---\n"), "text")).otherwise(F.col("text"))
    return t.documents.where(wiki.raw_pointer(page)).select("doc_id")


@query("f08_images", "select doc_id, 'img/' || (doc_id % 10) || '.png' as target from documents where doc_id % 10 > 6")
def f08(t):
    page = F.concat(F.replace("text", F.lit("]("), F.lit("] (")), F.lit("![a](img/"), (F.col("doc_id") % 10).cast("string"), F.lit(".png) ![b](https://x/y.png) ![c](#part)"))
    files = t._spark.createDataFrame([(f"img/{k}.png",) for k in range(7)], "path string")
    return wiki.missing_images(wiki.references(t.documents.select("doc_id", page.alias("text")), "doc_id", "text"), files)


@query("f10_two_way", "select c_custkey as k, 'left_only' as side from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'right_only' from orders where o_custkey not in (select c_custkey from customer)")
def f10(t):
    return wiki.two_way(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("f11_unindexed", "select p_partkey as id from part where p_partkey % 3 > 0 or p_partkey % 7 = 0")
def f11(t):
    index = t.part.where("p_partkey % 3 = 0 and p_partkey % 7 > 0").select(F.concat(F.lit("- [["), text("p_partkey"), F.lit(".md#top|a part]] and [[open")).alias("line"))
    return wiki.unindexed(t.part.select(text("p_partkey").alias("id")), F.col("line"), index).select(F.col("id").cast("long").alias("id"))


@query("f12_health", "select (select count(*) from pages) as pages, (select count(*) from documents where length(text) > 8000) as big, 0::bigint as dead, (select count(*) from documents where length(text) > 8000) > 0 as failed")
def f12(t):
    return wiki.health(t.pages, {"big": t.documents.where(F.length("text") > 8000), "dead": t.documents.where("false")}, ["big", "dead"])


@query("f19_fixes", r"select doc_id, sha256('### A' || chr(10) || chr(10) || trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) || ' z' || chr(10) || '#### deep b' || chr(10) || '**图 3 c**' || chr(10)) as sha from documents")
def f19(t):
    flat = F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    page = F.concat(F.lit("###   **A**  \r\n\n\n\n"), flat, F.lit(" z \t\n##\n###### deep **b**\n## 图 3 c\n\n"))
    return t.documents.select("doc_id", F.sha2(wiki.safe_fixes(page), 256).alias("sha"))


@query("f19_replacements", "select doc_id, cast(length(text) - length(replace(text, 'e', '')) + (length(replace(text, 'e', 'E')) - length(replace(replace(text, 'e', 'E'), 'E ', ''))) / 2 as integer) as n, sha256(replace(replace(text, 'e', 'E'), 'E ', '- ')) as sha from documents")
def f19_replacements(t):
    new, n = wiki.replaced(F.col("text"), {"e": "E", "E ": "- "})
    return t.documents.select("doc_id", n.alias("n"), F.sha2(new, 256).alias("sha"))


ISSUES = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)"


@query("f20_tasks", f"select doc_id as path, 'placeholder' as issue, 'recover the missing content' as action, count(*) as n from {ISSUES} where regexp_matches(line, '(?i)todo') group by 1 union all select doc_id, 'embedded_data_uri', 'review against the source', count(*) from {ISSUES} where contains(line, 'e') group by 1")
def f20(t):
    lines = t.documents.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = lines.withColumn("line", F.concat(F.regexp_replace("line", r"[#!|$\[\]<]|data:image/|(.{5,20})\1{3,}", " "), F.when(F.contains("line", F.lit("e")), " $ data:image/png").otherwise(" $")))
    found = wiki.repair_tasks(wiki.line_issues(marked)).where(F.col("issue").isin("placeholder", "embedded_data_uri"))
    return found.groupBy("path", "issue", "action").agg(F.count("*").alias("n"))


@query("f21_compatibility", """select p_partkey as path, unnest(case p_partkey % 4 when 0 then ['rag_chunk_missing'] when 1 then ['missing_id', 'rag_heading_spacing_answer', 'empty_rag_answer_text', 'rag_chunk_missing', 'rag_heading_spacing_question', 'empty_rag_question_text'] when 2 then ['rag_chunk_text_empty', 'rag_chunk_knowledge_points_empty'] else [] end) as issue from part""")
def f21(t):
    head = F.concat(F.lit("---\n"), F.when(F.col("p_partkey") % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("id: q"), text("p_partkey"), F.lit("\n"))), F.lit("question_type: x\nknowledge_points:\n  - one\n---\n"))
    body = F.when(F.col("p_partkey") % 4 == 1, F.lit("## 题目\n\nabc\n\n## 详解\n\nghi\n")).otherwise(F.lit("## 题目\n\nabc\n\n## 答案\n\ndef\n\n## 详解\n\nghi\n"))
    files = t.part.select(F.col("p_partkey").alias("path"), F.concat(F.lit("n"), text("p_partkey"), F.lit(".md")).alias("name"), F.concat(head, body).alias("text"))
    chunks = t.part.where("p_partkey % 4 > 0").select(F.concat(F.lit("exercise-q"), text("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 4 == 2, "题目：").otherwise("题目：abc 答案：def 详解：ghi").alias("text"), F.when(F.col("p_partkey") % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("one"))).alias("knowledge_points"))
    return wiki.compatibility(files, chunks)


@query("f22_images", """select p_partkey as key, array_to_string(list_filter([case when p_partkey % 3 = 0 and p_size < 40 then 'alpha_black' end, case when p_partkey % 3 > 0 and p_size * 10 * (p_partkey % 200) >= 20000 and p_size < 45 then 'dark' end,
case when p_partkey <= 2500 and ((p_size * 10 <= 180 and p_partkey % 200 <= 270) or (p_partkey % 200 <= 60 and p_size * 10 <= 250)) then 'small_file_image' end, case when p_partkey % 200 <= 45 and p_size * 10 >= 180 then 'wide_short_text_line' end,
case when p_partkey % 200 = 0 or p_size * 10.0 / nullif(p_partkey % 200, 0) >= 8 or p_size * 10.0 / nullif(p_partkey % 200, 0) <= 0.14 then 'extreme_aspect_ratio' end], lambda x: x is not null), ',') as codes from part""")
def f22(t):
    alpha = F.col("p_partkey") % 3 == 0
    m = t.part.select(F.col("p_partkey").alias("key"), (F.col("p_size") * 10).alias("width"), (F.col("p_partkey") % 200).cast("int").alias("height"), F.col("p_partkey").cast("int").alias("bytes"), alpha.alias("has_alpha"), F.when(alpha, F.col("p_size") + 5).otherwise(F.col("p_size")).alias("direct_mean"), F.lit(200).alias("white_mean"), F.lit(0.2).alias("transparent"), F.lit("plain").alias("context"))
    return wiki.image_risks(m).select("key", F.array_join("codes", ",").alias("codes"))


@query("f23_assets", "select p_partkey as path, case when p_partkey % 3 = 1 then 'b' else '' end as undeclared, case when p_partkey % 3 = 2 then 'c' else '' end as unused from part where p_partkey % 3 > 0")
def f23(t):
    some = lambda k, c: F.when(F.col("p_partkey") % 3 == k, F.array(F.lit("a"), F.lit(c))).otherwise(F.array(F.lit("a")))
    out = wiki.asset_difference(t.part.select(F.col("p_partkey").alias("path"), some(2, "c").alias("assets"), some(1, "b").alias("references")))
    return out.select("path", F.array_join("undeclared", ",").alias("undeclared"), F.array_join("unused", ",").alias("unused"))


@query("f24_figures", "select doc_id as path, '如图所示' as signal from documents where doc_id % 4 = 1")
def f24(t):
    question = F.concat(F.regexp_replace("text", "图", "_"), F.when(F.col("doc_id") % 4 < 2, F.when(F.col("doc_id") % 4 == 1, "如图所示，求").otherwise("图像法")).otherwise("如图所示，求"))
    rows = t.documents.select(F.col("doc_id").alias("path"), question.alias("question"), F.when(F.col("doc_id") % 4 == 2, F.array(F.lit("x.png"))).alias("assets"), F.when(F.col("doc_id") % 4 == 3, F.array(F.lit("y.png"))).alias("references"))
    return wiki.figures_without_assets(rows).select("path", "signal")


@query("f29_video", "select event_id as id, unnest(list_filter([case when event_id % 5 = 0 then 'missing_file' end, case when event_id % 5 = 1 then 'empty_file' end, case when abs(value - 50) > 5 then 'duration_mismatch' end, case when event_id % 7 < 3 then 'too_few_frames' end], lambda x: x is not null)) as issue from events")
def f29(t):
    v = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_id") % 5 - 1).alias("bytes"), F.col("value").alias("duration"), F.lit(50.0).alias("expected_duration"), (F.col("event_id") % 7).alias("n_frames"), F.lit("words").alias("text"))
    return wiki.video_issues(v)


@query("f32_counts", "select o_orderstatus as kind, o_orderpriority as status, count(*) as n from orders group by cube (1, 2)")
def f32(t):
    return scans.formula_counts(t.orders.select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("status")))


@query("f33_shared", "select distinct sha256(text) as sha from documents where doc_id % 2 = 0 and text in (select text from documents where doc_id % 2 = 1)")
def f33(t):
    side = lambda k: t.documents.where(F.col("doc_id") % 2 == k).select(F.sha2("text", 256).alias("sha"))
    return wiki.shared_hashes(side(0), side(1), "sha")


@query("f34_parity", "select n_name as name, 'missing_path' as issue from nation where n_nationkey % 5 = 0 union all select n_name, 'without_card' from nation where n_regionkey = 1 union all select r_name, 'not_registered' from region where r_name not in (select n_name from nation)")
def f34(t):
    registry = t.nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 > 0, "p").alias("path"))
    cards = t.nation.where("n_regionkey <> 1").select(F.col("n_name").alias("name")).union(t.region.select("r_name"))
    return wiki.registry_parity(registry, cards, ["path"])


@query("f35_migrated", "select doc_id as path, cast(length(text) - length(replace(text, 'a', '')) as integer) as changes, sha256(replace(text, 'a', 'A')) as sha from documents where contains(text, 'a')")
def f35(t):
    return wiki.migrated(t.documents.select(F.col("doc_id").alias("path"), "text"), {"a": "A"}).select("path", "changes", F.sha2("text", 256).alias("sha"))


@query("f36_unregistered", "select distinct o_custkey as owner, o_orderpriority as id from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def f36(t):
    declared = t.orders.groupBy(F.col("o_custkey").alias("owner")).agg(F.collect_set("o_orderpriority").alias("ids"))
    return wiki.unregistered(declared, t._spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "id string"))


SCORE = r"""cast(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) * 2 + least(length(text) // 20, 200) + case doc_id % 3 when 0 then 90 when 1 then -45 else 0 end + case doc_id % 2 when 0 then 80 else 0 end + cast(trunc((doc_id % 10) / 10.0 * 30) as bigint)
- case when doc_id % 4 = 0 then 15 else 0 end - case when doc_id % 5 = 0 then 10 else 0 end + len(regexp_extract_all(text, '[ABCD][\.．、]')) * 4 as bigint)"""


@query("g08_score", f"select doc_id, {SCORE} as score from (select doc_id, regexp_replace(text, '[0-9]|�', '', 'g') as text from documents)")
def g08(t):
    d = t.documents.select("doc_id", F.regexp_replace("text", "[0-9]|�", "").alias("text"))
    k = F.col("doc_id")
    score = scans.candidate_score(F.col("text"), F.when(k % 3 == 0, "paddleocr_vl").when(k % 3 == 1, "pp_ocr").otherwise("other"), F.when(k % 2 == 0, "machine_final").otherwise("none"), (k % 10) / 10.0, F.lit(None).cast("double"), F.when(k % 4 == 0, "r1"), F.when(k % 5 == 0, F.array(F.lit("formula_candidate"))))
    return d.select("doc_id", score.alias("score"))


@query("g07_merge", "select l_orderkey as key, string_agg(e || ':' || x, ',' order by e, x) as candidates from (select l_orderkey, 'a' as e, l_returnflag || l_linenumber as x from lineitem union all select l_orderkey, 'b', l_linestatus || l_linenumber from lineitem) group by 1")
def g07(t):
    part = lambda e, c: t.lineitem.select(F.col("l_orderkey").alias("key"), F.lit(e).alias("engine"), F.concat(c, text("l_linenumber")).alias("text"))
    m = scans.merged_reports(part("a", "l_returnflag"), part("b", "l_linestatus"))
    return m.select("key", F.array_join(F.transform("candidates", lambda x: F.concat(x["engine"], F.lit(":"), x["text"])), ",").alias("candidates"))


@query("g12_gate", """select doc_id as draft, array_to_string(list_filter([case when doc_id % 3 = 0 then 'unresolved_conflicts' end, case when contains(text, '�') then 'replacement_characters' end, case when len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) < greatest(10, doc_id % 4 * 5) then 'too_few_nonblank_lines' end,
case when (length(text) - length(replace(text, '$', ''))) % 2 = 1 then 'unbalanced_inline_latex_dollars' end, case when doc_id % 5 = 0 then 'model_candidate_matrix_missing' end], lambda x: x is not null), ',') as issues from documents""")
def g12(t):
    k = F.col("doc_id")
    d = t.documents.select(k.alias("draft"), "text", (k % 4).alias("pages"), F.when(k % 3 == 0, 1).otherwise(0).alias("unresolved"), F.lit(0).alias("broken_images"), F.lit(None).cast("int").alias("omitted"), (k % 5).alias("n_candidates"))
    return scans.quality_gate(d).select("draft", F.array_join("issues", ",").alias("issues"))


@query("g13_waves", "select count(*) as waves, count(*) filter (not (n_regionkey > 0) or n_nationkey % 3 > 0) as bad, cast(sum(n_nationkey % 3) as bigint) as issues, 0::bigint as unresolved, count(*) filter (not (n_regionkey > 0) or n_nationkey % 3 > 0) = 0 as ok from nation")
def g13(t):
    return scans.wave_rollup(t.nation.select((F.col("n_regionkey") > 0).alias("ok"), (F.col("n_nationkey") % 3).alias("issues"), F.lit(0).alias("unresolved")))


@query("g19_counts", "select (select count(*) from orders) as objects, count(distinct o_orderkey) as with_result, count(*) as results, count(*) filter (l_returnflag not in ('A', 'N')) as open from orders join lineitem on l_orderkey = o_orderkey")
def g19(t):
    return scans.reporting_counts(t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.select(F.col("l_orderkey").alias("k"), "l_returnflag"), "k", "l_returnflag", ["A", "N"])


@query("g20_queue", "select o_orderkey as key, 'object' as kind, (select string_agg(distinct l_returnflag, ',' order by l_returnflag) from lineitem where l_orderkey = o_orderkey) as previews from orders where o_orderstatus <> 'F' union all select c_custkey, 'extra', null from customer")
def g20(t):
    q = scans.review_queue(t.orders.select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("resolved")), t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("sha256")), t.customer.select(F.col("c_custkey").alias("key")))
    return q.select("key", "kind", F.array_join("previews", ",").alias("previews"))


@query("g21_reconciled", "select l_orderkey as key, case when bool_and(l_linestatus = 'F') and count(distinct l_returnflag) = 1 then min(l_returnflag) end as value, bool_and(l_linestatus = 'F') and count(distinct l_returnflag) = 1 as resolved from lineitem group by 1")
def g21(t):
    return scans.reconciled(t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("value"), (F.col("l_linestatus") == "F").alias("resolved")))


@query("g23_inherited", "select p_partkey as id, coalesce(review, first_value(review) over w) as review, case when review is null then first_value(case when review is not null then cast(p_partkey as varchar) end) over w end as donor from (select p_partkey, p_brand, case when p_partkey % 5 = 0 then 'r' || p_partkey end as review from part) window w as (partition by p_brand order by review is null, p_partkey rows between unbounded preceding and unbounded following)")
def g23(t):
    return scans.inherited(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("sha256"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("r"), text("p_partkey"))).alias("review"))).drop("sha256").withColumn("donor", text("donor"))


@query("g27_next", "select l_orderkey as batch_pos, l_linenumber as segment_pos from lineitem where l_returnflag = 'R' order by 1, 2 limit 1")
def g27(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("batch_pos"), F.col("l_linenumber").alias("segment_pos"), F.when(F.col("l_returnflag") == "R", "pending").otherwise("done").alias("status"))
    return scans.next_pending(rows).drop("status")


@query("g28_best", "select o_custkey as source, o_orderkey as path from (select *, row_number() over (partition by o_custkey order by o_orderstatus desc, o_orderpriority desc, o_orderdate desc, o_orderkey) as n from orders) where n = 1")
def g28(t):
    return scans.best_manifest(t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("mapped"), F.col("o_orderpriority").alias("n_questions"), F.col("o_orderdate").alias("mtime")))


@query("g29_repair", r"select p_partkey, case p_partkey % 3 when 0 then 'F_{\text{net}}=ma' when 1 then 'v_{0}=at' else 'x_{\perp}' end as formula, case p_partkey % 3 when 0 then 'perp' when 1 then '' else 'perp' end as found from part")
def g29(t):
    formula = F.when(F.col("p_partkey") % 3 == 0, r"F_{\!\perp\!}=ma").when(F.col("p_partkey") % 3 == 1, "v_{0}=at").otherwise(r"x_{\perp}")
    marks = [r"\perp"]
    found = F.array_join(F.transform(scans.garbled(formula, marks), lambda x: F.replace(x, F.lit("\\"), F.lit(""))), ",")
    return t.part.select("p_partkey", scans.repaired(formula, marks, [(r"=\s*m\s*a\b", r"\text{net}")]).alias("formula"), found.alias("found"))


@query("g35_lines", """select doc_id, case when doc_id % 9 = 0 then 'empty' when doc_id % 7 = 0 then 'text' when f + least(a, 8) * 0.35 + least(d, 8) * 0.18 >= 2.2 and c >= 2 then 'mixed' when f + least(a, 8) * 0.35 + least(d, 8) * 0.18 >= 1.5 then 'formula' else 'text' end as kind
from (select doc_id, len(regexp_extract_all(x, '[-=+*/^_()\\[\\]{}<>]')) as f, len(regexp_extract_all(x, '[A-Za-z]')) as a, len(regexp_extract_all(x, '[0-9]')) as d, case when doc_id % 2 = 0 then 2 else 0 end as c from (select doc_id, regexp_replace(substr(text, 1, doc_id % 6), '[^ -~]', '', 'g') as x from documents))""")
def g35(t):
    """Short lines: each text's first few characters, as the classes differ there."""
    s = F.concat(F.regexp_replace(F.expr("substr(text, 1, doc_id % 6)"), "[^ -~]", ""), F.when(F.col("doc_id") % 2 == 0, "中文").otherwise(""))
    return t.documents.select("doc_id", scans.line_kind(F.when(F.col("doc_id") % 7 == 0, "q09"), s, F.when(F.col("doc_id") % 9 == 0, 0.001).otherwise(0.5)).alias("kind"))


@query("g38_probes", "select s_suppkey as url, s_acctbal as speed, cast(row_number() over (order by s_acctbal desc, s_suppkey) as integer) as rank from supplier where s_acctbal > 0")
def g38(t):
    return scans.ranked_probes(t.supplier.select(F.col("s_suppkey").alias("url"), F.col("s_acctbal").alias("speed"), (F.col("s_acctbal") > 0).alias("ok"))).drop("ok")


@query("h02_terms", "select p_partkey, p_brand || '|' || p_type as terms from part")
def h02(t):
    return t.part.select("p_partkey", F.array_join(routing.terms(F.concat(F.lit("， `"), "p_brand", F.lit("`、; ,"), "p_type", F.lit(" ；"))), "|").alias("terms"))


@query("h11_self_test", "select n_nationkey as qid, case when n_nationkey % 3 = 0 then 'x' else '' end as missing from nation where n_nationkey % 3 = 0 or n_nationkey % 5 = 0")
def h11(t):
    k = F.col("n_nationkey")
    cases = t.nation.select(k.alias("qid"), F.lit("a").alias("primary"), F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"))).alias("queued"), F.lit(None).cast("double").alias("min_confidence"))
    routed = t.nation.select(k.alias("qid"), F.lit("a").alias("rec"), F.array(F.lit("y")).alias("queued"), F.when(k % 5 == 0, 0.5).otherwise(0.6).alias("confidence"))
    return routing.failures(cases, routed).select("qid", F.array_join("missing_queued", ",").alias("missing"))


@query("i01_outline", "select 'kp_' || printf('%06d', n) as id, case when up > 0 then 'kp_' || printf('%06d', up) end as parent, level, title, cast(row_number() over (partition by up order by n) as integer) as sort_order from (select *, case when level = 1 then 0 else max(case when level = 1 then n end) over (order by n) end as up from (select cast(row_number() over (order by r_regionkey, k) as integer) as n, level, title from (select r_regionkey, -1 as k, 1 as level, r_name as title from region union all select n_regionkey, n_nationkey, 2, n_name from nation)))")
def i01(t):
    rows = t.region.select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("k"), F.concat(F.lit("- "), "r_name").alias("line")).union(t.nation.select("n_regionkey", "n_nationkey", F.concat(F.lit("  - "), "n_name")))
    lines = rows.select(F.lit("d").alias("doc"), (F.col("r") * 1000 + F.col("k")).alias("pos"), "line")
    return hierarchy.parsed(lines)[0].drop("doc")


@query("i05_refresh", """select 'n' || n_nationkey as id, case when n_regionkey = 1 then 3 else 2 end as level, case when n_regionkey = 1 then 'World/New/' || n_name else 'old/' || n_name end as path, case when n_regionkey = 1 then 'old/' || n_name else '' end as aliases from nation
union all select 'r' || r_regionkey, case when r_regionkey = 1 then 2 else 1 end, case when r_regionkey = 1 then 'World/New' else 'old' end, case when r_regionkey = 1 then 'old' else '' end from region union all select 'w', 1, 'World', ''""")
def i05(t):
    empty = F.array().cast("array<string>")
    rows = t._spark.createDataFrame([("w", None, "World", 1, "World")], "id string, parent string, title string, level int, path string").withColumn("aliases", empty)
    rows = rows.union(t.region.select(F.concat(F.lit("r"), text("r_regionkey")), F.when(F.col("r_regionkey") == 1, "w"), F.lit("New"), F.lit(1), F.lit("old"), empty))
    rows = rows.union(t.nation.select(F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("r"), text("n_regionkey")), "n_name", F.lit(2), F.concat(F.lit("old/"), "n_name"), empty))
    return hierarchy.refreshed(rows, "r1").select("id", "level", "path", F.array_join("aliases", ",").alias("aliases"))


@query("i09_unresolved", "select distinct o_custkey as id from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 > 0)")
def i09(t):
    return hierarchy.unresolved_links(t.orders.select(F.col("o_custkey").alias("target")), t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id")))


@query("i10_inbound", "select distinct l_suppkey as src from lineitem where l_partkey = 7")
def i10(t):
    return hierarchy.inbound(t.lineitem.select(F.col("l_suppkey").alias("src"), text("l_partkey").alias("dst")), "7")


@query("i12_managed", "select doc_id, sha256(case doc_id % 3 when 0 then 'a' || chr(10) || chr(10) || '<!-- m:begin -->' || chr(10) || 'L' || chr(10) || '<!-- m:end -->' || chr(10) when 1 then '<!-- m:begin -->' || chr(10) || 'K' || chr(10) || 'L' || chr(10) || '<!-- m:end -->' else 'L' end) as sha from documents")
def i12(t):
    page = F.when(F.col("doc_id") % 3 == 0, "a  ").when(F.col("doc_id") % 3 == 1, "<!-- m:begin -->\nK\n<!-- m:end -->").otherwise("L")
    once = hierarchy.with_managed_line(page, "m", F.lit("L"))
    return t.documents.select("doc_id", F.sha2(hierarchy.with_managed_line(once, "m", F.lit("L")), 256).alias("sha"))


@query("i13_guarded", "select doc_id as path, case when doc_id % 4 = 0 then 'conflict' else 'accepted' end as verdict from documents")
def i13(t):
    changes = t.documents.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.sha2("text", 256)).alias("expected_sha256"))
    good, bad = hierarchy.guarded(t.documents.select(F.col("doc_id").alias("path"), "text"), changes)
    return good.select("path", F.lit("accepted").alias("verdict")).union(bad.select("path", F.lit("conflict")))


@query("j06_batches", "select o_orderkey as batch_id, case when n is null or done then 'completed' when o_orderstatus = 'P' then 'in_progress' when ready then 'ready' else 'pending' end as status from orders left join (select l_orderkey, count(*) as n, bool_and(l_linestatus = 'F') as done, bool_or(l_returnflag = 'R') as ready from lineitem where l_partkey % 5 > 0 group by 1) on l_orderkey = o_orderkey")
def j06(t):
    items = t.lineitem.where("l_partkey % 5 > 0").select(F.col("l_orderkey").alias("batch_id"), F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "R", "stale").otherwise("done")).when(F.col("l_returnflag") == "R", "stale").otherwise("open").alias("status"), "l_linestatus")
    ended = items.withColumn("status", F.when((F.col("l_linestatus") == "F") & (F.col("status") == "stale"), "dry_run_passed").otherwise(F.col("status")))
    return scans.batch_states(ended.drop("l_linestatus"), t.orders.select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderstatus") == "P").alias("claimed")), ["done", "dry_run_passed"])


@query("j15_arithmetic", "select p_partkey, case when p_partkey % 4 = 3 then null else round(case p_partkey % 4 when 0 then -(p_size + 2.5) * 3 when 1 then power(p_size, 2) / 4 - 1 else p_partkey / (1 + p_size) end, 6) end as value from part")
def j15(t):
    n, k = text("p_size"), F.col("p_partkey") % 4
    s = F.when(k == 0, F.concat(F.lit("-("), n, F.lit(" + 2.5)*3"))).when(k == 1, F.concat(n, F.lit("**2 / 4 - 1"))).when(k == 2, F.concat(text("p_partkey"), F.lit("/(1+"), n, F.lit(")"))).otherwise("__import__('os')")
    return t.part.select("p_partkey", F.round(arithmetic.evaluated(s), 6).alias("value"))


@query("s08_header", "select n_nationkey as sheet, cast(n_nationkey % 4 + 1 as integer) as row, cast(0 as integer) as seat_col, cast(2 as integer) as name_col from nation")
def s08(t):
    cells = []
    for at, names in ((0, ["title", "", ""]), (1, ["座号", "性别", "学生姓名"])):
        for col, name in enumerate(names):
            row = F.lit(0) if not at else (F.col("n_nationkey") % 4 + 1).cast("int")
            cells.append(t.nation.select(F.col("n_nationkey").alias("sheet"), row.alias("row"), F.lit(col).alias("col"), F.lit(name).alias("value")))
    every = cells[0]
    for more in cells[1:]:
        every = every.union(more)
    return imports.header(every).select("sheet", "row", F.col("names")["seat_no"].alias("seat_col"), F.col("names")["real_name"].alias("name_col"))


@query("a13_formulas", r"""with p as (select doc_id, '$$a+b$$ \[ d \] ' || text || ' \(e\) $c$ $$a+b$$' as page from documents),
f as (select doc_id, list_filter(list_transform(list_concat(list_concat(regexp_extract_all(page, '\$([^$\n]+)\$', 1), regexp_extract_all(page, '\\\[([^\]]+)\\\]', 1)), regexp_extract_all(page, '\\\(([^\)]+)\\\)', 1)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> '') as l from p)
select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as formulas from f""")
def a13(t):
    """Formulas of the whole texts as they are, with one of each kind of delimiter around them."""
    page = F.concat(F.lit(r"$$a+b$$ \[ d \] "), "text", F.lit(r" \(e\) $c$ $$a+b$$"))
    return t.documents.select("doc_id", F.array_join(tx.formulas(page), "|").alias("formulas"))

"""Families A, F and page triage over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, chunking, scans, wiki
from ..plans.registry import query

LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)"
SEGS = f"(select *, cast(sum(case when length(line) < 30 then 1 else 0 end) over (partition by doc_id order by pos) as bigint) as seg from {LINES})"
CHUNKS = f"(select doc_id, seg, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as text from {SEGS} group by 1, 2)"


def parted(t):
    return chunking.segments(chunking.lines(t.documents, "doc_id", F.col("text")), "doc_id", F.length("line") < 30)


@query("a04_segments", f"select doc_id, seg, cast(row_number() over (partition by doc_id order by seg) - 1 as integer) as index, sha256(text) as sha from {CHUNKS} where length(text) >= 20")
def a04(t):
    return chunking.joined(parted(t), "doc_id").select("doc_id", "seg", "index", F.sha2("text", 256).alias("sha"))


FLAT = "(select doc_id, lang, regexp_replace(text, '[#\\x00-\\x20]+', ' ', 'g') as x from documents)"
HALVES = f"(select doc_id, lang, x, 0 as k, 'Doc ' || doc_id || ' - ' || lang as title from {FLAT} union all select doc_id, lang, x, 1, 'Doc ' || doc_id || ' - ' || lang || ' - Deeper' from {FLAT})"


def headed(t):
    """Each document as a page with a title, a second- and a third-level heading."""
    flat = F.regexp_replace("text", r"[#\x00-\x20]+", " ")
    page = F.concat(F.lit("---\nid: x\n---\n# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"), flat, F.lit("\n### Deeper\n"), flat, F.lit("\n"))
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), page.alias("text"))


@query("a04_textbook", f"select 'd' || doc_id as path, title, k as chunk_index, sha256(trim(x)) as sha from {HALVES} where length(trim(x)) >= 20")
def a04_textbook(t):
    return chunking.textbook(headed(t)).select("path", "title", "chunk_index", F.sha2("text", 256).alias("sha"))


@query("a05_path", f"select title, count(*) as n from {HALVES} where length(trim(x)) >= 20 group by 1")
def a05(t):
    return chunking.textbook(headed(t)).groupBy("title").agg(F.count("*").alias("n"))


@query("a10_strip", r"select doc_id, sha256(regexp_replace(text, '!\[[^\]]*\]\([^)]+\)', '', 'g')) as sha from documents")
def a10(t):
    return t.documents.select("doc_id", F.sha2(tx.strip_images(F.col("text")), 256).alias("sha"))


@query("a14_counts", "select source, count(*) as n from documents group by 1")
def a14(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


EDGES = "(select url as src, 'https://' || unnest(regexp_extract_all(html, '<a href=\"/([^\"#|]*)\"', 1)) as dst from pages)"
IDS = "(select distinct 'https://' || regexp_extract(html, '<title>([^ <]*)', 1) as id from pages)"


def edges(t):
    """Links of each page, written as wiki links with an anchor and an alias, and read again by the operator."""
    wiki = F.regexp_replace("html", r'<a href="/([^"#|]*)"', r"[[x/$1.md#part|alias]]")
    return t.pages.select(F.col("url").alias("src"), F.explode(tx.links(wiki)).alias("d")).select("src", F.concat(F.lit("https://"), "d").alias("dst"))


def ids(t):
    return t.pages.select(F.concat(F.lit("https://"), F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("id")).distinct()


@query("f01_links", f"select src, dst, count(*) as n from {EDGES} group by 1, 2")
def f01(t):
    return edges(t).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("f02_dead", f"select src, count(*) as n, array_to_string(list_sort(list(distinct dst)), ' ') as dead from {EDGES} where dst not in (select id from {IDS}) group by 1")
def f02(t):
    return audit.dead(edges(t), ids(t)).groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("dst")), " ").alias("dead"))


@query("f03_degrees", f"select id, coalesce(i.n, 0) as inlinks, coalesce(o.n, 0) as outlinks from {IDS} left join (select dst as id, count(distinct src) as n from {EDGES} group by 1) i using (id) left join (select src as id, count(distinct dst) as n from {EDGES} group by 1) o using (id)")
def f03(t):
    return audit.degrees(edges(t), ids(t))


@query("f04_orphans", f"select id from {IDS} where id not in (select dst from {EDGES})")
def f04(t):
    return audit.orphans(edges(t), ids(t))


@query("f05_top", f"select dst, count(distinct src) as n from {EDGES} group by 1 order by n desc, dst limit 20")
def f05(t):
    return edges(t).groupBy("dst").agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(20)


@query("f06_bytes", "select doc_id, strlen(text) as bytes from documents where strlen(text) > 8000")
def f06(t):
    return t.documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes > 8000")


@query("f09_completeness", "select user_id as id, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda x: not list_contains(l, x))), ',') as missing from (select user_id, list(distinct event_type) as l from events where event_id % 3 > 0 group by 1) where missing <> ''")
def f09(t):
    rows = audit.incomplete(t.events.where("event_id % 3 > 0"), "user_id", "event_type", ["click", "purchase", "signup", "view"])
    return rows.select(F.col("user_id").alias("id"), F.array_join("missing", ",").alias("missing"))


@query("f13_dollar", "select doc_id, length(text) - length(replace(text, '$', '')) as dollars from documents where (length(text) - length(replace(text, '$', ''))) % 2 = 1")
def f13(t):
    n = F.length("text") - F.length(F.replace("text", F.lit("$"), F.lit("")))
    return t.documents.select("doc_id", n.cast("long").alias("dollars")).where("dollars % 2 = 1")


@query("f15_gaps", "select b + 1 as low, n - 1 as high from (select n, lag(n) over (order by n) as b from (select distinct o_orderkey as n from orders)) where n - b > 1")
def f15(t):
    return audit.gaps(t.orders, "o_orderkey")


@query("f15_duplicates", "select user_id, count(*) as n from events group by 1 having count(*) > 1")
def f15_duplicates(t):
    return audit.duplicates(t.events, "user_id")


@query("f17_level_jump", f"select doc_id, pos, level, before from (select *, lag(level) over (partition by doc_id order by pos) as before from (select doc_id, cast(pos as integer) as pos, cast(length(line) % 4 + 1 as integer) as level from {LINES})) where level - before > 1")
def f17(t):
    """Each line as a heading of a level that its length gives."""
    rows = chunking.lines(t.documents, "doc_id", F.col("text")).select(F.col("doc_id").alias("path"), "pos", F.concat(F.repeat(F.lit("#"), F.length("line") % 4 + 1), F.lit(" title")).alias("line"))
    return wiki.gaps_in_headings(rows).withColumnRenamed("path", "doc_id")


@query("f18_repeat")
def f18(t):
    """A back-reference, which the oracle's regular expressions lack."""
    return t.documents.where(audit.repeated_noise(F.col("text"))).select("doc_id")


@query("f26_bucket", """select user_id, bucket, text from (select *, row_number() over (partition by user_id order by bucket) as n from
(select user_id, cast(floor(s / 86400) as bigint) as bucket, substr(string_agg(event_type, ' ' order by s, event_type), 1, 1600) as text from (select user_id, event_type, cast(floor(epoch(ts)) as bigint) as s from events) group by 1, 2)) where n <= 80""")
def f26(t):
    return audit.buckets(t.events.select("user_id", "event_type", F.unix_timestamp("ts").alias("s")), "user_id", "s", "event_type", 86400)


@query("f28_rollup", "select count(*) as total, count(*) filter (value > 50) as ok, count(*) filter (not value > 50) as failed from events")
def f28(t):
    return t.events.agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("ok"), F.count_if(~(F.col("value") > 50)).alias("failed"))


@query("f30_manifest_diff", """select coalesce(e.doc_id, a.doc_id) as doc_id, case when a.doc_id is null then 'missing' when e.doc_id is null then 'extra' when e.b <> a.b then 'size' when e.s <> a.s then 'hash' else 'ok' end as status
from (select doc_id, strlen(text) as b, sha256(text) as s from documents where doc_id % 5 > 0) e full join (select doc_id, case when doc_id % 9 = 0 then 0 else strlen(text) end as b, case when doc_id % 4 = 0 then sha256(text || 'x') else sha256(text) end as s from documents where doc_id % 7 > 0) a on e.doc_id = a.doc_id""")
def f30(t):
    d = t.documents.select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.sha2(F.concat("text", F.lit("x")), 256).alias("other"))
    actual = d.where("doc_id % 7 > 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("doc_id") % 4 == 0, F.col("other")).otherwise(F.col("sha256")).alias("sha256"))
    return audit.manifest_diff(d.where("doc_id % 5 > 0"), actual, "doc_id")


@query("f30_renames", """with e as (select replace(source || chr(92) || 'sub/' || cast(doc_id as varchar), chr(92), '/') as old, strlen(text) as b, case when doc_id % 6 = 0 then '' else sha256(text) end as s, doc_id from documents where doc_id % 5 > 0),
n as (select *, case when doc_id % 50 = 1 then 'src1/moved/' || cast(doc_id % 100 as varchar) else old end as p from e),
m as (select *, case when starts_with(p, 'src12') then 'twelve' || substr(p, 6) when starts_with(p, 'src1') then 'one' || substr(p, 5) when starts_with(p, 'src2/sub/1') then 'two' || substr(p, 11) else 'kept/' || p end as path from n),
x as (select * from (select *, row_number() over (partition by path order by old desc) as r from m) where r = 1),
a as (select path, case when doc_id % 9 = 0 then 0 else b end as b, case when doc_id % 4 = 0 then 'other' else sha256(text) end as s from x join documents using (doc_id) where doc_id % 7 > 0 union all select 'extra/' || cast(doc_id as varchar), 1, '' from documents where doc_id % 70 = 0)
select coalesce(x.path, a.path) as path, case when a.path is null then 'missing' when x.path is null then 'extra' when x.b <> a.b then 'size' when x.s <> '' and x.s <> a.s then 'hash' else 'ok' end as status,
case when a.path is not null and x.b = a.b and (x.s = '' or x.s = a.s) then a.b else 0 end as bytes from x full join a on x.path = a.path""")
def f30_renames(t):
    d = t.documents.withColumns({"bytes": F.octet_length("text"), "sha256": F.sha2("text", 256)})
    expected = d.where("doc_id % 5 > 0").select(F.concat("source", F.lit("\\sub/"), F.col("doc_id").cast("string")).alias("path"), "bytes", F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("sha256")).alias("sha256"), "doc_id")
    moved = d.where("doc_id % 50 = 1").select(F.concat("source", F.lit("/sub/"), F.col("doc_id").cast("string")).alias("old"), F.concat(F.lit("src1/moved/"), (F.col("doc_id") % 100).cast("string")).alias("new"))
    prefixes = t._spark.createDataFrame([(0, "src12", "twelve"), (1, "src1", "one"), (2, "src2/sub/1", "two"), (3, "src12/", "never")], "position int, old string, new string")
    due = audit.renamed(expected, moved, prefixes, "kept/")
    there = due.join(d.select("doc_id", F.col("sha256").alias("own")), "doc_id").where("doc_id % 7 > 0").select("path", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("own")).alias("sha256"))
    more = d.where("doc_id % 70 = 0").select(F.concat(F.lit("extra/"), F.col("doc_id").cast("string")), F.lit(1), F.lit(""))
    return audit.verified(due.drop("doc_id"), there.union(more)).select("path", "status", "bytes")


@query("a12_list", """select doc_id, case doc_id % 5 when 4 then null else sha256('---' || chr(10) || case doc_id % 5 when 0 then 'tags:' || chr(10) || '    - ' || lang || chr(10) || '    - ' || source || chr(10) || 'b: 1' when 1 then 'a: 0' || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - ' || source || chr(10) || 'b: 1'
when 2 then 'a: 0' || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - ' || source else 'tags:' || chr(10) || '- ' || lang || chr(10) || '- ' || source end || chr(10) || '---' || chr(10) || text) end as sha from documents""")
def a12_list(t):
    """Lists of the frontmatter before each text: indented, in brackets, absent, not indented, and no frontmatter."""
    k = F.col("doc_id") % 5
    heads = ["tags:\n    - x\n    - y\nb: 1", "a: 0\ntags: [x, y]\nb: 1", "a: 0", "tags:\n- x"]
    head = F.element_at(F.array(*map(F.lit, heads)), F.least(k, F.lit(3)).cast("int") + 1)
    page = F.when(k == 4, F.concat(F.lit("tags: x\n"), "text")).otherwise(F.concat(F.lit("---\n"), head, F.lit("\n---\n"), "text"))
    return t.documents.select("doc_id", F.sha2(tx.with_frontmatter_list(page, "tags", F.array("lang", "source")), 256).alias("sha"))


@query("q10_classify", """select doc, pages, chars, round(scan_share, 6) as scan_share, case when scan_share >= 0.8 then 'image' when text_share >= 0.8 then 'text' else 'mixed' end as kind from
(select source as doc, count(*) as pages, cast(sum(n_chars) as bigint) as chars, avg(case when n_chars < 20 and doc_id % 10 > 5 then 1.0 else 0 end) as scan_share, avg(case when n_chars >= 200 then 1.0 else 0 end) as text_share from documents group by 1)""")
def q10(t):
    metrics = t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.col("n_chars").alias("chars"), F.lit(0).alias("images"), (F.col("doc_id") % 10 / 10.0).alias("image_area"))
    return scans.page_kind(metrics).select("doc", "pages", "chars", F.round("scan_share", 6).alias("scan_share"), "kind")

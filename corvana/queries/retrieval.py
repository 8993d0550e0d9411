"""Families B, H: retrieval and routing over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as r
from ..operators import routing
from ..plans.registry import query

DOT = "round(list_dot_product(cast(v.embedding as double[]), cast(q.embedding as double[])), 6)"
TOP = f"select q.vec_id as qid, v.vec_id as id, {DOT} as score from embeddings v, embeddings q where q.vec_id"
RANKED = "select qid, id, score, cast(row_number() over (partition by qid order by score desc, id) as integer) as rank from"


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def asked(t, condition):
    return t.embeddings.where(condition).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query("b03_dense_topk", f"select * from ({RANKED} ({TOP} % 50 = 0)) where rank <= 5")
def b03(t):
    return r.nearest(asked(t, "vec_id % 50 = 0"), vectors(t), 5)


@query("b06_hybrid_compat", f"select * from ({RANKED} ({TOP} % 50 = 1)) where rank <= 5")
def b06(t):
    return r.nearest(asked(t, "vec_id % 50 = 1"), vectors(t), 5)


@query("b10_multi_query_topk", f"select * from ({RANKED} ({TOP} % 50 = 0)) where rank <= 3")
def b10(t):
    return r.nearest(asked(t, "vec_id % 50 = 0"), vectors(t), 3)


@query("b11_pairwise", f"{TOP} % 50 = 0")
def b11(t):
    return r.scored(asked(t, "vec_id % 50 = 0"), vectors(t), by_score=True)


@query("b12_normalize", """select vec_id, i, round(x / case when n = 0 then 1 else n end, 6) as x from (select vec_id, unnest(e) as x, unnest(range(1, len(e) + 1)) as i, sqrt(list_sum(list_transform(e, lambda y: y * y))) as n
from (select vec_id, list_transform(cast(embedding as double[]), lambda y: y * (vec_id % 3)) as e from embeddings))""")
def b12(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)).alias("e"))
    rows = e.select("vec_id", F.posexplode(r.normalized(F.col("e"))).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


POSTINGS = "(select doc_id as id, token, cast(count(*) as double) as weight from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as token from documents) group by 1, 2)"
ASKED = "(select item_id as qid, token, cast(count(*) as double) as w from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as token from benchmark) group by 1, 2)"
SPARSE = f"(select qid, id, round(sum(w * weight), 6) as score from {POSTINGS} join {ASKED} using (token) group by qid, id)"


def sparse(t):
    queries = r.postings(t.benchmark, "item_id", "text").withColumnRenamed("id", "qid")
    return r.sparse(queries, r.postings(t.documents, "doc_id", "text", only=queries))


@query("b04_sparse_topk", f"select * from ({RANKED} {SPARSE}) where rank <= 5")
def b04(t):
    return r.best(sparse(t), 5)


@query("b07_union_dedup", f"""with d as (select qid, id, score from ({RANKED} ({TOP} % 50 = 0)) where rank <= 5), s as (select qid, id, score from ({RANKED} {SPARSE}) where rank <= 5),
u as (select *, 'src' || cast(id % 20 as varchar) as source from (select * from d union all select * from s))
select qid, id, score, source from (select *, row_number() over (partition by qid, source order by score desc, id) as n from u) where n = 1""")
def b07(t):
    with_source = lambda x: x.select("qid", "id", "score", F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("source"))
    return r.merged(with_source(b03(t)), with_source(r.best(sparse(t), 5)), ["qid", "source"])


@query("b09_budget", f"""select qid, id, rank, tokens, used from (select *, cast(sum(tokens) over (partition by qid order by rank) as bigint) as used from
(select s.*, cast(ceil(strlen(substr(d.text, 1, 500)) / 3.0) as bigint) as tokens from (select * from ({RANKED} {SPARSE}) where rank <= 10) s join documents d on d.doc_id = s.id)) where used <= 1000""")
def b09(t):
    top = r.best(sparse(t), 10).join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return r.within_budget(top, 1000).select("qid", "id", "rank", "tokens", "used")


@query("b14_contamination", "select doc_id, source from documents where contains(lower(source), 'src3') or contains(lower(source), 'src7') or contains(lower(source), 'skills/')")
def b14(t):
    return t.documents.where(r.contaminated(F.col("source"), ("src3", "src7", "skills/"))).select("doc_id", "source")


@query("b15_parity", "select (select count(*) from documents) as total_chunks, (select count(*) from embeddings) as total_vectors, (select max(len(embedding)) from embeddings) as dim")
def b15(t):
    return t.documents.agg(F.count("*").alias("total_chunks")).join(t.embeddings.agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).cast("long").alias("dim")))


@query("b16_coverage", "select text as key, exists (select 1 from documents d where contains(d.text, b.text)) as found from (select distinct text from benchmark) b")
def b16(t):
    return r.coverage(t.benchmark.select(F.col("text").alias("key")).distinct(), t.documents.select("text"))


TERMS = [("en", "the", 28), ("en", " and ", 14), ("de", "der", 28), ("de", " und ", 14), ("fr", "les", 28), ("es", "ción", 28), ("junk", "%%%", 40), ("junk", "!!", 14), ("en", "%%%", -35)]
VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in TERMS)
LEXICAL = f"select doc_id as qid, rec, cast(sum(weight) as bigint) as score from documents d join (values {VALUES}) as t(rec, term, weight) on contains(lower(d.text), trim(lower(term))) group by 1, 2"


def lexical(t):
    terms = t._spark.createDataFrame(TERMS, "rec string, term string, weight long")
    return routing.lexical(t.documents.select(F.col("doc_id").alias("qid"), "text"), terms)


@query("h03_lexical", LEXICAL)
def h03(t):
    return lexical(t)


ROUTED = f"(select qid, case when score > 0 then rec else 'none' end as rec, score, runner_up from (select *, row_number() over w as n, coalesce(lead(score) over w, 0) as runner_up from ({LEXICAL}) window w as (partition by qid order by score desc, rec)) where n = 1)"


@query("h06_route", f"select * from {ROUTED}")
def h06(t):
    return routing.ranked(lexical(t), "none")


@query("h08_confidence", f"select qid, round(case when score <= 0 then 0.42 else least(0.98, greatest(0.35, 0.58 + least((score - runner_up) / 220.0, 0.18) + least(score / 500.0, 0.08))) end, 1) as confidence from {ROUTED}")
def h08(t):
    return routing.ranked(lexical(t), "none").select("qid", F.round(routing.confidence(F.col("score"), F.col("runner_up"), F.lit(False)), 1).alias("confidence"))


#: Records (rec, name, category, priority) and their typed terms; stages and cosines of a text go by its language and number.
RECORDS = [("en", "english prose", "the", 61, 0), ("de", "deutsch", "und", 50, 1), ("fr", "les textes", "fr", None, 2), ("es", "texto", "ción", 55, 3), ("junk", "junk", "%%%", 5, 4)]
TYPED = [("en", "trigger", " the "), ("en", "trigger", "and"), ("en", "hint", "ing "), ("en", "negative", "der "), ("de", "trigger", "Die "), ("de", "card", "ung"), ("de", "hint", "der"), ("fr", "trigger", "les"), ("fr", "card", "que"), ("fr", "card", "que"), ("es", "trigger", "ción"), ("es", "hint", "los"), ("es", "negative", "the"), ("junk", "trigger", "!!"), ("junk", "negative", "e"), ("junk", "negative", "a")]
KINDS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TYPED)
LISTED = ", ".join(f"('{a}', '{b}', '{c}', {d or 'null'}, {e})" for a, b, c, d, e in RECORDS)
COMPOSED = f"""with r(rec, name, category, priority, position) as (values {LISTED}), y(rec, kind, term) as (values {KINDS}),
w as (select rec, lower(trim(term)) as term, case kind when 'trigger' then 28 + least(length(term), 8) when 'hint' then 14 when 'card' then 10 else -35 end as weight from y
union all select rec, lower(trim(name)), 4 from r union all select rec, lower(trim(category)), 4 from r),
l as (select doc_id as qid, rec, sum(weight) as added from documents join w on contains(lower(text), w.term) group by 1, 2),
q as (select doc_id as qid, r.rec, position, coalesce(priority, 50) // 10 + coalesce(added, 0) as lexical, case when lang = r.rec and doc_id % 3 = 0 then 100 else 0 end as bonus,
case when doc_id % 7 = position then cast(floor(greatest(0, (doc_id % 41 - 20) / 20.0) * 15) as bigint) else 0 end as semantic from documents cross join r left join l on l.qid = doc_id and l.rec = r.rec),
n as (select *, lexical + bonus + semantic as score, row_number() over (partition by qid order by lexical + bonus + semantic desc, bonus desc, position) as rank from q),
top as (select qid, max(score) as top from n group by qid)"""


def composed(t):
    """Every document routed as a query: a third of them have a stage, and one record in seven numbers a cosine."""
    records = t._spark.createDataFrame(RECORDS, "rec string, name string, category string, priority int, position int")
    terms = t._spark.createDataFrame(TYPED, "rec string, kind string, term string")
    number = F.col("doc_id") % 7
    near = F.when(number < len(RECORDS), F.map_from_arrays(F.array(F.element_at(F.array(*(F.lit(r[0]) for r in RECORDS)), F.least(number, F.lit(len(RECORDS) - 1)).cast("int") + 1)), F.array((F.col("doc_id") % 41 - 20) / 20.0)))
    queries = t.documents.select(F.col("doc_id").alias("qid"), "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("stage"), near.alias("semantic"))
    return routing.routed(queries, records, terms, "de")


@query("h06_composed", f"{COMPOSED} select qid, rec, rank, cast(score as bigint) as score, cast(lexical as bigint) as lexical, bonus, semantic from n join top using (qid) where rank <= 2 and top > 0 union all select qid, 'de', 1, 0, 0, 0, 0 from top where top <= 0")
def h06_composed(t):
    return composed(t)


@query("h08_staged", f"""{COMPOSED} select qid, rec, cast(score as bigint) as score, round(least(0.98, greatest(0.35, case when staged then 0.72 else 0.58 end + least((score - second) / 220.0, 0.18) + least(score / 500.0, 0.08))), 2) as confidence
from (select qid, max(case when rank = 1 then rec end) as rec, max(case when rank = 1 then score end) as score, max(case when rank = 2 then score end) as second, qid % 3 = 0 as staged from n group by qid) where score > 0
union all select qid, 'de', 0, 0.42 from top where top <= 0""")
def h08_staged(t):
    return routing.with_confidence(composed(t).withColumn("staged", F.col("qid") % 3 == 0))


@query("h05_semantic", f"select qid, id, cast(floor(greatest(0, score) * 15) as bigint) as bonus from ({TOP} % 50 = 0)")
def h05(t):
    return r.scored(asked(t, "vec_id % 50 = 0"), vectors(t)).select("qid", "id", routing.semantic(F.col("score")).alias("bonus"))

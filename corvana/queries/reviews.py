"""Reviews, contracts and ledgers over lineitem, customer, supplier, events, documents and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reviews as r
from ..operators import versions
from ..operators.tables import shared_dir
from ..plans.registry import query


@query("j09_attempts", """select task_id, problems from (select l_orderkey as task_id, concat_ws(',', case when count(*) > 5 then 'too_many' end, case when count(distinct l_linenumber) < count(*) then 'repeated' end,
case when count(distinct l_suppkey) < count(*) then 'worker_reused' end, case when min(l_linenumber) <> 1 or max(l_linenumber) <> count(distinct l_linenumber) then 'gap' end) as problems from lineitem group by 1) where problems <> ''""")
def j09(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("attempt_id"), F.col("l_linenumber").alias("attempt_no"), F.col("l_suppkey").alias("worker_id"))
    return r.ledger_problems(rows, 5).select("task_id", F.array_join("problems", ",").alias("problems"))


@query("j10_identity", """select s_suppkey as key, concat_ws(',', case when c_custkey is null or s_nationkey <> c_nationkey then 'nation' end, case when c_custkey is null or (s_acctbal > 0) <> (c_acctbal > 0) then 'solvent' end) as fields
from supplier left join customer on s_suppkey = c_custkey""")
def j10(t):
    results = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("solvent"))
    cards = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("solvent"))
    return r.mismatches(results, cards, "key", ["nation", "solvent"]).select("key", F.array_join(F.transform("mismatches", lambda x: x["field"]), ",").alias("fields"))


@query("j19_sync", """select coalesce(s_suppkey, c_custkey) as path, case when s_suppkey is null then 'delete' when c_custkey is null then 'create' when s_nationkey = c_nationkey then 'keep' else 'update' end as action
from supplier full join customer on s_suppkey = c_custkey""")
def j19(t):
    files = lambda rows, p: rows.select(F.col(f"{p[0]}_{p[1]}key").alias("path"), F.col(f"{p[0]}_nationkey").cast("string").alias("sha"))
    plan = r.sync_plan(files(t.supplier, "s supp".split()), files(t.customer, "c cust".split()), r"^\.git/")
    return plan.select("path", "action")


@query("g32_unique", """with p as (select user_id, case when count(distinct event_type) = 1 and bool_and(value > 10) then min(event_type) end as one from events group by 1)
select coalesce(user_id, c_custkey) as user_id, coalesce(one, c_mktsegment) as kind from p full join customer on user_id = c_custkey""")
def g32(t):
    primary = t.events.select("user_id", F.col("event_type").alias("kind"), (F.col("value") > 10).alias("final"))
    return r.unique_or(primary, t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("kind")), "user_id", "kind", "final")


@query("g34_changed", "select doc_id, sha256(text) as sha from documents where doc_id not in (select doc_id from labels where quality = 1)")
def g34(t):
    files = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    known = files.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return r.changed(files, known, ["doc_id", "sha"])


@query("g34_replaced", """select source_path, line, version from (select cast(doc_id as varchar) as source_path, unnest(string_split(text, chr(10))) as line, 1 as version from documents where doc_id % 3 = 0
union all select cast(doc_id as varchar), unnest(string_split(text || ' again', chr(10))), 2 from documents where doc_id % 3 = 1 union all select cast(doc_id as varchar), unnest(string_split(text, chr(10))), 2 from documents where doc_id % 3 = 2)""")
def g34_replaced(t):
    """Two scans of the documents into one store: of the first, a third is unchanged and a third has new texts; a third comes new."""
    store = versions.Store(t._spark, f"{shared_dir(t._spark)}/g34-{uuid.uuid4().hex}", 16)
    k = F.col("doc_id") % 3
    for scan in (1, 2):
        rows = t.documents.where(k < 2) if scan == 1 else t.documents
        text = F.when((k == 1) & F.lit(scan == 2), F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
        rows = rows.select(F.col("doc_id").cast("string").alias("source_path"), text.alias("text"), F.when(k == 0, 1).otherwise(scan).alias("mtime"))
        found = rows.select("source_path", F.sha2("text", 256).alias("sha"), "mtime", F.lit("scanned").alias("status"))
        children = rows.select("source_path", F.explode(F.split("text", "\n")).alias("line"), F.lit(scan).alias("version"))
        shared = children.select(F.sha2("line", 256).alias("hash"), "line").distinct()
        versions.replace_documents(store, found, children, shared)
    return store.read("occurrences").select("source_path", "line", "version")


LEGACY = """(select source as campaign, 'q' || cast(doc_id as varchar) as question_id, case when doc_id % 97 = 0 then 7 else doc_id end as queue_ordinal, 'd/' || cast(case when doc_id % 31 = 0 then -doc_id else doc_id end as varchar) as target_path,
case when doc_id % 29 = 0 then 'old' else sha256(text) end as current_sha256, doc_id % 4 > 0 as ready, case when doc_id % 5 = 0 then null else 'd/' || cast(doc_id - doc_id % 5 as varchar) end as source_path, doc_id, text from documents)"""
FILES = "(select 'd/' || cast(doc_id as varchar) as path, sha256(text) as sha256, strlen(text) as bytes from documents)"


def legacy(t):
    d, k = t.documents, F.col("doc_id")
    path = lambda c: F.concat(F.lit("d/"), c.cast("string"))
    items = d.select(
        F.col("source").alias("campaign"), F.concat(F.lit("q"), k.cast("string")).alias("question_id"), F.when(k % 97 == 0, 7).otherwise(k).alias("queue_ordinal"), F.replace(path(F.when(k % 31 == 0, -k).otherwise(k)), F.lit("/"), F.lit("\\")).alias("target_path"),
        F.when(k % 29 == 0, "old").otherwise(F.sha2("text", 256)).alias("current_sha256"), F.when(k % 4 > 0, "source_ready").otherwise("absent").alias("source_state"), F.lit("").alias("source_key"), F.when(k % 5 > 0, path(k - k % 5)).alias("source_path"),
        F.when(k % 3 == 0, "gone").otherwise(F.sha2("text", 256)).alias("source_sha256"), F.when(k % 2 == 0, F.array(F.lit("P2"), F.lit("P0"))).otherwise(F.array(F.lit("P1"))).alias("severities"),
    )
    items = items.join(d.select(path(k).alias("source_path"), F.sha2("text", 256).alias("_s")), "source_path", "left").withColumn("source_sha256", F.when(F.col("source_sha256") == "gone", "gone").otherwise(F.coalesce("_s", F.lit("none")))).drop("_s")
    files = d.select(path(k).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    return r.legacy_ledger(items, files, ["q8", "q9"])


@query("j22_ledger", f"""select campaign, question_id, cast(queue_ordinal as integer) as queue_ordinal, case when doc_id % 2 = 0 then 'P0' else 'P1' end as severity, ready and (source_path is null or (doc_id % 3 > 0 and s.path is not null)) as source_ready, coalesce(t.bytes, -1) as target_bytes,
coalesce(case when ready and doc_id % 3 > 0 then s.bytes end, -1) as source_bytes, case when question_id in ('q8', 'q9') then 'legacy_no_change_pending_audit' else 'queued' end as initial_status from {LEGACY} l left join {FILES} t on t.path = l.target_path left join {FILES} s on s.path = l.source_path""")
def j22_ledger(t):
    return legacy(t)[0].select("campaign", "question_id", "queue_ordinal", "severity", "source_ready", F.coalesce("target.bytes", F.lit(-1)).alias("target_bytes"), F.coalesce("source.bytes", F.lit(-1)).alias("source_bytes"), "initial_status")


@query("j22_problems", f"""select campaign, question_id, case when t.path is null then 'missing_target' else 'target_drift' end as problem from {LEGACY} l left join {FILES} t on t.path = l.target_path where t.path is null or t.sha256 <> current_sha256
union all select campaign, question_id, 'duplicate_ordinal' from {LEGACY} where (campaign, queue_ordinal) in (select (campaign, queue_ordinal) from {LEGACY} group by campaign, queue_ordinal having count(*) > 1)
union all select campaign, question_id, 'source_hash_or_path_drift' from {LEGACY} l left join {FILES} s on s.path = l.source_path where ready and source_path is not null and (s.path is null or doc_id % 3 = 0)""")
def j22_problems(t):
    _, drift, problems = legacy(t)
    return problems.union(drift.select("campaign", "question_id", F.col("defect").alias("problem")))

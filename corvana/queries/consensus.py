"""Family G over documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import consensus as c
from ..plans.registry import query

USABLE = "(select user_id as key, event_type as engine, cast(cast(floor(value / 20) as bigint) as varchar) as norm from events)"


def usable(t):
    return t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("engine"), F.floor(F.col("value") / 20).cast("string").alias("norm"))


@query("g03_consensus", f"""with g as (select key, norm, list(distinct engine) as engines from {USABLE} group by 1, 2), f as (select *, list_contains(engines, 'click') and list_contains(engines, 'view') as full_set from g),
r as (select *, row_number() over (partition by key order by full_set desc, len(engines) desc, norm desc) as n, count(*) over (partition by key) as vals from f)
select key, case when full_set then norm end as winner, case when full_set then 'agreed' else 'needs_review' end as status, not full_set and vals > 1 as disagrees from r where n = 1""")
def g03(t):
    return c.consensus(usable(t), ["click", "view"])


@query("g05_dedup", "select doc_id, sha256(text) as sha, min(doc_id) over (partition by text) as owner from documents")
def g05(t):
    return c.by_hash(t.documents.select("doc_id", "text"), "doc_id", F.col("text")).select("doc_id", "sha", "owner")


@query("g06_pending", "select distinct sha256(text) as sha from documents where text not in (select text from documents where doc_id < 300)")
def g06(t):
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return c.pending(hashed, hashed.where("doc_id < 300").select("sha").distinct())


@query("g09_argmax", "select user_id, arg_max(event_type, {'v': value, 'e': -event_id}) as event_type, max(value) as value from events group by 1")
def g09(t):
    return c.best_candidate(t.events.select("user_id", "event_type", "value", "event_id"), "user_id", "value", "event_id").select("user_id", "event_type", "value")


@query("g10_conflicts", "select user_id, round(max(value) - min(value), 6) as spread, min(value) as least from events group by 1 having max(value) - min(value) > 60 or min(value) < 0.65")
def g10(t):
    return c.spread_conflicts(t.events, "user_id", "value", "value").select("user_id", F.round("spread", 6).alias("spread"), "least")


@query("g11_matrix", "select user_id, event_type, count(*) as n, count(distinct cast(floor(value) as bigint)) as regions, max(value) as best, bool_or(value < 1) as needs_review from events group by 1, 2")
def g11(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.countDistinct(F.floor("value")).alias("regions"), F.max("value").alias("best"), F.bool_or(F.col("value") < 1).alias("needs_review"))


@query("g15_repetition", "select conv_id, turn, round(coalesce((select max(n) / sum(n) from (select count(*) as n from unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as u(w) group by w)), 0), 6) as share from conversations")
def g15(t):
    return t.conversations.select("conv_id", "turn", F.round(tx.repetition(F.col("text")), 6).alias("share"))


@query("g17_having", "select user_id, count(distinct event_type) as engines from events group by 1 having count(distinct event_type) >= 2")
def g17(t):
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("engines")).where("engines >= 2")


@query("g18_invalidate", "select o_orderkey, case when o_custkey in (select user_id from events where value > 99) then 'stale' else o_orderstatus end as status from orders")
def g18(t):
    bad = t.events.where("value > 99").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("bad", F.lit(True))
    return t.orders.join(bad, "o_custkey", "left").select("o_orderkey", F.when(F.col("bad"), "stale").otherwise(F.col("o_orderstatus")).alias("status"))


@query("g22_owner", "select doc_id, min(doc_id) over (partition by text) <> doc_id as is_duplicate from documents")
def g22(t):
    return c.by_hash(t.documents.select("doc_id", "text"), "doc_id", F.col("text")).select("doc_id", (F.col("owner") != F.col("doc_id")).alias("is_duplicate"))


@query("g24_packing", """with recursive r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as i, cast(floor(value) as bigint) as s from events),
p as (select user_id, i, event_id, s as used, 0 as part from r where i = 1 union all
select r.user_id, r.i, r.event_id, case when p.used + r.s > 90 then r.s else p.used + r.s end, case when p.used + r.s > 90 then p.part + 1 else p.part end from p join r on r.user_id = p.user_id and r.i = p.i + 1)
select user_id, event_id, part from p""")
def g24(t):
    return c.packed(t.events.select("user_id", "event_id", F.floor("value").alias("s")), "user_id", "event_id", "s", 90)


@query("g24_hot_keys", """with recursive r as (select event_type, event_id, row_number() over (partition by event_type order by event_id) as i, cast(floor(value) as bigint) as s from events),
p as (select event_type, i, event_id, s as used, 1 as n, 0 as part from r where i = 1 union all
select r.event_type, r.i, r.event_id, case when p.n = 4 or p.used + r.s > 90 then r.s else p.used + r.s end, case when p.n = 4 or p.used + r.s > 90 then 1 else p.n + 1 end, case when p.n = 4 or p.used + r.s > 90 then p.part + 1 else p.part end from p join r on r.event_type = p.event_type and r.i = p.i + 1)
select event_type, event_id, part from p""")
def g24_hot_keys(t):
    """A few keys with all the rows, under a cap of size and one of number."""
    return c.packed_by_jumps(t.events.select("event_type", "event_id", F.floor("value").alias("s")), "event_type", "event_id", "s", 90, 4)


@query("g36_boxes", """with recursive b as (select l_orderkey as k, row_number() over (partition by l_orderkey order by y0, x0, y1, x1) as i, x0, y0, x1, y1 from (select l_orderkey, l_partkey % 30 as x0,
l_linenumber * 22 + l_partkey % 7 as y0, l_partkey % 30 + l_suppkey % 60 as x1, l_linenumber * 22 + l_partkey % 7 + 8 + cast(floor(l_quantity) as bigint) % 18 as y1 from lineitem)),
f as (select k, i, x0, y0, x1, y1, false as done, 0::bigint as dx0, 0::bigint as dy0, 0::bigint as dx1, 0::bigint as dy1 from b where i = 1 union all
select b.k, b.i, case when m then least(f.x0, b.x0) else b.x0 end, case when m then least(f.y0, b.y0) else b.y0 end, case when m then greatest(f.x1, b.x1) else b.x1 end, case when m then greatest(f.y1, b.y1) else b.y1 end, not m, f.x0, f.y0, f.x1, f.y1
from (select f.*, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, b.y0 - f.y1 <= 5 and (f.y1 - f.y0 < 18 or b.y1 - b.y0 < 18) as m from f join b on b.k = f.k and b.i = f.i + 1) f join b on b.k = f.k and b.i = f.i + 1),
e as (select k, dx0 as x0, dy0 as y0, dx1 as x1, dy1 as y1 from f where done union all select k, x0, y0, x1, y1 from (select *, row_number() over (partition by k order by i desc) as r from f) where r = 1)
select k as page, x0, y0, x1, y1 from e where x1 - x0 >= 24""")
def g36_boxes(t):
    """Each order as a page of boxes, one a line."""
    x0, y0 = F.col("l_partkey") % 30, F.col("l_linenumber") * 22 + F.col("l_partkey") % 7
    boxes = t.lineitem.select(F.col("l_orderkey").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_suppkey") % 60).alias("x1"), (y0 + 8 + F.floor("l_quantity") % 18).alias("y1"), F.struct(F.lit(600).alias("width"), F.lit(500).alias("height")).alias("size"))
    return c.merged_boxes(boxes, "page", "size")


@query("g25_tokens", "select doc_id, cast(ceil(strlen(text) / 3.0) as bigint) as tokens from documents")
def g25(t):
    return t.documents.select("doc_id", tx.text_tokens(F.col("text")).alias("tokens"))


@query("g26_budget", "select source, count(*) as n, count(*) filter (n_chars > 4000) as large, max(n_chars) as most, bool_or(n_chars > 15000) as any_huge from documents group by 1")
def g26(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 4000).alias("large"), F.max("n_chars").alias("most"), F.bool_or(F.col("n_chars") > 15000).alias("any_huge"))


@query("g36_islands", """select user_id, cast(sum_new as bigint) as island, min(s) as low, max(s) as high, count(*) as n from (select *, sum(fresh) over (partition by user_id order by s, event_id rows unbounded preceding) as sum_new from
(select user_id, event_id, s, case when s - lag(s) over (partition by user_id order by s, event_id) > 1800 then 1 else 0 end as fresh from (select user_id, event_id, cast(floor(epoch(ts)) as bigint) as s from events))) group by 1, 2""")
def g36(t):
    return c.islands(t.events.select("user_id", F.unix_timestamp("ts").alias("s")), "user_id", "s", 1800)

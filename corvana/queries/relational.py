"""Families C, D, E, I, J over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics as a
from ..operators import hierarchy, ingest, queueing, taxonomy
from ..plans.registry import query


@query("c01_class_point", "select c_custkey, n_name, r_name, c_acctbal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def c01(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name", "c_acctbal")


@query("c02_status_rollup", """select c_custkey, count(o_orderstatus) as n, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as n_f, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as n_o,
cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as n_p, round(avg(coalesce(floor(o_totalprice), 0)), 3) as avg_rate from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def c02(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.floor("o_totalprice").cast("double").alias("rate"))
    return a.status_rollup(t.customer.select("c_custkey"), orders, "c_custkey", "o_orderstatus", "rate")


PROFILE = """select c_custkey as id, coalesce(r.n, 0) as n_results, round(r.s, 3) as avg_score, coalesce(s.n, 0) as n_submissions, round(coalesce(s.c, 0), 3) as avg_completion from customer
left join (select o_custkey, count(distinct o_orderkey) as n, avg(floor(o_totalprice)) as s from orders group by 1) r on o_custkey = c_custkey
left join (select user_id, count(distinct event_id) as n, avg(coalesce(floor(value), 0)) as c from events group by 1) s on user_id = c_custkey"""


def facts(t):
    results = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("result_id"), F.floor("o_totalprice").cast("double").alias("score"))
    submissions = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("submission_id"), F.floor("value").cast("double").alias("completion"))
    return t.customer.select(F.col("c_custkey").alias("id")), results, submissions


@query("c03_profile", PROFILE)
def c03(t):
    return a.profile(*facts(t), "id")


@query("c03_profile_literal", PROFILE)
def c03_literal(t):
    return a.profile_literal(*facts(t), "id")


ITEMS = "select p_partkey, p_brand, count(l_orderkey) as evidence, round(avg(case when l_quantity > 0 then floor(l_extendedprice) / 1000 end), 10) as rate, round(avg(case when l_returnflag = 'R' then 1.0 else 0 end), 6) as correct_rate from part left join lineitem on p_partkey = l_partkey group by 1, 2"


def items(t):
    joined = t.part.select("p_partkey", "p_brand").join(t.lineitem.select("l_partkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.groupBy("p_partkey", "p_brand").agg(F.count("l_orderkey").alias("evidence"), F.round(F.avg(F.when(F.col("l_quantity") > 0, F.floor("l_extendedprice") / 1000)), 10).alias("rate"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("correct_rate"))


@query("c04_item_analysis", ITEMS)
def c04(t):
    return items(t)


@query("c05_filtered", f"select * from ({ITEMS}) where p_brand = 'Brand#11' order by p_partkey limit 50")
def c05(t):
    return a.safe_query({"items": items(t)}, "items", ["p_partkey"], 50, p_brand="Brand#11")


@query("c07_report", "select o_orderkey, o_custkey, o_orderdate from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 10")
def c07(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_orderdate")


@query("c12_additive_columns", "select n_nationkey, n_name, 'U' as gender, cast(null as varchar) as score_band from nation")
def c12(t):
    return t.nation.select("n_nationkey", "n_name", F.lit("U").alias("gender"), F.lit(None).cast("string").alias("score_band"))


@query("d02_unpivot", """select l_orderkey, l_linenumber, 'Q1' as item_key, l_quantity as score, cast(50 as double) as max_score from lineitem union all
select l_orderkey, l_linenumber, 'Q2a', l_tax, null from lineitem union all select l_orderkey, l_linenumber, 'Q_3', case when l_discount = 0 then null else l_discount end, 0.1 from lineitem""")
def d02(t):
    text = lambda c: F.col(c).cast("string")
    wide = t.lineitem.select(
        "l_orderkey", "l_linenumber", text("l_quantity").alias("Q1_score"), F.lit("50").alias("Q1_max_score"), text("l_tax").alias("Q2a_score"),
        F.when(F.col("l_discount") == 0, "缺考").otherwise(text("l_discount")).alias("Q_3_score"), F.lit(" 0.1 ").alias("Q_3_max_score"), F.lit("1").alias("Total_score"),
    )
    return ingest.item_results(wide, ["l_orderkey", "l_linenumber"])


@query("d03_clean", "select event_id, try_cast(nullif(trim(regexp_extract(props, '\"k\": *\"?([^,}\"]*)', 1)), '') as double) as k from events")
def d03(t):
    return t.events.select("event_id", tx.number(F.regexp_extract("props", '"k": *"?([^,}"]*)', 1)).alias("k"))


@query("d04_answer", "select o_orderkey, array_to_string(list_sort(string_split(upper(o_orderpriority), '-')), ',') as answer from orders")
def d04(t):
    return t.orders.select("o_orderkey", F.replace(tx.answer(F.replace("o_orderpriority", F.lit("-"), F.lit("，"))), F.lit("\0"), F.lit("")).alias("answer"))


@query("d05_correctness", "select l_orderkey, l_linenumber, cast(l_quantity >= 25 as integer) as is_correct from lineitem")
def d05(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.is_correct(F.col("l_quantity"), F.lit(25), F.lit(""), F.lit("")).alias("is_correct"))


@query("d08_first_wins", "select user_id, event_type, arg_min(event_id, event_id) as event_id from events group by 1, 2")
def d08(t):
    return ingest.first_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("d09_last_wins", "select user_id, event_type, max(event_id) as event_id from events group by 1, 2")
def d09(t):
    return ingest.last_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("d10_upsert", "select coalesce(o.k, n.k) as k, coalesce(n.v, o.v) as v from (select c_custkey as k, c_mktsegment as v from customer where c_custkey % 3 > 0) o full join (select c_custkey as k, 'new' as v from customer where c_custkey % 2 = 0) n on o.k = n.k")
def d10(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return ingest.upsert(c.where("k % 3 > 0"), c.where("k % 2 = 0").withColumn("v", F.lit("new")), ["k"], ["v"])


@query("d12_fk_miss", "select event_id, user_id from events where user_id not in (select c_custkey from customer)")
def d12(t):
    return ingest.missing_parents(t.events.select("event_id", "user_id"), t.customer.select("c_custkey"), "user_id", "c_custkey")


@query("d13_score_rate", "select l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 6) as rate from lineitem")
def d13(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(tx.rate(F.col("l_quantity"), F.col("l_discount")), 6).alias("rate"))


@query("d19_align", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey")
def d19(t):
    roster = t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return ingest.aligned(roster, t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey"), ["k"])[0].select("c_custkey", "s_suppkey")


@query("d22_observed_max", "select l_partkey, coalesce(max(l_quantity), 1.0) as max_score from lineitem group by 1")
def d22(t):
    return ingest.observed_max(t.lineitem, "l_partkey", "l_quantity")


RATED = "(select l_orderkey, l_linenumber, l_partkey, l_quantity, avg(l_quantity / 50) over (partition by l_partkey) as class_rate from lineitem)"


def rated(t):
    return a.with_class_average(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(50.0).alias("m")), "l_partkey", "l_quantity", "m")


@query("e01_item_vs_avg", f"select l_orderkey, l_linenumber, l_partkey, round(class_rate, 6) as class_rate from {RATED}")
def e01(t):
    return rated(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round("class_rate", 6).alias("class_rate"))


KPS = f"""(select kp, score, weight, score / weight as mastery, class_rate, score / weight - class_rate as gap from (select coalesce(case when p_size < 25 then p_brand end, 'unmapped:' || cast(l_partkey as varchar)) as kp, sum(l_quantity) as score, sum(50.0) as weight, sum(class_rate * 50) / sum(50.0) as class_rate
from {RATED} join part on p_partkey = l_partkey group by 1))"""


def points(t):
    rows = rated(t).join(t.part.select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_brand")).alias("kp_id")), F.col("l_partkey") == F.col("p_partkey"))
    return a.knowledge_rollup(rows.select("kp_id", F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("score"), F.col("m").alias("max_score"), "class_rate"))


@query("e02_rollup", f"select kp, round(score, 3) as score, round(weight, 3) as weight, round(mastery, 8) as mastery, round(class_rate, 8) as class_rate from {KPS}")
def e02(t):
    return points(t).select("kp", F.round("score", 3).alias("score"), F.round("weight", 3).alias("weight"), F.round("mastery", 8).alias("mastery"), F.round("class_rate", 8).alias("class_rate"))


@query("e04_levels", f"select kp, case when round(mastery, 6) >= 0.85 then 'solid' when round(mastery, 6) >= 0.6 then 'basic' else 'weak' end as level from {KPS}")
def e04(t):
    return points(t).select("kp", a.level(F.round("mastery", 6)).alias("level"))


@query("e07_priority", f"select kp, cast(row_number() over (order by round(mastery, 6), weight desc, kp) as integer) as n from {KPS} qualify n <= 5")
def e07(t):
    rows = points(t).withColumns({"mastery": F.round("mastery", 6), "gap": F.lit(0.0)}).orderBy(*a.by_priority()).limit(5)
    return rows.withColumn("n", F.row_number().over(Window.orderBy(*a.by_priority()))).select("kp", "n")  # five rows


@query("e08_strength", f"select kp, cast(row_number() over (order by round(mastery, 6) desc, weight desc, kp) as integer) as n from {KPS} qualify n <= 3")
def e08(t):
    rows = points(t).withColumn("mastery", F.round("mastery", 6)).orderBy(*a.by_strength()).limit(3)
    return rows.withColumn("n", F.row_number().over(Window.orderBy(*a.by_strength()))).select("kp", "n")  # three rows


@query("e09_freq_topn", "select 'flag ' || l_returnflag as label, count(*) as n from lineitem group by 1 order by n desc, label limit 3")
def e09(t):
    labels = t._spark.createDataFrame([(c, f"flag {c}") for c in "ARN"], "code string, label string")
    return a.top_errors(t.lineitem, "l_returnflag", labels)


@query("e10_tag_union", "select o_custkey, array_to_string((list_sort(list(distinct o_orderpriority)))[1:3], ';') as tags from orders group by 1")
def e10(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3), ";").alias("tags"))


TREE = "(select 'r' || r_regionkey as id, null as parent, 1 as level, r_regionkey as sort_order from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 2, n_nationkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 3, c_custkey from customer)"


def tree(t):
    node = lambda df, i, p, level: df.select(F.concat(F.lit(i[0]), F.col(i[1]).cast("string")).alias("id"), (F.concat(F.lit(p[0]), F.col(p[1]).cast("string")) if p else F.lit(None).cast("string")).alias("parent"), F.lit(level).alias("level"), F.col(i[1]).cast("long").alias("sort_order"))
    return node(t.region, ("r", "r_regionkey"), None, 1).union(node(t.nation, ("n", "n_nationkey"), ("r", "n_regionkey"), 2)).union(node(t.customer, ("c", "c_custkey"), ("n", "c_nationkey"), 3))


@query("i02_validate", f"""with t as (select id, case when id like 'c%7' then 'none' else parent end as parent, case when id like 'n1%' then 3 else level end as level from {TREE})
select c.id, 'missing_parent' as issue from t c left join t p on p.id = c.parent where c.parent is not null and p.id is null
union select c.id, 'wrong_level' from t c left join t p on p.id = c.parent where (c.parent is null or p.id is not null) and c.level <> coalesce(p.level, 0) + 1""")
def i02(t):
    """The tree with some parents and levels broken."""
    rows = tree(t)
    broken = {"parent": F.when(F.col("id").rlike("^c.*7$"), "none").otherwise(F.col("parent")), "level": F.when(F.col("id").startswith("n1"), 3).otherwise(F.col("level"))}
    return hierarchy.problems(rows.withColumns(broken))


#: A registry with a broken node here and there: what is broken goes by the node's number.
NODES = """(select n, up, title, lvl, n % 1000 + 1 as sort_order from (
select 1 + r_regionkey as n, null as up, r_name as title, 1 as lvl from region
union all select 100 + n_nationkey, 1 + n_regionkey, n_name, 2 from nation union all select 1000 + c_custkey, 100 + c_nationkey, c_name, 3 from customer))"""
REGISTRY = f"""whole as (select a.*, coalesce(g.title || '/', '') || coalesce(p.title || '/', '') || a.title as path from {NODES} a left join {NODES} p on p.n = a.up left join {NODES} g on g.n = p.up),
t as (select case when n % 97 = 0 then 'x' || cast(n as varchar) when n % 89 = 0 and n > 1000 then printf('kp_%06d', n + 1) else printf('kp_%06d', n) end as id,
printf('kp_%06d', case when n % 83 = 0 then 900000 + n when n > 1100 and n % 202 = 0 then n + 1 when n > 1100 and n % 202 = 1 then n - 1 else up end) as parent,
case when n % 79 = 0 then 'a/b' when n % 73 = 0 then '  ' else title end as title, case when n % 71 = 0 then lvl + 1 else lvl end as level,
case when n % 67 = 0 then 0 else sort_order end as sort_order, case when n % 61 = 0 then 'lost' else path end as path, n % 59 <> 0 as listed,
case when n % 53 = 0 then 'gone' when n % 47 = 0 then 'deprecated' else 'active' end as status,
case when n % 94 = 0 then [printf('kp_%06d', n), 'kp_000001'] when n % 43 = 0 then ['kp_999999'] else [] end as replacements from whole)"""


@query("i02_registry", f"""with recursive {REGISTRY}, k as (select id, list(distinct level) as levels, list(distinct path) as paths, count(*) as c, min(parent) as up from t group by id),
ended(id) as (select id from k where up is null or up not in (select id from k) union select k.id from k join ended on k.up = ended.id),
u as (select t.*, k.id as known, k.levels, k.paths from t left join k on k.id = t.parent where t.parent is not null)
select distinct id, issue from (select id, 'invalid_id' as issue from t where not regexp_matches(id, '^kp_[0-9]{{6}}$')
union all select id, 'invalid_title' from t where trim(title) = '' or contains(title, '/') union all select id, 'invalid_level' from t where level not in (1, 2, 3)
union all select id, 'invalid_sort_order' from t where sort_order < 1 union all select id, 'no_list' from t where not listed union all select id, 'invalid_status' from t where status = 'gone'
union all select id, 'deprecated_without_replacement' from t where status = 'deprecated' and len(replacements) = 0
union all select id, 'root_mismatch' from t where parent is null and not (level = 1 and path = title)
union all select id, 'self_replacement' from t where list_contains(replacements, id) union all select id, 'duplicate_id' from k where c > 1
union all select id, 'duplicate_active_path' from t where status = 'active' and path in (select path from t where status = 'active' group by path having count(*) > 1)
union all select id, 'missing_parent' from u where known is null union all select id, 'wrong_level' from u where known is not null and not list_contains(levels, level - 1)
union all select id, 'path_mismatch' from u where known is not null and not list_contains(list_transform(paths, lambda p: p || '/' || title), path)
union all select id, 'unknown_replacement' from (select id, unnest(replacements) as x from t) where x not in (select id from k)
union all select id, 'cycle' from k where id not in (select id from ended)
union all select null, 'next_id' where (select max(cast(nullif(regexp_extract(id, '_([0-9]+)$', 1), '') as bigint)) from t) >= 1500)""")
def i02_registry(t):
    rows = t.region.select((F.lit(1) + F.col("r_regionkey")).alias("n"), F.lit(None).cast("int").alias("up"), F.col("r_name").alias("title"), F.lit(1).alias("lvl"))
    rows = rows.union(t.nation.select(F.lit(100) + F.col("n_nationkey"), F.lit(1) + F.col("n_regionkey"), "n_name", F.lit(2))).union(t.customer.select(F.lit(1000) + F.col("c_custkey"), F.lit(100) + F.col("c_nationkey"), "c_name", F.lit(3)))
    p, g = rows.select(F.col("n").alias("up"), F.col("up").alias("upper"), F.col("title").alias("_p")), rows.select(F.col("n").alias("upper"), F.col("title").alias("_g"))
    whole = rows.join(p, "up", "left").join(g, "upper", "left").withColumn("path", F.concat_ws("/", "_g", "_p", "title"))
    n, by = F.col("n"), lambda m, k=0: F.col("n") % m == k
    name = lambda c: F.format_string("kp_%06d", c.cast("long"))
    parent = F.when(by(83), n + 900000).when((n > 1100) & by(202), n + 1).when((n > 1100) & by(202, 1), n - 1).otherwise(F.col("up"))
    nodes = whole.select(
        F.when(by(97), F.concat(F.lit("x"), n.cast("string"))).when(by(89) & (n > 1000), name(n + 1)).otherwise(name(n)).alias("id"), F.when(parent.isNotNull(), name(parent)).alias("parent"),
        F.when(by(79), "a/b").when(by(73), "  ").otherwise(F.col("title")).alias("title"), F.when(by(71), F.col("lvl") + 1).otherwise(F.col("lvl")).alias("level"), F.when(by(67), 0).otherwise(n % 1000 + 1).alias("sort_order"),
        F.when(by(61), "lost").otherwise(F.col("path")).alias("path"), F.when(~by(59), F.array().cast("array<string>")).alias("aliases"), F.when(by(53), "gone").when(by(47), "deprecated").otherwise("active").alias("status"),
        F.when(by(94), F.array(name(n), F.lit("kp_000001"))).when(by(43), F.array(F.lit("kp_999999"))).otherwise(F.array().cast("array<string>")).alias("replacements"),
    )
    return taxonomy.problems(nodes, 1500)


@query("i04_preorder", f"""with recursive d as (select id, 0 as level, cast([] as struct(s bigint, i varchar)[]) as k from {TREE} where id = 'r1'
union all select t.id, d.level + 1, list_append(d.k, {{'s': cast(t.sort_order as bigint), 'i': t.id}}) from {TREE} t join d on t.parent = d.id)
select id, level, row_number() over (order by k) as position from d where level > 0""")
def i04_preorder(t):
    return taxonomy.preorder(tree(t), "r1")


@query("i03_children", f"select parent, array_to_string(list(id order by sort_order, id), ',') as children from {TREE} group by parent")
def i03(t):
    return hierarchy.children(tree(t)).select("parent", F.array_join("children", ",").alias("children"))


@query("i04_descendants", f"with recursive d as (select id, 0 as level, id as path from {TREE} where id = 'r1' union all select t.id, d.level + 1, d.path || '/' || t.id from {TREE} t join d on t.parent = d.id) select id, level, path from d")
def i04(t):
    return hierarchy.descendants(tree(t), "r1").select("id", "level", F.array_join("path", "/").alias("path"))


@query("i07_levels", f"select level, count(*) as n from {TREE} group by level")
def i07(t):
    return tree(t).groupBy("level").agg(F.count("*").alias("n"))


@query("j01_ledger", "select count(*) = max(n_nationkey) + 1 as contiguous, count(distinct n_name) = count(*) as unique_ids, count(distinct n_nationkey) = count(*) as unique_ordinals from nation")
def j01(t):
    return queueing.ledger_ok(t.nation, "n_name", "n_nationkey")


@query("j02_dispatch", """with r as (select o_orderkey, o_orderstatus as status, o_orderpriority, case o_orderstatus when 'P' then 0 when 'O' then 1 end as p from orders where o_orderstatus in ('P', 'O')),
a as (select status, o_orderpriority from r order by p, o_orderkey limit 1) select o_orderkey, status, o_orderpriority from r join a using (status, o_orderpriority) order by p, o_orderkey limit 8""")
def j02(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return queueing.dispatched(rows, {"P": 0, "O": 1}, ["status", "o_orderpriority"], "o_orderkey", 8).select("o_orderkey", "status", "o_orderpriority")


@query("j05_histogram", "select o_orderstatus, count(*) as n from orders group by 1")
def j05(t):
    return queueing.histogram(t.orders, "o_orderstatus")


@query("j07_natural_sort", "select p_partkey, array_to_string(list_transform(regexp_extract_all(p_brand || '-' || cast(p_size as varchar), '[0-9]+'), lambda x: cast(cast(x as bigint) as varchar)), '.') as key from part")
def j07(t):
    return t.part.select("p_partkey", F.array_join(tx.natural_key(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))), ".").alias("key"))


@query("j13_cube", "select o_orderstatus, o_orderpriority, count(*) as n, bool_and(o_totalprice > 0) as all_valid from orders group by cube (o_orderstatus, o_orderpriority)")
def j13(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.bool_and(F.col("o_totalprice") > 0).alias("all_valid"))


@query("j14_levenshtein", "select item_id, round(levenshtein(x, y) / greatest(length(x), 1), 6) as cer from (select item_id, regexp_replace(text, '[^ -~]', '', 'g') as x, regexp_replace(lead(text, 1, text) over (order by item_id), '[^ -~]', '', 'g') as y from benchmark)")
def j14(t):
    """Each whole text against that of the next item."""
    x = t.benchmark.select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("x"))  # the oracle's distance counts bytes
    ids = x.select("item_id", F.coalesce(F.lead("item_id").over(Window.orderBy("item_id")), F.col("item_id")).alias("next"))  # a stated list of items
    pairs = x.join(ids, "item_id").join(x.select(F.col("item_id").alias("next"), F.col("x").alias("y")), "next")
    return pairs.select("item_id", F.round(queueing.error_rate(F.col("x"), F.col("y")), 6).alias("cer"))


@query("j14_nfkc")
def j14_nfkc(t):
    """Each benchmark text as a reader with other letter widths and line breaks would give it; no SQL here knows the form."""
    wide = F.translate(F.col("text"), "abcdefgh0123456789 ", "ａｂｃｄｅｆｇｈ０１２３４５６７８９　")
    worse = F.when(F.col("item_id") % 3 == 0, F.regexp_replace(wide, "[eé]", "o")).otherwise(wide)
    return queueing.compared(t.benchmark.select("item_id", "text", worse.alias("read")), "text", "read").select("item_id", "exact", "distance", "rate")

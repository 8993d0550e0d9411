"""A registry of knowledge points as a table: nodes (id, parent, title, level, sort_order, path, aliases, status, replacements)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered, saved

#: The form of an id, the levels there are, the states of a node.
ID, LEVELS, STATES = r"^kp_[0-9]{6}$", (1, 2, 3), ("active", "deprecated")


def endless(nodes: DataFrame) -> DataFrame:
    """(id) of nodes (id, parent) whose chain of parents never ends: those of a cycle, and all below one. Each turn looks twice as
    far up, and nodes whose chain has ended are left out, so a chain of n nodes takes log n turns."""
    up = nodes.where("id is not null").groupBy("id").agg(F.min("parent").alias("up")).where("up is not null")
    at = saved(up, "up")
    most, reach = at.count(), 1
    while reach <= most:
        beyond = at.select(F.col("id").alias("up"), F.col("up").alias("beyond"))
        at = saved(at.join(beyond, "up").select("id", F.col("beyond").alias("up")), "up")
        reach *= 2
        if at.isEmpty():
            break
    return at.select("id")


def problems(nodes: DataFrame, next_id: int | None = None, version: int | None = None) -> DataFrame:
    """(id, issue): each rule that a registry breaks, once for each id. Issues of the registry as a whole have a null id.

    A null counts as blank, as no list, or as no such value. A node without parent is a root. Of ids that are there twice both
    rows are judged by the other rules, against any row of the parent's id."""
    n = nodes.select("id", "parent", "title", F.col("level").cast("long").alias("level"), F.col("sort_order").cast("long").alias("sort_order"), "path", "aliases", "status", "replacements")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own: dict[str, Column] = {
        "invalid_id": ~F.coalesce(F.col("id").rlike(ID), F.lit(False)),
        "invalid_title": blank("title") | F.contains("title", F.lit("/")),
        "invalid_level": ~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)),
        "invalid_sort_order": F.coalesce("sort_order", F.lit(0)) < 1,
        "no_list": F.col("aliases").isNull() | F.col("replacements").isNull(),
        "invalid_status": ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)),
        "deprecated_without_replacement": (F.col("status") == "deprecated") & (F.coalesce(F.size("replacements"), F.lit(0)) < 1),
        "root_mismatch": F.col("parent").isNull() & ~((F.col("level") == 1) & F.col("path").eqNullSafe(F.col("title"))),
        "self_replacement": F.coalesce(F.array_contains("replacements", F.col("id")), F.lit(False)),
    }
    found = n.select("id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in own.items())))).alias("issue"))
    told = n.groupBy(F.col("id").alias("_pid")).agg(F.count("*").alias("_n"), F.collect_set("level").alias("_levels"), F.collect_set("path").alias("_paths"))
    told = told.where("_pid is not null")
    twice = told.where("_n > 1").select(F.col("_pid").alias("id"), F.lit("duplicate_id").alias("issue"))
    paths = n.where("status = 'active' and path is not null").groupBy("path").agg(F.count("*").alias("_n")).where("_n > 1").select("path")
    paths = n.where("status = 'active'").join(paths, "path", "left_semi").select("id", F.lit("duplicate_active_path").alias("issue"))
    under = n.where("parent is not null").join(told, F.col("parent") == F.col("_pid"), "left")
    known = F.col("_pid").isNotNull()
    level = known & ~F.coalesce(F.array_contains("_levels", F.col("level") - 1), F.lit(False))
    path = known & ~F.coalesce(F.array_contains(F.transform("_paths", lambda p: F.concat(p, F.lit("/"), F.col("title"))), F.col("path")), F.lit(False))
    below = under.select("id", F.explode(F.array_compact(F.array(F.when(~known, F.lit("missing_parent")), F.when(level, F.lit("wrong_level")), F.when(path, F.lit("path_mismatch"))))).alias("issue"))
    named = n.select("id", F.explode("replacements").alias("_pid")).join(told.select("_pid"), "_pid", "left_anti").select("id", F.lit("unknown_replacement").alias("issue"))
    out = found.union(twice).union(paths).union(below).union(named).union(endless(n).select("id", F.lit("cycle").alias("issue"))).distinct()
    whole = n.agg(F.count("*").alias("n"), F.max(F.regexp_extract("id", r"_(\d+)$", 1).try_cast("long")).alias("highest"))
    rules = {"no_nodes": F.col("n") == 0, "version": F.lit(version is not None and version != 1)}
    if next_id is not None:
        rules["next_id"] = F.coalesce("highest", F.lit(0)) >= next_id
    registry = whole.select(F.lit(None).cast("string").alias("id"), F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("issue"))
    return out.union(registry)


def below(nodes: DataFrame, root: str) -> DataFrame:
    """(id, level, path, keys) below and with root, each level written once: path as ids, keys as (sort_order, id). A node that is
    its own ancestor ends its branch. nodes(id, parent, sort_order)."""
    rows = nodes.select("id", "parent", F.col("sort_order").cast("long").alias("sort_order"))
    own = F.struct(F.col("sort_order"), F.col("id"))
    at = saved(rows.where(F.col("id") == root).select("id").distinct().select("id", F.lit(0).alias("level"), F.array("id").alias("path"), F.array().cast("array<struct<sort_order:bigint,id:string>>").alias("keys")), "level")
    levels = [at]
    while not levels[-1].isEmpty():
        upper = levels[-1].select(F.col("id").alias("parent"), F.col("level").alias("_l"), F.col("path").alias("_p"), F.col("keys").alias("_k"))
        lower = rows.join(upper, "parent").where(~F.array_contains("_p", F.col("id")))
        levels.append(saved(lower.select("id", (F.col("_l") + 1).alias("level"), F.concat("_p", F.array("id")).alias("path"), F.concat("_k", F.array(own)).alias("keys")), "level"))
    out = levels[0]
    for level in levels[1:-1]:
        out = out.union(level)
    return out


def preorder(nodes: DataFrame, root: str) -> DataFrame:
    """(id, level, position): the nodes below root as a walk meets them, children by (sort_order, id). Parents sort before what
    they are a prefix of, so the walk is the order of keys, and positions are numbers over it. Roots are not among them."""
    rows = below(nodes, root).where("level > 0")
    return numbered(rows.select("id", "level", "keys"), "keys", name="position").select("id", "level", "position")

"""Trees as tables (id, parent, title, sort_order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import running, saved
from .taxonomy import below


def descendants(nodes: DataFrame, root: str) -> DataFrame:
    """(id, level, path) below and with root; a node that is its own ancestor ends its branch."""
    order = F.col("sort_order") if "sort_order" in nodes.columns else F.lit(0)
    return below(nodes.select("id", "parent", order.alias("sort_order")), root).drop("keys")


def children(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "id"))), lambda x: x["id"]).alias("children"))


def problems(nodes: DataFrame) -> DataFrame:
    """(id, issue): repeated ids, missing parents, wrong levels."""
    p = nodes.select(F.col("id").alias("_pid"), F.col("level").alias("_pl")).distinct()
    joined = nodes.join(p, F.col("parent") == F.col("_pid"), "left")
    lost = joined.where(F.col("parent").isNotNull() & F.col("_pid").isNull()).select("id", F.lit("missing_parent").alias("issue"))
    wrong = joined.where(F.col("level") != F.coalesce(F.col("_pl"), F.lit(0)) + 1).where(F.col("parent").isNull() | F.col("_pid").isNotNull()).select("id", F.lit("wrong_level").alias("issue"))
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("issue"))
    return lost.union(wrong).union(twice).distinct()


def tags_ok(tags):
    """At most 16 tags, distinct and of 2 to 32 characters when trimmed, none like a path or an id."""
    t = F.transform(tags, lambda x: F.trim(x))
    return (F.size(t) <= 16) & (F.size(F.array_distinct(t)) == F.size(t)) & F.forall(t, lambda x: F.length(x).between(2, 32) & ~x.rlike(r"(?i)/|\\|^kp_[0-9]+$"))


def retarget(text, old: str, new: str):
    return F.regexp_replace(text, r"\[\[\Q" + old + r"\E(?=[\]|#])", "[[" + new)


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, gaps) of indented bullets: lines (doc, pos, line), two blanks a level. A node's parent is the last bullet one level
    up, if none less deep lies between; ids count the bullets of a document, sort_order those of a parent. The last bullet of each
    level is carried along the lines by ranges, so an outline may be as long as the table."""
    depth = F.length(F.regexp_extract("line", r"^( *)-\s+\S", 1))
    rows = lines.where(F.col("line").rlike(r"^ *-\s+\S")).where(depth % 2 == 0)
    rows = rows.select("doc", "pos", (depth / 2 + 1).cast("int").alias("level"), F.trim(F.regexp_extract("line", r"^ *-\s+(.+?)\s*$", 1)).alias("title"), F.lit(1).alias("_one"))
    rows = saved(running(rows, "doc", ["pos"], {"n": (F.sum, "_one")}).drop("_one"), "bullets")
    deepest = rows.agg(F.max("level")).first()[0] or 1
    marks = {f"_l{k}": F.when(F.col("level") == k, F.col("n")) for k in range(1, deepest)}
    rows = running(rows.withColumns({f"_m{k}": c for k, c in marks.items()}), "doc", ["n"], {k: (F.max, f"_m{k}") for k in marks}) if marks else rows
    last = F.array(*(F.coalesce(k, F.lit(0)) for k in marks)) if marks else F.array(F.lit(0).cast("long"))
    upper, above = F.try_element_at(last, F.col("level") - 1), F.array_max(F.slice(last, 1, F.greatest(F.col("level") - 2, F.lit(0))))
    up = F.when((F.col("level") > 1) & (upper > F.coalesce(above, F.lit(0))), F.nullif(upper, F.lit(0)))
    rows = rows.select("doc", "pos", "level", "title", F.col("n").cast("int").alias("n"), up.cast("int").alias("up"))
    name = lambda c: F.when(c.isNotNull(), F.format_string("kp_%06d", c))
    order = F.row_number().over(Window.partitionBy("doc", "up").orderBy("pos"))
    nodes = rows.select("doc", name(F.col("n")).alias("id"), name(F.col("up")).alias("parent"), "level", "title", order.cast("int").alias("sort_order"))
    return nodes.where("level = 1 or parent is not null"), nodes.where("level > 1 and parent is null").select("doc", "id", "title")


def refreshed(nodes: DataFrame, root: str) -> DataFrame:
    """nodes (id, parent, title, level, path, aliases, ..) with new levels and paths below root; a path that changed becomes an
    alias."""
    upper = nodes.alias("n").join(nodes.alias("p"), F.col("n.parent") == F.col("p.id"), "left").where(F.col("n.id") == root)
    top = upper.select(F.coalesce(F.col("p.level") + 1, F.lit(1)).alias("_base"), F.when(F.col("p.path").isNotNull(), F.concat("p.path", F.lit("/"))).otherwise("").alias("_prefix"))
    below = descendants(nodes.select("id", "parent"), root)
    steps = below.select("id", "level", F.posexplode("path").alias("_at", "_step")).join(nodes.select(F.col("id").alias("_step"), F.col("title").alias("_title")), "_step")
    titles = steps.groupBy("id", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_title"))), lambda x: x["_title"]), "/").alias("_path"))
    new = titles.crossJoin(top).select("id", (F.col("_base") + F.col("level")).cast("int").alias("_level"), F.concat("_prefix", "_path").alias("_path"))  # top is one row
    rows = nodes.join(new, "id", "left")
    moved = F.col("_path").isNotNull() & (F.col("_path") != F.col("path"))
    changed = {"aliases": F.when(moved, F.array_union("aliases", F.array("path"))).otherwise(F.col("aliases")), "path": F.coalesce("_path", "path"), "level": F.coalesce("_level", "level")}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in nodes.columns))


MOST_LEVELS = 3


def changed(nodes: DataFrame, change: dict) -> DataFrame:
    """nodes (id, parent, title, level, sort_order, path, aliases, status, replacements) after one reviewed change: add, rename,
    move, deprecate, merge, reorder, assign or delete. ValueError if it breaks a rule. Ids are never deleted."""
    action, key = change.get("action"), change.get("id")
    columns = nodes.columns
    one = lambda i: nodes.where(F.col("id") == i).first() if i else None
    title = str(change.get("title") or "").strip()

    def last(parent) -> int:
        found = nodes.where(F.col("parent").eqNullSafe(F.lit(parent))).agg(F.max("sort_order")).first()[0]
        return int(change.get("sort_order") or (found or 0) + 1)

    def with_values(values: dict[str, Column]) -> DataFrame:
        return nodes.select(*(F.when(F.col("id") == key, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns))

    if action == "assign":
        return nodes
    if action == "delete":
        raise ValueError("ids are never deleted; deprecate with replacements")
    if action in ("add", "rename") and (not title or "/" in title):
        raise ValueError(f"{action} needs a title without slash")
    if action == "add":
        parent = one(change.get("parent"))
        if change.get("parent") and parent is None:
            raise ValueError(f"unknown parent {change['parent']}")
        level = parent["level"] + 1 if parent else 1
        if level > MOST_LEVELS:
            raise ValueError("too deep")
        if not nodes.where(F.col("parent").eqNullSafe(F.lit(change.get("parent"))) & (F.col("title") == title) & (F.col("status") == "active")).isEmpty():
            raise ValueError("an active sibling has this title")
        number = (nodes.agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long"))).first()[0] or 0) + 1
        row = (f"kp_{number:06d}", change.get("parent"), title, level, last(change.get("parent")), f"{parent['path']}/{title}" if parent else title, [], "active", [])
        return nodes.unionByName(nodes.sparkSession.createDataFrame([row], "id string, parent string, title string, level int, sort_order int, path string, aliases array<string>, status string, replacements array<string>"))
    node = one(key)
    if node is None:
        raise ValueError(f"unknown id {key}")
    if action == "rename":
        return refreshed(with_values({"title": F.lit(title)}), key)
    if action == "reorder":
        return with_values({"sort_order": F.lit(int(change.get("sort_order", 0)))})
    below = descendants(nodes.select("id", "parent"), key)
    if action == "move":
        to = change.get("parent")
        if to and one(to) is None:
            raise ValueError(f"unknown parent {to}")
        if to and not below.where(F.col("id") == to).isEmpty():
            raise ValueError("a node cannot move below itself")
        out = refreshed(with_values({"parent": F.lit(to), "sort_order": F.lit(last(to))}), key)
        if not out.where(F.col("level") > MOST_LEVELS).isEmpty():
            raise ValueError("too deep")
        return out
    if action in ("deprecate", "merge"):
        to = change.get("replacements") or ([change["target"]] if change.get("target") else [])
        if not to:
            raise ValueError(f"{action} needs replacements")
        if not nodes.where("status = 'active'").join(below.where("level > 0"), "id", "left_semi").isEmpty():
            raise ValueError("active nodes lie below")
        return with_values({"status": F.lit("deprecated"), "replacements": F.array(*map(F.lit, to))})
    raise ValueError(f"unknown action {action}")


def unresolved_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets of new links (target) that are no page (id), each once."""
    return links.select(F.col("target").alias("id")).distinct().join(pages, "id", "left_anti")


def inbound(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select("src").distinct()


def with_managed_line(text: Column, marker: str, line: Column) -> Column:
    """The text with a line in the block that marker opens; as it was if the block has the line, with a new block if it has none."""
    begin, end = f"<!-- {marker}:begin -->", f"<!-- {marker}:end -->"
    has = F.contains(F.concat(F.lit("\n"), text, F.lit("\n")), F.concat(F.lit("\n"), line, F.lit("\n")))
    added = F.replace(text, F.lit(end), F.concat(line, F.lit(f"\n{end}")))
    fresh = F.concat(F.rtrim(text), F.lit(f"\n\n{begin}\n"), line, F.lit(f"\n{end}\n"))
    return F.when(has, text).when(text.contains(end), added).otherwise(fresh)


def guarded(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts) of changes (path, expected_sha256, ..) against current files (path, text): the hash must still hold,
    and be empty for a new file."""
    rows = changes.join(current.select("path", F.sha2("text", 256).alias("_now")), "path", "left")
    same = F.coalesce("expected_sha256", F.lit("")) == F.coalesce("_now", F.lit(""))
    return rows.where(same).drop("_now"), rows.where(~same).withColumnRenamed("_now", "found_sha256")

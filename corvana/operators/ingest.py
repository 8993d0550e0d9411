"""Wide-to-long reshaping, cleaning, upserts, integrity checks and privacy gates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .matching import hits

SCORE = re.compile(r"Q[0-9A-Za-z_]+_score")
#: Rows of a roster that may be broadcast (about 30 MB), rows of a task of those that meet it, and rows of a block of either.
BROADCAST, SPREAD, BLOCK, RUN = 500_000, 20_000, 1024, 128
#: Columns that a roster must not have.
FORBIDDEN_IDENTITY = frozenset("real_name name 姓名 school_number school_no 学号 exam_number exam_no 考号 student_status_number student_registry_number 学籍号 guardian_contact student_code".split())


def score_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if SCORE.fullmatch(c) and not c.endswith("_max_score")]


def item_results(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, item_key, score, max_score) of a wide sheet; all families unpivot in one pass."""
    items = [c[: -len("_score")] for c in score_columns(wide.columns)]
    entry = lambda i: F.struct(F.lit(i).alias("item_key"), t.number(F.col(f"{i}_score")).alias("score"), (t.number(F.col(f"{i}_max_score")) if f"{i}_max_score" in wide.columns else F.lit(None).cast("double")).alias("max_score"))
    return wide.select(*keys, F.inline(F.array(*map(entry, items))))


def observed_max(rows: DataFrame, item: str, score: str) -> DataFrame:
    return rows.groupBy(item).agg(F.coalesce(F.max(score), F.lit(1.0)).alias("max_score"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """By min_by, which sums up in each task before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """By max_by, which sums up in each task before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], keep_blank: bool = False) -> DataFrame:
    """New values over old ones, for some columns; with keep_blank an empty new value leaves the old one."""
    o, n = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in columns)), new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_new"))
    value = lambda c: F.coalesce(F.nullif(F.col(f"_n_{c}"), F.lit("")) if keep_blank else F.col(f"_n_{c}"), F.col(f"_o_{c}"))
    return o.join(n, key, "full").select(*key, *(value(c).alias(c) for c in columns))


def missing_parents(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents, rows[key] == parents[parent_key], "left_anti")


def require_parents(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    bad = missing_parents(rows, parents, key, parent_key).select(key).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unknown {key}: {', '.join(str(r[0]) for r in bad)}")
    return rows


def gate_identity(rows: DataFrame) -> DataFrame:
    found = sorted(FORBIDDEN_IDENTITY & {c.lower() for c in rows.columns})
    if found:
        raise ValueError(f"identity columns are not allowed: {', '.join(found)}")
    return rows


def rejects(rows: DataFrame, rules: dict) -> DataFrame:
    """Rows with the sorted codes of the rules they break; rules map codes to boolean columns."""
    return rows.withColumn("issues", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in sorted(rules.items()))))).where(F.size("issues") > 0)


def aligned(roster: DataFrame, scores: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, scores without a roster row, keys that the roster has twice)."""
    twice = roster.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return met_in_blocks(scores, roster, key), scores.join(roster, key, "left_anti"), twice


def met_in_blocks(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The inner join of rows with others, for keys that many of both share: blocks of a key's rows meet, and the pairs of blocks are
    dealt evenly by key, over tasks that grow with rows; pairs of rows are made in the task that returns them, each row with a whole
    block of others. So a columnar file holds a row once a block and the block once a page, not the values of every pair."""
    many, most = rows.count(), others.count()
    least = rows.sparkSession.sparkContext.defaultParallelism * 4
    own, theirs = in_blocks(rows, key, "_row", many, min(BLOCK, -(-many // least) or 1)), in_blocks(others, key, "_other", most, RUN)
    met = own.join(F.broadcast(theirs) if most <= BROADCAST else theirs, key).repartitionByRange(max(least, -(-many // SPREAD)), *key, "_row_at", "_other_at")
    pairs = met.select(F.explode("_row").alias("_row"), "_other").select("_row", F.explode("_other").alias("_other"))
    return pairs.select(*(F.col(f"_row.{c}") for c in [*key, *(c for c in rows.columns if c not in key)]), *(F.col(f"_other.{c}") for c in others.columns if c not in key))


def in_blocks(rows: DataFrame, key: list[str], name: str, many: int, size: int) -> DataFrame:
    """(key, name_at, name): rows of a key in arrays of at most `size`. `many` rows are dealt by key and the rest of the row, so a key of
    many rows has several tasks, and a task few keys, which are cut into few short arrays."""
    at = F.floor(F.monotonically_increasing_id() / size).alias(f"{name}_at")
    dealt = rows.repartitionByRange(-(-many // SPREAD) or 1, *key, F.xxhash64(*rows.columns)).sortWithinPartitions(*key)
    return dealt.select(*key, at, F.struct(*rows.columns).alias(name)).groupBy(*key, f"{name}_at").agg(F.collect_list(name).alias(name))


def forward_filled(cells: DataFrame, column: str, order: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return cells.withColumn(column, F.last(F.nullif(F.trim(column), F.lit("")), ignorenulls=True).over(w))


def leaks(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(path, term): the longest term found in each file."""
    hit = hits(files, "path", "text", terms)
    return hit.groupBy("path").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))

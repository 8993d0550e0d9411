"""Mastery tables and the reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analytics

#: Words of an item's points and of its knowledge point, and the kind of task they stand for, in order.
TASKS: list[tuple[tuple[str, ...], tuple[str, ...], str]] = [
    (("图像",), ("图像",), "图像识别与物理量关系判断"),
    (("输电", "线损"), ("变压器",), "变压器与远距离输电的链式计算"),
    (("等温",), ("气体", "状态方程"), "气体状态方程与图像/实验情境"),
    (("导体", "金属棒"), ("电磁感应", "法拉第"), "电磁感应过程分析与综合计算"),
    (("圆心角", "轨迹"), ("带电粒子",), "带电粒子轨迹几何与分段运动"),
    ((), ("磁场",), "磁场方向、轨迹与基本模型判断"),
    ((), ("分子",), "分子力图像与势能变化判断"),
]
OTHER_TASK = "同知识点基础题到中档题"
WEAK_UNDER = 0.60
CORRECT_FROM, CONCEPT_UNDER = 0.8, 0.6


def task_kind(points: Column, knowledge_point: Column) -> Column:
    """The first kind one of whose words is in the item's points (an array) or in its knowledge point."""
    text, kp = F.array_join(F.coalesce(points, F.array().cast("array<string>")), "；"), F.coalesce(knowledge_point, F.lit(""))
    out = None
    for in_points, in_kp, kind in TASKS:
        hit = F.lit(False)
        for where, words in ((text, in_points), (kp, in_kp)):
            for w in words:
                hit = hit | where.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(OTHER_TASK)


def by_mastery() -> list[Column]:
    return [F.col("mastery").asc_nulls_last(), F.col("kp").asc()]


def demo_flags(rate: Column) -> tuple[Column, Column]:
    """(is correct, error type) of a score rate, as the demonstration data have them."""
    return (rate >= CORRECT_FROM).cast("int"), F.when(rate < CONCEPT_UNDER, "concept")


def mastery(facts: DataFrame) -> DataFrame:
    """(class_id, student_id, kp, weight, mastery, level) from facts (class_id, student_id, kp, score, max_score)."""
    usable = F.col("score").isNotNull() & (F.col("max_score") > 0)
    rows = facts.groupBy("class_id", "student_id", "kp").agg(F.sum(F.when(usable, F.col("max_score"))).alias("weight"), F.sum(F.when(usable, F.col("score"))).alias("score"))
    rate = F.col("score") / F.col("weight")
    return rows.select("class_id", "student_id", "kp", F.coalesce("weight", F.lit(0.0)).alias("weight"), rate.alias("mastery"), analytics.level(rate).alias("level"))


def class_summary(students: DataFrame) -> DataFrame:
    """(class_id, kp, n_students, avg_mastery, weak_students) from `mastery`; weak is under `WEAK_UNDER`."""
    return students.groupBy("class_id", "kp").agg(
        F.count("mastery").alias("n_students"), F.avg("mastery").alias("avg_mastery"), F.count_if(F.col("mastery") < WEAK_UNDER).alias("weak_students")
    )


def table_lines(rows: DataFrame, columns: list[str], by: list[str], order: list[Column]) -> DataFrame:
    """(by.., body): a Markdown table of each group's rows, in order. A group is one report, of one class or person."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"[|\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    from pyspark.sql import Window

    ranked = rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_n"), line.alias("_line"))
    return ranked.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")).alias("body"))


def weekly(summary: DataFrame) -> DataFrame:
    """(class_id, report): Markdown of a class's knowledge points, weakest first."""
    shown = summary.select("class_id", "kp", analytics.percent(F.col("avg_mastery")).alias("average"), "weak_students", F.col("avg_mastery"))
    body = table_lines(shown, ["kp", "average", "weak_students"], ["class_id"], [F.col("avg_mastery").asc_nulls_last(), F.col("kp")])
    return body.select("class_id", F.concat(F.lit("# Weekly report: "), "class_id", F.lit("\n\n"), "body", F.lit("\n")).alias("report"))


def mastery_reports(students: DataFrame) -> DataFrame:
    """(student_id, report): Markdown of a person's knowledge points, weakest first, with levels."""
    shown = students.select("student_id", "kp", analytics.percent(F.col("mastery")).alias("rate"), "level", "mastery")
    body = table_lines(shown, ["kp", "rate", "level"], ["student_id"], [F.col("mastery").asc_nulls_last(), F.col("kp")])
    return body.select("student_id", F.concat(F.lit("# Mastery: "), "student_id", F.lit("\n\n"), "body", F.lit("\n")).alias("report"))


def write_reports(reports: DataFrame, key: str, path: str) -> None:
    """One text file a report, below a folder for each key, written by the executors."""
    reports.select(key, F.col("report").alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)

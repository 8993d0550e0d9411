"""Relational views and the safe query surface; mastery rollups and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small

#: Columns that no query shows.
FORBIDDEN = ("real_name", "school_number", "guardian_contact", "notes", "teacher_note", "teacher_comment", "class_rank", "grade_rank", "score_band")
LIMITS = (1, 500)
MASTERY = ((0.85, "solid"), (0.60, "basic"))


def status_rollup(tasks: DataFrame, submissions: DataFrame, key: str, status: str, rate: str) -> DataFrame:
    """Per task: counts by status and mean rate. A task without submissions has zeros, from its null-extended row."""
    joined = tasks.join(submissions, key, "left")
    count = lambda s: F.sum(F.when(F.col(status) == s, 1).otherwise(0)).alias(f"n_{s.lower()}")
    return joined.groupBy(key).agg(F.count(status).alias("n"), count("F"), count("O"), count("P"), F.round(F.avg(F.coalesce(rate, F.lit(0.0))), 3).alias("avg_rate"))


def profile(people: DataFrame, results: DataFrame, submissions: DataFrame, key: str) -> DataFrame:
    """Each fact is summed per person before the join, so nothing fans out."""
    r = results.groupBy(key).agg(F.countDistinct("result_id").alias("n_results"), F.avg("score").alias("avg_score"))
    s = submissions.groupBy(key).agg(F.countDistinct("submission_id").alias("n_submissions"), F.avg(F.coalesce("completion", F.lit(0.0))).alias("avg_completion"))
    joined = people.join(r, key, "left").join(s, key, "left")
    return joined.select(key, F.coalesce("n_results", F.lit(0)).alias("n_results"), F.round("avg_score", 3).alias("avg_score"), F.coalesce("n_submissions", F.lit(0)).alias("n_submissions"), F.round(F.coalesce("avg_completion", F.lit(0.0)), 3).alias("avg_completion"))


def profile_literal(people: DataFrame, results: DataFrame, submissions: DataFrame, key: str) -> DataFrame:
    """The same by one wide join, with distinct counts against the fan-out. Kept to test `profile` against."""
    joined = people.join(results, key, "left").join(submissions, key, "left")
    return joined.groupBy(key).agg(F.countDistinct("result_id").alias("n_results"), F.round(F.avg("score"), 3).alias("avg_score"), F.countDistinct("submission_id").alias("n_submissions"), F.round(F.avg(F.coalesce("completion", F.lit(0.0))), 3).alias("avg_completion"))


def safe_query(views: dict[str, DataFrame], alias: str, order: list[str], limit: int = 50, **equal) -> DataFrame:
    """An allowed view without its forbidden columns, filtered by equality, in key order, with a clamped limit."""
    if alias not in views:
        raise ValueError(f"{alias} is not an allowed view")
    rows = views[alias].drop(*FORBIDDEN)
    for column, value in equal.items():
        if value is not None:
            if column not in rows.columns:
                raise ValueError(f"{alias} has no {column}")
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order).limit(max(LIMITS[0], min(limit, LIMITS[1])))


def audit_row(spark, actor: str, action: str, target: str, rows: int) -> DataFrame:
    return spark.range(1).select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(target).alias("target"), F.lit(rows).alias("row_count"), F.current_timestamp().alias("at"))


def with_class_average(items: DataFrame, item: str, score: str, most: str) -> DataFrame:
    """Each row with the mean rate of its item over all rows: summed in each task before the shuffle, then joined. A null item is
    an item too."""
    rate = F.when(F.col(score).isNotNull() & (F.col(most) > 0), F.col(score) / F.col(most))
    means = items.groupBy(F.col(item).alias("_item")).agg(F.avg(rate).alias("class_rate"))
    return items.join(means, items[item].eqNullSafe(means._item), "left").drop("_item")


def knowledge_rollup(items: DataFrame) -> DataFrame:
    """Rows (kp_id, item_id, score, max_score, class_rate) by knowledge point; unmapped items stand alone."""
    kp = F.coalesce("kp_id", F.concat(F.lit("unmapped:"), F.col("item_id").cast("string")))
    usable = F.col("class_rate").isNotNull() & (F.col("max_score") > 0)
    return (
        items.groupBy(kp.alias("kp"))
        .agg(
            F.sum(F.coalesce("score", F.lit(0.0))).alias("score"),
            F.sum(F.coalesce("max_score", F.lit(0.0))).alias("weight"),
            (F.sum(F.when(usable, F.col("class_rate") * F.col("max_score"))) / F.nullif(F.sum(F.when(usable, F.col("max_score"))), F.lit(0.0))).alias("class_rate"),
        )
        .withColumn("mastery", F.col("score") / F.nullif(F.col("weight"), F.lit(0.0)))
        .withColumn("gap", F.col("mastery") - F.col("class_rate"))
    )


def level(mastery: Column) -> Column:
    return F.when(mastery.isNull(), "insufficient").when(mastery >= MASTERY[0][0], MASTERY[0][1]).when(mastery >= MASTERY[1][0], MASTERY[1][1]).otherwise("weak")


def headline(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").when(rate >= 0.75, "strong").when(rate >= 0.55, "steady").when(rate >= 0.35, "fragile").otherwise("critical")


def gap_band(gap: Column) -> Column:
    return F.when(gap.isNull(), "unknown").when(gap >= 0.08, "above").when(gap <= -0.08, "below").otherwise("level")


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string("%.1f%%", x * 100))


def signed_percent(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.1f%%", x * 100)))


def gap_text(gap: Column) -> Column:
    """The gap to the class in words (fixed values)."""
    shown = signed_percent(gap)
    near = F.concat(F.lit("接近班均（"), shown, F.lit("）"))
    return F.when(gap.isNull(), "暂无班级对照").when(gap >= 0.08, F.concat(F.lit("高于班均 "), shown)).when(gap <= -0.08, F.concat(F.lit("低于班均 "), shown)).otherwise(near)


def by_priority() -> list[Column]:
    return [F.col("mastery").isNull().asc(), F.col("mastery").asc(), F.coalesce("gap", F.lit(0.0)).asc(), F.col("weight").desc(), F.col("kp").asc()]


def by_strength() -> list[Column]:
    return [F.col("mastery").isNull().asc(), F.col("mastery").desc(), F.col("weight").desc(), F.col("kp").asc()]


def exam_profile(rows: DataFrame) -> DataFrame:
    """Overall and class mean, both over the student-side weight; without weights items count one each."""
    weight = F.sum(F.when(F.col("mastery").isNotNull(), F.col("weight")))
    base = F.coalesce(F.nullif(weight, F.lit(0.0)), F.nullif(F.count("*").cast("double"), F.lit(0.0)), F.lit(1.0))
    return rows.agg((F.sum(F.col("mastery") * F.col("weight")) / base).alias("overall"), (F.sum(F.col("class_rate") * F.col("weight")) / base).alias("class_mean"))


def top_errors(rows: DataFrame, column: str, labels: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent labels of codes; ties by label. labels is a small code table."""
    named = rows.where(F.coalesce(column, F.lit("")) != "").join(small(labels), F.col(column) == labels.code, "left")
    return named.groupBy(F.coalesce("label", F.col(column)).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)

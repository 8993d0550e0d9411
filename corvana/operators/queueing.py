"""Batch queues: checks, dispatch, transitions, rollups, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact
from .sizes import small


def ledger_ok(items: DataFrame, key: str, ordinal: str) -> DataFrame:
    return items.agg((F.count("*") == F.max(ordinal) + 1).alias("contiguous"), (F.countDistinct(key) == F.count("*")).alias("unique_ids"), (F.countDistinct(ordinal) == F.count("*")).alias("unique_ordinals"))


def dispatched(items: DataFrame, priority: dict[str, int], group: list[str], ordinal: str, n: int) -> DataFrame:
    """The first n items of the group which the most urgent item belongs to."""
    rank = F.coalesce(*(F.when(F.col("status") == k, v) for k, v in priority.items()))
    ready = items.withColumn("priority", rank).where(F.col("priority").isNotNull())
    anchor = ready.orderBy("priority", ordinal).limit(1).select(*group)
    return ready.join(F.broadcast(anchor), group, "left_semi").orderBy("priority", ordinal).limit(n)


def advanced(items: DataFrame, events: DataFrame, transitions: DataFrame) -> DataFrame:
    """Items with the status that the transition table (status, event, next) gives their event; others stay."""
    joined = items.join(events, "id", "left").join(small(transitions), ["status", "event"], "left")
    return joined.select("id", F.coalesce("next", "status").alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def exhausted(attempts, status, most: int = 2):
    return F.when(attempts >= most, "blocked").otherwise(status)


def histogram(items: DataFrame, status: str) -> DataFrame:
    return items.groupBy(status).agg(F.count("*").alias("n"))


def compared(rows: DataFrame, expected: str, actual: str, form=compact) -> DataFrame:
    """rows with exact, distance and rate (four digits) of two texts in a form: without width variants and white space, or a formula's
    (`formula_form`). Whole texts are compared; a null counts as empty."""
    made = rows.withColumns({"_e": form(F.coalesce(F.col(expected), F.lit(""))), "_a": form(F.coalesce(F.col(actual), F.lit("")))})
    made = made.withColumn("distance", F.levenshtein("_e", "_a"))
    return made.select(*rows.columns, (F.col("_e") == F.col("_a")).alias("exact"), "distance", F.round(F.col("distance") / F.greatest(F.length("_e"), F.lit(1)), 4).alias("rate"))


def error_rate(expected, actual):
    """Edit distance over the length of what was expected."""
    return F.levenshtein(expected, actual) / F.greatest(F.length(expected), F.lit(1))

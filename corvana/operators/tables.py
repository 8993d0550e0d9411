"""Intermediate tables in the shared folder, and numbers over a whole order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own will do only where all run on one machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvana-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def saved(rows: DataFrame, label: str) -> DataFrame:
    """rows written once as Parquet and read back: plans stay short, and a lost executor costs its task alone."""
    path = f"{shared_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, key: str, many: int = 2000) -> DataFrame:
    """rows by the hash of their key, over tasks that grow with them, about `many` each: what follows by that key needs no other
    shuffle, and holds no more in a task when the table is larger."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // many)), key)


def numbered(rows: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """rows with their number (from 1) in the order: dealt by ranges, each range counts its own, and starts where those before it
    end. Only one row a range comes together. Rows that are equal in the order have any of their numbers."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = saved(dealt.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    ranges = dealt.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("_range", (F.col("_first") - before - 1).alias("_less"))
    return dealt.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_at") - F.col("_less")).alias(name))


def running(rows: DataFrame, key: str, order: list[str | Column], made: dict[str, tuple]) -> DataFrame:
    """rows with running aggregates (name: (sum, max or min, column)) of each key in the order, the row's own value included. Rows are
    dealt by ranges of key and order; what a key has in the ranges before comes by one row a key and range, so a key may be as
    large as the table. Nulls are passed over."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = saved(dealt.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    here = Window.partitionBy(key, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy(key, "_range").agg(*(f(c).alias(f"_run_{name}") for name, (f, c) in made.items()))
    whole = whole.select(key, "_range", *(f(f"_run_{name}").over(past).alias(f"_past_{name}") for name, (f, _) in made.items()))
    join = {F.sum: lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), F.max: F.greatest, F.min: F.least}
    local = dealt.select("*", *(f(c).over(here).alias(f"_run_{name}") for name, (f, c) in made.items()))
    both = [join[f](F.col(f"_run_{name}"), F.col(f"_past_{name}")).alias(name) for name, (f, _) in made.items()]
    return local.join(whole, [key, "_range"]).select(*rows.columns, *both)

"""Readers and writers: Markdown trees, delimited and JSON-lines files, file inventories, index artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, source_type, text) of the indexable Markdown files of five trees; text is the whole file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/*", "/")
    tree = F.regexp_extract(path, r"/(textbooks|standards|exercises|lectures|transcripts)/", 1)
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    rows = files.select(path.alias("path"), name.alias("name"), tree.alias("tree"), F.col("value").alias("text")).where("tree <> ''")
    kind = (
        F.when(F.col("tree") == "textbooks", "textbook")
        .when(F.col("tree") == "standards", "standard")
        .when(F.col("tree") == "exercises", "exercise")
        .when(F.col("tree") == "transcripts", "transcript")
        .when(F.col("name").contains("_设计"), "lesson_design")
        .otherwise("lecture")
    )
    return exercise_levels(rows.withColumn("source_type", kind).where((F.col("tree") != "transcripts") | F.col("name").endswith("_知识笔记.md"))).drop("tree")


def exercise_levels(rows: DataFrame) -> DataFrame:
    """Of a category with sub-folders (other than media) only files in those; of others the files directly below."""
    below = F.split(F.regexp_extract("path", r"/exercises/(.*)$", 1), "/")
    rows = rows.withColumns({"_main": F.when(F.col("tree") == "exercises", below[0]), "_depth": F.when(F.col("tree") == "exercises", F.size(below))})
    rows = rows.where(F.col("_depth").isNull() | ~F.array_contains(below, "media"))
    deep = rows.where("tree = 'exercises'").groupBy("_main").agg(F.max("_depth").alias("_deepest"))
    joined = rows.join(deep, "_main", "left")
    return joined.where(F.col("_depth").isNull() | (F.col("_depth") == F.least(F.col("_deepest"), F.lit(3)))).drop("_main", "_depth", "_deepest")


def csv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """All cells as strings; a byte-order mark before the first name goes. Missing columns and no rows are errors."""
    rows = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Some fields in a fixed order, with a byte-order mark before the first name of each file."""
    shown = rows.select(*(F.col(c).alias(f"\ufeff{c}" if k == 0 else c) for k, c in enumerate(fields)))
    shown.write.csv(path, header=True)


def last_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines; blank and broken lines go, the last complete record of each key stays."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("pos"))
    rows = lines.withColumn("r", F.from_json("value", schema)).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", F.struct("f", "pos")).alias("r")).select("r.*")


def inventory(spark: SparkSession, root: str, root_id: str) -> DataFrame:
    """(root_id, relative_path, bytes, modified, sha256) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + root.rstrip("/") + "/", "")
    return files.select(F.lit(root_id).alias("root_id"), relative.alias("relative_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def write_index(chunks: DataFrame, embeddings: DataFrame, postings: DataFrame, path: str) -> None:
    """The index as tables keyed by chunk id, the manifest last: it marks a whole index."""
    chunks.write.partitionBy("source_type").parquet(f"{path}/chunks")
    embeddings.write.parquet(f"{path}/embeddings")
    postings.write.parquet(f"{path}/postings")
    counts = chunks.agg(F.count("*").alias("total_chunks")).join(embeddings.agg(F.count("*").alias("total_vectors"), F.max(F.size("vec")).alias("dim")))
    counts.write.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = {k: spark.read.parquet(f"{path}/{k}") for k in ("chunks", "embeddings", "postings", "manifest")}
    row = found["manifest"].first()
    if row["total_chunks"] != found["chunks"].count() or row["total_vectors"] != row["total_chunks"]:
        raise ValueError(f"{path}: the manifest does not fit its tables")
    return found

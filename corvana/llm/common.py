"""Shared plumbing of the corpus operators: inputs, written intermediate tables, row keys, word codes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an Arrow batch to a Python worker, in rows and in bytes: 1,000 long texts would be too heavy for one.
ARROW_ROWS, ARROW_BYTES = 1000, "16m"
#: Keys that a lookup broadcasts at most: those with over 1 / HEAVY of all rows, of which there cannot be more.
HEAVY = 10_000
#: Words whose code a Python worker remembers before it starts afresh.
WORD_CACHE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the inputs. Python workers get batches bounded in rows and bytes from here on; the session keeps that."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all runs on one machine (local tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvana-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_path = path
    return found


def drop(*tables: DataFrame | None) -> None:
    """Delete saved tables that nothing reads any more."""
    for t in tables:
        if t is not None and (name := getattr(t, "saved_path", None)):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(rows: DataFrame, key: str, pairs: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined to pairs (key, values.., n), where n is about how many of the `total` rows have the key.

    Keys with over 1 / HEAVY of all rows are broadcast, at most HEAVY of them by that count; the others are joined by a
    shuffle in which none is hot."""
    hot = pairs.where(F.col("n") > max(total // HEAVY, 1000)).drop("n")
    light = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(pairs.drop("n"), key, how)
    return light.unionByName(rows.join(F.broadcast(hot), key).select(*light.columns))


def with_row_key(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """A key by which a row's parts meet again. Equal rows share it, which every user of the key allows for."""
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit(""))))


def text_key():
    """128 bits that stand for a whole text, whatever row it is in."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordCodes(dict):
    """Word to its 64-bit code; bounded by `settle`."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def settle(self) -> None:
        if len(self) > WORD_CACHE:
            self.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each run of `size` consecutive codes."""
    n = len(codes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(size):
            out = mixed(out + codes[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle codes; fewer words than `size` make one shingle of the whole sequence, no word none."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    if len(codes) < size:
        return windows(codes, len(codes)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    return np.unique(windows(codes, size))


def ascii_words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes outside space and \\t \\n \\v \\f \\r, with A-Z lower-cased."""
    return text.lower().split()

"""Packing of documents into sequences: shortest-pack-first over the length histogram.

A document's ids are cut into pieces of the sequence length and one remainder. The histogram of piece lengths (at most
`size` bins, over all pieces) is packed on the driver: lengths are placed longest first, each into the packs that are
shortest so far and still have room, and what is kept are packing patterns with counts, never single packs. Pieces then
find their pattern by rank within their length. Ranks come from counts by (length, bucket) and a row number within a
bucket, so a length that holds most pieces is still dealt over many tasks.

Defined results: null and empty text are the end id alone. Repeated rows are packed as often as they occur. Ties of rank
are broken by document and start, equal rows arbitrarily. An empty table packs into nothing. Texts are never cut but
between sequences, and no id is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path, word_encoder, words_of
from .common import saved, table

#: Words whose ids a worker remembers.
WORD_CACHE = 300_000
#: Pieces of one (length, bucket) that a task ranks at a time, about.
BUCKET_ROWS = 50_000


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit numbers; a worker encodes a word when it first meets it."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = word_encoder(path)

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > WORD_CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, words_of(text)))


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece; each text is encoded once, whole."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = known.of(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    for column, x in zip(out, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns (count, {length: how many}), from the counts of lengths: longest first, into the shortest pack."""
    room: dict[int, list[list]] = {}  # free space: [count, {length: how many}]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length >= size:
            room.setdefault(0, []).append([left, {length: 1}])
            continue
        while left:
            free = max((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                # New packs: none open has room. As many as take all that is left, filled evenly.
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    room.setdefault(size - each * length, []).append([full, {length: each}])
                if rest:
                    room.setdefault(size - rest * length, []).append([1, {length: rest}])
                break
            pattern = room[free].pop()
            took = min(pattern[0], left)
            if took < pattern[0]:
                room[free].append([pattern[0] - took, pattern[1]])
            # Where even one more of this length in each pack leaves more to place, place evenly at once.
            each = max(1, min(left // took, free // length, (free - max((r for r in room if r < free and room[r]), default=0)) // length)) if took == pattern[0] else 1
            lengths = dict(pattern[1])
            lengths[length] = lengths.get(length, 0) + each
            room.setdefault(free - each * length, []).append([took, lengths])
            left -= took * each
    return [(count, lengths) for patterns in room.values() for count, lengths in patterns]


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each (length, pattern): the ranks it takes, its first sequence, pieces a sequence, and offset there."""
    rows, taken, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length, each in lengths.items():
            begin = taken.get(length, 0)
            rows.append((length, begin, sequence, each, offset))
            taken[length] = begin + count * each
            offset += length * each
        sequence += count
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "begin", "sequence", "each", "offset"))}


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 0, within each length."""
    n = rows.count()
    buckets = max(16, n // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32"))
    return rows.join(before, ["length", "_bucket"]).withColumn("rank", within - 1 + F.col("_before")).drop("_bucket", "_before")


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    rows = saved(pieces(docs, path, size, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}  # at most `size` rows
    at = rows.sparkSession.sparkContext.broadcast(places(plan(histogram, size)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        p = at.value
        stride = int(p["begin"].max()) + int(rank.max()) + 2
        k = np.searchsorted(p["length"] * stride + p["begin"], length.to_numpy() * stride + rank.to_numpy(), "right") - 1
        over = rank.to_numpy() - p["begin"][k]
        return pd.DataFrame({"sequence_id": p["sequence"][k] + over // p["each"][k], "offset": p["offset"][k] + over % p["each"][k] * length.to_numpy()})

    return ranked(rows).withColumn("_at", place("length", "rank")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), 4096, 2)

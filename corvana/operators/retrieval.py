"""Dense, sparse and merged top-k retrieval, keyed by chunk id."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .matching import hits
from .sizes import small
from .tables import dealt

#: Mode: chunks by dense and by sparse score, and tokens of context.
DEPTHS = {"light": (0, 0, 4000), "standard": (5, 5, 8000), "deep": (10, 10, 12000), "extreme": (10, 10, 16000)}
#: Query vectors that may be broadcast; more meet the vectors in blocks.
BROADCAST_QUERIES = 2000
#: Vectors of a block of an index; vectors that meet all queries at a time; pairs that a batch holds, and that a task returns.
BLOCK_ROWS, TILE, PAIRS, TASK_PAIRS = 1024, 256, 200_000, 8_000_000
#: Asked tokens that may be broadcast (about 30 MB), and salts of the join beyond.
MOST_TOKENS, SALTS = 500_000, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def in_blocks(rows: DataFrame, key: str) -> list[DataFrame]:
    """A stated set of rows in blocks that may each be broadcast."""
    n = -(-rows.count() // BROADCAST_QUERIES) or 1
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def finite(v: str) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scored(queries: DataFrame, vectors: DataFrame, by_score: bool = False) -> DataFrame:
    """(qid, id, score) of each query (qid, q), a stated set, with each vector (id, v): all of them, block of queries by block, by one
    matrix product for a tile of `PAIRS`. Null where either is null or has a null component, or their lengths differ. Vectors are
    dealt evenly over tasks that grow with the pairs. by_score: a task holds the scores of `TASK_PAIRS` and returns them in their
    order, so that equal ones, which are most of a file's bytes, stand together; numbers of ids take less than scores."""
    spark = vectors.sparkSession
    doubles = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.transform(c, lambda x: x.cast("double")))
    asked = queries.select("qid", doubles("q").alias("q"))
    rows = vectors.select("id", doubles("v").alias("v"))
    kinds = {"qid": asked.schema["qid"].dataType, "id": rows.schema["id"].dataType}
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-rows.count() * min(asked.count(), BROADCAST_QUERIES) // TASK_PAIRS))
    dealt = rows.repartition(tasks)
    found = []
    for part in in_blocks(asked, "qid"):
        own = part.collect()
        sizes = np.array([-1 if q is None else len(q) for _, q in own])
        by_size = {int(n): (np.flatnonzero(sizes == n), np.array([own[i][1] for i in np.flatnonzero(sizes == n)], float).reshape(-1, n)) for n in set(sizes[sizes >= 0].tolist())}
        shared = spark.sparkContext.broadcast(([r[0] for r in own], by_size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            listed, by_size = shared.value
            qids = pa.array(listed, to_arrow_type(kinds["qid"]))
            tile = max(1, (TASK_PAIRS if by_score else PAIRS) // max(1, len(qids)))
            for batch in batches if len(qids) else ():
                for at in range(0, batch.num_rows, tile):
                    ids, v = batch.column(0).slice(at, tile), batch.column(1).slice(at, tile)
                    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(v).to_pylist()])
                    scores, known = np.zeros((len(ids), len(qids))), np.zeros((len(ids), len(qids)), bool)
                    for size, (where, matrix) in by_size.items():
                        here = np.flatnonzero(sizes == size)
                        mine = v.take(pa.array(here)).flatten().to_numpy().reshape(len(here), size)
                        scores[np.ix_(here, where)], known[np.ix_(here, where)] = np.round(mine @ matrix.T, 6), True
                    order = np.argsort(scores, axis=None) if by_score else np.arange(scores.size)
                    for start in range(0, len(order), PAIRS):
                        own = order[start : start + PAIRS]
                        i, j = np.divmod(own, len(qids))
                        out = [qids.take(pa.array(j)), ids.take(pa.array(i)), pa.array(scores.ravel()[own], mask=~known.ravel()[own])]
                        yield pa.RecordBatch.from_arrays(out, names=["qid", "id", "score"])

        schema = T.StructType([T.StructField("qid", kinds["qid"]), T.StructField("id", kinds["id"]), T.StructField("score", T.DoubleType())])
        found.append(dealt.mapInArrow(run, schema))
    return functools.reduce(DataFrame.unionByName, found)


def plain(vectors: DataFrame) -> DataFrame:
    """(id, size, v) of vectors that can be searched, in 64 bits."""
    rows = vectors.where(F.col("id").isNotNull() & finite("v"))
    return rows.select(F.col("id").cast("long").alias("id"), F.size("v").alias("size"), F.transform("v", lambda x: x.cast("double")).alias("v"))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, ids, matrix) of at most `BLOCK_ROWS` vectors of one length each, from batches (id, size, v)."""
    for batch in batches:
        sizes, ids, flat = batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(2)
        for size in np.unique(sizes):
            every = np.flatnonzero(sizes == size)
            for at in range(0, len(every), BLOCK_ROWS):
                own = every[at : at + BLOCK_ROWS]
                yield int(size), ids[own].astype(np.int64), flat.take(pa.array(own)).flatten().to_numpy().astype(np.float64).reshape(len(own), size)


def index(vectors: DataFrame) -> DataFrame:
    """(size, ids, matrix): vectors (id, v) of one length in blocks, to be written once and searched often: ids and components as
    64-bit numbers. Null vectors, and those with a null or non-finite component, are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, ids, matrix in blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids.tobytes()]), pa.array([matrix.tobytes()])], names=["size", "ids", "matrix"])

    return plain(vectors).mapInArrow(run, "size int, ids binary, matrix binary")


class Best:
    """The k best (score, then smaller id) of each of some queries of one length; what is held is k rows a query."""

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, k: int):
        self.qids, self.matrix, self.k = qids, matrix, k
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(qids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(ids), TILE):
            scores = np.round(self.matrix @ vectors[start : start + TILE].T, 6)
            q, j = np.divmod(np.flatnonzero(~(scores < self.worst[:, None])), scores.shape[1])
            if not len(q):
                continue
            at, every, told = np.concatenate([self.at, q]), np.concatenate([self.ids, ids[start + j]]), np.concatenate([self.scores, scores[q, j]])
            order = np.lexsort((every, -told, at))
            at = at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            order, at = order[rank < self.k], at[rank < self.k]
            self.at, self.ids, self.scores = at, every[order], told[order]
            last = np.searchsorted(at, np.arange(len(self.qids)), "right")
            full = last - np.searchsorted(at, np.arange(len(self.qids))) == self.k
            self.worst[full] = self.scores[last[full] - 1]


def searched(rows: DataFrame, blocks, queries: DataFrame, k: int) -> DataFrame:
    """The search of `found_in` over rows that `blocks` turns into (size, ids, matrix) in the task."""
    spark = rows.sparkSession
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.transform("q", lambda x: x.cast("double")).alias("q")).where(finite("q"))
    found = []
    for part in in_blocks(asked, "qid"):
        by_size: dict[int, tuple[list, list]] = {}
        for qid, q in part.collect():
            own = by_size.setdefault(len(q), ([], []))
            own[0].append(qid)
            own[1].append(q)
        shared = spark.sparkContext.broadcast({s: (np.array(i, np.int64), np.array(m, float).reshape(len(i), s)) for s, (i, m) in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kept = {s: Best(i, m, k) for s, (i, m) in shared.value.items()}
            for size, ids, matrix in blocks(batches):
                if size in kept:
                    kept[size].add(ids, matrix)
            for own in kept.values():
                yield pa.RecordBatch.from_arrays([pa.array(own.qids[own.at]), pa.array(own.ids), pa.array(own.scores)], names=["qid", "id", "score"])

        found.append(rows.mapInArrow(run, "qid long, id long, score double"))
    return best(functools.reduce(DataFrame.unionByName, found), k)


def found_in(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best of an index for each query (qid, q), a stated set, block of queries by block. A task keeps k
    rows a query while blocks of vectors stream past, by one matrix product a tile; no pair of vectors is a row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for size, ids, matrix in zip(*batch.columns, strict=True):
                new = np.frombuffer(ids.as_buffer(), np.int64)
                yield size.as_py(), new, np.frombuffer(matrix.as_buffer()).reshape(len(new), size.as_py())

    return searched(blocks.select("size", "ids", "matrix"), read, queries, k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query, through blocks that are made on the way and never leave their task."""
    return searched(plain(vectors), blocks_of, queries, k)


def best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(id, token, weight): counts of tokens; of the tokens of `only` (token), if given. Texts are dealt by their key first, so that
    neither counts nor scores of an id need another shuffle, and a task holds those of a bounded number of texts."""
    tokens = dealt(docs.select(key, text), key).select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), 1)).alias("token"))
    if only is not None:
        tokens = tokens.join(small(only.select("token").distinct(), MOST_TOKENS), "token", "left_semi")
    return tokens.groupBy("id", "token").agg(F.count("*").cast("double").alias("weight"))


def sparse(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, id, score) over common tokens of queries (qid, token, weight) and postings (id, token, weight). Asked tokens of a
    checked number are broadcast, so that a frequent token is no hot key; beyond, the join is salted."""
    asked = queries.select("qid", "token", F.col("weight").alias("w"))
    if len(asked.select(F.lit(1)).limit(MOST_TOKENS + 1).take(MOST_TOKENS + 1)) <= MOST_TOKENS:
        joined = index.join(F.broadcast(asked), "token")
    else:
        salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = index.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "_salt"])
    return joined.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("weight")), 6).alias("score"))


def merged(dense: DataFrame, other: DataFrame, source: list[str]) -> DataFrame:
    """Union of two result lists, the best row of each source (and query), by score."""
    w = Window.partitionBy(*source).orderBy(F.desc("score"), "id")
    return dense.unionByName(other).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def within_budget(ranked: DataFrame, tokens: int, longest: int = 500) -> DataFrame:
    """Rows (qid, rank, text) while their texts, cut to `longest` characters, fit the tokens."""
    cut = ranked.withColumn("text", F.substring("text", 1, longest)).withColumn("tokens", F.ceil(F.octet_length("text") / 3))
    used = F.sum("tokens").over(Window.partitionBy("qid").orderBy("rank"))
    return cut.withColumn("used", used).where(F.col("used") <= tokens)


def contaminated(source: Column, roots: tuple[str, ...] = ("skills/", "studentdata", "session-output")) -> Column:
    path = F.lower(F.replace(source, F.lit("\\"), F.lit("/")))
    found = F.lit(False)
    for root in roots:
        found = found | path.contains(root)
    return found


def coverage(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """keys(key) with found: whether any text contains it. All keys go over a text at once; the empty key is in any text there is."""
    hit = hits(texts.select(F.lit(0).alias("_row"), "text"), "_row", "text", keys.select(F.col("key").alias("term"))).select(F.col("term").alias("key")).distinct()
    some = texts.where("text is not null").limit(1).select(F.lit("").alias("key"))
    return keys.join(hit.union(some).withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def depths(mode: str) -> tuple[int, int, int]:
    """(dense chunks, sparse chunks, tokens of context) of a mode."""
    if mode not in DEPTHS:
        raise ValueError(f"mode is none of {', '.join(DEPTHS)}")
    return DEPTHS[mode]


def hashed_encoder(dimensions: int = 1024, most_tokens: int = 1024):
    """A deterministic stand-in for an encoder model: hashed tokens, L2-normalised, and token weights. Any function of texts that
    gives (dense, weights) pairs may take its place."""

    def encode(texts: list[str]) -> list[tuple[np.ndarray, dict[str, float]]]:
        out = []
        for text in texts:
            tokens = re.findall(r"\w+", text.lower())[:most_tokens]
            dense, weights = np.zeros(dimensions), {}
            for x in tokens:
                code = zlib.crc32(x.encode())
                dense[code % dimensions] += 1 if code & 1 << 31 else -1
                weights[x] = weights.get(x, 0.0) + 1.0
            norm = float(np.sqrt((dense**2).sum()))
            out.append((dense / (norm or 1.0), {k: v / len(tokens) for k, v in weights.items()}))
        return out

    return encode


def encoded(chunks: DataFrame, encoder=None, batch: int = 16) -> DataFrame:
    """chunks (.., text) with dense and weights, by a vectorised encoder in batches. `max_length` is the encoder's own."""

    @F.pandas_udf("dense array<float>, weights map<string,float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = encoder or hashed_encoder()
        for part in parts:
            texts = [x or "" for x in part]
            found = [y for at in range(0, len(texts), batch) for y in model(texts[at : at + batch])]
            yield pd.DataFrame({"dense": [d.astype("float32").tolist() for d, _ in found], "weights": [w for _, w in found]})

    return chunks.withColumn("_e", run("text")).select("*", "_e.*").drop("_e")


class Session:
    """A search session: `mode NAME`, `k N` or a query; errors are answers and do not end it."""

    def __init__(self, search, mode: str = "dense", k: int = 5, modes: tuple[str, ...] = ("dense", "sparse", "hybrid")):
        self.search, self.mode, self.k, self.modes = search, mode, k, modes

    def answer(self, line: str):
        command, _, rest = line.strip().partition(" ")
        if command == "mode" and rest:
            if rest not in self.modes:
                return f"mode is none of {', '.join(self.modes)}"
            self.mode = rest
            return f"mode {rest}"
        if command == "k" and rest:
            if not rest.isdigit() or not int(rest):
                return "k is a whole number over 0"
            self.k = int(rest)
            return f"k {self.k}"
        try:
            return self.search(line.strip(), self.mode, self.k) if line.strip() else ""
        except Exception as error:  # noqa: BLE001 a session outlives a failed search
            return f"error: {error}"

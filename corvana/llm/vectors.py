"""Near-duplicate embeddings: subspace pigeonhole join under a cosine threshold.

Unit vectors at cosine t or more are at squared distance 2 - 2t or less. Vectors are turned to the principal axes of a bounded
sample (any orthogonal axes give the same result) and the axes are dealt to blocks of `BLOCK`, so that blocks hold about as
much variance each. The squared distance that is allowed is divided over the blocks in proportion to their variance: a pair
over the threshold keeps to the share of one block at least. Each block is joined by itself, a range join on its first axes:
a vector lies in a cell, and also in the next one along each axis where it is within the block's range of the border, so that
a pair in range meets in the cell that is the larger of both homes on each axis, and counts only there. Cells with one vector
go no further. Axes whose cells part the sample too little are passed over: a block without any is one cell. In a cell, the
block's distance picks the candidates, by products of tiles, the cosine of the whole vectors in double precision decides, and a
link counts for the first block whose share it keeps to. So each link counts once though blocks overlap, and no pair of vectors
is ever a row: a task returns, for each vector, how many vectors it is linked to and one of its class.

Equal vectors of one label are one from the start, with their number. A cell of more than `CHUNK` vectors (or `CHUNK_BYTES`) is
dealt into parts which meet two by two, so memory stays bounded; what is compared in a dense cell still grows with its square, as every link
of different vectors has to be counted.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and rows without label or vec_id, link
with nothing and are classes of their own; a null vec_id keeps a null component and is kept. Vectors of different lengths do
not meet. Rows that share a vec_id are vectors of their own. Repeated rows are linked to each other. Of equal vec_ids all are
kept that carry the smallest. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lookup, mixed, saved, table
from .components import components

#: Axes of a block, vectors that the axes are fitted on, components of a vector that is turned, and lengths that are fitted.
BLOCK, FIT, TURNED, LENGTHS = 16, 4096, 1024, 8
#: Vectors of a cell that one task holds once; rows, and vectors, compared at a time; width of a cell in ranges.
CHUNK, SLICE, TILE, WIDTH = 32_768, 256, 8192, 2
#: Candidates judged at a time.
JUDGED = 65_536
#: Most of the pairs that cells along an axis may leave: axes that part fewer cost more copies than they save.
MOST_LEFT = 0.75
#: Bytes of the vectors that a task holds twice: long vectors make smaller parts.
CHUNK_BYTES = 64_000_000
#: What rounding to 32 bits may add to a squared distance of unit vectors.
BLUR = 2e-6
#: What a block's distance by a product in 32 bits may be off; candidates are judged again in 64.
SLACK = 1e-5


def unit(flat: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square under- or overflows."""
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat**2).sum(1, keepdims=True))


class Blocks:
    """Axes of vectors of one length, dealt to blocks, with the share of the squared distance that each may use."""

    def __init__(self, size: int, sample: np.ndarray | None, threshold: float):
        if sample is not None and 1 < size <= TURNED:
            spread, found = np.linalg.eigh(np.cov(sample.T))
            spread, self.axes = np.maximum(spread[::-1], 0), found.T[::-1]
        else:
            spread, self.axes = np.ones(size), None
        n = -(-size // BLOCK)
        rounds = np.arange(size) // n
        place = np.where(rounds % 2 == 0, np.arange(size) % n, n - 1 - np.arange(size) % n)  # there and back, in falling order
        order = np.argsort(place, kind="stable")
        self.axes = order if self.axes is None else self.axes[order]
        ends = np.cumsum(np.bincount(place, minlength=n))
        self.parts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        mass = np.array([spread[order][a:b].sum() for a, b in self.parts]) + spread.sum() / (100 * n) + 1e-12
        self.budgets = (2 - 2 * threshold) * mass / mass.sum() + BLUR
        self.useful = [b - a for a, b in self.parts]
        if sample is not None:
            x = self.turned(sample)
            self.useful = [self.parting(x, block) for block in range(len(self.parts))]

    def parting(self, x: np.ndarray, block: int) -> int:
        """How many of the block's first axes have cells that part the sample."""
        home, near = self.homes(x, block, BLOCK)
        for k in range(home.shape[1]):
            at, n = np.unique(np.concatenate([home[:, k], home[near[:, k], k] + 1]), return_counts=True)
            if ((n / len(x)) ** 2).sum() > MOST_LEFT:
                return k
        return home.shape[1]

    def turned(self, v: np.ndarray) -> np.ndarray:
        return (v[:, self.axes] if self.axes.ndim == 1 else v @ self.axes.T).astype(np.float32)

    def homes(self, x: np.ndarray, block: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells of turned vectors along the block's first axes, and whether they are in range of the next one."""
        a, b = self.parts[block]
        reach = np.sqrt(self.budgets[block])
        side = WIDTH * reach
        at = x[:, a : min(b, a + min(axes, self.useful[block]))].astype(float)
        home = np.floor(at / side)
        return home.astype(np.int64), at - home * side >= side - reach * (1 + 1e-6)


def cell_code(home: np.ndarray) -> np.ndarray:
    out = np.full(len(home), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(home.shape[1]):
        out = mixed(out ^ home[:, k].astype(np.uint64))
    return out.view(np.int64)


def fitted(rows: DataFrame, threshold: float) -> dict[int, Blocks]:
    """Blocks for the lengths that a sample of `FIT` vectors of up to `TURNED` components shows most; others keep their own axes."""
    sample = rows.where(F.col("size") <= TURNED).orderBy(F.xxhash64("key")).limit(FIT).select("size", "e").collect()
    by_size: dict[int, list] = {}
    for size, e in sample:
        by_size.setdefault(size, []).append(e)
    largest = sorted((x for x in by_size if len(by_size[x]) > 2), key=lambda s: -len(by_size[s]))[:LENGTHS]
    return {s: Blocks(s, unit(np.array(by_size[s], float)), threshold) for s in largest}


def placed(rows: DataFrame, known: dict[int, Blocks], threshold: float) -> DataFrame:
    """rows with `v` (the vector as it is, 32 bits a component where these hold it, else 64) and `x` (turned at length one, 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs, xs = [], []
            for e in batch.column("e").to_pylist():
                v = np.array(e, float)
                with np.errstate(over="ignore"):
                    short = v.astype(np.float32)
                vs.append((short if (short == v).all() else v).tobytes())
                xs.append(blocks_of(known, len(e), threshold).turned(unit(v[None, :])).tobytes())
            kept = batch.drop_columns(["e"])
            yield kept.append_column("v", pa.array(vs, pa.binary())).append_column("x", pa.array(xs, pa.binary()))

    kept = [c for c in rows.columns if c != "e"]
    kinds = dict(rows.dtypes)
    return rows.select(*kept, "e").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", v binary, x binary")


def blocks_of(known: dict[int, Blocks], size: int, threshold: float) -> Blocks:
    if size not in known:
        known[size] = Blocks(size, None, threshold)
    return known[size]


def cells(reps: DataFrame, known: dict[int, Blocks], threshold: float, axes: int) -> DataFrame:
    """(rep, label, size, block, cell): where each vector has to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(2).to_pylist(), np.int64)
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                by = blocks_of(known, int(size), threshold)
                x = np.frombuffer(b"".join(own.column(3).to_pylist()), np.float32).reshape(-1, size)
                for block in range(len(by.parts)):
                    home, near = by.homes(x, block, axes)
                    for step in np.ndindex(*(2,) * home.shape[1]):
                        step = np.array(step, bool)
                        there = np.flatnonzero((near | ~step).all(1))
                        out = own.select([0, 1, 2]).take(pa.array(there))
                        out = out.append_column("block", pa.array(np.full(len(there), block, np.int32)))
                        yield out.append_column("cell", pa.array(cell_code(home[there] + step)))

    return reps.select("rep", "label", "size", "x").mapInArrow(run, "rep long, label string, size int, block int, cell long")


class Cell:
    """One group of vectors: `chunk` tells the two parts of a large cell apart where they meet."""

    def __init__(self, by: Blocks, block: int, cell: int, axes: int, two: bool, threshold: float, held: list[tuple]):
        reps, ns, chunks, vs, xs = zip(*held, strict=True)
        self.reps, self.ns, self.chunks = np.array(reps), np.array(ns), np.array(chunks)
        self.by, self.block, self.cell, self.two, self.threshold = by, block, cell, two, threshold
        size = len(xs[0]) // 4
        self.v = unit(np.array([np.frombuffer(v, np.float32 if len(v) == 4 * size else np.float64) for v in vs], float))
        self.x = np.frombuffer(b"".join(xs), np.float32).reshape(len(reps), -1).astype(float)
        self.home = by.homes(self.x.astype(np.float32), block, axes)[0]

    def linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which candidates are links that count here: over the threshold, in no earlier block, and at home in this cell."""
        stay = np.empty(len(i), bool)
        for at in range(0, len(i), 16_384):
            a, b = i[at : at + 16_384], j[at : at + 16_384]
            ok = np.flatnonzero(np.einsum("ij,ij->i", self.v[a], self.v[b]) >= self.threshold)
            for k in range(self.block):
                ok = ok[self.apart(a[ok], b[ok], k) > self.by.budgets[k]]
            ok = ok[cell_code(np.maximum(self.home[a[ok]], self.home[b[ok]])) == self.cell]
            part = np.zeros(len(a), bool)
            part[ok] = True
            stay[at : at + 16_384] = part
        return stay

    def apart(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        lo, hi = self.by.parts[block]
        return ((self.x[a, lo:hi] - self.x[b, lo:hi]) ** 2).sum(1)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs, each once, within the block's range, from squared distances by products of tiles in 32 bits."""
        lo, hi = self.by.parts[self.block]
        x = self.x[:, lo:hi].astype(np.float32)
        square, one = (x**2).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
        left, right = np.hstack([-2 * x, square, one]), np.hstack([x, one, square])
        order = np.argsort(self.chunks, kind="stable")
        first = int((self.chunks == self.chunks[order[0]]).sum()) if self.two else len(x)
        left, right = left[order], right[order]
        for at in range(0, first, SLICE):
            end = min(first, at + SLICE)
            for to in range(first if self.two else at, len(x), TILE):
                near = left[at:end] @ right[to : to + TILE].T <= self.by.budgets[self.block] + SLACK
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                i, j = i + at, j + to
                i, j = order[i[j > i]], order[j[j > i]]
                for k in range(0, len(i), JUDGED):
                    a, b = i[k : k + JUDGED], j[k : k + JUDGED]
                    sure = self.apart(a, b, self.block) <= self.by.budgets[self.block]
                    yield a[sure], b[sure]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rep, vectors linked to it, a rep of its class) of those with links."""
        n = len(self.reps)
        degree, up = np.zeros(n, np.int64), np.arange(n)
        for i, j in self.candidates():
            stay = self.linked(i, j)
            i, j = i[stay], j[stay]
            np.add.at(degree, i, self.ns[j])
            np.add.at(degree, j, self.ns[i])
            while len(i):
                a, b = up[i], up[j]
                if (a == b).all():
                    break
                np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
                while (up[up] != up).any():
                    up = up[up]
        some = np.flatnonzero(degree)
        return self.reps[some], degree[some], self.reps[up[some]]


def meet(rows: DataFrame, known: dict[int, Blocks], threshold: float, axes: int) -> DataFrame:
    """(rep, links, head) from rows sorted by group."""
    key = ["label", "size", "block", "cell", "one", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def out() -> pa.RecordBatch:
            _, size, block, cell, one, other = at
            if len(held) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["rep", "links", "head"])
            found = Cell(blocks_of(known, size, threshold), block, cell, axes, one != other, threshold, list(held.values()))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found.links()], names=["rep", "links", "head"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:6] != at:
                    if held:
                        yield out()
                    at, held = row[:6], {}
                held[row[6]] = row[6:]
        if held:
            yield out()

    rows = rows.select(*key, "rep", "n", "chunk", "v", "x")
    return rows.sortWithinPartitions(*key).mapInArrow(run, "rep long, links long, head long")


def groups(at: DataFrame, crowded: DataFrame, total: int) -> DataFrame:
    """(rep, label, size, block, cell, chunk, one, other): rows of `at` once for each pair of parts of their cell."""
    rows = lookup(at.select("rep", F.struct("label", "size", "block", "cell").alias("key")), "key", crowded, total)
    chunk = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    rows = rows.select("rep", "key.*", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    return rows.select("rep", "label", "size", "block", "cell", "chunk", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"))


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("e"))
    sound = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    key = F.when(takes_part, F.struct("label", F.xxhash64("e").alias("a"), F.xxhash64(F.lit(1), "e").alias("b")))
    keyed = rows.withColumn("key", key)
    same = keyed.where("key is not null").groupBy("key").agg(F.first("e").alias("e"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    same = saved(same.select("key", "least", "n", F.col("key.label").alias("label"), F.size("e").alias("size"), "e", F.monotonically_increasing_id().alias("rep")), "vectors")
    count, longest = same.agg(F.count("*"), F.max("size")).first()
    chunk = max(1, min(CHUNK, CHUNK_BYTES // (20 * (longest or 1))))
    axes = max(1, min(BLOCK, round(np.log10(count + 1)) - 3))  # cells get finer as vectors get more
    known = fitted(same, threshold)
    reps = saved(placed(same, known, threshold), "turned")
    at = saved(cells(reps, known, threshold, axes), "cells")
    crowded = at.groupBy(F.struct("label", "size", "block", "cell").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    crowded = saved(crowded.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"), "n"), "crowded")
    total = at.count()
    dealt = groups(at, crowded, total).join(reps.select("rep", "n", "v", "x"), "rep")
    tasks = max(4 * reps.sparkSession.sparkContext.defaultParallelism, -(-total // chunk))
    met = saved(meet(dealt.repartition(tasks, "label", "size", "block", "cell", "one", "other"), known, threshold, axes), "met")
    loose = components(met.select(F.col("head").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("v", "rep")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    judged = reps.select("rep", "key", "least", "n").join(loose, "rep", "left").join(links, "rep", "left")
    judged = saved(judged.select("key", "least", "n", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "judged")
    least = judged.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    final = saved(lookup(judged.withColumnRenamed("n", "copies"), "root", least.withColumnRenamed("c", "n"), count), "final")
    drop(at, crowded, met, judged)
    found = lookup(keyed.where("key is not null").select("vec_id", "key"), "key", final.select("key", "n_links", "component_id", F.col("copies").alias("n")), max(1, keyed.count()))
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op11(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


SQL = """
with recursive e as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
s as materialized (
  select * from e where vec_id is not null and label is not null and v is not null
    and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as materialized (
  select a.r as a, b.r as b from s a join s b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select a, a from l union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select reach.a, min(e.vec_id) as component_id from reach join e on e.r = reach.b group by reach.a),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.component_id, e.vec_id) as component_id,
  coalesce(e.vec_id = coalesce(c.component_id, e.vec_id), true) as kept
from e left join n on n.a = e.r left join c on c.a = e.r
"""

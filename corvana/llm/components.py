"""Connected components of an edge table, by contraction: no component and no list of edges leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lookup, saved

#: Edges that one task finishes, 16 bytes each: graphs of more are contracted over all tasks until no more are left.
LOCAL = 250_000


def moves(edges: DataFrame, turn: int, total: int, seed: int = 0) -> DataFrame:
    """(v, m, n): where each vertex of edges goes, and its degree.

    A vertex takes the first of itself and its neighbours, then what that one took. First is the smallest id in turn 0 without
    a seed (one turn does for stars of the smallest), else by a hash of seed and turn: few vertices, by chance, come first
    among their neighbours, so that chains and any other shape shrink by a constant factor a turn."""
    rank = lambda x: F.xxhash64(x, F.lit(seed + turn)) if seed or turn else F.lit(0).cast("long")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("m"))).alias("near"), F.count("*").alias("n"))
    taken = near.select(F.col("a").alias("v"), F.least(F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("m")), "near").getField("m").alias("m"), "n")
    return lookup(taken, "m", taken.select(F.col("v").alias("m"), F.col("m").alias("to"), "n"), 2 * total).select("v", F.col("to").alias("m"), "n")


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges, and the smallest vertex that each reaches: roots hook to the smallest root across an edge, then all are
    followed to their ends, until no edge joins two roots."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (open_ := up[a] != up[b]).any():
        x, y = up[a[open_]], up[b[open_]]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((on := up[up]) != up).any():
            up = on
    return ids, ids[up]


def finished(edges: DataFrame) -> DataFrame:
    """(v, m) of at most `LOCAL` edges, in one task: m is the smallest vertex of v's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            found = rooted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["v", "m"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, m long")


def components(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(v, root) for every end of edges (a, b): root is the smallest vertex of v's component. Stars whose centres come first by
    the hash of seed take one turn.

    Each turn redraws the edges between what their ends took, until at most `LOCAL` are left, which one task finishes; the
    number of turns grows with the logarithm of the vertices. Then the turns' moves are followed from the last to the first.
    Vertices with a large share of the edges are looked up by broadcast of at most `HEAVY` of them, so stars are no hot keys."""
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    turns: list[tuple[DataFrame, int]] = []
    while (total := edges.count()) > LOCAL:
        taken = saved(moves(edges, len(turns), total, seed), "taken")
        turns.append((taken, total))
        ends = edges
        for end in ("a", "b"):
            ends = lookup(ends, end, taken.select(F.col("v").alias(end), F.col("m").alias(f"m{end}"), "n"), 2 * total)
        drawn = ends.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        drawn, old = saved(drawn, "edges"), edges
        edges = drawn
        drop(old)
    labels = saved(finished(edges), "labels")
    drop(edges)
    if not turns:
        return labels.withColumnRenamed("m", "root")
    for taken, total in reversed(turns):
        # How many vertices came to a place: a bound for the rows that look it up.
        came = taken.groupBy("m").agg(F.count("*").alias("n"))
        onward = came.join(labels.select(F.col("v").alias("m"), F.col("m").alias("to")), "m", "left").select("m", F.coalesce("to", "m").alias("to"), "n")
        old, labels = labels, saved(lookup(taken.select("v", "m"), "m", onward, 2 * total).select("v", F.col("to").alias("m")), "labels")
        drop(old, taken)
    least = labels.groupBy("m").agg(F.min("v").alias("root"), F.count("*").alias("n"))
    out = saved(lookup(labels.select("v", "m"), "m", least, 2 * turns[0][1]).select("v", "root"), "roots")
    drop(labels)
    return out

"""Candidates of several engines: flags, consensus, de-duplication, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import numbered, running, saved


#: Rows of a block, in order, whose jumps one task follows.
BLOCK = 65_536


def consensus(candidates: DataFrame, required: list[str]) -> DataFrame:
    """(key, winner, status, disagrees) from usable candidates (key, engine, norm): a winner has all required engines."""
    groups = candidates.groupBy("key", "norm").agg(F.collect_set("engine").alias("engines"))
    full = F.size(F.array_except(F.array(*map(F.lit, required)), F.col("engines"))) == 0
    best = groups.groupBy("key").agg(F.max_by(F.when(full, F.col("norm")), F.struct(full, F.size("engines"), F.col("norm"))).alias("winner"), F.count("*").alias("values"))
    return best.select("key", "winner", F.when(F.col("winner").isNotNull(), "agreed").otherwise("needs_review").alias("status"), (F.col("winner").isNull() & (F.col("values") > 1)).alias("disagrees"))


def by_hash(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """rows with sha and owner: the smallest key of the same content."""
    hashed = rows.withColumn("sha", F.sha2(content, 256))
    owners = hashed.groupBy("sha").agg(F.min(key).alias("owner"))
    return hashed.join(owners, "sha")


def pending(hashes: DataFrame, done: DataFrame) -> DataFrame:
    return hashes.select("sha").distinct().join(done, "sha", "left_anti")


def best_candidate(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The highest score of each key; of equals the first."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(order))).alias("_r")).select(key, "_r.*")


def spread_conflicts(rows: DataFrame, key: str, score: str, confidence: str, spread: float = 60, least: float = 0.65) -> DataFrame:
    found = rows.groupBy(key).agg((F.max(score) - F.min(score)).alias("spread"), F.min(confidence).alias("least"))
    return found.where((F.col("spread") > spread) | (F.col("least") < least))


def packed(rows: DataFrame, key: str, order: str, size: str, cap: int, most: int | None = None) -> DataFrame:
    """(key, order, part): greedy groups in order, a new one where the cap would be passed, or `most` rows. A row larger than the
    cap is a group. Rows stream by key and order; a key's groups depend on each other, so they are one task's, but nothing of a
    key is held but its last group's size. Keys of any length over many tasks: `packed_by_jumps`."""
    plain = rows.select(key, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias("_size"))
    schema = T.StructType([plain.schema[key], plain.schema[order], T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, used, n = object(), 0, 0, 0
        for batch in batches:
            parts = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = x or 0
                if k != now:
                    now, part, used, n = k, 0, 0, 0
                if n and (used + x > cap or n == most):
                    part, used, n = part + 1, 0, 0
                used, n = used + x, n + 1
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int32())], names=[key, order, "part"])

    return plain.repartition(key).sortWithinPartitions(key, order, "_size").mapInArrow(run, schema)


def followed(jump: DataFrame, entries: DataFrame, every: bool) -> DataFrame:
    """(_n, _to, _part) of jumps (_n, _to) inside each block, from its entries (_n, _part): where each leaves the block, null if it
    does not, and the jumps it took; with `every` all rows on the way, each with its entry's _part and the jumps up to it."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = jump.select("_n", "_to", null("long").alias("_part")).union(entries.select("_n", null("long"), "_part"))
    rows = rows.withColumn("_block", F.floor(F.col("_n") / BLOCK).cast("long"))
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-jump.count() // BLOCK))

    def told(to: dict[int, int], begun: list[tuple[int, int]], block: int) -> pa.RecordBatch:
        end, out = (block + 1) * BLOCK, []
        done: dict[int, tuple[int | None, int]] = {}
        for n, part in sorted(begun, reverse=True):
            at, took, way = n, 0, []
            while at is not None and at < end and (every or at not in done):
                way.append(at)
                if every:
                    out.append((at, None, part + took))
                at, took = to.get(at), took + 1
            if every:
                continue
            leaves, more = done[at] if at in done else (at, 0 if at is not None else -1)
            for k, x in enumerate(way):
                done[x] = leaves, len(way) - k + more
            out.append((n, *done[n]))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["_n", "_to", "_part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, to, begun = None, {}, []
        for batch in batches:
            for block, n, target, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if begun:
                        yield told(to, begun, now)
                    now, to, begun = block, {}, []
                if part is None:
                    to[n] = target
                else:
                    begun.append((n, part))
        if begun:
            yield told(to, begun, now)

    dealt = rows.select("_block", "_n", "_to", "_part").repartition(blocks, "_block").sortWithinPartitions("_block")
    return dealt.mapInArrow(run, "_n long, _to long, _part long")


def packed_by_jumps(rows: DataFrame, key: str, order: str, size: str, cap: int, most: int | None = None) -> DataFrame:
    """What `packed` gives, for sizes of 0 or more and keys that are not null, with no key held by one task.

    Sums are scanned over ranges of the whole order. The group that begins at a row ends before the first row that no longer fits:
    rows by their sum and the limits of all rows are scanned together, and a limit takes the last row before it. That is a jump
    from each row to the next group's. Rows are dealt to blocks of `BLOCK` in order; a block's task follows the jumps from the few
    rows at which a block is entered (a key's first, and where jumps from before it end) to the first row behind it. Only these
    are doubled, by joins: from the first row of each key, the longest jump first, all entries that begin a group are reached, with
    the group's number. Then each block follows its own jumps once more, and a last scan gives the numbers to the rows between."""
    plain = rows.select(key, F.col(order).cast("long").alias(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s"))
    at = saved(running(numbered(plain, key, order, "_s", name="_n"), key, ["_n"], {"_sum": (F.sum, "_s")}), "sums")
    points = at.select(key, F.col("_sum").alias("_v"), F.lit(0).alias("_asks"), F.col("_n").alias("_last"), "_n")
    limits = at.select(key, (F.col("_sum") - F.col("_s") + cap).alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_last"), "_n")
    met = running(points.union(limits), key, ["_v", "_asks", "_n"], {"_fits": (F.max, "_last")}).where("_asks = 1")
    ends = at.groupBy(key).agg(F.min("_n").alias("_first"), F.max("_n").alias("_end"))
    after = F.greatest(F.coalesce("_fits", F.lit(0)), F.col("_n")) + 1
    after = F.least(after, F.col("_n") + most) if most else after
    jump = saved(met.join(ends, key).select("_n", after.alias("_to"), "_end").where("_to <= _end").select("_n", "_to"), "jumps")
    firsts = ends.select(F.col("_first").alias("_n"))
    crossing = jump.where(F.floor(F.col("_n") / BLOCK) != F.floor(F.col("_to") / BLOCK)).select(F.col("_to").alias("_n"))
    entries = saved(firsts.union(crossing).distinct(), "entries")
    hop = saved(followed(jump, entries.withColumn("_part", F.lit(0).cast("long")), False), "hops").where("_to is not null")
    hops = []
    while not hop.isEmpty():
        hops.append(hop)
        onward = hop.select(F.col("_n").alias("_to"), F.col("_to").alias("_far"), F.col("_part").alias("_more"))
        hop = saved(hop.join(onward, "_to").select("_n", F.col("_far").alias("_to"), (F.col("_part") + F.col("_more")).alias("_part")), "hops")
    reached = firsts.withColumn("_part", F.lit(0).cast("long"))
    for hop in reversed(hops):
        onward = hop.select("_n", "_to", F.col("_part").alias("_more"))
        reached = saved(reached.union(reached.join(onward, "_n").select(F.col("_to").alias("_n"), F.col("_part") + F.col("_more"))), "reached")
    starts = followed(jump, reached, True).select("_n", F.col("_part").cast("int").alias("_part"))
    marked = at.join(starts, "_n", "left")
    return running(marked, key, ["_n"], {"part": (F.max, "_part")}).select(key, order, "part")


def islands(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, island, low, high, n): runs whose neighbours are at most `gap` apart."""
    w = Window.partitionBy(key).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    marked = rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(key, "island").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))


def merged_boxes(boxes: DataFrame, key: str, size: str, short: int = 18) -> DataFrame:
    """(key, x0, y0, x1, y1): boxes (key, x0, y0, x1, y1) of a page of (size: width and height) with small gaps closed.

    From the top down, a box joins the one before, as that has grown, if one of them is lower than `short` and the gap is at most a
    hundredth of the page's height (4 at least). What is then narrower than 4 in 100 of the width (24 at least) goes. Boxes of equal
    top come by x0, y1 and x1. Boxes stream by key; one box is held."""
    columns = ["x0", "y0", "x1", "y1"]
    plain = boxes.select(key, *(F.col(c).cast("long").alias(c) for c in columns), F.col(size)["width"].cast("long").alias("_w"), F.col(size)["height"].cast("long").alias("_h"))
    schema = T.StructType([plain.schema[key], *(T.StructField(c, T.LongType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, page = None, None, None
        for batch in batches:
            out = []
            for k, x0, y0, x1, y1, width, height in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = last and k == at and y0 - last[3] <= max(4, height // 100) and (last[3] - last[1] < short or y1 - y0 < short)
                if near:
                    last = [min(last[0], x0), min(last[1], y0), max(last[2], x1), max(last[3], y1)]
                    continue
                if last and last[2] - last[0] >= max(24, page * 4 // 100):
                    out.append((at, *last))
                at, last, page = k, [x0, y0, x1, y1], width
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], batch.schema.types[n]) for n in range(5)], names=schema.names)
        if last and last[2] - last[0] >= max(24, page * 4 // 100):
            yield pa.RecordBatch.from_arrays([pa.array([v]) if n else pa.array([v], kind) for n, (v, kind) in enumerate(zip((at, *last), batch.schema.types[:5], strict=True))], names=schema.names)

    return plain.repartition(key).sortWithinPartitions(key, "y0", "x0", "y1", "x1").mapInArrow(run, schema)

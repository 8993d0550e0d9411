"""Prefix trie of conversations: level-order tries in numpy for each prefix shard, and heavy upper levels merged apart.

A turn is 128 bits of its role and text and its number of words; texts travel no further. Turns get their places by a sort over
ranges: a task numbers its own, and a conversation that runs over several tasks takes the counts before. A conversation is
rebuilt from its donor's first turns and its own others. Equal conversations are one, with their number. A node is known by
its depth and by the exclusive or of codes of turn and place up to it, which windows over `PIECE` turns make.

Nodes whose conversations have more than `SHARD` turns to go are the upper levels, with the root. Below them each node that is
not heavy is the top of a shard. A task makes its shards one forest in LOUDS form: nodes in level order, a bit vector with a
one for each child and a zero for each node's end, and arrays of labels, so a node's parent is the number of zeros before its
bit. Sums run over the levels from the last to the first.

Upper levels: of a conversation's nodes those it is the smallest member of are the deepest ones, without a gap. What these add,
and the totals of a shard whose top it is the smallest member of, is summed along the conversation from below; a node's subtree
is then the sum over all conversations through it, which Spark aggregates. Neither depth nor members pass one task.

Defined results: rows without conv_id belong to no conversation. Turns with equal numbers come by role, then by the bits of
their text; a null turn comes first. Null and empty roles and texts are the same. Repeated rows are turns of their own. Whole
texts count, of any length. `conv_id - conv_id % 20` is taken as SQL does for negative ids. An empty table gives no nodes, not
even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lookup, saved, table

#: Conversations that share a donor, and the most turns that are taken from it, by crc32 modulo `HEADS`.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that one window takes; turns under a node that one task takes.
PIECE, SHARD = 4096, 50_000
#: A multiple of PIECE less one, beyond any depth: sums from below run along what is left to it.
DEEPEST = PIECE * 2**30 - 1
EMPTY = hashlib.sha256(b"").hexdigest()
MEASURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, code, words) of the rows that belong to a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), code.alias("code"), words.alias("words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, code, words) of the rebuilt turns, and (conv_id) of every conversation, turnless ones too."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "code"]
    light = turns(conversations)
    at = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code", "words", F.monotonically_increasing_id().alias("at"))
    at = saved(at.withColumn("part", F.shiftright("at", 33)), "turns")
    parts = at.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks at most
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    donors = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("donor"), F.col("turns").alias("given"))
    plan = parts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("donor", F.col("conv_id") - F.col("conv_id") % FAMILY)
    plan = saved(plan.join(donors, "donor", "left").select("conv_id", "part", "first", "before", "h", "donor", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")), "plan")
    # A conversation's rows are dealt by part too, so that none is a hot key.
    placed = saved(at.join(plan, ["conv_id", "part"]).select("conv_id", "h", "taken", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "code", "words"), "placed")
    drop(at)
    kept = placed.where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "code", "words")
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("donor"), "pos", "code", "words")
    convs = plan.select("conv_id", "h", "donor").distinct()
    led = convs.join(heads, "donor").where(F.col("pos") < F.col("h")).select("conv_id", (F.col("pos") + 1).alias("depth"), "code", "words")
    return kept.union(led), convs.select("conv_id")


def running(rows: DataFrame, key: str, at: Column, made: dict[str, tuple]) -> DataFrame:
    """rows with running aggregates (name: (bit_xor or sum, column)) along `at` for each key, in pieces of at most `PIECE`."""
    rows = rows.withColumn("_at", at).withColumn("_piece", F.floor(F.col("_at") / PIECE))
    here = Window.partitionBy(key, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *(f(c).over(here).alias(f"_{name}") for name, (f, c) in made.items()))
    if rows.agg(F.min("_piece") < F.max("_piece")).first()[0]:
        whole = rows.groupBy(key, "_piece").agg(*(f(c).alias(name) for name, (f, c) in made.items()))
        past = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        whole = whole.select(key, "_piece", *(f(F.col(name)).over(past).alias(f"_past_{name}") for name, (f, _) in made.items()))
        local = local.join(whole, [key, "_piece"])
        past = lambda name: F.coalesce(f"_past_{name}", F.lit(0))
        both = {name: F.col(f"_{name}").bitwiseXOR(past(name)) if f is F.bit_xor else F.col(f"_{name}") + past(name) for name, (f, _) in made.items()}
    else:
        both = {name: F.col(f"_{name}") for name in made}
    kept = [c for c in rows.columns if c not in ("_piece", "_at")]
    return local.select(*kept, *(c.alias(name) for name, c in both.items()))


class Forest:
    """Shards as one LOUDS forest under a super-root; rows come by shard, conversation and depth."""

    def __init__(self, shard: np.ndarray, rep: np.ndarray, depth: np.ndarray, codes: np.ndarray, words: np.ndarray, ending: np.ndarray):
        fresh = lambda *columns: np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        trees = np.cumsum(fresh(shard)) - 1
        starts = fresh(shard, rep)
        line = np.cumsum(starts) - 1  # the conversation
        level = depth - depth[starts][line]
        node = np.empty(len(rep), np.int64)
        at = trees[starts].copy()  # where each conversation stands: its tree, then a node
        order = np.lexsort((line, level))
        self.levels, tops, parents, labels, base = [0], [], [], [], 0
        for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
            own, label = at[line[part]], codes[part]
            by = np.lexsort((label[:, 1], label[:, 0], own))
            first = fresh(own[by], label[by, 0], label[by, 1])
            node[part[by]] = at[line[part[by]]] = base + np.cumsum(first) - 1
            tops.append(part[by][first])
            parents.append(own[by][first] + (1 if base else 0))
            labels.append(label[by][first])
            base += int(first.sum())
            self.levels.append(base)
        shown, self.labels = np.concatenate(tops), np.concatenate(labels)
        # The super-root's children are the trees; node i stands at i + 1.
        up = np.concatenate([np.zeros(len(parents[0]), np.int64), *parents[1:]])
        counts = np.bincount(up, minlength=base + 1)
        self.bits = np.ones(2 * base + 1, bool)
        self.bits[np.cumsum(counts) + np.arange(base + 1)] = False
        self.parent = np.flatnonzero(self.bits) - np.arange(base) - 1  # zeros before a node's one, from the super-root's -1
        self.depth, self.words, self.children = depth[shown], words[shown], counts[1:]
        self.shown, ends = shown, np.flatnonzero(ending)
        self.convs, self.first, self.end = np.zeros(base, np.int64), np.full(base, np.iinfo(np.int64).max), np.full(base, -1)
        np.add.at(self.convs, node[ends], ending[ends])
        np.minimum.at(self.first, node, rep)
        self.end[node[ends]] = ends
        self.up(self.convs)
        self.leaves = (self.children == 0).astype(np.int64)
        self.saved = (self.convs - 1) * self.words
        self.up(self.leaves)
        self.up(self.saved)

    def up(self, values: np.ndarray) -> None:
        """Add each node's sum to its parent's, from the last level to the second."""
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(values, self.parent[lo:hi], values[lo:hi])


def shards(rows: DataFrame) -> DataFrame:
    """Nodes of all shards; `top` marks those whose parent (p1, p2) is an upper node."""
    kinds = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, top boolean, p1 long, p2 long"
    names = [x.split()[0] for x in kinds.split(", ")]
    rows = rows.select("s1", "s2", "rep", "depth", "code", "words", "ending", "u1", "u2")

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        s1, rep, depth, words, ending, u1, u2 = (t[c].to_numpy() for c in ("s1", "rep", "depth", "words", "ending", "u1", "u2"))
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(-1, 2)
        f = Forest(s1, rep, depth, codes, words, ending)
        top = f.parent < 0
        ends = f.end >= 0
        columns = [f.depth, f.first, pa.array(f.first[f.parent], mask=top), f.convs, f.children, f.leaves, f.saved, pa.array(rep[f.end], mask=~ends), top, u1[f.shown], u2[f.shown]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            s1 = batch.column(0).to_numpy()
            if n >= SHARD:  # cut where a shard begins
                cuts = np.flatnonzero(s1 != np.concatenate([[held[-1].column(0)[-1].as_py()], s1[:-1]]))
                if len(cuts):
                    yield forest([*held, batch.slice(0, int(cuts[0]))])
                    batch, held, n = batch.slice(int(cuts[0])), [], 0
            held.append(batch)
            n += batch.num_rows
        if held:
            yield forest(held)

    return rows.mapInArrow(run, kinds)


def ends(members: DataFrame) -> DataFrame:
    """(end_rep, ends_sha256): the hash over the ids of each class (rep, conv_id), in order. Ids are joined where a range holds
    them, so the one task that a hash must run through gets few and large pieces."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(reps)) + 1).tolist(), len(ids)] if ids else [0]
            pairs = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([reps[a] for a, _ in pairs], pa.int64()), pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in pairs], pa.string())], names=["rep", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if rep != at:
                    if sha:
                        out.append((at, sha.hexdigest()))
                    at, sha = rep, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["end_rep", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sha.hexdigest()])], names=["end_rep", "ends_sha256"])

    rows = members.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    pieces = rows.mapInArrow(joined, "rep long, first long, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashed, "end_rep long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    rows, convs = rebuilt(conversations)
    rows = rows.withColumn("a1", F.xxhash64("code", "depth")).withColumn("a2", F.xxhash64("depth", "code", F.lit(1)))
    whole = rows = saved(running(rows, "conv_id", F.col("depth") - 1, {"p1": (F.bit_xor, "a1"), "p2": (F.bit_xor, "a2")}), "rebuilt")
    last = convs.join(rows.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end")), "conv_id", "left")
    zero = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    last = saved(last.select("conv_id", F.coalesce("end", zero).alias("end")), "ends")
    classes = saved(last.groupBy("end").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "classes")
    members = lookup(last, "end", classes.select("end", "rep", "n"), last.count())
    reps = classes.select("rep", F.col("end.depth").alias("length"), F.col("n").alias("k"))
    rows = rows.withColumnRenamed("conv_id", "rep").join(reps, "rep").withColumn("u1", F.col("p1").bitwiseXOR(F.col("a1"))).withColumn("u2", F.col("p2").bitwiseXOR(F.col("a2")))
    rows = saved(rows.select("rep", "depth", "code", "words", "p1", "p2", "u1", "u2", "length", "k"), "lines")
    drop(whole)
    total = rows.count()
    node = F.struct("depth", "p1", "p2").alias("node")
    heavy = rows.groupBy(node).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.count("*").alias("n")).where(F.col("weight") > SHARD)
    heavy = saved(heavy.select("node", F.lit(True).alias("heavy"), "n"), "heavy")
    marked = rows.withColumn("heavy", F.lit(False))
    if heavy.limit(1).count():
        marked = saved(lookup(rows.withColumn("node", node), "node", heavy, total, "left").drop("node").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "marked")
    below = marked.where(~F.col("heavy"))
    first = below.groupBy("rep").agg(F.min(F.struct("depth", "p1", "p2", "u1", "u2")).alias("s")).select("rep", F.col("s.p1").alias("s1"), F.col("s.p2").alias("s2"), F.col("s.u1").alias("u1"), F.col("s.u2").alias("u2"))
    ending = F.when(F.col("depth") == F.col("length"), F.col("k")).otherwise(0).alias("ending")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // SHARD))
    dealt = below.select("rep", "depth", "code", "words", ending).join(first, "rep").repartition(tasks, "s1", "s2").sortWithinPartitions("s1", "s2", "rep", "depth")
    lower = saved(shards(dealt), "shards")
    upper = upper_nodes(marked.where("heavy"), reps, lower.where("top"))
    parents = upper.select(F.struct("depth", "p1", "p2").alias("node"), F.col("conv_id").alias("parent"), F.col("n_children").alias("n"))
    tops = lower.where("top").select(F.struct((F.col("depth") - 1).alias("depth"), "p1", "p2").alias("node"), "depth", "conv_id", *MEASURES, "end_rep")
    tops = tops.union(upper.where("depth > 0").select(F.struct((F.col("depth") - 1).alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2")).alias("node"), "depth", "conv_id", *MEASURES, "end_rep"))
    columns = ["conv_id", "depth", "parent_conv_id", *MEASURES, "end_rep"]
    nodes = lookup(tops, "node", parents, total).withColumnRenamed("parent", "parent_conv_id").select(*columns)
    nodes = nodes.union(lower.where("not top").select(*columns))
    nodes = nodes.union(upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    inner = nodes.where("end_rep is null").select(*columns[:-1], F.lit(EMPTY).alias("ends_sha256"))
    return inner.union(nodes.where("end_rep is not null").join(ends(members), "end_rep").select(*columns[:-1], "ends_sha256"))


def upper_nodes(heavy: DataFrame, reps: DataFrame, tops: DataFrame) -> DataFrame:
    """(depth, p1, p2, u1, u2, conv_id, n_convs, n_children, n_leaves, saved_tokens, end_rep) of the root and the heavy nodes."""
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", "words", "p1", "p2", "u1", "u2")]
    columns = ["rep", "depth", "words", "p1", "p2", "u1", "u2", "length", "k"]
    lines = heavy.select(*columns).union(reps.select("rep", *nothing, "length", "k"))
    key = ["depth", "p1", "p2"]
    found = lines.groupBy(*key).agg(F.min("rep").alias("conv_id"), F.sum("k").alias("n_convs"), F.max(F.when(F.col("depth") == F.col("length"), F.col("rep"))).alias("end_rep"), F.max("words").alias("words"), F.max("u1").alias("u1"), F.max("u2").alias("u2"))
    found = saved(found, "upper")
    born = found.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2"))
    born = born.union(tops.select((F.col("depth") - 1).alias("depth"), "p1", "p2")).groupBy(*key).agg(F.count("*").alias("n_children"))
    found = saved(found.join(born, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "upper")
    adds = found.select(F.col("conv_id").alias("rep"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    adds = adds.union(tops.select(F.col("conv_id").alias("rep"), F.col("depth") - 1, "n_leaves", "saved_tokens")).groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    along = lines.select("rep", *key).join(adds, ["rep", "depth"], "left").fillna(0, ["leaves", "saved"])
    sums = running(along, "rep", F.lit(DEEPEST) - F.col("depth"), {"n_leaves": (F.sum, "leaves"), "saved_tokens": (F.sum, "saved")})
    sums = sums.groupBy(*key).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return saved(found.join(sums, key), "upper")


def op12(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))

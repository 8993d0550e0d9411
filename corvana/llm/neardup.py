"""Near-duplicate documents: chosen-path set similarity join over word shingles.

Equal shingle sets are one vertex from the start. Every other document carries `SIGNATURE` minwise tokens of its set. A
tree sends it down chosen paths: at each node one or two positions are drawn from the node's own seed, and a document goes
on to the child named by its token there (1.25 children on average, one over the threshold: pairs at the threshold or above
survive, others die out). A path depends only on its node and the document, so each document finds its own paths, in
`TREES` independent trees. Nodes of up to `NODE` documents at a depth are compared exhaustively, by signature. In a larger
node all documents are compared with about `FEW` pivots of it. A document that agrees with a pivot in `SETTLED` positions is
done there: whoever agrees with it in `LEAST` positions agrees with the pivot in `SETTLED + LEAST - SIGNATURE` at the least, and
all that do are linked to the pivot. The documents which no pivot settles branch on, in `AGAIN` independent subtrees each.

What comes out of the nodes is a loose graph (a spanning forest of all pairs in a node whose signatures agree enough, the
links to pivots, and in a node that is still large at the last depth, all with its smallest). Its components hold every pair
that met. Within a component, links are confirmed on the full sets, all pairs but those which are connected already or which
the triangle inequality of the Jaccard distance excludes. A large component is dealt over sub-blocks that share some pivots;
documents which are then still outside its largest class are compared with all of the component, in blocks. So no cap on
partners loses a link of documents that met.

Recall: a pair of similarity 0.8 meets with probability 0.9998 where its nodes of depth 3 are small or settle it, 0.9995 where
it has to reach depth 6 and 0.9993 where it has to reach depth 9, by the branching and with the spread of the one signature
that all trees share; higher similarity does better. `tests/llm` measure it by depth, and hold results against brute force.

Defined results: texts that are null, empty or without words have no shingle and link with nothing. A text with fewer
words than a shingle is one shingle of all its words. Repeated rows and equal texts are in one class. Rows that share a
doc_id are documents of their own, each with the class of its own text. Rows with a null doc_id are classes of their own
with a null id and are kept. Long texts are taken whole. Empty tables give empty results. Other columns are ignored by
`classes`, whatever their names, and pass through `keep_one` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, ascii_words, drop, lookup, mixed, saved, shingles, table, text_bytes
from .components import components

SIGNATURE, TREES, AGAIN, DEPTHS = 64, 10, 3, (3, 6, 9)
#: Documents of a node that are compared exhaustively; of a component that one task confirms, and the bytes of their texts.
NODE, TASK, TASK_BYTES, PIVOTS = 128, 750, 64_000_000, 24
#: Signature positions that must agree for a loose edge: five standard deviations under the threshold.
LOOSE = 0.25
#: Pivots of a larger node, on average, and the share of positions by which one settles a document.
FEW, SETTLED = 8, 0.75
#: Pivots are first by this seed's hash, and components of their links begin by it.
PLACE = 17
U = np.uint64
SEEDS = mixed(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def signature(codes: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set, 32 bits each."""
    out = np.full(SIGNATURE, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(codes), 4096):
        part = codes[at : at + 4096]
        out = np.minimum(out, ((part[None, :] * SEEDS[:, None]) >> U(32)).astype(np.uint32).min(1))
    return out


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, body, n_shingles, print, sig): a code of the text, 128 bits that stand for its set, and its minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            n, prints, sigs = [], [], []
            for text in text_bytes(batch.column(2)):
                found = shingles(codes.of(ascii_words(text)), size)
                codes.settle()
                n.append(len(found))
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "body", "n_shingles", "print", "sig"])

    return docs.select("doc_id", "body", "text").mapInArrow(run, "doc_id long, body long, n_shingles long, print binary, sig binary")


def deeper(sig: np.ndarray, owner: np.ndarray, node: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths `levels` further: rows of sig by owner, and the nodes they reach."""
    for _ in range(levels):
        draw = mixed(node)
        first = (draw % U(SIGNATURE)).astype(np.int64)
        second = ((draw >> U(20)) % U(SIGNATURE - 1)).astype(np.int64)
        second += second >= first
        two = (draw >> U(40)) % U(4) == 0  # a fourth of all nodes draw two positions
        step = lambda who, at, pos: mixed(mixed(at ^ U(0x51ED270B)) + sig[who, pos].astype(np.uint64) + (pos.astype(np.uint64) << U(40)))
        owner, node = np.concatenate([owner, owner[two]]), np.concatenate([step(owner, node, first), step(owner[two], node[two], second[two])])
    return owner, node


def paths(rows: DataFrame, levels: int) -> DataFrame:
    """(node, rep) after `levels` more levels, from (rep, sig) at the roots or (rep, sig, node) further down, where each node
    is the root of `AGAIN` subtrees: pairs that die out in one of them have the others."""
    below = "node" in rows.columns
    rows = rows.select("rep", "sig", "node") if below else rows.select("rep", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            reps = batch.column(0).to_numpy()
            if below:
                roots = mixed(np.arange(1, AGAIN + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
                owner, node = np.tile(np.arange(len(reps)), AGAIN), mixed(batch.column(2).to_numpy().view(np.uint64)[None, :] ^ roots[:, None]).ravel()
            else:
                owner, node = np.repeat(np.arange(len(reps)), TREES), np.tile(mixed(np.arange(1, TREES + 1, dtype=np.uint64)), len(reps))
            owner, node = deeper(sig, owner, node, levels)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(reps[owner])], names=["node", "rep"])

    return rows.mapInArrow(run, "node long, rep long").distinct() if below else rows.mapInArrow(run, "node long, rep long")


def forest(similar) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix."""
    n, left, out = len(similar), np.ones(len(similar), bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(similar[at] & left)
            left[new] = False
            out += [(at, x) for x in new]
            queue += new.tolist()
    return out


def root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        x = y
    return x


def settled(large: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, rep, sig, n) of larger nodes against the pivots of each: links (a, b), and (rep, sig, node) left to branch."""
    done = int(SIGNATURE * SETTLED)
    near = done + least - SIGNATURE
    place = F.xxhash64("rep", F.lit(PLACE)).cast("double") / 2.0**64 + 0.5  # even on 0 to 1, the same in every node
    pivots = large.where(place * F.col("n") < FEW).groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("rep", F.lit(PLACE)).alias("h"), "rep", "sig"))).alias("p"))  # FEW on average
    pivots = pivots.select("node", F.col("p.rep").alias("p"), F.col("p.sig").alias("p_sigs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, up = [], [], [], {}
            for k, (rep, sig, ids, sigs) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                agree = (np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, SIGNATURE) == np.frombuffer(sig, np.uint32)).sum(1) if ids else np.zeros(0, np.int64)
                linked = [ids[x] for x in np.flatnonzero(agree >= near) if ids[x] != rep]
                # One link for the document, to the pivot that is first in every node; its others are linked to that one once a batch.
                for x in linked:
                    one, other = root(up, linked[0]), root(up, x)
                    if x == linked[0] or one != other:
                        up[other] = one
                        a.append(linked[0])
                        b.append(rep if x == linked[0] else x)
                if not (agree >= done).any():
                    left.append(k)
            n = len(a)
            rest = batch.take(pa.array(left, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), rest.column(1)]), pa.array([*b, *[None] * len(left)], pa.int64()), pa.concat_arrays([pa.nulls(n, pa.binary()), rest.column(2)]), pa.concat_arrays([pa.nulls(n, pa.int64()), rest.column(0)])],
                names=["a", "b", "sig", "node"],
            )

    met = saved(large.join(pivots, "node", "left").select("node", "rep", "sig", "p", "p_sigs").mapInArrow(compare, "a long, b long, sig binary, node long"), "settled")
    return met.where("b is not null").select("a", "b").distinct(), met.where("b is null").select(F.col("a").alias("rep"), "sig", "node")


def loose_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges whose components hold all pairs of documents that met in a node and may be similar."""
    least = int(SIGNATURE * (threshold - LOOSE))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for ids, sigs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, SIGNATURE)
                agree = np.array([(sig == row).sum(1) >= least for row in sig])
                for x, y in forest(agree):
                    a.append(ids[x])
                    b.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found, at = [], paths(reps, DEPTHS[0])
    for depth, below in zip(DEPTHS, [*DEPTHS[1:], None], strict=True):
        met = saved(at, "paths")
        counts = saved(met.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1"), "nodes")
        small = met.join(counts.where(F.col("n") <= NODE).select("node"), "node").join(reps, "rep")
        grouped = small.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rep", "sig"))).alias("g")).select(F.col("g.rep").alias("ids"), F.col("g.sig").alias("sigs"))  # at most NODE rows each
        found.append(saved(grouped.mapInArrow(compare, "a long, b long").distinct(), "loose"))
        many = counts.where(F.col("n") > NODE)
        if many.limit(1).count():
            links, left = settled(met.join(many.select("node", "n"), "node").join(reps, "rep").select("node", "rep", "sig", "n"), least)
            found.append(links)
            if below is None:
                found.append(left.join(many.select("node", "least"), "node").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
            else:
                at = paths(left, below - depth)
                drop(met, counts)
                continue
        drop(met)
        break
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


class Classes:
    """Union-find over positions; the smallest stands for its class."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def confirmed(found: list[np.ndarray], asked: range | None, percent: int) -> np.ndarray:
    """Classes of sets under 100 * intersection >= percent * union, over all pairs with one end in `asked`.

    Pairs within a class are not compared again. The Jaccard distance is a metric: what each pivot's distances exclude
    needs no comparison either."""
    n = len(found)
    sizes = np.array([len(x) for x in found])
    everything, members = np.unique(np.concatenate(found), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    classes, far = Classes(n), 1 - percent / 100 + 1e-9
    pivots: list[np.ndarray] = []
    for i in asked or range(n):
        rest = np.flatnonzero(classes.roots() != classes.root(i))
        if asked is None:
            rest = rest[rest > i]
        rest = rest[(100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)]
        for d in pivots:
            rest = rest[np.abs(d[rest] - d[i]) <= far]
        if not len(rest):
            continue
        mark = np.zeros(len(everything), bool)
        mark[members[starts[i] : starts[i] + sizes[i]]] = True
        if len(members) < 2000 * len(rest):  # one pass over all sets costs less than one step for each
            common = np.add.reduceat(mark[members], starts)
            if len(rest) > n // 2 and len(pivots) < 12:
                pivots.append(1 - common / (sizes + sizes[i] - common))
            common = common[rest]
        else:
            common = np.array([np.count_nonzero(mark[members[starts[j] : starts[j] + sizes[j]]]) for j in rest])
        for j in rest[100 * common >= percent * (sizes[rest] + sizes[i] - common)]:
            classes.join(i, int(j))
    return classes.roots()


def grouped_links(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links confirmed within each group of rows (group, rep, asks, text), as a spanning star of each class. Where some
    rows of a group ask, only pairs with one of them count. Each group fits one task; rows stream in by group."""
    rows = rows.select("group", "asks", "rep", "text")

    def links(held: list[tuple], codes: WordCodes) -> tuple[list[int], list[int]]:
        held.sort(key=lambda x: (not x[0], x[1]))
        ids = [x[1] for x in held]
        found = [shingles(codes.of(ascii_words(x[2])), size) for x in held]
        codes.settle()
        asking = sum(x[0] for x in held)
        roots = confirmed(found, range(asking) if 0 < asking < len(held) else None, percent)
        pairs = [(ids[r], ids[k]) for k, r in enumerate(roots) if r != k]
        return [x for x, _ in pairs], [y for _, y in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, last = WordCodes(), [], None
        for batch in batches:
            a, b = [], []
            for group, asks, rep, text in zip(*(batch.column(k).to_pylist() for k in range(3)), text_bytes(batch.column(3)), strict=True):
                if group != last and held:
                    x, y = links(held, codes)
                    a, b, held = a + x, b + y, []
                last = group
                held.append((asks, rep, text))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held:
            a, b = links(held, codes)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def classed(docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, body, n_shingles, print) that have shingles and an id, with `component` and `component_id`; and those that
    have not. A vertex is a set of shingles, whatever rows have it; its number is given when the sets are written."""
    percent = round(100 * threshold)
    docs = with_body(docs).select("doc_id", "body", "text")
    every = saved(sets(docs, size), "sets")
    owned = every.where("n_shingles > 0 and doc_id is not null")
    reps = owned.groupBy("print").agg(F.min(F.struct("doc_id", "body")).alias("first"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    reps = saved(reps.select("print", "first.*", "sig", "n", F.monotonically_increasing_id().alias("rep")), "reps")
    loose = components(loose_edges(reps.select("rep", "sig"), threshold), PLACE).withColumnRenamed("v", "rep").withColumnRenamed("root", "loose")
    wanted = reps.select("rep", "doc_id", "body").join(loose, "rep")
    held = saved(docs.join(wanted, ["doc_id", "body"]).select("rep", "loose", "text").dropDuplicates(["rep"]), "texts")  # equal rows: one text
    sizes = held.groupBy("loose").agg(F.greatest(F.ceil(F.count("*") / TASK), F.ceil(F.sum(F.octet_length("text")) / TASK_BYTES)).cast("int").alias("parts"), F.count("*").alias("n"))
    sizes = saved(sizes, "sizes")
    held = lookup(held, "loose", sizes.select("loose", "parts", F.col("n").alias("size"), "n"), held.count())
    small = held.where("parts = 1").select(F.struct("loose", F.lit(0).alias("x"), F.lit(0).alias("y")).alias("group"), F.lit(False).alias("asks"), "rep", "text")
    edges = grouped_links(small, size, percent)
    if sizes.where("parts > 1").limit(1).count():
        edges = saved(edges, "links").union(large_links(saved(held.where("parts > 1"), "large"), size, percent))
    final = components(edges).withColumnRenamed("v", "rep")
    rooted = reps.join(final, "rep", "left").select("print", "doc_id", "n", F.coalesce("root", "rep").alias("component"))
    least = saved(rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    chosen = saved(lookup(rooted.withColumnRenamed("n", "rows"), "component", least, reps.count()).select("print", "component", "component_id", F.col("rows").alias("n")), "chosen")
    linked = lookup(owned.select("doc_id", "body", "n_shingles", "print"), "print", chosen, every.count())
    return linked, every.where("n_shingles = 0 or doc_id is null").select("doc_id", "body", "n_shingles")


def with_body(docs: DataFrame) -> DataFrame:
    """docs with `body`, a code of the text: rows of one doc_id are told apart by it."""
    return docs.withColumn("body", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    linked, alone = classed(docs.select("doc_id", "text"), size, threshold)
    return linked.select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def large_links(held: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of components that no single task takes: sub-blocks with shared pivots, then all outside the largest class
    against everything."""
    blocks = F.col("parts")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    share = held.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("size")) < PIVOTS)
    pivots = share.withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1))).select(F.struct("loose", "x", F.lit(0).alias("y")).alias("group"), F.lit(False).alias("asks"), "rep", "text")
    own = held.select(F.struct("loose", block.alias("x"), F.lit(0).alias("y")).alias("group"), F.lit(False).alias("asks"), "rep", "text")
    first = saved(grouped_links(own.unionByName(pivots).dropDuplicates(["group", "rep"]), size, percent), "links")
    roots = components(first)
    rooted = saved(held.select("rep", "loose").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("rep", "loose", F.coalesce("root", "rep").alias("root")), "classes")
    largest = rooted.groupBy("loose", "root").agg(F.count("*").alias("k")).groupBy("loose").agg(F.max_by("root", "k").alias("largest"))
    # As many components as that have many texts each: few, and so is what is joined by component from here on.
    outside = saved(rooted.join(largest, "loose").where("root <> largest").select("rep"), "outside")
    chunked = held.join(outside, "rep", "left_semi")
    chunks = chunked.groupBy("loose").agg(F.greatest(F.ceil(F.count("*") / TASK), F.ceil(F.sum(F.octet_length("text")) / TASK_BYTES)).cast("int").alias("chunks"))
    asks = chunked.join(chunks, "loose").withColumn("y", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int"))
    asks = asks.withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1))).select(F.struct("loose", "x", "y").alias("group"), F.lit(True).alias("asks"), "rep", "text")
    told = held.join(chunks, "loose").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(F.struct("loose", block.alias("x"), "y").alias("group"), F.lit(False).alias("asks"), "rep", "text")
    return first.union(grouped_links(asks.unionByName(told.join(outside, "rep", "left_anti")), size, percent)).union(grouped_links_among(asks, size, percent))


def grouped_links_among(asks: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the asking rows themselves, chunk against chunk."""
    rows = asks.where("group.x = 0").select(F.col("group.loose").alias("loose"), F.col("group.y").alias("y"), "rep", "text")
    others = rows.groupBy("loose").agg((F.max("y") + 1).alias("chunks"))
    rows = rows.join(others, "loose").withColumn("z", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = F.struct("loose", F.least("y", "z").alias("x"), F.greatest("y", "z").alias("y")).alias("group")
    return grouped_links(rows.select(group, F.lit(False).alias("asks"), "rep", "text"), size, percent)


def op4(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), 2, 0.8)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class stays, the one with the smallest doc_id (of these, the smallest text code). Rows
    without an id or without a word all stay."""
    columns = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    linked, _ = classed(docs.select("doc_id", "text"), 5, 0.8)
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "body")).alias("first")).select("first.*")
    times = linked.groupBy("doc_id", "body").agg(F.count("*").alias("times"))
    judged = saved(times.join(first.withColumn("stays", F.lit(True)), ["doc_id", "body"], "left"), "judged")
    rows = with_body(docs.select(own, "doc_id", "text")).select("_row", "doc_id", "body").join(judged, ["doc_id", "body"], "left")
    # Rows without a judgement have no id or no word. Of rows equal in id and text one stays.
    alone = rows.where("times is null or stays and times = 1").select("_row")
    repeated = rows.where("stays and times > 1").dropDuplicates(["doc_id", "body"]).select("_row")
    return alone.union(repeated).select("_row.*")

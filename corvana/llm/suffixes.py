"""Removal of repeated byte windows: a depth-limited radix sort of suffixes, most significant digits first.

Which windows of `length` bytes occur twice is what an order of all suffixes through that depth would show. The passes here
deal suffixes by one digit after the other; a suffix that stands alone after a pass is never looked at again, and what is
equal through the last digit is repeated. Suffixes travel in runs, not byte by byte:

1. The first digit is a suffix's anchor: of the 32-byte strings in its window, the one with the smallest code, the leftmost
   of equals. Equal windows have equal anchors at equal places. The suffixes that share an anchor are neighbours in the text,
   about 85 of them, and form one run. Runs whose anchor occurs at one place only drop out.
2. The second digit is all that the windows of a run cover. Where that is equal, all of them repeat.
3. Of runs that share an anchor and differ around it, one of each kind goes on, cut into aligned blocks of 64, then 16, 4 and 1
   suffixes. The digit is what all windows of a block share. Blocks that stand alone by it drop out, blocks that cover equal
   bytes are repeated, and one of each other kind goes on, cut finer. Blocks of one suffix are equal through `length` bytes
   or alone.

No pass needs the rows of a digit together: rows of a kind are counted, and hot digits are looked up by broadcast of a bounded
number of them. Digits are compared by 64-bit codes, texts by 128 bits. A text that several rows have is all repeated if it has
a window, and sorted as one.

Defined results: null text is the empty text and has no window, as have texts shorter than `length`. Matches never cross
documents. Repeated rows are copies of each other, and all their windows repeat. Texts of any size are taken whole. An empty
table gives an empty result. Other columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, lookup, mixed, saved, table, text_bytes, text_key

GRAM = 32
#: Bytes of text that a worker takes at a time; a longer text is taken whole.
SEGMENT = 400_000
#: Texts whose repetition a task remembers before it starts afresh.
SEEN = 1_000_000
#: Windows of a block in each pass over larger anchors; the last is the window itself.
BLOCKS = (64, 16, 4, 1)
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64)) | U(1)
PLACE = U((1 << 31) - 1)


class Codes:
    """64-bit polynomial codes of any part of a buffer."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, buffer: bytes):
        n = len(buffer) + 1
        if len(Codes.powers) < n:
            more = max(n, SEGMENT * 2)
            Codes.powers = np.cumprod(np.concatenate([[U(1)], np.full(more, U(BASE))]), dtype=np.uint64)
            Codes.inverses = np.cumprod(np.concatenate([[U(1)], np.full(more, U(pow(BASE, -1, 1 << 64)))]), dtype=np.uint64)
        sums = LETTERS[np.frombuffer(buffer, np.uint8)] * Codes.powers[: n - 1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)])

    def of(self, begin, end):
        return mixed((self.sums[end] - self.sums[begin]) * Codes.inverses[begin] + (end - begin).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Of each run of `size` bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * Codes.inverses[:n] + U(size))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (size - reach)], x[size - reach :]) if reach < size else x


def anchors(texts: list[bytes], length: int):
    """(text, anchor code, context code, first window, anchor's distance from it, windows) of every anchor."""
    buffer, sizes = b"".join(texts), np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if len(buffer) < length:
        return (np.zeros(0, np.int64),) * 6
    codes = Codes(buffer)
    grams = codes.every(GRAM)
    keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(keys, length - GRAM + 1) & PLACE).astype(np.int64)
    edges = np.zeros(len(buffer) + 1, np.int8)
    has = sizes >= length
    edges[begins[has]] += 1
    edges[ends[has] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edges, dtype=np.int8)[: len(least)])
    at = least[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
    place, low, high = at[first], starts[first], starts[last]
    text = np.searchsorted(ends, place, "right")
    return text, grams[place].view(np.int64), codes.of(low, high + length).view(np.int64), low - begins[text], place - low, high - low + 1


def segments(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SEGMENT:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(gram, context, key, loc) of each run: loc packs the first window, the anchor's distance from it and the number of
    windows. A task gives the runs of equal texts once, or seldom more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            every = batch.column(0).to_pylist()
            new = [k for k, key in enumerate(every) if key not in seen and not seen.add(key)]
            keys, known = batch.column(0).take(pa.array(new, pa.int64())), text_bytes(batch.column(1).take(pa.array(new, pa.int64())))
            if len(seen) > SEEN:
                seen.clear()
            for at, texts in segments(known):
                text, gram, context, low, apart, n = anchors(texts, length)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), keys.take(pa.array(at + text)), pa.array(low << 20 | apart << 10 | n)], names=["gram", "context", "key", "loc"])

    return docs.select("key", "text").mapInArrow(run, "gram long, context long, key binary, loc long")


def runs(wanted: DataFrame, length: int) -> DataFrame:
    """(gram, key, place, near, far, bytes) from rows (key, text, places): an anchor's place in the text, its windows, which begin
    `near` to `far` bytes before it, and what they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, text, places in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in places:
                    low, far, n = p["loc"] >> 20, p["loc"] >> 10 & 1023, p["loc"] & 1023
                    for column, x in zip(out, (p["gram"], key, low + far, far - n + 1, far, text[low : low + n - 1 + length]), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["gram", "key", "place", "near", "far", "bytes"])

    return wanted.select("key", "text", "places").mapInArrow(run, "gram long, key binary, place long, near long, far long, bytes binary")


def digits(rows: DataFrame, size: int, length: int) -> DataFrame:
    """rows of `runs`, cut into aligned blocks of `size` suffixes: digit is what all windows of a block share, whole is what the
    row's own windows in it cover together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, _, _, near, far = (batch.column(k) if k == 1 else batch.column(k).to_numpy() for k in range(5))
            covered = batch.column(5).to_pylist()
            n = far // size - near // size + 1
            owner = np.repeat(np.arange(len(n)), n)
            least = ((near // size)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * size
            most = np.minimum(least + size - 1, length - GRAM)
            own_near, own_far = np.maximum(near[owner], least), np.minimum(far[owner], most)
            sizes = np.array([len(x) for x in covered], np.int64)
            anchor = (np.cumsum(sizes) - sizes + far)[owner]
            codes = Codes(b"".join(covered))
            shared = mixed(codes.of(anchor - least, anchor + length - most) + mixed(grams.view(np.uint64)[owner] + least.astype(np.uint64)))
            whole = mixed(shared + codes.of(anchor - own_far, anchor + length - own_near) + (own_near << 10 | own_far).astype(np.uint64))
            begin, end = far[owner] - own_far, far[owner] + length - own_near
            parts = [covered[o][i:j] for o, i, j in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True)]
            kept = [batch.column(k).take(pa.array(owner)) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64)), *kept, pa.array(own_near), pa.array(own_far), pa.array(parts, pa.binary())], names=["digit", "whole", "gram", "key", "place", "near", "far", "bytes"])

    return rows.select("gram", "key", "place", "near", "far", "bytes").mapInArrow(run, "digit long, whole long, gram long, key binary, place long, near long, far long, bytes binary")


def passes(rows: DataFrame, length: int) -> list[DataFrame]:
    """Ranges (key, low, high) of repeated windows among the rows of `runs`, pass by pass."""
    found = []
    for size in BLOCKS:
        level = saved(digits(rows, size, length), "digits")
        kinds = level.groupBy("digit", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "near", "far", "gram", "bytes")).alias("one"))
        kinds = saved(kinds, "kinds")
        equal = lookup(level.select("whole", "key", "place", "near", "far"), "whole", kinds.where("n > 1").select("whole", "n"), level.count())
        found.append(saved(equal.select("key", (F.col("place") - F.col("far")).alias("low"), (F.col("place") - F.col("near")).alias("high")), "ranges"))
        drop(level)
        split = kinds.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1")
        rows = lookup(kinds.select("digit", "one"), "digit", split, kinds.count()).select("one.*")
    return found


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """docs(key, text) to (key, ranges, whole, n), absent if nothing of a text repeats: the starts of windows that occur
    elsewhere too, as ranges; or whole, where n rows have the text and it has a window."""
    times = docs.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"))
    copies = saved(times.where((F.col("n") > 1) & (F.col("size") >= length)).select("key", "n"), "copies")
    spot = F.xxhash64("key", "loc")
    every = saved(anchor_rows(docs, length), "anchors")
    n = every.count()
    shared = every.groupBy("gram").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("n")).where("a <> b").select("gram", "n")
    matched = saved(lookup(every, "gram", saved(shared, "grams"), n).select("gram", F.xxhash64("gram", "context").alias("run"), "key", "loc"), "matched")
    drop(every)
    around = matched.groupBy("run").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("n"), F.min(F.struct("key", "loc", "gram")).alias("one"))
    around = saved(around, "around")
    equal = lookup(matched.select("run", "key", "loc"), "run", around.where("a <> b").select("run", "n"), n)
    low = F.shiftright("loc", 20)
    found = [equal.select("key", low.alias("low"), (low + F.col("loc").bitwiseAND(F.lit(1023)) - 1).alias("high"))]
    kinds = around.groupBy("one.gram").agg(F.count("*").alias("n")).where("n > 1")
    left = lookup(around.select("one.gram", "one.key", "one.loc"), "gram", kinds, n)
    wanted = saved(left.groupBy("key").agg(F.collect_list(F.struct("gram", "loc")).alias("places"), F.lit(1).alias("n")), "wanted")  # at most a text's own runs
    total = docs.count()
    texts = wanted.join(copies.select("key", F.col("n").alias("rows")), "key", "left").select("key", "places", F.coalesce("rows", "n").alias("n"))
    held = lookup(docs.select("key", "text"), "key", texts, total)
    found += passes(runs(held, length).dropDuplicates(["gram", "key", "place"]), length)
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.union(more)
    # A text that several rows have needs no ranges, and there may be very many rows of it.
    few = ranges.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    whole = copies.select("key", F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("ranges"), F.lit(True).alias("whole"), "n")
    return saved(few.select("key", "ranges", F.lit(False).alias("whole"), F.lit(1).cast("long").alias("n")).union(whole), "found")


def cut(text: bytes, ranges: list[dict] | None, length: int, whole: bool = False) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, and maximal removed runs."""
    if whole:
        return b"", len(text), 1
    if not ranges:
        return text, 0, 0
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, [r["low"] for r in ranges], 1)
    np.add.at(edges, [r["high"] + length for r in ranges], -1)
    gone = np.cumsum(edges)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): each row of docs as a struct, and what is left of its text's UTF-8 bytes."""
    found = repeated(docs.select(text_key().alias("key"), "text"), length)
    keyed = docs.select(text_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([keyed.schema["row"], *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(0).field("text"))
            done = [cut(t, r, length, bool(w)) for t, r, w in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kept, removed, spans = zip(*done, strict=True) if done else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return lookup(keyed, "key", found, docs.count(), "left").select("row", "ranges", "whole").mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def strip_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the bytes that repeat; where a cut splits a character, its other bytes go too."""

    @F.pandas_udf("string")
    def readable(kept):
        return kept.map(lambda x: x.decode("utf-8", "ignore"))

    done = without_repeats(docs, 200).withColumn("kept_text", readable("kept"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))

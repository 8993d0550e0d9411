"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Learning takes a bounded sample of labelled rows (`SAMPLE`, the smallest hashes of doc_id), never those of the held-out
fold (crc32(doc_id) mod 5 = 0). Words and word beginnings of the sample are counted by fold and label in Spark; the ones
that lean to one label are the learned lexicon, beside a short fixed one. Features of the sample's rows use a lexicon that
was counted without their own fold. Trees are grown by histogram, on all of the sample; for the calibration every row is
scored by trees grown without its fold, and adjacent violators are pooled. The sample bounds the model (trees, knots,
lexicon), which is broadcast; scoring is one pass over all texts without a shuffle.

Defined results: null and empty text get the score of a text without words. Label rows with null are ignored; of several
labels of a document the largest holds. A table without labelled rows of both kinds scores by the fixed lexicon alone.
Repeated rows get equal scores. Rows with a null doc_id count as held out. Texts are read whole. An empty table gives an
empty result. `score` puts its result in place of a column `score`; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

SAMPLE, CACHE = 12_000, 200_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 60, 3, 32, 0.2, 5
#: Insults, and the second person, in the corpus's four languages.
INSULTS = """idiot idiots moron morons stupid dumb loser losers pathetic scum worthless trash garbage clown disgusting vermin filth filthy
retard imbecile jerk bastard bitch asshole shit fuck fucking damn crap hate kill ugly fool dumbass
dumm idioten trottel abschaum arschloch scheisse scheiße blödmann depp verlierer widerlich hässlich
imbécile connard salope merde crétin débile ordure stupide abruti minable
idiota estúpido imbécil basura mierda cabrón pendejo asqueroso inútil payaso patético""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes su".split()
WORDS = re.compile(r"[^\W_]+(?:[@$!*.\-'][^\W_]+)*").findall
CAPITALS, SIGNS = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall, re.compile(r"[#*$%&|<>]").findall
LEET = str.maketrans("013457@$!", "oieastasi", "*.-'")
PREFIXES = (4, 5)
FEATURES = 18


def grams_of(word: str) -> list[str]:
    return [f"={word}", *(f"{k}{word[:k]}" for k in PREFIXES if len(word) > k)]


def plain(word: str) -> str:
    """A word without obfuscation: `1d.i0t` is `idiot`."""
    return word if word.isalpha() else word.translate(LEET)


def fold(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 5, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """(fold, label, text): at most `most` labelled documents outside the held-out fold, the first text of each doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = known.where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # in each task first, so no id's rows come together
    return saved(rows.select(fold().cast("int").alias("fold"), "label", "text"), "sample")


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, fold, label, n): documents of the sample that have the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for f, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.update((g, f, label) for g in {g for w in set(WORDS(text.lower())) for g in grams_of(plain(w))})
        columns = zip(*seen, strict=True) if seen else ([], [], [])
        grams, folds, labels = columns
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(folds, pa.int32()), pa.array(labels, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["gram", "fold", "label", "n"])

    return sample.select("fold", "label", "text").mapInArrow(run, "gram string, fold int, label int, n long").groupBy("gram", "fold", "label").agg(F.sum("n").alias("n"))


def learned_lexicon(sample: DataFrame) -> tuple[dict[str, list[float]], dict]:
    """Gram: its leaning without fold 0, 1, .. 4 (without fold 0: in the whole sample); and rows by (fold, label)."""
    sizes = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # at most 8 rows
    total = {y: sum(n for (_, l), n in sizes.items() if l == y) for y in (0, 1)}
    if not total[0] or not total[1]:
        return {}, sizes
    counts = gram_counts(sample)
    sums = counts.groupBy("gram").agg(*(F.sum(F.when((F.col("label") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{y}{f}") for y in (0, 1) for f in range(1, 5)))
    of = lambda y, out: sum(F.col(f"n{y}{f}") for f in range(1, 5) if f != out)

    def leaning(out: int):
        n = {y: sum(k for (f, l), k in sizes.items() if l == y and f != out) for y in (0, 1)}
        smooth = 0.2
        return F.log((of(1, out) + smooth) / (n[1] + 2 * smooth)) - F.log((of(0, out) + smooth) / (n[0] + 2 * smooth))

    rows = sums.where(of(1, 0) + of(0, 0) >= 2).select("gram", *(leaning(f).alias(f"l{f}") for f in range(5)), (of(1, 0) + of(0, 0)).alias("n"))
    return {r[0]: [float(x) for x in r[1:6]] for r in rows.where(F.col("l0") > 0.7).collect()}, sizes  # grams of the sample only


def least_distance(a: list[int], b: list[int], most: int = 99) -> int:
    """Least distance of a position of a to one of b, both sorted; `most` if either is empty."""
    if not a or not b:
        return most
    x, y = np.array(a), np.array(b)
    after = np.searchsorted(y, x)
    return int(np.minimum(np.abs(y[np.minimum(after, len(y) - 1)] - x), np.abs(x - y[np.maximum(after - 1, 0)])).min())


class Scales:
    """Words to features, by a lexicon that leaves one fold out."""

    def __init__(self, lexicon: dict[str, list[float]], out: int):
        self.lexicon, self.out = lexicon, out
        self.insults, self.second = set(INSULTS), set(SECOND_PERSON)
        self.known: dict[str, int] = {}
        self.kinds = [(0.0, 0.0, False, False)]

    def kind(self, word: str) -> int:
        clear = plain(word)
        own = [self.lexicon[g][self.out] if g in self.lexicon else 0.0 for g in grams_of(clear)]
        entry = (max(own[0], 0.0), max([*own[1:], 0.0]), clear in self.insults, word in self.second)
        if entry == self.kinds[0]:
            return 0
        self.kinds.append(entry)
        return len(self.kinds) - 1

    def features(self, text: str) -> list[float]:
        if len(self.known) > CACHE:
            self.known.clear()
            del self.kinds[1:]
        words, known = WORDS(text.lower()), self.known
        for w in [w for w in set(words) if w not in known]:
            known[w] = self.kind(w)
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(found)
        n, chars = max(len(words), 1), max(len(text), 1)
        hits = [(int(p), *self.kinds[found[p]]) for p in at]
        word = np.array([h[1] for h in hits] or [0.0])
        start = np.array([h[2] for h in hits] or [0.0])
        strong = [h[0] for h in hits if h[1] > 2 or h[2] > 2.5 or h[3]]
        second = [h[0] for h in hits if h[4]]
        near = least_distance(strong, second)
        upper = len(CAPITALS(text))
        odd = sum(1 for w in set(words) if not w.isalpha() and plain(w) != w and not w.isdigit())
        insults = sum(h[3] for h in hits)
        marks = text.count("!") + text.count("?")
        signs = len(SIGNS(text))
        return [
            word.max(), start.max(), np.sort(word)[-3:].sum(), np.sort(start)[-3:].sum(), word.sum() / n, start.sum() / n,
            float((word > 2).sum()), float((start > 2.5).sum()), float(insults), insults / n, len(strong) / n, float(min(near, 99)),
            len(second) / n, upper / chars, marks / chars, signs / chars, odd / n, float(np.log1p(n)),
        ]


def grow(x: np.ndarray, y: np.ndarray) -> tuple[list, list, float]:
    """(bin edges, trees, bias): logistic boosting of histogram trees."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins, n = BINS + 1, x.shape[1]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    cells = binned + np.arange(n) * bins
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    raw, trees = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, tree = np.zeros(len(y), np.int64), {}
        for depth in range(DEPTH):
            for at in range(2**depth - 1, 2 ** (depth + 1) - 1):
                rows = np.flatnonzero(node == at)
                if len(rows) < 2 * LEAST_LEAF:
                    continue
                flat = cells[rows].ravel()
                total = lambda w: np.cumsum(np.bincount(flat, None if w is None else np.repeat(w[rows], n), n * bins).reshape(n, bins), 1)  # noqa: B023, E731
                gl, hl, nl = total(g), total(h), total(None)
                gs, hs = g[rows].sum(), h[rows].sum()
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                k, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[k, cut] <= 1e-6:
                    continue
                tree[at] = (int(k), int(cut))
                node[rows] = 2 * at + 1 + (binned[rows, k] > cut)
        sums, weights = np.bincount(node, g), np.bincount(node, h)
        worth = RATE * sums / (weights + 1)
        raw += worth[node]
        trees.append((tree, {int(k): float(worth[k]) for k in np.unique(node)}))
    return edges, trees, bias


def raw_scores(model: tuple, x: np.ndarray) -> np.ndarray:
    edges, trees, bias = model
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    raw = np.full(len(x), bias)
    for tree, leaves in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            for at in [k for k in np.unique(node) if k in tree]:
                rows = node == at
                k, cut = tree[at]
                node[rows] = 2 * at + 1 + (binned[rows, k] > cut)
        raw += np.array([leaves.get(int(k), 0.0) for k in node])
    return raw


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw, probability) by pooling adjacent violators, smoothed by one row of each label at the ends."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of raw
    for r, label in [(float(raw.min()) - 0.1, 0.0), *zip(raw[order], y[order], strict=True), (float(raw.max()) + 0.1, 1.0)]:
        pools.append([label, 1.0, float(r)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / n for _, n, s in pools]), np.clip([k / n for k, n, _ in pools], 0.001, 0.999)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """The model, from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", most)
    lexicon, sizes = learned_lexicon(sample)
    if not lexicon:
        return {"lexicon": {}, "trees": None, "knots": None}
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = {f: Scales(shared.value, f) for f in range(1, 5)}
        for batch in batches:
            folds = batch.column(0).to_pylist()
            rows = [scales[f].features(t) for f, t in zip(folds, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["fold", "label", "x"])

    rows = sample.mapInArrow(measured, "fold int, label int, x array<double>").toPandas()  # at most `most` rows of FEATURES numbers
    rows = rows.iloc[np.lexsort(np.array(rows["x"].tolist()).T)]
    x, y, f = np.array(rows["x"].tolist()), (rows["label"].to_numpy() > 0).astype(float), rows["fold"].to_numpy()
    return {"lexicon": lexicon, "trees": grow(x, y), "knots": isotonic(out_of_fold(x, y, f), y)}


def out_of_fold(x: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Raw scores of each row, by trees grown without its fold; a fold that holds all rows is scored by its own."""
    raw = np.zeros(len(y))
    for k in np.unique(f):
        others = f != k if (f != k).any() else f == k
        raw[f == k] = raw_scores(grow(x[others], y[others]), x[f == k])
    return raw


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `score`, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scales = Scales(m["lexicon"], 0)
        for texts in parts:
            x = np.array([scales.features(t or "") for t in texts]).reshape(-1, FEATURES)
            if m["trees"] is None:
                yield pd.Series(np.clip(0.05 + 0.3 * x[:, 8], 0, 0.95))
            else:
                yield pd.Series(np.interp(raw_scores(m["trees"], x), *m["knots"]))

    return docs.withColumn("score", scored("text"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not predicted toxic, as they came."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns])
    return score(docs.select(own.alias("_row"), "text"), model).where("score < 0.5").select("_row.*")

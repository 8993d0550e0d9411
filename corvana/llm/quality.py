"""Quality classifier without labels: a weak-label model of heuristic labellers, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a document, from measures of its whole text. Labellers overlap: each way to be bad
(repetition, symbols, shouting, no prose) is seen by two at least. Documents are counted by their pattern of votes, over all
of the corpus (at most 3 ** labellers rows come to the driver), and expectation-maximisation over the patterns estimates each
labeller's accuracy and the share of good documents. What is known of labellers bounds it: one's bad votes meet at most
`MOST_FALSE` of good documents and at least `LEAST_SEEN` of bad ones, since each sees only some ways to be bad. Posterior labels
then train a linear scorer on hashed words and measures, on a bounded sample (`SAMPLE`, the smallest hashes); it scores
every whole text.

Defined results: null and empty text are bad by their length. Repeated rows get equal scores. Rows with a null doc_id are
scored by their text like others. A table on which all patterns agree is scored by what that pattern says. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, saved, table, text_bytes, with_row_key
from .pages import STOP_WORDS
from .rules import NOT_COUNTED, SYMBOLS, repeated_words

SAMPLE, BUCKETS, ROUNDS, EPOCHS = 6_000, 1 << 16, 50, 12
LABELLERS = ("length", "repeats", "symbols", "dup_lines", "capitals", "stop_words", "punctuation", "short_words", "variety", "stutter", "symbol_words")
MOST_FALSE, LEAST_SEEN = 0.02, 0.2
STOPS = frozenset(w.encode() for w in STOP_WORDS)
LETTERS_UP = bytes(range(65, 91))
MARKS = b"!?"
MEASURES = 11
SYMBOL_WORD = re.compile(rb"[^\w\s\x80-\xff]{3}|(?:(?<=\s)|^)[^\w\s\x80-\xff]+(?=\s|$)").findall


def measures(text: bytes, words: list[bytes], codes: np.ndarray) -> list[float]:
    n, chars = max(len(words), 1), max(len(text.translate(None, NOT_COUNTED)), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lower = text.lower().split()
    count = lambda what: len(text) - len(text.translate(None, what))
    return [
        float(len(words)), repeated_words(codes) / n, count(SYMBOLS) / chars, (len(lines) - len(set(lines))) / max(len(lines), 1), count(LETTERS_UP) / chars,
        sum(map(STOPS.__contains__, lower)) / n, count(MARKS) / n, chars / n, len(np.unique(codes)) / n,
        np.count_nonzero(codes[1:] == codes[:-1]) / n, len(SYMBOL_WORD(text)) / n,
    ]


def votes(m: np.ndarray) -> np.ndarray:
    """A row of -1 (bad), 0 (nothing), 1 (good) for each row of measures."""
    n, repeats, symbols, dup, capitals, stops, marks, length, variety, stutter, odd = m.T
    pick = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack(
        [
            pick(n >= 50, n < 10), pick(repeats < 0.02, repeats > 0.2), pick(symbols < 0.01, symbols > 0.1), pick(dup < 0.02, dup > 0.2),
            pick(capitals < 0.1, capitals > 0.3), pick(stops > 0.15, (stops < 0.03) & (n >= 20)), pick(marks < 0.03, marks > 0.3), pick((length > 3) & (length < 9), (length < 2) | (length > 14)),
            pick(variety > 0.5, (variety < 0.3) & (n >= 20) & (n < 5000)), pick(stutter < 0.02, stutter > 0.2), pick(odd < 0.01, odd > 0.1),
        ],
        1,
    )


def voted(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, pattern, k, dense): votes as digits of base three, and what the scorer reads, so that texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            k, dense, rows = zip(*[hashed(t, codes) for t in text_bytes(batch.column(2))], strict=True) if batch.num_rows else ((), (), ())
            v = votes(np.array(rows).reshape(-1, MEASURES)) + 1
            own = [pa.array(v @ 3 ** np.arange(len(LABELLERS)), pa.int64()), pa.array([x.astype(np.int32) for x in k], pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["rid", "doc_id", "pattern", "k", "dense"])

    return with_row_key(docs, "rid").select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, pattern long, k array<int>, dense array<double>")


def bounded(chance: np.ndarray) -> None:
    """Hold each labeller's chance of a bad vote in its bounds; its other votes share the rest as they did."""
    for side, bound in ((1, np.minimum(chance[:, 1, 0], MOST_FALSE)), (0, np.maximum(chance[:, 0, 0], LEAST_SEEN))):
        chance[:, side, 1:] *= ((1 - bound) / np.maximum(chance[:, side, 1:].sum(1), 1e-12))[:, None]
        chance[:, side, 0] = bound


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, each labeller's chance of each vote on bad and on good documents, share of good)."""
    cast = (patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3)[:, :, None] == np.arange(3)  # pattern, labeller, vote
    # A start by which votes mean what they say: bad votes are rare on good documents.
    chance = np.tile(np.array([[0.35, 0.35, 0.3], [0.03, 0.27, 0.7]]), (len(LABELLERS), 1, 1))  # labeller, class, vote
    share, post = 0.85, np.full(len(patterns), 0.85)
    for _ in range(rounds):
        lean = (cast * (np.log(chance[:, 1]) - np.log(chance[:, 0]))).sum((1, 2)) + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(lean, -40, 40)))
        for k, weight in enumerate(((1 - post) * counts, post * counts)):
            seen = (cast * weight[:, None, None]).sum(0)
            chance[:, k] = (seen + 1) / (seen.sum(1, keepdims=True) + 3)
        bounded(chance)
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.05, 0.95))
    return post, chance, share


def hashed(text: bytes, codes: WordCodes) -> tuple[np.ndarray, list[float], list[float]]:
    """Distinct hashed words, measures between 0 and about 1, and the measures as they are."""
    words = text.split()
    own = codes.of(words)
    m = measures(text, words, own)
    codes.settle()
    dense = [1.0, min(np.log1p(m[0]) / 8, 1.5), float(m[0] < 10), *np.minimum(np.array(m[1:7]) * 5, 2).tolist(), min(m[7] / 10, 2), *m[8:10], min(m[10] * 5, 2)]
    return np.unique(own % np.uint64(BUCKETS)).astype(np.int64), dense, m


def train(rows: list[tuple[np.ndarray, list[float], float]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of buckets and measures, by adaptive steps on the logistic loss of posterior labels."""
    w, u = np.zeros(BUCKETS), np.zeros(len(rows[0][1]) if rows else 13)
    gw, gu = np.full(BUCKETS, 1e-3), np.full(len(u), 1e-3)
    for _ in range(EPOCHS):
        for k, dense, target in rows:
            x = np.array(dense)
            scale = 1 / np.sqrt(max(len(k), 1))
            error = 1 / (1 + np.exp(-np.clip(w[k].sum() * scale + u @ x, -30, 30))) - target
            d, e = error * scale + 1e-4 * w[k], error * x
            gw[k] += d * d
            gu += e * e
            w[k] -= 0.1 * d / np.sqrt(gw[k])
            u -= 0.3 * e / np.sqrt(gu)
    return w, u


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, score, kept) of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = saved(voted(docs), "votes")
    patterns = found.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** 11 rows
    shared = spark.sparkContext.broadcast
    post = estimate(patterns["pattern"].to_numpy(np.int64), patterns["n"].to_numpy(float))[0] if len(patterns) else np.zeros(0)
    known = shared(dict(zip(patterns["pattern"].tolist(), post.tolist(), strict=True)))

    @F.pandas_udf("double")
    def posterior(pattern: pd.Series) -> pd.Series:
        return pattern.map(known.value).astype(float)

    chosen = found.select("rid", "pattern").dropDuplicates(["rid"]).orderBy("rid").limit(sample).withColumn("target", posterior("pattern")).select("rid", "target")
    rows = found.select("rid", "k", "dense").join(F.broadcast(chosen), "rid").dropDuplicates(["rid"]).toPandas().sort_values("rid")  # at most `sample` rows
    model = shared(train([(np.asarray(k, np.int64), list(d), t) for k, d, t in zip(rows["k"], rows["dense"], rows["target"], strict=True)]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, u = model.value
        for batch in (b for b in batches if b.num_rows):
            at, flat, dense = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(), batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            out = []
            for n, x in enumerate(dense):
                k = flat[at[n] : at[n + 1]]
                out.append(float(1 / (1 + np.exp(-np.clip(w[k].sum() / np.sqrt(max(len(k), 1)) + u @ x, -30, 30)))))
            believed = [known.value.get(p, 0.5) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(believed, pa.float64()), pa.array(out, pa.float64())], names=["doc_id", "posterior", "score"])

    return found.select("doc_id", "pattern", "k", "dense").mapInArrow(scored, "doc_id long, posterior double, score double").withColumn("kept", F.col("score") >= 0.5)


def op7(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))

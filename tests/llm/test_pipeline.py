"""The pipeline's stages, one after the other, against brute force over what the stage before kept."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from corvana.llm import bpe, rules, toxicity

from test_llm import linked


def words(text):
    return (text or "").split()


def measured(row):
    w = words(row["text"])
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = collections.Counter(runs)
    repeated = {i + k for i, r in enumerate(runs) if seen[r] > 1 for k in range(5)}
    lines = [x for x in (row["text"] or "").split("\n") if x.strip()]
    symbols = sum(c in "#*$%&|<>" for c in row["text"] or "")
    few, repeats = len(w) < 10, 100 * len(repeated) > 20 * len(w)
    return {"few_words": few, "repeats": repeats, "symbols": 100 * symbols > rules.MOST_SYMBOLS * sum(map(len, w)), "dup_lines": len(lines) - len(set(lines)) > rules.MOST_DUP_LINES}


def good(rows):
    flags = [measured(r) for r in rows]
    hosts = collections.defaultdict(list)
    for r, f in zip(rows, flags, strict=True):
        hosts[r["source"]].append(f)
    bad = set()
    for k, limit in rules.HOST_LIMITS.items():
        rates = [np.mean([f[k] for f in fs]) for fs in hosts.values()]
        m, v = np.mean(rates), np.var(rates, ddof=1) if len(rates) > 1 else 0.0
        weight = 1000.0 if v <= 0 else min(1000.0, max(1.0, m * (1 - m) / max(v, 1e-12) - 1))
        bad |= {h for h, fs in hosts.items() if (sum(f[k] for f in fs) + m * weight) / (len(fs) + weight) > limit}
    return [r for r, f in zip(rows, flags, strict=True) if not (f["few_words"] or f["repeats"]) and r["source"] not in bad]


def stripped(text, seen):
    t = text.encode()
    gone = np.zeros(len(t), bool)
    for i in range(len(t) - 199):
        if seen[t[i : i + 200]] > 1:
            gone[i : i + 200] = True
    return np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocabulary = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = text(60), [text(int(n)) for n in rng.integers(30, 90, 120)]
    texts = [*base, base[3], base[4], base[5] + " end", "too few words", "again and " * 40, *(f"{text(30)} {passage} {text(30)}" for _ in range(4))]
    texts += [f"you are an idiot and a moron of a {text(12)}" for _ in range(60)] + [f"$$ ## {'% ' * 90}{text(15)}" for _ in range(12)]
    rows = [(k, t, "en", "junk" if "% %" in t else f"src{k % 4}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, 1, int("idiot" in t)) for k, t in enumerate(texts) if k % 5]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_neardup", "suffix_dedup", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.common.saved(stage(spark, docs, str(tmp_path)), name)
        kept.append(sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"]))
    clean, ruled, unique, cut = kept
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(whole, toxicity.fit(whole, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert [tuple(r.values()) for r in clean] == [r for r in rows if scores[r[0]] < 0.5] and all("idiot" not in r["text"] for r in clean)
    assert ruled == good(clean) and len(ruled) < len(clean) - 2
    roots = linked([(r["doc_id"], r["text"]) for r in ruled], 5)
    assert unique == [r for r in ruled if roots[r["doc_id"]][1] == r["doc_id"]] and len(unique) < len(ruled)
    seen = collections.Counter(t[i : i + 200] for t in (r["text"].encode() for r in unique) for i in range(len(t) - 199))
    want = [r | {"text": stripped(r["text"], seen)} for r in unique]
    assert cut == [r | {"n_chars": len(r["text"])} for r in want] and cut != unique
    made, pieces = bpe.tokenizer(bpe.vocabulary_path()), collections.Counter()
    for r in cut:
        ids = [*made.encode(r["text"], add_special_tokens=False).ids, 2]
        pieces.update((at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces == collections.Counter((r["start"], r["length"], r["ids_crc32"]) for r in packed)

"""The corpus operators on small tables with nulls, empty and repeated rows, ties and clashing extra columns, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from corvana.llm import bpe, licenses, neardup, packing, pages, quality, rules, suffixes, topk, toxicity

WORDS = "the of and alpha beta gamma delta it's I'M Straße x1 <|endoftext|> 中文 12 _a! don't é %%".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, rid long, loose long, rep long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(WORDS, n)) + ("\n" if n % 3 else "")
    base = [text(n) for n in (3, 12, 60, 90, 150, 200, 400)]
    near = [re.sub(r"alpha", "alpha", base[5]) + " extra", base[6][:900] + " middle " + base[6][900:]]
    unlike = ["", None, " \n\t ", "one", "one two", "a " * 400, base[4], base[4], base[2] + base[3]]
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [*base, *near, *unlike, long]
    out = [(k, t, "en", f"src{k % 3}" if k % 4 else None, len(t or ""), 0.5, "r", 1, 2, 3) for k, t in enumerate(texts)]
    return [*out, out[4], (None, "row without id but with some words in it", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(spark, docs, rows, none):
    path = bpe.vocabulary_path()
    made = bpe.tokenizer(path)
    want = sorted((-1 if r[0] is None else r[0], tuple(made.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for head in (5, 100_000):
        import pyarrow as pa

        got = bpe.encode(docs, path, lambda ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], "ids array<int>", head_words=head)
        assert sorted((-1 if r[0] is None else r[0], tuple(r[1])) for r in got.collect()) == want
    back = bpe.decode(bpe.encode_column(docs, path), path).collect()
    assert all(r["text"] == made.decode(r["ids"], skip_special_tokens=False) for r in back)
    assert bpe.encode_column(none, path).count() == 0


def test_packing(docs, rows, none):
    path = bpe.vocabulary_path()
    made = bpe.tokenizer(path)
    got = packing.pack(docs, path, 256, 2).toPandas()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 256
    want = collections.Counter()
    for r in rows:
        ids = [*made.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want[at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert want == collections.Counter(zip(got["start"], got["length"], got["ids_crc32"], got["doc_tokens"], strict=True))
    assert packing.pack(none, path).count() == 0


def test_plan_keeps_all_pieces():
    histogram = {5: 1000, 3: 17, 1: 9, 8: 4, 16: 2}
    made = packing.plan(histogram, 16)
    assert all(sum(k * n for k, n in lengths.items()) <= 16 for _, lengths in made)
    assert all(sum(c * lengths.get(k, 0) for c, lengths in made) == n for k, n in histogram.items())


def linked(texts, size, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = {k: shingles(t) for k, t in texts}
    up = {k: k for k in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize("task", [1500, 2])
def test_neardup(docs, rows, none, monkeypatch, task):
    monkeypatch.setattr(neardup, "TASK", task)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    want = linked([(r[0], r[1]) for r in rows if r[0] is not None], 2)
    got = neardup.classes(docs, 2, 0.8).collect()
    assert len(got) == len(rows)
    assert all(want[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert neardup.classes(none, 2, 0.8).count() == 0


def test_rules(docs, rows, none):
    assert rules.repeated_words(np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5], np.uint64)) == 10
    got = rules.judge(docs).collect()
    assert len(got) == len(rows)
    empty = [r for r in got if r["n_words"] == 0]
    assert len(empty) == 3 and all(r["base_failed"] and not r["kept"] for r in empty)
    assert rules.judge(none).count() == 0
    assert rules.keep_good(None, none, "").collect() == []
    kept = rules.keep_good(None, docs, "")
    assert kept.columns == docs.columns
    by_id = collections.Counter(r["doc_id"] for r in got if r["kept"])
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == by_id


@pytest.mark.parametrize("share", [15, 30])
def test_host_of_symbol_junk(spark, share):
    """A host whose documents all hold 15 or 30 symbols per 100 word characters goes; hosts of prose stay, one junk text or not."""
    plain = [" ".join(f"{k:03}{i:03}".rjust(20, "w") for i in range(30)) for k in range(100)]
    junk = [" ".join(w[share // 5 :] + "#%$|<&*#"[: share // 5] for w in t.split()) for t in plain]
    texts = [(k, t, f"src{k % 4}") for k, t in enumerate(plain)] + [(100 + k, t, "junk") for k, t in enumerate(junk)] + [(200, junk[0], "src1")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = rules.judge(frame).collect()
    assert {100 * r["n_symbols"] / r["word_chars"] for r in got if r["doc_id"] >= 100} == {share} and not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(100, 200))
    assert {r["doc_id"] for r in rules.keep_good(None, frame, "").collect()} == {*range(100), 200}


def test_topk(spark):
    v = [(k, [float(x) for x in np.random.default_rng(k // 2).normal(size=20)]) for k in range(300)]
    v += [(301, None), (302, [1.0, None] * 10), (303, [float("nan")] * 20), (304, [float("inf")] * 20), (305, [0.5, 0.5]), (None, [1.0] * 20)]
    frame = topk.valid(spark.createDataFrame(v, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in topk.top_k(frame.where("vec_id % 100 = 0"), frame, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {k: [int(np.floor(1024 * x)) for x in e] for k, e in v[:300]}
    for q in (0, 100, 200):
        want = sorted(((k, sum(a * b for a, b in zip(whole[q], e, strict=True))) for k, e in whole.items() if k != q), key=lambda x: (-x[1], x[0]))[:10]
        assert got[q] == want
    assert topk.top_k(frame.where("false"), frame, 10).count() == 0


def test_topk_repeated_rows_and_clashing_columns(spark):
    """Equal candidates each count, one of equal queries asks, scores of 64 bits are exact, other columns do not matter."""
    big = [3_000_000_000.0, 1.0]
    rows = [(100, [1.0, 2.0], 0, 0), (100, [1.0, 2.0], 1, 1), (3, [5.0, 5.0], 2, 2), (3, [5.0, 5.0], 3, 3), (4, [5.0, 5.0], 4, 4), (200, big, 5, 5), (5, big, 6, 6)]
    frame = topk.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, q int"), 1)
    got = collections.defaultdict(list)
    for r in topk.top_k(frame.where("vec_id % 100 = 0"), frame, 4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[100] == [(5, 3_000_000_002), (200, 3_000_000_002), (3, 15), (3, 15)]
    assert got[200] == [(5, 9 * 10**18 + 1), (3, 15_000_000_005), (3, 15_000_000_005), (4, 15_000_000_005)]


def work_share(vectors, k=10):
    """Share of the dimension work done, and the result against brute force."""
    v = np.floor(1024 * vectors).astype(np.int64)
    ids = np.arange(len(v))
    search = topk.Search(ids[::100], v[::100].T, k)
    for at in range(0, len(v), 1024):
        search.meet(ids[at : at + 1024], v[at : at + 1024].T)
    whole = v[::100] @ v.T
    for j, q in enumerate(ids[::100]):
        order = [x for x in np.lexsort((ids, -whole[j])) if x != q][:k]
        assert list(search.best[j][0]) == order and list(search.best[j][1]) == list(whole[j][order])
    return search.done / search.full


def test_topk_prunes():
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centers = unit(rng.normal(size=(20, 64)))
    assert work_share(unit(centers[rng.integers(0, 20, 8000)] + 0.05 * rng.normal(size=(8000, 64)))) < 0.5
    assert work_share(unit(rng.normal(size=(8000, 64)))) < 1


def test_suffixes(docs, rows, none):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.without_repeats(docs, 200).collect()
    assert want == collections.Counter((r["n_bytes"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert suffixes.without_repeats(none, 200).count() == 0


def test_suffixes_of_many_copies(spark):
    """Copies cost no ranges; passages with differences all around them; matches within one text; neighbours of a copy."""
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefgh ij"), n))
    copy, passage = text(900), text(450)
    rows = [(k, copy) for k in range(60)] + [(100 + k, text(150) + passage[k : 450 - 2 * k] + text(100)) for k in range(40)]
    rows += [(200, passage[:199]), (201, copy[:300] + text(50)), (202, "ab" * 300), (203, passage[:200]), (204, None), (1, copy)]
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    got = collections.defaultdict(list)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = suffixes.repeated(frame.select(suffixes.text_key().alias("key"), "text"), 200)
    assert ranges.where("whole").count() == 1 and ranges.where("whole").first()["ranges"] is None
    for r in suffixes.without_repeats(frame, 200).collect():
        got[r["row"]["doc_id"]].append((r["n_removed"], r["n_spans"], bytes(r["kept"])))
    for (k, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()) in got[k]


def test_toxicity(spark, docs, rows, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    sample = spark.createDataFrame([(k, f"you are an idiot and a moron {k}" if k % 4 == 0 else f"a clean sentence about rivers {k}") for k in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, None if k == 7 else int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    found = toxicity.score(sample, toxicity.fit(sample, marks)).withColumn("held", toxicity.fold() == 0).where("held").collect()
    assert len(found) > 40 and all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in found)


def test_quality(docs, rows, none):
    got = quality.classify(docs, 50).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    empty = [r["posterior"] for r in got if r["doc_id"] in (7, 8)]
    assert len(empty) >= 2 and quality.classify(none).count() == 0


def test_quality_estimates_planted_accuracies():
    """Votes drawn from known chances: each labeller's chance of a bad vote and the share of good documents are found again."""
    rng, n, k = np.random.default_rng(6), 60_000, len(quality.LABELLERS)
    seen, false = rng.uniform(0.3, 0.9, k), rng.uniform(0.0, 0.015, k)
    good = rng.random(n) < 0.8
    bad_vote = rng.random((n, k)) < np.where(good[:, None], false, seen)
    vote = np.where(bad_vote, 0, np.where(rng.random((n, k)) < 0.9, 2, 1))
    patterns, counts = np.unique(vote @ 3 ** np.arange(k), return_counts=True)
    post, chance, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.01
    assert np.abs(chance[:, 0, 0] - seen).max() < 0.03 and np.abs(chance[:, 1, 0] - false).max() < 0.01
    found = dict(zip(patterns.tolist(), post, strict=True))
    right = np.array([found[p] >= 0.5 for p in (vote @ 3 ** np.arange(k)).tolist()]) == good
    assert right.mean() > 0.99


def test_quality_finds_each_way_to_be_bad(spark):
    rng = np.random.default_rng(1)
    prose = lambda k: "the people of the town and the river have a bridge that is old " + " ".join(f"word{x}" if x % 3 else "and" for x in rng.integers(0, 5000, 60)) + f" it is {k}."
    bad = ["Was Was Was " * 60, "### $$$ &&& " + "noise%%% more### words$$$ " * 40, "A | menu | of | many | links | " * 20, "BUY NOW!!! " * 40, ""]
    rows = [(k, prose(k)) for k in range(400)] + [(1000 + k, f"{bad[k % 5]} {k}" if k % 5 < 4 else "") for k in range(100)]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), 300).collect()}
    assert all(got[k] for k in range(400)) and not any(got[1000 + k] for k in range(100) if k % 5 < 4)


def test_licenses(spark):
    texts = ["Released under the MIT License.", "some prose\nLicensed under CC BY-NC 4.0.\nmore", "no cue at all", None, "", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "the driver license office was closed on monday"]
    got = [r["licenses"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "CC-BY-NC-4.0", "", "", "", "Apache-2.0", "GPL-3.0", ""]


def test_pages(spark, none):
    body = "This is the main text of the article and it has enough of the words that are in a list. " * 2
    page = f"""<html><head><title>t</title><script>var a="</p>";</script></head><body><div class="cookie-notice">We use cookies on this site and it is for you to say so in the end of all of it.</div>
    <nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>{body}<p>Short  one.<div class="advert">Buy the best of it now and be the first of them all in the town.</div></article>
    <section id="comments"><p>{body}</p></section><footer>&copy; x</footer></body>"""
    assert pages.main_text(page) == "\n\n".join(["Head & line", " ".join(body.split()), "Short one."])
    frame = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (4, "u", "<p>unclosed <b")], "page_id long, url string, html string")
    assert sorted(len(r["text"]) for r in pages.extract(frame).collect())[:2] == [0, 0]


def test_quality_reads_texts_once(spark):
    """What the scorer reads is kept with the votes: no plan after them reads a text."""
    rows = [(k, f"word{k} and some more words of a text {k % 7}") for k in range(40)]
    made = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), 20)._jdf.queryExecution().toString()
    assert "votes-" in made and "text" not in made


def test_rare_words_travel_once(spark, docs):
    """Rare words meet their ids by one shuffle, with no other before it to make them distinct."""
    made = bpe.encode_column(docs, bpe.vocabulary_path())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in made

"""Spelling variants against all pairs of words; automata against lists; ties, chains, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvana.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, half string, key string, root string"


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            count[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in count if apart(v, w)] for w in count}
    best = {w: min(vs, key=lambda v: (-count[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if count[v] >= 10 * count[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    letters = np.array(list("abÄéÿñ×"))
    stems = ["".join(rng.choice(letters, rng.integers(7, 15))) for _ in range(25)]
    words = list(stems)
    for stem in stems:
        for _ in range(12):
            at, how = int(rng.integers(0, len(stem))), rng.integers(0, 3)
            words.append(stem[:at] + ("" if how == 0 else str(rng.choice(letters))) + stem[at + (how < 2) :])
    out = [(k, " ".join(rng.choice(words, 40)) + " 1" + "_".join(rng.choice(stems[:5], 30))) for k in range(60)]
    out += [(100, " ".join(["abababab"] * 300 + ["abababaa"] * 25 + ["abababca"] * 2 + ["ABABABAB"] * 9)), (101, None), (102, ""), (103, "short wörd"), (None, "abababab abababab"), (104, "zzzzzzzz" * 3000 + " aaaaaaa aaaaaaab aaaaaaa aaaaaaab")]
    return [(*r, "w", 1, "h", "k", "r") for r in [*out, out[3], out[3]]]


@pytest.mark.parametrize(("group", "shard"), [(20_000, 60_000), (6, 50)])
def test_against_all_pairs(spark, rows, monkeypatch, group, shard):
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "SHARD", shard)
    got = variants.variants(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_automaton():
    rng = np.random.default_rng(2)
    names = sorted({"".join(rng.choice(list("abc"), rng.integers(7, 11))) for _ in range(900)})
    made = variants.Automaton(names)
    assert [made.number(w) for w in names] == list(range(len(names))) and made.number("abc") == -1
    assert len(made.edges) < sum(map(len, names)) / 5
    for word in names[::9]:
        assert made.near(word, 3) == {k for k, v in enumerate(names) if v[:3] == word[:3] and apart(v, word)}


def test_long_chain(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(18)]
    got = dict(variants.roots(spark.createDataFrame([*chain, ("x", "w0")], "word string, form string")).collect())
    assert set(got.values()) == {"w18"} and len(got) == 19


def test_empty(spark):
    assert variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0

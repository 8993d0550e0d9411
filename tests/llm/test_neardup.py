"""Near duplicates and components: shapes, recall by depth, large nodes, rows that share an id."""

import numpy as np
import pytest
from test_llm import linked

from corvana.llm import components, neardup


@pytest.mark.parametrize("local", [0, 100, 250_000])
def test_components_of_a_long_chain(spark, monkeypatch, local):
    """A chain of rising ids, a star, a cycle and a random forest; turns grow with the logarithm, and one task finishes what is
    small: nothing, the last hundred edges, or all."""
    turns = []
    monkeypatch.setattr(components, "LOCAL", local)
    kept = components.moves
    monkeypatch.setattr(components, "moves", lambda *a: turns.append(a[1]) or kept(*a))
    chain = [(k, k + 1) for k in range(1000)]
    star = [(5000, k) for k in range(5001, 5400)]
    cycle = [(6000 + k, 6000 + (k + 1) % 50) for k in range(50)]
    got = dict(components.components(spark.createDataFrame([*chain, *star, *cycle, (7, 7)], "a long, b long")).collect())
    assert len(turns) < 15 and (len(turns) > 1) == (local < 1000)
    assert got == {k: 0 for k in range(1001)} | {k: 5000 for k in range(5000, 5400)} | {k: 6000 for k in range(6000, 6050)}
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    up = list(range(400))
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {v: up[v] for e in edges if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_of_one_task():
    """Sorted, reversed and shuffled chains, a star around the largest, repeated edges: smallest vertex each."""
    n = 20_000
    order = np.random.default_rng(5).permutation(n).astype(np.int64)
    for chain in (np.arange(n), np.arange(n)[::-1], order):
        ids, roots = components.rooted(chain[:-1], chain[1:])
        assert len(ids) == n and (roots == 0).all()
    ids, roots = components.rooted(np.full(n, n), np.arange(n))
    assert len(ids) == n + 1 and (roots == 0).all()
    ids, roots = components.rooted(np.array([5, 5, 9, -2]), np.array([7, 7, 8, 3]))
    assert dict(zip(ids.tolist(), roots.tolist())) == {5: 5, 7: 5, 8: 8, 9: 8, -2: -2, 3: -2}


@pytest.mark.parametrize(("few", "depths"), [(0, (3,)), (0, (6,)), (0, (3, 6, 9)), (8, (3, 6, 9))])
def test_recall_by_depth(spark, monkeypatch, few, depths):
    """Planted pairs at the threshold meet: at depth 3 alone, where all must reach depth 9, and by pivots."""
    monkeypatch.setattr(neardup, "FEW", few)
    if depths == (6,):  # every pair has to go on to depth 6
        monkeypatch.setattr(neardup, "NODE", 1)
        depths = (3, 6)
    elif depths != (3,):
        monkeypatch.setattr(neardup, "NODE", 1)
    monkeypatch.setattr(neardup, "DEPTHS", depths)
    rng, n = np.random.default_rng(11), 2000
    a = rng.integers(0, 2**32, (n, neardup.SIGNATURE), dtype=np.uint32)
    other = rng.random(a.shape) >= 0.8
    b = np.where(other, rng.integers(0, 2**32, a.shape, dtype=np.uint32), a)
    rows = [(2 * k + j, bytearray(s[k].tobytes())) for k in range(n) for j, s in enumerate((a, b))]
    met = {(min(r), max(r)) for r in neardup.loose_edges(spark.createDataFrame(rows, "rep long, sig binary"), 0.8).collect()}
    assert sum((2 * k, 2 * k + 1) in met for k in range(n)) >= 0.995 * n


def test_hot_family(spark, monkeypatch):
    """A family on one template whose nodes are all large: classes as by brute force, with pairs next to the threshold."""
    monkeypatch.setattr(neardup, "NODE", 8)
    monkeypatch.setattr(neardup, "TASK", 60)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(300):
        own = list(base)
        for at in rng.choice(120, rng.integers(2, 14), replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        texts.append((k, " ".join(own)))
    want = linked(texts, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(texts, "doc_id long, text string"), 2, 0.8).collect()}
    assert got == want


def test_rows_that_share_an_id(spark):
    """Two texts under one id are documents of their own; a near copy of the second finds it, and no text is lost."""
    a = " ".join(f"a{k}" for k in range(10))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, b + " more"), (3, ""), (3, None), (None, b), (4, a), (4, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.classes(frame, 2, 0.8).collect()), key=repr)
    assert got == sorted([(1, 9, 1), (1, 59, 1), (2, 60, 1), (3, 0, 3), (3, 0, 3), (None, 59, None), (4, 9, 1), (4, 9, 1)], key=repr)
    extra = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, body string, component long")
    kept = neardup.keep_one(spark, extra, "")
    assert kept.columns == ["doc_id", "text", "body", "component"]
    assert sorted((r["component"] for r in kept.collect())) == [0, 1, 3, 4, 5]
    assert neardup.keep_one(spark, extra.where("false"), "").count() == 0
    twice = spark.createDataFrame([(4, a), (4, a), (9, a)], "doc_id long, text string")
    assert [tuple(r) for r in neardup.keep_one(spark, twice, "").collect()] == [(4, a)]

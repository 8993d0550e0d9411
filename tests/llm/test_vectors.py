"""Near-duplicate embeddings against all pairs, with cells of every size, several lengths, and rows that take no part."""

import time

import numpy as np
import pytest

from corvana.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, key string, cell long, n long, v string"


def brute(rows, threshold, kind=np.float32):
    sound = [r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and sound[i] and sound[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], kind).astype(float), np.array(b[1], kind).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((r[0], len(near[i]), least, least == r[0] or r[0] is None))
    return sorted(out, key=str)


def families(rng, size, n):
    for k in range(n):
        base = rng.normal(size=size)
        for _ in range(int(rng.integers(1, 12))):
            yield k % 3, (base + rng.normal(size=size) * rng.choice([0.0, 0.15, 0.3, 0.4])).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(i, v, label) for i, (label, v) in enumerate([*families(rng, 20, 40), *families(rng, 3, 12), *families(rng, 1, 3)])]
    same = out[4]
    odd = [same, (same[0] + 5000, same[1], same[2]), (9000, same[1], None), (None, same[1], same[2]), (9001, None, 1), (9002, [], 1), (9003, [0.0] * 20, 1), (9004, [0.0] * 20, 1)]
    odd += [(9005, [float("nan"), *same[1][1:]], 1), (9006, [None, *same[1][1:]], 1), (9007, [float("inf"), *same[1][1:]], 1), (9008, [x * 1e-30 for x in same[1]], same[2])]
    return [(*r, 1, "k", 2, 3, "v") for r in [*out, *odd]]


@pytest.mark.parametrize("chunk", [8192, 16])
def test_against_all_pairs(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)  # small parts meet two by two
    if chunk == 16:
        rows = [(r[0], r[1] and [x and x / 3 for x in r[1]], *r[2:]) for r in rows]  # not held by 32 bits
    monkeypatch.setattr(vectors, "SLICE", 10)
    wide = SCHEMA.replace("array<float>", "array<double>") if chunk == 16 else SCHEMA
    got = vectors.near_vectors(spark.createDataFrame(rows, wide).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 0.93, np.float64 if chunk == 16 else np.float32)


def test_finer_cells(spark):
    """Cells along several axes keep all links: the links of each cell table add up to the same."""
    rng = np.random.default_rng(1)
    data = [(i, v, 0) for i, (_, v) in enumerate(families(rng, 16, 60))]
    v = vectors.unit(np.array([r[1] for r in data], float))
    by = vectors.Blocks(16, v, 0.9)
    want = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.9), strict=True) if i < j}
    x = by.turned(v)
    for axes in (1, 3, 8):
        found = []
        for block in range(len(by.parts)):
            home, near = by.homes(x, block, axes)
            there = {}
            for step in np.ndindex(*(2,) * home.shape[1]):
                for i in np.flatnonzero((near | ~np.array(step, bool)).all(1)):
                    there.setdefault(int(vectors.cell_code(home[i : i + 1] + np.array(step))[0]), []).append(i)
            for cell, ids in there.items():
                c = vectors.Cell(by, block, cell, axes, False, 0.9, [(int(i), 1, 0, v[i].tobytes(), x[i].tobytes()) for i in ids])
                a, b = np.triu_indices(len(ids), 1)
                close = ((c.x[a, by.parts[block][0] : by.parts[block][1]] - c.x[b, by.parts[block][0] : by.parts[block][1]]) ** 2).sum(1) <= by.budgets[block]
                ok = np.flatnonzero(close)
                ok = ok[c.linked(a[ok], b[ok])]
                found += [tuple(sorted((ids[p], ids[q]))) for p, q in zip(a[ok], b[ok], strict=True)]
        assert len(found) == len(set(found)) and set(found) == want


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_work_grows_by_little():
    """Spread vectors of a label: a vector is copied once a block, as no axis parts them, and 20,000 meet in seconds."""
    rng = np.random.default_rng(3)
    v = vectors.unit(rng.normal(size=(20_000, 64)))
    v[1] = vectors.unit(v[:1] + 0.01)[0]
    by = vectors.Blocks(64, v[:4096], 0.93)
    x = by.turned(v)
    assert sum(int(np.prod(1 + by.homes(x, k, 8)[1], axis=1).sum()) for k in range(len(by.parts))) <= 8 * len(v)
    held = [(i, 1, 0, v[i].tobytes(), x[i].tobytes()) for i in range(len(v))]
    start = time.process_time()
    found = [vectors.Cell(by, k, int(vectors.cell_code(by.homes(x[:1], k, 8)[0])[0]), 8, False, 0.93, held).links()[0].tolist() for k in range(len(by.parts))]
    assert sorted(sum(found, [])) == [0, 1]
    assert time.process_time() - start < 30

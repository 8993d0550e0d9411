"""Cases that a cut of the work would get wrong."""

import numpy as np

from corvana.llm import licenses, neardup, toxicity


def test_neardup_meets_through_large_nodes(spark, monkeypatch):
    """Pairs at the threshold whose shared nodes are all large meet as often as the others do."""
    monkeypatch.setattr(neardup, "NODE", 1)
    rng, n = np.random.default_rng(11), 3000
    a = rng.integers(0, 2**32, (n, neardup.SIGNATURE), dtype=np.uint32)
    other = rng.random(a.shape) >= 0.8
    b = np.where(other, rng.integers(0, 2**32, a.shape, dtype=np.uint32), a)
    rows = [(2 * k + j, bytearray(s[k].tobytes())) for k in range(n) for j, s in enumerate((a, b))]
    found = neardup.loose_edges(spark.createDataFrame(rows, "rep long, sig binary"), 0.8)
    met = {(min(r), max(r)) for r in found.collect()}
    assert sum((2 * k, 2 * k + 1) in met for k in range(n)) >= 0.998 * n


def test_licenses_in_sentences(spark):
    """A notice within a long sentence, and several licenses in one."""
    cases = {
        "The source code that goes with this article is released under the MIT License.": "MIT",
        "This dataset and its documentation are made available under the Apache License, Version 2.0.": "Apache-2.0",
        "Dual-licensed under the MIT License and the Apache License, Version 2.0.": "Apache-2.0,MIT",
        "You may choose the GNU General Public License, version 2, the Mozilla Public License, Version 2.0, the MIT License or the Apache License, Version 2.0, as you like.": "Apache-2.0,GPL-2.0,MIT,MPL-2.0",
        "Copyright 2023 by us. The code is free software under the GNU General Public License, version 3, and the book of it is sold in shops.": "GPL-3.0",
        "please submit your license to the permit office": "",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(frame).orderBy("doc_id").collect()] == list(cases.values())


def test_toxicity_near_is_exact_for_long_texts():
    """The least distance of an insult to a second person does not depend on the number of hits."""
    scales = toxicity.Scales({}, 0)
    insult, second = sorted(toxicity.INSULTS)[0], sorted(toxicity.SECOND_PERSON)[0]
    for times in (5, 150):
        text = " ".join([second, *["rivers"] * 16, insult, *["rivers"] * 40] * times)
        assert scales.features(text)[11] == 17
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.flatnonzero(rng.random(300) < p).tolist() for p in (0.02, 0.05))
        assert toxicity.least_distance(a, b) == min((abs(x - y) for x in a for y in b), default=99)


def test_toxicity_learns_one_row_an_id(spark):
    """An id with many rows counts once, whatever their number, so that the sample keeps its bound."""
    rows = [(7, f"text {k}") for k in range(500)] + [(k, f"other {k}") for k in range(100, 160)] + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in [7, 8, *range(100, 160)]] + [(7, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 40).collect()
    assert len(got) == 40
    every = toxicity.labelled_sample(docs, labels, "toxic", 1000).collect()
    assert len(every) <= 62 and len({r["text"] for r in every}) == len(every)

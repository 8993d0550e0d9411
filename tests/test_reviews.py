"""Reviews and contracts on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corvana.operators import reviews as r


def plain(frame):
    return {tuple(x) for x in frame.collect()}


def test_contract(spark):
    good = {"id": "a", "n": 3, "kind": "x", "refs": ["p", "q"], "path": "in/a.md"}
    payloads = [good, {**good, "n": 9}, {**good, "kind": "z"}, {**good, "refs": ["p", "p"]}, {**good, "path": "../a"}, {**good, "more": 1}, {**good, "id": "a" * 20_000}]
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(payloads)] + [(7, None)], "k int, payload string")
    got = r.contract(rows, "payload", list(good), {"n": (0, 5)}, {"kind": ["x", "y"]}, ("refs",), ("path",)).orderBy("k").collect()
    assert [x["problems"] for x in got[:7]] == [[], ["range:n"], ["enum:kind"], ["repeated:refs"], ["path:path"], ["keys"], ["too_large"]]
    assert len(got[7]["problems"]) == 6


def test_ledger_and_mismatches(spark):
    rows = spark.createDataFrame([(1, "a", 1, "w"), (1, "b", 2, "w"), (2, "c", 2, "v"), (3, "d", 1, "u"), (4, "e", 1, "x"), (4, "e", 1, "y"), (4, "f", 2, "z")], "task_id int, attempt_id string, attempt_no int, worker_id string")
    assert {(x[0], *x[1]) for x in r.ledger_problems(rows).collect()} == {(1, "worker_reused"), (2, "gap"), (4, "too_many", "repeated")}
    cards = spark.createDataFrame([(1, "s", None), (2, "s", 5)], "k int, skill string, n int")
    results = spark.createDataFrame([(1, "s", None), (2, "q", None), (3, None, None)], "k int, skill string, n int")
    assert {(x[0], tuple(y["field"] for y in x[1])) for x in r.mismatches(results, cards, "k", ["skill", "n"]).collect()} == {(1, ()), (2, ("skill", "n")), (3, ("skill", "n"))}


def test_plans_by_hash(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), (".git/c", "4")], "path string, sha string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("old", "5")], "path string, sha string")
    assert plain(r.sync_plan(a, b, r"^\.git/")) == {("x", "keep"), ("y", "update"), ("z", "create"), ("old", "delete"), (".git/c", "blocked")}
    assert {x["path"] for x in r.unverified(a, b).collect()} == {"y", "z", ".git/c"}
    files = spark.createDataFrame([("tmp/a", "1", "duplicate"), ("tmp/b", "1", "duplicate"), ("tmp/keep/b", "1", "duplicate"), ("tmp/l.log", None, "log"), ("src/l.py", "7", "log"), ("q", "8", "other")], "path string, sha string, category string")
    assert {x["path"] for x in r.cleanup(files, {"duplicate": "^tmp/", "log": r"\.log$"}, ["keep/"]).where("eligible").collect()} == {"tmp/b", "tmp/l.log"}
    items = spark.createDataFrame([("x", "1", "P0"), ("y", "2", "P9"), ("w", "2", "P0")], "path string, sha string, severity string")
    assert {x[-2:] for x in plain(r.drift(items, b, "path", {"P0": "strong"}, "weak"))} == {("same", "strong"), ("changed", "weak"), ("missing", "strong")}
    assert {x["path"] for x in r.changed(a, b, ["path", "sha"]).collect()} == {"y", "z", ".git/c"}


def test_grid_samples_and_records(spark):
    assert sorted(plain(r.grid(spark, {"a": [1, 2, 3], "b": ["u", "v"]}))) == [(k, 1 + k // 2, "uv"[k % 2]) for k in range(6)]
    assert sorted(plain(r.sampled(spark, lambda x: x * x, 0, 2, 3))) == [(0.0, 0.0), (1.0, 1.0), (2.0, 4.0)]
    with pytest.raises(ValueError):
        r.sampled(spark, F.sin, 1, 0, 3)
    answers = spark.createDataFrame([("The force is 5 N", 5.0004), ("the Force is 6", 6.0), (None, 5.0)], "a string, v double")
    assert [x[0] for x in answers.select(r.passes(F.col("a"), ["force"], ["is"], ["joule"], F.col("v"), 5.0)).collect()] == [True, False, False]
    old = spark.createDataFrame([("t1", "done")], "task string, phase string")
    assert plain(r.adapted(old, {"task_id": "task", "owner": "nobody"})) == {("t1", None)}
    assert plain(r.migrated(old, {"done": "closed"})) == {("t1", "closed")}


def test_reviews(spark):
    docs = spark.createDataFrame([(1, "see ![](a) and ![](b)"), (2, "plain")], "doc_id int, text string")
    refs = spark.createDataFrame([(1, "a", "![](a)"), (1, "b", "![](b)")], "doc_id int, key string, ref string")
    made = spark.createDataFrame([("a", "$x$", "seen", 0.9, "1"), ("b", "$y$", "", 1.5, "0"), ("c", "$z$", "seen", 0.5, "3")], "key string, replacement string, evidence string, confidence double, sha string")
    assets = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, sha string")
    checked = r.review_problems(made, assets, refs)
    assert {x["key"]: x["problems"] for x in checked.collect()} == {"a": [], "b": ["no_evidence", "confidence", "hash"], "c": ["unreferenced"]}
    got = {x[0]: (x[1], x[2]) for x in r.apply_reviews(docs, refs, checked.where(F.size("problems") == 0)).collect()}
    assert got == {1: ("see $x$ and ![](b)", ["b"]), 2: ("plain", [])}
    previews = "audit int, key string, sha string"
    sure = r.bound(spark.createDataFrame([(1, "a", "1"), (2, "a", "1"), (2, "b", "2")], previews), spark.createDataFrame([(1, "a", "1"), (2, "a", "1")], previews))
    assert plain(sure) == {(1, True), (2, False)}
    old = spark.createDataFrame([(1, "a", "open"), (2, "a", "open")], "audit int, key string, status string")
    assert plain(r.decided(old, old.withColumn("status", F.lit("done")), sure)) == {(1, "a", "done"), (2, "a", "open")}
    rows = "key string, resolution string, kind string, at int"
    merged = r.merged_evidence(spark.createDataFrame([("a", "new", "formula", 1), ("a", "newer", "formula", 2)], rows), spark.createDataFrame([("a", "old", "diagram", 9), ("b", "old", "diagram", 9)], rows))
    assert plain(merged) == {("a", "newer", "formula"), ("b", "old", "diagram")}
    assert plain(r.replacement_counts(refs.union(spark.createDataFrame([(1, "q", "r")], refs.schema)), merged)) == {(1, 1, 1, 1)}


def test_line_ranking(spark):
    rows = [(1, "formula", "reader", "text", "F equals m a", 0.95, 0.1), (1, "formula", "net", "formula", r"F = m a + \frac{1}{2}", None, 0.1), (2, "text", "reader", "text", "a page of notes", 0.9, 0.1), (3, "text", "reader", "text", "Score here", 0.9, 0.1), (4, "text", "reader", "text", "", None, 0.1)]
    frame = spark.createDataFrame(rows, "line_id int, line_type string, source string, kind string, text string, mean double, ink double")
    got = {x[0]: tuple(x)[1:5] for x in r.ranked_lines(frame, ["Score"], ["lorem"], r"\\frac|=", {"net": 0.54}).collect()}
    assert (got[1][0], got[1][2]) == (r"F = m a + \frac{1}{2}", "candidate")
    assert got[2] == ("a page of notes", 0.9, "final", None)
    assert got[3] == (None, 0.0, "abstain", "template_text") and got[4] == (None, 0.0, "abstain", "empty")

"""Taxonomy rules, walks, term matching and routing: a golden row for each rule, chains and cycles, plans and sizes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.functions import text as tx
from corvana.operators import audit, hierarchy, matching, retrieval, routing, taxonomy
from corvana.operators.tables import numbered, running

NODES = "id string, parent string, title string, level int, sort_order int, path string, aliases array<string>, status string, replacements array<string>"


def node(n, parent=None, title=None, level=None, order=1, path=None, aliases=(), status="active", replacements=()):
    title = f"t{n}" if title is None else title
    lists = (None if x is None else list(x) for x in (aliases, replacements))
    aliases, replacements = lists
    return (f"kp_{n:06d}" if isinstance(n, int) else n, parent, title, (2 if parent else 1) if level is None else level, order, path or (f"t1/{title}" if parent else title), aliases, status, replacements)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([node(2, "kp_000001")], set()),
        ([node("kp_12")], {("kp_12", "invalid_id"), (None, "next_id")}),
        ([node(None)], {(None, "invalid_id")}),
        ([node(1)], {("kp_000001", "duplicate_id"), ("kp_000001", "duplicate_active_path")}),
        ([node(2, title=" ")], {("kp_000002", "invalid_title")}),
        ([node(2, title="a/b")], {("kp_000002", "invalid_title")}),
        ([node(2, level=4)], {("kp_000002", "invalid_level"), ("kp_000002", "root_mismatch")}),
        ([node(2, order=0)], {("kp_000002", "invalid_sort_order")}),
        ([node(2, aliases=None)], {("kp_000002", "no_list")}),
        ([node(2, status="draft")], {("kp_000002", "invalid_status")}),
        ([node(2, status="deprecated")], {("kp_000002", "deprecated_without_replacement")}),
        ([node(2, status="deprecated", replacements=["kp_000001"])], set()),
        ([node(2, "kp_000001", title="x", path="t1/x"), node(3, "kp_000001", title="x", path="t1/x")], {("kp_000002", "duplicate_active_path"), ("kp_000003", "duplicate_active_path")}),
        ([node(2, path="other")], {("kp_000002", "root_mismatch")}),
        ([node(2, "kp_000009")], {("kp_000002", "missing_parent")}),
        ([node(2, "kp_000001", level=3)], {("kp_000002", "wrong_level")}),
        ([node(2, "kp_000001", path="t1/z")], {("kp_000002", "path_mismatch")}),
        ([node(2, replacements=["kp_000002"])], {("kp_000002", "self_replacement")}),
        ([node(2, replacements=["kp_000007"])], {("kp_000002", "unknown_replacement")}),
        ([node(10)], {(None, "next_id")}),
    ],
)
def test_registry_rules(spark, rows, want):
    assert {tuple(r) for r in taxonomy.problems(spark.createDataFrame([node(1), *rows], NODES), 10, 1).collect()} == want


def test_registry_as_a_whole(spark):
    none = spark.createDataFrame([], NODES)
    assert {tuple(r) for r in taxonomy.problems(none, 1, 2).collect()} == {(None, "no_nodes"), (None, "version")}


def test_cycles_and_long_chains(spark):
    """A chain of 1,000 ends; a cycle, a node that is its own parent and all that hangs below them do not."""
    chain = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(1000)]
    odd = [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w"), ("s", "s"), ("lost", "nobody"), ("after", "lost"), (None, "x")]
    got = {r[0] for r in taxonomy.endless(spark.createDataFrame([*chain, *odd], "id string, parent string")).collect()}
    assert got == {"x", "y", "z", "w", "v", "s"}


def test_preorder(spark):
    """Children by (sort_order, id), each with all below it before the next; roots are not part, cycles end."""
    rows = [("r", None, 1), ("b", "r", 1), ("a", "r", 2), ("a1", "a", 1), ("b2", "b", 10), ("b1", "b", 9), ("c", "r", 2), ("b11", "b1", 1), ("r", "b11", 1), ("other", None, 1)]
    got = taxonomy.preorder(spark.createDataFrame(rows, "id string, parent string, sort_order int"), "r").orderBy("position").collect()
    assert [r["id"] for r in got] == ["b", "b1", "b11", "b2", "a", "a1", "c"] and [r["position"] for r in got] == list(range(1, 8))
    assert [r["level"] for r in got][:4] == [1, 2, 3, 2]
    assert hierarchy.descendants(spark.createDataFrame(rows, "id string, parent string, sort_order int"), "a").count() == 2


def test_numbers_and_running_values(spark):
    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["a", "a", "a", "b", "c"])), int(k), None if k % 7 == 0 else int(rng.integers(0, 9))) for k in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(6)
    got = [(r["k"], r["at"]) for r in numbered(df, F.desc("k"), "at").orderBy("rank").collect()]
    assert got == sorted(((r[0], r[1]) for r in rows), key=lambda r: (-ord(r[0]), r[1]))
    sums, most = {}, {}
    want = {}
    for k, at, v in sorted(rows):
        sums[k] = sums.get(k, 0) + (v or 0)
        most[k] = max(most.get(k, -1), -1 if v is None else v)
        want[k, at] = (sums[k], most[k])
    out = running(df, "k", ["at"], {"s": (F.sum, "v"), "m": (F.max, "v")}).collect()
    assert {(r["k"], r["at"]): (r["s"] or 0, -1 if r["m"] is None else r["m"]) for r in out} == want


def test_terms_in_texts(spark, monkeypatch):
    """All terms that a text holds, also inside and across each other; the same in several passes; no join of all with all."""
    texts = [(1, "he said she sells"), (2, ""), (3, None), (4, "x王小明y"), (5, "aaaa" * 1000)]
    terms = ["he", "she", "s s", "ells", "王小", "王小明", "aaaaaaa", "", None, "he", "z"]
    df, listed = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(i, t) for i, x in texts for t in terms if t and x and t in x}
    for most in (200_000, 2):
        monkeypatch.setattr(matching, "MOST_TERMS", most)
        got = [tuple(r) for r in matching.hits(df, "id", "text", listed).collect()]
        assert set(got) == want and len(got) == len(want)
    plan = retrieval.coverage(listed.select(F.col("term").alias("key")), df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["key"]: r["found"] for r in retrieval.coverage(listed.select(F.col("term").alias("key")).distinct(), df).collect()} == {t: bool(t is not None and any(t in (x or "") for _, x in texts)) for t in set(terms)}


def test_lexical_with_many_terms(spark):
    """10,000 terms are no part of the plan."""
    terms = spark.createDataFrame([(f"r{k % 50}", f"Term{k:05d}x", k % 9 + 1) for k in range(10_000)], "rec string, term string, weight int")
    queries = spark.createDataFrame([(1, "a term00007X and TERM09999x term9"), (2, "none")], "qid long, text string")
    began = time.time()
    plan = routing.lexical(queries, terms)
    plan._jdf.queryExecution().optimizedPlan()
    planned = time.time() - began
    assert {tuple(r) for r in plan.collect()} == {(1, "r7", 8), (1, "r49", 1)}
    assert planned < 10 and len(plan._jdf.queryExecution().toString()) < 50_000


RECORDS = [("a", "alpha", "first", 50, 0), ("b", "beta", "first", None, 1), ("c", "gamma", "", 0, 2)]
TERMS = [("a", "trigger", "index"), ("a", "hint", "build"), ("a", "negative", "delete"), ("b", "trigger", "a much longer trigger"), ("b", "card", "vector"), ("b", "card", "vector"), ("c", "trigger", "qq"), ("c", "other", "build")]


@pytest.mark.parametrize(
    ("text", "stage", "semantic", "want", "confidence"),
    [
        ("INDEX it", None, None, [("a", 5 + 28 + 5), ("b", 5)], 0.58 + 33 / 220 + 38 / 500),
        ("build the index", None, None, [("a", 5 + 33 + 14), ("b", 5)], 0.58 + 0.18 + 0.08),
        ("delete the index", None, None, [("b", 5), ("a", 3)], 0.58 + 2 / 220 + 0.01),
        ("A much LONGER trigger", None, None, [("b", 5 + 36), ("a", 5)], 0.58 + 36 / 220 + 0.08),
        ("vector", None, None, [("b", 25), ("a", 5)], 0.58 + 20 / 220 + 25 / 500),
        ("alpha first", None, None, [("a", 13), ("b", 9)], 0.58 + 4 / 220 + 13 / 500),
        ("", None, None, [("a", 5), ("b", 5)], 0.58 + 0.01),  # a tie goes to the first position
        ("nothing", "c", None, [("c", 100), ("a", 5)], 0.72 + 0.18 + 0.08),
        ("nothing", "b", {"c": 0.999, "a": -1.0}, [("b", 105), ("c", 14)], 0.72 + 0.18 + 0.08),
        ("nothing", None, {"c": 0.39}, [("a", 5), ("b", 5)], 0.58 + 0.01),
        ("nothing", None, {"c": 0.4, "zz": 1.0}, [("c", 6), ("a", 5)], 0.58 + 1 / 220 + 6 / 500),
        ("nothing", "unknown", None, [("a", 5), ("b", 5)], 0.72 + 0.01),
        (None, None, None, [("a", 5), ("b", 5)], 0.58 + 0.01),
    ],
)
def test_routes(spark, text, stage, semantic, want, confidence):
    records = spark.createDataFrame(RECORDS, "rec string, name string, category string, priority int, position int")
    terms = spark.createDataFrame(TERMS, "rec string, kind string, term string")
    queries = spark.createDataFrame([(1, text, stage, semantic)], "qid long, text string, stage string, semantic map<string,double>")
    routes = routing.routed(queries, records, terms, "b")
    assert [(r["rec"], r["score"]) for r in routes.orderBy("rank").collect()] == want
    got = routing.with_confidence(routes.withColumn("staged", F.lit(stage is not None))).first()
    assert got["confidence"] == pytest.approx(round(min(0.98, confidence), 2))


def test_route_fallback(spark):
    records = spark.createDataFrame([("a", "", "", 0, 0), ("b", "", "", 3, 1)], "rec string, name string, category string, priority int, position int")
    terms = spark.createDataFrame([("a", "negative", "bad")], "rec string, kind string, term string")
    queries = spark.createDataFrame([(1, "bad", None, None), (2, "x", None, None)], "qid long, text string, stage string, semantic map<string,double>")
    routes = routing.routed(queries, records, terms, "home")
    assert {tuple(r) for r in routes.collect()} == {(1, "home", 1, 0, 0, 0, 0), (2, "home", 1, 0, 0, 0, 0)}
    assert {r["confidence"] for r in routing.with_confidence(routes.withColumn("staged", F.lit(True))).collect()} == {0.42}


def test_index_on_disk(spark, tmp_path):
    """An index is written once; ties go to the smaller id; unsound vectors and other lengths take no part."""
    rng = np.random.default_rng(6)
    data = [(k, rng.normal(size=8).round(2).tolist()) for k in range(300)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0, 2.0])]
    data += [(500 + k, data[k][1]) for k in range(5)]
    retrieval.index(spark.createDataFrame(data, "id long, v array<double>").repartition(3)).write.parquet(str(tmp_path / "index"))
    asked = [(k, data[k][1]) for k in range(0, 300, 40)] + [(7000, [1.0, 0.0])]
    got = retrieval.found_in(spark.read.parquet(str(tmp_path / "index")), spark.createDataFrame(asked, "qid long, q array<double>"), 4)
    for qid, q in asked:
        scores = sorted((-round(float(np.dot(q, v)), 6), k) for k, v in data if v and len(v) == len(q) and all(x is not None and x == x for x in v))[:4]
        rows = sorted((r["rank"], r["id"], r["score"]) for r in got.where(F.col("qid") == qid).collect())
        assert rows == [(n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    plan = retrieval.nearest(spark.createDataFrame(asked, "qid long, q array<double>"), spark.createDataFrame(data, "id long, v array<double>"), 4)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frontmatter_on_a_plain_session(spark):
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    page = "---\ntitle: a\nother: b\ntitle: \"c\"\n---\nbody"
    assert spark.createDataFrame([(page,)], "s string").select(tx.frontmatter(F.col("s"))).first()[0] == {"other": "b", "title": "c"}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("---\na: 1\ntags:\n    - x\n    - y\nb: 2\n---\nbody\n---\n", "---\na: 1\ntags:\n    - n$1\n    - m\nb: 2\n---\nbody\n---\n"),
        ("---\ntags: [x, y]\nb: 2\n---\n", "---\ntags:\n  - n$1\n  - m\nb: 2\n---\n"),
        ("---\nb: 2\ntags:\n---\n", "---\nb: 2\ntags:\n  - n$1\n  - m\n---\n"),
        ("---\nb: 2\n\n---\nx", "---\nb: 2\ntags:\n  - n$1\n  - m\n---\nx"),
        ("---\nmytags:\n- x\n---\nx", "---\nmytags:\n- x\ntags:\n  - n$1\n  - m\n---\nx"),
        ("tags:\n- x\n", None),
        ("---\ntags:\n- x\n", None),
        (None, None),
    ],
)
def test_frontmatter_lists(spark, page, want):
    row = spark.createDataFrame([(page,)], "s string").select(tx.with_frontmatter_list(F.col("s"), "tags", F.array(F.lit("n$1"), F.lit("m"))))
    assert row.first()[0] == want


def test_section_of_a_heading_with_marks(spark):
    page = spark.createDataFrame([("## A (b)\nold\n## C\nz",)], "s string")
    assert page.select(tx.replace_section(F.col("s"), "A (b)", F.lit("new"))).first()[0] == "## A (b)\n\nnew\n\n## C\nz"


def test_migrated_paths(spark):
    expected = spark.createDataFrame([("old\\a", 1, "h"), ("b/x/1", 2, "h"), ("b/y", 3, ""), ("c", 4, "h"), ("e", 5, "h"), ("f", 6, None)], "path string, bytes int, sha256 string")
    renames = spark.createDataFrame([("old/a", "b/new")], "old string, new string")
    prefixes = spark.createDataFrame([(1, "b/", "B/"), (0, "b/x/", "BX/")], "position int, old string, new string")
    due = audit.renamed(expected, renames, prefixes, "kept/")
    assert {r["path"] for r in due.collect()} == {"B/new", "BX/1", "B/y", "kept/c", "kept/e", "kept/f"}
    there = spark.createDataFrame([("B/new", 1, "h"), ("BX/1", 9, "h"), ("B/y", 3, "any"), ("kept/c", 4, "other"), ("kept/f", 6, "z"), ("more", 1, "q")], "path string, bytes int, sha256 string")
    checked = audit.verified(due, there)
    assert {(r["path"], r["status"], r["expected"], r["actual"]) for r in checked.collect()} == {("B/new", "ok", None, None), ("BX/1", "size", "2", "9"), ("B/y", "ok", None, None), ("kept/c", "hash", "h", "other"), ("kept/e", "missing", None, None), ("kept/f", "ok", None, None), ("more", "extra", None, None)}
    assert tuple(audit.verdict(checked, True).first()) == (False, 6, 3, 10, 1, 1, 1, 1)


@pytest.mark.parametrize(("a", "b", "exact", "distance"), [("ＡＢ　１", "A B1", True, 0), ("ﬁn e", "fine", True, 0), ("Straße", "Strasse", False, 2), ("", None, True, 0), ("x y", "xy", True, 0)])
def test_compared_texts(spark, a, b, exact, distance):
    from corvana.operators import queueing

    got = queueing.compared(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first()
    assert (got["exact"], got["distance"]) == (exact, distance)


def test_compared_formulas(spark):
    from corvana.operators import queueing

    row = spark.createDataFrame([(r"\[\mathrm{F} = {m}\,a \quad\]", "$$f=MA$$")], "a string, b string")
    assert queueing.compared(row, "a", "b", tx.formula_form).first()["exact"]

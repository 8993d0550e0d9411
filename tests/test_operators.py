"""Golden rows for operators that the driver's tables cannot show."""

import pytest
from pyspark.sql import functions as F

from corvana.functions import text as t
from corvana.operators import analytics, chunking, consensus, hierarchy, ingest

BOOK = """---
title: "A"
title: "B"
---
# Book
intro text that is long enough to stay
## One
short
### Deep
this body has more than twenty characters
##### stays in the body
#### Deeper
another body with more than twenty characters
## Two
a second chapter with enough characters in it
"""


def test_textbook_chunks_and_titles(spark):
    docs = spark.createDataFrame([("/x/a.md", "a.md", BOOK)], "path string, name string, text string")
    got = {r["chunk_index"]: (r["title"], r["text"]) for r in chunking.textbook(docs).collect()}
    assert [got[k][0] for k in sorted(got)] == ["Book", "Book - One - Deep", "Book - One - Deep - Deeper", "Book - Two"]
    assert "##### stays" in got[1][1] and "short" not in "".join(x for _, x in got.values())


def test_standard_titles_add_up(spark):
    text = "# T\n## A\n### B\nlong enough body for a chunk here\n### C\nlong enough body for a chunk here\n## D\nlong enough body for a chunk here"
    docs = spark.createDataFrame([("/x/a.md", "a.md", text)], "path string, name string, text string")
    assert [r["title"] for r in chunking.standard(docs).orderBy("chunk_index").collect()] == ["T - A / B", "T - A / B / C", "T - D"]


def test_frontmatter_last_key_wins_and_strips(spark):
    row = spark.createDataFrame([(BOOK,)], "s string").select(t.frontmatter(F.col("s"))["title"], t.strip_frontmatter(F.col("s"))).first()
    assert row[0] == "B" and row[1].startswith("# Book")


@pytest.mark.parametrize(("given", "want"), [("缺考", None), ("", None), ("12.0", 12.0), ("x", None), (" 3 ", 3.0)])
def test_numbers(spark, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(t.number(F.col("s"))).first()[0] == want


def test_answers_and_correctness(spark):
    row = spark.createDataFrame([("b，A", "A,B", 1.0, 2.0)], "r string, k string, s double, m double").select(t.answer(F.col("r")), t.is_correct(F.col("s"), F.col("m"), F.col("r"), F.col("k"))).first()
    assert tuple(row) == ("A,B", 1)


def test_wide_sheet_unpivots(spark):
    wide = spark.createDataFrame([("s1", "2", "4", "缺")], "student_id string, Q1_score string, Q1_max_score string, Q2_score string")
    assert {tuple(r) for r in ingest.item_results(wide, ["student_id"]).collect()} == {("s1", "Q1", 2.0, 4.0), ("s1", "Q2", None, None)}


def test_identity_gate_and_view_limits(spark):
    with pytest.raises(ValueError):
        ingest.gate_identity(spark.createDataFrame([("a",)], "real_name string"))
    views = {"v": spark.range(600).withColumn("teacher_note", F.lit("x"))}
    rows = analytics.safe_query(views, "v", ["id"], 10_000)
    assert rows.columns == ["id"] and rows.count() == 500
    with pytest.raises(ValueError):
        analytics.safe_query(views, "other", ["id"])


def test_tree_problems_and_cycles(spark):
    nodes = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "b", 2), ("d", "zz", 2), ("a", None, 1)], "id string, parent string, level int")
    assert {tuple(r) for r in hierarchy.problems(nodes).collect()} == {("c", "wrong_level"), ("d", "missing_parent"), ("a", "duplicate_id")}
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "id string, parent string")
    assert hierarchy.descendants(loop, "x").count() == 2


def test_greedy_packing(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 3, 20), ("k", 4, 1)], "k string, o long, s long")
    assert {(r["o"], r["part"]) for r in consensus.packed(rows, "k", "o", "s", 11).collect()} == {(1, 0), (2, 0), (3, 1), (4, 2)}

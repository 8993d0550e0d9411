"""Golden rows for exam sheets, candidates of readers, status rollups, acceptance and page metrics."""

import pytest
from pyspark.sql import functions as F

from corvana.operators import audit, candidates, exams


def flags(spark, text, confidence, **more):
    row = spark.createDataFrame([("k", more.pop("engine", "e1"), text, confidence, more.pop("own", None))], "key string, engine string, text string, confidence double, risk_flags array<string>")
    got = candidates.assessed(row, **more).first()
    return got["status"], got["risk_flags"]


@pytest.mark.parametrize(
    ("text", "confidence", "status", "want"),
    [
        ("", 0.99, "machine_abstain", ["empty_candidate"]),
        (None, None, "machine_abstain", ["empty_candidate"]),
        ("F=ma", 0.54, "machine_abstain", ["low_confidence"]),
        ("F=ma", 0.92, "machine_candidate", []),
        ("F=ma", None, "machine_candidate", []),
        ("a�", 0.95, "machine_candidate", ["replacement_character"]),
        ("v_速", 0.95, "machine_candidate", ["chinese_formula_text"]),
        (r"\vec a", 0.95, "machine_candidate", ["vector_notation"]),
        (r"\vector", 0.95, "machine_candidate", []),
        ("{}^{4}He", 0.95, "machine_candidate", ["nuclear_or_multi_script"]),
        ("a_{1}+b^{2}", 0.95, "machine_candidate", ["nuclear_or_multi_script"]),
        (r"$\left x\right $", 0.95, "machine_candidate", ["single_character_formula"]),
        ("$$λ$$", 0.95, "machine_candidate", ["single_character_formula"]),
        (r"\sqrt2", 0.95, "machine_candidate", []),
        (r"\sqrt{2}", 0.95, "machine_candidate", ["fraction_or_root"]),
        (r"\frac{1}{\frac{2}{3}}", 0.95, "machine_candidate", ["complex_formula_structure", "fraction_or_root"]),
        (r"\begin{cases}a\end{cases}", 0.95, "machine_candidate", ["complex_formula_structure"]),
        (r"\sum i", 0.95, "machine_candidate", ["complex_formula_structure"]),
        ("a??b", 0.95, "machine_candidate", ["unresolved_engine_specific_garble"]),
    ],
)
def test_candidate_flags(spark, text, confidence, status, want):
    assert flags(spark, text, confidence, garbled=r"\?\?") == (status, want)


def test_candidate_flags_from_outside(spark):
    assert flags(spark, "F=ma", 0.99, own=["z", "a"], active=["e2"]) == ("machine_candidate", ["a", "disabled_by_profile", "z"])


CASES = {
    "agree": [("p", r"\(F = ma\)"), ("q", "$F=ma$")],
    "three": [("p", "F=ma"), ("q", "F=ma"), ("r", "F=ma"), ("p", "E=x"), ("q", "E=x")],
    "differ": [("p", "F=ma"), ("q", "F=mb")],
    "one": [("p", "F=ma")],
    "flagged": [("p", r"\sqrt{ab}"), ("q", r"\sqrt{ab}")],
    "vetoed": [("p", "F=ma"), ("q", "F=ma")],
    "empty": [("p", ""), ("q", None)],
}


def test_consensus_of_engines(spark):
    rows = [(k, e, x, 0.99, None) for k, readings in CASES.items() for e, x in readings]
    judged = candidates.assessed(spark.createDataFrame(rows, "key string, engine string, text string, confidence double, risk_flags array<string>"))
    geometry = spark.createDataFrame([("vetoed", "cut_off"), ("vetoed", ""), ("unread", "tilted")], "key string, issue string")
    got = {r["key"]: r for r in candidates.resolved(judged, ["q", "p"], geometry, ["r", "q"]).collect()}
    state = {k: (r["status"], r["final"], list(r["agreed"]), list(r["risk_flags"])) for k, r in got.items()}
    assert state == {
        "agree": ("machine_final", "F=ma", ["q", "p"], []),
        "three": ("machine_final", "F=ma", ["r", "q", "p"], []),
        "differ": ("needs_vlm", None, [], ["engine_disagreement"]),
        "one": ("needs_vlm", None, [], []),
        "flagged": ("needs_vlm", None, [], ["fraction_or_root"]),
        "vetoed": ("needs_vlm", None, [], ["render_geometry_risk"]),
        "empty": ("machine_abstain", None, [], ["empty_candidate"]),
        "unread": ("machine_abstain", None, [], ["render_geometry_risk"]),
    }
    assert got["vetoed"]["geometry_issues"] == ["cut_off"]
    with pytest.raises(ValueError, match="two engines"):
        candidates.resolved(judged, ["p", "p"])


def test_one_inference_for_each_content(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", None), ("e", "3")], "key string, sha string")
    results = spark.createDataFrame([("a", "1", "x", 0.5), ("b", "1", "x", 0.5), ("c", "2", "y", None)], "key string, sha string, text string, score double")
    got = candidates.fanned_out(rows, results, "sha", "key", ["text", "score"])
    assert {tuple(r) for r in got.collect()} == {("a", "1", "a", False, "x", 0.5), ("b", "1", "a", True, "x", 0.5), ("c", "2", "c", False, "y", None), ("d", None, None, None, None, None), ("e", "3", None, None, None, None)}
    with pytest.raises(ValueError, match="evidence differs for equal content: 1"):
        candidates.fanned_out(rows, results.withColumn("text", F.col("key")), "sha", "key", ["text"])
    done = spark.createDataFrame([("1", "completed"), ("1", "completed"), ("2", "failed")], "sha string, status string")
    assert tuple(candidates.cache_counts(rows, done, "sha").first()) == (4, 3, 1, 2, 1)
    assert tuple(candidates.cache_counts(rows.limit(0), done, "sha").first()) == (0, 0, 0, 0, 0)


def test_page_conflicts(spark):
    schema = "page int, score int, status string, confidence double, quality double, region string, source_kind string, risk_flags array<string>, signs array<string>, selected boolean"
    rows = [
        (1, 10, "ok", 0.9, None, "", "page", [], ["s1"], True),
        (1, 71, "machine_abstain", None, 0.64, None, "page", None, ["s2"], False),
        (2, 5, "machine_candidate", 0.65, 0.65, "r1", "x_formula", ["f2", "f1"], None, True),
        (3, 5, "ok", None, None, None, "page", [], [], True),
        (3, 65, "ok", None, None, None, "page", ["formula_candidate"], [], False),
        (5, 1, "ok", None, None, None, None, None, None, None),
    ]
    markers = spark.createDataFrame([(5, ["ocr_garbled", "other"]), (4, ["picture_omitted"])], "page int, signs array<string>")
    got = {r["page"]: (r["conflict_types"], r["flags"]) for r in candidates.page_conflicts(spark.range(1, 7).select(F.col("id").alias("page")), spark.createDataFrame(rows, schema), markers).collect()}
    assert got == {
        1: (["candidate_disagreement", "low_confidence_candidate", "machine_abstain", "s1"], []),
        2: (["candidate_risk_flags", "formula_candidate", "machine_candidate_review", "region_candidate"], ["f1", "f2"]),
        3: (["candidate_risk_flags", "formula_candidate"], ["formula_candidate"]),
        4: (["empty_text", "missing_local_candidate", "picture_omitted"], []),
        5: (["ocr_garbled"], []),
        6: (["empty_text", "missing_local_candidate"], []),
    }


def test_method_errors_and_genders(spark):
    rows = spark.createDataFrame([("Q1", " unknown ", "男生"), ("Q2", "", " f"), ("Q3", None, None)], "item string, e string, g string")
    assert [r[0] for r in exams.method_errors(rows, "e", "item").orderBy("item").select("e").collect()] == ["unknown", None, None]
    assert [r[0] for r in exams.strict_gender(rows, "g").orderBy("item").select("g").collect()] == ["M", "F", "U"]
    with pytest.raises(ValueError, match="invalid method_error_type for Q9: typo"):
        exams.method_errors(spark.createDataFrame([("Q9", "typo")], "item string, e string"), "e", "item")
    with pytest.raises(ValueError, match="unsupported gender value: x"):
        exams.strict_gender(spark.createDataFrame([("x",)], "g string"), "g")
    assert len(exams.METHOD_ERRORS) == 11


def test_items_of_the_first_row(spark):
    names = ["row", "assessment_id", "Q1_score", "Q1_item_no", "N1_question_id", "N1_max_score", "Q1_kp_id", "N1_kp_title", "Q2_score", "Q2_max_score", "Q2_title", "Q3_score", "Q3_correct_answer", "exam_report_ref"]
    wide = spark.createDataFrame([("2", "E", "1", "other", "q", "9", "k9", "t", "1", "9", "T9", "1", "B", "r9"), ("1", "E", "1", "N1", "question7", "4", "k1", "", "1", "", "Two", "1", "A", "r1")], ", ".join(f"{c} string" for c in names))
    got = {r["item_key"]: r for r in exams.item_metadata(wide, "row").collect()}
    q1, q2, q3 = got["Q1"], got["Q2"], got["Q3"]
    assert (q1["assessment_item_id"], q1["item_no"], q1["question_id"], q1["title"], q1["max_score"], q1["kp_id"], q1["kp_title"], q1["display_order"]) == ("E_Q1", "N1", "question7", "N1", 4.0, "k1", "k1", 1)
    assert (q2["question_id"], q2["title"], q2["max_score"], q2["kp_id"], q2["kp_title"]) == ("question_E_Q2", "Two", 1.0, None, None)
    assert (q3["correct_answer"], q3["question_type"], q3["exam_report_ref"]) == ("A", "exam_item", "r1")
    assert exams.item_metadata(wide.limit(0), "row").count() == 0


def test_seats(spark):
    roster = spark.createDataFrame([("c", "01", "s1"), ("c", "2.0", "s2"), ("d", "1", "s3")], "class_id string, seat_no string, student_id string")
    scores = [("c", "1", "A", "90"), ("c", "2", "B", "缺考"), ("c", "", "mean", "80"), ("c", "3", " ", "70"), ("d", "001", "C", "60.5")]
    schema = "class_id string, seat_no string, name string, total string"
    assert {(r["name"], r["student_id"]) for r in exams.seated(roster, spark.createDataFrame(scores, schema), "name", "total").collect()} == {("A", "s1"), ("C", "s3")}
    with pytest.raises(ValueError, match="no roster match for: c/9"):
        exams.seated(roster, spark.createDataFrame([("c", "9", "X", "1")], schema), "name", "total")
    with pytest.raises(ValueError, match="duplicate roster seat_no: c/1"):
        exams.seated(roster.union(roster.where("student_id = 's1'")), spark.createDataFrame(scores, schema), "name", "total")


def test_study_plan(spark):
    weak = [(f"w{k}", k / 100, None, 1.0, "weak") for k in range(8)]
    rows = [*weak, ("b1", 0.7, 0.2, 1.0, "basic"), ("b2", 0.7, -0.2, 1.0, "basic"), ("s1", 0.9, 0.0, 1.0, "strong"), ("s2", 0.9, 0.0, 2.0, "strong"), ("n", None, None, 1.0, "insufficient")]
    got = {(r["part"], r["place"]): r["kp"] for r in exams.study_plan(spark.createDataFrame(rows, "kp string, mastery double, gap double, weight double, level string")).collect()}
    assert [got["urgent", k] for k in range(1, 6)] == ["w0", "w1", "w2", "w3", "w4"]
    assert [got["consolidate", k] for k in range(1, 6)] == ["b2", "b1", "w5", "w6", "w7"]
    assert [got["strong", k] for k in (1, 2)] == ["s2", "s1"] and len(got) == 12


def test_ids_in_texts(spark):
    rows = spark.createDataFrame([("AB1, C3 and X3",), ("Z0007 E99999999999999999999 low8",), (None,)], "s string")
    numbers = exams.id_numbers(rows, "s")
    assert sorted(r[0] for r in numbers.collect()) == [1, 3, 3, 7]
    assert [tuple(r) for r in audit.duplicates(numbers, "number").collect()] == [(3, 2)]
    assert sorted(r[0] for r in exams.gap_names(audit.gaps(numbers, "number")).collect()) == ["2", "4~6"]


def test_import_status(spark):
    rows = [("a", k, f"b{k}", None, k % 2 == 0, f"e{k}") for k in range(9)] + [("b", 0, "x", "t", None, None), ("c", 0, "y", "t", True, None)]
    got = {r["label"]: r for r in exams.import_status(spark.createDataFrame(rows, "label string, position int, key string, title string, ok boolean, error string"), 3).collect()}
    assert (got["a"]["count"], got["a"]["ok"], got["a"]["failed"], got["a"]["truncated_failures"]) == (9, 5, 4, 1)
    assert [f["key"] for f in got["a"]["failures"]] == ["b1", "b3", "b5"]
    assert [tuple(f) for f in got["b"]["failures"]] == [("x", "t", None)] and list(got["c"]["failures"]) == []


def test_acceptance(spark):
    base = [(f"c{k}", k < 8, True, False, False) for k in range(10)]
    models = {"good": base, "form": [*base[:9], ("c9", False, False, False, False)], "safety": [*base[:9], ("c9", False, True, False, True)], "critical": [*base[:9], ("c9", True, True, True, False)], "low": [(f"c{k}", k < 7, True, False, False) for k in range(10)], "null": [*base[:9], ("c9", None, None, None, None)]}
    rows = spark.createDataFrame([(m, *r) for m, rs in models.items() for r in rs], "model string, case_id string, passed boolean, schema_valid boolean, critical_error boolean, safety_critical boolean")
    got = {r["model"]: r for r in exams.accepted(rows).collect()}
    assert {m for m, r in got.items() if r["accepted"]} == {"good"}
    assert got["critical"]["critical_errors"] == ["c9"] and got["low"]["score_rate"] == 0.7


@pytest.mark.parametrize(("s", "want"), [(" m/s² ", "m/s^2"), ("N · m", "n*m"), ("cm³", "cm^3"), (None, "")])
def test_units(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(exams.unit(F.col("s"))).first()[0] == want


def test_page_kinds(spark):
    long = "a line of text that is long enough\n" * 4
    pages = [("img", k, "", 1, 0.7) for k in range(4)] + [("img", 9, long, 0, 0.0)] + [("mix", 1, long, 1, 0.1), ("mix", 2, "x", 0, 0.0)] + [("full", k, long, int(k == 0), 0.65 if k == 0 else 0.0) for k in range(3)]
    pages += [("txt", 1, long, 0, None), ("prv", 1, long + "\ue123", 0, 0.0), ("frag", 1, "ab\n" * 40 + long, 0, 0.0), ("none", 1, None, None, None)]
    got = {r["doc"]: r for r in exams.pdf_kind(exams.page_metrics(spark.createDataFrame(pages, "doc string, page int, text string, images int, coverage double"))).collect()}
    assert {d: r["kind"] for d, r in got.items()} == {"img": "image_pdf", "mix": "mixed_pdf", "full": "mixed_pdf", "txt": "text_pdf", "prv": "text_pdf", "frag": "text_pdf", "none": "text_pdf"}
    assert {d for d, r in got.items() if r["formula_risk"]} == {"mix", "full", "prv", "frag"}
    assert {d for d, r in got.items() if r["advice"] == "text_reader"} == {"txt", "none"}
    assert got["frag"]["fragments"] == round(40 / 44, 4) and got["none"]["zero_text_pages"] == 1


def test_campaigns_and_streams(spark):
    items = spark.createDataFrame([("a", "done"), ("a", "done"), ("b", "done"), ("b", "blocked"), ("c", "queued"), ("c", "source_blocked")], "campaign string, status string")
    got = {r["campaign"]: (r["counts"], r["complete"], r["blocked"]) for r in exams.campaign_status(items, ["done", "blocked"]).collect()}
    assert got == {"a": ({"done": 2}, True, 0), "b": ({"done": 1, "blocked": 1}, False, 1), "c": ({"queued": 1, "source_blocked": 1}, False, 1)}
    streams = spark.createDataFrame([("v", 100, "x"), ("v", 300, "y"), ("w", None, "z")], "key string, bandwidth int, codec string")
    assert [r["codec"] for r in exams.audio_streams(streams.where("key = 'v'"), 150).collect()] == ["y"]
    assert exams.audio_streams(streams, 150, True).count() == 3
    with pytest.raises(ValueError, match="no stream of 150 or more: w"):
        exams.audio_streams(streams, 150)


def test_outlines_of_any_depth(spark):
    from corvana.operators import hierarchy

    text = ["- a", "  - b", "    - c", "        - skips a level", "  - d", "    - e", "no bullet", "- f", "    - no parent", "  - g", "- h", "    - none either", "      - nor here"]
    rows = [("x", n, line) for n, line in enumerate(text)] + [("y", 0, "  - first"), ("y", 1, "- second")]
    nodes, gaps = hierarchy.parsed(spark.createDataFrame(rows, "doc string, pos int, line string"))
    got = {(r["doc"], r["title"]): (r["id"], r["parent"], r["level"], r["sort_order"]) for r in nodes.collect()}
    assert got["x", "c"] == ("kp_000003", "kp_000002", 3, 1) and got["x", "e"] == ("kp_000006", "kp_000005", 3, 1) and got["x", "d"] == ("kp_000005", "kp_000001", 2, 2)
    assert got["x", "g"] == ("kp_000009", "kp_000007", 2, 1) and got["y", "second"] == ("kp_000002", None, 1, 2)
    assert sorted((r["doc"], r["title"]) for r in gaps.collect()) == [("x", "no parent"), ("x", "none either"), ("x", "skips a level"), ("y", "first")]
    assert got["x", "nor here"][1] == "kp_000011"  # what hangs below a gap has its own parent
    assert hierarchy.parsed(spark.createDataFrame([], "doc string, pos int, line string"))[0].count() == 0


def test_hash_of_a_registry(spark, monkeypatch):
    from corvana.operators import routing

    frame = spark.createDataFrame([(f"r{k:03d}", k) for k in range(50)], "name string, v int")
    one = routing.content_hash(frame, "name").first()[0]
    monkeypatch.setattr(routing, "HASHES", 4)
    two = routing.content_hash(frame.repartition(5), "name").first()[0]
    assert len(one) == len(two) == 64 and two == routing.content_hash(frame.orderBy(F.desc("v")), "name").first()[0]
    assert two != routing.content_hash(frame.where("v < 49"), "name").first()[0]
    assert routing.content_hash(frame.limit(0), "name").count() == 1


def test_cleaned_segments(spark):
    rows = [
        ("v", 0, "1.5", "0.5", " say\n作公  now "),
        ("v", 1, "2", None, "啊啊"),
        ("v", 2, "3", "4", "follow and like"),
        ("v", 3, "3", "4", "follow and like " + "but this is much longer than what a platform's own line would ever be"),
        ("v", 4, "x", "4", "bad time"),
        ("v", 5, None, "9", "12:30 [..]"),
        ("v", 6, None, None, "kept"),
        ("w", 0, "1", "2", ""),
    ]
    df = spark.createDataFrame(rows, "id string, idx int, s string, finish string, sentence string")
    kept, counters = audit.cleaned_segments(df, {"作公": "做功"}, noise_only="啊+", platform="subscribe", words=["follow", "like"])
    got = {(r["id"], r["idx"]): (r["begin"], r["end"], r["text"], r["raw_text"]) for r in kept.collect()}
    assert got["v", 0] == (1.5, 1.5, "say 做功 now", "say 作公 now") and got["v", 6] == (0.0, 0.0, "kept", "kept") and set(got) == {("v", 0), ("v", 3), ("v", 6)}
    assert {tuple(r) for r in counters.collect()} == {("v", 7, 3, 4), ("w", 1, 0, 1)}


def test_assets_by_their_last_part(spark):
    from corvana.operators import reviews

    assets = spark.createDataFrame([("k1", "a/x.wmf"), ("k2", "b/x.wmf"), ("k3", "b/y.wmf")], "key string, path string")
    told = spark.createDataFrame([("a/x.wmf",), ("c/x.wmf",), ("old\\y.wmf",), ("z.wmf",), (None,)], "path string")
    assert {tuple(r) for r in reviews.by_basename(told, assets).collect()} == {("a/x.wmf", "k1"), ("c/x.wmf", None), ("old\\y.wmf", "k3"), ("z.wmf", None), (None, None)}

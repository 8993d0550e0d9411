"""Golden rows for the import path, stores, sources, encoders and taxonomy changes."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvana.functions import arithmetic
from corvana.operators import analytics, hierarchy, imports, ingest, queueing, retrieval, routing, wiki
from corvana.sources import corpus, office


def test_denylists():
    assert sorted(analytics.FORBIDDEN) == ["class_rank", "grade_rank", "guardian_contact", "notes", "real_name", "school_number", "score_band", "teacher_comment", "teacher_note"]
    assert len(ingest.FORBIDDEN_IDENTITY) == 14 and {"姓名", "学号", "考号", "学籍号", "exam_no", "student_registry_number"} <= ingest.FORBIDDEN_IDENTITY


def test_identified(spark):
    rows = [("t", "c", "高一", "男", "07.0", "王", "t_c_M_seat7"), ("t", "c", "高一", "F", "8", " ", None), ("t", "c", "高一", "F", "9", "李", "other")]
    good, bad = imports.identified(spark.createDataFrame(rows, "term_id string, class_id string, class_name string, gender string, seat_no string, family_name string, student_id string"))
    assert [(r["person_id"], r["pseudonym"]) for r in good.collect()] == [("t_c_M_seat7", "高一-王-7号")]
    assert sorted(r["issue"] for r in bad.collect()) == ["family_name_missing", "student_id_not_derived"]


def test_store_applies_migrations_once(spark):
    store = imports.Store(spark, "corvana_test_store", dev=True)
    store.reset()
    steps = {"002_b": ["alter table {ns}.people add columns (gender string)"], "001_a": ["create table {ns}.people (id string) using parquet"]}
    assert store.migrate(steps) == ["001_a", "002_b"] and store.migrate(steps) == []
    assert store.migrate(steps | {"003_c": ["create table {ns}.terms (id string) using parquet"]}) == ["003_c"]
    assert spark.table("corvana_test_store.people").columns == ["id", "gender"]
    store.reset()
    for dev, key in ((True, "k"), (False, None)):
        with pytest.raises(ValueError):
            imports.Store(spark, "x", dev, key)


def test_ledger_and_pick(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x")
    content = spark.read.format("binaryFile").load(str(tmp_path))
    row = imports.batch_row(spark, "roster", "a.csv", content, 5, 2, "teacher").first()
    assert row["success_count"] == 3 and row["checksum"].startswith("2d711642") and row["batch_id"].startswith("batch_")
    results = spark.createDataFrame([("b", "c1", "t1"), ("a", "c1", None), ("d", "c1", "t1")], "student_id string, class_id string, term_id string")
    seats = spark.createDataFrame([("a", "c1", "t9", "3"), ("b", "c1", "t2", "4"), ("d", "c1", None, "5")], "student_id string, class_id string, term_id string, seat_no string")
    assert tuple(imports.pick(results, seats).first()) == ("a", "c1", None, "3")
    assert imports.pick(results, seats, student_id="b").first()["seat_no"] is None
    assert imports.pick(results, seats, seat_no="5").first()["student_id"] == "d"
    assert imports.pick(results, seats, seed=3).count() == 1
    with pytest.raises(ValueError):
        imports.pick(results, seats, "a", "3")


def test_artifacts(spark):
    files = spark.createDataFrame([("in\\a_roster.csv", bytearray(b"1")), ("./b.PNG", bytearray(b"22"))], "path string, content binary")
    got = {r["path"]: (r["kind"], r["ref"], r["bytes"]) for r in imports.archived(files, spark.createDataFrame([("e1", "b.PNG")], "ref string, path string")).collect()}
    assert got == {"in/a_roster.csv": ("roster_csv", None, 1), "b.PNG": ("answer_card_png", "e1", 2)}


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_presentations_and_workbooks(spark):
    rels = f'<Relationships><Relationship Id="r1" Type="{R}/image" Target="../media/i.png"/><Relationship Id="r2" Type="{R}/notesSlide" Target="../notesSlides/n.xml"/></Relationships>'
    deck = archive({
        "ppt/slides/slide2.xml": f"<s {A}><a:p><a:t>Two</a:t></a:p></s>", "ppt/slides/slide1.xml": f'<s {A}><a:p><a:t>One </a:t><a:t>title</a:t></a:p><a:p/><a:p><a:t>body</a:t></a:p><a:blip r:embed="r1"/></s>',
        "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/n.xml": f"<s {A}><a:p><a:t>note</a:t></a:p></s>", "ppt/media/i.png": "x" * 9, "ppt/media/j.PNG": "xx",
    })
    files = spark.createDataFrame([("d.pptx", deck), ("bad.pptx", bytearray(b"no zip"))], "path string, content binary")
    got = {(r["path"], r["slide"]): r for r in office.presentation_slides(files).collect()}
    assert got["d.pptx", 1]["title"] == "One title" and got["d.pptx", 1]["media"] == ["ppt/media/i.png"] and got["d.pptx", 1]["notes"] == "note" and got["d.pptx", 2]["blocks"] == ["Two"]
    assert next(r["error"] for (p, _), r in got.items() if p == "bad.pptx").startswith("BadZipFile")
    counts, largest = office.presentation_media(files)
    assert [tuple(r) for r in counts.collect()] == [("d.pptx", ".png", 2, 11)] and largest.first()["name"] == "ppt/media/i.png"
    book = archive({
        "xl/workbook.xml": f'<w {S}><sheets><sheet name="A" r:id="r1"/></sheets></w>', "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Type="{R}/worksheet" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>座号</t></si><si><t>姓名</t></si></sst>", "xl/worksheets/s.xml": f'<ws {S}><c r="A1"><v>5</v></c><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c></ws>',
    })
    cells = office.workbook_cells(spark.createDataFrame([("b.xlsx", book)], "path string, content binary"))
    assert [(r["sheet"], r["row"], r["names"]) for r in imports.header(cells).collect()] == [("A", 1, {"seat_no": 0, "real_name": 27})]


def test_json_of_any_encoding(spark, tmp_path):
    for k, (encoding, value) in enumerate([("utf-8-sig", {"videos": [{"id": "a"}, {"id": "b"}]}), ("utf-16", [{"id": "c"}]), ("utf-16-le", {"id": "d"})]):
        (tmp_path / f"{k}.json").write_bytes(json.dumps(value).encode(encoding))
    (tmp_path / "9.json").write_bytes(b"{broken")
    got = office.json_items(spark, str(tmp_path), "id string").collect()
    assert sorted(r["item"]["id"] if r["item"] else "-" for r in got) == ["-", "a", "b", "c", "d"]


def test_csv_has_a_mark_and_comes_back(spark, tmp_path):
    corpus.write_csv(spark.createDataFrame([("1", "x", "y")], "a string, b string, c string").coalesce(1), f"{tmp_path}/o", ["b", "a"])
    assert next((tmp_path / "o").glob("*.csv")).read_bytes().startswith("﻿b,a".encode())
    assert corpus.csv(spark, f"{tmp_path}/o", ["a", "b"]).collect()[0].asDict() == {"b": "x", "a": "1"}


def test_encoder_and_session(spark):
    rows = retrieval.encoded(spark.createDataFrame([(1, "force and mass"), (2, None), (3, "force and mass")], "id int, text string")).collect()
    one, none, same = rows
    assert abs(sum(x * x for x in one["dense"]) - 1) < 1e-6 and len(one["dense"]) == 1024 and one["dense"] == same["dense"] and set(none["dense"]) == {0.0}
    assert set(one["weights"]) == {"force", "and", "mass"}
    session = retrieval.Session(lambda q, mode, k: 1 / 0 if q == "bad" else (q, mode, k))
    assert [session.answer(x) for x in ("mode sparse", "mode odd", "k 0", "k 7", "a b")] == ["mode sparse", "mode is none of dense, sparse, hybrid", "k is a whole number over 0", "k 7", ("a b", "sparse", 7)]
    assert session.answer("bad").startswith("error") and session.answer("x") == ("x", "sparse", 7)
    assert retrieval.depths("deep") == (10, 10, 12000)


NODES = "id string, parent string, title string, level int, sort_order int, path string, aliases array<string>, status string, replacements array<string>"


def test_taxonomy_changes(spark):
    lines = ["- A", "  - B", "    - C", "  - D", "- E"]
    nodes, gaps = hierarchy.parsed(spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, pos int, line string"))
    assert [(r["id"][-1], (r["parent"] or "-")[-1], r["sort_order"]) for r in nodes.orderBy("id").collect()] == [("1", "-", 1), ("2", "1", 1), ("3", "2", 1), ("4", "1", 2), ("5", "-", 2)] and gaps.count() == 0
    lost = hierarchy.parsed(spark.createDataFrame([("d", 0, "- A"), ("d", 1, "    - deep")], "doc string, pos int, line string"))[1]
    assert [r["title"] for r in lost.collect()] == ["deep"]
    rows = [("kp_1", None, "A", 1, 1, "A", [], "active", []), ("kp_2", "kp_1", "B", 2, 1, "A/B", [], "active", []), ("kp_3", "kp_2", "C", 3, 1, "A/B/C", [], "active", []), ("kp_4", None, "E", 1, 2, "E", [], "active", [])]
    tree = spark.createDataFrame(rows, NODES)
    after = lambda change: {r["id"]: r for r in hierarchy.changed(tree, change).collect()}
    added = after({"action": "add", "title": "N", "parent": "kp_2"})["kp_000005"]
    assert (added["path"], added["level"], added["sort_order"]) == ("A/B/N", 3, 2)
    renamed = after({"action": "rename", "id": "kp_2", "title": "X"})
    assert (renamed["kp_3"]["path"], renamed["kp_3"]["aliases"], renamed["kp_1"]["aliases"]) == ("A/X/C", ["A/B/C"], [])
    moved = after({"action": "move", "id": "kp_2", "parent": "kp_4"})
    assert (moved["kp_3"]["path"], moved["kp_2"]["sort_order"]) == ("E/B/C", 1)
    assert after({"action": "merge", "id": "kp_3", "target": "kp_4"})["kp_3"]["status"] == "deprecated"
    assert after({"action": "reorder", "id": "kp_3", "sort_order": 9})["kp_3"]["sort_order"] == 9 and len(after({"action": "assign"})) == 4
    for bad in ({"action": "delete"}, {"action": "move", "id": "kp_1", "parent": "kp_3"}, {"action": "move", "id": "kp_1", "parent": "kp_4"}, {"action": "deprecate", "id": "kp_2", "replacements": ["kp_4"]}, {"action": "add", "title": "B", "parent": "kp_1"}, {"action": "add", "title": "a/b"}, {"action": "odd", "id": "kp_1"}):
        with pytest.raises(ValueError):
            hierarchy.changed(tree, bad)


def test_deep_trees_lose_nothing(spark):
    nodes = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(14)] + [("x", "y"), ("y", "x")], "id string, parent string")
    assert hierarchy.descendants(nodes, "n0").count() == 14 and hierarchy.descendants(nodes, "x").count() == 2


def test_cache_hash_does_not_depend_on_order(spark):
    frame = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, doc string")
    one = routing.content_hash(frame, "name").first()[0]
    assert one == routing.content_hash(frame.orderBy(F.desc("name")).repartition(2), "name").first()[0]
    assert not routing.stale(frame, "name", one) and routing.stale(frame.where("name = 'a'"), "name", one)


@pytest.mark.parametrize(("text", "want"), [("2+3*4", 14), ("-2**2", -4), ("(1+2)*-3", -9), ("2**-1", 0.5), ("1/0", None), ("9**9", None), ("2**3**2", 512 if False else None), ("1e3-.5", 999.5), ("abs(1)", None), ("1 2", None), ("", None), ("(1", None), ("1_000", 1000)])
def test_arithmetic(text, want):
    assert arithmetic.safe(text) == want


def test_line_and_page_issues(spark):
    page = ["# A", "## **B**", "##", "##### deep", "## 图 1 x", "x TODO", "abcdefabcdefabcdefabcdef", "## 第3章", "![a](b.WMF)", "## **B**", "one $ only"]
    lines = spark.createDataFrame([("p", k, x) for k, x in enumerate(page)], "path string, pos int, line string")
    got = {(r["pos"], r["issue"]) for r in wiki.line_issues(lines, ["only"]).collect()}
    assert got == {(1, "bold_in_heading"), (9, "bold_in_heading"), (2, "empty_heading"), (3, "heading_too_deep"), (4, "caption_as_heading"), (5, "placeholder"), (6, "repeated_ocr_noise"), (7, "chapter_name_missing"), (8, "wmf_reference"), (10, "suspicious_ocr_token")}
    assert {(r["issue"], r["detail"]) for r in wiki.page_issues(lines).collect()} == {("unbalanced_latex_delimiter", "1"), ("duplicate_h2", "**B**")}
    named = spark.createDataFrame([("## 第3章\nx",)], "s string").select(wiki.named_chapters(F.col("s"), {"3": "力 $"})).first()[0]
    assert named == "## 第3章 力 $\nx"
    deep = spark.createDataFrame([("a/b.md",), ("a/c/d.md",)], "p string").where(wiki.first_level(F.col("p"))).collect()
    assert [r["p"] for r in deep] == ["a/b.md"] and queueing is not None

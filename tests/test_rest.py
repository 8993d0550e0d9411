"""Golden rows for sources, text functions and operators that no registered query shows."""

import datetime
import hashlib
import pathlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana import catalog, session
from corvana.functions import text as t
from corvana.operators import analytics, audit, candidates, chunking, hierarchy, ingest, queueing, retrieval, reviews, routing, tables, versions, wiki
from corvana.sources import corpus
from corvana.streaming import incremental


def value(spark, make, s, schema="s string"):
    return spark.createDataFrame([(s,)], schema).select(make(F.col("s")).alias("v")).first()["v"]


def test_trees_of_markdown(spark, tmp_path):
    files = {
        "textbooks/b/x.md": "textbook", "standards/s.md": "standard", "textbooks/x.txt": None, "other/o.md": None,
        "lectures/l.md": "lecture", "lectures/l_设计.md": "lesson_design", "transcripts/a_知识笔记.md": "transcript", "transcripts/a.md": None,
        "exercises/flat/e.md": "exercise", "exercises/deep/above.md": None, "exercises/deep/sub/e.md": "exercise",
        "exercises/pics/e.md": "exercise", "exercises/pics/media/m.md": None,
    }
    for name in files:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    got = {r["path"][len(str(tmp_path)) + 1 :]: (r["source_type"], r["text"]) for r in corpus.markdown(spark, str(tmp_path)).collect()}
    assert {k: v for k, (v, _) in got.items()} == {k: v for k, v in files.items() if v} and all(v == f"# {k}" for k, (_, v) in got.items())
    found = {r["relative_path"]: r for r in corpus.inventory(spark, str(tmp_path), "root").collect()}
    assert set(found) == set(files)
    one = found["standards/s.md"]
    assert (one["root_id"], one["bytes"], one["sha256"]) == ("root", 16, hashlib.sha256(b"# standards/s.md").hexdigest())


def test_required_columns_and_last_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,score\n007,1\n".encode())
    (tmp_path / "empty.csv").write_text("id,score\n")
    assert [tuple(r) for r in corpus.csv(spark, f"{tmp_path}/a.csv", ["id", "score"]).collect()] == [("007", "1")]
    for name, columns in (("a.csv", ["id", "name"]), ("empty.csv", ["id"])):
        with pytest.raises(ValueError):
            corpus.csv(spark, f"{tmp_path}/{name}", columns)
    (tmp_path / "r.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "b", "v"\n{"v": 9}\n')
    assert sorted(map(tuple, corpus.last_records(spark, f"{tmp_path}/r.jsonl", "k string, v long", "k").collect())) == [("a", 3), ("b", 2)]


def test_index_is_whole_or_refused(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "textbook", "x"), ("c2", "standard", "y")], "chunk_id string, source_type string, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, vec array<double>")
    postings = spark.createDataFrame([("x", "c1", 1.0)], "token string, chunk_id string, weight double")
    corpus.write_index(chunks, vectors, postings, f"{tmp_path}/whole")
    read = corpus.read_index(spark, f"{tmp_path}/whole")
    assert read["manifest"].first().asDict() == {"total_chunks": 2, "total_vectors": 2, "dim": 2} and read["postings"].count() == 1
    corpus.write_index(chunks, vectors.limit(1), postings, f"{tmp_path}/torn")
    with pytest.raises(ValueError):
        corpus.read_index(spark, f"{tmp_path}/torn")


def test_logical_paths(tmp_path, monkeypatch):
    assert session.located(str(tmp_path), "index") == str((tmp_path / "index").resolve())
    monkeypatch.setenv("CORVANA_INDEX", "other")
    assert session.located(str(tmp_path), "index").endswith("/other")
    monkeypatch.setenv("CORVANA_INDEX", "../up")
    for name, error in (("index", ValueError), ("nothing", KeyError)):
        with pytest.raises(error):
            session.located(str(tmp_path), name)


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (lambda s: t.section(s, "答案"), "## 题目\nq\n## 答案\r\nA\r\nB\n## 详解\nx", "A\r\nB"),
        (t.options, "A. one\n B 、two \nC: three\nI. no", [("A", "one"), ("B", "two"), ("C", "three")]),
        (t.formulas, r"\(c\) $a$ \[ d \] and $b$ or $a$", ["a", "b", "d", "c"]),
        (t.answer, "b ， 1,a", "1,A,B"),
        (t.gender, " male ", "M"),
        (t.gender, "女生", "F"),
        (t.gender, "?", "U"),
        (t.seat, "07.0", "7"),
        (t.seat, "A7.0", "A7.0"),
        (t.item_key, "（3）", "Q03"),
        (t.item_key, "12.(1)", "Q12__1"),
        (t.item_label, "5（答案A，C）", ("5", "A,C")),
        (t.title, ' a<b>:c  d"', "a-b-c  d"),
        (t.title, "con.txt", "_con.txt"),
        (t.title, "?", "video"),
        (t.title, "x" * 200, "x" * 120),
        (t.duration, "1:02:03", 3723.0),
        (t.duration, "90.5", 90.5),
        (t.duration, "1:x", None),
        (t.latex, r"$\left( a + b \right)$", "(a+b)"),
        (t.balanced, r"\left({a}\right", False),
        (t.balanced, r"\{ {a}(b)", True),
        (lambda s: chunking.chunk_id(F.lit("textbook"), s, F.lit(7)), "a.md", "textbook-a-0007"),
    ],
)
def test_text_functions(spark, make, given, want):
    assert value(spark, make, given) == want


def test_redaction_names_what_fired(spark):
    made = lambda s: F.struct(*t.redact(s, {"phone": r"\d{11}", "mail": r"\S+@\S+", "id": r"ID-\d+"}))
    assert tuple(value(spark, made, "call 13800000000 or a@b.c")) == ("call [REDACTED] or [REDACTED]", ["mail", "phone"])


def test_exercise_chunk(spark):
    text = "---\nquestion_type: choice\ndifficulty: hard\nknowledge_points:\n  - one\n  - 'two'\n---\n## 题目\n\nq ![a](b.png)\n## 答案\n\n![k](k.png)A\n## 详解\nno blank line\n"
    row = chunking.exercise(spark.createDataFrame([("/e.md", text)], "path string, text string")).first()
    assert (row["id"], row["title"], row["text"]) == ("exercise-e", "e choice one, two", "题目：q\n答案：![k](k.png)A\n详解：")
    assert (row["question"], row["answer"], row["explanation"]) == ("q", "![k](k.png)A", "")
    assert (row["question_type"], row["knowledge_points"], row["difficulty"]) == ("choice", ["one", "two"], 0.5)


def test_blank_values_keep_old_ones_and_headers_fill(spark):
    old, new = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string"), spark.createDataFrame([("a", ""), ("b", "z"), ("c", "w")], "k string, v string")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], ["v"], keep_blank=True).collect())) == [("a", "x"), ("b", "z"), ("c", "w")]
    cells = spark.createDataFrame([(1, "Q1"), (2, " "), (3, None), (4, "Q2")], "c int, top string")
    assert [r["top"] for r in ingest.forward_filled(cells, "top", "c").orderBy("c").collect()] == ["Q1", "Q1", "Q1", "Q2"]


def test_leaks_and_status_rejects(spark):
    files = spark.createDataFrame([("f", "by 王小明 and 王小"), ("g", "none")], "path string, text string")
    assert [tuple(r) for r in ingest.leaks(files, spark.createDataFrame([("王小",), ("王小明",)], "term string")).collect()] == [("f", "王小明")]
    rows = spark.createDataFrame([("present",), ("lost",), (None,)], "status string")
    bad = ingest.rejects(rows, {"status": ~F.col("status").isin("present", "missing_artifact")})
    assert {r["status"] for r in bad.collect()} == {"lost", None}


def test_exam_profile_and_bands(spark):
    rows = spark.createDataFrame([(0.5, 0.8, 10.0), (1.0, 0.6, 30.0), (None, 0.4, 20.0)], "mastery double, class_rate double, weight double")
    got = analytics.exam_profile(rows).first()
    assert (got["overall"], got["class_mean"]) == (pytest.approx(35 / 40), pytest.approx(34 / 40))  # both over the student-side weight
    bands = spark.createDataFrame([(0.75, 0.08), (0.55, -0.08), (0.35, 0.0), (0.1, None), (None, 0.2)], "r double, g double")
    got = [tuple(r) for r in bands.select(analytics.headline(F.col("r")), analytics.gap_band(F.col("g")), analytics.percent(F.col("r"))).collect()]
    assert got == [("strong", "above", "75.0%"), ("steady", "below", "55.0%"), ("fragile", "level", "35.0%"), ("critical", "unknown", "10.0%"), ("unknown", "above", "-")]
    assert [r[0] for r in bands.select(analytics.gap_text(F.col("g"))).collect()] == ["高于班均 +8.0%", "低于班均 -8.0%", "接近班均（+0.0%）", "暂无班级对照", "高于班均 +20.0%"]
    row = analytics.audit_row(spark, "me", "export", "v", 3).first()
    assert (row["actor"], row["action"], row["target"], row["row_count"]) == ("me", "export", "v", 3) and row["at"]


def test_exercise_issues(spark):
    long = "an explanation of more than twenty characters "
    rows = [("ok", "q", "B", long + "故选B"), ("none", "q", "无", long), ("short", "q $x", "A", "too short"), ("odd", "q", "A", long + "故选 C 见答案"), ("told", "q", "见详解", long + "故选C"), ("bare", "q", "", "")]
    got = {(r["path"], r["issue"]) for r in audit.exercise_issues(spark.createDataFrame(rows, "path string, question string, answer string, explanation string")).collect()}
    assert got == {("none", "no_answer"), ("short", "short_explanation"), ("short", "odd_dollars"), ("odd", "placeholder"), ("odd", "answer_mismatch")}


def test_segments_cues_and_retention(spark):
    rows = spark.createDataFrame([("v", 0, "1.0", "0.5", " hi "), ("v", 1, "2", None, "there"), ("v", 2, "3", "4", "...")], "id string, idx int, s string, e string, content string")
    assert sorted(tuple(r) for r in audit.normalized_segments(rows).collect()) == [("v", 0, 1.0, 1.0, "hi"), ("v", 1, 2.0, 2.0, "there")]
    said = spark.createDataFrame([(k, "look at the figure") for k in range(3)] + [(9, "chart")], "k int, text string")
    got = audit.cues(said, spark.createDataFrame([("figure",), ("chart",), ("table",)], "term string"), "k", "text", 2)
    assert sorted((r["term"], r["k"], r["n"], r["overflow"]) for r in got.collect()) == [("chart", 9, 1, 0), ("figure", 0, 3, 1), ("figure", 1, 3, 1)]
    files = spark.createDataFrame([("old", datetime.datetime(2024, 1, 1)), ("edge", datetime.datetime(2024, 1, 3)), ("new", datetime.datetime(2024, 1, 4))], "path string, modified timestamp")
    assert {r["path"] for r in audit.retained(files, "modified", 7, F.lit("2024-01-10").cast("timestamp")).collect()} == {"old", "edge"}


def test_stages_and_follow_ups(spark):
    queries = spark.createDataFrame([(1, "Import the PDF"), (2, "import and REVIEW"), (3, "review"), (4, "nothing")], "qid int, text string")
    rules = spark.createDataFrame([(1, "import", "import", "review"), (2, "audit", "review", None)], "ordinal int, stage string, term string, unless string")
    assert sorted(map(tuple, routing.stage(queries, rules).collect())) == [(1, "import"), (2, "audit"), (3, "audit")]
    primary = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, rec string")
    nexts = spark.createDataFrame([("a", "pdf", "ocr", 2), ("a", "import", "index", 1), ("a", "the", "ocr", 3), ("b", "pdf", "ocr", 1)], "rec string, term string, next string, ordinal int")
    assert [tuple(r) for r in routing.follow_ups(primary, queries, nexts).collect()] == [(1, ["index", "ocr"])]


def test_queue_transitions(spark):
    items = spark.createDataFrame([("a", "queued", 1), ("b", "done", None), ("c", "queued", 2)], "id string, status string, attempts int")
    events = spark.createDataFrame([("a", "start"), ("b", "start")], "id string, event string")
    table = spark.createDataFrame([("queued", "start", "running")], "status string, event string, next string")
    moved = queueing.advanced(items, events, table)
    assert sorted(map(tuple, moved.collect())) == [("a", "running", 1), ("b", "done", 0), ("c", "queued", 2)]
    assert {r[0] for r in moved.where("id <> 'b'").select(queueing.exhausted(F.col("attempts"), F.col("status"))).collect()} == {"running", "blocked"}


def test_cleanup_and_tags(spark):
    files = [("/tmp/a.log", "1", "log"), ("/keep/b.log", "2", "log"), ("/x/1.png", "3", "duplicate"), ("/x/2.png", "3", "duplicate"), ("/x/3.png", None, "duplicate"), ("/x/y", "4", "other")]
    got = reviews.cleanup(spark.createDataFrame(files, "path string, sha string, category string"), {"log": r"\.log$", "duplicate": r"\.png$"}, ["/keep/"])
    assert {r["path"] for r in got.where("eligible").collect()} == {"/tmp/a.log", "/x/2.png"}
    for tags, ok in ((["ab", "cd"], True), (["a"], False), (["ab", "ab"], False), (["a/b"], False), (["KP_12"], False), (["ab", " ab"], False), ([f"t{k:02}" for k in range(17)], False)):
        assert value(spark, hierarchy.tags_ok, tags, "s array<string>") is ok


def test_streamed_statuses(spark, tmp_path):
    events = spark.createDataFrame([("a", 2, "finish"), ("a", 1, "start"), ("b", 1, "finish")], "id string, seq int, event string")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    made = incremental.statuses(stream, {("queued", "start"): "running", ("running", "finish"): "done"})
    run = made.writeStream.outputMode("update").format("memory").queryName("statuses").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("statuses").collect())) == [("a", "done"), ("b", "queued")]


def test_streamed_copies_and_buckets(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("x", at(0), "k", 1.0), ("x", at(1), "k", 2.0), ("y", at(3), "k", 4.0)], "sha string, ts timestamp, event_type string, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, mode, make in (("copies", "append", incremental.unseen), ("buckets", "complete", incremental.bucket_counts)):
        stream = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert sorted(r["sha"] for r in spark.table("copies").collect()) == ["x", "y"]
    assert sorted((r["start"].minute, r["n"], r["total"]) for r in spark.table("buckets").collect()) == [(0, 2, 3.0), (2, 1, 4.0)]


def test_best_holds_k_rows_a_query():
    """Blocks of any number of vectors stream past; a first block of all of them gives the same as small ones."""
    rng = np.random.default_rng(2)
    q, v, ids = rng.integers(-3, 4, (7, 4)).astype(float), rng.integers(-3, 4, (3000, 4)).astype(float), rng.permutation(3000)
    parts = [retrieval.Best(np.arange(7), q, 5) for _ in range(2)]
    parts[0].add(ids, v)
    for at in range(0, 3000, 2):
        parts[1].add(ids[at : at + 2], v[at : at + 2])
        assert len(parts[1].ids) <= 35
    want = [(k, i, s) for k in range(7) for s, i in [(-a, b) for a, b in sorted(zip((-(v @ q[k])).tolist(), ids.tolist(), strict=True))[:5]]]
    for own in parts:
        assert list(zip(own.at.tolist(), own.ids.tolist(), own.scores.tolist(), strict=True)) == want


def test_scored_in_tiles(spark, monkeypatch):
    """Every pair, null where there is no product; no row goes through a join of pairs."""
    monkeypatch.setattr(retrieval, "PAIRS", 4)
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "qid long, q array<double>")
    b = spark.createDataFrame([("x", [3.0, 0.5]), ("y", [2.0]), ("z", [1.0, None])], "id string, v array<double>")
    got = retrieval.scored(a, b)
    assert {(r.qid, r.id): r.score for r in got.collect()} == {(1, "x"): 4.0, (3, "y"): 2.0} | {k: None for k in [(1, "y"), (1, "z"), (2, "x"), (2, "y"), (2, "z"), (3, "x"), (3, "z")]}
    assert "Join" not in got._jdf.queryExecution().toString()


def test_pairs_come_by_score(spark, tmp_path, monkeypatch):
    """All pairs of b11, and those of a task by score, so that a file holds equal scores side by side: over several batches and tiles,
    with vectors that are null, not finite or of another length."""
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.integers(-4, 5, 3)], 0) for k in rng.permutation(900)]
    rows += [(900, None, 0), (950, [1.0, 2.0], 0), (1000, [1.0, None, 1.0], 0), (1050, [float("nan"), 1.0, 0.0], 0), (1051, [float("inf"), 1.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    told = catalog.queries()["b11_pairwise"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    by_task = {}
    for r in told:
        if r.score is not None:
            by_task.setdefault(r.task, []).append(r.score)
    assert len(by_task) > 1 and all(np.array_equal(x, np.sort(x), equal_nan=True) for x in by_task.values())

    def want(q, v):
        if q is None or v is None or len(q) != len(v) or None in q or None in v:
            return None
        with np.errstate(invalid="ignore"):
            return float(np.round(np.sum(np.multiply(q, v)), 6))

    both = {(a, b): want(q, v) for a, q, _ in rows if a % 50 == 0 for b, v, _ in rows}
    assert len(told) == len(both) and {(r.qid, r.id): str(r.score) for r in told} == {k: str(x) for k, x in both.items()}
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 100)
    monkeypatch.setattr(retrieval, "PAIRS", 7)
    few = catalog.queries()["b11_pairwise"](spark, str(tmp_path))
    assert {(r.qid, r.id): str(r.score) for r in few.collect()} == {k: str(x) for k, x in both.items()} and few.count() == len(both)


def test_rosters_meet_evenly(spark):
    """Scores of one file and one key are dealt over tasks before their many partners are made."""
    roster, scores = spark.range(50).select(F.lit(1).alias("k"), "id"), spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("s")).coalesce(1)
    matched = ingest.aligned(roster, scores, ["k"])[0]
    assert matched.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism and matched.count() == 25_000


def test_pairs_of_rosters_are_stored_once(spark, tmp_path):
    """A score stands before a block of its partners, and the block comes again for the next score: a file need not hold all pairs."""
    roster, scores = spark.range(12_500).select(F.lit(1).alias("k"), "id").orderBy(F.xxhash64("id")), spark.range(320).select(F.lit(1).alias("k"), F.col("id").alias("s"))
    ingest.aligned(roster, scores, ["k"])[0].write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("s", "id").distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.7 * 4_000_000


@pytest.mark.parametrize("most", [0, 500_000])
def test_rosters_of_any_keys(spark, monkeypatch, most):
    """Blocks give the rows of a join: keys of two columns, nulls, copies, keys of one side, whether a roster is broadcast or not."""
    monkeypatch.setattr(ingest, "BROADCAST", most)
    monkeypatch.setattr(ingest, "BLOCK", 2)
    monkeypatch.setattr(ingest, "RUN", 3)
    monkeypatch.setattr(ingest, "SPREAD", 40)
    key = [F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("a"), F.when(F.col("id") > 60, "x").otherwise("y").alias("b")]
    roster = spark.range(90).select((F.col("id") / 2).cast("int").alias("n"), *key)
    scores = spark.range(30, 200).select(*key, F.when(F.col("id") % 5 > 0, F.col("id")).alias("s"), F.lit(1.5).alias("t"))
    scores = scores.union(scores.limit(9)).union(spark.sql("select 9L, 'x', 1L, 2.5"))
    got, want = ingest.aligned(roster, scores, ["a", "b"])[0], scores.join(roster, ["a", "b"])
    assert got.columns == want.columns and got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 1000
    assert ingest.aligned(roster.limit(0), scores, ["a", "b"])[0].count() == ingest.aligned(roster, scores.limit(0), ["a", "b"])[0].count() == 0


def test_formulas_of_whole_texts(spark, tmp_path):
    """Every delimiter of a text is read, as by three searches over the whole page."""
    text = r"$x$ \[ b\] y \(z\) $a+b$"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    page = r"$$a+b$$ \[ d \] " + text + r" \(e\) $c$ $$a+b$$"
    want = [m.strip() for p in (r"\$([^$\n]+)\$", r"\\\[([^\]]+)\\\]", r"\\\(([^\)]+)\\\)") for m in re.findall(p, page) if m.strip()]
    assert {"x", "b", "z", "d", "e"} & set(want) >= {"b", "z", "d", "e"}
    assert catalog.queries()["a13_formulas"](spark, str(tmp_path)).first()["formulas"] == "|".join(dict.fromkeys(want))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_texts(spark, monkeypatch):
    """What follows a text's key runs where its row was dealt, over tasks of a bounded number of rows."""
    docs = spark.range(9000).select(F.col("id").cast("string").alias("path"), F.lit("# a\n\n## b\nsome words of a text\n").alias("text"))
    assert tables.dealt(docs, "path", 100).rdd.getNumPartitions() == 90
    made = plan(chunking.textbook(docs))
    assert made.count("Exchange") == made.count("REPARTITION_BY_NUM") == 1
    made = plan(retrieval.sparse(retrieval.postings(docs.limit(2).withColumnRenamed("path", "qid"), "qid", "text").withColumnRenamed("id", "qid"), retrieval.postings(docs, "path", "text")))
    assert "hashpartitioning(qid" not in made.split("REPARTITION_BY_NUM")[0]


def test_ledger_without_copies(spark):
    """Distinct counts each take a row once; a task without a number is still one."""
    rows = spark.createDataFrame([(1, 1, 1, 7), (1, 2, 2, 7), (None, 1, 1, 1), (None, 1, 2, 2), (3, None, 1, 1)], "task_id long, attempt_id long, attempt_no long, worker_id long")
    found = reviews.ledger_problems(rows)
    assert {r["task_id"]: r["problems"] for r in found.collect()} == {1: ["worker_reused"], None: ["repeated"], 3: ["repeated"]}
    assert "Expand" not in plan(found)


def test_rules_read_a_text_once(spark):
    """Formula flags and file checks derive what they share once a row."""
    rows = spark.createDataFrame([("k", "e", "$ \\left x \\right $", 0.99, None)], "key string, engine string, text string, confidence double, risk_flags array<string>")
    judged = candidates.assessed(rows)
    assert judged.first()["risk_flags"] == ["single_character_formula"] and judged.columns == [*rows.columns, "norm", "status"]
    long = rows.withColumn("text", F.concat(F.repeat(F.lit(" $"), 300), F.lit("x"), F.repeat(F.lit("$ "), 300)))
    assert "single_character_formula" not in candidates.assessed(long).first()["risk_flags"]  # dollars with blanks between stay
    assert plan(judged.select("status", "risk_flags")).count("_text") > 2
    files = spark.createDataFrame([("p", "p.md", "---\nid: x\n---\nbody")], "path string, name string, text string")
    assert plan(wiki.compatibility(files)).count("map_from_entries") <= 1


def test_a_commit_moves_no_row_to_write(spark, tmp_path):
    """A bucket is written by every task that has rows of it, and read back whole."""
    store = versions.Store(spark, str(tmp_path), 4)
    rows = spark.range(1000).repartition(3).select(F.col("id").cast("string").alias("k"), "id")
    store.commit({"t": (rows, "k")})
    assert sorted(r.id for r in store.read("t").collect()) == list(range(1000))
    assert all(len(list(pathlib.Path(p).glob("*.parquet"))) == 3 for p in store.state()["t"]["buckets"].values())

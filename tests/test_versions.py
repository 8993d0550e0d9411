"""Stores whose tables change together: crashes between writes, other writers, replacement of documents, decisions, cutover."""

import pytest
from pyspark.sql import functions as F

from corvana.operators import consensus, reviews, versions

FOUND, CHILDREN, SHARED = "source_path string, sha string, mtime long, status string", "source_path string, n int, hash string", "hash string, seen string"


def scan(spark, rows):
    """Frames of (path, sha, mtime, hashes of children)."""
    found = spark.createDataFrame([(p, s, m, "scanned") for p, s, m, _ in rows], FOUND)
    children = spark.createDataFrame([(p, n, h) for p, _, _, hs in rows for n, h in enumerate(hs)], CHILDREN)
    shared = spark.createDataFrame(sorted({(h, min(p for p, _, _, hs in rows if h in hs)) for _, _, _, hs in rows for h in hs}), SHARED)
    return found, children, shared


def held(store):
    return {n: sorted(map(tuple, store.read(n).collect())) for n in ("documents", "occurrences", "shared")}


def test_documents_go_with_their_children(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path), 4)
    first = [("a", "1", 1, ["x", "y"]), ("b", "1", 1, ["y"]), ("c", "1", 1, [])]
    assert versions.replace_documents(store, *scan(spark, first)).count() == 3
    at = store.version()
    assert versions.replace_documents(store, *scan(spark, first)).count() == 0 and store.version() == at
    second = [("a", "2", 2, ["z"]), ("b", "1", 1, ["y"]), ("d", "1", 1, ["x"])]
    assert sorted(r[0] for r in versions.replace_documents(store, *scan(spark, second)).collect()) == ["a", "d"]
    got = held(store)
    assert got["documents"] == [("a", "2", 2, "scanned"), ("b", "1", 1, "scanned"), ("c", "1", 1, "scanned"), ("d", "1", 1, "scanned")]
    assert got["occurrences"] == [("a", 0, "z"), ("b", 0, "y"), ("d", 0, "x")]
    assert got["shared"] == [("x", "d"), ("y", "b"), ("z", "a")]
    assert sorted(r[0] for r in store.read("documents", at).collect()) == ["a", "b", "c"]  # the state before can still be read


@pytest.mark.parametrize("step", ["documents", "occurrences", "shared", "publish"])
def test_crash_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    store = versions.Store(spark, str(tmp_path), 4)
    versions.replace_documents(store, *scan(spark, [("a", "1", 1, ["x"])]))
    before, write, publish = held(store), versions.Store.write, versions.Store.publish

    def broken_write(self, name, rows, key):
        done = write(self, name, rows, key)
        if name == step:
            raise OSError("lost")
        return done

    def broken_publish(self, number, state):
        raise OSError("lost")

    monkeypatch.setattr(versions.Store, "write", broken_write)
    if step == "publish":
        monkeypatch.setattr(versions.Store, "publish", broken_publish)
    with pytest.raises(OSError, match="lost"):
        versions.replace_documents(store, *scan(spark, [("a", "2", 2, ["z"])]))
    assert held(versions.Store(spark, str(tmp_path), 4)) == before
    monkeypatch.setattr(versions.Store, "write", write)
    monkeypatch.setattr(versions.Store, "publish", publish)
    versions.replace_documents(store, *scan(spark, [("a", "2", 2, ["z"])]))
    assert held(store)["occurrences"] == [("a", 0, "z")]


def test_second_writer_is_told(spark, tmp_path):
    store, rows = versions.Store(spark, str(tmp_path), 2), spark.createDataFrame([("a", 1)], "k string, v int")
    assert store.commit({"t": (rows, "k")}, since=0) == 1
    with pytest.raises(versions.Conflict):
        store.commit({"t": (rows.limit(0), "k")}, since=0)
    assert store.version() == 1 and store.read("t").count() == 1
    assert not [n for n in store.manifests.names() if n.startswith(".") and not n.endswith(".crc")]


def audited(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path), 4)
    previews = spark.createDataFrame([("A", "k1", "s1", "open"), ("A", "k2", "s2", "open"), ("B", "k3", "s3", "open")], "audit string, key string, sha string, status string")
    results = spark.createDataFrame([("k1", "pending", 7), ("k3", "pending", 8)], "key string, final_status string, size int")
    uses = spark.createDataFrame([("d1", "k1", "open"), ("d1", "k3", "open"), ("d2", "k2", "open"), ("d3", None, "open")], "source_path string, key string, status string")
    store.commit({"previews": (previews, "key"), "results": (results, "key"), "occurrences": (uses, "source_path")})
    return store


def test_decisions_of_a_whole_audit(spark, tmp_path):
    store = audited(spark, tmp_path)
    told = spark.createDataFrame([("k1", "s1", "accepted"), ("k2", "s2", "rejected")], "key string, sha string, status string")
    versions.apply_decisions(store, "A", told)
    assert sorted(map(tuple, store.read("previews").select("key", "status").collect())) == [("k1", "accepted"), ("k2", "rejected"), ("k3", "open")]
    assert sorted(map(tuple, store.read("results").collect())) == [("k1", "accepted", 7), ("k2", "rejected", None), ("k3", "pending", 8)]
    assert sorted(map(tuple, store.read("occurrences").select("source_path", "status").collect())) == [("d1", "accepted"), ("d1", "open"), ("d2", "rejected"), ("d3", "open")]


@pytest.mark.parametrize("told", [[("k1", "s1", "ok")], [("k1", "s1", "ok"), ("k2", "other", "ok")], [("k1", "s1", "ok"), ("k2", "s2", "ok"), ("k3", "s3", "ok")], [("k1", "s1", "ok"), ("k1", "s1", "no"), ("k2", "s2", "ok")]])
def test_decisions_that_do_not_fit(spark, tmp_path, told):
    store = audited(spark, tmp_path)
    with pytest.raises(ValueError, match="audit A"):
        versions.apply_decisions(store, "A", spark.createDataFrame(told, "key string, sha string, status string"))
    assert store.version() == 1


@pytest.mark.parametrize("crash", ["none", "before", "after"])
def test_cutover_and_replay(spark, tmp_path, monkeypatch, crash):
    """Whatever step a migration stops at, doing it again or replaying the journal leaves it done once."""
    store = versions.Store(spark, str(tmp_path), 2)
    store.commit({"ledger": (spark.createDataFrame([("q", "old")], "question_id string, phase string"), "question_id")})
    new = {"ledger": (spark.createDataFrame([("q", "new"), ("r", "new")], "question_id string, phase string"), "question_id")}
    publish = versions.Store.publish

    def broken(self, number, state):
        if crash == "after":
            publish(self, number, state)
        raise OSError("lost")

    if crash != "none":
        monkeypatch.setattr(versions.Store, "publish", broken)
        with pytest.raises(OSError, match="lost"):
            versions.cutover(store, "ledger", new, "v2")
        assert store.read("ledger").count() == (2 if crash == "after" else 1)
        monkeypatch.setattr(versions.Store, "publish", publish)
        assert versions.replay(store) == {"v2": 2}
    assert versions.cutover(store, "ledger", new, "v2") == 2 and store.version() == 2
    assert store.read("ledger").count() == 2 and versions.replay(store) == {"v2": 2}


def test_cutover_that_another_commit_overtook(spark, tmp_path, monkeypatch):
    store = versions.Store(spark, str(tmp_path), 2)
    rows = spark.createDataFrame([("q", "old")], "question_id string, phase string")
    monkeypatch.setattr(versions, "replay", lambda s: {"v2": 0})
    versions.cutover(store, "ledger", {"ledger": (rows, "question_id")}, "v2")
    monkeypatch.undo()
    store.commit({"other": (rows, "question_id")})
    with pytest.raises(versions.Conflict):
        versions.replay(store)
    assert "ledger" not in store.state()


def test_legacy_items(spark):
    schema = "campaign string, question_id string, queue_ordinal int, target_path string, current_sha256 string, source_state string, source_key string, source_path string, source_sha256 string, severities array<string>"
    items = [
        ("c", "q1", 1, "t\\1", "h1", "source_ready", None, "s\\1", "g1", ["P1", "P0"]),
        ("c", "q2", 2, "t/2", "h2", "source_ready", "", "s/2", "other", ["P1"]),
        ("c", "q3", 2, "t/9", "h3", "blocked", None, None, None, None),
        ("d", "q4", 2, "t/1", "old", "source_ready", None, None, None, []),
    ]
    files = spark.createDataFrame([("t/1", "h1", 10), ("t/2", "h2", 20), ("s/1", "g1", 5), ("s/2", "g2", 6)], "path string, sha256 string, bytes long")
    ledger, drift, problems = reviews.legacy_ledger(spark.createDataFrame(items, schema), files, ["q2"])
    got = {r["question_id"]: (r["severity"], r["source_ready"], r["target"] and r["target"]["bytes"], r["source"] and r["source"]["bytes"], r["initial_status"]) for r in ledger.collect()}
    assert got == {"q1": ("P0", True, 10, 5, "queued"), "q2": ("P1", False, 20, None, "legacy_no_change_pending_audit"), "q3": ("P1", False, None, None, "queued"), "q4": ("P1", True, 10, None, "queued")}
    assert [tuple(r) for r in drift.collect()] == [("c", "q2", "source_hash_or_path_drift", "s/2", "other")]
    assert {tuple(r) for r in problems.collect()} == {("c", "q3", "missing_target"), ("d", "q4", "target_drift"), ("c", "q2", "duplicate_ordinal"), ("c", "q3", "duplicate_ordinal")}
    assert {tuple(r) for r in reviews.campaigns(ledger, drift).collect()} == {("c", 3, 1, 2, 1, 1), ("d", 1, 1, 0, 0, 0)}


@pytest.mark.parametrize(("cap", "most"), [(90, None), (90, 3), (0, None)])
def test_packing_by_jumps(spark, cap, most):
    rows = [("a", k, (k * 37) % 61 if k % 5 else 0) for k in range(400)] + [("b", k, 0) for k in range(20)] + [("c", 1, 0), ("c", 2, 100), ("c", 3, 10)]
    df = spark.createDataFrame(rows, "k string, o long, s long")
    got = sorted(map(tuple, consensus.packed_by_jumps(df, "k", "o", "s", cap, most).collect()))
    assert got == sorted(map(tuple, consensus.packed(df, "k", "o", "s", cap, most).collect()))
    assert [r for r in got if r[0] == "c"] == [("c", 1, 0), ("c", 2, 1), ("c", 3, 2)]


def test_boxes_merge_into_the_grown_one(spark):
    boxes = [("p", 0, 0, 50, 30), ("p", 10, 33, 90, 40), ("p", 0, 44, 50, 90), ("p", 0, 95, 60, 130), ("p", 0, 140, 10, 200), ("q", 0, 0, 20, 10), ("q", 5, 12, 40, 20)]
    df = spark.createDataFrame(boxes, "page string, x0 int, y0 int, x1 int, y1 int").withColumn("size", F.struct(F.lit(500).alias("width"), F.lit(400).alias("height")))
    # The second joins the first for it is low; the third is 4 from the grown box, but neither is low any more.
    assert {tuple(r) for r in consensus.merged_boxes(df, "page", "size").collect()} == {("p", 0, 0, 90, 40), ("p", 0, 44, 50, 90), ("p", 0, 95, 60, 130), ("q", 0, 0, 40, 20)}
    assert consensus.merged_boxes(df.limit(0), "page", "size").count() == 0


@pytest.mark.parametrize("block", [1, 7, 64])
def test_packing_over_blocks(spark, monkeypatch, block):
    """Groups that begin in one block of rows and end in another, and keys over many blocks, are those of one stream."""
    monkeypatch.setattr(consensus, "BLOCK", block)
    df = spark.createDataFrame([("a", k, (k * 37) % 61 if k % 5 else 0) for k in range(100)] + [("b", k, 0) for k in range(20)] + [("c", 1, 100)], "k string, o long, s long")
    got, want = (sorted(map(tuple, f(df, "k", "o", "s", 90, 4).collect())) for f in (consensus.packed_by_jumps, consensus.packed))
    assert got == want

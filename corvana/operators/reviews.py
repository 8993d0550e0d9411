"""Reviews and contracts: rule checks, identity binding, ledgers, reviewed replacements, plans by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Absolute paths, drive letters and steps upwards.
UNSAFE_PATH = r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)"


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in the order given; a rule that is null holds."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items())))


def contract(rows: DataFrame, payload: str, keys: list[str], ranges: dict | None = None, enums: dict | None = None, lists: tuple = (), paths: tuple = (), most: int = 16_384) -> DataFrame:
    """rows with `problems` of a JSON payload: size, exact key set, ranges, enumerations, unique references, safe paths."""
    at = lambda k: F.get_json_object(payload, f"$.{k}")
    rules = {"too_large": F.octet_length(payload) > most, "keys": ~F.array_sort(F.json_object_keys(payload)).eqNullSafe(F.array(*map(F.lit, sorted(keys))))}
    rules |= {f"range:{k}": ~at(k).try_cast("double").between(*v) for k, v in (ranges or {}).items()}
    rules |= {f"enum:{k}": ~at(k).isin(*v) for k, v in (enums or {}).items()}
    for k in lists:
        refs = F.from_json(at(k), "array<string>")
        rules[f"repeated:{k}"] = F.size(F.array_distinct(refs)) != F.size(refs)
    rules |= {f"path:{k}": at(k).rlike(UNSAFE_PATH) for k in paths}
    return rows.withColumn("problems", broken(rules))


def ledger_problems(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(task_id, problems) of tasks whose attempts (task_id, attempt_id, attempt_no, worker_id) are too many, repeat an
    identity or a worker, or are not numbered from 1 without gaps."""
    found = attempts.groupBy("task_id").agg(F.count("*").alias("n"), F.min("attempt_no").alias("least"), F.max("attempt_no").alias("last"))
    for c in ("attempt_id", "attempt_no", "worker_id"):  # each by itself: together, every row would travel once for each of them
        each = attempts.groupBy(F.col("task_id").alias("_task")).agg(F.countDistinct(c).alias(f"n_{c}"))
        found = found.join(each, F.col("task_id").eqNullSafe(F.col("_task"))).drop("_task")
    rules = {
        "too_many": F.col("n") > most,
        "repeated": (F.col("n_attempt_id") < F.col("n")) | (F.col("n_attempt_no") < F.col("n")),
        "worker_reused": F.col("n_worker_id") < F.col("n"),
        "gap": (F.col("least") != 1) | (F.col("last") != F.col("n_attempt_no")),
    }
    return found.select("task_id", broken(rules).alias("problems")).where(F.size("problems") > 0)


def mismatches(results: DataFrame, cards: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatches): fields of each result that differ from its card, with both values; a missing card has none right."""
    expected = cards.select(key, *(F.col(c).cast("string").alias(f"_want_{c}") for c in fields), F.lit(True).alias("_card"))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_want_{c}").alias("expected"), F.col(c).cast("string").alias("actual")) for c in fields))
    wrong = F.filter(pairs, lambda x: F.col("_card").isNull() | ~x["expected"].eqNullSafe(x["actual"]))
    return results.select(key, *fields).join(expected, key, "left").select(key, wrong.alias("mismatches"))


def drift(items: DataFrame, current: DataFrame, key: str, capabilities: dict[str, str], other: str) -> DataFrame:
    """items(key, sha, severity) with `drift` against the current hashes (key, sha) and the capability of their severity."""
    now = current.select(key, F.col("sha").alias("_now"))
    kind = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha"), "same").otherwise("changed")
    needs = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in capabilities.items()), F.lit(other))
    return items.join(now, key, "left").select(*items.columns, kind.alias("drift"), needs.alias("capability"))


def unverified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files (path, sha) of a handoff that are not there with the hash it names."""
    return expected.join(found.select("path", "sha").distinct(), ["path", "sha"], "left_anti")


def sync_plan(source: DataFrame, target: DataFrame, forbidden: str) -> DataFrame:
    """(path, action): what makes the target's files (path, sha) the source's; paths that match `forbidden` are blocked."""
    both = source.select("path", F.col("sha").alias("s")).join(target.select("path", F.col("sha").alias("t")), "path", "full")
    action = F.when(F.col("path").rlike(forbidden), "blocked").when(F.col("s").isNull(), "delete").when(F.col("t").isNull(), "create").when(F.col("s") == F.col("t"), "keep")
    return both.select("path", F.coalesce(action, F.lit("update")).alias("action"))


def cleanup(files: DataFrame, categories: dict[str, str], protected: list[str]) -> DataFrame:
    """files(path, sha, category) with `eligible`: the category's pattern fits, no protected marker is in the path, and a
    file of category `duplicate` has a smaller path of the same content, which stays."""
    owners = files.where("sha is not null").groupBy("sha").agg(F.min("path").alias("_owner"))
    allowed = F.coalesce(*(F.when(F.col("category") == k, F.col("path").rlike(v)) for k, v in categories.items()), F.lit(False))
    marked = F.exists(F.array(*map(F.lit, protected)), lambda m: F.contains(F.col("path"), m)) if protected else F.lit(False)
    proven = (F.col("category") != "duplicate") | F.coalesce(F.col("_owner") < F.col("path"), F.lit(False))
    return files.join(owners, "sha", "left").select(*files.columns, F.coalesce(allowed & ~marked & proven, F.lit(False)).alias("eligible"))


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """One case for each combination of the axes' values, the last axis fastest: case_id and a column for each axis."""
    total = 1
    for values in axes.values():
        total *= len(values)
    cases, below, out = spark.range(total).withColumnRenamed("id", "case_id"), total, ["case_id"]
    for name, values in axes.items():
        below //= len(values)
        place = F.floor(F.col("case_id") / below) % len(values) + 1
        out.append(F.element_at(F.array(*map(F.lit, values)), place.cast("int")).alias(name))
    return cases.select(*out)


def sampled(spark: SparkSession, curve: Callable[[Column], Column], low: float, high: float, n: int) -> DataFrame:
    """(x, y) of a column function at n even places; columns are the allow-list, no text is evaluated."""
    if not (2 <= n <= 5000 and low < high):
        raise ValueError("2 to 5000 samples of a rising domain are needed")
    x = F.lit(float(low)) + F.col("id") * F.lit((high - low) / (n - 1))
    return spark.range(n).select(x.alias("x")).select("x", curve(F.col("x")).cast("double").alias("y"))


def passes(answer: Column, any_of: list[str] = (), all_of: list[str] = (), none_of: list[str] = (), value: Column | None = None, expected: float | None = None, tolerance: float = 1e-3) -> Column:
    """Whether an answer has one of, all of and none of some phrases, and a value near what is expected."""
    has = lambda x: F.contains(F.lower(answer), F.lower(F.lit(x)))
    out = F.lit(True)
    if any_of:
        out &= F.greatest(*map(has, any_of), F.lit(False))
    for x in all_of:
        out &= has(x)
    for x in none_of:
        out &= ~has(x)
    if expected is not None:
        out &= F.abs(value - expected) <= tolerance
    return F.coalesce(out, F.lit(False))


def adapted(rows: DataFrame, fields: dict[str, str], hashed: list[str] = ()) -> DataFrame:
    """Older records under new names (new to old), with <name>_sha256 for some; fields that they lack are null."""
    old = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(*(old(v).alias(k) for k, v in fields.items()), *(F.sha2(old(fields[k]).cast("string"), 256).alias(f"{k}_sha256") for k in hashed))


def migrated(items: DataFrame, phases: dict[str, str], other: str = "blocked") -> DataFrame:
    """items with the phase that a retired one maps to."""
    return items.withColumn("phase", F.coalesce(*(F.when(F.col("phase") == k, v) for k, v in phases.items()), F.lit(other)))


def legacy_ledger(items: DataFrame, files: DataFrame, unchanged: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, drift, problems) of a retired ledger's items (campaign, question_id, queue_ordinal, target_path, current_sha256,
    source_state, source_key, source_path, source_sha256, severities) against files (path, sha256, bytes).

    An item is P0 if P0 is among its severities, else P1, and queued unless it is one of `unchanged`. A source that is ready but
    whose file is gone or has another hash is drift: the item stays, without source. A target that is gone or has another hash,
    and an ordinal that a campaign has twice, are problems; with any of them a ledger is not to be cut over."""
    plain = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    rows = items.withColumns({"target_path": plain(F.col("target_path")), "_source": plain(F.coalesce(F.nullif("source_key", F.lit("")), F.nullif("source_path", F.lit(""))))})
    target = files.select(F.col("path").alias("target_path"), F.struct("path", "sha256", "bytes").alias("target"))
    source = files.select(F.col("path").alias("_source"), F.struct("path", "sha256", "bytes").alias("_found"))
    rows = rows.join(target, "target_path", "left").join(source, "_source", "left")
    asked = F.coalesce((F.col("source_state") == "source_ready") & F.col("_source").isNotNull(), F.lit(False))
    held = asked & F.coalesce(F.col("_found.sha256") == F.col("source_sha256"), F.lit(False))
    ready = F.coalesce(F.col("source_state") == "source_ready", F.lit(False)) & (~asked | held)
    severity = F.when(F.coalesce(F.array_contains("severities", "P0"), F.lit(False)), "P0").otherwise("P1")
    status = F.when(F.col("question_id").isin(list(unchanged)), "legacy_no_change_pending_audit").otherwise("queued")
    ledger = rows.select("campaign", "question_id", F.col("queue_ordinal").cast("int").alias("queue_ordinal"), severity.alias("severity"), ready.alias("source_ready"), "target", F.when(held, F.col("_found")).alias("source"), status.alias("initial_status"))
    drift = rows.where(asked & ~held).select("campaign", "question_id", F.lit("source_hash_or_path_drift").alias("defect"), F.col("_source").alias("path"), F.col("source_sha256").alias("sha256"))
    lost = rows.select("campaign", "question_id", F.when(F.col("target").isNull(), "missing_target").when(~F.col("target.sha256").eqNullSafe(F.col("current_sha256")), "target_drift").alias("problem")).where("problem is not null")
    twice = rows.groupBy("campaign", "queue_ordinal").agg(F.collect_set("question_id").alias("ids"), F.count("*").alias("n")).where("n > 1").select("campaign", F.explode("ids").alias("question_id"), F.lit("duplicate_ordinal").alias("problem"))
    return ledger, drift, lost.union(twice)


def campaigns(ledger: DataFrame, drift: DataFrame) -> DataFrame:
    """(campaign, item_count, source_ready, source_blocked, unchanged, drift) of each campaign of a ledger."""
    n = drift.groupBy("campaign").agg(F.count("*").alias("drift"))
    counts = ledger.groupBy("campaign").agg(F.count("*").alias("item_count"), F.count_if("source_ready").alias("source_ready"), F.count_if(~F.col("source_ready")).alias("source_blocked"), F.count_if(F.col("initial_status") == "legacy_no_change_pending_audit").alias("unchanged"))
    return counts.join(n, "campaign", "left").fillna(0, ["drift"])


def review_problems(reviews: DataFrame, assets: DataFrame, references: DataFrame) -> DataFrame:
    """reviews(key, replacement, evidence, confidence, sha) with problems: no evidence or text, confidence outside 0 to 1, a
    hash other than the asset's (key, sha), or no reference (doc_id, key, ref) to replace."""
    used = references.groupBy("key").agg(F.count("*").alias("_uses"))
    known = reviews.join(assets.select("key", F.col("sha").alias("_sha")), "key", "left").join(used, "key", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {"no_evidence": blank("evidence"), "no_replacement": blank("replacement"), "confidence": ~F.col("confidence").between(0, 1), "hash": F.col("_sha") != F.col("sha"), "unreferenced": F.coalesce("_uses", F.lit(0)) < 1}
    return known.select(*reviews.columns, broken(rules).alias("problems"))


def by_basename(reviews: DataFrame, assets: DataFrame) -> DataFrame:
    """reviews(path, ..) with the key of the asset (key, path) at their path, else of the one asset that has the path's last part; null
    where none or several do."""
    last = lambda c: F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), r"([^/]+)$", 1)
    exact = assets.groupBy("path").agg(F.min("key").alias("_exact"))
    named = assets.groupBy(last(F.col("path")).alias("_base")).agg(F.when(F.countDistinct("key") == 1, F.min("key")).alias("_only"))
    rows = reviews.withColumn("_base", last(F.col("path"))).join(exact, "path", "left").join(named, "_base", "left")
    return rows.select(*reviews.columns, F.coalesce("_exact", "_only").alias("key"))


def apply_reviews(docs: DataFrame, references: DataFrame, reviews: DataFrame) -> DataFrame:
    """docs(doc_id, text) with every reviewed reference replaced, and the sorted keys that stay unresolved."""
    told = references.join(reviews.select("key", "replacement"), "key", "left")
    done = F.array_sort(F.collect_set(F.when(F.col("replacement").isNotNull(), F.struct("ref", "replacement"))))
    byd = told.groupBy("doc_id").agg(done.alias("_done"), F.array_sort(F.collect_set(F.when(F.col("replacement").isNull(), F.col("key")))).alias("unresolved"))
    text = F.aggregate(F.coalesce("_done", F.array().cast("array<struct<ref:string,replacement:string>>")), F.col("text"), lambda a, x: F.replace(a, x["ref"], x["replacement"]))
    return docs.select("doc_id", "text").join(byd, "doc_id", "left").select("doc_id", text.alias("text"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"))


def bound(expected: DataFrame, supplied: DataFrame) -> DataFrame:
    """(audit, bound): whether an audit's supplied previews (audit, key, sha) are exactly the expected ones."""
    both = expected.select("audit", "key", F.col("sha").alias("e")).join(supplied.select("audit", "key", F.col("sha").alias("s")), ["audit", "key"], "full")
    return both.groupBy("audit").agg(F.bool_and(F.coalesce(F.col("e") == F.col("s"), F.lit(False))).alias("bound"))


def decided(old: DataFrame, decisions: DataFrame, sure: DataFrame) -> DataFrame:
    """Decisions (audit, key, status) over old ones, of bound audits alone: an audit is taken whole or not at all."""
    taken = decisions.join(sure.where("bound").select("audit"), "audit", "left_semi").select("audit", "key", F.col("status").alias("_new"))
    return old.join(taken, ["audit", "key"], "full").select("audit", "key", F.coalesce("_new", "status").alias("status"))


def unique_or(primary: DataFrame, fallback: DataFrame, key: str, value: str, final: str) -> DataFrame:
    """(key, value): the primary value where there is just one and it is final, else the fallback's."""
    one = primary.groupBy(key).agg(F.when((F.countDistinct(value) == 1) & (F.count(value) == F.count("*")) & F.bool_and(final), F.min(value)).alias("_one"))
    return one.join(fallback.select(key, F.col(value).alias("_two")), key, "full").select(key, F.coalesce("_one", "_two").alias(value))


def merged_evidence(own: DataFrame, inherited: DataFrame) -> DataFrame:
    """(key, resolution, kind): the latest own resolution (key, resolution, kind, at), the inherited one only where none is."""
    latest = lambda rows, c: rows.groupBy("key").agg(F.max_by(F.struct("resolution", "kind"), F.struct("at", "resolution")).alias(c))
    row = F.coalesce("_own", "_old")
    return latest(own.where("resolution is not null"), "_own").join(latest(inherited, "_old"), "key", "full").select("key", row["resolution"].alias("resolution"), row["kind"].alias("kind"))


def replacement_counts(references: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc_id, formula, diagram, unmatched) of the references (doc_id, key) of each document."""
    told = references.join(merged, "key", "left")
    return told.groupBy("doc_id").agg(*(F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in ("formula", "diagram")), F.count_if(F.col("resolution").isNull()).alias("unmatched"))


def changed(files: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Files that no known row equals in path, hash and time; the others need no work."""
    return files.join(known.select(*by).distinct(), by, "left_anti")


def reject_reason(kind: Column, text: Column, ink: Column, templates: list[str], garbage: list[str]) -> Column:
    """Why a line candidate is unusable, the first rule that fits; null if none does."""
    holds = lambda words: F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(w)) for w in words))
    count = lambda p: F.regexp_count(text, F.lit(p))
    formula, n = kind == "formula", F.length(text)
    repeats = (count(r"\\qquad") >= 3) | ((t.repetition(text) >= 0.25) & (n > 70)) | (count(r"\\frac") >= 7)
    rules = [("empty", F.coalesce(text, F.lit("")) == ""), ("template_text", holds(templates)), ("garbage", holds(garbage) | text.rlike(r"[\x{3040}-\x{30ff}]")), ("unbalanced", formula & ~t.balanced(text)), ("repetition", repeats), ("too_long", formula & (n > 420)), ("low_ink", (ink < 0.002) & (n > 12))]
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules))


def line_score(kind: Column, source: Column, text: Column, mean: Column, ink: Column, reason: Column, templates: list[str], hint: str, bases: dict[str, float]) -> Column:
    """Confidence in a candidate: what its reader says, or its source's base, less a penalty for each sign of trouble."""
    less = lambda c, by: F.when(F.coalesce(c, F.lit(False)), -by).otherwise(0.0)
    n, repeated = F.length(text), t.repetition(text) > 0.18
    plain = F.coalesce(mean, F.lit(0.58)) + less(n <= 2, 0.12) + less(F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(w)) for w in templates)), 0.3) + less(ink < 0.003, 0.2) + less(reason.isNotNull(), 0.45)
    base = F.coalesce(*(F.when(source == k, v) for k, v in bases.items()), F.lit(0.5))
    made = base + less(text.rlike(hint), -0.08) + less(n < 8, 0.18) + less(n > 220, 0.12) + less(repeated, 0.18) + less(reason.isNotNull(), 0.5) + less(ink < 0.004, 0.18)
    score = F.when(kind == "formula", F.least(F.lit(0.9), made)).otherwise(F.least(F.lit(0.97), plain))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), score))


def ranked_lines(candidates: DataFrame, templates: list[str], garbage: list[str], hint: str, bases: dict[str, float], keep: int = 8) -> DataFrame:
    """(line_id, final, confidence, status, reason, alternatives) from candidates (line_id, line_type, source, kind, text,
    mean, ink). Formula lines prefer formulas; a line without usable candidate abstains with its best one's reason."""
    c = {k: F.col(k) for k in ("kind", "source", "text", "mean", "ink")}
    rows = candidates.withColumn("reason", reject_reason(c["kind"], c["text"], c["ink"], templates, garbage))
    rows = rows.withColumn("score", line_score(*c.values(), F.col("reason"), templates, hint, bases))
    sure = F.when(F.col("kind") == "formula", 0.78).otherwise(0.80)
    rows = rows.withColumn("status", F.when(F.col("reason").isNotNull() | (F.col("score") < 0.55), "abstain").when(F.col("score") >= sure, "final").otherwise("candidate"))
    fits = (F.col("line_type") != "formula") | (F.col("kind") == "formula")
    by_score = Window.partitionBy("line_id").orderBy(F.desc("score"), "source", "text")
    rows = rows.withColumn("n", F.row_number().over(by_score))
    order = F.struct((F.col("status") != "abstain").alias("usable"), fits.alias("fits"), (-F.col("n")).alias("n"))
    order = F.when(F.col("status") != "abstain", order).otherwise(F.struct(F.lit(False).alias("usable"), F.lit(False).alias("fits"), (-F.col("n")).alias("n")))
    best = F.max_by(F.struct("text", "score", "status", "reason"), order)
    listed = F.array_sort(F.collect_list(F.when(F.col("n") <= keep, F.struct("n", "source", "text", "score", "reason"))))
    out = rows.groupBy("line_id").agg(best.alias("b"), listed.alias("alternatives"))
    usable = F.col("b.status") != "abstain"
    return out.select("line_id", F.when(usable, F.col("b.text")).alias("final"), F.round(F.when(usable, F.col("b.score")).otherwise(0.0), 3).alias("confidence"), F.col("b.status").alias("status"), F.col("b.reason").alias("reason"), "alternatives")

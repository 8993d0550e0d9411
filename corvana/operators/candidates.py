"""Formula and page candidates of several readers: what speaks against each, what they agree on, what a person has to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of a final and of any usable reading; signs that a reading needs a second look, by pattern.
FINAL, USABLE = 0.92, 0.55
SIGNS = {
    "chinese_formula_text": r"[\x{3400}-\x{9fff}]",
    "vector_notation": r"\\(?:vec|rightharpoonup|overrightarrow|mathbf)\b",
    "nuclear_or_multi_script": r"\{\}\s*[_^]\{|[_^]\{[^}]+\}.*[_^]\{[^}]+\}",
    "fraction_or_root": r"\\(?:frac|dfrac|tfrac|sqrt)\b",
}
COMPLEX = r"\\(?:begin\{(?:matrix|cases)|sum|int)\b"
#: Spread of page scores and confidence that make a conflict; signs of a page's marker that count for the page.
SPREAD, UNSURE, MARKER_SIGNS = 60, 0.65, ("picture_omitted", "ocr_garbled", "empty_text")


def none() -> Column:
    return F.array().cast("array<string>")


def stripped(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")


def norm(text: Column) -> Column:
    """A formula without what only presents it: dollars, brackets around all of it, sizes of delimiters, white space."""
    x = stripped(F.regexp_replace(stripped(text), r"^\$+|\$+$", ""))
    wrapped = (F.startswith(x, F.lit(r"\[")) & F.endswith(x, F.lit(r"\]"))) | (F.startswith(x, F.lit(r"\(")) & F.endswith(x, F.lit(r"\)")))
    x = F.when(wrapped & (F.length(x) >= 4), F.substring(x, F.lit(3), F.length(x) - 4)).otherwise(x)
    return F.regexp_replace(F.replace(F.replace(x, F.lit(r"\left"), F.lit("")), F.lit(r"\right"), F.lit("")), r"\s+", "")


def flagged(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that hold; a null holds not."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rules[k], F.lit(False)), F.lit(k)) for k in sorted(rules))))


def assessed(candidates: DataFrame, garbled: str | None = None, active: list[str] | None = None) -> DataFrame:
    """candidates(key, engine, text, confidence, risk_flags) with norm, risk_flags and status.

    Flags are those a candidate brings and ten of the text: garbled is a pattern of the reader's own garbage. An engine that is not
    among the active ones is flagged as well. An empty text, or a confidence below `USABLE`, abstains; all else is a candidate, as
    one reading alone is never final. A null confidence says nothing."""
    candidates = candidates.withColumn("_text", stripped(F.col("text")))  # once a row, not once a rule
    text, confidence = F.col("_text"), F.col("confidence")
    # What a single character has around it is few signs but white space, dollars and sizes: most texts are no formula of one.
    left = F.replace(F.replace(F.substring("text", 1, 200), F.lit(r"\left"), F.lit("")), F.lit(r"\right"), F.lit(""))
    short = F.length(F.regexp_replace(left, r"[\s$]+", "")) <= 16
    rules = {k: text.rlike(p) for k, p in SIGNS.items()} | {
        "empty_candidate": text == "",
        "replacement_character": F.contains(text, F.lit("�")),
        "low_confidence": confidence < FINAL,
        "unresolved_engine_specific_garble": text.rlike(garbled) if garbled else F.lit(False),
        "single_character_formula": F.when(short, norm(F.col("text")).rlike("^[A-Za-z0-9α-ωΑ-Ω]$")).otherwise(F.lit(False)),
        "complex_formula_structure": (F.length(text) - F.length(F.replace(text, F.lit(r"\frac"), F.lit(""))) >= 10) | text.rlike(COMPLEX),
    }
    if active is not None:
        rules["disabled_by_profile"] = ~F.coalesce(F.col("engine").isin(active), F.lit(False))
    flags = F.array_sort(F.array_union(flagged(rules), F.coalesce("risk_flags", none())))
    status = F.when((text == "") | F.coalesce(confidence < USABLE, F.lit(False)), "machine_abstain").otherwise("machine_candidate")
    return candidates.withColumns({"risk_flags": flags, "norm": norm(F.col("text")), "status": status}).drop("_text")


def resolved(judged: DataFrame, required: list[str], geometry: DataFrame | None = None, order: list[str] = ()) -> DataFrame:
    """(key, status, final, agreed, risk_flags, geometry_issues) of assessed candidates.

    Readings without flags that have one norm are a group. The group of most engines among those that all required engines are in
    is final (of equals the smallest norm), unless geometry(key, issue) has an issue with the key. Without one, a key abstains if
    all its candidates do, or it has none; else a person has to see it. agreed engines come in `order`, then by name."""
    if len(set(required)) < 2:
        raise ValueError("a consensus needs two engines at least")
    usable = judged.where((F.col("status") != "machine_abstain") & (F.col("norm") != ""))
    groups = usable.where(F.size("risk_flags") == 0).groupBy("key", "norm").agg(F.collect_set("engine").alias("engines"))
    groups = groups.where(F.size(F.array_except(F.array(*map(F.lit, sorted(set(required)))), F.col("engines"))) == 0)
    won = groups.groupBy("key").agg(F.min(F.struct((-F.size("engines")).alias("n"), "norm", "engines")).alias("_w"))
    keys = judged.groupBy("key").agg(F.bool_and(F.col("status") == "machine_abstain").alias("_abstain"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("risk_flags")))).alias("_flags"))
    varied = usable.groupBy("key").agg((F.countDistinct("norm") > 1).alias("_varied"))
    rows = keys.join(varied, "key", "left")
    if geometry is None:
        rows = rows.withColumn("geometry_issues", none())
    else:
        found = geometry.where("issue is not null and issue <> ''").groupBy("key").agg(F.array_sort(F.collect_set("issue")).alias("geometry_issues"))
        rows = rows.join(found, "key", "full").withColumn("geometry_issues", F.coalesce("geometry_issues", none()))
    rows = rows.join(won, "key", "left")
    issues, has = F.size("geometry_issues") > 0, F.col("_w").isNotNull()
    final = has & ~issues
    listed = F.array(*map(F.lit, order)) if order else none()
    agreed = F.transform(F.array_sort(F.transform(F.col("_w.engines"), lambda e: F.struct(F.coalesce(F.nullif(F.array_position(listed, e), F.lit(0)), F.lit(len(order) + 1)).alias("at"), e.alias("e")))), lambda x: x["e"])
    more = F.array_compact(F.array(F.when(issues, F.lit("render_geometry_risk")), F.when(F.coalesce("_varied", F.lit(False)) & ~has, F.lit("engine_disagreement"))))
    status = F.when(final, "machine_final").when(F.coalesce("_abstain", F.lit(True)), "machine_abstain").otherwise("needs_vlm")
    return rows.select("key", status.alias("status"), F.when(final, F.col("_w.norm")).alias("final"), F.when(final, agreed).otherwise(none()).alias("agreed"), F.when(final, none()).otherwise(F.array_sort(F.array_union(F.coalesce("_flags", none()), more))).alias("risk_flags"), "geometry_issues")


def conflicting(evidence: DataFrame, by: str, signature: list[str]) -> DataFrame:
    """(by, n): contents whose evidence differs in any of the signature's columns."""
    return evidence.groupBy(by).agg(F.countDistinct(F.struct(*signature)).alias("n")).where("n > 1")


def fanned_out(rows: DataFrame, results: DataFrame, sha: str, key: str, signature: list[str]) -> DataFrame:
    """rows(key, sha, ..) with the result of their content, and `owner` and `inherited`: whose result it is. results(key, sha,
    signature ..) hold one inference for each content; equal ones count once. ValueError where they differ for one content."""
    bad = conflicting(results, sha, signature).limit(5).collect()
    if bad:
        raise ValueError(f"evidence differs for equal content: {', '.join(str(r[0]) for r in bad)}")
    one = results.groupBy(sha).agg(F.min(key).alias("owner"), F.first(F.struct(*signature)).alias("_r"))
    return rows.join(one, sha, "left").select(*rows.columns, "owner", (F.col("owner") != F.col(key)).alias("inherited"), "_r.*")


def cache_counts(rows: DataFrame, done: DataFrame, sha: str) -> DataFrame:
    """One row: rows, distinct contents, contents with a completed record of done(sha, status), contents to do, and rows that need no
    work of their own because an equal one does it."""
    known = done.where("status = 'completed'").select(sha).distinct().withColumn("_done", F.lit(1))
    each = rows.where(F.col(sha).isNotNull()).groupBy(sha).agg(F.count("*").alias("n")).join(known, sha, "left")
    held = F.col("_done").isNotNull()
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("contents"), F.count_if(held).alias("cached"), F.count_if(~held).alias("pending"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduplicated"))


def page_conflicts(pages: DataFrame, candidates: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(page, conflict_types, flags) of each page with something to see.

    candidates(page, score, status, confidence, quality, region, source_kind, risk_flags, signs, selected): signs are those of its
    text, and count where it is the page's selected one; markers(page, signs) add theirs, as far as `MARKER_SIGNS` names them. A
    page of pages(page) without any candidate is missing."""
    c, any_of = F.col, lambda cond: F.bool_or(F.coalesce(cond, F.lit(False)))
    told = candidates.groupBy("page").agg(
        (F.max("score") - F.min("score") > SPREAD).alias("candidate_disagreement"),
        any_of(c("status") == "machine_abstain").alias("machine_abstain"),
        any_of(c("status") == "machine_candidate").alias("machine_candidate_review"),
        any_of((c("confidence") < UNSURE) | (c("quality") < UNSURE)).alias("low_confidence_candidate"),
        any_of(F.coalesce("region", F.lit("")) != "").alias("region_candidate"),
        any_of(F.endswith("source_kind", F.lit("formula")) | F.array_contains("risk_flags", "formula_candidate")).alias("formula_candidate"),
        any_of(F.size("risk_flags") > 0).alias("candidate_risk_flags"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("risk_flags", none()))))).alias("flags"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.coalesce("selected", F.lit(False)), F.coalesce("signs", none())).otherwise(none())))).alias("_signs"),
    )
    rows = pages.select("page").distinct().join(told, "page", "left")
    if markers is None:
        rows = rows.withColumn("_marked", none())
    else:
        marked = markers.groupBy("page").agg(F.array_intersect(F.flatten(F.collect_set("signs")), F.array(*map(F.lit, MARKER_SIGNS))).alias("_marked"))
        rows = rows.join(marked, "page", "left")
    kinds = ("candidate_disagreement", "machine_abstain", "machine_candidate_review", "low_confidence_candidate", "region_candidate", "formula_candidate", "candidate_risk_flags")
    own = flagged({k: c(k) for k in kinds} | {"missing_local_candidate": c("flags").isNull(), "empty_text": c("flags").isNull()})
    types = F.array_sort(F.array_union(F.array_union(own, F.coalesce("_signs", none())), F.coalesce("_marked", none())))
    return rows.select("page", types.alias("conflict_types"), F.coalesce("flags", none()).alias("flags")).where(F.size("conflict_types") > 0)

"""Page and line candidates of text recognition: scores, quality gates, review queues and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered


#: Weights of engines and states, and noise, in a page candidate's score.
ENGINES = {"paddleocr_vl": 90, "auto_transcript": 55, "pp_formulanet": 45, "texteller": 42, "marker": 25, "pp_ocr": -45}
STATES = {"machine_final": 80, "machine_candidate": 15, "machine_abstain": -160}
NOISE = r'(style="text-align:\s*src=|牧師|粥|I_6|\\\\bar\{u\})'
OMITTED = "picture intentionally omitted"
#: Characters of formulas, words of answer sheets, regions of short answers.
FORMULA = r"[=+\-*/^_()\[\]{}<>≤≥≈∴∵√∑∫πθαβγΔΩμ]"
SHEET_WORDS = "满分|答题|班级|姓名|座号|缺考|考场"
SHORT_ANSWERS = ("q09", "q10", "q11", "q12", "q13")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def times(s: Column, what: str) -> Column:
    """How often a literal occurs."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))) / len(what)).cast("int")


def filled_lines(s: Column) -> Column:
    return F.size(F.filter(F.split(s, "\n"), lambda x: F.trim(x) != ""))


def candidate_score(s: Column, engine: Column, status: Column, confidence: Column, quality: Column, region: Column, flags: Column) -> Column:
    share = lambda c: F.when(c.isNull(), 0).otherwise((F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 30).cast("int"))
    return (
        filled_lines(s) * 2 + F.least(F.floor(F.length(s) / 20), F.lit(200))
        + F.coalesce(literal_map(ENGINES)[engine], F.lit(0)) + F.coalesce(literal_map(STATES)[status], F.lit(0)) + share(confidence) + share(quality)
        - F.when(F.coalesce(region, F.lit("")) != "", 15).otherwise(0) - F.when(F.array_contains(F.coalesce(flags, F.array().cast("array<string>")), "formula_candidate"), 10).otherwise(0)
        + F.regexp_count(s, F.lit(r"(?<!\d)([1-9]|1[0-9]|2[0-9])[\.．、]")) * 8 + F.regexp_count(s, F.lit(r"[ABCD][\.．、]")) * 4
        - times(F.lower(s), OMITTED) * 50 - times(s, "�") * 10 - F.regexp_count(s, F.lit(NOISE)) * 20
    ).cast("long")


def merged_reports(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, candidates): the candidates (key, engine, text) of two reports in one list an image."""
    return first.unionByName(second).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("engine", "text"))).alias("candidates"))  # one row an engine


def quality_gate(drafts: DataFrame) -> DataFrame:
    """(draft, issues, ok) of drafts (draft, text, pages, unresolved, broken_images, omitted, n_candidates)."""
    s = F.col("text")
    rules = {
        "unresolved_conflicts": F.col("unresolved") > 0, "picture_intentionally_omitted": times(F.lower(s), OMITTED) > 0, "replacement_characters": times(s, "�") > 0,
        "too_few_nonblank_lines": filled_lines(s) < F.greatest(F.lit(10), F.col("pages") * 5), "broken_image_links": F.col("broken_images") > 0,
        "unbalanced_inline_latex_dollars": times(s, "$") % 2 == 1, "marker_picture_omitted": F.coalesce("omitted", F.lit(0)) > 0, "model_candidate_matrix_missing": F.coalesce("n_candidates", F.lit(0)) == 0,
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return drafts.select("draft", found.alias("issues"), (F.size(found) == 0).alias("ok"))


def wave_rollup(waves: DataFrame) -> DataFrame:
    """One row over waves (ok, issues, unresolved): sums, bad waves, and whether all may be imported."""
    bad = ~F.coalesce("ok", F.lit(False)) | (F.coalesce("issues", F.lit(0)) > 0) | (F.coalesce("unresolved", F.lit(0)) > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return waves.agg(F.count("*").alias("waves"), F.count_if(bad).alias("bad"), total("issues"), total("unresolved"), (F.count_if(bad) == 0).alias("ok"))


def reporting_counts(objects: DataFrame, results: DataFrame, key: str, status: str, settled: list[str]) -> DataFrame:
    """One row: objects, objects with a result, results, and results whose state is not settled."""
    joined = objects.select(key).join(results.select(key, status), key)
    return objects.agg(F.count("*").alias("objects")).crossJoin(joined.agg(F.countDistinct(key).alias("with_result"), F.count("*").alias("results"), F.count_if(~F.col(status).isin(settled)).alias("open")))  # one row each


def review_queue(objects: DataFrame, previews: DataFrame, extra: DataFrame) -> DataFrame:
    """(key, kind, previews): unresolved objects (key, resolved) with their distinct previews (key, sha256), and tasks of another
    kind (key)."""
    shown = previews.groupBy("key").agg(F.array_sort(F.collect_set("sha256")).alias("previews"))
    own = objects.where(~F.coalesce("resolved", F.lit(False))).select("key", F.lit("object").alias("kind")).join(shown, "key", "left")
    return own.unionByName(extra.select("key", F.lit("extra").alias("kind")), allowMissingColumns=True)


def reconciled(previews: DataFrame) -> DataFrame:
    """(key, value, resolved) of previews (key, value, resolved): one value that all have resolved, or none."""
    values = F.collect_set("value")
    fine = F.bool_and(F.coalesce("resolved", F.lit(False))) & (F.size(values) == 1)
    return previews.groupBy("key").agg(F.when(fine, F.element_at(values, 1)).alias("value"), fine.alias("resolved"))


def inherited(assets: DataFrame) -> DataFrame:
    """Assets (id, sha256, review) without a review take that of the first asset of equal content that has one."""
    donor = assets.where("review is not null").groupBy("sha256").agg(F.min_by(F.struct(F.col("id").alias("donor"), F.col("review").alias("given")), "id").alias("d"))
    out = assets.join(donor, "sha256", "left")
    return out.select("id", "sha256", F.coalesce("review", "d.given").alias("review"), F.when(F.col("review").isNull(), F.col("d.donor")).alias("donor"))


def next_pending(segments: DataFrame) -> DataFrame:
    """The first pending row by (batch_pos, segment_pos)."""
    return segments.where("status = 'pending'").orderBy("batch_pos", "segment_pos").limit(1)


def best_manifest(manifests: DataFrame) -> DataFrame:
    """(source, path): of each source's manifests the one with the most mapped, then questions, then the latest; of equals the
    first path."""
    w = Window.partitionBy("source").orderBy(F.desc("mapped"), F.desc("n_questions"), F.desc("mtime"), "path")
    return manifests.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("source", "path")


def garbled(formula: Column, marks: list[str]) -> Column:
    """Subscripts, braces within them included one level deep, that consist of a mark alone but for spacing."""
    inner = F.regexp_extract_all(formula, F.lit(r"_\{((?:[^{}]|\{[^{}]*\})*)\}"), 1)
    bare = F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"\\!+", "")))
    return F.filter(bare, lambda x: x.isin(marks) | F.exists(F.array(*map(F.lit, marks)), lambda m: F.concat(F.lit(r"\text{"), m, F.lit("}")) == x))


def repaired(formula: Column, marks: list[str], rules: list[tuple[str, str]]) -> Column:
    """The formula with its garbled subscripts set by the first rule (pattern, subscript) that fits; as it is where none does."""
    chosen = None
    for pattern, subscript in rules:
        hit = formula.rlike(pattern)
        chosen = F.when(hit, subscript) if chosen is None else chosen.when(hit, subscript)
    if chosen is None:
        return formula
    any_mark = "|".join(rf"\Q{m}\E" for m in marks)
    target = F.concat(F.lit("_{"), F.regexp_replace(chosen, r"([\\$])", r"\\$1"), F.lit("}"))
    return F.when(chosen.isNull(), formula).otherwise(F.regexp_replace(formula, F.lit(rf"_\{{(?:\\!)*\s*(?:\\text\{{)?(?:{any_mark})\}}?\s*(?:\\!)*\}}"), target))


def line_kind(region: Column, s: Column, ink: Column) -> Column:
    """empty, text, mixed or formula, from counts of character classes."""
    s = F.coalesce(s, F.lit(""))
    count = lambda p: F.regexp_count(s, F.lit(p))
    formula = count(FORMULA)
    score = formula + F.least(count("[A-Za-z]"), F.lit(8)) * 0.35 + F.least(count(r"\d"), F.lit(8)) * 0.18
    return (
        F.when(F.coalesce(ink, F.lit(0.0)) < 0.002, "empty")
        .when(F.coalesce(region, F.lit("")).isin(*SHORT_ANSWERS) | s.rlike(SHEET_WORDS) & (formula < 2), "text")
        .when((score >= 2.2) & (count("[一-鿿]") >= 2), "mixed")
        .when(score >= 1.5, "formula")
        .otherwise("text")
    )


def ranked_probes(probes: DataFrame) -> DataFrame:
    """Probes (url, ok, speed) that succeeded, fastest first."""
    return numbered(probes.where("ok"), F.desc("speed"), "url")


def page_kind(pages: DataFrame) -> DataFrame:
    """One row a document of page metrics (doc, page, chars, images, image_area): shares, kind and advice."""
    rows = pages.withColumns({"scan": ((F.col("chars") < 20) & (F.col("image_area") > 0.5)).cast("int"), "texted": (F.col("chars") >= 200).cast("int")})
    out = rows.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.avg("scan").alias("scan_share"), F.avg("texted").alias("text_share"))
    kind = F.when(F.col("scan_share") >= 0.8, "image").when(F.col("text_share") >= 0.8, "text").otherwise("mixed")
    return out.withColumns({"kind": kind, "advice": F.when(kind == "text", "extract").when(kind == "image", "recognise").otherwise("combine")})


def formula_counts(rows: DataFrame) -> DataFrame:
    """Counts of formulas (kind, status) by kind and status, by each alone, and of all."""
    return rows.cube("kind", "status").agg(F.count("*").alias("n"))


def batch_states(items: DataFrame, batches: DataFrame, terminal: list[str]) -> DataFrame:
    """(batch_id, status) from items (batch_id, status) and batches (batch_id, claimed): completed if all its items ended (or it has
    none), in progress if claimed, ready if one may run, else pending."""
    seen = items.groupBy("batch_id").agg(F.bool_and(F.col("status").isin(terminal)).alias("ended"), F.bool_or(F.col("status").isin("dry_run_passed", "stale")).alias("ready"))
    rows = batches.join(seen, "batch_id", "left")
    status = F.when(F.coalesce("ended", F.lit(True)), "completed").when(F.col("claimed"), "in_progress").when(F.coalesce("ready", F.lit(False)), "ready").otherwise("pending")
    return rows.select("batch_id", status.alias("status"))



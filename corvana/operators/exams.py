"""Exam sheets: what the first row says of the items, values that are allowed, seats that have to fit, what to study next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .analytics import by_priority, by_strength
from .ingest import score_columns
from .tables import numbered

#: Types of a method error, the blank one among them, and how a gender may be written.
METHOD_ERRORS = ("", "concept_confusion", "model_selection_error", "condition_misread", "direction_sign_error", "formula_condition_error", "calculation_error", "process_incomplete", "expression_unit_error", "careless_or_omission", "unknown")
GENDERS = ("M", "MALE", "男", "男生", "F", "FEMALE", "女", "女生", "U", "UNKNOWN", "未知", "")
METADATA = "assessment_item_id string, assessment_id string, item_key string, item_no string, question_id string, title string, question_type string, max_score double, kp_id string, kp_title string, wiki_path string, display_order int, correct_answer string, scoring_points_json string, method_tags_json string, key_point string, difficulty_point string, exam_report_ref string"


def method_errors(rows: DataFrame, column: str, item: str) -> DataFrame:
    """rows with the column trimmed, a blank one null. ValueError names the items with a value outside `METHOD_ERRORS`."""
    told = F.coalesce(F.trim(column), F.lit(""))
    bad = rows.where(~told.isin(*METHOD_ERRORS)).select(item, told.alias("value")).distinct().orderBy(item, "value").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"invalid method_error_type for {r[0]}: {r[1]}" for r in bad))
    return rows.withColumn(column, F.nullif(told, F.lit("")))


def strict_gender(rows: DataFrame, column: str) -> DataFrame:
    """rows with M, F or U; ValueError for anything that is not written as one of them."""
    told = F.upper(F.trim(F.coalesce(column, F.lit(""))))
    bad = rows.where(~told.isin(*GENDERS)).select(column).distinct().orderBy(column).limit(5).collect()
    if bad:
        raise ValueError(f"unsupported gender value: {', '.join(str(r[0]) for r in bad)}")
    return rows.withColumn(column, t.gender(F.col(column)))


def item_metadata(wide: DataFrame, order: str) -> DataFrame:
    """One row for each item of a wide sheet, from its first row alone by `order`: what stands under the item's key, else under its
    number, else what is made of them. A blank cell is as good as none."""
    first = wide.orderBy(order).limit(1).collect()
    if not first:
        return wide.sparkSession.createDataFrame([], METADATA)
    row = {k: None if v is None or str(v) == "" else str(v) for k, v in first[0].asDict().items()}
    exam, out = row.get("assessment_id"), []
    for n, column in enumerate(score_columns(wide.columns), 1):
        key = column.removesuffix("_score")
        no = row.get(f"{key}_item_no") or key
        either = lambda name: row.get(f"{key}_{name}") or row.get(f"{no}_{name}")  # noqa: B023, E731
        kp = either("kp_id")
        out.append((
            f"{exam}_{key}", exam, key, no, either("question_id") or f"question_{exam}_{no}", either("title") or no, row.get(f"{key}_question_type") or "exam_item", float(either("max_score") or 1), kp, kp and (either("kp_title") or kp), kp and either("wiki_path"), n,
            row.get(f"{key}_correct_answer"), row.get(f"{key}_scoring_points_json"), row.get(f"{key}_method_tags_json"), row.get(f"{key}_key_point"), row.get(f"{key}_difficulty_point"), row.get(f"{key}_exam_report_ref") or row.get("exam_report_ref"),
        ))
    return wide.sparkSession.createDataFrame(out, METADATA)


def seated(roster: DataFrame, scores: DataFrame, name: str, total: str) -> DataFrame:
    """scores(class_id, seat_no, name, total, ..) with the row of roster(class_id, seat_no, ..) on their seat.

    Rows without name, seat or a number as total are none of a student and left out. ValueError for a class whose roster has a seat
    twice, or none of its rows, and for a seat that the roster does not have."""
    sat = roster.withColumn("seat_no", t.seat(F.col("seat_no")))
    twice = sat.groupBy("class_id", "seat_no").agg(F.count("*").alias("n")).where("n > 1").orderBy("class_id", "seat_no").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate roster seat_no: {', '.join(f'{r[0]}/{r[1]}' for r in twice)}")
    rows = scores.withColumn("seat_no", t.seat(F.col("seat_no")))
    rows = rows.where((F.coalesce(F.trim(name), F.lit("")) != "") & (F.coalesce("seat_no", F.lit("")) != "") & t.number(F.col(total)).isNotNull())
    lost = rows.join(sat, ["class_id", "seat_no"], "left_anti").select("class_id", "seat_no").distinct().orderBy("class_id", "seat_no").limit(5).collect()
    if lost:
        raise ValueError(f"no roster match for: {', '.join(f'{r[0]}/{r[1]}' for r in lost)}")
    return rows.join(sat, ["class_id", "seat_no"])


def study_plan(points: DataFrame, n: int = 5) -> DataFrame:
    """(part, place, kp) from points(kp, mastery, gap, weight, level): the n weakest of the weak are urgent; then n to consolidate,
    the basic ones first and the weak ones that were left after them; the strong ones by strength."""
    weak = numbered(points.where("level = 'weak'"), *by_priority(), name="_n")
    urgent = weak.where(F.col("_n") <= n).select(F.lit("urgent").alias("part"), F.col("_n").alias("place"), "kp")
    basic = points.where("level = 'basic'").orderBy(*by_priority()).limit(n)
    rest = weak.where((F.col("_n") > n) & (F.col("_n") <= 2 * n)).drop("_n")
    several = basic.withColumn("_g", F.lit(0)).unionByName(rest.withColumn("_g", F.lit(1)))  # 2 n rows at most
    later = several.withColumn("place", F.row_number().over(Window.orderBy("_g", *by_priority())).cast("long")).where(F.col("place") <= n)
    strong = numbered(points.where("level = 'strong'"), *by_strength(), name="place").where(F.col("place") <= n)
    return urgent.union(later.select(F.lit("consolidate"), "place", "kp")).union(strong.select(F.lit("strong"), "place", "kp"))


def id_numbers(rows: DataFrame, column: str) -> DataFrame:
    """(number) of each id, capitals and digits, in a text; the capitals do not count. Ids beyond 18 digits have none."""
    found = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"[A-Z]+(\d+)"), 1)
    return rows.select(F.explode(found).alias("number")).select(F.col("number").try_cast("long").alias("number")).where("number is not null")


def gap_names(gaps: DataFrame) -> DataFrame:
    """(gap) as a report says it: `7`, or `7~9`."""
    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    return gaps.select(F.when(F.col("low") == F.col("high"), low).otherwise(F.concat(low, F.lit("~"), high)).alias("gap"))


def import_status(rows: DataFrame, most: int = 20) -> DataFrame:
    """(label, count, ok, failed, failures, truncated_failures) of rows (label, position, key, title, ok, error): of each label's
    failures the first `most` in order, and how many are not told."""
    ok = F.coalesce("ok", F.lit(False))
    counts = rows.groupBy("label").agg(F.count("*").alias("count"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("position", "key"))
    first = rows.where(~ok).withColumn("_n", place).where(F.col("_n") <= most)
    told = first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_n", "key", "title", "error"))).alias("_f"))
    failures = F.transform(F.coalesce("_f", F.array().cast("array<struct<_n:int,key:string,title:string,error:string>>")), lambda x: F.struct(x["key"].alias("key"), x["title"].alias("title"), x["error"].alias("error")))
    return counts.join(told, "label", "left").select("label", "count", "ok", "failed", failures.alias("failures"), F.greatest(F.col("failed") - most, F.lit(0)).alias("truncated_failures"))


def accepted(records: DataFrame, least: float = 0.8) -> DataFrame:
    """(model, score, out_of, score_rate, schema_valid, safety_passed, critical_errors, accepted) of records (model, case_id, passed,
    schema_valid, critical_error, safety_critical): a model is accepted if every answer has the form, every safety case passes, none
    is a critical error and `least` of all cases pass."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = records.groupBy("model").agg(
        F.count_if(yes("passed")).alias("score"), F.count("*").alias("out_of"), F.bool_and(yes("schema_valid")).alias("schema_valid"),
        F.bool_and(yes("passed") | ~yes("safety_critical")).alias("safety_passed"), F.array_sort(F.collect_list(F.when(yes("critical_error"), F.col("case_id")))).alias("critical_errors"),
    )
    rate = F.col("score") / F.col("out_of")
    verdict = F.col("schema_valid") & F.col("safety_passed") & (F.size("critical_errors") == 0) & (rate >= least)
    return out.select("model", "score", "out_of", F.round(rate, 4).alias("score_rate"), "schema_valid", "safety_passed", "critical_errors", verdict.alias("accepted"))


def unit(s: Column) -> Column:
    """A unit as it is compared: lower case, powers and products written plainly, no blanks."""
    x = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    for old, new in (("²", "^2"), ("³", "^3"), ("·", "*"), (" ", "")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


#: Characters of a page with text, the part of a page that an image must cover, and the shares between the kinds.
TEXT_PAGE, FULL_PAGE = 80, 0.65


def page_metrics(pages: DataFrame) -> DataFrame:
    """(doc, page, chars, images, full_image, private_use, fragments) from pages (doc, page, text, images, coverage): fragments is the
    share of lines with three characters at most among those that are not blank."""
    body = t.stripped(F.coalesce("text", F.lit("")))
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), t.stripped), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 3))
    share = F.when(F.size(lines) > 0, F.round(short / F.size(lines), 4)).otherwise(0.0)
    return pages.select("doc", "page", F.length(body).alias("chars"), F.coalesce("images", F.lit(0)).alias("images"), (F.coalesce("coverage", F.lit(0.0)) >= FULL_PAGE).alias("full_image"), body.rlike(r"[\x{e000}-\x{f8ff}]").alias("private_use"), share.alias("fragments"))


def pdf_kind(metrics: DataFrame) -> DataFrame:
    """One row a document of `page_metrics`: totals, shares, kind, risk to formulas and which reader to take."""
    share = lambda cond: F.avg(cond.cast("double"))
    out = metrics.groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.avg("chars").alias("_mean"), F.count_if(F.col("chars") == 0).alias("zero_text_pages"), share(F.col("chars") >= TEXT_PAGE).alias("_text"), share(F.col("images") > 0).alias("_image"),
        share(F.col("full_image")).alias("_full"), F.count_if("private_use").alias("private_use_pages"), F.coalesce(F.avg(F.when(F.col("chars") > 0, F.col("fragments"))), F.lit(0.0)).alias("_fragments"),
    )
    kind = F.when((F.col("_text") <= 0.2) & (F.col("_full") >= 0.5), "image_pdf").when((F.col("_image") >= 0.3) & (F.col("_text") >= 0.3), "mixed_pdf").when(F.col("_full") >= 0.3, "mixed_pdf").otherwise("text_pdf")
    risk = (kind == "mixed_pdf") | (F.col("private_use_pages") > 0) | ((F.col("_fragments") >= 0.25) & (F.col("_mean") >= TEXT_PAGE))
    advice = F.when(kind.isin("image_pdf", "mixed_pdf") | risk, "combined_ocr").otherwise("text_reader")
    four = lambda c, name: F.round(c, 4).alias(name)
    return out.select("doc", "pages", "chars", F.round("_mean", 2).alias("mean_chars"), "zero_text_pages", four("_text", "text_share"), four("_image", "image_share"), four("_full", "full_share"), "private_use_pages", four("_fragments", "fragments"), kind.alias("kind"), risk.alias("formula_risk"), advice.alias("advice"))


def campaign_status(items: DataFrame, terminal: list[str]) -> DataFrame:
    """(campaign, counts, complete, blocked) of items (campaign, status): complete if all have ended and none is blocked."""
    each = items.groupBy("campaign", "status").agg(F.count("*").alias("n"))
    ended = F.sum(F.when(F.col("status").isin(terminal), F.col("n")).otherwise(0)) == F.sum("n")
    n = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    return each.groupBy("campaign").agg(counts.alias("counts"), (ended & (n("blocked") == 0)).alias("complete"), n("blocked", "source_blocked").alias("blocked"))


def audio_streams(streams: DataFrame, least: int, allow_low: bool = False) -> DataFrame:
    """Streams (key, bandwidth, ..) of each key from the widest on, those of at least `least`. ValueError for keys that have none left,
    unless low ones are allowed."""
    width = F.coalesce("bandwidth", F.lit(0))
    kept = streams if allow_low else streams.where(width >= least)
    lost = streams.join(kept, "key", "left_anti").select("key").distinct().orderBy("key").limit(5).collect()
    if lost:
        raise ValueError(f"no stream of {least} or more: {', '.join(str(r[0]) for r in lost)}")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(width.desc(), *[c for c in streams.columns if c not in ("key", "bandwidth")])))

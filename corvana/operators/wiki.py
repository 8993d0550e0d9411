"""Audits and repairs of pages, exercises, images, registries and reference files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import audit

#: Patterns of pages.
RAW_POINTER = r"\^\[\.\./raw/|##\s*raw 原文|\[查看\]\(\.\./raw|\.\./raw/[^\s)]+\.md"
PLACEHOLDER = r"(?i)OCR乱码|picture intentionally omitted|machine_abstain|TODO|待补|占位|无法识别|OCR失败"
HEADING, EMPTY_HEADING, CAPTION, CHAPTER = r"^(#{1,6})\s+(.+?)\s*$", r"^#{1,6}\s*$", r"^#{1,6}\s*(图|表)\s*\d+", r"^##\s+第(\d+)章\s*$"
FIGURE = r"如(?:下)?图(?:所示)?|图示(?:中|所示)?|图中|下图(?:中|所示)?|图[甲乙丙丁一二三四五六七八九十0-9]+(?:中|所示)?|见图[甲乙丙丁一二三四五六七八九十0-9]*"
IMAGE_CONTEXT = r"如图|图中|图像|曲线|装置|轨迹|电路|坐标|示意|波形|受力|磁场|电场"
EMPTY_CHUNK = "题目：\n答案：\n详解："
#: What to do about an issue.
ACTIONS = {
    "suspicious_ocr_token": "compare with the source page before correcting",
    "repeated_ocr_noise": "render the source page and resolve, never delete",
    "placeholder": "recover the missing content",
    "chapter_name_missing": "supply a map of chapter names",
    "unexpected_h1": "confirm the book's title",
    "duplicate_h2": "compare with the source's structure",
    "wmf_reference": "convert the formula picture",
}
REVIEW = "review against the source"


def missing_frontmatter(s: Column) -> Column:
    return ~F.ltrim(s).startswith("---")


def raw_pointer(s: Column) -> Column:
    return t.strip_frontmatter(s).rlike(RAW_POINTER)


def references(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target) of each image reference."""
    return pages.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)).alias("target")).withColumn("target", F.trim("target"))


def missing_images(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References to local images (key.., target) that are no file (path)."""
    return refs.where(~F.col("target").rlike("^(https?://|data:|#)")).join(files, refs.target == files.path, "left_anti")


def two_way(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of both has."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def unindexed(pages: DataFrame, index_text: Column, index: DataFrame) -> DataFrame:
    """Pages (id) which no link of the index names."""
    named = index.select(F.explode(t.links(index_text)).alias("id")).distinct()
    return pages.join(named, "id", "left_anti")


def health(pages: DataFrame, counts: dict[str, DataFrame], gating: Iterable[str]) -> DataFrame:
    """One row: how many rows each finding has, and whether any that gates has one."""
    out = pages.agg(F.count("*").alias("pages"))
    for name, rows in counts.items():
        out = out.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    failed = F.lit(False)
    for name in gating:
        failed = failed | (F.col(name) > 0)
    return out.withColumn("failed", failed)


def line_issues(lines: DataFrame, tokens: Iterable[str] = ()) -> DataFrame:
    """(path, pos, issue) of each line's own faults, from lines (path, pos, line)."""
    s = F.trim("line")
    level, title = F.length(F.regexp_extract("line", HEADING, 1)), F.regexp_extract("line", HEADING, 2)
    odd = F.lit(False)
    for x in tokens:
        odd = odd | F.contains(s, F.lit(x))
    return audit.issues(
        lines,
        ["path", "pos"],
        {
            "bold_in_heading": title.contains("**"),
            "heading_too_deep": level > 4,
            "caption_as_heading": (level > 0) & s.rlike(CAPTION),
            "empty_heading": (level == 0) & s.rlike(EMPTY_HEADING),
            "placeholder": s.rlike(PLACEHOLDER),
            "suspicious_ocr_token": odd,
            "repeated_ocr_noise": ~s.contains("$") & ~s.rlike(r"^(\||<!--)") & (F.size(F.filter(F.regexp_extract_all(s, F.lit(r"(.{5,20})\1{3,}"), 1), lambda x: ~x.rlike(r"^[_\-\s]+$"))) > 0),
            "embedded_data_uri": s.contains("data:image/"),
            "wmf_reference": F.lower("line").rlike(r"!\[[^\]]*\]\((?!https?://)[^)]+\.wmf\)"),
            "chapter_name_missing": s.rlike(CHAPTER),
        },
    )


def page_issues(lines: DataFrame) -> DataFrame:
    """(path, issue, detail) of what only a whole page shows: number of titles, repeated second-level headings, dollars."""
    level, title = F.length(F.regexp_extract("line", HEADING, 1)), F.regexp_extract("line", HEADING, 2)
    rows = lines.withColumns({"level": level, "title": title, "dollars": t.unescaped_dollars(F.col("line"))})
    whole = rows.groupBy("path").agg(F.count_if(F.col("level") == 1).alias("h1"), F.sum("dollars").alias("dollars"))
    twice = rows.where("level = 2").groupBy("path", "title").agg(F.count("*").alias("n")).where("n > 1")
    return (
        whole.where("h1 <> 1").select("path", F.lit("h1_count").alias("issue"), F.col("h1").cast("string").alias("detail"))
        .union(whole.where("dollars % 2 = 1").select("path", F.lit("unbalanced_latex_delimiter"), F.col("dollars").cast("string")))
        .union(twice.select("path", F.lit("duplicate_h2"), "title"))
    )


def safe_fixes(s: Column) -> Column:
    """The text with format-only repairs: line ends, empty and too deep headings, bold in headings, captions, blank runs."""

    def fixed(line: Column) -> Column:
        flat = F.regexp_replace(line, r"\s+$", "")
        level, title = F.length(F.regexp_extract(flat, HEADING, 1)), F.trim(F.replace(F.regexp_extract(flat, HEADING, 2), F.lit("**"), F.lit("")))
        heading = F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(4))), F.lit(" "), title)
        return F.when(level > 0, F.when(heading.rlike(CAPTION), F.concat(F.lit("**"), title, F.lit("**"))).otherwise(heading)).otherwise(flat)

    lines = F.filter(F.split(F.regexp_replace(s, r"\r\n?", "\n"), "\n"), lambda x: ~F.trim(x).rlike(EMPTY_HEADING))
    return F.concat(F.rtrim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(lines, fixed), "\n"), r"\n{3,}", "\n\n"), r"\s+$", "")), F.lit("\n"))


def replaced(s: Column, pairs: dict[str, str]) -> tuple[Column, Column]:
    """Literal replacements in order, and how many were made. pairs is a reviewed list."""
    count = F.lit(0)
    for old, new in pairs.items():
        count = count + ((F.length(s) - F.length(F.replace(s, F.lit(old), F.lit("")))) / len(old)).cast("int")
        s = F.replace(s, F.lit(old), F.lit(new))
    return s, count


def named_chapters(s: Column, names: dict[str, str]) -> Column:
    for number, title in names.items():
        s = F.regexp_replace(s, rf"(?m)^##\s+第{number}章[ \t]*$", f"## 第{number}章 {title}".replace("$", r"\$"))
    return s


def repair_tasks(issues: DataFrame) -> DataFrame:
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return issues.withColumns({"status": F.lit("unresolved"), "action": F.coalesce(action[F.col("issue")], F.lit(REVIEW))})


def compatibility(files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(path, issue) of exercise files (path, name, text), and of their chunks (id, text, knowledge_points) if given."""
    text, body, head = F.col("text"), F.col("_body"), F.col("_head")
    files = files.withColumns({"_body": t.strip_frontmatter(text), "_head": t.frontmatter(text)})  # once a file, not once a rule
    part = lambda p: F.regexp_extract(body, p, 1)
    question, answer, explanation = r"(?s)## 题目\n\n(.*?)(?=\n## 答案)", r"(?s)## 答案\n\n(.*?)(?=\n## 详解)", r"(?s)## 详解\n\n(.*)"
    blank = lambda c: F.trim(F.regexp_replace(t.strip_images(c), r"\s+", " ")) == ""
    empty = lambda k: F.coalesce(head[k], F.lit("")) == ""
    rows = files.withColumn("chunk_id", F.concat(F.lit("exercise-"), F.coalesce(F.nullif(head["id"], F.lit("")), F.regexp_replace("name", r"\.md$", ""))))
    rules = {
        "missing_frontmatter": ~text.startswith("---\n"), "missing_id": empty("id"), "missing_question_type": empty("question_type"),
        "rag_heading_spacing_question": ~body.rlike(question), "rag_heading_spacing_answer": ~body.rlike(answer), "rag_heading_spacing_explanation": ~body.rlike(explanation),
        "empty_rag_question_text": blank(part(question)), "empty_rag_answer_text": F.trim(part(answer)) == "", "empty_rag_explanation_text": blank(part(explanation)),
        "rag_knowledge_points_not_parseable": F.size(t.frontmatter_list(text, "knowledge_points")) == 0,
    }
    if chunks is not None:
        rows = rows.join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("_chunk"), F.col("knowledge_points").alias("_points"), F.lit(True).alias("_there")), "chunk_id", "left")
        there = F.coalesce("_there", F.lit(False))
        rules |= {
            "rag_chunk_missing": ~there,
            "rag_chunk_text_empty": there & (F.length(F.trim(F.coalesce("_chunk", F.lit("")))) <= len(EMPTY_CHUNK)),
            "rag_chunk_knowledge_points_empty": there & (F.coalesce(F.size("_points"), F.lit(0)) <= 0),
        }
    return audit.issues(rows, ["path"], rules)


def image_risks(metrics: DataFrame) -> DataFrame:
    """(key, codes) from metrics (key, width, height, bytes, has_alpha, direct_mean, white_mean, transparent, context)."""
    n = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    w, h = n("width", 0), n("height", 0)
    ratio = F.when(h > 0, w / h).otherwise(float("inf"))
    small = (n("bytes", 0) <= 2500) & (((w <= 180) & (h <= 270)) | ((h <= 60) & (w <= 250)))
    wide, extreme = (h <= 45) & (w >= 180), (ratio >= 8) | (ratio <= 0.14)
    codes = {
        "alpha_black": n("has_alpha", False) & (n("direct_mean", 255) < 45) & (n("white_mean", 0) > 160) & (n("transparent", 0.0) > 0.15),
        "dark": ~n("has_alpha", False) & (w * h >= 20_000) & (n("direct_mean", 255) < 45),
        "small_file_image": small,
        "wide_short_text_line": wide,
        "extreme_aspect_ratio": extreme,
        "physics_context": (small | wide | extreme) & n("context", "").rlike(IMAGE_CONTEXT),
    }
    return metrics.select("key", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items()))).alias("codes"))


def asset_difference(rows: DataFrame) -> DataFrame:
    """(path, undeclared, unused) from (path, assets, references), where they differ."""
    a, b = F.coalesce("assets", F.array()), F.coalesce("references", F.array())
    out = rows.select("path", F.array_sort(F.array_except(b, a)).alias("undeclared"), F.array_sort(F.array_except(a, b)).alias("unused"))
    return out.where((F.size("undeclared") > 0) | (F.size("unused") > 0))


def figures_without_assets(rows: DataFrame, around: int = 120) -> DataFrame:
    """(path, signal, context): questions (path, question, assets, references) that name a figure and have none."""
    signal = F.regexp_extract("question", f"({FIGURE})", 1)
    rows = rows.withColumn("signal", signal).where((F.col("signal") != "") & (F.size(F.coalesce("assets", F.array())) <= 0) & (F.size(F.coalesce("references", F.array())) <= 0))
    at = F.expr("locate(signal, question)")
    begin = F.greatest(at - around, F.lit(1))
    context = F.substring("question", begin, at - begin + F.length("signal") + around)
    return rows.select("path", "signal", F.trim(F.regexp_replace(context, r"\s+", " ")).alias("context"))


def video_issues(videos: DataFrame, tolerance: float = 5.0, frames: int = 3) -> DataFrame:
    """(id, issue) from (id, bytes, duration, expected_duration, n_frames, text): existence, size, length, frames, noise."""
    return audit.issues(
        videos,
        ["id"],
        {
            "missing_file": F.col("bytes").isNull(),
            "empty_file": F.col("bytes") == 0,
            "duration_mismatch": F.abs(F.col("duration") - F.col("expected_duration")) > tolerance,
            "too_few_frames": F.coalesce("n_frames", F.lit(0)) < frames,
            "noise_only": F.trim("text").rlike(r"^[\W_]*$"),
        },
    )


def shared_hashes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Hashes that both sets have, which must be none."""
    return a.select(column).where(F.col(column).isNotNull()).intersect(b.select(column))


def registry_parity(registry: DataFrame, cards: DataFrame, required: list[str]) -> DataFrame:
    """(name, issue) of a registry (name, path, required..) against cards (name, path)."""
    lacking = audit.issues(registry, ["name"], {f"missing_{c}": F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in required})
    twice = registry.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("duplicate_name").alias("issue"))
    sides = two_way(registry, cards, "name").select("name", F.when(F.col("side") == "left_only", "without_card").otherwise("not_registered").alias("issue"))
    return lacking.union(twice).union(sides)


def migrated(files: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(path, text, changes): files whose references change by an ordered map of literal renames."""
    new, count = replaced(F.col("text"), pairs)
    return files.select("path", new.alias("text"), count.alias("changes")).where("changes > 0")


def unregistered(declared: DataFrame, registry: DataFrame) -> DataFrame:
    """(owner, id): declared dependencies (owner, ids) that the registry (id) lacks."""
    return declared.select("owner", F.explode("ids").alias("id")).distinct().join(registry, "id", "left_anti").select("owner", "id")


def first_level(path: Column, depth: int = 1) -> Column:
    """Whether a relative path lies no more than `depth` folders down: what a scan that does not recurse would see."""
    return F.size(F.split(path, "/")) <= depth + 1


def gaps_in_headings(lines: DataFrame) -> DataFrame:
    """(path, pos, level, before): headings that skip a level."""
    rows = lines.withColumn("level", F.length(F.regexp_extract("line", HEADING, 1))).where("level > 0")
    before = F.lag("level").over(Window.partitionBy("path").orderBy("pos"))
    return rows.withColumn("before", before).where(F.col("level") > F.col("before") + 1).select("path", "pos", "level", "before")

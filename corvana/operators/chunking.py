"""Structure-aware chunking of Markdown (path, name, text) by headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .tables import dealt

LEAST = 20


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def segments(rows: DataFrame, key: str, boundary: Column) -> DataFrame:
    """Lines (key, pos, line) with `seg`: how many boundaries come up to each. The running sum is per document."""
    w = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("seg", F.sum(boundary.cast("int")).over(w))


def joined(rows: DataFrame, key: str, least: int = LEAST, *more: Column) -> DataFrame:
    """(key, seg, text, index): lines of each segment in order; short segments go and take no index."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    text = F.regexp_replace(whole, r"^\s+|\s+$", "")
    out = rows.groupBy(key, "seg").agg(text.alias("text"), *more).where(F.length("text") >= least)
    return out.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy("seg")) - 1)


def chunk_id(kind: Column, name: Column, index: Column) -> Column:
    return F.format_string("%s-%s-%04d", kind, F.regexp_replace(name, r"\.md$", ""), index)


def _headed(docs: DataFrame, top: int) -> DataFrame:
    rows = lines(dealt(docs, "path"), "path", t.strip_frontmatter(F.regexp_replace("text", "\r\n", "\n")))
    level = F.length(F.regexp_extract("line", r"^(#+) ", 1))
    rows = rows.withColumn("level", level).withColumn("heading", F.trim(F.regexp_extract("line", r"^#+ (.*)", 1)))
    return segments(rows, "path", (F.col("level") >= 2) & (F.col("level") <= top))


def textbook(docs: DataFrame) -> DataFrame:
    """(path, title, text, chunk_index): second- to fourth-level headings part chunks; the title is their path."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = _headed(docs, 4)
    first = F.first(F.when(F.col("level") == 1, F.col("heading")), ignorenulls=True).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"h1": first, "g2": F.sum((F.col("level") == 2).cast("int")).over(w)})
    rows = rows.withColumn("g3", F.sum((F.col("level") == 3).cast("int")).over(Window.partitionBy("path", "g2").orderBy("pos")))
    last = lambda k, *by: F.last(F.when(F.col("level") == k, F.col("heading")), ignorenulls=True).over(Window.partitionBy("path", *by).orderBy("pos"))
    rows = rows.withColumn("title", F.concat_ws(" - ", "h1", last(2), last(3, "g2"), last(4, "g2", "g3")))
    body = rows.where(~F.col("level").between(1, 4))
    return joined(body, "path", LEAST, F.max("title").alias("title")).select("path", "title", "text", F.col("index").alias("chunk_index"))


def standard(docs: DataFrame) -> DataFrame:
    """As textbook with second- and third-level headings; third-level headings add up until the next second-level one."""
    rows = _headed(docs, 3)
    every = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("g2", F.sum((F.col("level") == 2).cast("int")).over(every))
    h1 = F.last(F.when(F.col("level") == 1, F.col("heading")), ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    h2 = F.last(F.when(F.col("level") == 2, F.col("heading")), ignorenulls=True).over(every)
    h3 = F.collect_list(F.when(F.col("level") == 3, F.col("heading"))).over(Window.partitionBy("path", "g2").orderBy("pos"))
    rows = rows.withColumns({"h1": h1, "h2": h2, "h3": h3}).withColumn("title", F.concat_ws(" - ", "h1", F.concat_ws(" / ", "h2", "h3")))
    return joined(rows.where(~F.col("level").between(1, 3)), "path", LEAST, F.max("title").alias("title")).select("path", "title", "text", F.col("index").alias("chunk_index"))


def exercise(docs: DataFrame) -> DataFrame:
    """One chunk a file: question, answer and explanation, each empty where the next heading or the blank line below its own
    lacks, with what the frontmatter tells. Images stay in the answer alone."""
    body, front = t.strip_frontmatter(F.col("text")), t.frontmatter(F.col("text"))
    part = lambda pattern: t.stripped(F.regexp_extract(body, rf"(?s){pattern}", 1))
    question, answer = t.stripped(t.strip_images(part(r"## 题目\n\n(.*?)(?=\n## 答案)"))), part(r"## 答案\n\n(.*?)(?=\n## 详解)")
    explanation = t.stripped(t.strip_images(part(r"## 详解\n\n(.*)")))
    own = F.coalesce(front["id"], F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    kind, points = F.coalesce(front["question_type"], F.lit("")), t.frontmatter_list(F.col("text"), "knowledge_points")
    return docs.select(
        "path",
        F.concat(F.lit("exercise-"), own).alias("id"),
        F.concat_ws(" ", own, kind, F.array_join(points, ", ")).alias("title"),
        F.concat(F.lit("题目："), question, F.lit("\n答案："), answer, F.lit("\n详解："), explanation).alias("text"),
        question.alias("question"),
        answer.alias("answer"),
        explanation.alias("explanation"),
        kind.alias("question_type"),
        points.alias("knowledge_points"),
        F.coalesce(front["difficulty"].try_cast("double"), F.lit(0.5)).alias("difficulty"),
        F.coalesce(front["source_title"], F.lit("")).alias("source_title"),
    )

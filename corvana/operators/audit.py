"""Corpus audits: links, ids, headings, manifests, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import hits


def dead(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges (src, dst) whose dst is no page (id)."""
    return edges.join(pages, edges.dst == pages.id, "left_anti")


def degrees(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, inlinks, outlinks) as distinct neighbours."""
    e = edges.select("src", "dst").distinct()
    i, o = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inlinks")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outlinks"))
    return pages.select("id").join(i, "id", "left").join(o, "id", "left").na.fill(0, ["inlinks", "outlinks"])


def orphans(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.select("id").join(edges, pages.id == edges.dst, "left_anti")


def incomplete(rows: DataFrame, group: str, kind: str, required: list[str]) -> DataFrame:
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.collect_set(kind)))
    return rows.groupBy(group).agg(lacking.alias("missing")).where(F.size("missing") > 0)


def gaps(ids: DataFrame, n: str, *by: str) -> DataFrame:
    """(low, high): runs of numbers that lack between neighbours. Without a prefix the numbers are dealt by ranges, and only
    each range's ends meet."""
    if by:
        before = F.lag(n).over(Window.partitionBy(*by).orderBy(n))
        return ids.select(*by, n).distinct().withColumn("_b", before).where(F.col(n) - F.col("_b") > 1).select(*by, (F.col("_b") + 1).alias("low"), (F.col(n) - 1).alias("high"))
    width = 100_000
    d = ids.select(F.col(n).alias("n")).distinct().withColumn("_r", F.floor(F.col("n") / width))
    inner = d.withColumn("_b", F.lag("n").over(Window.partitionBy("_r").orderBy("n"))).where(F.col("n") - F.col("_b") > 1).select((F.col("_b") + 1).alias("low"), (F.col("n") - 1).alias("high"))
    ends = d.groupBy("_r").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    w = Window.orderBy("_r")  # one row for each 100,000 numbers
    between = ends.withColumn("_b", F.lag("last").over(w)).where(F.col("first") - F.col("_b") > 1).select((F.col("_b") + 1).alias("low"), (F.col("first") - 1).alias("high"))
    return inner.union(between)


def duplicates(ids: DataFrame, key: str) -> DataFrame:
    return ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def repeated_noise(text: Column) -> Column:
    return text.rlike(r"(.{5,20})\1{3,}")


def issues(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, issue): a row for each rule that a row breaks."""
    return rows.select(*key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("issue"))


#: Phrases that stand in for an explanation, and the answer that refers to it.
PLACEHOLDERS, IN_EXPLANATION = "见解析原件|见答案", "见详解"


def exercise_issues(rows: DataFrame) -> DataFrame:
    """(path, issue) of rows (path, question, answer, explanation); a part that is null or empty is absent, and not judged."""
    answer, told = F.trim("answer"), F.trim("explanation")
    chosen = F.regexp_extract("explanation", r"故选\s*([A-Z]+)", 1)
    rules = {
        "no_answer": answer == "无",
        "placeholder": told.rlike(PLACEHOLDERS),
        "short_explanation": F.length(told).between(1, 19),
        "answer_mismatch": (chosen != "") & (answer != "") & (chosen != answer) & (answer != IN_EXPLANATION),
        "odd_dollars": F.regexp_count(F.col("question"), F.lit(r"(?<!\\)\$")) % 2 == 1,
    }
    return issues(rows, ["path"], rules)


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status) of two manifests (key, bytes, sha256)."""
    e, a = expected.select(key, F.col("bytes").alias("eb"), F.col("sha256").alias("eh")), actual.select(key, F.col("bytes").alias("ab"), F.col("sha256").alias("ah"))
    status = F.when(F.col("ah").isNull(), "missing").when(F.col("eh").isNull(), "extra").when(F.col("eb") != F.col("ab"), "size").when(F.col("eh") != F.col("ah"), "hash").otherwise("ok")
    return e.join(a, key, "full").select(key, status.alias("status"))


def renamed(expected: DataFrame, renames: DataFrame | None = None, prefixes: DataFrame | None = None, default_prefix: str = "") -> DataFrame:
    """expected(path, ..) under the paths that a migration gives them: first whole paths (old, new), then the first prefix (position,
    old, new) that fits, else the default prefix. Prefixes are looked up by the lengths that they have, not tried one by one. Of
    rows that come to one path the one with the largest old path holds."""
    rows = expected.withColumn("_old", F.col("path")).withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    if renames is not None:
        rows = rows.join(renames.select(F.col("old").alias("path"), F.col("new").alias("_new")), "path", "left").withColumn("path", F.coalesce("_new", "path")).drop("_new")
    if prefixes is not None:
        lengths = [r[0] for r in prefixes.select(F.length("old")).distinct().collect()]  # no more than a path has characters
        tried = rows.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n"))
        hit = tried.where(F.length("path") >= F.col("_n")).select("path", F.expr("left(path, _n)").alias("old")).join(prefixes, "old")
        first = hit.groupBy("path").agg(F.min_by(F.struct("old", "new"), "position").alias("_p"))
        rest = F.concat(F.col("_p.new"), F.expr("substr(path, length(_p.old) + 1)"))
        rows = rows.join(first, "path", "left").withColumn("path", F.when(F.col("_p").isNotNull(), rest).otherwise(F.concat(F.lit(default_prefix), "path"))).drop("_p")
    elif default_prefix:
        rows = rows.withColumn("path", F.concat(F.lit(default_prefix), "path"))
    others = [c for c in expected.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*others), "_old").alias("_r")).select("path", "_r.*")


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status, expected, actual, bytes) of a manifest (path, bytes, sha256) against files (path, bytes, sha256): missing, extra,
    size, hash or ok. Without an expected hash the size decides. bytes are those of a file that is ok."""
    e, a = expected.select("path", F.col("bytes").alias("_eb"), F.nullif("sha256", F.lit("")).alias("_eh"), F.lit(1).alias("_e")), actual.select("path", F.col("bytes").alias("_ab"), F.col("sha256").alias("_ah"), F.lit(1).alias("_a"))
    rows = e.join(a, "path", "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("_eb").eqNullSafe(F.col("_ab")), "size").when(F.col("_eh").isNotNull() & ~F.col("_eh").eqNullSafe(F.col("_ah")), "hash").otherwise("ok")
    told = lambda size, sha: F.when(status == "size", F.col(size).cast("string")).when(status == "hash", F.col(sha))
    return rows.select("path", status.alias("status"), told("_eb", "_eh").alias("expected"), told("_ab", "_ah").alias("actual"), F.when(status == "ok", F.col("_ab")).otherwise(0).cast("long").alias("bytes"))


def verdict(checked: DataFrame, allow_extra: bool = False) -> DataFrame:
    """One row over `verified`: ok, expected_files, verified_files, verified_bytes and how many files have each fault."""
    n = lambda s: F.count_if(F.col("status") == s)
    faults = n("missing") + n("size") + n("hash") + (F.lit(0) if allow_extra else n("extra"))
    return checked.agg((faults == 0).alias("ok"), (F.count("*") - n("extra")).alias("expected_files"), n("ok").alias("verified_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("verified_bytes"), n("missing").alias("missing"), n("extra").alias("extra"), n("size").alias("size_mismatch"), n("hash").alias("hash_mismatch"))


def normalized_segments(rows: DataFrame) -> DataFrame:
    """(id, idx, begin, end, text) from rows with aliased keys; an end before its begin takes the begin; noise goes."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*(F.col(c) for c in names if c in have), F.lit(None))
    begin, end = pick("start", "s", "begin").cast("double"), pick("end", "e", "finish").cast("double")
    out = rows.select("id", "idx", begin.alias("begin"), F.greatest(begin, F.coalesce(end, begin)).alias("end"), F.trim(pick("text", "sentence", "content")).alias("text"))
    return out.where((F.col("text") != "") & ~F.col("text").rlike(r"^[\W_]*$"))


#: Longest text in which signs of a platform are noise, and how many of its words make it so.
SHORT_SEGMENT, PLATFORM_WORDS = 60, 2


def cleaned_segments(rows: DataFrame, replacements: dict[str, str] | None = None, noise_only: str | None = None, platform: str | None = None, words: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(segments, counters) of transcript rows (id, idx, and begin, end and text under any of their names).

    White space becomes single blanks, then wrong words are replaced in order. A segment is dropped if nothing is left, all of it is
    noise (`noise_only`), it is short and shows a sign of the platform (`platform`, or two of `words`), it has no letter and no
    CJK character, or its times are no numbers. A missing time is 0, a missing end its begin; an end before the begin takes it.
    counters has one row an id: raw, kept and dropped segments."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*(F.col(c).cast("string") for c in names if c in have), F.lit(None).cast("string"))
    line = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    first, last, raw = pick("start", "s", "begin"), pick("end", "e", "finish"), line(pick("text", "sentence", "content"))
    begin, end = first.try_cast("double"), last.try_cast("double")
    broken = (first.isNotNull() & begin.isNull()) | (last.isNotNull() & end.isNull())
    begin = F.coalesce(begin, F.lit(0.0))
    end = F.coalesce(F.nullif(end, F.lit(0.0)), begin)
    text = raw
    for wrong, right in (replacements or {}).items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    hits = sum((F.contains(F.col("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    own = rows.select("id", "idx", broken.alias("_broken"), begin.alias("begin"), F.greatest(begin, end).alias("end"), text.alias("text"), raw.alias("raw_text"))
    short = (F.length("text") <= SHORT_SEGMENT) & ((F.col("text").rlike(platform) if platform else F.lit(False)) | (hits >= PLATFORM_WORDS))
    noise = (F.col("text") == "") | short | ~F.col("text").rlike(r"[\x{4e00}-\x{9fff}A-Za-z]")
    if noise_only:
        noise = noise | F.col("text").rlike(rf"\A(?:{noise_only})\z")
    judged = own.withColumn("_drop", F.col("_broken") | noise)
    counters = judged.groupBy("id").agg(F.count("*").alias("raw"), F.count_if(~F.col("_drop")).alias("kept"), F.count_if("_drop").alias("dropped"))
    return judged.where(~F.col("_drop")).select("id", "idx", "begin", "end", "text", "raw_text"), counters


def buckets(rows: DataFrame, key: str, begin: str, text: str, seconds: int = 120, longest: int = 1600, most: int = 80) -> DataFrame:
    """Texts of tumbling buckets in order of time, at most `most` buckets a key, each cut to `longest` characters."""
    parts = F.array_sort(F.collect_list(F.struct(begin, text)))
    out = rows.groupBy(key, F.floor(F.col(begin) / seconds).alias("bucket")).agg(F.substring(F.array_join(F.transform(parts, lambda x: x[text]), " "), 1, longest).alias("text"))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("bucket"))).where(F.col("_n") <= most).drop("_n")


def cues(rows: DataFrame, terms: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(term, key, n, overflow): the first hits of each term, and how many more there are."""
    hit = hits(rows, key, text, terms).select("term", key)
    counts = hit.groupBy("term").agg(F.count("*").alias("n"))
    first = hit.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(key))).where(F.col("_r") <= most).drop("_r")
    return first.join(counts, "term").withColumn("overflow", F.greatest(F.col("n") - most, F.lit(0)))


def retained(files: DataFrame, modified: str, days: int, now: Column) -> DataFrame:
    return files.where(F.col(modified) <= now - F.make_interval(days=F.lit(days)))

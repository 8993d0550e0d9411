"""The import path: names and ids, headers, files, homework sheets, answer cards, ledgers, and the store's schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Surnames of two characters.
COMPOUND_SURNAMES = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空".split()
#: The names by which a roster's columns go.
HEADER_ALIASES = {
    "seat_no": ("座号", "座位号", "班内学号", "班内学号（座位号）", "班内学号(座位号)", "seat_no"),
    "gender": ("性别", "gender"),
    "family_name": ("姓氏", "学生姓氏", "family_name"),
    "real_name": ("姓名", "学生姓名", "real_name", "name"),
    "class_id": ("class_id", "班级ID", "班级id"),
    "class_name": ("班级", "班级名称", "class_name"),
    "term_id": ("term_id", "学期ID", "学期id"),
}
HEADER_ROWS = 20


def family_name(name: Column) -> Column:
    """A compound surname if the name begins with one, else its first character; unknown for blanks."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")
    compound = F.regexp_extract(plain, f"^({'|'.join(COMPOUND_SURNAMES)})", 1)
    return F.when(plain == "", "未知").when(compound != "", compound).otherwise(F.substring(plain, 1, 1))


def person_id(term: Column, group: Column, gender: Column, seat: Column) -> Column:
    return F.concat(term, F.lit("_"), group, F.lit("_"), t.gender(gender), F.lit("_seat"), t.seat(seat))


def pseudonym(group_name: Column, family: Column, seat: Column) -> Column:
    return F.concat(group_name, F.lit("-"), F.trim(family), F.lit("-"), t.seat(seat), F.lit("号"))


def identified(roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with person_id and pseudonym, rejects): a given student_id must be the derived one, and a family name is needed."""
    own = person_id(F.col("term_id"), F.col("class_id"), F.col("gender"), F.col("seat_no"))
    given = F.nullif(F.trim(F.col("student_id")), F.lit("")) if "student_id" in roster.columns else F.lit(None)
    issue = F.when(F.coalesce(F.trim("family_name"), F.lit("")) == "", "family_name_missing").when(own.isNull() | (F.coalesce(F.trim("seat_no"), F.lit("")) == ""), "seat_missing").when(F.coalesce(given, own) != own, "student_id_not_derived")
    rows = roster.withColumns({"person_id": own, "pseudonym": pseudonym(F.col("class_name"), F.col("family_name"), F.col("seat_no")), "issue": issue})
    return rows.where("issue is null").drop("issue"), rows.where("issue is not null")


def json_issue(s: Column) -> Column:
    """Whether a text that is not blank fails to be one JSON value, with nothing after it."""
    alone = F.concat(F.lit("["), s, F.lit("]"))
    return (F.coalesce(F.trim(s), F.lit("")) != "") & (F.try_parse_json(alone).isNull() | (F.coalesce(F.json_array_length(alone), F.lit(0)) != 1))


def header(cells: DataFrame) -> DataFrame:
    """(sheet, row, names): the first of the first `HEADER_ROWS` rows of cells (sheet, row, col, value) that names a seat and a
    name, and the first column of each canonical name in it."""
    names = F.create_map(*[F.lit(x) for k, aliases in HEADER_ALIASES.items() for a in aliases for x in (a, k)])
    known = cells.where(F.col("row") < HEADER_ROWS).select("sheet", "row", "col", names[F.trim("value")].alias("name")).where("name is not null")
    columns = known.groupBy("sheet", "row", "name").agg(F.min("col").alias("col"))
    rows = columns.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "col"))).alias("names"))
    has = lambda k: F.map_contains_key("names", F.lit(k))
    rows = rows.where(has("seat_no") & (has("real_name") | has("family_name")))
    return rows.groupBy("sheet").agg(F.min_by(F.struct("row", "names"), "row").alias("h")).select("sheet", "h.*")


def file_kind(path: Column) -> Column:
    """What an import folder's file is, by suffix and then by name; the first rule that fits holds."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    low = F.lower(name)
    return (
        F.when(low.endswith(".json"), "preprocess_summary_json")
        .when(low.endswith(".png"), "answer_card_png")
        .when(name.endswith("_roster.csv"), "roster_csv")
        .when(name.contains("answer_card_manifest"), "answer_card_manifest_csv")
        .when(name.contains("scores_ready"), "score_ready_csv")
        .when(name.endswith("_scores.csv"), "score_csv")
        .when(name.contains("item_map_review"), "item_map_review_csv")
        .otherwise("import_csv")
    )


def archived(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Files (path, content) as artifacts: stable id, kind, checksum, and the evidence row (ref, path) that names them."""
    path = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", "")
    rows = files.select(path(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    rows = rows.withColumns({"artifact_id": F.concat(F.lit("artifact_"), F.substring(F.sha2("path", 256), 1, 24)), "kind": file_kind(F.col("path"))})
    return rows.join(evidence.select("ref", path(F.col("path")).alias("path")), "path", "left")


def first_token(name: Column, tokens: dict[str, Iterable[str]]) -> Column:
    """The first class whose tokens the name contains."""
    out = None
    for found, words in tokens.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out if out is not None else F.lit(None).cast("string")


def homework_items(wide: DataFrame) -> DataFrame:
    """Long form of a homework sheet: one row an item of Q.._correct; only the flag 1 is correct, attempts are 1 by default."""
    items = sorted(c[: -len("_correct")] for c in wide.columns if c.startswith("Q") and c.endswith("_correct"))
    column = lambda i, suffix: F.col(f"{i}_{suffix}") if f"{i}_{suffix}" in wide.columns else F.lit(None).cast("string")
    entry = lambda i: F.struct(
        F.lit(i).alias("item_no"),
        F.coalesce((column(i, "correct").cast("string") == "1").cast("int"), F.lit(0)).alias("is_correct"),
        F.coalesce(t.whole(column(i, "attempt_count").cast("string")), F.lit(1)).alias("attempts"),
        column(i, "error_type").cast("string").alias("error_type"),
    )
    submission = F.concat_ws("_", "assignment_id", "student_id")
    return wide.select("assignment_id", "student_id", submission.alias("submission_id"), F.inline(F.array(*map(entry, items)))).withColumn("result_id", F.concat_ws("_", "submission_id", "item_no"))


def scores_of_people(scores: DataFrame, people: DataFrame) -> DataFrame:
    """Score rows (name, ..) with the id of the person of that name; the name goes, and so do names that nobody has."""
    return scores.join(people.select("name", "student_id"), "name").drop("name")


def answer_cards(people: DataFrame, cards: DataFrame, exam: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, counts by status) of people (class_id, student_id, name, seat_no) and cards (class_id, name, sha256)."""
    rows = people.join(cards.select("class_id", "name", "sha256"), ["class_id", "name"], "left")
    assessment = F.concat_ws("_", "class_id", F.lit(exam))
    there = F.col("sha256").isNotNull()
    rows = rows.select(
        assessment.alias("assessment_id"), "class_id", "student_id", "seat_no",
        F.when(there, "present").otherwise("missing_artifact").alias("artifact_status"),
        F.when(there, F.concat(F.lit(f"{exam}/"), "class_id", F.lit("-seat"), "seat_no", F.lit(".png"))).otherwise("").alias("redacted_path"),
        F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.when(there, F.concat_ws(":", F.lit("answer_card"), assessment, "student_id")).otherwise("missing_artifact").alias("evidence_ref"),
    )
    return rows, rows.groupBy("artifact_status").agg(F.count("*").alias("n"))


def by_seat() -> list[Column]:
    """Numeric seats first, by number; then the others."""
    n = F.expr("try_cast(seat_no as int)")
    return [n.isNull().asc(), n.asc(), F.col("seat_no").asc()]


def batch_row(spark: SparkSession, kind: str, source: str, content: DataFrame | None, rows: int, errors: int, actor: str, real: bool = False) -> DataFrame:
    """A row of the import ledger; content is the source file as `binaryFile` reads it, whose bytes make the checksum."""
    made = spark.range(1).select(
        F.concat(F.lit("batch_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("batch_id"), F.lit(kind).alias("import_type"), F.lit(source).alias("source_file"), F.lit(rows).alias("row_count"),
        F.lit(rows - errors).alias("success_count"), F.lit(errors).alias("error_count"), F.lit(actor).alias("imported_by"), F.lit(int(real)).alias("real_data"),
    )
    if content is None:
        return made.withColumn("checksum", F.lit(""))
    return made.crossJoin(content.agg(F.coalesce(F.max(F.sha2("content", 256)), F.lit("")).alias("checksum")))  # one row each


def pick(results: DataFrame, seats: DataFrame, student_id: str | None = None, seat_no: str | None = None, seed: int | None = None) -> DataFrame:
    """One row of results (student_id, class_id, term_id) with its seat: by id or by seat, else the first id, or any by a seed.
    A seat row holds where its term is the result's, or either has none."""
    if student_id and seat_no:
        raise ValueError("either student_id or seat_no, not both")
    s = seats.select("student_id", "class_id", F.col("term_id").alias("_term"), "seat_no")
    on = (results.student_id == s.student_id) & (results.class_id == s.class_id) & ((s._term == results.term_id) | results.term_id.isNull() | s._term.isNull())
    rows = results.join(s, on, "left").select(results["*"], s.seat_no)
    if student_id:
        rows = rows.where(F.col("student_id") == student_id)
    elif seat_no:
        rows = rows.where(F.col("seat_no") == seat_no)
    return rows.orderBy(F.rand(seed) if seed is not None else F.col("student_id"), "seat_no").limit(1)


class Store:
    """Tables of a namespace: migrations are applied in order of their names, each once; one mode at a time."""

    def __init__(self, spark: SparkSession, namespace: str, dev: bool = False, key: str | None = None):
        if dev == bool(key):
            raise ValueError("either a development store or one with a key")
        if not namespace.replace("_", "").isalnum():
            raise ValueError(f"{namespace} is no name of a store")
        self.spark, self.namespace = spark, namespace

    def migrate(self, migrations: dict[str, list[str]]) -> list[str]:
        """Apply what is new of {version: statements}; `{ns}` in a statement is the namespace."""
        run = self.spark.sql
        run(f"create namespace if not exists {self.namespace}")
        run(f"create table if not exists {self.namespace}.schema_migrations (version string) using parquet")
        known = {r[0] for r in self.spark.table(f"{self.namespace}.schema_migrations").collect()}  # one row a migration
        done = [v for v in sorted(migrations) if v not in known]
        for version in done:
            for statement in migrations[version]:
                run(statement.replace("{ns}", self.namespace))
            self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.insertInto(f"{self.namespace}.schema_migrations")
        return done

    def reset(self) -> None:
        self.spark.sql(f"drop namespace if exists {self.namespace} cascade")

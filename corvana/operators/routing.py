"""Routing: lexical, rule and semantic scores, ranking and confidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import MOST_TERMS, automaton, hits
from .sizes import small
from .tables import numbered, saved


#: What a term of each kind adds; a trigger adds its length too, up to `LONGEST`. A record's own name and category.
WEIGHTS, LONGEST, NAMED, STAGED = {"trigger": 28, "hint": 14, "card": 10, "negative": -35}, 8, 4, 100
#: Records of a registry that a task scores at once.
MOST_RECORDS = 20_000


def lexical(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, rec, score): weights of the terms (rec, term, weight) that a query (qid, text) contains, case folded."""
    plain = terms.select("rec", F.lower(F.trim("term")).alias("term"), F.col("weight").cast("long").alias("weight"))
    hit = hits(queries.select("qid", F.lower("text").alias("low")), "qid", "low", plain)
    return hit.join(small(plain), "term").groupBy("qid", "rec").agg(F.sum("weight").cast("long").alias("score"))


def weighed(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(rec, term, weight) of the typed terms (rec, kind, term) of a registry, with the names and categories of its records. A term
    that a record lists twice counts twice."""
    kind = F.when(F.col("kind") == "trigger", WEIGHTS["trigger"] + F.least(F.length("term"), F.lit(LONGEST)))
    for name, weight in WEIGHTS.items():
        kind = kind.when(F.col("kind") == name, weight)
    typed = terms.select("rec", "term", kind.cast("long").alias("weight")).where("weight is not null")
    named = records.select("rec", F.explode(F.array("name", "category")).alias("term"), F.lit(NAMED).cast("long").alias("weight"))
    every = typed.union(named).select("rec", F.lower(F.trim("term")).alias("term"), "weight")
    return every.where("term is not null and term <> ''")


def routed(queries: DataFrame, records: DataFrame, terms: DataFrame, fallback: str, k: int = 2) -> DataFrame:
    """(qid, rec, rank, score, lexical, bonus, semantic): the k best records of each query.

    queries(qid, text, stage, semantic): the record that a stage rule names, and a map of cosines, may both be null.
    records(rec, name, category, priority, position), terms(rec, kind, term). A record begins with a tenth of its priority
    (50 where it is null), so all records take part. The total is that with the terms it matches, `STAGED` for the stage's record
    and the semantic part; ties go to the stage's record, then to the first position. Where no total is over 0 the answer is the
    fallback alone, with 0. A task holds the registry once, as an automaton over its terms."""
    listed = records.select("rec", "position", F.floor(F.coalesce("priority", F.lit(50)) / 10).cast("long")).orderBy("position", "rec").limit(MOST_RECORDS + 1).collect()
    if len(listed) > MOST_RECORDS:
        raise ValueError(f"over {MOST_RECORDS} records; route by `lexical`, which needs no whole registry")
    place = {r[0]: n for n, r in enumerate(listed)}
    found = weighed(records, terms).groupBy("term").agg(F.collect_list(F.struct("rec", "weight")).alias("adds")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms; route by `lexical`, which takes them in blocks")
    adds = [([place[x[0]] for x in r["adds"] if x[0] in place], [x[1] for x in r["adds"] if x[0] in place]) for r in found]
    shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in listed], [r[2] for r in listed], [r["term"] for r in found], adds))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("rec", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("rank", "score", "lexical", "bonus", "semantic"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base, words, adds = shared.value
        at, made, base = {x: n for n, x in enumerate(names)}, automaton(words), np.array(base, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for row, (low, stage, cosines) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                own = base.copy()
                for n in {n for _, n in made.iter(low)} if low else ():
                    np.add.at(own, adds[n][0], adds[n][1])
                bonus, near = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                if stage in at:
                    bonus[at[stage]] = STAGED
                for rec, cosine in cosines or ():
                    if rec in at and cosine is not None and cosine > 0:
                        near[at[rec]] = int(cosine * 15)
                total = own + bonus + near
                best = np.lexsort((np.arange(len(total)), -bonus, -total))[:k]
                if not len(best) or total[best[0]] <= 0:
                    parts = [(fallback, 1, 0, 0, 0, 0)]
                else:
                    parts = [(names[x], n + 1, int(total[x]), int(own[x]), int(bonus[x]), int(near[x])) for n, x in enumerate(best)]
                for p in parts:
                    for column, value in zip(out, (row, *p), strict=True):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), *(pa.array(x, pa.int64()) for x in out[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return queries.select("qid", F.lower("text").alias("low"), "stage", "semantic").mapInArrow(run, schema)


def with_confidence(routes: DataFrame) -> DataFrame:
    """(qid, rec, score, confidence) of the first of routes (qid, rec, rank, score, staged)."""
    top = routes.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.struct("rec", "score"))).alias("a"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0)).alias("second"), F.max("staged").alias("staged"))
    return top.select("qid", "a.rec", "a.score", confidence(F.col("a.score"), F.col("second"), F.col("staged")).alias("confidence"))


def stage(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(qid, stage): the first rule (ordinal, stage, term, unless) that fits each query."""
    low = queries.select("qid", F.lower("text").alias("low"))
    stated = rules.select("ordinal", "stage", F.lower("term").alias("term"), F.nullif(F.lower("unless"), F.lit("")).alias("unless"))
    found = hits(low, "qid", "low", stated.select("term").union(stated.select("unless")))
    fits = found.join(small(stated), "term").join(found.select("qid", F.col("term").alias("unless")), ["qid", "unless"], "left_anti")
    return fits.groupBy("qid").agg(F.min_by("stage", "ordinal").alias("stage"))


def semantic(cosine: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), cosine) * 15).cast("long")


def ranked(scores: DataFrame, fallback: str) -> DataFrame:
    """(qid, rec, score, runner_up) of the best record of each query; the fallback where none scores over 0."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rec")
    rows = scores.withColumns({"_n": F.row_number().over(w), "runner_up": F.coalesce(F.lead("score").over(w), F.lit(0))}).where("_n = 1")
    return rows.select("qid", F.when(F.col("score") > 0, F.col("rec")).otherwise(fallback).alias("rec"), "score", "runner_up")


def confidence(top: Column, runner_up: Column, staged: Column) -> Column:
    base = F.when(staged, 0.72).otherwise(0.58)
    value = base + F.least((top - runner_up) / 220.0, F.lit(0.18)) + F.least(top / 500.0, F.lit(0.08))
    return F.when(top <= 0, 0.42).otherwise(F.bround(F.least(F.lit(0.98), F.greatest(F.lit(0.35), value)), 2))


def follow_ups(primary: DataFrame, queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(qid, queued): next records by rules (rec, term, next, ordinal), in order, each once."""
    stated = rules.select("rec", F.lower("term").alias("term"), "next", "ordinal")
    found = hits(queries.select("qid", F.lower("text").alias("low")), "qid", "low", stated)
    hit = found.join(primary.select("qid", "rec"), "qid").join(small(stated), ["rec", "term"])
    return hit.groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "next"))), lambda x: x["next"])).alias("queued"))


def terms(s: Column) -> Column:
    """Parts between commas, semicolons and enumeration commas, trimmed, without backticks and blanks."""
    parts = F.filter(F.split(s, "[,，;；、]"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^`+|`+$", ""))


#: Hashes that one array holds.
HASHES = 4096


def content_hash(records: DataFrame, key: str) -> DataFrame:
    """One row: a hash of all records in canonical form, in key order. Hashes of records are hashed in blocks of `HASHES`, blocks
    again, until one is left, so no array grows with the registry; an empty registry is the hash of nothing."""
    own = F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256)
    at = numbered(records.select(F.col(key).alias("_k"), own.alias("_h")), "_k", "_h", name="_n").select((F.col("_n") - 1).alias("_n"), "_h")
    while True:
        listed = F.array_sort(F.collect_list(F.struct("_n", "_h")))
        at = saved(at.groupBy(F.floor(F.col("_n") / HASHES).alias("_b")).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["_h"]), ""), 256).alias("_h")).select(F.col("_b").alias("_n"), "_h"), "hashes")
        if at.count() <= 1:
            return at.agg(F.coalesce(F.max("_h"), F.sha2(F.lit(""), 256)).alias("sha256"))


def stale(records: DataFrame, key: str, cached: str | None) -> bool:
    return content_hash(records, key).first()[0] != cached


def failures(cases: DataFrame, routed: DataFrame, least: float = 0.55) -> DataFrame:
    """Cases (qid, primary, queued, min_confidence) that routed (qid, rec, queued, confidence) does not meet."""
    got = routed.select("qid", "rec", F.col("queued").alias("_queued"), "confidence")
    rows = cases.join(got, "qid", "left")
    lacking = F.array_except(F.coalesce("queued", F.array().cast("array<string>")), F.coalesce("_queued", F.array().cast("array<string>")))
    bad = ~F.col("rec").eqNullSafe(F.col("primary")) | (F.size(lacking) > 0) | (F.coalesce("confidence", F.lit(0.0)) < F.coalesce("min_confidence", F.lit(least)))
    return rows.where(bad).select("qid", "primary", "rec", lacking.alias("missing_queued"), "confidence")

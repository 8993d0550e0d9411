"""Quality rules with host verdicts.

Each document is measured once. Rule failures are then counted by host (`source`), each rule's failure rate of a host is
shrunk towards all hosts by an empirical beta prior (method of moments over the hosts), and a host whose shrunk rate
passes the rule's limit is rejected; the verdicts join back to the documents. Counts by host are summed in each task
first, so a host with most documents costs one row a task; rejected hosts are broadcast only when few, else the join
is salted.

Defined results: null text has no words and fails by too few of them. Null is a host of its own. Repeated rows are judged
one by one and count each for their host. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCodes, saved, table, text_bytes, windows

LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Rule: the shrunk failure rate from which a host is rejected.
HOST_LIMITS = {"few_words": 0.5, "repeats": 0.5, "symbols": 0.7, "dup_lines": 0.7}
#: A document fails `symbols` over so many symbols per 100 word characters, and `dup_lines` over so many repeated lines. At
#: sf0.1 clean text has 3.6 symbols at most and junk 5 to 40.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 5
#: Rejected hosts up to this number are broadcast (under 2 MB).
BROADCAST_HOSTS, SALTS = 20_000, 64
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NOT_COUNTED = bytes(range(9, 14)) + b" " + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a character


def repeated_words(codes: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a run of `size` words which the text has twice or more."""
    runs = windows(codes, size)
    if len(runs) < 2:
        return 0
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    edges = np.zeros(len(codes) + 1, np.int64)
    twice = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def measures(texts: pa.Array, codes: WordCodes) -> list[pa.Array]:
    """The five MEASURES of each whole text."""
    out = []
    for text in text_bytes(texts):
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        out.append((len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(codes.of(words))))
        codes.settle()
    return [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(MEASURES))]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source) and the MEASURES of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *measures(batch.column(2), codes)], names=["doc_id", "source", *MEASURES])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def failures(measured: DataFrame) -> DataFrame:
    """measured with one flag a rule, and base_failed."""
    few = F.col("n_words") < LEAST_WORDS
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    return measured.withColumns(
        {
            "f_few_words": few,
            "f_repeats": repeats,
            "f_symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars"),
            "f_dup_lines": F.col("n_dup_lines") > MOST_DUP_LINES,
            "base_failed": few | repeats,
        }
    )


def host_verdicts(flagged: DataFrame) -> DataFrame:
    """(host, n, one shrunk rate a rule, rejected) of each host."""
    hosts = flagged.groupBy(F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("no_host"))
    hosts = hosts.agg(F.count("*").alias("n"), *(F.sum(F.col(f"f_{k}").cast("long")).alias(k) for k in HOST_LIMITS))
    prior = hosts.agg(
        F.count("*").alias("_hosts"),
        *(F.avg(F.col(k) / F.col("n")).alias(f"_m_{k}") for k in HOST_LIMITS),
        *(F.coalesce(F.var_samp(F.col(k) / F.col("n")), F.lit(0.0)).alias(f"_v_{k}") for k in HOST_LIMITS),
    )
    rated = hosts.join(F.broadcast(prior))  # one row
    for k in HOST_LIMITS:
        m, v = F.col(f"_m_{k}"), F.col(f"_v_{k}")
        # Weight of the prior in documents; hosts that do not differ leave it at its most.
        weight = F.when(v <= 0, 1000.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / F.greatest(v, F.lit(1e-12)) - 1)))
        rated = rated.withColumn(f"rate_{k}", (F.col(k) + m * weight) / (F.col("n") + weight))
    rejected = F.lit(False)
    for k, limit in HOST_LIMITS.items():
        rejected = rejected | (F.col(f"rate_{k}") > limit)
    return rated.select("host", "no_host", "n", *(f"rate_{k}" for k in HOST_LIMITS), rejected.alias("rejected"))


def with_verdict(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows with host_rejected, from the rejected hosts."""
    bad = saved(verdicts.where("rejected").select("host", "no_host", F.lit(True).alias("host_rejected")), "hosts")
    rows = rows.withColumns({"host": F.coalesce("source", F.lit("")), "no_host": F.col("source").isNull()})
    if len(bad.limit(BROADCAST_HOSTS + 1).select(F.lit(1)).collect()) <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(bad), ["host", "no_host"], "left")
    else:
        salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "no_host", "_salt"], "left").drop("_salt")
    return joined.drop("host", "no_host").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    measured = saved(measure(docs), "measured")
    flagged = failures(measured)
    return with_verdict(flagged, host_verdicts(flagged)).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op5(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, as they came. One pass measures each text and writes the measures of all
    rows, with the rows themselves where the base rules keep them; hosts are then judged on the measures alone."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            found = measures(batch.column(2), codes)
            ok = [n >= LEAST_WORDS and 100 * r <= MOST_REPEATED * n for n, r in zip(found[0].to_pylist(), found[4].to_pylist(), strict=True)]
            rows = batch.column(0).take(pa.array([k if x else None for k, x in enumerate(ok)], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, batch.column(1), *found], names=["_row", "source", *MEASURES])

    schema = T.StructType([T.StructField("_row", keyed.schema["_row"].dataType), keyed.schema["source"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    measured = saved(keyed.mapInArrow(run, schema), "measured")
    good = measured.where(F.col("_row").isNotNull()).select("_row", "source", F.col("_row.doc_id").alias("doc_id"))
    return with_verdict(good, host_verdicts(failures(measured))).where(~F.col("host_rejected")).select("_row.*")


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, {WORDS} as ws from documents),
w as (select rid, w, i from (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d)),
g as (select rid, i, w || chr(31) || lead(w, 1) over o || chr(31) || lead(w, 2) over o || chr(31) || lead(w, 3) over o || chr(31) || lead(w, 4) over o as g
      from w window o as (partition by rid order by i)),
r as (select rid, i from (select rid, i, g, count(*) over (partition by rid, g) as n from g where g is not null) where n > 1),
c as (select rid, count(distinct i + k) as n from r, range(0, 5) t(k) group by rid),
l as (select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
m as (select d.rid, doc_id, source, cast(len(ws) as bigint) as n_words,
      cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
      cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
      cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
      from d left join c using (rid) left join l using (rid)),
f as (select *, n_words < 10 as few_words, 100 * n_repeat_words > 20 * n_words as repeats, 100 * n_symbols > {MOST_SYMBOLS} * word_chars as symbols, n_dup_lines > {MOST_DUP_LINES} as dup_lines from m),
h as (select source, count(*) as n, {", ".join(f"sum({k}::int) as {k}" for k in HOST_LIMITS)} from f group by source),
p as (select {", ".join(f"avg({k} / n) as m_{k}, coalesce(var_samp({k} / n), 0) as v_{k}" for k in HOST_LIMITS)} from h),
q as (select h.*, {", ".join(f"case when v_{k} <= 0 then 1000 else least(1000, greatest(1, m_{k} * (1 - m_{k}) / greatest(v_{k}, 1e-12) - 1)) end as w_{k}, m_{k}" for k in HOST_LIMITS)} from h, p),
v as (select source, {" or ".join(f"({k} + m_{k} * w_{k}) / (n + w_{k}) > {limit}" for k, limit in HOST_LIMITS.items())} as rejected from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words or repeats as base_failed,
       not (few_words or repeats) and not rejected as kept
from f join v on f.source is not distinct from v.source
"""

"""Which of many stated strings a text holds: one automaton a task finds them all in one pass over the text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings and characters of one automaton (about 400 MB of a worker at most); more strings take further passes.
MOST_TERMS, MOST_CHARS = 200_000, 8_000_000


def automaton(terms: list[str]):
    """Aho-Corasick automaton of distinct terms, each with its number."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        made.add_word(term, k)
    made.make_automaton()
    return made


def blocks(terms: DataFrame) -> Iterator[list[str]]:
    """Terms (term), distinct and not empty, in blocks of a bounded size. A term that is alone beyond `MOST_CHARS` is a block."""
    terms = terms.select("term").where("term is not null and term <> ''").distinct()
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    parts = max(-(-n // MOST_TERMS), -(-chars // MOST_CHARS))
    for k in range(parts):
        block = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        if found := [r[0] for r in block.toLocalIterator()]:
            yield found


def hits(texts: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    """(id, term): the terms (term) that the text of each row holds, each once a row. Null and empty terms and texts match
    nothing."""
    schema = T.StructType([T.StructField(id, texts.schema[id].dataType), T.StructField("term", T.StringType())])
    rows, spark = texts.select(id, text), texts.sparkSession
    found = [spark.createDataFrame([], schema)]
    for block in blocks(terms):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            listed = shared.value
            made = automaton(listed)
            for batch in batches:
                at, which = [], []
                for row, told in enumerate(batch.column(1).to_pylist()):
                    seen = {k for _, k in made.iter(told)} if told else ()
                    at += [row] * len(seen)
                    which += [listed[k] for k in seen]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(which, pa.string())], names=[id, "term"])

        found.append(rows.mapInArrow(run, schema))
    return functools.reduce(DataFrame.union, found[1:] or found)

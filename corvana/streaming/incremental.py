"""Incremental forms of three batch operators; additions, since batch is all that the blueprint has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def bucket_counts(events: DataFrame, late: str = "10 minutes", width: str = "2 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def unseen(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content hash once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha"])


def statuses(events: DataFrame, transitions: dict[tuple[str, str], str], initial: str = "queued") -> DataFrame:
    """(id, status) after each micro-batch, by a transition table over (status, event); events is (id, seq, event)."""

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else initial
        for _, row in pd.concat(list(batches)).sort_values("seq").iterrows():
            status = transitions.get((status, row["event"]), status)
        state.update((status,))
        yield pd.DataFrame({"id": [key[0]], "status": [status]})

    schema = StructType([events.schema["id"], StructField("status", StringType())])
    return events.groupBy("id").applyInPandasWithState(advance, schema, "status string", "update", "NoTimeout")

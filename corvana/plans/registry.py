"""Named queries over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return function

    return add

"""Session settings that the operators assume, and logical paths."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}
#: Logical id: path below the root, unless CORVANA_<ID> says otherwise.
LAYOUT = {"corpus": "corpus", "index": "index", "store": "store", "reports": "reports"}


def session(name: str = "corvana", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def confined(root: str, path: str) -> str:
    """path below root; anything outside is an error."""
    top, full = Path(root).resolve(), (Path(root) / path).resolve()
    if top != full and top not in full.parents:
        raise ValueError(f"{path} is outside {root}")
    return str(full)


def located(root: str, name: str) -> str:
    if name not in LAYOUT:
        raise KeyError(name)
    return confined(root, os.environ.get(f"CORVANA_{name.upper()}", LAYOUT[name]))

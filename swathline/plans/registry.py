"""Registry binding each operator to its query over the supplied tables and its checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from swathline.plans.views import Views

Build = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Views(spark, sf_dir))


ENTRIES: dict[str, Entry] = {}


def as_doubles(sql: str) -> str:
    """Spell decimal literals outside quotes as doubles (``0.5`` -> ``0.5e0``)."""
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", part) for part in parts[::2]]
    return "'".join(parts)


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build`` under ``name``; ``sql`` is the independent statement it is checked with."""

    def wrap(build: Build) -> Build:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, build, as_doubles(sql) if sql else None)
        return build

    return wrap

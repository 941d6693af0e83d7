"""Registered queries: a name, how to build it over a folder of tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures


#: Moves exact halves off the border, where engines round apart.
NUDGE = 1e-9


@dataclass
class Query:
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    sql: str | None = None
    doubles: str = ""

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        def source(name: str) -> DataFrame:
            return fixtures.view(spark, sf_dir, name) if name.startswith("fx_") else spark.read.parquet(f"{sf_dir}/{name}.parquet")

        out = self.build(source)
        return out.select(*[F.round(F.col(c) + NUDGE, 6).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in out.dtypes])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = fixtures.with_views(self.sql)
        if not self.doubles:
            return body
        return f"SELECT * REPLACE ({', '.join(f'round({c} + {NUDGE}, 6) AS {c}' for c in self.doubles.split())}) FROM ({body}) q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: str = ""):
    def add(build):
        REGISTRY[name] = Query(build, sql, doubles)
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: q.frame for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, q in REGISTRY.items() if (sql := q.oracle()) is not None}


def load() -> None:
    from . import q_agreement, q_align, q_scoring, q_series, q_sources, q_streams, q_text  # noqa: F401

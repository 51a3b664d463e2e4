"""Registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures
from .core import CORE
from .ingest import INGEST
from .models import MODELS
from .quality import QUALITY
from .race import RACE
from .views import with_views

ALL = CORE | RACE | INGEST | QUALITY | MODELS


def prepare(spark: SparkSession) -> None:
    """Settings for wide reports: the driver holds no long plan texts and derives no constraints by the thousand."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000)
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


def _bound(plan: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return plan(Fixtures(spark, sf_dir))

    return query


QUERIES = {name: _bound(plan) for name, (plan, _) in ALL.items()}
SQL = {name: with_views(sql) for name, (_, sql) in ALL.items() if sql}

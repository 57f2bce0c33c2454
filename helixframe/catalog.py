"""The registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans.annotation import QUERIES as ANNOTATION
from helixframe.plans.assembly import QUERIES as ASSEMBLY
from helixframe.plans.intervals import QUERIES as INTERVALS
from helixframe.plans.matrix import QUERIES as MATRIX
from helixframe.plans.networks import QUERIES as NETWORKS
from helixframe.plans.sequences import QUERIES as SEQUENCES
from helixframe.plans.statistics import QUERIES as STATISTICS

Query = Callable[[SparkSession, str], DataFrame]
#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {**MATRIX, **STATISTICS, **SEQUENCES, **INTERVALS, **NETWORKS, **ANNOTATION, **ASSEMBLY}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY["matrix_group_summary"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}

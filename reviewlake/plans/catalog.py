"""All registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlake.oracles import models, prep, triage
from reviewlake.plans import model_queries, prep_queries, triage_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**prep_queries.QUERIES, **triage_queries.QUERIES, **model_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**prep.oracle(), **triage.oracle(), **models.oracle()}

"""The table of registered queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one where that is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{path.rstrip('/') if path else mkdtemp(prefix='sylva-')}/{uuid4().hex}"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})

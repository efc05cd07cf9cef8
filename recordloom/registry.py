"""Where queries are registered, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None, *decimals: str) -> Callable:
    """Register a query with its SQL; exact DECIMAL columns, named here, come out as doubles on both sides."""

    def add(run: Callable) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = run(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else out

        QUERIES[run.__name__] = query
        if sql:
            ORACLES[run.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in decimals)}) FROM ({sql})" if decimals else sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(15,2)")


def fields(df: DataFrame, *numbers: str) -> dict[str, Column]:
    """Columns by COBOL names; the named ones as money."""
    return {c.upper().replace("_", "-"): money(c) if c in numbers else F.col(c) for c in df.columns}

"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import prepare


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; columns and filters are pushed to the scan by Catalyst."""
    return prepare(spark).read.parquet(table_path(folder, name))

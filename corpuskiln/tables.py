"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` under ``root``, only the given columns if there are any.

    Naming the columns keeps the Parquet ``ReadSchema`` small whatever comes later.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df

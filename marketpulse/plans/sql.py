"""Parameterised SQL (C9): SQL text with bound values, all rows or the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql(spark: SparkSession, text: str, args: dict | list | None = None,
        first: bool = False) -> DataFrame:
    """Run ``text`` with named (``:name``) or positional (``?``) parameters.

    Values are bound by Spark, never spliced into the text.  ``first``
    limits the result to one row (the "fetch one" form).
    """
    df = spark.sql(text, args=args) if args else spark.sql(text)
    return df.limit(1) if first else df

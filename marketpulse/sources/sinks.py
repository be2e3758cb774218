"""Sinks (S8, S9, S12) and stored tables.

Tables are Parquet folders written by Spark's own writers: appends for prices
and indicators (partitioned by symbol); for news (partitioned by a prefix of
the id, which is a hash) appends of new ids and dynamic overwrite of the
partitions whose stored rows change.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse import schemas
from marketpulse.operators import tables


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, UTF-8, overwrite; quoting doubles embedded quotes."""
    (df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8")
       .option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


# Time columns a partitioned table is clustered by inside each partition.
TIME_COLUMNS = ("recorded_at", "Date", "published_at", "created_at")


def clustered(df: DataFrame, by: str, order: str | None = None) -> DataFrame:
    """Rows arranged for a write partitioned by ``by``.

    Range-partitioned on (by, time): a symbol holding a large share of the
    rows is split over many tasks, each writing one time slice of it, and
    every file is sorted by time (tight min/max statistics for time-range
    filters).  Partitioning on ``by`` alone would send a whole symbol to one
    task.  Without a time column the rows are written as they are.
    """
    order = order or next((c for c in TIME_COLUMNS if c in df.columns), None)
    if order is None:
        return df
    return df.repartitionByRange(by, order).sortWithinPartitions(by, order)


def write_price_files(df: DataFrame, directory: str, quote: str = "USDT") -> None:
    """S8 for prices: one ``{SYM}{quote}_historical_prices.csv`` folder per
    symbol with columns Date, Open, High, Low, Close, Volume, in one job
    (a partitioned write, so no loop over symbols); read back by
    ``files.read_prices``."""
    cols = ["Date", "Open", "High", "Low", "Close", "Volume"]
    named = df.select(F.concat(F.col("symbol"), F.lit(f"{quote}_historical_prices.csv")).alias("file"),
                      *cols)
    (clustered(named, "file", "Date").write.mode("overwrite").option("header", True)
       .option("encoding", "UTF-8").partitionBy("file").csv(directory))


def write_partitioned(df: DataFrame, path: str, by: str = "symbol", mode: str = "overwrite",
                      order: str | None = None) -> None:
    """Parquet partitioned by ``by``; overwrite replaces only the
    partitions present in ``df`` (dynamic partition overwrite)."""
    (clustered(df, by, order).write.mode(mode)
       .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table in its declared schema; an empty frame if none exists yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_rows(df: DataFrame, path: str, by: str = "symbol", written: Observation | None = None,
                order: str | None = None) -> None:
    """Add rows to a partitioned table: Spark's own append, which writes new
    files beside the stored ones and touches none of them.  ``written``
    observes the number of rows (``rows``) in the writing stage, after the
    rows are arranged, so that the sampling of the ranges is not counted."""
    out = clustered(df, by, order)
    if written is not None:
        out = out.observe(written, F.count(F.lit(1)).alias("rows"))
    out.write.mode("append").partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str, within: str) -> None:
    """Overwrite only the partitions that ``df`` has rows for.  ``df`` must not
    read the table any more (checkpoint it first).  Rows are dealt out by
    ranges of (by, within), so a large partition is written by many tasks."""
    df.repartitionByRange(by, within).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def create_tables(spark: SparkSession, base: str, database: str = "marketpulse") -> dict[str, str]:
    """Create the five tables in the session's catalog where absent, their
    files under ``base``; (name, path).  Raises if a table of that name is
    there with files elsewhere."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    made = {}
    for name, schema in schemas.TABLES.items():
        path = os.path.join(base, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
        part = schemas.PARTITIONED.get(name)
        empty = spark.createDataFrame([], schema).write.mode("ignore")  # the folder; stored files stay as they are
        (empty.partitionBy(part) if part else empty).parquet(path)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet "
                  + (f"PARTITIONED BY (`{part}`) " if part else "") + f"LOCATION '{path}'")
        told = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{name}`").where("col_name = 'Location'").first()["data_type"]
        if not told.rstrip("/").endswith(path.split(":")[-1].rstrip("/")):
            raise ValueError(f"{database}.{name} is stored at {told}, not at {path}")
        made[name] = path
    return made


def refresh_table(spark: SparkSession, name: str, database: str = "marketpulse") -> DataFrame:
    """The catalog's table after loads by path: new files and partitions are known."""
    table = f"`{database}`.`{name}`"
    if name in schemas.PARTITIONED:
        spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def read_merged(spark: SparkSession, path: str, columns: dict[str, T.DataType | str]) -> DataFrame:
    """S10 on stored files of different ages: one table whose columns are those
    of all files; a column that a file lacks is null in its rows, and those of
    ``columns`` are there even if no file has them."""
    return tables.ensure_columns(spark.read.option("mergeSchema", True).parquet(path), columns)

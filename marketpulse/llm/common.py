"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors see.

    Where the setting is absent a scratch folder is made, but only under a
    local master (tests); elsewhere a missing setting is an error, because
    executors do not see the driver's disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-ckpt-")
        sc.setCheckpointDir(named)
    return named


def saved(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of executors, and
    later steps read a table with known size and stable row order.  ``codec``
    is the file compression; None leaves it to the session.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, key: str, codec: str | None = None) -> DataFrame:
    """As :func:`saved`, dealt by ``key`` into the buckets of a table, one file
    a bucket.  Joins and aggregates on ``key`` read the buckets as they stand
    and move only the other side.  The table is named in the session's
    catalog; its files lie in the shared folder."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key) \
        .options(path=f"{shared_dir(spark).rstrip('/')}/{name}", **({"compression": codec} if codec else {})).saveAsTable(name)
    return spark.read.table(name)


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value's text, modulo n (null stays null)."""
    return F.crc32(col.cast("string").cast("binary")) % n


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``doc``, so that no name of its columns
    can clash with a helper column; ``select("doc.*")`` gives them back."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("doc"))

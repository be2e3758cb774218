"""News pipeline (C1, S11): articles -> keyed news table -> vector table.

Relational half: lenient scan (S1) -> content key (P1) -> rows later than
the table's latest publication (J3, global) -> upsert on id (J5).
Vector half: strict scan (S2) -> first row per title (W10) -> document text
(P2), epoch (P8) -> embedding (U3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse import schemas
from marketpulse.functions.scalars import content_key, document_text, to_epoch, ts_text
from marketpulse.operators import enrich
from marketpulse.operators import tables as tb
from marketpulse.sources import sinks
from marketpulse.sources.files import FILE_ORDER

NEWS_UPDATE_COLS = ["url", "keywords"]
#: The stored table is partitioned by this many leading hex digits of the id.
PREFIX, PREFIX_DIGITS = "id_prefix", 2
STORED = T.StructType([*schemas.NEWS.fields, T.StructField(PREFIX, T.StringType())])


def keyed_news(scanned: DataFrame, created_at=None, order: Sequence[str] | str | None = None) -> DataFrame:
    """P1 + P7: rows in the news table's shape, with ``_pos`` (input order: the
    columns ``order``, by default the files' own, or ``timestamp`` where the
    rows come from no file; ties by the row's values)."""
    if order is None:
        order = FILE_ORDER if set(FILE_ORDER) <= set(scanned.columns) else ["timestamp"]
    order = [order] if isinstance(order, str) else list(order)
    created = F.lit(created_at).cast("timestamp_ntz") if created_at is not None else \
        F.lit(None).cast("timestamp_ntz")
    return scanned.select(
        content_key("title", "body").alias("id"), "title", "body", "published_at", "url", "keywords",
        created.alias("created_at"), F.struct(F.struct(*order).alias("o"), "published_at", "url", "keywords").alias("_pos"))


def merge_news(target: DataFrame, batch: DataFrame, order: str = "_pos") -> DataFrame:
    """C1 relational half on prepared rows: the news table after the load.

    ``batch`` has the table's columns plus an order column.  Only rows later
    than the table's latest ``published_at`` take part (J3); then the upsert
    (J5) inserts new ids and refreshes url/keywords of existing ones.
    """
    fresh = tb.newer_than(batch, target, "published_at")
    return tb.upsert(target, fresh, "id", order, NEWS_UPDATE_COLS)


def vector_rows(news: DataFrame, encoder, tz: str = "UTC", order: Sequence[str] = FILE_ORDER) -> DataFrame:
    """C1 vector half: one vector record per distinct title, of its first row in ``order``."""
    return rebuild_vectors(tb.first_per_key(news, ["title"], order), encoder, tz)


def rebuild_vectors(news: DataFrame, encoder, tz: str = "UTC") -> DataFrame:
    """Re-key and re-embed every news row (no title dedup)."""
    return enrich.embed(vector_records(news, tz), "content", encoder)


def vector_records(news: DataFrame, tz: str = "UTC") -> DataFrame:
    """Vector records without their vectors."""
    return news.select(
        content_key("title", "body").alias("id"),
        document_text("title", "body").alias("content"),
        "title",
        ts_text("published_at").alias("published_time"),
        to_epoch("published_at", tz).alias("timestamp"))


def _with_prefix(news: DataFrame) -> DataFrame:
    """The partition of a news row: the first digits of its id, a hash."""
    return news.withColumn(PREFIX, F.substring("id", 1, PREFIX_DIGITS))


def run_news(table_path: str, scanned: DataFrame, created_at=None, order: Sequence[str] | str | None = None) -> int:
    """C1 relational half with the sink; A7: returns the number of new rows.

    New ids are appended, so a load of new articles rewrites no stored file.
    Only the partitions that hold an id of the batch already are read, merged
    and written again; which those are follows from the id column alone.
    Without new rows nothing is written.  Fresh and merged rows are
    checkpointed, so each is computed once and the table is not read while it
    is overwritten.

    The overwrite comes first: it changes no ``published_at``, so a load that
    is lost between the two writes finds the same new rows when it runs again.
    """
    spark = scanned.sparkSession
    target = sinks.read_table(spark, table_path, STORED)
    newer = _with_prefix(tb.newer_than(keyed_news(scanned, created_at, order), target, "published_at")).checkpoint()
    known = target.select("id").join(newer.select("id").distinct(), "id", "left_semi").withColumn("_known", F.lit(True))
    fresh = newer.join(known, "id", "left").withColumn("_known", F.coalesce("_known", F.lit(False))).checkpoint()
    # at most 2 * 16 ** PREFIX_DIGITS rows
    parts = fresh.groupBy(PREFIX, "_known").count().collect()
    touched = [r[PREFIX] for r in parts if r["_known"]]
    if touched:
        merged = tb.upsert(target.where(F.col(PREFIX).isin(touched)).drop(PREFIX),
                           fresh.where("_known").drop(PREFIX, "_known"), "id", "_pos", NEWS_UPDATE_COLS)
        sinks.replace_partitions(_with_prefix(merged).checkpoint(), table_path, PREFIX, "id")
    if len(touched) < len(parts):
        none = spark.createDataFrame([], schemas.NEWS)
        added = tb.upsert(none, fresh.where("NOT _known").drop(PREFIX, "_known"), "id", "_pos", NEWS_UPDATE_COLS)
        sinks.append_rows(_with_prefix(added), table_path, PREFIX, order="id")
    return sum(r["count"] for r in parts)


def compact_news(spark: SparkSession, table_path: str) -> None:
    """Write the stored news table again in few files a partition: many small
    loads append many small files.  The rows stay as they are; run it between loads."""
    stored = sinks.read_table(spark, table_path, STORED).checkpoint()
    sinks.replace_partitions(stored, table_path, PREFIX, "id")


def read_news_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored news table."""
    return sinks.read_table(spark, table_path, STORED).drop(PREFIX)


def run_vectors(table_path: str, news: DataFrame, encoder, tz: str = "UTC",
                order: Sequence[str] = FILE_ORDER) -> int:
    """C1 vector half with the sink: the first row of each title becomes a
    vector record, if its content key is not stored yet.  Only new records go
    through the model; they are appended, and stored ones stay as they are.
    Returns the number of new records."""
    stored = sinks.read_table(news.sparkSession, table_path, schemas.VECTORS)
    records = vector_records(tb.first_per_key(news, ["title"], order), tz)
    new = enrich.embed(records.join(stored.select("id"), "id", "left_anti"), "content", encoder)
    written = Observation()
    new.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(table_path)
    return written.get.get("rows", 0)

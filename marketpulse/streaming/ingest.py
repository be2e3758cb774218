"""Continuous ingest (T1): a file stream loaded into a stored table.

Each micro-batch runs the same load as the batch pipelines (``run_news``,
``run_prices``, ``run_indicators``): rows at or before the table's high-water
mark are dropped, so replaying a micro-batch after a failure finds no new rows
and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: A load: (table path, batch) -> number of new rows.
Load = Callable[[str, DataFrame], int]


def file_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    """A Parquet file stream of declared schema.  ``max_files`` bounds what one
    micro-batch reads, also the first over a large backlog."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The stream without repeats: of rows with equal ``keys`` the first to
    arrive, as long as they come within ``delay`` of event time ``ts``.  Rows
    that lie more than ``delay`` behind the latest time seen in earlier
    micro-batches are late and dropped.  The state (in RocksDB, see
    ``streaming.indicators.STATE_STORE``) holds the keys of that stretch only."""
    # a watermark needs an instant; the difference of two times is the same in any fixed zone
    timed = stream.withColumn("_event_time", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")


def load_into(table_path: str, load: Load) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: load each micro-batch into the table."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        load(table_path, batch)
    return run


def stream_ingest(stream: DataFrame, table_path: str, load: Load, checkpoint: str,
                  available_now: bool = True, keys: Sequence[str] = (), ts: str | None = None,
                  delay: str = "1 day") -> StreamingQuery:
    """Start the ingest stream; with ``keys`` and ``ts`` repeated and late
    rows are dropped before the load (:func:`deduplicated`).

    ``checkpoint`` is a folder on shared storage for the stream's offsets.
    With ``available_now`` the query processes what is there and stops.
    """
    if keys:
        if ts is None:
            raise ValueError("keys need the event time column ts")
        stream = deduplicated(stream, keys, ts, delay)
    w = stream.writeStream.foreachBatch(load_into(table_path, load)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

"""Price and indicator pipelines, listing ranking, first trade date
(C2, C3, C7, A5, F4, L4, P3, P4, P6).

The pipelines are pure functions (table, batch) -> rows to write, so they
can be checked without touching storage; ``run_*`` adds the sink.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.functions.scalars import (
    pair_symbol, quantize_half_up, volume_or_null,
)
from marketpulse.operators import indicator_state as ist
from marketpulse.operators import indicators as ind
from marketpulse.operators import quality as q
from marketpulse.operators import retrieval as rt
from marketpulse.operators import tables as tb
from marketpulse.sources import sinks


def _append_new(table_path: str, new: DataFrame) -> int:
    """Append ``new`` to the table; A7: return the number of rows, observed by
    the write itself.  J3 reads the stored symbols and times, nothing more."""
    written = Observation()
    sinks.append_rows(new, table_path, "symbol", written)
    return written.get.get("rows", 0)


def price_rows(prices: DataFrame) -> DataFrame:
    """P4 + P6: (symbol, price, volume, recorded_at) typed for the price table."""
    return prices.select(
        "symbol",
        quantize_half_up("Close").alias("price"),
        quantize_half_up(volume_or_null("Volume")).alias("volume"),
        F.col("Date").cast("timestamp_ntz").alias("recorded_at"))


def _first_bars(bars: DataFrame, order: Sequence[str]) -> DataFrame:
    """J4 inside a batch: of bars with one symbol and date the first in ``order``."""
    return tb.first_per_key(bars, ["symbol", "Date"], order)


def new_prices(target: DataFrame, batch: DataFrame, order: Sequence[str],
               closed_before: dt.datetime | None = None) -> DataFrame:
    """Price rows to append — later than the symbol's stored maximum, the
    first of equal (symbol, date) in ``order``, the batch's input order.

    ``closed_before``: bars from this time on are still open and left for a
    later load.  A key in the table cannot come again: J3 keeps later rows only.
    """
    if closed_before is not None:
        batch = batch.where(F.col("Date") < F.lit(closed_before))
    return tb.newer_than(price_rows(_first_bars(batch, order)), target, "recorded_at", by=["symbol"])


def indicator_rows(prices: DataFrame) -> DataFrame:
    """W12 + P5 in the indicator table's shape."""
    return _stored_shape(ind.indicators(prices))


def _stored_shape(out: DataFrame) -> DataFrame:
    out = out.withColumnRenamed("Date", "recorded_at").withColumn(
        "recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    return ind.quantize_indicators(out).select("symbol", "recorded_at", *ind.INDICATOR_COLUMNS)


def new_indicators(target: DataFrame, prices: DataFrame, order: Sequence[str],
                   closed_before: dt.datetime | None = None) -> DataFrame:
    """Indicators over the full history (equal dates: the first bar in
    ``order``), then only rows later than the stored maximum per symbol, so
    warm-up uses all history and no stored key comes again."""
    if closed_before is not None:
        prices = prices.where(F.col("Date") < F.lit(closed_before))
    return tb.newer_than(indicator_rows(_first_bars(prices, order)), target, "recorded_at", by=["symbol"])


def run_prices(table_path: str, batch: DataFrame, order: Sequence[str],
               closed_before: dt.datetime | None = None) -> int:
    """C2 with the sink: append new rows; returns their number."""
    target = sinks.read_table(batch.sparkSession, table_path, schemas.CRYPTO_PRICES)
    return _append_new(table_path, new_prices(target, batch, order, closed_before))


def state_path(table_path: str) -> str:
    """Where the indicator table's series states are stored, beside it."""
    return f"{table_path.rstrip('/')}_state"


def read_state(spark: SparkSession, table_path: str) -> DataFrame:
    """The latest stored state of every symbol."""
    return ist.latest_state(sinks.read_table(spark, state_path(table_path), ist.STATE))


def run_indicators(table_path: str, prices: DataFrame, order: Sequence[str],
                   closed_before: dt.datetime | None = None) -> int:
    """C3 with the sink; returns the number of rows written.

    The load goes on from the stored state of each symbol: bars up to the
    state's last are dropped after the scan, and only later ones are numbered
    and windowed.  A symbol without state needs its full history in ``prices``.
    Rows are appended first, then the states; after a crash in between, the
    next load computes those rows again from the older states and J3 keeps
    them out.  A late or revised bar does not change later values; to recompute,
    load the history into a new table.
    """
    spark = prices.sparkSession
    if closed_before is not None:
        prices = prices.where(F.col("Date") < F.lit(closed_before))
    rows = ist.resume(_first_bars(prices, order), read_state(spark, table_path)).checkpoint()
    target = sinks.read_table(spark, table_path, schemas.CRYPTO_INDICATORS)
    n = _append_new(table_path, tb.newer_than(_stored_shape(ist.new_rows(rows)), target, "recorded_at", by=["symbol"]))
    if not rows.where("NOT _old").isEmpty():
        ist.next_state(rows).write.mode("append").parquet(state_path(table_path))
    return n


def top_pairs(listings: DataFrame, n: int = 10, excluded: Sequence[str] = q.STABLECOINS,
              order: str = "pos", quote: str = "USDT", by: Sequence[str] = ()) -> DataFrame:
    """C7 (S6 -> F4 -> L4 -> P3): the first ``n`` listed coins outside the
    excluded set, in listing order, as trading pairs — of each response, if
    ``by`` names its key (top-k per key), else of the one listing (planned as
    TakeOrderedAndProject; each task keeps its best n)."""
    kept = q.exclude(listings, "symbol", excluded)
    if by:
        best = rt.top_k(kept, by, [F.col(order)], n)
        return best.select(*by, order, pair_symbol("symbol", quote).alias("pair"))
    return (kept.orderBy(order).limit(n)
                .select(order, pair_symbol("symbol", quote).alias("pair")))


def rank_by_cap(listings: DataFrame, n: int = 10, excluded: Sequence[str] = q.STABLECOINS,
                cap: str = "market_cap", quote: str = "USDT") -> DataFrame:
    """L4 when the listing is not pre-sorted: top ``n`` by market cap
    (ties by symbol) after the exclusion."""
    kept = q.exclude(listings, "symbol", excluded)
    return (kept.orderBy(F.col(cap).desc(), F.col("symbol")).limit(n)
                .select("symbol", cap, pair_symbol("symbol", quote).alias("pair")))


def first_trade(prices: DataFrame, symbols: DataFrame | None = None,
                now: dt.datetime | None = None) -> DataFrame:
    """A5: earliest bar per symbol; symbols without bars get ``now``."""
    first = prices.groupBy("symbol").agg(F.min("Date").alias("first_date"))
    if symbols is None:
        return first
    j = symbols.select("symbol").join(first, "symbol", "left")
    fallback = F.lit(now or dt.datetime.now()).cast(first.schema["first_date"].dataType)
    return j.withColumn("first_date", F.coalesce(F.col("first_date"), fallback))

"""Indicators that go on from a stored state.

The state of a series is what its next rows need: the number of bars, the last
bar's time, the three EMA values and the last 20 closes.  :func:`resume` numbers
only the new bars, puts the stored closes before them as rows and seeds the EMA
block scans with the stored values, so a load touches no older bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.operators.indicators import (
    BB_K, BB_N, INDICATOR_COLUMNS, MACD_FAST, MACD_SIGNAL, MACD_SLOW, RSI_N, gain_loss, rsi_from_means,
)
from marketpulse.operators.series import (
    BLK, DEFAULT_BLOCK_ROWS, DEFAULT_BUCKET_ROWS, HALO, IDX, _over, ema, ema_block, halo_blocks, index_series,
)

#: Closes that the longest window needs before a new bar.
KEEP = max(RSI_N + 1, BB_N)
STATE = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("n", T.LongType()),
    T.StructField("last_ts", T.TimestampNTZType()),
    T.StructField("e_fast", T.DoubleType()),
    T.StructField("e_slow", T.DoubleType()),
    T.StructField("e_sig", T.DoubleType()),
    T.StructField("closes", T.ArrayType(T.DoubleType())),
])
_FIELDS = [f.name for f in STATE.fields if f.name != "symbol"]


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def latest_state(states: DataFrame) -> DataFrame:
    """One row a symbol: the state after most bars, of all that loads have written."""
    last = states.groupBy("symbol").agg(F.max_by(F.struct(*_FIELDS), "n").alias("s"))
    return last.select("symbol", "s.*")


def resume(bars: DataFrame, state: DataFrame, block: int = DEFAULT_BLOCK_ROWS,
           bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Rows from which :func:`new_rows` and :func:`next_state` are read; write
    or checkpoint them once.

    ``bars`` (symbol, Date, Close): those later than their symbol's state are
    taken, others dropped; null closes are left out.  A symbol without state
    starts a series.  The result has one row a new bar and up to ``KEEP`` rows
    a symbol of the state (``_old``): (symbol, Date, _k, _i, _x, _ef, _es, _old,
    indicators); ``_k`` counts from the last stored bar, ``_i`` from the first.
    """
    block = ema_block([MACD_FAST, MACD_SLOW, MACD_SIGNAL], block)
    known = state.select("symbol", F.col("n").alias("_n"), "last_ts")
    new = bars.select("symbol", F.col("Date").cast("timestamp_ntz").alias("Date"), F.col("Close").cast("double").alias("_x")) \
        .where("_x IS NOT NULL").join(known, "symbol", "left") \
        .where("last_ts IS NULL OR Date > last_ts").selectExpr("symbol", "Date", "_x", "coalesce(_n, 0) AS _n")
    numbered = index_series(new, ["symbol"], "Date", bucket_rows, tie=["_x"])
    fresh = numbered.selectExpr("symbol", "Date", f"CASE WHEN _n > 0 THEN {IDX} + 1 ELSE {IDX} END AS _k", f"_n + {IDX} AS _i", "_x",
                                "_x AS _xf", "_x AS _xs", "CAST(NULL AS DOUBLE) AS _xg", "false AS _old")
    old = state.where("n > 0").selectExpr("symbol", "n", "last_ts", "e_fast", "e_slow", "e_sig", "size(closes) AS m", "posexplode(closes) AS (p, _x)")
    old = old.selectExpr("symbol", "last_ts AS Date", "CAST(p - m + 1 AS BIGINT) AS _k", "n - m + p AS _i", "_x",
                         *[f"CASE WHEN p = m - 1 THEN {e} ELSE 0.0D END AS {x}" for e, x in (("e_fast", "_xf"), ("e_slow", "_xs"), ("e_sig", "_xg"))],
                         "true AS _old")
    # row 0 is the stored bar, or the first of a new series: either seeds the
    # recursions.  Numbered once: the block scans read the rows several times.
    rows = old.unionByName(fresh).checkpoint()
    rows = ema(rows, ["symbol"], "_k", {"_ef": ("_xf", MACD_FAST), "_es": ("_xs", MACD_SLOW)}, block=block)
    rows = rows.selectExpr("*", "_ef - _es AS macd", "CASE WHEN _old THEN _xg ELSE _ef - _es END AS _m")
    rows = ema(rows, ["symbol"], "_k", {"macd_signal": ("_m", MACD_SIGNAL)}, block=block)
    rows = halo_blocks(rows, "_k", block, KEEP - 1)

    def over(n: int | None = None) -> str:
        return _over(["symbol", BLK], "_k", None if n is None else f"{n - 1} PRECEDING AND CURRENT ROW")

    rows = rows.selectExpr("*", f"_x - lag(_x) {over()} AS _d")
    gain, loss = gain_loss(F.col("_d"))
    rows = rows.select("*", gain.alias("_gain"), loss.alias("_loss")).selectExpr(
        "*", f"avg(_gain) {over(RSI_N)} AS _mg", f"avg(_loss) {over(RSI_N)} AS _ml",
        f"avg(_x) {over(BB_N)} AS _mid", f"stddev_samp(_x) {over(BB_N)} AS _sd")
    ready = F.col("_i") >= BB_N - 1
    return rows.where(f"NOT {HALO}").select(
        "symbol", "Date", "_k", "_i", "_x", "_ef", "_es", "_old",
        F.when(F.col("_i") >= RSI_N - 1, rsi_from_means(F.col("_mg"), F.col("_ml"))).alias("rsi_14"), "macd", "macd_signal",
        F.when(ready, F.col("_mid") + F.lit(BB_K) * F.col("_sd")).alias("bb_upper"), F.when(ready, F.col("_mid")).alias("bb_middle"),
        F.when(ready, F.col("_mid") - F.lit(BB_K) * F.col("_sd")).alias("bb_lower"))


def new_rows(rows: DataFrame) -> DataFrame:
    """(symbol, Date, indicators) of the new bars."""
    return rows.where("NOT _old").select("symbol", "Date", *INDICATOR_COLUMNS)


def next_state(rows: DataFrame) -> DataFrame:
    """The state after the new bars, of the symbols that have any."""
    last = rows.where("NOT _old").groupBy("symbol").agg(
        F.max("_k").alias("_mk"), (F.max("_i") + 1).alias("n"),
        F.max_by(F.struct(F.col("Date").alias("last_ts"), F.col("_ef").alias("e_fast"), F.col("_es").alias("e_slow"), F.col("macd_signal").alias("e_sig")), "_k").alias("s"))
    tail = rows.select("symbol", "_k", "_x").join(last.select("symbol", "_mk"), "symbol").where(F.col("_k") > F.col("_mk") - KEEP)
    closes = tail.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_k", "_x"))).alias("c")) \
        .select("symbol", F.expr("transform(c, e -> e._x)").alias("closes"))
    return last.select("symbol", "n", "s.*").join(closes, "symbol").select("symbol", *_FIELDS)

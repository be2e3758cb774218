"""Technical indicators over many price series at once.

All series are computed in one plan.  Rows are shuffled twice at most: once
to number them inside their series (``index_series``) and once into
(symbol, block) partitions with a halo of earlier rows, which every window
below shares.  MACD and its signal come from one block scan
(``macd_scan``): its block table is an aggregate of the input rows, so the
window pass over the rows runs once; the carries touch one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.operators.series import (
    BLK, DEFAULT_BLOCK_ROWS, DEFAULT_BUCKET_ROWS, HALO, IDX,
    _d, _over, _q, ema, ema_block, ema_gaps, halo_blocks, index_series, macd_scan,
)

# Indicator parameters and output order of the indicator table.
RSI_N = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BB_N, BB_K = 20, 2.0
INDICATOR_COLUMNS = ["rsi_14", "macd", "macd_signal", "bb_upper", "bb_middle", "bb_lower"]


def diff(c: str | Column, w: Window) -> Column:
    """Value minus the previous value in the window order (null first)."""
    c = F.col(c) if isinstance(c, str) else c
    return c - F.lag(c).over(w)


def gain_loss(delta: Column) -> tuple[Column, Column]:
    """Positive and negative parts of a delta; a null delta gives 0."""
    return (F.when(delta > 0, delta).otherwise(F.lit(0.0)),
            F.when(delta < 0, -delta).otherwise(F.lit(0.0)))


def rsi_from_means(mean_gain: Column, mean_loss: Column) -> Column:
    """W4 formula: 100 - 100/(1 + g/l); l = 0 -> 100 if g > 0, null if g = 0."""
    return (F.when(mean_loss == 0, F.when(mean_gain > 0, F.lit(100.0)))
             .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + mean_gain / mean_loss)))


#: What a null close does: its row is left out, or stays and carries values on.
DROP, CARRY = "drop", "carry"


def _indexed(prices: DataFrame, by: str, ts: str, close: str, bucket_rows: int, nulls: str = DROP) -> DataFrame:
    if nulls not in (DROP, CARRY):
        raise ValueError(f"nulls must be {DROP!r} or {CARRY!r}, not {nulls!r}")
    base = prices.selectExpr(_q(by), _q(ts), f"CAST({_q(close)} AS DOUBLE) AS _x")
    return index_series(base.where("_x IS NOT NULL") if nulls == DROP else base, [by], ts, bucket_rows, tie=["_x"])


def _prepare(prices: DataFrame, by: str, ts: str, close: str, bucket_rows: int,
             block: int, halo: int, nulls: str = DROP) -> DataFrame:
    return halo_blocks(_indexed(prices, by, ts, close, bucket_rows, nulls), IDX, block, halo)


def _carried_macd(rows: DataFrame, by: str, fast: int, slow: int, signal: int, block: int) -> DataFrame:
    """``rows`` (by, IDX, _x nullable) with macd and macd_signal: the EMAs carry
    over null rows, the signal runs over every row from the first close on."""
    rows = ema_gaps(rows, [by], IDX, "_x", {"_ef": fast, "_es": slow}, block=block, first="_i0")
    rows = rows.selectExpr("*", "_ef - _es AS macd", "coalesce(_ef - _es, 0.0D) AS _m", f"{IDX} - coalesce(_i0, 0) AS _k").drop("_ef", "_es", "_i0")
    rows = ema(rows, [by], "_k", {"_sig": ("_m", signal)}, block=block)
    return rows.selectExpr("*", "CASE WHEN macd IS NOT NULL THEN _sig END AS macd_signal").drop("_sig", "_m", "_k")


def indicators(prices: DataFrame, by: str = "symbol", ts: str = "Date", close: str = "Close",
               rsi_n: int = RSI_N, fast: int = MACD_FAST, slow: int = MACD_SLOW,
               signal: int = MACD_SIGNAL, bb_n: int = BB_N, bb_k: float = BB_K,
               block: int = DEFAULT_BLOCK_ROWS,
               bucket_rows: int = DEFAULT_BUCKET_ROWS, nulls: str = DROP) -> DataFrame:
    """RSI, MACD, MACD signal and Bollinger bands per (symbol, date).

    Semantics per series ordered by ``ts`` (i = 0-based row index):
    RSI = simple-mean form over ``rsi_n`` deltas, defined from i = rsi_n-1;
    MACD = EMA(fast) - EMA(slow), signal = EMA(signal) of MACD, both defined
    from i = 0; bands = mean ± k·sample sd over ``bb_n`` rows, from i = bb_n-1.
    Warm-up rows are kept with nulls.  With ``nulls="drop"`` rows with a null
    close are left out before the windows.  With ``nulls="carry"`` they stay and
    count as rows: a delta with a null side is neither gain nor loss, bands are
    null while a null is in their window, and the averages keep their last value
    at a null row while the weight of that value keeps decaying by position
    (rows before the first close have no MACD).  Dates should be unique in
    a series (Q2; the loads take the first bar of a date); rows of equal date
    are ordered by close, so the result does not depend on the partitioning.  The expressions are the
    Column helpers above (diff, gain_loss, rsi_from_means), written as SQL
    text so the plan is built in a few calls.
    """
    block = ema_block([fast, slow, signal], block)
    halo = max(rsi_n, bb_n - 1)
    rows = _prepare(prices, by, ts, close, bucket_rows, block, halo, nulls)

    own = rows.where(f"NOT {HALO}").select(by, ts, IDX, BLK, "_x")

    def over(frame=None):
        return _over([by, BLK], IDX, frame)

    rows = rows.selectExpr("*", f"_x - lag(_x) {over()} AS _d")         # W1
    gain = "CASE WHEN _d > 0 THEN _d ELSE 0.0D END"                     # W2 (null -> 0)
    loss = "CASE WHEN _d < 0 THEN -_d ELSE 0.0D END"
    w_rsi = over(f"{rsi_n - 1} PRECEDING AND CURRENT ROW")
    w_bb = over(f"{bb_n - 1} PRECEDING AND CURRENT ROW")
    g, l = f"avg({gain}) {w_rsi}", f"avg({loss}) {w_rsi}"                # W3
    rsi = (f"CASE WHEN {IDX} >= {rsi_n - 1} THEN (CASE WHEN {l} = 0 THEN "   # W4
           f"(CASE WHEN {g} > 0 THEN 100.0D END) ELSE 100.0D - 100.0D / (1.0D + {g} / {l}) END) END")
    ready = f"{IDX} >= {bb_n - 1}" if nulls == DROP else f"count(_x) {w_bb} = {bb_n}"
    rows = (rows.selectExpr(
        _q(by), _q(ts), IDX, BLK, HALO, "_x", f"{rsi} AS rsi_14",
        f"CASE WHEN {ready} THEN avg(_x) {w_bb} END AS bb_middle",        # W8
        f"CASE WHEN {ready} THEN stddev_samp(_x) {w_bb} END AS _sd")
        .where(f"NOT {HALO}").drop(HALO))

    if nulls == CARRY:
        rows = _carried_macd(rows.drop(BLK), by, fast, slow, signal, block)
    else:
        rows = macd_scan(rows, [by], IDX, "_x", fast, slow, signal, block=block, blk_col=BLK,
                         blocks_from=own)                                # W5-W7
    k = _d(bb_k)
    return rows.selectExpr(                                              # W9
        _q(by), _q(ts), "rsi_14", "macd", "macd_signal",
        f"bb_middle + {k} * _sd AS bb_upper", "bb_middle", f"bb_middle - {k} * _sd AS bb_lower")


def rsi(prices: DataFrame, by: str = "symbol", ts: str = "Date", close: str = "Close",
        n: int = RSI_N, block: int = DEFAULT_BLOCK_ROWS,
        bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W1–W4 alone: (by, ts, delta, gain, loss, avg_gain, avg_loss, rsi)."""
    rows = _prepare(prices, by, ts, close, bucket_rows, block, n)
    w = Window.partitionBy(by, BLK).orderBy(IDX)
    rows = rows.withColumn("delta", diff("_x", w))
    gain, loss = gain_loss(F.col("delta"))
    rows = rows.withColumn("gain", gain).withColumn("loss", loss)
    wn = w.rowsBetween(-(n - 1), 0)
    ready = F.col(IDX) >= n - 1
    rows = (rows.withColumn("avg_gain", F.when(ready, F.avg("gain").over(wn)))
                .withColumn("avg_loss", F.when(ready, F.avg("loss").over(wn))))
    return (rows.where(~F.col(HALO))
                .select(by, ts, "delta", "gain", "loss", "avg_gain", "avg_loss",
                        rsi_from_means(F.col("avg_gain"), F.col("avg_loss")).alias("rsi")))


def bollinger(prices: DataFrame, by: str = "symbol", ts: str = "Date", close: str = "Close",
              n: int = BB_N, k: float = BB_K, block: int = DEFAULT_BLOCK_ROWS,
              bucket_rows: int = DEFAULT_BUCKET_ROWS, nulls: str = DROP) -> DataFrame:
    """Rolling mean and sample sd over ``n`` rows, bands at ±k sd; with
    ``nulls="carry"`` null where a close in the window is null."""
    rows = _prepare(prices, by, ts, close, bucket_rows, block, n - 1, nulls)
    wn = Window.partitionBy(by, BLK).orderBy(IDX).rowsBetween(-(n - 1), 0)
    ready = F.count("_x").over(wn) == n
    rows = rows.select(by, ts, HALO, F.when(ready, F.avg("_x").over(wn)).alias("mean"),
                       F.when(ready, F.stddev_samp("_x").over(wn)).alias("sd"))
    return (rows.where(~F.col(HALO))
                .select(by, ts, "mean", "sd",
                        (F.col("mean") + F.lit(k) * F.col("sd")).alias("upper"),
                        (F.col("mean") - F.lit(k) * F.col("sd")).alias("lower")))


def ema_series(prices: DataFrame, spans: dict[str, int], by: str = "symbol", ts: str = "Date",
               col: str = "Close", block: int = DEFAULT_BLOCK_ROWS,
               bucket_rows: int = DEFAULT_BUCKET_ROWS, nulls: str = DROP) -> DataFrame:
    """One EMA column per entry of ``spans`` (name -> span)."""
    rows = _indexed(prices, by, ts, col, bucket_rows, nulls)
    if nulls == CARRY:
        return ema_gaps(rows, [by], IDX, "_x", spans, block=block).select(by, ts, *spans.keys())
    rows = ema(rows, [by], IDX, {n: ("_x", s) for n, s in spans.items()}, block=block)
    return rows.select(by, ts, *spans.keys())


def macd(prices: DataFrame, by: str = "symbol", ts: str = "Date", close: str = "Close",
         fast: int = MACD_FAST, slow: int = MACD_SLOW, signal: int = MACD_SIGNAL,
         block: int = DEFAULT_BLOCK_ROWS, bucket_rows: int = DEFAULT_BUCKET_ROWS, nulls: str = DROP) -> DataFrame:
    """MACD line, signal line and their difference (histogram)."""
    rows = _indexed(prices, by, ts, close, bucket_rows, nulls)
    if nulls == CARRY:
        rows = _carried_macd(rows, by, fast, slow, signal, block).withColumnRenamed("macd_signal", "signal")
    else:
        rows = macd_scan(rows, [by], IDX, "_x", fast, slow, signal, block=block, out=("macd", "signal"))
    return rows.select(by, ts, "macd", "signal", (F.col("macd") - F.col("signal")).alias("hist"))


def quantize_indicators(df: DataFrame) -> DataFrame:
    """P5 at the sink: RSI to 4 places, the rest to 8, half-even, as decimals."""
    def q(c):
        if c not in INDICATOR_COLUMNS:
            return _q(c)
        places, prec = (4, 10) if c == "rsi_14" else (8, 20)
        return f"CAST(bround({_q(c)}, {places}) AS DECIMAL({prec},{places})) AS {_q(c)}"
    return df.selectExpr(*[q(c) for c in df.columns])

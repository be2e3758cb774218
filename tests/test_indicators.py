"""Indicator edge cases (FIXTURES part C) and block-size properties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from marketpulse.operators import indicators as ind


def _series(spark, closes, symbol="S", start=dt.datetime(2024, 1, 1)):
    rows = [(symbol, start + dt.timedelta(days=i), None if c is None else float(c))
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, Date timestamp_ntz, Close double")


def _pandas(closes):
    c = pd.Series(closes, dtype=float)
    d = c.diff()
    g = d.where(d > 0, 0).rolling(14).mean()
    l = (-d.where(d < 0, 0)).rolling(14).mean()
    e12 = c.ewm(span=12, adjust=False).mean()
    e26 = c.ewm(span=26, adjust=False).mean()
    macd = e12 - e26
    m, sd = c.rolling(20).mean(), c.rolling(20).std()
    return pd.DataFrame({"rsi_14": 100 - 100 / (1 + g / l), "macd": macd,
                         "macd_signal": macd.ewm(span=9, adjust=False).mean(),
                         "bb_upper": m + 2 * sd, "bb_middle": m, "bb_lower": m - 2 * sd})


def _run(spark, closes, **kw):
    out = ind.indicators(_series(spark, closes), **kw).orderBy("Date").toPandas()
    return out.reset_index(drop=True)


def test_constant_series(spark):
    out = _run(spark, [5.0] * 20)
    assert out["rsi_14"].isna().all()
    assert out["macd"].abs().max() < 1e-9
    stored = ind.quantize_indicators(ind.indicators(_series(spark, [5.0] * 20))).collect()
    assert all(r.macd == 0 and r.macd_signal == 0 for r in stored)
    assert out.loc[19, "bb_middle"] == 5.0 and out.loc[19, "bb_upper"] == 5.0
    assert out.loc[:18, "bb_middle"].isna().all()


def test_rising_series(spark):
    out = _run(spark, list(range(1, 21)))
    assert out.loc[:12, "rsi_14"].isna().all()
    assert (out.loc[13:, "rsi_14"] == 100.0).all()


@pytest.mark.parametrize("n", [1, 13, 14, 19, 20])
def test_warm_up(spark, n):
    closes = list(np.random.default_rng(n).normal(100, 5, n))
    out = _run(spark, closes)
    assert len(out) == n
    assert out["rsi_14"].notna().sum() == max(0, n - 13)
    assert out["bb_middle"].notna().sum() == max(0, n - 19)
    assert out["macd"].notna().all()


@pytest.mark.parametrize("block", [8, 27, 256, 1024])
def test_long_series_any_block(spark, block):
    closes = list(np.random.default_rng(7).normal(100, 10, 700))
    out = _run(spark, closes, block=block, bucket_rows=60)
    ref = _pandas(closes)
    for c in ind.INDICATOR_COLUMNS:
        a, b = out[c].astype(float), ref[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        assert np.nanmax(np.abs(a - b)) < 1e-7, c


def test_many_series_at_once(spark):
    rows = []
    rng = np.random.default_rng(3)
    series = {s: list(rng.normal(50, 3, 60)) for s in ["A", "B", "C"]}
    df = None
    for s, closes in series.items():
        part = _series(spark, closes, s)
        df = part if df is None else df.unionByName(part)
    out = ind.indicators(df, block=16).toPandas()
    for s, closes in series.items():
        got = out[out.symbol == s].sort_values("Date").reset_index(drop=True)
        ref = _pandas(closes)
        assert np.nanmax(np.abs(got["macd_signal"] - ref["macd_signal"])) < 1e-9


def test_null_close_is_left_out(spark):
    closes = [1.0, 2.0, None, 3.0]
    out = _run(spark, closes)
    assert len(out) == 3


def test_quantize_indicators(spark):
    df = spark.createDataFrame([(1.23456789012, 2.000000005)], "rsi_14 double, macd double")
    row = ind.quantize_indicators(df).first()
    assert str(row.rsi_14) == "1.2346" and str(row.macd) == "2.00000000"


def test_macd_scan_many_blocks_and_carry_chunks(spark):
    from marketpulse.operators.series import IDX, index_series, macd_scan
    closes = list(np.random.default_rng(11).normal(50, 4, 500))
    rows = index_series(_series(spark, closes).withColumnRenamed("Close", "x"), ["symbol"], "Date",
                        bucket_rows=60)
    out = (macd_scan(rows, ["symbol"], IDX, "x", 12, 26, 9, block=8, carry_chunk=5)
           .orderBy("Date").toPandas())
    ref = _pandas(closes)
    assert np.abs(out["macd"] - ref["macd"]).max() < 1e-8
    assert np.abs(out["macd_signal"] - ref["macd_signal"]).max() < 1e-8


def test_numbering_does_not_depend_on_session_zone(spark):
    """20-minute bars across a DST change, buckets of 3 rows: the row index (and
    so every indicator) is the same whatever the session time zone."""
    from marketpulse.operators.series import IDX, index_series
    start = dt.datetime(2024, 3, 10, 0, 0)          # US spring-forward night
    rows = [("S", start + dt.timedelta(minutes=20 * i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, Date timestamp_ntz, Close double")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = {}
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = index_series(df, ["symbol"], "Date", bucket_rows=3).orderBy("Date").collect()
            out[tz] = [r[IDX] for r in got]
        assert out["UTC"] == out["America/New_York"] == list(range(30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_buckets_are_bounded_by_rows_not_by_time(spark):
    """One symbol with nine tenths of its rows in one day: buckets stay small,
    the numbering is exact, and rows of equal time keep their tie order."""
    from marketpulse.operators.series import IDX, index_series, with_buckets
    day = dt.datetime(2024, 5, 5)
    times = [day + dt.timedelta(seconds=30 * k) for k in range(1800)] + [dt.datetime(2020, 1, 1) + dt.timedelta(days=7 * k) for k in range(200)]
    rows = [("HOT", t, float(k)) for k, t in enumerate(times)] + [("COLD", day, 1.0), ("COLD", day, 0.0)]
    df = spark.createDataFrame(rows[::-1], "symbol string, Date timestamp_ntz, x double")
    sizes = with_buckets(df, ["symbol"], "Date", 50).groupBy("symbol", "_tb").count().where("symbol = 'HOT'").collect()
    assert len(sizes) >= 30 and max(r["count"] for r in sizes) <= 100
    got = {(r.symbol, r.x): r[IDX] for r in index_series(df, ["symbol"], "Date", 50, tie=["x"]).collect()}
    order = sorted(range(2000), key=lambda k: times[k])
    assert got == {**{("HOT", float(k)): i for i, k in enumerate(order)}, ("COLD", 0.0): 0, ("COLD", 1.0): 1}


@pytest.mark.parametrize("cuts,bucket_rows", [(128, 3), (4, 2), (2, 1)])
def test_series_longer_than_one_pass_of_cuts(spark, cuts, bucket_rows):
    """A series of more than ``cuts * bucket_rows`` rows is cut again until its
    buckets are small; crowded and sparse stretches alike, a short series and
    rows without a time beside it."""
    from marketpulse.operators.series import IDX, index_series, with_buckets
    day = dt.datetime(2024, 5, 5)
    n = 1200 if cuts == 128 else 160
    times = [day + dt.timedelta(seconds=k) for k in range(n * 3 // 4)] + [day - dt.timedelta(days=k) for k in range(1, n // 4 + 1)]
    rows = [("HOT", t, float(k)) for k, t in enumerate(times)] + [("COLD", day, 0.0), ("NONE", None, 0.0)]
    df = spark.createDataFrame(rows[::-1], "symbol string, Date timestamp_ntz, x double")
    assert n > cuts * bucket_rows
    cut = with_buckets(df, ["symbol"], "Date", bucket_rows, cuts).collect()
    sizes = {}
    for r in cut:
        sizes[r.symbol, r._tb] = sizes.get((r.symbol, r._tb), 0) + 1
    assert len(cut) == n + 2 and max(sizes.values()) <= 3 * bucket_rows
    hot = [r._tb for r in sorted((r for r in cut if r.symbol == "HOT"), key=lambda r: r.Date)]
    assert hot == sorted(hot)
    if cuts == 128:
        got = {(r.symbol, r.x): r[IDX] for r in index_series(df, ["symbol"], "Date", bucket_rows, tie=["x"]).collect()}
        order = sorted(range(n), key=lambda k: times[k])
        assert got == {**{("HOT", float(k)): i for i, k in enumerate(order)}, ("COLD", 0.0): 0, ("NONE", 0.0): 0}


def test_empty_series_table_has_no_buckets(spark):
    from marketpulse.operators.series import index_series
    df = spark.createDataFrame([], "symbol string, Date timestamp_ntz, x double")
    assert index_series(df, ["symbol"], "Date").collect() == []


def _gaps(seed, n=900):
    """Closes with single nulls, a run over several blocks and leading nulls."""
    rng = np.random.default_rng(seed)
    closes = list(rng.normal(100, 10, n))
    for k in rng.choice(n, n // 40, replace=False):
        closes[k] = None
    closes[:5] = [None] * 5
    closes[300:420] = [None] * 120
    closes[600:640:2] = [None] * 20
    return closes


@pytest.mark.parametrize("block", [1, 27, 1024])
def test_null_closes_are_carried_any_block(spark, block):
    closes = _gaps(block)
    out = _run(spark, closes, block=block, bucket_rows=60, nulls=ind.CARRY)
    ref = _pandas([np.nan if c is None else c for c in closes])
    assert len(out) == len(closes)
    for c in ind.INDICATOR_COLUMNS:
        a, b = out[c].astype(float), ref[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        assert np.nanmax(np.abs(a - b)) < 1e-7, c


def test_carried_averages_at_the_ends(spark):
    assert _run(spark, [None, None], nulls=ind.CARRY)["macd"].isna().all()
    one = _run(spark, [None, 5.0, None, None], nulls=ind.CARRY)
    assert one["macd"].isna().tolist() == [True, False, False, False] and (one["macd_signal"].dropna() == 0).all()
    with pytest.raises(ValueError, match="nulls"):
        ind.indicators(_series(spark, [1.0]), nulls="zero")


def test_carry_without_nulls_equals_drop(spark):
    closes = list(np.random.default_rng(5).normal(100, 10, 300))
    a, b = (_run(spark, closes, block=16, nulls=n) for n in (ind.CARRY, ind.DROP))
    for c in ind.INDICATOR_COLUMNS:
        assert np.nanmax(np.abs(a[c].astype(float) - b[c].astype(float))) < 1e-8


def test_a_gap_longer_than_the_frame(spark):
    """300 null rows in blocks of 1: far more blocks than a frame needs to hold."""
    from marketpulse.operators.series import IDX, ema_gaps, index_series
    closes = [10.0, 20.0] + [None] * 300 + [30.0, None, 40.0]
    rows = index_series(_series(spark, closes).withColumnRenamed("Close", "x"), ["symbol"], "Date", bucket_rows=10)
    out = ema_gaps(rows, ["symbol"], IDX, "x", {"e": 3}, block=1, carry_chunk=7).orderBy("Date").toPandas()["e"].astype(float)
    ref = pd.Series([np.nan if c is None else c for c in closes]).ewm(span=3, adjust=False).mean()
    assert np.abs(out - ref).max() < 1e-9

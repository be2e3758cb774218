"""Keyed-table operators and pipeline properties (run twice = run once)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.operators import tables as tb
from marketpulse.plans import market, news as newsplan
from marketpulse.sources import sinks
from marketpulse.sources.adapters import prices_v
from tests.conftest import SMALL

T = dt.datetime(2024, 1, 10)


def test_newer_than_keeps_only_later_rows(spark):
    target = spark.createDataFrame([("A", T)], "symbol string, ts timestamp_ntz")
    batch = spark.createDataFrame([("A", T - dt.timedelta(days=1)), ("A", T), ("A", T + dt.timedelta(days=1)),
                                   ("B", T - dt.timedelta(days=5)), ("A", None)],
                                  "symbol string, ts timestamp_ntz")
    per_key = {tuple(r) for r in tb.newer_than(batch, target, "ts", by=["symbol"]).collect()}
    assert per_key == {("A", T + dt.timedelta(days=1)), ("B", T - dt.timedelta(days=5))}
    glob = {tuple(r) for r in tb.newer_than(batch, target, "ts").collect()}
    assert glob == {("A", T + dt.timedelta(days=1))}
    empty = target.where(F.lit(False))
    assert tb.newer_than(batch, empty, "ts").count() == 5


def test_upsert_first_and_last_rules(spark):
    cols = "id string, title string, published_at timestamp_ntz, url string, pos long"
    target = spark.createDataFrame([("x", "old", T, "u0", 0)], cols).drop("pos")
    batch = spark.createDataFrame([
        ("y", "t1", T, "u1", 1), ("y", "t2", T + dt.timedelta(days=1), "u2", 2),
        ("x", "new", T + dt.timedelta(days=3), "u3", 3)], cols)
    out = {r.id: r for r in tb.upsert(target, batch, "id", "pos", ["url"]).collect()}
    assert out["y"].title == "t1" and out["y"].published_at == T and out["y"].url == "u2"
    assert out["x"].title == "old" and out["x"].published_at == T and out["x"].url == "u3"


def test_insert_absent_existing_key_wins(spark):
    cols = "symbol string, recorded_at timestamp_ntz, v double"
    target = spark.createDataFrame([("A", T, 1.0)], cols)
    batch = spark.createDataFrame([("A", T, 2.0), ("A", T + dt.timedelta(days=1), 3.0),
                                   ("A", T + dt.timedelta(days=1), 4.0)], cols)
    new = tb.insert_absent(target, batch, ["symbol", "recorded_at"], ["v"]).collect()
    assert [(r.recorded_at, r.v) for r in new] == [(T + dt.timedelta(days=1), 3.0)]


def test_delete_cascade_and_keyed_update(spark):
    s = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, title string")
    m = spark.createDataFrame([("m1", "a"), ("m2", "b"), ("m3", None)], "id string, session_id string")
    ids = spark.createDataFrame([("a",)], "id string")
    s2, m2 = tb.delete_cascade(s, m, ids, "id", "session_id")
    assert {r.id for r in s2.collect()} == {"b"}
    assert {r.id for r in m2.collect()} == {"m2", "m3"}
    ch = spark.createDataFrame([("b", "new", 2), ("b", "old", 1), ("zz", "ignored", 1)], "id string, new_value string, n int")
    assert sorted(map(tuple, tb.keyed_update(s, ch, "id", "title", "n").collect())) == [("a", "t"), ("b", "new")]


def test_price_and_indicator_pipelines_run_twice_equal_once(spark, tmp_dir):
    p = prices_v(spark, SMALL)
    path = f"{tmp_dir}/crypto_prices"
    first = market.run_prices(path, p, ["Close"])
    assert first == p.count()
    assert market.run_prices(path, p, ["Close"]) == 0
    ipath = f"{tmp_dir}/crypto_indicators"
    n1 = market.run_indicators(ipath, p, ["Close"])
    assert n1 == p.count() and market.run_indicators(ipath, p, ["Close"]) == 0
    table = sinks.read_table(spark, ipath, schemas.CRYPTO_INDICATORS)
    assert table.count() == n1
    assert "symbol" in table.columns


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, Date timestamp_ntz, Close double, Volume double, seq int")


def test_first_of_equal_bars_whatever_the_partitions(spark):
    rows = [("A", T, float(k), 1.0, k) for k in range(1, 41)]
    target = spark.createDataFrame([], schemas.CRYPTO_PRICES)
    for n in (1, 4, 7):
        got = market.new_prices(target, _bars(spark, rows[::-1]).repartition(n), ["seq"]).collect()
        assert [float(r.price) for r in got] == [1.0]


def test_open_candles_wait(spark, tmp_dir):
    bars = _bars(spark, [("A", T + dt.timedelta(days=d), 1.0 + d, 1.0, 0) for d in range(3)])
    path = f"{tmp_dir}/p"
    assert market.run_prices(path, bars, ["seq"], closed_before=T + dt.timedelta(days=2)) == 2
    assert market.run_prices(path, bars, ["seq"]) == 1


def test_two_writers_keep_all_rows(spark, tmp_dir):
    """B is committed while C's load is planned on the table of A: all stay."""
    path = f"{tmp_dir}/w"

    def bar(symbol):
        return _bars(spark, [(symbol, T, 1.0, 1.0, 0)])

    market.run_prices(path, bar("A"), ["seq"])
    slow = market.new_prices(sinks.read_table(spark, path, schemas.CRYPTO_PRICES), bar("C"), ["seq"])
    market.run_prices(path, bar("B"), ["seq"])
    sinks.append_rows(slow, path)
    assert sorted(r.symbol for r in sinks.read_table(spark, path, schemas.CRYPTO_PRICES).collect()) == ["A", "B", "C"]


def _files(path):
    import os
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_news_load_writes_only_touched_partitions(spark, tmp_dir):
    cols = "title string, body string, published_at timestamp_ntz, url string, keywords string, timestamp long"
    first = [(f"t{k}", "b", T, f"u{k}", "k", k) for k in range(40)]
    path = f"{tmp_dir}/news"
    assert newsplan.run_news(path, spark.createDataFrame(first, cols)) == 40
    before = _files(path)
    assert newsplan.run_news(path, spark.createDataFrame(first, cols)) == 0 and _files(path) == before
    later = [("t0", "b", T + dt.timedelta(days=1), "new", "k2", 1), ("t0", "b", T + dt.timedelta(days=1), "newer", "k3", 2)]
    assert newsplan.run_news(path, spark.createDataFrame(later[::-1], cols)) == 2
    assert len(set(before) - set(_files(path))) <= 1  # one partition was written again
    got = {r.title: r for r in newsplan.read_news_table(spark, path).collect()}
    assert len(got) == 40 and got["t0"].url == "newer" and got["t0"].published_at == T and got["t1"].url == "u1"


def test_news_load_appends_new_ids_and_survives_a_loss_between_the_writes(spark, tmp_dir, monkeypatch):
    cols = "title string, body string, published_at timestamp_ntz, url string, keywords string, timestamp long"
    path = f"{tmp_dir}/news"
    newsplan.run_news(path, spark.createDataFrame([(f"t{k}", "b", T, f"u{k}", "k", k) for k in range(40)], cols))
    before = _files(path)
    day = T + dt.timedelta(days=1)
    more = spark.createDataFrame([(f"n{k}", "b", day, f"v{k}", "k", k) for k in range(30)], cols)
    assert newsplan.run_news(path, more) == 30
    after = _files(path)
    assert all(after.get(f) == at for f, at in before.items()) and len(after) > len(before)  # no stored file was touched

    # new and stored ids together; the first try is lost after the overwrite
    day += dt.timedelta(days=1)
    both = spark.createDataFrame([("t1", "b", day, "changed", "k", 1), ("x", "b", day, "w1", "k", 2), ("x", "b", day, "w2", "k", 3)], cols)
    append = sinks.append_rows

    def lost(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "append_rows", lost)
    with pytest.raises(RuntimeError, match="lost"):
        newsplan.run_news(path, both)
    monkeypatch.setattr(sinks, "append_rows", append)
    assert newsplan.run_news(path, both) == 3 and newsplan.run_news(path, both) == 0
    rows = newsplan.read_news_table(spark, path)
    got = {r.title: r for r in rows.collect()}
    assert rows.count() == len(got) == 71
    assert (got["t1"].url, got["t1"].published_at, got["x"].url, got["x"].published_at) == ("changed", T, "w2", day)

    many, stored = len(_files(path)), sorted(map(str, rows.collect()))
    newsplan.compact_news(spark, path)
    assert len(_files(path)) < many and sorted(map(str, newsplan.read_news_table(spark, path).collect())) == stored


def test_stream_replay_writes_nothing(spark, tmp_dir):
    from marketpulse.streaming.ingest import file_stream, load_into, stream_ingest
    bars = _bars(spark, [("A", T + dt.timedelta(days=d), 1.0, 1.0, 0) for d in range(3)])
    bars.write.parquet(f"{tmp_dir}/src")
    path = f"{tmp_dir}/t"

    def load(t, b):
        return market.run_prices(t, b, ["seq"])

    stream_ingest(file_stream(spark, f"{tmp_dir}/src", bars.schema), path, load, f"{tmp_dir}/ck").awaitTermination()
    before = _files(path)
    assert sinks.read_table(spark, path, schemas.CRYPTO_PRICES).count() == 3
    load_into(path, load)(bars, 0)  # the same micro-batch once more
    assert _files(path) == before


def _walk(seed, n, symbol):
    import numpy as np
    rng = np.random.default_rng(seed)
    return [(symbol, T + dt.timedelta(days=k), float(x), 1.0, 0) for k, x in enumerate(rng.normal(100, 9, n))]


def test_resumed_indicators_equal_the_full_recompute(spark):
    """Loads of every length, symbols that start late or miss a load; blocks of 8 rows."""
    from marketpulse.operators import indicator_state as ist, indicators as ind
    rows = _walk(1, 90, "A") + [(s, t + dt.timedelta(days=30), c, v, q) for s, t, c, v, q in _walk(2, 40, "B")] + _walk(3, 12, "C")
    bars = _bars(spark, rows)
    state, made = ist.empty_state(spark), []
    for day in (1, 15, 33, 200):
        part = ist.resume(bars.where(F.col("Date") < F.lit(T + dt.timedelta(days=day))), state, block=8, bucket_rows=7).checkpoint()
        made += ist.new_rows(part).collect()
        state = ist.latest_state(state.unionByName(ist.next_state(part))).checkpoint()
    want = {(r.symbol, r.Date): r for r in ind.indicators(bars).collect()}
    assert len(made) == len(want) == len(rows)
    for r in made:
        for c in ind.INDICATOR_COLUMNS:
            a, b = r[c], want[(r.symbol, r.Date)][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-8), (r.symbol, r.Date, c)
    assert {(r.symbol, r.n, len(r.closes)) for r in state.collect()} == {("A", 90, 20), ("B", 40, 20), ("C", 12, 12)}


def test_indicator_load_after_a_crash_between_its_writes(spark, tmp_dir):
    """Rows were appended but not the states: nothing is written twice or lost."""
    from marketpulse.operators import indicator_state as ist
    bars, path = _bars(spark, _walk(5, 60, "A")), f"{tmp_dir}/ind"
    early = bars.where(F.col("Date") < F.lit(T + dt.timedelta(days=30)))
    assert market.run_indicators(path, early, ["seq"]) == 30
    before = _files(market.state_path(path))
    assert market.run_indicators(path, early, ["seq"]) == 0 and _files(market.state_path(path)) == before
    rows = ist.resume(bars.where(F.col("Date") < F.lit(T + dt.timedelta(days=40))), market.read_state(spark, path))
    sinks.append_rows(market._stored_shape(ist.new_rows(rows)), path)
    assert market.run_indicators(path, bars, ["seq"]) == 20
    table = sinks.read_table(spark, path, schemas.CRYPTO_INDICATORS)
    want = {r.recorded_at: r.macd_signal for r in market.indicator_rows(bars).collect()}
    got = {r.recorded_at: r.macd_signal for r in table.collect()}
    assert table.count() == 60 and got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-7 for k in want)


def test_write_counts_its_own_rows(spark, tmp_dir):
    """The count is observed on the write, many partitions and symbols, each row once."""
    bars = _bars(spark, [(f"S{k % 7}", T + dt.timedelta(days=k // 7), 1.0, 1.0, 0) for k in range(700)]).repartition(9)
    assert market.run_prices(f"{tmp_dir}/p", bars, ["seq"]) == 700
    assert market.run_prices(f"{tmp_dir}/p", bars, ["seq"]) == 0


def test_stream_drops_repeats_and_late_rows_before_the_load(spark, tmp_dir):
    from marketpulse.streaming.ingest import file_stream, stream_ingest
    seen = []
    src = f"{tmp_dir}/src"
    days = [[(f"S{d}", d) for d in (10, 11, 11)], [("S11", 11), ("S12", 12), ("S3", 3)], [("S12", 12), ("S4", 4), ("S13", 13)]]
    for chunk in days:
        b = _bars(spark, [(s, T + dt.timedelta(days=d), 1.0, 1.0, 0) for s, d in chunk])
        b.coalesce(1).write.mode("append").parquet(src)
        stream_ingest(file_stream(spark, src, b.schema), "-", lambda t, x: seen.extend(r.symbol for r in x.collect()), f"{tmp_dir}/ck",
                      keys=["symbol"], ts="Date", delay="3 days").awaitTermination()
    assert sorted(seen) == ["S10", "S11", "S12", "S13"]

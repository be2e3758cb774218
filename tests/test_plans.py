"""Plan shape checks: pushdown, pruning, no Python in the window path."""

from pyspark.sql import functions as F

from marketpulse.operators import indicators as ind
from marketpulse.operators import quality as q
from marketpulse.sources import sinks
from marketpulse.sources.adapters import prices_v
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicator_plan_is_jvm_only_and_pruned(spark):
    plan = _plan(ind.indicators(prices_v(spark, SMALL)))
    assert "Python" not in plan and "ArrowEval" not in plan
    # only the three needed order columns reach the scan
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l]
    assert scan and all("o_custkey" not in l and "o_orderstatus" not in l for l in scan)


def test_partition_filter_on_symbol_table(spark, tmp_dir):
    df = spark.createDataFrame([("BTC", 1.0), ("ETH", 2.0)], "symbol string, price double")
    sinks.write_partitioned(df, f"{tmp_dir}/p")
    plan = _plan(q.by_key(spark.read.parquet(f"{tmp_dir}/p"), "symbol", "BTC"))
    assert "PartitionFilters: [isnotnull(symbol" in plan and "BTC" in plan


def test_filter_pushed_to_scan(spark):
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = _plan(q.by_key(o, "o_orderpriority", "1-URGENT").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan


def _final_plan(df):
    """Plan after execution (adaptive plans show their final form)."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_and_first_per_key_limit_before_the_shuffle(spark):
    from marketpulse.operators import retrieval as rt
    from marketpulse.operators import tables as tb
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        o = spark.read.parquet(f"{SMALL}/orders.parquet")
        top = rt.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)
        first = tb.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
        for df in (top, first):
            plan = _plan(df)
            # a partial WindowGroupLimit runs below the exchange, a final one above it
            assert plan.count("WindowGroupLimit") >= 2, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_latest_combines_map_side(spark):
    from marketpulse.operators import retrieval as rt
    plan = _plan(rt.latest(prices_v(spark, SMALL), ["symbol"], "Date"))
    # one partial max_by per task below the exchange: one row per key per
    # task is shuffled; no window over the rows
    assert "partial_max_by" in plan and "Window" not in plan


def test_keyed_table_and_conversation_plans_have_no_python(spark):
    from marketpulse.operators import conversations as cv
    from marketpulse.operators import tables as tb
    from marketpulse.sources import adapters as ad
    n = ad.news_v(spark, SMALL)
    plans = [
        _plan(tb.upsert(n.drop("doc_id"), n, "id", "doc_id", ["url", "keywords"])),
        _plan(tb.newer_than(n, n.where(F.col("doc_id") > 0), "published_at")),
        _plan(cv.number_titles(ad.sessions_v(spark, SMALL).withColumn("title", F.lit(None).cast("string")),
                               ad.sessions_v(spark, SMALL))),
        _plan(ind.rsi(prices_v(spark, SMALL))),
        _plan(ind.bollinger(prices_v(spark, SMALL))),
    ]
    for p in plans:
        assert "Python" not in p and "ArrowEval" not in p and "MapInPandas" not in p


def test_partitioned_write_splits_a_hot_symbol(spark, tmp_dir):
    import os
    rows = [("HOT", f"2024-01-{d:02d} 00:00:00", float(d)) for d in range(1, 29)] + [("COLD", "2024-01-01 00:00:00", 1.0)]
    df = (spark.createDataFrame(rows, "symbol string, t string, price double")
               .select("symbol", F.col("t").cast("timestamp_ntz").alias("recorded_at"), "price"))
    # AQE would merge these tiny range partitions into one (it only merges
    # small ones); turned off here to see the split itself
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_partitioned(df, f"{tmp_dir}/hot")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for f in os.listdir(f"{tmp_dir}/hot/symbol=HOT") if f.endswith(".parquet")]
    assert len(files) > 1          # the hot symbol is written by several tasks
    back = spark.read.parquet(f"{tmp_dir}/hot")
    assert back.count() == 29

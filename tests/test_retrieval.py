"""Vector search, coin tagging and prompt assembly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketpulse.operators import coins as cn
from marketpulse.operators import retrieval as rt


def _vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype("float32")
    rows = [(f"id{i:04d}", v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id string, embedding array<float>"), v


def _brute(v, q, k):
    out = {}
    for qi, qv in enumerate(q):
        d = ((v.astype(float) - qv.astype(float)) ** 2).sum(1)
        order = sorted(range(len(v)), key=lambda i: (d[i], f"id{i:04d}"))[:k]
        out[qi] = [f"id{i:04d}" for i in order]
    return out


def test_knn_exact_for_any_tile_size(spark):
    vec, v = _vectors(spark)
    q = np.random.default_rng(2).normal(size=(12, 8)).astype("float32")
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(12)], "qid long, qvec array<float>")
    want = _brute(v, q, 5)
    for kw in ({}, {"tile_rows": 40}, {"tile_rows": 3}):
        hits = rt.knn(vec, qdf, 5, **kw).collect()
        got = {}
        for r in sorted(hits, key=lambda r: (r.qid, r.rank)):
            got.setdefault(r.qid, []).append(r.id)
        assert got == want


def test_knn_far_tiles_are_left_out(spark):
    """Vectors in distant clusters: the result is exact though few tiles meet."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 100
    v = np.concatenate([c + rng.normal(size=(60, 6)) for c in centres]).astype("float32")
    vec = spark.createDataFrame([(f"id{i:04d}", v[i].tolist()) for i in range(len(v))], "id string, embedding array<float>")
    q = v[::37]
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "qid long, qvec array<float>")
    got = {}
    for r in sorted(rt.knn(vec, qdf, 4, tile_rows=30).collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append(r.id)
    assert got == _brute(v, q, 4)
    vs = rt.tiles(vec.select("id", F.col("embedding").alias("vec")), 30)
    n = vs.select("tile").distinct().count()
    assert rt._tile_pairs(vs, vs, 4).count() < 0.3 * n * n
    assert vs.groupBy("tile").count().agg(F.max("count")).first()[0] <= 40


def test_knn_null_vectors_and_no_job_while_planning(spark):
    rows = [("b", [1.0, 0.0]), ("a", None), ("c", [0.0, 1.0])]
    vec = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, qvec array<float>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("knn-plan", "")
    hits = rt.knn(vec, q, 2)
    assert len(tracker.getJobIdsForGroup("knn-plan")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.qid, r.id) for r in hits.orderBy("rank").collect()] == [(0, "b"), (0, "c")]
    assert rt.knn(vec.limit(0), q, 2).collect() == []


def test_knn_ties_with_duplicate_vectors(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])]
    vec = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<float>")
    assert [r.id for r in rt.knn(vec, q, 2).orderBy("rank").collect()] == ["a", "b"]


def test_top_k_plan_uses_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    plan = rt.top_k(df, ["g"], [F.col("v").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_coin_rules(spark):
    qs = spark.createDataFrame([(1, "比特幣適合買進嗎？"), (2, "除了BTC，還有什麼幣值得關注？"),
                                (3, "what now?"), (4, "ETHER and SOLANA"), (5, "eth/xrp pair")],
                               "qid long, question string")
    got = {}
    for r in cn.tag_coins(qs, "question", "qid").orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.symbol)
    assert got == {1: ["BTC"], 2: ["ETH", "SOL"], 3: ["BTC", "ETH"], 4: ["BTC", "ETH"], 5: ["ETH", "XRP"]}


def test_attach_sources_defaults(spark):
    hits = spark.createDataFrame([("x", "T1"), ("y", None), ("z", "T3")], "id string, title string")
    news = spark.createDataFrame([("x", "http://u"), ("y", None)], "id string, url string")
    out = {r.id: r.source for r in rt.attach_sources(hits, news).collect()}
    assert out == {"x": "T1 : http://u", "y": "無標題 : None", "z": "T3 : 無連結"}


def test_more_tiles_than_one_pass_cuts(spark):
    """Cut in three passes of four parts: every row keeps a tile, tiles stay
    bounded (a crowd of one direction too), and like directions stay together."""
    from marketpulse.operators.retrieval import tiles
    rng = np.random.default_rng(7)
    vecs = [rng.normal(size=6).tolist() for _ in range(400)] + [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 200
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = tiles(df, 10, 600, 4).collect()
    sizes = {}
    for r in got:
        sizes[r.tile] = sizes.get(r.tile, 0) + 1
    assert sorted(r.id for r in got) == list(range(600))
    assert len(sizes) >= 40 and max(sizes.values()) <= 40


@pytest.mark.parametrize("meet", [1, 3])
def test_knn_over_many_groups_of_tiles(spark, monkeypatch, meet):
    """Summaries dealt out over many groups, several passes of cuts: still exact."""
    from marketpulse.operators import retrieval
    monkeypatch.setattr(retrieval, "MEET_TILES", meet)
    monkeypatch.setattr(retrieval, "CUTS", 4)
    rng = np.random.default_rng(meet)
    centers = rng.normal(0, 50, (5, 4))
    v = [(i, (centers[i % 5] + rng.normal(size=4)).tolist()) for i in range(150)] + [(150, None)]
    q = [(i, (centers[i % 5] + rng.normal(size=4)).tolist()) for i in range(40)]
    got = retrieval.knn(spark.createDataFrame(v, "id long, embedding array<double>"),
                        spark.createDataFrame(q, "qid long, qvec array<double>"), 3, tile_rows=8, n_vectors=151, n_queries=40).collect()
    m = np.array([x for _, x in v[:150]])
    want = {(i, r + 1): int(k) for i, x in q for r, k in enumerate(np.argsort(((m - x) ** 2).sum(1), kind="stable")[:3])}
    assert {(r.qid, r["rank"]): r.id for r in got} == want


def test_rows_are_sent_once_a_group_however_small_the_tiles(spark):
    """Tiles of 4 rows that all meet: a row goes to as many tasks as the other side has groups, not tiles."""
    import pandas as pd
    from pyspark.sql import types as T
    vec, _ = _vectors(spark, 200)
    vs = rt.tiles(vec.select("id", F.col("embedding").alias("vec")), 4)
    def count(q, v):
        return pd.DataFrame({"q": [len(q)], "v": [len(v)]})
    got = rt._meet(vs, vs, F.lit(2), F.lit(3), count, T.StructType.fromDDL("q long, v long")).agg(F.sum("q"), F.sum("v"), F.count("q")).first()
    assert tuple(got) == (200 * 3, 200 * 2, 6)
    assert vs.select("tile").distinct().count() >= 40


def test_knn_of_far_offset_copies_and_values_that_are_not_finite(spark):
    """Far from the origin single precision says nothing; many copies tie; a vector with NaN hides no other; ids may be null."""
    rng = np.random.default_rng(5)
    v = [(f"id{i:03d}", (1e6 + rng.normal(size=4)).tolist()) for i in range(60)]
    v += [(f"c{i:03d}", [1e6] * 4) for i in range(30)] + [("nan", [float("nan")] * 4), (None, [1e6 + 9.0] * 4)]
    q = [(0, [1e6] * 4), (1, v[7][1]), (2, [1e6 + 8.0] * 4), (3, [float("inf")] * 4)]
    hits = rt.knn(spark.createDataFrame(v, "id string, embedding array<double>"),
                  spark.createDataFrame(q, "qid long, qvec array<double>"), 3, tile_rows=5).collect()
    got = {(r.qid, r["rank"]): r.id for r in hits}
    known = [(i, np.array(x)) for i, x in v if i != "nan"]
    want = {}
    for qid, x in q[:3]:
        best = sorted(known, key=lambda r: (((r[1] - np.array(x)) ** 2).sum(), r[0] or ""))[:3]
        want.update({(qid, n + 1): i for n, (i, _) in enumerate(best)})
    assert got == want and got[2, 1] is None

"""Vector search and the lookups around it.

Exact nearest-neighbour search in one lazy plan.  Vectors and queries are cut
into tiles of bounded size, near vectors in the same tile, and tiles into a few
groups; each pair of groups meets in one task of bounded size.  There, pairs of
tiles are kept only if they can hold a hit (triangle inequality over the tiles'
centres and radii) and scored by numpy.  Neither pairs of rows nor pairs of
tiles are rows of a table, and a row is sent once a group of the other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.functions.scalars import (
    NO_CONTENT, NO_LINK, NO_TIME, NO_TITLE, or_default, source_line,
)
from marketpulse.operators.series import shares

#: Rows of a tile.
TILE_ROWS = 2048
#: Signs of fixed random projections that order vectors by direction, and the
#: most parts into which one pass cuts that order.
CODE_BITS, CUTS = 32, 256
#: Groups of tiles on each side (more if a group would hold more rows or tiles
#: than a task is meant to): every pair of groups meets in one task.
GROUPS, GROUP_ROWS, MEET_TILES = 8, 1 << 16, 4096
#: Queries and vectors of one matrix product, and pairs of rows whose distance
#: is computed at once.
BLOCK, BATCH, EXACT = 512, 2048, 1 << 16


def _nearest(qids: np.ndarray, q: np.ndarray, qtile: np.ndarray, vids: np.ndarray, v: np.ndarray,
             vtile: np.ndarray, k: int) -> pd.DataFrame:
    """Exact best ``k`` (distance, id) per query for the rows of one task.

    A block of queries meets the tiles of vectors from the nearest possible one
    on, until a tile cannot hold a hit any more.  Squared L2 is first estimated
    with one matrix product in single precision around the block's centre, then
    computed exactly (sum of squared differences in float64) for every vector
    whose estimate, less its error bound, is within the k-th best so far, so
    the returned set is exact.  Rows with a component that is not finite are
    left out.
    """
    rank = pd.Series(vids).rank(method="dense", na_option="top").to_numpy()
    qi, qt = _in_tiles(q, qtile, np.flatnonzero(np.isfinite(q).all(axis=1)))
    vi, vt = _in_tiles(v, vtile, _least_copies(v, rank, k))
    if len(qi) == 0 or len(vi) == 0:
        return pd.DataFrame({"qid": qids[:0], "id": vids[:0], "distance": np.zeros(0)})
    q, v, rank, vids = q[qi], v[vi], rank[vi], vids[vi]
    near, _ = _near(qt, vt, k)
    of = np.repeat(np.arange(len(qt.at)), qt.n)
    out_q, out_v, out_d = [], [], []
    for low in range(0, len(q), BLOCK):
        rows = q[low:low + BLOCK]
        found, dist = _block(rows, near[of[low]:of[low + len(rows) - 1] + 1].min(axis=0), v, vt, rank, k)
        i, j = np.nonzero(np.isfinite(dist))
        out_q.append(qids[qi[low + i]])
        out_v.append(vids[found[i, j]])
        out_d.append(dist[i, j])
    return pd.DataFrame({"qid": np.concatenate(out_q), "id": np.concatenate(out_v), "distance": np.concatenate(out_d)})


def _least_copies(v: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` best of a query: of equal vectors those of the ``k`` least ids."""
    rows = np.flatnonzero(np.isfinite(v).all(axis=1))
    if len(rows) <= k:
        return rows
    rows = rows[np.argsort(rank[rows], kind="stable")]
    same = pd.Series(np.ascontiguousarray(v[rows]).view(f"V{v.shape[1] * 8}").ravel().tolist())
    return rows[(same.groupby(same, sort=False).cumcount() < k).to_numpy()]


def _block(q: np.ndarray, reach: np.ndarray, v: np.ndarray, vt: _Tiles, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``v``, distance) of the best ``k`` of each query of one block, infinite where there are fewer;
    ``reach``: the least distance that the vectors of each tile can have."""
    order = np.argsort(reach, kind="stable")
    order = order[np.isfinite(reach[order])]
    n = vt.n[order]
    rows = np.repeat(vt.at[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    reach = np.repeat(reach[order], n)
    center = q.mean(axis=0)
    near_q = q - center
    qn = (near_q * near_q).sum(axis=1)
    best, found = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
    for low in range(0, len(rows), BATCH):
        kth = best[:, -1]
        if reach[low] > np.sqrt(kth.max()) * (1 + 1e-9) + 1e-9:
            break
        part = rows[low:low + BATCH]
        w = v[part] - center
        wn = (w * w).sum(axis=1)
        size = (np.sqrt(qn) + np.sqrt(wn.max())) ** 2
        single = 1e-25 < size.min() and size.max() < 1e30
        kind = np.float32 if single else np.float64
        # error of products, sums and roundings of that precision, with a margin of 2
        error = 4 * (q.shape[1] + 8) * np.finfo(kind).eps * size
        a = np.concatenate((near_q * -2.0, np.ones((len(q), 1))), axis=1).astype(kind)
        est = a @ np.concatenate((w, wn[:, None]), axis=1).astype(kind).T
        limit = kth - qn + error
        if not np.isfinite(kth).all() and len(part) > k:
            limit = np.minimum(limit, np.partition(est, k - 1, axis=1)[:, k - 1] + 2 * error)
        hits = np.flatnonzero(est <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None])
        for at in range(0, len(hits), EXACT):
            i, j = np.divmod(hits[at:at + EXACT], len(part))
            j = part[j]
            diff = v[j] - q[i]
            exact = (diff * diff).sum(axis=1)
            closer = exact <= best[i, -1]
            _merge(best, found, rank, i[closer], j[closer], exact[closer])
    return found, best


def _merge(best: np.ndarray, found: np.ndarray, rank: np.ndarray, i: np.ndarray, j: np.ndarray, exact: np.ndarray) -> None:
    """Take the vectors ``j`` at distance ``exact`` into the best of the queries ``i``."""
    some, k = np.unique(i), best.shape[1]
    i = np.concatenate((i, np.repeat(some, k)))
    j = np.concatenate((j, found[some].ravel()))
    exact = np.concatenate((exact, best[some].ravel()))
    order = np.lexsort((rank[j], exact, i))
    first = np.searchsorted(i[order], some)
    take = order[first[:, None] + np.arange(k)]
    best[some], found[some] = exact[take], j[take]


class _Tiles(NamedTuple):
    """Tiles of one side of a task: first row, rows, centre and radius of each."""
    tile: np.ndarray
    at: np.ndarray
    n: np.ndarray
    center: np.ndarray
    radius: np.ndarray


def _in_tiles(m: np.ndarray, tile: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, _Tiles]:
    """``rows`` ordered by their tile, and the tiles."""
    rows = rows[np.argsort(tile[rows], kind="stable")]
    tile, at, n = np.unique(tile[rows], return_index=True, return_counts=True)
    if not len(rows):
        return rows, _Tiles(tile, at, n, m[:0], np.zeros(0))
    center = np.add.reduceat(m[rows], at, axis=0) / n[:, None]
    radius = np.maximum.reduceat(np.sqrt(((m[rows] - np.repeat(center, n, axis=0)) ** 2).sum(axis=1)), at)
    return rows, _Tiles(tile, at, n, center, radius)


def _near(qt: _Tiles, vt: _Tiles, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least distance that a query of each tile can have to a vector of
    each tile, infinite where the tile cannot hold one of its k nearest; and the
    bound of each tile's queries.

    Any k vectors of one tile bound the k-th distance from above; a tile whose
    nearest possible vector is farther than the best such bound is left out."""
    mid = vt.center.mean(axis=0)
    a, b = qt.center - mid, vt.center - mid
    an, bn = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    error = (an + bn) * 1e-12
    apart = an + bn - 2.0 * (a @ b.T)
    both = qt.radius[:, None] + vt.radius[None, :]
    near = np.sqrt(np.maximum(apart - error, 0.0)) - both
    far = np.where(vt.n >= k, np.sqrt(np.maximum(apart, 0.0) + error) + both, np.inf).min(axis=1)
    return np.where(near <= far[:, None] * (1 + 1e-9) + 1e-9, near, np.inf), far


def _matrix(series: pd.Series) -> np.ndarray:
    return np.asarray(np.stack(series.to_numpy()), dtype=np.float64) if len(series) else np.zeros((0, 0))


def _directions(vecs: pd.Series) -> pd.Series:
    """``CODE_BITS`` signs of fixed random projections, as a number."""
    if not len(vecs):
        return pd.Series([], dtype="int64")
    m = _matrix(vecs)
    signs = m @ np.random.default_rng(0).normal(size=(m.shape[1], CODE_BITS)) > 0
    return pd.Series((signs @ (1 << np.arange(CODE_BITS)[::-1])).astype(np.int64))


def _coded(rows: DataFrame, most: int) -> tuple[DataFrame, list[Column], Column]:
    """``rows`` with ``code``; the statistics that cut it (count, quantiles of the
    codes), and their value over all rows, which the plan finds when it runs."""
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(code=_directions(b["vec"]).to_numpy())

    stats = [F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(code, {shares(most)}, 10000) AS cuts")]
    coded = rows.mapInPandas(code, T.StructType([*rows.schema.fields, T.StructField("code", T.LongType())]))
    one = coded.agg(*stats).select(F.struct("n", F.coalesce("cuts", F.array().cast("array<long>")).alias("cuts")))
    return coded, stats, one.scalar()


def tiles(rows: DataFrame, tile_rows: int = TILE_ROWS, n_rows: int | None = None, most: int = CUTS) -> DataFrame:
    """``rows`` (id, vec) with ``tile``: about ``tile_rows`` rows or fewer each
    (twice that at most where a frequent code begins), vectors of like direction
    together.  Where tiles begin follows from counts and quantiles inside the
    plan; ``n_rows``, the number of rows or a bound on it, says in how
    many passes of ``most`` parts the order is cut; if it is not known there is
    one, and beyond ``most`` tiles a part's rows are dealt out by hash."""
    return _cut(*_coded(rows, most), tile_rows, n_rows, most)


def _cut(coded: DataFrame, stats: list[Column], one: Column, tile_rows: int, n_rows: int | None, most: int) -> DataFrame:
    cut = coded.withColumn("stats", one).selectExpr("id", "vec", "code", "0L AS cell", "stats.n", "stats.cuts")
    part = f"cell * {most} + size(filter(cuts, c -> c < code)) * least({most}, ceil(n / {int(tile_rows)})) div {most}"
    while n_rows is not None and n_rows > most * tile_rows:
        n_rows = -(-n_rows // most)
        finer = cut.selectExpr("id", "vec", "code", f"{part} AS cell")
        cut = finer.join(finer.groupBy("cell").agg(*stats), "cell")
    # a code that many quantiles fall on has as many shares of the rows; those
    # are dealt out by hash, half as many parts again as needed
    parts = f"greatest(1, ceil(1.5D * n * (1 + size(filter(cuts, c -> c = code))) / {most * int(tile_rows)}))"
    return cut.selectExpr("id", "vec", f"({part}) * {1 << 32}L + pmod(xxhash64(id), {parts}) AS tile")


def _groups(n: Column, tile_rows: int) -> Column:
    """Groups of one side's tiles: ``GROUPS``, or as many as hold each about
    ``GROUP_ROWS`` rows in ``MEET_TILES`` tiles, whichever is more."""
    return F.greatest(F.lit(GROUPS), F.ceil(n / min(GROUP_ROWS, MEET_TILES * tile_rows))).cast("int")


def _meet(queries: DataFrame, vectors: DataFrame, q_groups: Column, v_groups: Column,
          run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """``run(query rows, vector rows)`` for each pair of groups of whole tiles, in
    a task of its own.  A row goes to as many tasks as the other side has groups.
    Tiles are dealt out in turn, so that groups are of a size and each has tiles
    of every direction.  A group without rows on one side gives nothing."""
    def dealt(df: DataFrame, own: str, groups: Column, other: str, others: Column) -> DataFrame:
        # columns of their own names, so that both sides may be the same rows
        df = df.select(*[F.col(c).alias(f"{own}_{c}") for c in part]).withColumn("own", groups).withColumn("others", others)
        group = f"cast(pmod(shiftright({own}_tile, 32) + ({own}_tile & 4294967295L), own) AS int)"
        return df.select(*[f"{own}_{c}" for c in part], F.expr(group).alias(own), F.explode(F.expr("sequence(0, others - 1)")).alias(other))

    def both(qpdf: pd.DataFrame, vpdf: pd.DataFrame) -> pd.DataFrame:
        if not len(qpdf) or not len(vpdf):  # a side without rows may come without columns
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        return run(*(pdf[[f"{own}_{c}" for c in part]].set_axis(part, axis=1) for pdf, own in ((qpdf, "qg"), (vpdf, "vg"))))

    part, names = ["id", "vec", "tile"], schema.names
    q = dealt(queries, "qg", q_groups, "vg", v_groups)
    v = dealt(vectors, "vg", v_groups, "qg", q_groups)
    return q.groupBy("qg", "vg").cogroup(v.groupBy("qg", "vg")).applyInPandas(both, schema)


def _tile_pairs(queries: DataFrame, vectors: DataFrame, k: int, q_groups: int = 1, v_groups: int = 16) -> DataFrame:
    """(qt, vt): pairs of tiles that can hold one of a query's k nearest, by the
    bounds that the tasks of :func:`knn` start from, taken over all of them."""
    def pairs(qpdf: pd.DataFrame, vpdf: pd.DataFrame) -> pd.DataFrame:
        (_, qt), (_, vt) = (_in_tiles(m := _matrix(p["vec"]), p["tile"].to_numpy(), np.flatnonzero(np.isfinite(m).all(axis=1)))
                            for p in (qpdf, vpdf))
        if not len(qt.n) or not len(vt.n):
            return pd.DataFrame({"qt": qt.tile[:0], "vt": vt.tile[:0], "near": np.zeros(0), "far": np.zeros(0)})
        near, far = _near(qt, vt, k)
        i, j = np.nonzero(np.isfinite(near))
        return pd.DataFrame({"qt": qt.tile[i], "vt": vt.tile[j], "near": near[i, j], "far": far[i]})

    met = _meet(queries, vectors, F.lit(q_groups), F.lit(v_groups), pairs, T.StructType.fromDDL("qt long, vt long, near double, far double"))
    best = F.min("far").over(Window.partitionBy("qt"))
    return met.withColumn("bound", best).where("near <= bound * (1 + 1e-9) + 1e-9").select("qt", "vt")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "id",
        vec_col: str = "embedding", q_id: str = "qid", q_col: str = "qvec",
        tile_rows: int = TILE_ROWS, n_vectors: int | None = None, n_queries: int | None = None) -> DataFrame:
    """J8 + L1: exact k nearest vectors per query by squared L2 distance.

    Returns (qid, id, distance, rank) with rank 1..k ordered by
    (distance, id).  Filters on the vectors (e.g. the time floor F3) must be
    applied to ``vectors`` before the call so they reach the scan.  Rows
    without a vector are neither found nor answered.  No job
    runs while the plan is built.  Above ``CUTS * tile_rows`` rows give
    ``n_vectors`` and ``n_queries``, their numbers or bounds on them: tiles are
    then cut by direction in further passes.  The result is the same without.
    """
    qid_t = queries.schema[q_id].dataType
    vid_t = vectors.schema[vec_id].dataType
    schema = T.StructType([T.StructField("qid", qid_t), T.StructField("id", vid_t),
                           T.StructField("distance", T.DoubleType())])
    vs = _coded(vectors.select(F.col(vec_id).alias("id"), F.col(vec_col).alias("vec")).where("vec IS NOT NULL"), CUTS)
    qs = _coded(queries.select(F.col(q_id).alias("id"), F.col(q_col).alias("vec")).where("vec IS NOT NULL"), CUTS)

    def cell(qpdf: pd.DataFrame, vpdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(qpdf["id"].to_numpy(), _matrix(qpdf["vec"]), qpdf["tile"].to_numpy(),
                        vpdf["id"].to_numpy(), _matrix(vpdf["vec"]), vpdf["tile"].to_numpy(), k)

    partial = _meet(_cut(*qs, tile_rows, n_queries, CUTS), _cut(*vs, tile_rows, n_vectors, CUTS),
                    _groups(qs[2].getField("n"), tile_rows), _groups(vs[2].getField("n"), tile_rows), cell, schema)
    return top_k(partial, ["qid"], [F.col("distance"), F.col("id")], k)


def top_k(scored: DataFrame, by: Sequence[str], order: Sequence, k: int = 5,
          rank: str = "rank") -> DataFrame:
    """L1: the first ``k`` rows per group (planned as WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def newest_first(hits: DataFrame, by: str = "qid", ts: str = "timestamp",
                 pos: str = "pos") -> DataFrame:
    """L2: order hits newest first; ties keep distance order, then id."""
    w = Window.partitionBy(by).orderBy(F.col(ts).desc_nulls_last(), F.col("distance"), F.col("id"))
    return hits.withColumn(pos, F.row_number().over(w))


def attach_sources(hits: DataFrame, news: DataFrame, hit_id: str = "id", title: str = "title",
                   news_id: str = "id", url: str = "url") -> DataFrame:
    """Look each hit up in ``news``; adds ``url_text`` and ``source``.

    ``url_text`` is the URL, the text ``None`` for a matched row whose URL is
    null, and ``無連結`` when no row matches.  One join for all hits.
    """
    n = news.select(F.col(news_id).alias("_nid"), F.col(url).alias("_url")).withColumn("_m", F.lit(True))
    j = hits.join(n, F.col(hit_id) == F.col("_nid"), "left")
    url_text = (F.when(F.col("_m").isNull(), F.lit(NO_LINK))
                 .otherwise(F.coalesce(F.col("_url"), F.lit("None"))))
    return (j.withColumn("url_text", url_text)
             .withColumn("source", source_line(or_default(title, NO_TITLE), F.col("url_text")))
             .drop("_nid", "_url", "_m"))


def latest(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """L3: the row with the greatest ``ts`` per key (one aggregate, no sort)."""
    others = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*others), F.col(ts)).alias("_r"))
    return picked.select(*by, *[F.col(f"_r.{c}").alias(c) for c in others])


def attach_latest(symbols: DataFrame, indicators: DataFrame, by: str = "symbol",
                  ts: str = "recorded_at") -> DataFrame:
    """Each wanted symbol with its latest indicator row; symbols without
    any indicator row are dropped."""
    return symbols.join(latest(indicators, [by], ts), on=by, how="inner")


def join_lines(df: DataFrame, key: Sequence[str] | str, col: str, order: str,
               sep: str = "\n", alias: str | None = None) -> DataFrame:
    """One text per key: ``col`` values joined by ``sep`` in ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    agg = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v")))),
                    lambda s: s["v"]), sep)
    return df.groupBy(*keys).agg(agg.alias(alias or col))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id",
           vec_col: str = "embedding") -> DataFrame:
    """C4: (qid, id, title, content, published_time, score) of the top-k hits."""
    hits = knn(vectors, queries, k, vec_id=id_col, vec_col=vec_col)
    meta = vectors.select(F.col(id_col).alias("_id"), "title", "content", "published_time")
    j = hits.join(meta, hits.id == F.col("_id"), "inner")
    return j.select("qid", "id", or_default("title", NO_TITLE).alias("title"),
                    or_default("content", NO_CONTENT).alias("content"),
                    or_default("published_time", NO_TIME).alias("published_time"),
                    F.col("distance").alias("score"), "rank")


def get_by_id(vectors: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """C4 by id: the stored record of each requested id, with defaults."""
    j = vectors.join(ids.select(F.col(id_col).alias("_want")), F.col(id_col) == F.col("_want"), "left_semi")
    return j.select(id_col, or_default("title", NO_TITLE).alias("title"),
                    or_default("content", NO_CONTENT).alias("content"),
                    or_default("published_time", NO_TIME).alias("published_time"))


def delete_vectors(vectors: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The vector table without the given ids."""
    return vectors.join(ids.select(F.col(id_col).alias("_gone")), F.col(id_col) == F.col("_gone"), "left_anti")

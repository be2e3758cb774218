"""Near-duplicate vectors by random-hyperplane hashing and exact cosines.

Equal vectors are one class.  Each class is hashed in several tables by the
signs of its products with fixed random hyperplanes; vectors that share a
bucket of any table are compared by their exact cosine.  A pair is counted in
the first table that brings it together, so no list of pairs is made.  Groups
are the connected components of the links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketpulse.llm.common import saved
from marketpulse.llm.components import components

MIN_COSINE = 0.9
#: Share of the pairs at the very limit that some table brings together;
#: closer pairs are found more often.
RECALL = 0.999
#: Rows of an average bucket, and rows of one side of a comparison: a larger
#: bucket is cut into tiles, and its tile pairs are compared in tasks of their own.
BUCKET, TILE = 1024, 2048
SEED = 20


def tables_for(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, bits of each): bits follow the number of vectors, so that an
    average bucket stays one tile; tables follow the bits, for the recall."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, n) / bucket))))
    same = 1 - math.acos(min_cosine) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same ** bits))), bits


@functools.lru_cache(maxsize=8)
def _planes(dims: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims, bits]).standard_normal((tables, bits, dims))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in float64, without overflow of the squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket of every row in every table."""
    planes = _planes(x.shape[1], tables, bits)
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        out[:, t] = (x @ planes[t].T >= 0) @ (1 << np.arange(bits))
    return out


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, no null or non-finite
    component, not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hashed(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """(cls, n, dims, vector, codes) of every class."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["vector"].map(len).to_numpy()
            for dims in np.unique(size):
                part = b[size == dims]
                for low in range(0, len(part), TILE):
                    p = part.iloc[low:low + TILE]
                    x = np.stack(p["vector"].to_list()).astype(np.float64)
                    c = codes(unit(x), tables, bits)
                    yield pd.DataFrame({"cls": p["cls"].to_numpy(), "n": p["n"].to_numpy(), "dims": int(dims),
                                        "vector": [v.tobytes() for v in x], "codes": list(c)})

    return saved(classes.mapInPandas(run, "cls long, n long, dims int, vector binary, codes array<int>"))


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` after joining the trees of every pair (i, j)."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compare(group: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links of one bucket, or of two tiles of it: (u, v, w), where w > 0 says
    how many rows u is linked to, and w = 0 joins u and v in a spanning forest."""
    table, low, high = (int(group[c].iloc[0]) for c in ("table", "low", "high"))
    g = group.sort_values("cls", kind="stable").reset_index(drop=True)
    cls, n = g["cls"].to_numpy(), g["n"].to_numpy()
    x = unit(np.stack([np.frombuffer(v) for v in g["vector"]]))
    earlier = np.stack(g["codes"].to_list())[:, :table]
    tile = g["tile"].to_numpy()
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    linked, root = np.zeros(len(g), np.int64), np.arange(len(g))
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= min_cosine)
        i, j = rows[i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        if table:
            new = ~(earlier[i] == earlier[j]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(linked, i, n[j])
        np.add.at(linked, j, n[i])
        root = _hook(root, i, j)
    some, child = np.flatnonzero(linked), np.flatnonzero(root != np.arange(len(g)))
    return pd.DataFrame({"u": np.concatenate((cls[some], cls[child])), "v": np.concatenate((cls[some], cls[root[child]])),
                         "w": np.concatenate((linked[some], np.zeros(len(child), np.int64)))})


def _links(hashed: DataFrame, min_cosine: float, tile: int) -> DataFrame:
    """(u, v, w) of all tables, written.  A bucket above ``tile`` rows is dealt
    by hash into tiles, and a row goes to each pair of tiles that holds its own."""
    bucket = ["dims", "table", "code"]
    dealt = hashed.select("cls", "n", "dims", "vector", "codes", F.posexplode("codes").alias("table", "code"))
    large = saved(hashed.select("dims", F.posexplode("codes").alias("table", "code")).groupBy(*bucket).count()
                  .where(F.col("count") > tile).select(*bucket, F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    cut = dealt.join(large, bucket, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    cut = cut.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cut = cut.select(*bucket, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                     "tile", "cls", "n", "vector", "codes")
    return saved(cut.groupBy(*bucket, "low", "high")
                 .applyInPandas(lambda g: _compare(g, min_cosine), "u long, v long, w long"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", min_cosine: float = MIN_COSINE,
                    recall: float = RECALL, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``.

    Links join rows whose vectors have a cosine of ``min_cosine`` or more in
    double precision; equal vectors are linked.  ``n_links`` counts the other
    rows linked directly, ``component_id`` is the least key reachable, ``kept``
    says whether that is the row's own.  Rows whose vector is null, empty, zero or
    holds a null or non-finite component link with nothing; vectors of unequal
    length do not link.  Repeated rows count as often as they come.  Null keys
    are ignored when the least key is taken; where all are null the id is null,
    and such rows are kept.  An empty table gives an empty one.  Other columns
    are not read.  A very long vector is compared whole; hyperplanes take
    length x bits x tables numbers in a task.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    classes = saved(rows.where("vector IS NOT NULL").groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
                    .withColumn("cls", F.monotonically_increasing_id()))
    tables, bits = tables_for(classes.count(), min_cosine, recall, bucket)
    links = _links(_hashed(classes.select("cls", "n", "vector"), tables, bits), min_cosine, tile)
    roots = components(links.where("w = 0").select("u", "v")).withColumnRenamed("node", "cls")
    degree = links.where("w > 0").groupBy(F.col("u").alias("cls")).agg(F.sum("w").alias("others"))
    named = saved(classes.join(roots, "cls", "left").join(degree, "cls", "left")
                  .select("vector", "least", F.coalesce("root", "cls").alias("root"),
                          (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    ids = saved(named.groupBy("root").agg(F.min("least").alias("component_id")))
    told = saved(named.join(ids, "root").select("vector", "n_links", "component_id"))
    out = rows.join(told, "vector", "left")
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))

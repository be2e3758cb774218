"""Vector near-duplicates against all pairs."""
import numpy as np
import pytest

from marketpulse.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, cls string"


def brute(rows, limit=0.9):
    """(id, links, component, kept) of every row, from the whole cosine matrix."""
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for dims in {len(rows[k][1]) for k in ok}:
        own = [k for k in ok if len(rows[k][1]) == dims]
        x = np.array([np.float32(rows[k][1]) for k in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= limit, 1)), strict=True):
            links[own[i]] += 1
            links[own[j]] += 1
            a, b = find(own[i]), find(own[j])
            root[max(a, b)] = min(a, b)
    ids = {}
    for k, (key, _) in enumerate(rows):
        r = find(k)
        ids[r] = min((x for x in (ids.get(r), key) if x is not None), default=None)
    return sorted(((key, links[k], ids[find(k)], key == ids[find(k)]) for k, (key, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x") for k, v in rows], SCHEMA)


def crowd(rng, n, dims, spread):
    base = rng.standard_normal(dims)
    return base / np.linalg.norm(base) + spread * rng.standard_normal((n, dims)) / np.sqrt(dims)


@pytest.mark.parametrize("tile", [ed.TILE, 40])
def test_equals_all_pairs(spark, tile):
    """Crowds of near copies at every distance from the limit, copies, scaled
    copies and loners; the second case cuts every larger bucket into tiles."""
    rng = np.random.default_rng(11)
    x = [crowd(rng, 60, 24, s) for s in (0.1, 0.3, 0.4, 0.5, 0.6)] + [rng.standard_normal((300, 24))]
    x += [np.repeat(x[0][:1], 150, axis=0), x[1][:20] * 2.0]
    x = np.concatenate(x).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(len(x)) * 3, x, strict=True)]
    want = brute(rows)
    out = got(ed.near_duplicates(frame(spark, rows).repartition(5), tile=tile))
    assert [r[0] for r in out] == [r[0] for r in want]
    links, found = sum(r[1] for r in want), sum(r[1] for r in out)
    assert all(a[1] <= b[1] for a, b in zip(out, want, strict=True)) and found >= 0.995 * links > 0
    assert sum(a[2] == b[2] for a, b in zip(out, want, strict=True)) >= 0.99 * len(want)


def test_recall_over_many_bits(spark):
    """Loose crowds, many bits: the tables that the recall asks for find the links."""
    rng = np.random.default_rng(2)
    x = np.concatenate([crowd(rng, 12, 64, 0.32) for _ in range(60)]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    tables, bits = ed.tables_for(len(rows), bucket=4)
    assert bits == 8 and tables > 15
    out = got(ed.near_duplicates(frame(spark, rows), bucket=4))
    want = brute(rows)
    assert sum(r[1] for r in out) >= 0.99 * sum(r[1] for r in want) > 0


def test_tables_follow_the_number_of_vectors():
    assert ed.tables_for(0) == ed.tables_for(1000) and ed.tables_for(1 << 20)[1] == 10
    for n in (10**3, 10**6, 10**9):
        tables, bits = ed.tables_for(n)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.999


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1.0, -0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]),
            (11, [1e30, 1e30]), (12, [1e-30, 1e-30]), (None, None), (13, [-1.0, 0.0])]
    assert got(ed.near_duplicates(frame(spark, rows))) == [(*r[:3], r[3]) for r in brute(rows)]
    assert got(ed.near_duplicates(frame(spark, []))) == []
    assert got(ed.near_duplicates(frame(spark, rows[:6]))) == brute(rows[:6])

"""Ranked search against a plain scorer in whole numbers."""
import math
import re
from collections import Counter

import numpy as np

from marketpulse.llm import lexical
from tests.llm.edge import edge_docs, empty_docs, rows as edge_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=20):
    bags = [(k, Counter(words(t))) for k, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for k, bag in bags:
            if bag:
                m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                        for t in words(text) if t in bag)
                if s > 0:
                    scored.append((-s, k is None, k or 0, k))
        out += [(item, r + 1, k, -s) for r, (s, _, _, k) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got(lexical.ranked(docs.repartition(5), items)) == want
    assert got(lexical.ranked(docs, items, block_bytes=2000)) == want              # several blocks of items


def test_ties_go_by_document_over_tiles_and_tasks(spark, monkeypatch):
    texts = [(k, "same words here" if k % 3 else "other words") for k in range(2000)]
    docs = spark.createDataFrame(texts[::-1], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same here"), (2, "words other other"), (3, "absent"), (1, "same here"), (4, None)], "item_id long, text string")
    assert got(lexical.ranked(docs, items)) == brute(texts, [(1, "same here"), (2, "words other other"), (3, "absent"), (1, "same here"), (4, None)])


def test_products_are_cut_so_that_sums_stay_exact():
    rng = np.random.default_rng(5)
    weight = rng.integers(1, 40_000, 300)
    counts = rng.integers(0, 2_000_000, (300, 7))
    counts[17, 3] = 10**9                                                           # one term beyond the exact range by itself
    impact = rng.integers(0, 40_000 * 10**6, (11, 300)) // 7
    cuts = list(lexical._column_cuts(weight, counts))
    assert len(cuts) > 3 and [c.start for c in cuts[1:]] == [c.stop for c in cuts[:-1]]
    want = [[sum(int(a) * int(b) for a, b in zip(row, col, strict=True)) for col in counts.T] for row in np.minimum(impact, (weight * 10**6 - 1))]
    assert lexical._scores(np.minimum(impact, weight * 10**6 - 1), weight, counts).tolist() == want


def test_edges(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    items = [(1, "word3 thing3"), (2, "a b c"), (None, "wörds ÜNÏcödé ünïcödé"), (3, ""), (4, "aaa " * 3000)]
    table = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, rank string")
    assert got(lexical.ranked(docs, table)) == brute([r[:2] for r in edge_rows()], items)
    assert lexical.ranked(empty_docs(spark, tmp_dir), table).count() == 0
    assert lexical.ranked(docs, table.where("false")).count() == 0

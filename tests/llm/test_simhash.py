import random

import pytest
import xxhash

from marketpulse.llm import simhash
from marketpulse.llm.components import components
from tests.conftest import SMALL
from tests.llm.edge import edge_docs, empty_docs, rows


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, prints, bits=4):
    """Least id reachable over links of all pairs."""
    parent = {p: p for p in set(prints)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(parent)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for d, p in zip(ids, prints, strict=True):
        if d is not None:
            r = find(p)
            least[r] = min(d, least.get(r, d))
    return [least.get(find(p)) for p in prints]


def unsigned(x):
    return x & (2 ** 64 - 1)


def test_all_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    group = brute_groups([d for d, _ in want], [p for _, p in want])
    got = {r.doc_id: (unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (p, g) for (d, p), g in zip(want, group, strict=True)}
    assert len(set(group)) < len(group)


@pytest.mark.parametrize("bits,widths", [(4, (22, 21, 21)), (4, (32, 32)), (3, (16, 16, 16, 16)), (0, (22, 21, 21))])
def test_links_of_planted_groups(spark, bits, widths):
    rng = random.Random(bits + len(widths))
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):  # dense groups, chains and strangers just out of reach
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 9)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    got = {unsigned(r.fp): r.root for r in simhash.link_components(spark.createDataFrame([(p,) for p in signed], "fp long"), bits, widths).collect()}
    want = brute_groups(prints, prints, bits)
    pairs = {(got[p], w) for p, w in zip(prints, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 200 + k) for k in range(1, 40)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 101)}, **{200 + k: 200 for k in range(1, 40)}}


def test_edge_rows(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    got = [(r.doc_id, unsigned(r.fp), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    prints = [brute_fingerprint(r[1]) for r in rows()]
    group = brute_groups([r[0] for r in rows()], prints)
    assert sorted(got, key=str) == sorted([(r[0], p, g) for r, p, g in zip(rows(), prints, group, strict=True)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(g for g in group if g is not None))
    none = empty_docs(spark, tmp_dir)
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


def test_widths_follow_the_count_and_change_nothing(spark):
    assert simhash.segment_widths(10 ** 6) == (22, 21, 21) and simhash.segment_widths(10 ** 9) == (32, 32)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    narrow, wide = (sorted(map(tuple, simhash.near_duplicates(docs, widths=w).collect())) for w in (None, (32, 32)))
    assert narrow == wide

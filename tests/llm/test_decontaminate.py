import random

import numpy as np
import pytest

from marketpulse.llm import decontaminate as D
from tests.conftest import MEDIUM
from tests.llm.edge import edge_docs, empty_docs


def brute_alignment(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 20)), rng.integers(0, 4, rng.integers(0, 25))
        assert D.smith_waterman(a, b) == brute_alignment(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def tables(spark):
    docs, bench = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    return docs, bench, {r.item_id: r.text for r in bench.collect()}, docs.select("doc_id", "text").collect()


def test_every_whole_copy_is_found_and_nothing_else(tables):
    docs, bench, items, rows = tables
    found = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, bench).collect()}
    whole = {(r.doc_id, i) for r in rows for i, t in items.items() if " ".join(t.split()) in " ".join(r.text.split())}
    assert whole and whole <= set(found)
    words = {d.doc_id: D.words(d.text) for d in rows}
    for d, i in set(found) - whole:  # edited copies: the whole table confirms them
        number = {}
        a, b = ([number.setdefault(w, len(number)) for w in ws] for ws in (D.words(items[i]), words[d]))
        assert D.smith_waterman(np.array(a), np.array(b)) >= D.MIN_SCORE * len(a)
    clean = D.keep(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in found})


def test_edited_copies_and_blocks(spark, tables):
    docs, bench, items, rows = tables
    rng, planted, want = random.Random(5), [], set()
    pool = [w for r in rows[:60] for w in r.text.split()[:40]]
    for n, (i, t) in enumerate(items.items()):
        edited = []
        for w in t.split():
            k = rng.random()
            edited += [] if k < 0.03 else [rng.choice(pool)] if k < 0.08 else [w, rng.choice(pool)] if k < 0.11 else [w.upper() + ","]
        host = rng.choice(pool) + " " + " ".join(rng.choices(pool, k=200))
        at = rng.randrange(len(host))
        planted.append((10_000 + n, host[:at] + " " + " ".join(edited) + " " + host[at:]))
        want.add((10_000 + n, i))
    clean = [(20_000 + n, " ".join(rng.choices(pool, k=300))) for n in range(60)]
    extra = spark.createDataFrame(planted + clean, "doc_id long, text string")
    one = {(r.doc_id, r.item_id) for r in D.contaminated(extra, bench).collect()}
    assert len(want & one) >= 0.95 * len(want) and not [d for d, _ in one if d >= 20_000]
    some = {(r.doc_id, r.item_id) for r in D.contaminated(extra, bench, block_words=400).collect()}
    assert len(want & some) >= 0.95 * len(want) and not [d for d, _ in some if d >= 20_000]


def test_edge_rows(spark, tmp_dir, tables):
    docs, none = edge_docs(spark, tmp_dir), empty_docs(spark, tmp_dir)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d e f g h i j"), (5, "word1 thing1 word2 thing2 word3 thing3 word4 thing4 word5 thing5"),
                                   (4, "word1 thing1 word2 thing2 word3 thing3 word4 thing4 word5 thing5")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in D.contaminated(docs, bench).collect()) == [(5, 4, 1.0), (6, 4, 1.0)]
    kept = D.keep(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert D.contaminated(none, bench).collect() == [] and D.keep(none, bench).collect() == []
    assert D.contaminated(docs, bench.limit(0)).collect() == [] and D.keep(docs, bench.limit(0)).count() == docs.count()


def test_every_alignment_at_the_limit_is_found(spark):
    """One edited or partial copy of an item that occurs nowhere else, against the whole table."""
    rng = random.Random(11)
    items = {i: [f"i{i}w{k}" for k in range(rng.randrange(8, 60))] for i in range(40)}
    docs = []
    for i, ws in items.items():
        for n, rate in enumerate((0.1, 0.2, 0.3, 0.4, 0.5)):
            edited = []
            for w in ws[:len(ws) // 2 + 1] if n % 2 else ws:
                k = rng.random()
                edited += [w] if k > rate else [] if k < rate / 3 else ["x"] if k < 2 * rate / 3 else [w, "y"]
            docs.append((10 * i + n, " ".join(rng.choices("p q r s".split(), k=30) + edited + rng.choices("p q r s".split(), k=30))))
        docs.append((10 * i + 9, " ".join(f"{a} {b} x" for a, b in zip(ws[::2], ws[1::2], strict=False))))  # no three words in a row
    want = {}
    for d, t in docs:
        number = {}
        a, b = ([number.setdefault(w, len(number)) for w in ws] for ws in (items[d // 10], t.split()))
        score = D.smith_waterman(np.array(a), np.array(b)) / len(a)
        if score >= D.MIN_SCORE:
            want[d, d // 10] = round(score, 6)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert len(want) > 60 and {(r.doc_id, r.item_id): r.score for r in got} == want


def test_a_popular_part_is_found_beside_a_whole_copy(spark, monkeypatch):
    item = [f"w{k}" for k in range(40)]
    docs = [(0, " ".join(item))] + [(k, f"a{k} b " + " ".join(item[:20]) + f" c d{k}") for k in range(1, 60)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(0, 1.0)] + [(k, 0.5) for k in range(1, 60)]
    assert sorted((r.doc_id, r.score) for r in D.contaminated(frame, bench).collect()) == want
    assert D.keep(frame, bench).count() == 0
    monkeypatch.setattr(D, "PIECE_WORDS", 7)  # texts in pieces: no copy is cut
    block = D.Block([(7, [w.encode() for w in item])])
    assert [block.matches(t, 0.4) for _, t in docs] == [[(7, s)] for _, s in want]


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "今天天气很好我们去公园散步然后回家吃饭"
    bench = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, "omega"), (3, chinese), (4, "你好"), (5, "?!"), (6, "alpha beta")], "item_id long, text string")
    docs = [(1, "x alpha  BETA gamma. y"), (2, "alpha gamma beta omega!"), (3, "alphabeta gamma omegas"), (4, "他说" + chinese + "。"),
            (5, chinese[:12]), (6, "你,好吗"), (7, "您好"), (8, ""), (9, None), (10, "alpha beta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score) for r in D.contaminated(frame, bench).collect())
    assert got == [(1, 1, 1.0), (1, 6, 1.0), (2, 2, 1.0), (4, 3, 1.0), (5, 3, round(12 / len(chinese), 6)), (6, 4, 1.0), (10, 6, 1.0)]
    assert sorted(r.doc_id for r in D.keep(frame, bench).collect()) == [3, 7, 8, 9]

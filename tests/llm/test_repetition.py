import random

from marketpulse.llm import repetition as R
from tests.llm.edge import edge_docs, empty_docs, rows


def brute(text, least):
    w = (text or "").encode().split()
    n, longest = len(w), [0] * len((text or "").encode().split())
    for i in range(n):
        for j in range(n):
            size = 0
            while i != j and max(i, j) + size < n and w[i + size] == w[j + size]:
                size += 1
            longest[i] = max(longest[i], size)
    covered = {k for i in range(n) if longest[i] >= least for k in range(i, i + longest[i])}
    triple = {k for i in range(n) if longest[i] >= 3 for k in range(i, i + 3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(triple),
            len(covered), max(longest, default=0))


def test_figures_against_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab ", "cd\n", "é ", "f\t", "#$ ", "g\x0b", "\xa0"]) for _ in range(rng.randrange(0, 70))) for _ in range(120)]
    texts += [None, "", "a " * 60, "x y z " * 20, "a\nb\na\n \n \n"]
    for text, got in zip(texts, R.figures(texts, 4), strict=True):
        assert tuple(got) == brute(text, 4), text


def test_blocks_do_not_mix_texts(monkeypatch):
    texts = ["a b c d e f", "a b c d e f", "b c d", "a b a b a b"] * 5
    want = R.figures(texts, 2)
    monkeypatch.setattr(R, "BLOCK_WORDS", 1)
    assert (R.figures(texts, 2) == want).all()


def test_verdict(spark, tmp_dir):
    unique = " ".join(f"w{k}" for k in range(400))
    part = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"q{k}" for k in range(101))
    texts = {1: unique, 2: f"{part} {unique} {part}", 3: f"{part} {part} x" + " y z", 4: f"{long} {unique} {unique[:0]} {long}", 5: "w " * 49}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in R.quality(docs).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    assert [r.doc_id for r in R.keep(docs).collect()] == [1]


def test_edge_rows(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    got = R.quality(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.n_words for r in got if r.doc_id is not None} == {r[0]: len((r[1] or "").encode().split()) for r in rows() if r[0] is not None}
    assert R.keep(docs).columns == docs.columns
    none = empty_docs(spark, tmp_dir)
    assert R.quality(none).collect() == [] and R.keep(none).collect() == []

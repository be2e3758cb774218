import itertools
import math

import numpy as np
import pytest

from marketpulse.llm import langid as L
from marketpulse.llm.queries import op3_language_id, piece_path
from tests.conftest import MEDIUM
from tests.llm.edge import edge_docs, empty_docs


def segmentations(word, pieces):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in pieces or len(p) == 1 for p in parts):
            yield parts


def test_forward_sums_all_segmentations():
    names = ["a", "ab", "b", "ba", "aba", "▁a", "▁"]
    table = np.random.default_rng(1).random((len(names) + 1, 2))
    p = L.Pieces(names)
    number = {x: k for k, x in enumerate(names)}
    words = ["▁abab", "▁aba", "▁xab", "a", "bab", "▁abab"]
    got = L.log_likelihood(p, table, words)
    times = np.array([1.0, 2, 1, 3, 1, 1])
    counts, want_counts = L.expected_counts(p, table[:, 0], words, times), np.zeros(len(table))
    for w, row, n in zip(words, got, times, strict=True):
        every = [[number.get(x, len(names)) for x in s] for s in segmentations(w, names)]
        assert row == pytest.approx([math.log(sum(math.prod(table[k, j] for k in s) for s in every)) for j in range(2)])
        total = sum(math.prod(table[k, 0] for k in s) for s in every)
        for s in every:
            for k in s:
                want_counts[k] += n * math.prod(table[i, 0] for i in s) / total
    assert counts == pytest.approx(want_counts)


def log_chain(word, number, unseen, longest, table):
    """Plain forward and backward sums of logarithms, one letter at a time."""
    n = len(word)
    steps = [(a, b, number.get(word[a:b], unseen)) for a in range(n) for b in range(a + 1, min(n, a + longest) + 1)
             if word[a:b] in number or b == a + 1]
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    for a, b, k in steps:
        forward[b] = np.logaddexp(forward[b], forward[a] + math.log(table[k]))
    for a, b, k in reversed(steps):
        backward[a] = np.logaddexp(backward[a], backward[b] + math.log(table[k]))
    uses = np.zeros(len(table))
    for a, b, k in steps:
        uses[k] += math.exp(forward[a] + math.log(table[k]) + backward[b] - forward[n])
    return forward[n], uses


@pytest.mark.parametrize("length", [7, 8, 9, 16, 31, 32, 33, 100, 1500])
def test_runs_of_any_length_are_summed_whole(length):
    """Words on both sides of ``TOGETHER``, with probabilities so small that
    plain products leave the double range; pieces lie across every place."""
    rng = np.random.default_rng(length)
    names = ["a", "ab", "b", "ba", "aba", "abababab", "babaabba", "aa"]
    table = 10.0 ** -rng.uniform(1, 14, (len(names) + 1, 3))
    p, number = L.Pieces(names), {x: k for k, x in enumerate(names)}
    batch = ["".join(rng.choice(list("abx" if k else "ab"), length)) for k in range(4)]
    got = L.log_likelihood(p, table, batch)
    times = np.array([1.0, 2, 3, 1])
    want = [[log_chain(w, number, len(names), p.longest, table[:, j]) for j in range(3)] for w in batch]
    assert got == pytest.approx(np.array([[x[0] for x in row] for row in want]), rel=1e-9)
    counts = L.expected_counts(p, table[:, 1], batch, times)
    assert counts == pytest.approx(sum(t * row[1][1] for t, row in zip(times, want, strict=True)), rel=1e-6, abs=1e-9)


def test_one_run_is_one_word():
    assert L.words("字" * 100 + " Ab") == ["▁" + "字" * 100, "▁ab"]


def test_a_text_of_one_long_run_is_predicted():
    p = L.Pieces(["a", "b", "ab"])
    model = L.Model(p, ["x", "y"], np.array([[.4, .2], [.4, .2], [.1, .5], [1e-7, 1e-7]]))
    assert model.predict(["ab" * 100_000])[0] == ("y", pytest.approx(1.0))


def test_predictions_equal_plain_sums_over_documents(spark):
    """Every document's language and score again, word by word with plain logarithms."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("doc_id % 10 = 3")
    fitted = L.fit(spark, docs, piece_path(), rounds=1)
    names = L.vocabulary(piece_path())
    number, known = {x: k for k, x in enumerate(names)}, {}
    texts = [r.text for r in docs.collect()]
    for text, (lang, score) in zip(texts, fitted.predict(texts), strict=True):
        every = L.words(text)
        if not every:
            assert (lang, score) == ("und", 0.0)
            continue
        for w in set(every) - known.keys():
            sums = np.full((len(w) + 1, len(fitted.langs)), -np.inf)
            sums[0] = 0
            for b in range(1, len(w) + 1):
                for a in range(max(0, b - fitted.pieces.longest), b):
                    if w[a:b] in number or b == a + 1:
                        sums[b] = np.logaddexp(sums[b], sums[a] + np.log(fitted.table[number.get(w[a:b], len(names))]))
            known[w] = sums[-1]
        total = sum(known[w] for w in every)
        assert lang == fitted.langs[int(total.argmax())]
        assert score == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-9)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op3_language_id(spark, MEDIUM).collect()}
    truth = [(r.doc_id, r.lang) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()]
    held = [(d, lang) for d, lang in truth if got[d].held_out]
    assert len(got) == len(truth) and len(held) > 150
    assert sum(got[d].lang_pred == lang for d, lang in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    got = L.identify(docs, piece_path()).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[0].lang_pred, by_id[0].score) == (by_id[1].lang_pred, by_id[1].score) == (by_id[2].lang_pred, by_id[2].score) == ("und", 0.0)
    assert by_id[5].lang_pred == "en" and by_id[None].held_out is False
    assert L.identify(empty_docs(spark, tmp_dir), piece_path()).collect() == []
    assert {r.lang_pred for r in L.identify(docs.where("lang IS NULL"), piece_path()).collect()} == {"und"}


def test_number_signs_are_no_letters():
    assert L.words("½ ² ⅷ ₂ ① 12 _") == []
    assert L.words("m² a½b ⅷx") == ["▁m", "▁a", "▁b", "▁x"]

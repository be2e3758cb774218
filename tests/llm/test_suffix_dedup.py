import random
from collections import Counter

import pytest

from marketpulse.llm import suffix_dedup as S
from tests.conftest import SMALL
from tests.llm.edge import edge_docs, empty_docs


def brute(texts, length):
    octets = [(t or "").encode() for t in texts]
    seen = Counter(t[k:k + length] for t in octets for k in range(len(t) - length + 1))
    out = []
    for t in octets:
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            runs.append((a, at))
        out.append((len(t), runs, bytes(c for c, g in zip(t, gone, strict=False) if not g)))
    return out


def check(spark, path, texts, segment=S.SEGMENT):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = sorted(S.remove_repeats(spark.read.parquet(path), segment=segment).collect(), key=lambda r: r.doc_id)
    for r, t, (n, runs, kept) in zip(got, texts, brute(texts, S.LENGTH), strict=True):
        assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == (n, runs, kept), t


def test_documents(spark, tmp_dir):
    check(spark, f"{tmp_dir}/d", [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])


@pytest.mark.parametrize("segment", [1 << 19, 700])
def test_planted_repeats(spark, tmp_dir, segment):
    rng = random.Random(segment)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared = [noise(n) for n in (198, 199, 200, 201, 260, 900)]
    texts = [noise(rng.randrange(0, 400)) + rng.choice(shared) + noise(rng.randrange(0, 300)) for _ in range(60)]
    hot = noise(150)  # common, but shorter than the limit: every context differs
    texts += [noise(120) + hot + noise(120) for _ in range(40)]
    base = noise(1500)
    texts += [base[:k] + "X" + base[k + 1:] for k in range(40, 1500, 97)]  # near copies
    texts += ["ab" * 700, "a" * 500, "ab" * 99, "", None, "a" * 199, "z" * 200, "abc" * 300 + noise(50) + "abc" * 90]
    check(spark, f"{tmp_dir}/d", texts, segment)


def test_long_text_is_cut_into_pieces():
    text = bytes(random.Random(1).randrange(97, 123) for _ in range(3 * S.SEGMENT))
    covered = [0] * len(text)
    for part in S._joined([b"x" * 50, text, text[:S.LENGTH]], S.SEGMENT):
        for k, at, piece in part:
            if k == 1:
                assert text[at:at + len(piece)] == piece
                for s in (at, at + len(piece) - S.LENGTH):
                    covered[s] += 1
    starts = [(at, at + len(p) - S.LENGTH) for part in S._joined([text], S.SEGMENT) for _, at, p in part]
    assert starts[0][0] == 0 and starts[-1][1] == len(text) - S.LENGTH
    assert all(b + 1 == c for (_, b), (c, _) in zip(starts, starts[1:], strict=False))


def test_edge_rows(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    got = S.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[k].n_bytes, by_id[k].spans, by_id[k].kept) for k in (0, 1)] == [(0, [], b"")] * 2
    assert by_id[5].kept == b"" and len(by_id[5].spans) == 1 and by_id[7].kept == b"a b c d e f g"
    assert S.remove_repeats(empty_docs(spark, tmp_dir)).collect() == []

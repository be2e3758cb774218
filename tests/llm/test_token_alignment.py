"""Token alignment against a brute-force version over token spans."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketpulse.llm import token_alignment as ta
from tests.llm.edge import LONG, TEXTS, edge_docs, empty_docs

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a▁b", "  two  spaces ", "tab\tand\r\nline", "中文字", "\U0001f600\U0001f600", "<|endoftext|> <s> </s> <unk> <0x41>",
       "éaßİ", "x" * 5000, " " * 5000 + "a", "  　z", "don't we'll I'M", "ﬁ Å ½"]


def brute(docs):
    """doc -> figures, from lists of token spans."""
    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = ta._byte_alphabet()
    spans = {}
    for k, (_, text) in enumerate(docs):
        spans[k] = ([], [])
        if not text:
            continue
        want = (" " + text).encode()
        a = [(i, bytes(alphabet[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode())
             for i in b_tok.encode(text) for p in [b_tok.id_to_piece(i)]]
        if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
            for side, tokens in zip(spans[k], (a, b), strict=True):
                at = 0
                for i, piece in tokens:
                    side.append((i, at, at + len(piece)))
                    at += len(piece)
    linked, count = {}, Counter()
    for k, (a, b) in spans.items():
        pairs, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            m = low
            while m < len(b) and b[m][1] < e:
                pairs.append((i, b[m][0]))
                m += 1
        linked[k] = pairs
        count.update(set(pairs))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for k, (doc, _) in enumerate(docs):
        a, b = spans[k]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s, t in a if low < t <= e) + "|" + ",".join(str(i) for i, s, t in b if low < t <= e))
            low = e
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(ends), len(linked[k]), sum(count[p] == best[p[0]] for p in linked[k]),
                    sum(count[p] for p in linked[k]), sha))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize(("block", "shard"), [(ta.BLOCK, ta.SHARD), (300, 100)])
def test_equals_brute_force(spark, block, shard):
    """Whole and odd texts; the second case takes many shards and many blocks."""
    texts = [r["text"][:1500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    docs = [(k, t) for k, t in enumerate([*texts, *ODD, *ODD, *[t for t in TEXTS if t != LONG]])] + [(None, "null key")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(ta.align(df, *PATHS, block=block, shard_pairs=shard)) == brute(docs)


def test_quick_encoder_equals_the_tokenizers_library():
    a = ta.ByteLevel(PATHS[0])
    assert a.quick is not None
    rng = random.Random(3)
    signs = "".join(map(chr, [*range(0, 0x250), *range(0x2010, 0x2028)])) + "   \n\n'stdm" * 30
    texts = [" " + "".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(2000)] + [" " + t for t in ODD]
    for t, ids in zip(texts, a.encode(texts), strict=True):
        assert ids.tolist() == a.exact.encode(t, add_special_tokens=False).ids, t
    assert len(a.encode([" " * 300_000])[0]) > 0                         # beyond the quick encoder's stack


def test_hash_is_minimal_and_perfect_and_keys_are_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50257 * 32000, 40_000))
    shards = 5
    rows = []
    for s in range(shards):
        own = keys[ta.shard_of(keys, shards) == s]
        levels, bits, order = ta.build_hash(own)
        assert sorted(order) == sorted(own)
        rows.append((s, levels, bits, order.astype("<u8").tobytes(), (order * 3).astype("<i8").tobytes()))
    table = ta.PairTable(rows, shards)
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    assert (table.lookup(keys) == keys * 3).all()
    other = np.setdiff1d(rng.integers(0, 50257 * 32000, 40_000), keys)
    assert (table.lookup(other) == 0).all()
    part = ta.PairTable(rows[1:3], shards)
    held = np.isin(ta.shard_of(keys, shards), (1, 2))
    assert (part.lookup(keys) == np.where(held, keys * 3, 0)).all()


def test_edges(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    got = rows_of(ta.align(docs, *PATHS))
    assert len(got) == docs.count()
    assert ("one" in TEXTS) and sum(r[1] == 0 and r[-1] == "" for r in got) == 3        # null, empty, null with null key
    assert ta.align(empty_docs(spark, tmp_dir), *PATHS).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(ta.align(nothing, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]

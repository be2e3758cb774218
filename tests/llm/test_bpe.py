import hashlib
import random

import pytest
from tokenizers import Tokenizer

from marketpulse.llm import bpe
from marketpulse.llm.queries import tokenizer_path
from tests.conftest import SMALL
from tests.llm.edge import edge_docs, empty_docs, rows


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return bpe.encoder(tokenizer_path()), t


def same(both, text):
    mine, theirs = both
    want = theirs.encode(text or "", add_special_tokens=False).ids
    assert mine.encode(text) == want, text
    assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False), text


def test_documents(spark, both):
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect():
        same(both, r.text)


def test_odd_texts(both):
    rng = random.Random(2)
    signs = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABC'stremvd 0129.,!?-_<|>/éßİΣςñ中文日本語\x1c\x1f\x85\xa0\u0301ÅÅ😀👍🏽\t\n\x00\x7f</w>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 120))) for _ in range(3000)]
    for t in [*texts, None, "", " ", "a<|startoftext|>b <|endoftext|>", "<|startoftext|", "a" * 3000, "hahahaha" * 50, "\u0301 x", "don't WE'LL 'S", "١٢٣ ⅷ ½"]:
        same(both, t)


def test_small_cache(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    for t in ["the quick brown fox jumps over the lazy dog", "the dog the fox"]:
        same(both, t)


def test_edge_rows(spark, tmp_dir, both):
    docs = edge_docs(spark, tmp_dir)
    got = sorted(map(tuple, bpe.digests(docs, tokenizer_path(), ids=True).collect()), key=str)
    want = []
    for r in rows():
        ids = both[1].encode(r[1] or "", add_special_tokens=False).ids
        h = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), both[1].decode(ids, skip_special_tokens=False))]
        want.append((r[0], len(ids), *h, ids))
    assert got == sorted(want, key=str)
    assert bpe.encode(docs, tokenizer_path()).columns == ["doc_id", "ids", "decoded"]
    assert bpe.digests(empty_docs(spark, tmp_dir), tokenizer_path()).collect() == []

"""Benchmark passages in documents: word-pair seeds, then Smith-Waterman.

The benchmark is the query set, held in memory in blocks of a checked size;
all documents are searched for it where they are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketpulse.llm.common import packed

#: Words of a seed (two: the bound in ``Block`` holds for pairs).
SEED_WORDS = 2
#: Share of an item's words, less one point for each edit, from which a passage counts as a copy.
MIN_SCORE = 0.4
#: Items with fewer words count only where all their words stand in a text, in order and next to each other.
MIN_ITEM_WORDS = 8
#: Benchmark words in one block (a bound on the memory of a task; each block is a pass over the documents).
BLOCK_WORDS = 500_000
#: Words of a text that are searched at once, besides an overlap (a bound on memory only).
PIECE_WORDS = 1 << 16

# every ASCII sign that is neither a letter nor a digit separates words
_APART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
# scripts without spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, Japanese, Chinese): each sign is a word
_SIGNS = re.compile("([\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
# their punctuation separates words
_WIDE = re.compile("[\u3000-\u3004\u3008-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a text, without ASCII and full-width punctuation;
    in scripts without spaces each sign is a word."""
    text = (text or "").lower()
    if not text.isascii():
        text = _SIGNS.sub(r" \1 ", _WIDE.sub(" ", text))
    return text.encode("utf-8").translate(_APART).split()


class Block:
    """Some benchmark items with their n-gram seeds; picklable and bounded by ``BLOCK_WORDS``.

    All seeds of an item are used.  A copy of score s has at most as many edits
    as its matching words less s, and so at most one run of matching words more
    than that: its runs hold at least s - 1 pairs of neighbouring words, in a
    passage of at most twice the item's words less s.  Passages with fewer
    pairs are left out, and no copy is among them.

    Items of fewer than ``MIN_ITEM_WORDS`` words are looked up whole."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.names = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64) for _, ws in items]
        self.base = len(self.vocab) + 1
        if self.base ** SEED_WORDS >= 2 ** 63:
            raise ValueError("too many different words in a block: lower block_words")
        self.size = np.array([len(x) for x in self.items], np.int64)
        found = sorted({(c, k) for k, ids in enumerate(self.items) if len(ids) >= MIN_ITEM_WORDS for c in self._grams(ids).tolist()})
        self.short: dict[int, dict[bytes, int]] = {}
        for k, ids in enumerate(self.items):
            if len(ids) < MIN_ITEM_WORDS:
                self.short.setdefault(len(ids), {})[ids.tobytes()] = k
        self.item = np.array([f[1] for f in found], np.int64)
        self.code, self.first, self.per = np.unique(np.array([f[0] for f in found], np.int64), return_index=True, return_counts=True)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """A code for each n-gram; 0 where a word is not in the vocabulary."""
        n = max(0, len(ids) - SEED_WORDS + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED_WORDS):
            out = out * self.base + ids[k:k + n]
            known &= ids[k:k + n] > 0
        return np.where(known, out, 0)

    def read(self, text: str | None) -> np.ndarray:
        """The text's words as numbers of the block's vocabulary (0: another word)."""
        get = self.vocab.get
        ws = words(text)
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the text) of each seed in a text, sorted."""
        grams = self._grams(ids)
        at = np.flatnonzero(grams)
        where = np.searchsorted(self.code, grams[at])
        ok = where < len(self.code)
        ok[ok] = self.code[where[ok]] == grams[at[ok]]
        at, where = at[ok], where[ok]
        per = self.per[where]
        item = self.item[np.repeat(self.first[where] - np.cumsum(per) + per, per) + np.arange(per.sum())]
        order = np.argsort(item, kind="stable")
        return item[order], np.repeat(at, per)[order]

    def matches(self, text: str | None, min_score: float) -> list[tuple[int, float]]:
        """(item id, score) of the items that a text copies, by item id."""
        ids, best = self.read(text), {}
        for at in range(0, len(ids), PIECE_WORDS):
            self._aligned(ids[at:at + PIECE_WORDS + 2 * int(self.size.max())], min_score, best)
        best |= dict.fromkeys(self._whole(ids), 1.0)
        return sorted((self.names[k], score) for k, score in best.items())

    def _whole(self, ids: np.ndarray) -> set[int]:
        """Numbers of the short items that a text holds word for word."""
        out = set()
        for n, known in self.short.items():
            # places where n words in a row are all words of the benchmark
            runs = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.flatnonzero(runs[n:] - runs[:-n] == n)
            out |= {known[x] for x in {ids[a:a + n].tobytes() for a in at.tolist()} if x in known}
        return out

    def _aligned(self, ids: np.ndarray, min_score: float, best: dict[int, float]) -> None:
        """Raise ``best`` (item number: score) to the scores in a piece of a text."""
        item, at = self.hits(ids)
        size = self.size[item]
        need = np.ceil(min_score * size - 1e-9).astype(np.int64)
        reach, last = 2 * size - need, np.arange(len(item)) + np.maximum(need - 1, 1) - 1
        begin = np.flatnonzero(last < len(item))
        last = last[begin]
        ok = (item[last] == item[begin]) & (at[last] + SEED_WORDS - at[begin] <= reach[begin])
        begin, last = begin[ok], last[ok]
        if not len(begin):
            return
        item, low, high = item[begin], np.maximum(0, at[last] + SEED_WORDS - reach[begin]), at[begin] + reach[begin]
        # places that overlap are one passage
        starts = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (low[1:] > high[:-1])]))
        for a, b in zip(starts, np.append(starts[1:], len(item)) - 1, strict=True):
            k = int(item[a])
            score = smith_waterman(self.items[k], ids[low[a]:high[b]]) / len(self.items[k])
            if score >= min_score:
                best[k] = max(best.get(k, 0.0), round(score, 6))


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score: match 1, mismatch -1, gap -1 a word.

    One row of the table at a time; a gap along the row is a running maximum."""
    row, step, best = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1), 0
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == x, 1, -1), row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text",
           block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words.

    The size is summed before anything is collected; a larger benchmark makes
    more blocks (items are dealt by the hash of their text), not larger ones.
    Items with equal words are one, under the least id; null ids are left out."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.coalesce(text, F.lit("")).alias("text")).where("item IS NOT NULL")
    rows = rows.groupBy("text").agg(F.min("item").alias("item"))
    total = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    n = -(-total // block_words)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        least: dict[tuple[bytes, ...], int] = {}
        for r in sorted(part, key=lambda r: r["item"]):
            ws = tuple(words(r["text"]))
            if ws:
                least.setdefault(ws, r["item"])
        if not least:
            continue
        yield Block([(i, list(ws)) for ws, i in sorted(least.items(), key=lambda x: x[1])])


def copied_items(block: Block, text: Column, min_score: float = MIN_SCORE) -> Column:
    """Array of (item, score) that each text copies.

    A map over the rows, without a shuffle: hot items and hot passages are
    spread as the documents are."""
    @F.pandas_udf("array<struct<item:long,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"item": i, "score": s} for i, s in block.matches(t, min_score)] for t in b])

    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id",
                 text: str = "text", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item, score) of all pairs of a document and a benchmark item that
    it copies in whole or in large part, with edits; score 1 is a whole copy.

    Words are separated by white space and punctuation; in scripts without
    spaces each sign is a word.  An item of fewer than ``MIN_ITEM_WORDS`` words
    counts only as a whole, exact copy of its words; one without a word matches
    nothing.  A benchmark of single common words thus matches most texts.

    Repeated rows and equal keys give one row per pair, the best score; null
    texts match nothing; a null key is a key of its own.  An empty benchmark
    or table gives no rows.  Other columns are not read."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = None
    for block in blocks(benchmark, item, text, block_words):
        got = rows.select("key", F.explode(copied_items(block, F.col("text"), min_score)).alias("i")).select("key", "i.*")
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = rows.select("key", F.lit(0).cast("long").alias("item"), F.lit(0.0).alias("score")).limit(0)
    return found.groupBy("key", "item").agg(F.max("score").alias("score")) \
        .select(F.col("key").alias(key), F.col("item").alias(item), "score")


def keep(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text",
         min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that copy no benchmark item, with the columns of
    ``docs``; short items go by the rule in ``contaminated``."""
    out = packed(docs)
    for block in blocks(benchmark, item, "text", block_words):
        out = out.where(F.size(copied_items(block, F.col("doc")[text], min_score)) == 0)
    return out.select("doc.*")

"""Ranked lexical search: items against all documents by blocked matrix products.

Documents are read into sparse rows over the items' vocabulary, statistics are
summed by Spark, and every task multiplies dense document tiles (impacts in
float64) with dense item tiles over their compact vocabulary.  Impacts and
term counts are whole numbers, and a product covers so few columns that its
sums stay below 2^53, so each is exact; sums of products are 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from marketpulse.llm.common import saved

#: Hits of an item.
TOP = 20
#: Parts of the score (fixed values): saturation, length share, impact unit.
SATURATION, LENGTH_PCT, UNIT = 12, 25, 1_000_000_000
#: Text bytes of the items of one block; their vocabulary is what a task holds.
BLOCK_BYTES = 8 << 20
#: Items of an item tile, documents of a document tile, vocabulary columns of a product.
ITEM_TILE, DOC_TILE, COLUMNS = 256, 512, 4096
#: Below this a sum of whole numbers in float64 is exact.
EXACT = 1 << 53
#: Tasks that merge the hits of one item before the last step.
MERGE = 64

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, A-Z lower-cased; null has none.

    Every byte of a character beyond ASCII is above 0x7F, so the matches over
    bytes are those over characters."""
    return _TERM.findall(text.encode("utf-8").lower()) if text else []


class Block:
    """The items of one block: vocabulary and, by item tile, term counts."""

    def __init__(self, items: list[tuple[int, str | None]]):
        bags = [(row, Counter(terms(text))) for row, text in sorted(items, key=lambda x: x[0])]
        self.words = sorted({t for _, bag in bags for t in bag})
        self.at = {t: k for k, t in enumerate(self.words)}
        self.tiles = []
        for low in range(0, len(bags), ITEM_TILE):
            part = bags[low:low + ITEM_TILE]
            columns = np.array(sorted({self.at[t] for _, bag in part for t in bag}), np.int64)
            place = {int(c): k for k, c in enumerate(columns)}
            counts = np.zeros((len(columns), len(part)), np.int64)
            for j, (_, bag) in enumerate(part):
                for t, n in bag.items():
                    counts[place[self.at[t]], j] = n
            if len(columns):
                self.tiles.append((np.array([row for row, _ in part]), columns, counts))


def _sparse(docs: DataFrame, at, key: str, text: str) -> DataFrame:
    """(key, n, words, tfs) of every document; ``words`` are vocabulary places."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = at.value
        for b in batches:
            n, words, tfs = [], [], []
            for t in b["text"]:
                found = terms(t)
                bag = Counter(found)
                held = [(place[w], c) for w, c in bag.items() if w in place]
                n.append(len(found))
                words.append(np.array([x for x, _ in held], "<i4").tobytes())
                tfs.append(np.array([c for _, c in held], "<i8").tobytes())
            yield pd.DataFrame({"key": b["key"].array, "n": n, "words": words, "tfs": tfs})

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")) \
        .mapInPandas(run, "key long, n long, words binary, tfs binary")


def _statistics(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each vocabulary place); one summed row a place at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs, length = np.zeros(size, np.int64), 0, 0
        for b in batches:
            docs += int((b["n"] > 0).sum())
            length += int(b["n"].sum())
            df += np.bincount(np.frombuffer(b"".join(b["words"]), "<i4"), minlength=size)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"place": [*at, -1, -2], "total": [*df[at], docs, length]})

    got = {r["place"]: r["total"] for r in rows.select("n", "words").mapInPandas(run, "place long, total long")
           .groupBy("place").agg(F.sum("total").alias("total")).collect()}
    df = np.zeros(size, np.int64)
    for place, total in got.items():
        if place >= 0:
            df[place] = total
    return got.get(-1, 0), got.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _column_cuts(weight: np.ndarray, counts: np.ndarray) -> Iterator[slice]:
    """Column slices whose products stay exact: for every item, term counts
    times the greatest impact (below weight x 10^6) sum to less than 2^53."""
    bound = (counts * (np.maximum(weight, 1) * (UNIT // 1000))[:, None]).astype(np.float64)
    low, total = 0, np.zeros(counts.shape[1])
    for k in range(len(weight)):
        total = total + bound[k]
        if k > low and (k - low >= COLUMNS or total.max() >= EXACT):
            yield slice(low, k)
            low, total = k, bound[k].copy()
    if low < len(weight):
        yield slice(low, len(weight))


def _scores(impact: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``impact`` (documents x columns, int64) times ``counts`` as int64."""
    out = np.zeros((len(impact), counts.shape[1]), np.int64)
    for cut in _column_cuts(weight, counts):
        if cut.stop - cut.start == 1 and float(counts[cut].max()) * max(int(weight[cut][0]), 1) * (UNIT // 1000) >= EXACT:
            out += impact[:, cut] * counts[cut]              # one term, repeated beyond the exact range
        else:
            out += (impact[:, cut].astype(np.float64) @ counts[cut].astype(np.float64)).astype(np.int64)
    return out


class _Hits:
    """The best documents of each item of a tile so far, ties by document."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item = np.empty(0, np.int64)
        self.score, self.doc = self.item, self.item
        self.null = np.empty(0, bool)
        self.least = np.zeros(items, np.int64)               # the score that a new hit has to reach

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        floor = np.maximum(self.least, 1)
        if len(scores) > self.top:                           # ties with the last place stay in
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        d, j = np.nonzero(scores >= floor)
        if not len(d):
            return
        self.item, self.score = np.concatenate((self.item, j)), np.concatenate((self.score, scores[d, j]))
        self.doc, self.null = np.concatenate((self.doc, doc[d])), np.concatenate((self.null, null[d]))
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        self.item, self.score, self.doc, self.null = self.item[order], self.score[order], self.doc[order], self.null[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.top)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def _search(rows: DataFrame, tiles, weight, n_docs: int, length: int, top: int) -> DataFrame:
    """(item, key, score): at most ``top`` documents an item and task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, parts = weight.value, tiles.value
        hits = [_Hits(len(items), top) for items, _, _ in parts]
        for b in batches:
            for low in range(0, len(b), DOC_TILE):
                t = b.iloc[low:low + DOC_TILE]
                words = np.frombuffer(b"".join(t["words"]), "<i4").astype(np.int64)
                if not len(words):
                    continue
                tf = np.frombuffer(b"".join(t["tfs"]), "<i8")
                of = np.repeat(np.arange(len(t)), [len(x) // 4 for x in t["words"]])
                m = 100 - LENGTH_PCT + (LENGTH_PCT * t["n"].to_numpy() * n_docs) // length
                impact = w[words] * ((UNIT * tf) // (1000 * tf + SATURATION * m[of]))
                null = t["key"].isna().to_numpy()
                doc = t["key"].fillna(0).to_numpy(np.int64)
                for hit, (_, columns, counts) in zip(hits, parts, strict=True):
                    column = np.searchsorted(columns, words)
                    held = np.flatnonzero(column < len(columns))
                    held = held[columns[column[held]] == words[held]]
                    some, back = np.unique(of[held], return_inverse=True)
                    if len(some):
                        dense = np.zeros((len(some), len(columns)), np.int64)
                        dense[back, column[held]] = impact[held]
                        hit.add(_scores(dense, w[columns], counts), doc[some], null[some])
        for hit, (items, _, _) in zip(hits, parts, strict=True):
            yield pd.DataFrame({"item": items[hit.item], "score": hit.score, "none": hit.null,
                                "key": pd.array(np.where(hit.null, 0, hit.doc), "Int64").copy()})

    out = rows.select("key", "n", "words", "tfs").mapInPandas(run, "item long, score long, none boolean, key long")
    return out.select("item", "score", F.when(~F.col("none"), F.col("key")).alias("key"))


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_key, rank, key, score): each item's ``top`` documents with a score above 0.

    Equal scores are ranked by ascending ``key`` (an integer column; nulls
    last).  Null, empty and wordless texts have no term: such documents are in
    no result and not in the statistics, such items have no rows.  Repeated
    documents and items each count on their own; an empty table on either side
    gives no rows.  Other columns are not read.  A very long text is one sparse
    row over the items' vocabulary; a very long item has columns of its own,
    cut so that every product stays exact.

    Items are dealt by hash into blocks of about ``block_bytes`` of text, and
    each block is one pass over the documents that holds its vocabulary only.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    listed = saved(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_key}`").alias("item_key"),
                                F.col(f"`{item_text}`").alias("text")))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    hits = spark.createDataFrame([], "item long, score long, key long")
    for k in range(blocks):
        held = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "text")
        block = Block([(r[0], r[1]) for r in held.collect()])
        if not block.words:
            continue
        rows = saved(_sparse(docs, sc.broadcast(block.at), key, text))
        n_docs, length, df = _statistics(rows, len(block.words))
        if n_docs:
            found = saved(_search(rows, sc.broadcast(block.tiles), sc.broadcast(weights(n_docs, df)), n_docs, length, top))
            hits = hits.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("key")]
    some = hits.withColumn("part", F.pmod(F.xxhash64("key", "score"), F.lit(MERGE)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("place") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return out.join(listed.select("item", "item_key"), "item") \
        .select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")

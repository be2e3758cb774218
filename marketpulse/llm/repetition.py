"""Document quality rules on repetition, from a suffix array of each text.

The suffix array is built over a text's words by prefix doubling.  Its
longest-common-prefix values give the maximal repeated word sequences of a
text; the union of their spans is the repeated part of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketpulse.llm.common import packed

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: A repeat counts from this many words; shorter ones (a phrase, a
#: licence line) also occur in good texts.
MIN_REPEAT = 20
#: A text is rejected when repeats cover more than this share of its words ...
MAX_COVERED_PCT = 20
#: ... or when one repeat is longer than this many words.
MAX_REPEAT = 100
#: Words of the texts that are sorted together (a bound on memory only).
BLOCK_WORDS = 200_000

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "n_covered_words long, longest_repeat long")


def _refine(rank: np.ndarray, active: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split the groups of equal rank among ``active`` by ``second``.

    A rank is the number of suffixes before the group.  Returns the new ranks
    of ``active`` and which of them still share their rank."""
    order = np.lexsort((second, rank[active]))
    r, s = rank[active][order], second[order]
    at = np.arange(len(r))
    old = np.concatenate([[True], r[1:] != r[:-1]])
    new = old | np.concatenate([[True], s[1:] != s[:-1]])
    begin = np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(r), np.int64)
    out[order] = r + begin - np.maximum.accumulate(np.where(old, at, 0))
    sizes = np.diff(np.append(np.flatnonzero(new), len(r)))
    tied = np.empty(len(r), bool)
    tied[order] = np.repeat(sizes > 1, sizes)
    return out, tied


def _suffix_array(words: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words, and the suffix array.

    ``words`` must differ between texts; ``end`` is each position's end of text."""
    n = len(words)
    rank, tied = _refine(np.zeros(n, np.int64), np.arange(n), words)
    levels, active, k = [rank], np.flatnonzero(tied), 1
    while len(active):
        nxt = active + k
        inside = nxt < end[active]
        second = np.where(inside, rank[np.where(inside, nxt, 0)] + 1, 0)
        ranks, tied = _refine(rank, active, second)
        rank = rank.copy()
        rank[active] = ranks
        levels.append(rank)
        active, k = active[tied], 2 * k
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return levels, order


def _longest_match(levels: list[np.ndarray], order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the length of its longest repeat: the larger
    longest-common-prefix with its two neighbours in the suffix array."""
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same], b[same]
    size = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a + size, b + size
        inside = (p < end[a]) & (q < end[b])
        eq = inside & (levels[k][np.where(inside, p, 0)] == levels[k][np.where(inside, q, 0)])
        size += eq.astype(np.int64) << k
    out = np.zeros(len(order), np.int64)
    np.maximum.at(out, a, size)
    np.maximum.at(out, b, size)
    return out


def _covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in [start, start + size) of any span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + sizes, -1)
    return np.cumsum(step[:n]) > 0


def _block(texts: list[bytes], chars: list[int], min_repeat: int) -> np.ndarray:
    """One row of the seven figures for each text."""
    out = np.zeros((len(texts), 7), np.int64)
    ids, sizes = [], []
    for k, t in enumerate(texts):
        found: dict[bytes, int] = {}
        words = t.split()
        ids.append(np.fromiter((found.setdefault(w, len(found)) for w in words), np.int64, len(words)))
        sizes.append(len(words))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[k, :4] = (len(words), chars[k] - len(t) + len(t.translate(None, SPACES)),
                      len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)))
    if not (n := sum(sizes)):
        return out
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    end = (first + sizes)[doc]
    levels, order = _suffix_array(np.concatenate(ids) + first[doc], end)
    # word windows of three that occur twice: pairs that occur twice, split by the third word
    if len(levels) > 1:
        pair = levels[1]
        size = np.bincount(pair, minlength=n)
        at = np.flatnonzero((size[pair] > 1) & (np.arange(n) + 2 < end))
        if len(at):
            _, tied = _refine(pair, at, levels[0][at + 2])
            at = at[tied]
            out[:, 4] = np.bincount(doc, weights=_covered(at, np.full(len(at), 3), n), minlength=len(texts))
    match = _longest_match(levels, order, end)
    np.maximum.at(out[:, 6], doc, match)
    at = np.flatnonzero(match >= min_repeat)
    out[:, 5] = np.bincount(doc, weights=_covered(at, match[at], n), minlength=len(texts))
    return out


def figures(texts: Iterable[str | None], min_repeat: int = MIN_REPEAT) -> np.ndarray:
    """The seven figures of ``COLUMNS`` for each text, in order; null counts as empty."""
    rows, block, chars, size = [], [], [], 0
    for t in texts:
        block.append((t or "").encode("utf-8"))
        chars.append(len(t or ""))
        size += len(block[-1]) // 6
        if size >= BLOCK_WORDS:
            rows.append(_block(block, chars, min_repeat))
            block, chars, size = [], [], 0
    rows.append(_block(block, chars, min_repeat))
    return np.concatenate(rows)


def measured(docs: DataFrame, text: Column, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``docs`` with one more struct column ``figures`` (see ``COLUMNS``); no shuffle."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    @F.pandas_udf(COLUMNS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(figures(b, min_repeat), columns=names)

    return docs.withColumn("figures", run(text))


def verdict(min_words: int = 50, max_repeat_pct: int = 50,
            max_covered_pct: int = MAX_COVERED_PCT, max_repeat: int = MAX_REPEAT) -> tuple[Column, Column]:
    """(base_failed, kept) as columns over the struct of ``measured``."""
    f = F.col("figures")
    failed = (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > max_repeat_pct * f["n_words"])
    kept = ~failed & (100 * f["n_covered_words"] <= max_covered_pct * f["n_words"]) \
        & (f["longest_repeat"] <= max_repeat)
    return failed, kept


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_covered_words, longest_repeat, base_failed, kept) for every row.

    Null and empty texts have no words and so fail the base rules; repeated
    rows are judged each; a null key stays null.  A text is one unit of work:
    memory grows with the longest text of a batch.  Other columns are not read.
    """
    failed, kept = verdict(**limits)
    return measured(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), F.col("text")) \
        .select(F.col("key").alias(key), "figures.*", failed.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with the columns of ``docs``."""
    return measured(packed(docs), F.col(f"doc.{text}")).where(verdict(**limits)[1]).select("doc.*")

"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; the pieces' probabilities come from expectation
maximisation (forward-backward) on labelled text.  A word is a whole run of
letters, however long; the sums are rescaled on the way, so they neither
vanish nor overflow.  Short words are scored together, a length at a time;
longer ones (scripts without spaces) one by one, in time linear in the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketpulse.llm.common import crc32_mod, saved

#: Training documents of a language (expected number; all where there are fewer).
TRAIN_DOCS = 3000
#: Expectation maximisation rounds, and the count added to every piece.
ROUNDS, SMOOTH = 3, 0.1
#: Words up to this length are scored together, longer ones alone (the result is the same).
TOGETHER = 32
#: Letters between two rescalings of the running sums (probabilities from 1e-15 on stay in range).
RESCALE = 8
#: Probability of a letter that no piece is, times the language's share of such letters.
UNSEEN = 1e-7
#: Distinct words that are scored together (a bound on memory only).
BATCH_CHARS = 2_000_000
#: What stands before a word's first letter, in the vocabulary and here.
MARK = "▁"
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letter_runs(text: str) -> Iterator[str]:
    """Runs of letters (Unicode category L).  The pattern also takes number
    signs such as one half or a Roman numeral; they are no letters and end a run."""
    for w in _WORDS.findall(text):
        if w.isalpha():
            yield w
        else:
            yield from "".join(c if c.isalpha() else " " for c in w).split()


def words(text: str | None) -> list[str]:
    """Units of a text: whole lower-case runs of letters, with a mark in front."""
    return [MARK + w for w in _letter_runs((text or "").lower())]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file that lower-case words can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == p.lower() and (p.removeprefix(MARK).isalpha() or p == MARK))


class Pieces:
    """Finds pieces in many words at once; picklable."""

    def __init__(self, pieces: list[str]):
        self.count, self.longest = len(pieces), max(map(len, pieces), default=1)
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have the same hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(h)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % 2 ** 64
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)

    def spans(self, group: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces) for all places in words of one length,
        by begin; a single letter that is no piece has the number ``count``."""
        n = len(group[0])
        codes = np.array(group).view(np.uint32).reshape(len(group), n).astype(np.uint64)
        sums = np.zeros((len(group), n + 1), np.uint64)
        power = [np.uint64(pow(int(_BASE), k, 2 ** 64)) for k in range(n + 1)]
        for k in range(n):
            sums[:, k + 1] = sums[:, k] * _BASE + codes[:, k]
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                h = sums[:, b] - sums[:, a] * power[b - a]
                rows = np.flatnonzero(self.seen[self._slot(h)])
                at = np.searchsorted(self.hashes, h[rows])
                at[at == self.count] = 0
                ok = self.hashes[at] == h[rows]
                rows, ids = rows[ok], self.ids[at[ok]]
                if b == a + 1 and len(rows) < len(group):
                    full = np.full(len(group), self.count)
                    full[rows] = ids
                    rows, ids = np.arange(len(group)), full
                if len(rows):
                    yield a, b, rows, ids


    def matches(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, pieces) of all pieces in one word, by begin; a single
        letter that is no piece has the number ``count``."""
        codes = np.array([word]).view(np.uint32).astype(np.uint64)
        h = np.zeros(len(codes), np.uint64)
        found = []
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = h[:len(codes) - size + 1] * _BASE + codes[size - 1:]
            begins = np.arange(len(h)) if size == 1 else np.flatnonzero(self.seen[self._slot(h)])
            at = np.searchsorted(self.hashes, h[begins])
            at[at == self.count] = 0
            ok = self.hashes[at] == h[begins] if self.count else np.zeros(len(begins), bool)
            ids = self.ids[at] if self.count else at
            if size == 1:
                ids, ok = np.where(ok, ids, self.count), np.ones(len(begins), bool)
            found.append((begins[ok], begins[ok] + size, ids[ok]))
        begins, ends, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begins, kind="stable")
        return begins[order], ends[order], ids[order]


def _by_length(batch: list[str]) -> dict[int, list[int]]:
    """Places of the words of each length up to ``TOGETHER``."""
    out: dict[int, list[int]] = {}
    for k, w in enumerate(batch):
        if len(w) <= TOGETHER:
            out.setdefault(len(w), []).append(k)
    return out


def _long(batch: list[str]) -> list[int]:
    return [k for k, w in enumerate(batch) if len(w) > TOGETHER]


def log_likelihood(pieces: Pieces, table: np.ndarray, batch: list[str]) -> np.ndarray:
    """log probability of each word under each language; ``table`` is (pieces + 1, languages)."""
    out = np.zeros((len(batch), table.shape[1]))
    for n, at in _by_length(batch).items():
        forward = np.zeros((n + 1, len(at), table.shape[1]))
        forward[0] = 1
        scale, scaled = np.zeros(forward.shape[1:]), 0
        for a, b, rows, ids in pieces.spans([batch[k] for k in at]):
            if a % RESCALE == 0 and a > scaled:
                by = forward[a].copy()
                forward[a:a + pieces.longest] /= by
                scale += np.log(by)
                scaled = a
            forward[b][rows] += forward[a][rows] * table[ids]
        out[at] = np.log(forward[n]) + scale
    for k in _long(batch):
        out[k] = _long_log_likelihood(pieces, table, batch[k])
    return out


def _long_log_likelihood(pieces: Pieces, table: np.ndarray, word: str) -> np.ndarray:
    """The forward sums of one word; only as many of them are held as a piece is long."""
    n, ring = len(word), pieces.longest + 1
    begins, ends, ids = pieces.matches(word)
    first = np.searchsorted(begins, np.arange(n + 1))
    forward = np.zeros((ring, table.shape[1]))
    forward[0] = 1
    scale = np.zeros(table.shape[1])
    for a in range(n):
        if a and a % RESCALE == 0:
            by = forward[a % ring].copy()
            forward /= by
            scale += np.log(by)
        here = forward[a % ring].copy()
        forward[a % ring] = 0
        s = slice(first[a], first[a + 1])
        forward[ends[s] % ring] += here * table[ids[s]]
    return np.log(forward[n % ring]) + scale


def expected_counts(pieces: Pieces, table: np.ndarray, batch: list[str], n_times: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece under one language's ``table`` (pieces + 1)."""
    out = np.zeros(len(table))
    for n, at in _by_length(batch).items():
        spans = list(pieces.spans([batch[k] for k in at]))
        forward, backward = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
        forward[0] = backward[n] = 1
        # logarithms of what was taken out of the sums up to each place
        f_scale, b_scale = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
        scaled = 0
        for a, b, rows, ids in spans:
            if a % RESCALE == 0 and a > scaled:
                by = forward[a].copy()
                forward[a:a + pieces.longest] /= by
                f_scale[a:] += np.log(by)
                scaled = a
            forward[b][rows] += forward[a][rows] * table[ids]
        whole = mark = n  # the last place whose backward sum is whole, the last one rescaled
        for a, b, rows, ids in reversed(spans):
            if a + 1 < whole:
                whole = a + 1
                if whole % RESCALE == 0:
                    b_scale[:whole] = b_scale[whole] + np.log(backward[whole])
                    mark = whole
            step = backward[b][rows] * table[ids]
            backward[a][rows] += step if b < mark or mark == n else step * np.exp(b_scale[b] - b_scale[a])[rows]
        total = np.log(forward[n]) + f_scale[n]
        for a, b, rows, ids in spans:
            weight = n_times[at] * np.exp(f_scale[a] + b_scale[b] - total)
            out += np.bincount(ids, forward[a][rows] * table[ids] * backward[b][rows] * weight[rows], len(out))
    for k in _long(batch):
        out += n_times[k] * _long_expected(pieces, table, batch[k])
    return out


def _long_expected(pieces: Pieces, table: np.ndarray, word: str) -> np.ndarray:
    """Expected uses of each piece in one word, by forward and backward sums."""
    n = len(word)
    begins, ends, ids = pieces.matches(word)
    forward, f_scale = _chain(n, begins, ends, table[ids])
    # backward is forward from the other end
    order = np.argsort(n - ends, kind="stable")
    backward, b_scale = _chain(n, (n - ends)[order], (n - begins)[order], table[ids][order])
    with np.errstate(divide="ignore"):
        f, b = np.log(forward) + f_scale, (np.log(backward) + b_scale)[::-1]
        return np.bincount(ids, np.exp(f[begins] + np.log(table[ids]) + b[ends] - f[n]), len(table))


def _chain(n: int, begins: np.ndarray, ends: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all paths from 0 to each place along steps sorted by begin, and
    the logarithm of what rescaling took out of each."""
    first = np.searchsorted(begins, np.arange(n + 1)).tolist()
    to, prob = ends.tolist(), p.tolist()
    sums, scales = [0.0] * (n + 1), np.zeros(n + 1)
    sums[0], scale, ahead = 1.0, 0.0, 0
    for a in range(n):
        if a and a % RESCALE == 0:
            by = sums[a]
            for k in range(a, ahead + 1):
                sums[k] /= by
            scale += float(np.log(by))
        scales[a] = scale
        for s in range(first[a], first[a + 1]):
            sums[to[s]] += sums[a] * prob[s]
            ahead = max(ahead, to[s])
    scales[n] = scale
    return np.array(sums), scales


def _in_batches(items: list[str], size: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of about ``size`` characters."""
    at, total = 0, 0
    for k, w in enumerate(items):
        total += len(w)
        if total >= size:
            yield slice(at, k + 1)
            at, total = k + 1, 0
    if at < len(items):
        yield slice(at, len(items))


class Model:
    """Languages and their piece probabilities; picklable, of the vocabulary's size."""

    def __init__(self, pieces: Pieces, langs: list[str], table: np.ndarray):
        self.pieces, self.langs, self.table = pieces, langs, table

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior probability) of each text; ``und``, 0 without letters."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        at = 0
        while at < len(texts):
            number: dict[str, int] = {}
            docs, chars = [], 0
            while at < len(texts) and chars < BATCH_CHARS:
                ids = [number.setdefault(w, len(number)) for w in words(texts[at])]
                docs.append((at, np.array(ids, np.int64)))
                chars += len(texts[at] or "")
                at += 1
            distinct = list(number)
            score = np.concatenate([log_likelihood(self.pieces, self.table, distinct[s]) for s in _in_batches(distinct)]) \
                if distinct else np.zeros((0, len(self.langs)))
            for k, ids in docs:
                if len(ids):
                    total = score[ids].sum(axis=0)
                    best = int(total.argmax())
                    out[k] = self.langs[best], float(1 / np.exp(total - total[best]).sum())
        return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, text) -> (lang, word, n), summed in the tasks first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                got = pd.Series([w for t in texts for w in words(t)], dtype=object).value_counts()
                yield pd.DataFrame({"lang": lang, "word": got.index.to_numpy(), "n": got.to_numpy()})

    return docs.mapInPandas(run, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(spark: SparkSession, train: DataFrame, path: str, lang: str = "lang", text: str = "text",
        train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Learn piece probabilities from labelled rows.

    A language with more than ``train_docs`` rows is sampled to about that
    many by the hash of the text: the bound on the work of fitting.  Rows with
    a null label or text are left out.  Word counts and expected counts are
    computed and summed by Spark; the driver gets (piece, language) sums only."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = Pieces(vocabulary(path))
    langs = sorted(sizes)
    if not langs:
        return Model(pieces, [], np.zeros((pieces.count + 1, 0)))
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, train_docs / sizes[l]))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    counted = saved(_word_counts(chosen))
    table = np.full((pieces.count + 1, len(langs)), 1 / pieces.count)
    table[-1] = UNSEEN
    for _ in range(rounds):
        got = _expect(counted, pieces, langs, table).collect()
        fresh = np.zeros_like(table)
        for r in got:
            fresh[r["piece"], langs.index(r["lang"])] = r["n"]
        letters = fresh[-1].copy()  # letters that no piece is
        fresh = fresh[:-1] + SMOOTH
        table = np.vstack([fresh / (fresh.sum(axis=0) + letters), UNSEEN * np.ones(len(langs))])
    return Model(pieces, langs, table)


def _expect(counted: DataFrame, pieces: Pieces, langs: list[str], table: np.ndarray) -> DataFrame:
    """(lang, piece, n): expected uses under the present table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(table)
        for b in batches:
            for lang, part in b.groupby("lang"):
                k, ws, n = langs.index(lang), part["word"].tolist(), part["n"].to_numpy(float)
                for s in _in_batches(ws):
                    total[:, k] += expected_counts(pieces, table[:, k], ws[s], n[s])
        at, of = np.nonzero(total)
        yield pd.DataFrame({"lang": [langs[k] for k in of], "piece": at, "n": total[at, of]})

    return counted.mapInPandas(run, "lang string, piece int, n double") \
        .groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def predicted(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of each whole text."""
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(model.predict(b.tolist()), columns=["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, path: str, key: str = "doc_id", lang: str = "lang", text: str = "text",
             folds: int = 5) -> DataFrame:
    """(key, held_out, lang_pred, score) for every row.

    Learns from rows whose crc32(key) modulo ``folds`` is not 0; the label,
    the key and other columns are no inputs of a prediction.  Rows with a null
    key are neither learned from nor held out.  Null texts and texts without
    letters are ``und`` with score 0; so is all if nothing is labelled or the
    table is empty (then without rows).  Texts are read whole, runs of letters
    of any length too.  Of languages that tie, the first in sorted order is
    returned.  Repeated rows are all returned."""
    fold = crc32_mod(F.col(key), folds)
    model = fit(docs.sparkSession, docs.where(fold != 0), path, lang, text)
    return docs.select(F.col(key), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), predicted(model, F.col(text)).alias("found")) \
        .select(key, "held_out", "found.lang_pred", "found.score")

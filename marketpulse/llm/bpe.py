"""BPE encoding by longest matches with backtracking, decoding by offsets.

Merges need not be replayed.  A sequence of tokens is the one that merging
gives exactly when each neighbouring pair is compatible, that is when merging
the pair's text alone gives the pair.  An Aho-Corasick automaton finds the
longest token at each place; an incompatible choice is shortened or taken
back.  Every place is taken back at most once, so the time is linear.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

END = "</w>"
#: Words that a worker remembers in each of two generations, and their greatest length.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48

# The byte alphabet of byte-level vocabularies (printable bytes
# stand for themselves, the others for code points from 256 on).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    out = {b: chr(b) for b in _PRINTABLE}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(_PRINTABLE))
    return out


class WordBpe:
    """Encoder and decoder of one tokenizer file of the word-end kind.

    Inside, tokens are numbered by birth: first the symbols that no merge
    makes, then one token a merge, in the order of the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        made = [a + b for a, b in merges]
        merged = set(made)
        if len(merged) < len(made):
            raise ValueError("two merges make the same token: pair compatibility is undefined")
        names = [x for x in vocab if x not in merged] + made
        number = {x: k for k, x in enumerate(names)}
        self.atoms = len(names) - len(made)
        self.left = [-1] * self.atoms + [number[a] for a, _ in merges]
        self.right = [-1] * self.atoms + [number[b] for _, b in merges]
        self.pairs = {(x, y): k for k, (x, y) in enumerate(zip(self.left, self.right, strict=True)) if x >= 0}
        self.ids = [vocab[x] for x in names]
        # the token's text with one sign for the end of a word
        text = [x[:-len(END)] + "\0" if x.endswith(END) else x for x in names]
        self.size = [len(x) for x in text]
        # a token that merging never makes of its own text is never used
        real = [True] * self.atoms
        for k in range(self.atoms, len(names)):
            a, b = self.left[k], self.right[k]
            real.append(real[a] and real[b] and self._apart(a, b, k))
        self.longest = ahocorasick.Automaton()
        self.known = known = {}
        for k, x in enumerate(text):
            if real[k] and x != "\0":
                known[x] = k
                self.longest.add_word(x, k)
        self.longest.make_automaton()
        self.shorter = [next((known[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in known), -1) for x in text]
        self.compatible: dict[tuple[int, int], bool] = {}
        # decoding: all tokens in one string, and where each id begins
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        by_id = {i: x for x, i in vocab.items()} | added
        self.offsets, self.blob = [0], "".join(by_id.get(i, "") for i in range(max(by_id) + 1))
        for i in range(max(by_id) + 1):
            self.offsets.append(self.offsets[-1] + len(by_id.get(i, "")))
        self.special = {x: i for i, x in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = byte_alphabet()
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether a and b stay two tokens under the merges made before ``before``.

        Goes back in time: the younger of the two at the border is taken apart
        (of equals the right one, as merging goes from left to right), and no
        pair that met at the border may have a merge that comes before the one
        which took one of them in."""
        until_a = until_b = before
        while True:
            m = self.pairs.get((a, b))
            if m is not None and m < until_a and m <= until_b and m < before:
                return False
            if a > b:
                if a < self.atoms:
                    return True
                until_a, a = a, self.right[a]
            else:
                if b < self.atoms:
                    return True
                until_b, b = b, self.left[b]

    def _fits(self, a: int, b: int) -> bool:
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            found = self.compatible[a, b] = self._apart(a, b, len(self.ids))
        return found

    def word(self, symbols: str) -> tuple[int, ...]:
        """Token numbers of one word in the byte alphabet, ended by ``\\0``."""
        if (whole := self.known.get(symbols)) is not None:
            return (whole,)
        size, fits, best = self.size, self.compatible, [-1] * (len(symbols) + 1)
        for end, k in self.longest.iter(symbols):
            best[end - size[k] + 1] = k  # ends ascend: the last is the longest
        out: list[int] = []
        dead: set[int] = set()
        at, last, token = 0, -1, best[0]
        while at < len(symbols):
            while token >= 0:
                if not dead or at + size[token] not in dead:
                    if last < 0:
                        break
                    if (ok := fits.get((last, token))) is None:
                        ok = self._fits(last, token)
                    if ok:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last, token = token, best[at]
            else:  # nothing fits here: shorten the token before
                if not out:
                    raise ValueError("text has a symbol that the vocabulary lacks")
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return tuple(out)

    def _word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of one lower-case word, remembered in two generations."""
        got = self.older.get(word)
        if got is None:
            symbols = word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode("utf-8")))
            got = tuple([self.ids[k] for k in self.word(symbols + "\0")])
        if len(word) <= CACHE_CHARS:
            if len(self.recent) >= CACHE_ENTRIES:
                self.older, self.recent = self.recent, {}
            self.recent[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null is empty."""
        out: list[int] = []
        for piece in self.cut.split(text or "") if self.cut else (text or "",):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            # lower case is taken sign by sign: no special form of sigma at a word's end
            low = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower()
            for word in self.words.findall(low):
                out += self.recent.get(word) or self._word_ids(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space (the file names no decoder)."""
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i]:at[i + 1]] for i in ids])


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder of a tokenizer file, built once in each worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids: array<int>, decoded: string) of each text.

    Null and empty texts have no ids and decode to the empty string.  A map
    over the rows, without a shuffle; ``path`` must exist on the executors."""
    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t) for t in b]
            yield pd.DataFrame({"ids": ids, "decoded": [e.decode(x) for x in ids]})

    return docs.select(F.col(key), run(F.col(text)).alias("bpe")).select(key, "bpe.*")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row, and the ids
    themselves (array<int>) where ``ids`` asks for them; repeated rows and null
    keys are kept; other columns are not read.  Decoded texts stay in the
    worker: only their digests leave it."""
    def digest(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8")).hexdigest()

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            got = [(len(x), digest(" ".join(map(str, x))), digest(e.decode(x)), x)[:len(names)] for x in map(e.encode, b)]
            yield pd.DataFrame(got, columns=names)

    return docs.select(F.col(key), run(F.col(text)).alias("bpe")).select(key, "bpe.*")

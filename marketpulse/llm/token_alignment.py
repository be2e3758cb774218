"""Alignment of two tokenizers over a corpus, with counts of linked id pairs.

Pass 1 encodes every text with both tokenizers, aligns the tokens by byte
offsets and writes ids and per-chunk pair counts once.  The distinct pairs get
a minimal perfect hash a shard; every task adds its pair counts into dense
vectors indexed by that hash, and the vectors are summed in a tree.  Pass 2
aligns the stored ids again and looks the counts up; the key stored at each
slot is compared, so a pair that was never counted has count 0.

Pairs are handled in blocks of about ``BLOCK`` distinct pairs: what a task
holds of the hash, the keys and the counts is one block (about 13 bytes a
pair), whatever the size of the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketpulse.llm.common import saved

#: Bytes of text aligned at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Distinct pairs that one task holds at a time.
BLOCK = 1 << 22
#: Distinct pairs of a shard, the unit in which hashes are built.
SHARD = 1 << 14
#: Vectors added by one step of the tree.
FAN_IN = 64
#: Bits of the hash table a key of a level.
GAMMA = 2


# ---------------------------------------------------------------- tokenizers

def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 signs
    stand for themselves, the other bytes for the signs from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: The pattern that byte-level vocabularies of this family split text by (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these signs, without very long runs of white space, are split alike
#: by both regular expression engines; all others take the slower library.
_ODD = re.compile("[^\x00-ɏ‐-‧]|\\s{2000}")


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.table = [vocab.get(i, b"") for i in range(max([*vocab, *special]) + 1)]
        by_merge = [bytes(alphabet[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        ids = [i for i in sorted(vocab) if len(vocab[i]) > 1]
        # the quick encoder takes ids for merge ranks; only a file numbered that way may use it
        self.quick = None
        if [vocab[i] for i in ids] == by_merge:
            self.quick = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={v: k for k, v in vocab.items()}, special_tokens={})

    @functools.cached_property
    def exact(self):
        """The tokenizers library's own encoder, made where a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        made.no_padding()
        made.no_truncation()
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        quick = self.quick
        return [np.array(self.exact.encode(t, add_special_tokens=False).ids if quick is None or _ODD.search(t)
                         else quick.encode_ordinary(t), np.int64) for t in texts]


class Pieces:
    """Tokenizer B: a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                      else b"" if self.model.is_control(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


@functools.lru_cache(maxsize=2)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in t.table], np.int64) for t in _tokenizers(a_path, b_path))  # type: ignore[return-value]


@functools.lru_cache(maxsize=2)
def _decimals(a_path: str, b_path: str) -> list[bytes]:
    """``id,`` and ``id|`` of every A id, then ``id,`` and ``id;`` of every B id."""
    a, b = _tokenizers(a_path, b_path)
    return [b"%d%s" % (i, mark) for t, last in ((a, b"|"), (b, b";")) for mark in (b",", last) for i in range(len(t.table))]


# ----------------------------------------------------------------- alignment

def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Link every token of ``a`` with every token of ``b`` that shares a byte.

    Both lists tile the same bytes, so the union of their end offsets cuts the
    bytes into segments, and each segment is one link.  Returns (index into a,
    index into b, end offset of the segment, whether both tokens end there).
    """
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    marks = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.uint8)
    marks[end_a] |= 1
    marks[end_b] |= 2
    at = np.flatnonzero(marks)
    here = marks[at]
    in_a, in_b = here & 1, here >> 1
    return np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b, at, here == 3


def _group_text(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, both: np.ndarray, parts: list[bytes], n_a: int, n_b: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of one document."""
    cut = np.flatnonzero(both)
    last_a, last_b = ia[cut], ib[cut]                                   # the tokens that end a group
    before_b = np.concatenate(([0], last_b[:-1] + 1))                   # B tokens in earlier groups
    group_a = np.searchsorted(last_a, np.arange(len(a)))
    group_b = np.searchsorted(last_b, np.arange(len(b)))
    out = np.empty(len(a) + len(b), np.int64)
    kind_a = np.zeros(len(a), np.int64)
    kind_a[last_a] = n_a
    kind_b = np.full(len(b), 2 * n_a)
    kind_b[last_b] += n_b
    out[np.arange(len(a)) + before_b[group_a]] = a + kind_a
    out[np.arange(len(b)) + (last_a + 1)[group_b]] = b + kind_b
    return b"".join(map(parts.__getitem__, out.tolist()))[:-1]


def _starts(lengths: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _pairs_of(a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(pair of every link, first link of every document, what ``links`` says)."""
    aa, bb = np.concatenate(a), np.concatenate(b)
    ia, ib, at, both = links(aa, bb, size_a, size_b)
    ends = np.cumsum(size_a[aa])[_starts([len(x) for x in a])[1:] - 1]
    first = np.searchsorted(at, np.concatenate(([0], ends)), side="right")
    return aa[ia] * len(size_b) + bb[ib], first, (aa, bb, ia, ib, both)


def _chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    held: list[str] = []
    room = CHUNK_BYTES
    for t in texts:
        t = t or ""
        if held and room < len(t):
            yield held
            held, room = [], CHUNK_BYTES
        held.append(t)
        room -= len(t)
    if held:
        yield held


def _encode_chunk(texts: list[str], a_path: str, b_path: str) -> dict[str, list]:
    """Columns of pass 1 for one chunk; its pair counts stand in its first row."""
    tok_a, tok_b = _tokenizers(a_path, b_path)
    size_a, size_b = _sizes(a_path, b_path)
    parts, n_a, n_b = _decimals(a_path, b_path), len(size_a), len(size_b)
    want = [(" " + t).encode() for t in texts]
    some = [k for k, t in enumerate(texts) if t]
    some_a, some_b = tok_a.encode([" " + texts[k] for k in some]), tok_b.encode([texts[k] for k in some])
    none = np.empty(0, np.int64)
    a, b = [none] * len(texts), [none] * len(texts)
    for k, x, y in zip(some, some_a, some_b, strict=True):
        if all(b"".join(map(t.table.__getitem__, ids.tolist())) == want[k] for t, ids in ((tok_a, x), (tok_b, y))):
            a[k], b[k] = x, y
    out: dict[str, list] = {"n_a": [len(x) for x in a], "n_b": [len(x) for x in b], "n_groups": [0] * len(texts),
                            "n_links": [0] * len(texts), "groups_sha256": [""] * len(texts),
                            "a": [_pack(x) for x in a], "b": [_pack(x) for x in b],
                            "pairs": [None] * len(texts), "docs": [None] * len(texts)}
    full = [k for k in range(len(texts)) if len(a[k])]
    if full:
        pair, first, (_, _, ia, ib, both) = _pairs_of([a[k] for k in full], [b[k] for k in full], size_a, size_b)
        for j, k in enumerate(full):
            own = slice(first[j], first[j + 1])
            out["n_links"][k], out["n_groups"][k] = int(first[j + 1] - first[j]), int(both[own].sum())
            text = _group_text(a[k], b[k], ia[own] - ia[own][0], ib[own] - ib[own][0], both[own], parts, n_a, n_b)
            out["groups_sha256"][k] = hashlib.sha256(text).hexdigest()
        of = np.repeat(np.arange(len(full)), np.diff(first))
        held = np.unique(pair * len(full) + of) // len(full)            # each pair once a document
        pairs, docs = np.unique(held, return_counts=True)
        out["pairs"][0], out["docs"][0] = pairs.astype("<u8").tobytes(), docs.astype("<u4").tobytes()
    return out


def _pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


# ------------------------------------------------------ minimal perfect hash

def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser (two multiplications, three shifts)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(pairs, 0) % np.uint64(shards)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits of each level, the bits, keys in slot order) of distinct ``keys``.

    Level by level, a key that is alone at its position sets that bit; the
    others go to the next level.  A key's slot is the number of bits set
    before its own, so n keys have the slots 0 to n - 1.
    """
    levels, bits, order = [], [], []
    left = np.unique(keys)
    while len(left):
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        at = (_mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        taken = np.bincount(at, minlength=size) == 1
        alone = taken[at]
        levels.append(size)
        bits.append(taken)
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
        if len(levels) > 200:
            raise RuntimeError("a level of the hash places no key")
    packed = np.packbits(np.concatenate(bits), bitorder="little").tobytes() if bits else b""
    return levels, packed, np.concatenate(order) if order else np.empty(0, np.int64)


class PairTable:
    """Hashes of consecutive shards as one table: slots of all keys in a row."""

    def __init__(self, rows: list[tuple], shards: int):
        """``rows``: (shard, levels, bits, keys, counts), the last two None or bytes."""
        rows = sorted(rows, key=lambda r: r[0])
        self.shards, self.low, self.high = shards, rows[0][0], rows[-1][0] + 1
        deep = max(len(r[1]) for r in rows)
        self.size = np.zeros((deep, self.high - self.low), np.int64)
        self.offset = np.zeros_like(self.size)
        total = 0
        for shard, levels, *_ in rows:
            for k, size in enumerate(levels):
                self.size[k, shard - self.low], self.offset[k, shard - self.low] = size, total
                total += size
        self.words = np.frombuffer(b"".join(bytes(r[2]) for r in rows), "<u8")
        set_bits = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(set_bits) - set_bits
        self.n = int(set_bits.sum())
        self.keys = np.frombuffer(b"".join(bytes(r[3]) for r in rows), "<u8") if rows[0][3] is not None else None
        self.counts = np.frombuffer(b"".join(bytes(r[4]) for r in rows), "<i8") if rows[0][4] is not None else None

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """Slot of each pair; -1 where no bit answers or the shard is not held."""
        shard = shard_of(pairs, self.shards) - self.low
        out = np.full(len(pairs), -1, np.int64)
        open_ = np.flatnonzero((shard >= 0) & (shard < self.high - self.low))
        for level in range(len(self.size)):
            s = shard[open_]
            size = self.size[level, s]
            open_, s, size = open_[size > 0], s[size > 0], size[size > 0]
            if not len(open_):
                break
            at = self.offset[level, s] + (_mix(pairs[open_], level + 1) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def lookup(self, pairs: np.ndarray) -> np.ndarray:
        """Count of each pair, 0 where the key at its slot is another."""
        slot = self.slots(pairs)
        known = slot >= 0
        known[known] = self.keys[slot[known]] == pairs[known].astype(np.uint64)
        return np.where(known, self.counts[np.where(known, slot, 0)], 0)


# ----------------------------------------------------------------- Spark jobs

def encoded(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pass 1, written to the shared folder: (row, key, n_a, n_b, n_groups,
    n_links, groups_sha256, a, b, pairs, docs); ``a`` and ``b`` are the ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for texts in _chunks(batch["text"]):
                part = batch.iloc[done:done + len(texts)]
                done += len(texts)
                yield pd.DataFrame({"row": part["row"].to_numpy(), "key": part["key"].array, **_encode_chunk(texts, a_path, b_path)})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return saved(rows.mapInPandas(run, f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                       "a binary, b binary, pairs binary, docs binary"), "zstd")


def _hashes(rows: DataFrame, shard_pairs: int) -> tuple[DataFrame, int]:
    """One hash a shard of the distinct pairs, and the number of shards."""
    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pair": np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in b["pairs"]])).astype(np.int64)})

    pairs = saved(rows.where("pairs IS NOT NULL").select("pairs").mapInPandas(distinct, "pair long").distinct())
    shards = max(1, math.ceil(pairs.count() / shard_pairs))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"shard": shard_of(b["pair"].to_numpy(), shards), "pair": b["pair"]})

    def build(group: pd.DataFrame) -> pd.DataFrame:
        levels, bits, keys = build_hash(group["pair"].to_numpy())
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "levels": [levels], "bits": [bits], "keys": [keys.astype("<u8").tobytes()]})

    return saved(pairs.mapInPandas(deal, "shard long, pair long").groupBy("shard")
                 .applyInPandas(build, "shard long, levels array<long>, bits binary, keys binary")), shards


def _block(table: DataFrame, low: int, high: int, columns: list[str]) -> list[tuple]:
    """Rows of the shards from ``low`` up to ``high``: at most about ``BLOCK`` pairs."""
    got = table.where(F.col("shard").between(low, high - 1)).select("shard", "levels", "bits", *columns).collect()
    return [(r[0], list(r[1]), bytes(r[2]), *[bytes(x) for x in r[3:]]) for r in got]


def _summed(parts: DataFrame) -> DataFrame:
    """Tree sum of (shard, part, vector): ``FAN_IN`` vectors of a shard a step."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i8") for x in group["vector"]], axis=0)
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "part": group["part"].iloc[:1], "vector": [total.astype("<i8").tobytes()]})

    widest = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("shard", "part").applyInPandas(add, "shard long, part long, vector binary")
        widest //= FAN_IN
        if not widest:
            return saved(parts.select("shard", "vector"))
        parts = saved(parts)


def pair_counts(rows: DataFrame, block: int = BLOCK, shard_pairs: int = SHARD) -> tuple[DataFrame, int]:
    """((shard, levels, bits, keys, counts), number of shards): for every id
    pair of ``rows`` (pass 1) the number of documents that hold it linked."""
    hashes, shards = _hashes(rows, shard_pairs)
    step = max(1, block // shard_pairs)
    counted: DataFrame | None = None
    chunks = rows.where("pairs IS NOT NULL").select(F.spark_partition_id().cast("long").alias("part"), "pairs", "docs")
    for low in range(0, shards, step):
        held = _block(hashes, low, low + step, [])
        if not held:
            continue
        shared = rows.sparkSession.sparkContext.broadcast([(s, levels, bits, None, None) for s, levels, bits in held])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            table = PairTable(shared.value, shards)
            dense, part = np.zeros(table.n, np.int64), 0
            for b in batches:
                part = int(b["part"].iloc[0])
                for pairs, docs in zip(b["pairs"], b["docs"], strict=True):
                    pair, n = np.frombuffer(pairs, "<u8").astype(np.int64), np.frombuffer(docs, "<u4").astype(np.int64)
                    slot = table.slots(pair)
                    dense[slot[slot >= 0]] += n[slot >= 0]              # a chunk holds a pair once
            held = sorted(shared.value, key=lambda r: r[0])
            ends = _starts([int(np.bitwise_count(np.frombuffer(r[2], np.uint8)).sum()) for r in held])
            shard = [r[0] for r in held]
            for k in range(len(shard)):
                vector = dense[ends[k]:ends[k + 1]]
                if vector.any():
                    yield pd.DataFrame({"shard": [shard[k]], "part": [part], "vector": [vector.astype("<i8").tobytes()]})

        sums = _summed(saved(chunks.mapInPandas(run, "shard long, part long, vector binary")))
        counted = sums if counted is None else counted.unionByName(sums)
    if counted is None:
        return hashes.withColumn("counts", F.lit(None).cast("binary")), shards
    return saved(hashes.join(counted.withColumnRenamed("vector", "counts"), "shard")), shards


def _best(counts: DataFrame, n_a: int, n_b: int) -> np.ndarray:
    """Highest count of a pair of each A id; the vocabulary bounds its size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = np.zeros(n_a, np.int64)
            for keys, n in zip(b["keys"], b["counts"], strict=True):
                np.maximum.at(best, np.frombuffer(keys, "<u8").astype(np.int64) // n_b, np.frombuffer(n, "<i8"))
            a = np.flatnonzero(best)
            yield pd.DataFrame({"a": a, "n": best[a]})

    out = np.zeros(n_a, np.int64)
    for r in counts.where("counts IS NOT NULL").select("keys", "counts").mapInPandas(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


def _scorer(shared, best, a_path: str, b_path: str, shards: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = PairTable(shared.value, shards)
        size_a, size_b = _sizes(a_path, b_path)
        for batch in batches:
            for at in _starts_of(batch["n_links"].to_numpy()):
                part = batch.iloc[at]
                a = [_unpack(x, n) for x, n in zip(part["a"], part["n_a"], strict=True)]
                b = [_unpack(x, n) for x, n in zip(part["b"], part["n_b"], strict=True)]
                pair, first, _ = _pairs_of(a, b, size_a, size_b)
                own, back = np.unique(pair, return_inverse=True)
                count = table.lookup(own)
                top = (count > 0) & (count == best.value[own // len(size_b)])
                yield pd.DataFrame({"row": part["row"].to_numpy(), "n_best": np.add.reduceat(top[back].astype(np.int64), first[:-1]),
                                    "count_sum": np.add.reduceat(count[back], first[:-1])})

    return run


def _starts_of(links_of: np.ndarray) -> Iterator[slice]:
    """Row slices of about ``CHUNK_BYTES`` links."""
    low = total = 0
    for k, n in enumerate(links_of):
        if k > low and total + n > CHUNK_BYTES:
            yield slice(low, k)
            low, total = k, 0
        total += n
    if low < len(links_of):
        yield slice(low, len(links_of))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text",
          block: int = BLOCK, shard_pairs: int = SHARD) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A text that is null or empty, or that one tokenizer does not give back
    byte for byte, has no tokens: zeros and an empty ``groups_sha256``.
    Repeated rows and null keys count and are returned like any other row; an
    empty table gives an empty one.  Other columns of ``docs`` are not read.
    Texts are aligned whole; a very long one is a chunk of its own, and its
    task holds some tens of bytes a byte of it.  Ties for an A id's highest
    count are all best.
    """
    rows = encoded(docs, a_path, b_path, key, text)
    counts, shards = pair_counts(rows, block, shard_pairs)
    size_a, size_b = _sizes(a_path, b_path)
    sc = docs.sparkSession.sparkContext
    best = sc.broadcast(_best(counts, len(size_a), len(size_b)))
    step = max(1, block // shard_pairs)
    full = rows.where("n_links > 0").select("row", "n_links", "n_a", "n_b", "a", "b")
    sums: DataFrame | None = None
    for low in range(0, shards, step):
        held = _block(counts, low, low + step, ["keys", "counts"])
        if held:
            run = _scorer(sc.broadcast(held), best, a_path, b_path, shards)
            part = saved(full.mapInPandas(run, "row long, n_best long, count_sum long"))
            sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        sums = rows.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).where("false")
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return rows.select("row", "key", *figures).join(sums, "row", "left") \
        .select(F.col("key").alias(key), *figures[:-1], F.coalesce("n_best", F.lit(0)).alias("n_best"),
                F.coalesce("count_sum", F.lit(0)).alias("count_sum"), figures[-1])

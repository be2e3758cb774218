"""Removal of byte strings that occur more than once anywhere in the corpus.

Every byte is removed that lies in a string of ``LENGTH`` bytes which also
starts elsewhere.  The question is asked of each suffix (place in a text): is
its first ``LENGTH`` bytes some other suffix's too?

Sorting all suffixes would shuffle many times the corpus, so suffixes are
compared in the manner of a blockwise construction with a cover sample:

* The cover sample is a set of places such that every string of ``LENGTH``
  bytes holds one, and equal strings hold it at the same offset: the place of
  the least hash of ``GRAM`` bytes in the string.  (Periodic covers, modulo v,
  give the second property only for pairs of places and keep 9 % of all
  places at this length, against 1.4 %; see the README.)
* All suffixes that are covered by one sample place form a block with it, and
  each block is resolved by ranks (hashes) of what surrounds its sample place:
  a suffix is never compared byte by byte beyond its block's rank.
* What one level of ranks leaves open goes to the next, finer level: blocks,
  then parts of ``PART`` suffixes, then single suffixes.  Each level is one
  shuffle of short rows, reduced before they meet, so no bucket of suffixes
  is ever held by one task, however many copies it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from marketpulse.llm.common import saved, saved_by

LENGTH = 200
GRAM = 32
PART = 16
#: Bytes that are searched for sample places at once (a bound on memory only).
SEGMENT = 1 << 19

_U = np.uint64
_rng = np.random.default_rng(200)
_SIGN = _rng.integers(0, 2 ** 64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = max(SEGMENT, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, 2 ** 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _rank(octets: bytes) -> int:
    """64 bits that stand for a byte string, as a signed number."""
    return xxhash.xxh3_64_intdigest(octets) - (1 << 63)


def _gram_hashes(octets: bytes) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place."""
    power, inverse = _power_table(len(octets))
    sums = np.zeros(len(octets) + 1, _U)
    np.cumsum(_SIGN[np.frombuffer(octets, np.uint8)] * power[:len(octets)], out=sums[1:])
    return _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(octets) - GRAM + 1])


def _sample(octets: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sample places of the joined texts that end at ``ends``.

    Returns (place, first suffix, number of suffixes, hash) of each: the
    suffixes, all with ``LENGTH`` bytes in their own text, that it covers."""
    width = LENGTH - GRAM + 1
    grams = _gram_hashes(octets)
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U)
    # the low bits hold the place, so equal hashes are told apart by order
    least, k = (grams & ~_U(0xFFFFFF)) | np.arange(len(grams), dtype=_U), 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    n = len(grams) - width + 1
    place = (np.minimum(least[:n], least[width - k:width - k + n]) & _U(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    at = np.flatnonzero(np.arange(n) + LENGTH <= ends[text])
    place, text = place[at], text[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(at) else at
    return place[new], at[new], np.diff(np.append(new, len(at))), grams[place[new]]


def _joined(texts: list[bytes], segment: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (number of the text, place in it, bytes) of about ``segment``
    bytes together.  Longer texts are cut with an overlap, so that each suffix
    is in one piece; a block that is cut is resolved by its parts."""
    out, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), segment - LENGTH + 1):
            piece = t[at:at + segment]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > segment and out:
                yield out
                out, size = [], 0
            out.append((k, at, piece))
            size += len(piece)
    if out:
        yield out


def _packed(start: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A block in one number: first suffix, offset of its sample place, number of suffixes."""
    return (start << 20) | (offset << 10) | count


def _blocks(rows: DataFrame, segment: int) -> DataFrame:
    """``rows`` (row, text) -> (row, block, key, rank): a row for each sample place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").encode("utf-8") for t in b["text"]]
            ids = b["row"].to_numpy()
            for part in _joined(texts, segment):
                octets = b"".join(p[2] for p in part)
                sizes = np.array([len(p[2]) for p in part])
                ends = np.cumsum(sizes)
                place, start, count, key = _sample(octets, ends)
                piece = np.searchsorted(ends, start, side="right")
                shift = np.array([p[1] for p in part])[piece] - (ends - sizes)[piece]
                yield pd.DataFrame({
                    "row": ids[np.array([p[0] for p in part])[piece]],
                    "block": _packed(start + shift, place - start, count),
                    "key": key.view(np.int64),
                    "rank": np.fromiter((_rank(octets[s:s + n - 1 + LENGTH]) for s, n in
                                         zip(start.tolist(), count.tolist(), strict=True)), np.int64, len(start)),
                })

    return rows.mapInPandas(run, "row long, block long, key long, rank long")


def _parts(text: bytes, block: int, key: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(block, key, rank) of the parts of ``size`` suffixes that a block has.

    Parts are counted from the sample place.  All suffixes of a part share its
    core, whose hash is the key: without another such core none has a match."""
    start, offset, count = block >> 20, block >> 10 & 1023, block & 1023
    place = start + offset
    for j in range((offset - count + 1) // size, offset // size + 1):
        first, last = max(start, place - (j + 1) * size + 1), min(start + count - 1, place - j * size)
        core = text[place - j * size:place - (j + 1) * size + 1 + LENGTH]
        yield (first << 20 | (place - first) << 10 | (last - first + 1),
               _rank(core + (j * (1 << 64) + (key + (1 << 63))).to_bytes(16, "little")), _rank(text[first:last + LENGTH]))


def _finer(rows: DataFrame, open_blocks: DataFrame, size: int) -> DataFrame:
    """The open blocks (row, block, key) cut into parts: (row, block, key, rank)."""
    wanted = open_blocks.groupBy("row").agg(F.collect_list(F.struct("block", "key")).alias("wanted")) \
        .select("row", F.col("wanted.block").alias("blocks"), F.col("wanted.key").alias("keys"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for row, text, blocks, keys in zip(b["row"], b["text"], b["blocks"], b["keys"], strict=True):
                octets = text.encode("utf-8")
                got += [(row, *p) for x, k in zip(blocks.tolist(), keys.tolist(), strict=True) for p in _parts(octets, x, k, size)]
                if len(got) > 200_000:
                    yield pd.DataFrame(got, columns=["row", "block", "key", "rank"])
                    got = []
            yield pd.DataFrame(got, columns=["row", "block", "key", "rank"], dtype="int64")

    return rows.join(wanted, "row").mapInPandas(run, "row long, block long, key long, rank long")


def _resolved(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks`` (row, block, key, rank) -> (blocks whose suffixes all occur
    elsewhere, blocks left open), both (row, block, key).

    A key that occurs once has no match.  If all blocks of a key have one
    rank, all match.  Of a key with several ranks, the blocks of a repeated
    rank match, and one block of each rank goes on to the next level."""
    # written first, so that the join's sides are plain shuffles, whose hot keys Spark can split
    keys = saved(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
                 .where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("several")))
    met = saved(blocks.join(keys, "key"))
    several = met.where("several")
    ranks = saved(several.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "block")).alias("one")))
    same = several.join(ranks.where("n > 1").select("key", "rank"), ["key", "rank"], "left_semi")
    done = met.where("NOT several").select("row", "block", "key").unionByName(same.select("row", "block", "key"))
    return done, ranks.select("one.row", "one.block", "key")


def repeated(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``rows`` (row: long, text) -> (row, block): blocks of suffixes whose
    first ``LENGTH`` bytes start anywhere else too."""
    whole, left = _resolved(saved(_blocks(rows, segment)))
    part, left = _resolved(saved(_finer(rows, left, PART)))
    single = saved(_finer(rows, left, 1))
    twice = saved(single.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "rank"))
    last = single.join(twice, ["key", "rank"], "left_semi")
    return whole.select("row", "block").unionByName(part.select("row", "block")).unionByName(last.select("row", "block"))


def _cut(text: bytes, blocks: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal removed runs, remaining bytes) of a text and its repeated blocks."""
    start, stop = blocks >> 20, (blocks >> 20) + (blocks & 1023) - 1 + LENGTH
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    runs = list(zip(start[new].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist(), strict=True))
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return runs, b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, n_bytes, spans: array of (start, end), kept: binary) for every row.

    Texts are taken as UTF-8 bytes; ``spans`` are the maximal removed runs and
    ``kept`` the other bytes, joined.  Matches never cross texts.  Null texts
    are empty.  Repeated rows match each other (texts of ``LENGTH`` bytes or
    more go whole); shorter texts are kept.  Null keys stay null; other columns
    are not read; an empty table gives an empty one.  A very long text is searched
    ``SEGMENT`` bytes at a time; its row holds it whole.  ``docs`` is read once:
    rows are numbered as they are written to the shared folder.
    """
    # dealt by row once: the texts do not move again, only blocks are brought to them
    rows = saved_by(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "row", "zstd")
    found = repeated(rows.select("row", "text"), segment).groupBy("row").agg(F.collect_list("block").alias("blocks"))

    @F.pandas_udf("n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    def run(texts: pd.Series, blocks: pd.Series) -> pd.DataFrame:
        out = []
        for t, b in zip(texts, blocks, strict=True):
            octets = (t or "").encode("utf-8")
            runs, kept = _cut(octets, np.asarray(b)) if b is not None and len(b) else ([], octets)
            out.append((len(octets), [{"start": x, "end": y} for x, y in runs], kept))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    return rows.join(found, "row", "left").select(F.col("key").alias(key), run("text", "blocks").alias("_cut")) \
        .select(key, "_cut.*")

"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints: 64 majority bits over the XXH64 values of a text's word
shingles.  Links: all fingerprint pairs within ``MAX_BITS`` differing bits.
Groups: connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketpulse.llm.common import packed, saved
from marketpulse.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Segment widths.  By the pigeonhole principle two fingerprints within 4
#: bits differ by at most 1 bit in one of the first two segments, or agree in
#: the third (2 + 2 + 1 > 4), so balls of 1 + 22, 1 + 21 and 1 keys find all.
SEGMENTS = (22, 21, 21)
#: From this many distinct fingerprints on, two segments: 562 keys a fingerprint
#: instead of 46, but a key then meets n / 2^32 others instead of n / 2^21.
#: Both are complete, so the result is the same.
WIDE_FROM, WIDE_SEGMENTS = 100_000_000, (32, 32)


def segment_widths(n: int) -> tuple[int, ...]:
    """Segment widths for ``n`` distinct fingerprints."""
    return SEGMENTS if n < WIDE_FROM else WIDE_SEGMENTS


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of one text as an unsigned int; no word (or null): 0."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else \
        map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64,
                    max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        octets = h[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp: long) for every row; a map over the rows, without a shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"key": b["key"], "fp": fp.view(np.int64)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")) \
        .mapInPandas(run, f"key {kind}, fp long")


def _segments(widths: tuple[int, ...]) -> list[tuple[int, int, Column]]:
    """(number, width, value of the segment in ``fp``), from the low bits up."""
    out, low = [], 0
    for k, width in enumerate(widths):
        out.append((k, width, F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))))
        low += width
    return out


def _radii(widths: tuple[int, ...], max_bits: int) -> list[int]:
    """Ball radius of each segment (-1: none); their sum plus one each exceeds max_bits."""
    a, b = divmod(max_bits, len(widths))
    return [a if k <= b else a - 1 for k in range(len(widths))]


def _ball(value: Column, width: int, radius: int) -> list[Column]:
    """All segment values within ``radius`` bits of ``value``."""
    masks, layer = [0], [(0, 0)]
    for _ in range(radius):
        layer = [(m | 1 << j, j + 1) for m, first in layer for j in range(first, width)]
        masks += [m for m, _ in layer]
    return [value.bitwiseXOR(F.lit(m)) if m else value for m in masks]


def _key(k: int, value: Column) -> Column:
    return value + F.lit(k << 56)


def _chains(fps: DataFrame, widths: tuple[int, ...], max_bits: int) -> DataFrame:
    """Links between neighbours in the sorted order of each exact segment
    match: at most one per fingerprint and segment.  They join most of a dense
    group of near copies, whose links would otherwise number its square."""
    table = fps.select("fp", F.explode(F.array(*[_key(k, v) for k, _, v in _segments(widths)])).alias("seg"))
    before = F.lag("fp").over(Window.partitionBy("seg").orderBy("fp"))
    return table.select(F.col("fp").alias("u"), before.alias("v")) \
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).distinct()


def link_components(fps: DataFrame, max_bits: int = MAX_BITS,
                    widths: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """``fps`` (fp: long, distinct) -> (fp, root: long), root the same for all
    fingerprints that links of ``max_bits`` or fewer differing bits connect.

    Round 1 links sorted neighbours that share a segment and labels their
    components.  Round 2 is the complete multi-index search: every
    fingerprint looks up the small Hamming balls of its segments in the table
    of all segments, and the join condition verifies the whole distance.
    Pairs that round 1 has already put in one component cannot change the
    result, so the join leaves them out and emits no pairs inside a group.
    """
    first = components(_chains(fps, widths, max_bits))
    named = saved(fps.join(first.withColumnRenamed("node", "fp"), "fp", "left")
                  .select("fp", F.coalesce("root", "fp").alias("c")))
    segs = _segments(widths)
    table = named.select(F.col("fp").alias("tfp"), F.col("c").alias("tc"),
                         F.explode(F.array(*[_key(k, v) for k, _, v in segs])).alias("seg"))
    keys = [_key(k, x) for (k, width, v), r in zip(segs, _radii(widths, max_bits), strict=True)
            if r >= 0 for x in _ball(v, width, r)]
    probes = named.select("fp", "c", F.explode(F.array(*keys)).alias("seg"))
    links = probes.join(table, (probes["seg"] == table["seg"]) & (probes["fp"] < table["tfp"])
                        & (probes["c"] != table["tc"])
                        & (F.bit_count(probes["fp"].bitwiseXOR(table["tfp"])) <= max_bits)) \
        .select(F.col("c").alias("u"), F.col("tc").alias("v")).distinct()
    second = components(links)
    return named.join(second.withColumnRenamed("node", "c"), "c", "left") \
        .select("fp", F.coalesce("root", "c").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    widths: tuple[int, ...] | None = None) -> DataFrame:
    """(doc_id, fp: long, component_id) for every row of ``docs``.

    ``widths``: segment widths of the search; by default they follow the number
    of distinct fingerprints.  The result does not depend on them.

    ``component_id`` is the least key reachable over links of ``max_bits`` or
    fewer differing bits.  Equal fingerprints are one node, so copies are
    grouped before anything is joined.  Null or wordless texts have
    fingerprint 0 and are linked like any other; repeated rows are returned
    as often as they come; null keys are ignored when the least key is taken,
    so a component of null keys alone has a null id.  A very long text is
    fingerprinted whole, in its row.  An empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    rows = saved(fingerprints(docs, key, text, shingle))
    least = saved(rows.groupBy("fp").agg(F.min("key").alias("key")))
    root = saved(link_components(least.select("fp"), max_bits, widths or segment_widths(least.count())))
    # written first, so that the join below is dealt anew and a large component can be split
    ids = saved(root.join(least, "fp").groupBy("root").agg(F.min("key").alias("component_id")))
    label = root.join(ids, "root").select("fp", "component_id")
    return rows.join(label, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the least key stays (null keys last; of equal keys the first row).

    Null and wordless texts are one group.  The columns are those of ``docs``,
    which is read once: rows are numbered as they are written to the shared
    folder.  Only the numbers of dropped rows are joined to the texts."""
    rows = saved(packed(docs).withColumn("row", F.monotonically_increasing_id()))
    group = near_duplicates(rows.select("row", F.col("doc")[text].alias("text")), "row", "text", shingle, max_bits)
    named = saved(rows.select("row", F.col("doc")[key].alias("key")).join(group.select("row", "component_id"), "row"))
    first = saved(named.groupBy("component_id").agg(F.min(F.struct(F.isnull("key").alias("none"), "key", "row")).alias("first")))
    dropped = named.join(first, "component_id").where("row <> first.row").select("row")
    return rows.join(dropped, "row", "left_anti").select("doc.*")

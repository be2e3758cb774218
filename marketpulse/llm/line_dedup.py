"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketpulse.llm.common import packed, saved

#: A line is boilerplate on more than this share of its host's pages, distinct texts.  In sf0.1 the shared
#: line stands on 8.6 to 13.2 % of the pages of each of the 20 sources (9.2 to 13.9 % after the quality
#: rules), the next line on 4.8 % at most (5.1 %) ...
RATIO_PCT = 6
#: ... and on at least this many of them: what one or two pages hold is no boilerplate.
MIN_PAGES = 3

SPACES = " \t\n\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits that stand for a line in the shuffles."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _page(body: Column, host: str) -> tuple[Column, Column]:
    """Host and distinct line digests of a row's text."""
    return F.coalesce(F.col("doc")[host].cast("string"), F.lit("")).alias("host"), F.array_distinct(
        F.transform(F.filter(_lines(body), lambda x: _bare(x) != ""), lambda x: _digest(_bare(x)))).alias("lines")


def boilerplate(pages: DataFrame, ratio_pct: int = RATIO_PCT, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (host, lines: array of distinct digests) -> (host, line) of boilerplate.

    Pages per line and per host are counted with map-side partial sums, so
    neither a hot host nor a hot line meets in one task; the join sees only
    lines that reached ``min_pages``."""
    counts = pages.select("host", F.explode("lines").alias("line")) \
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(totals, "host").where(100 * F.col("n") > ratio_pct * F.col("pages")).select("host", "line")


def cleaned(docs: DataFrame, host: str = "source", text: str = "text",
            ratio_pct: int = RATIO_PCT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(doc, n_lines, n_dropped): each row of ``docs`` as a struct, its text
    without boilerplate lines, and the numbers (long) of its lines and of those dropped.

    A page is a distinct text of its host, so copies of a text and repeated rows
    count once: else a text that is copied often would be boilerplate.  Lines are
    compared without surrounding white space; blank lines are neither counted as
    boilerplate nor dropped, and a line that occurs several times on a page counts
    once but is dropped each time.  A null host is the site with the empty name.
    Null texts stay null (no lines) and count as the empty page.  A text that is
    boilerplate throughout becomes empty.  A line has to stand on ``min_pages``
    pages, so hosts of fewer distinct texts keep all their lines.  A very long text
    is split in its row.  An empty table gives an empty one.  ``docs`` is read
    once: rows are numbered as they are written to the shared folder.
    """
    body = F.col("doc")[text]
    rows = saved(packed(docs).withColumn("row", F.monotonically_increasing_id()))
    pages = rows.select("row", *_page(body, host))
    # partial first rows before the shuffle, so copies of a hot text do not meet
    counted = rows.select(*_page(body, host), _digest(F.coalesce(body, F.lit(""))).alias("text")) \
        .groupBy("host", "text").agg(F.first("lines").alias("lines")).select("host", "lines")
    bad = boilerplate(counted, ratio_pct, min_pages)
    hits = pages.select("row", "host", F.explode("lines").alias("line")).join(bad, ["host", "line"]) \
        .groupBy("row").agg(F.collect_set("line").alias("bad"))

    def keeps(x: Column) -> Column:
        return (_bare(x) == "") | ~F.array_contains("bad", _digest(_bare(x)))

    left = F.when(F.col("bad").isNull(), _lines(body)).otherwise(F.filter(_lines(body), keeps))
    n = F.when(body.isNull(), F.lit(0)).otherwise(F.size(_lines(body))).cast("long")
    return rows.join(hits, "row", "left").withColumn("left", left).select(
        F.col("doc").withField(text, F.when(body.isNotNull(), F.array_join("left", "\n"))).alias("doc"), n.alias("n_lines"),
        F.when(body.isNull(), F.lit(0)).otherwise(n - F.size("left")).cast("long").alias("n_dropped"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                     ratio_pct: int = RATIO_PCT, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; see ``cleaned``."""
    return cleaned(docs, host, text, ratio_pct, min_pages).select("doc.*")

"""Scrape pipeline (C8): page texts -> (author, date, title) triples.

S7 extracts the texts of each page in order; W11 forms overlapping triples
with two ``lead`` windows over (page, pos) and keeps those whose middle
text is a short date; W10 then keeps the first triple of each title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.scalars import SHORT_DATE_PATTERN, is_short_date
from marketpulse.operators import tables as tb
from marketpulse.sources.files import extract_texts


def triples(texts: DataFrame, page: str = "page_id", pos: str = "pos", text: str = "text",
            pattern: str = SHORT_DATE_PATTERN) -> DataFrame:
    """(page, pos, Youtuber, Date, Title) for every position whose next
    text matches ``pattern``; windows overlap, the last two positions have
    no triple."""
    w = Window.partitionBy(page).orderBy(pos)
    t = texts.select(page, pos, F.col(text).alias("Youtuber"),
                     F.lead(text, 1).over(w).alias("Date"),
                     F.lead(text, 2).over(w).alias("Title"))
    return t.where(F.col("Title").isNotNull() & is_short_date(F.col("Date"), pattern))


def extract_triples(pages: DataFrame, html_col: str = "html", key: str = "page_id",
                    css_class: str = "Text", inner_tag: str = "div",
                    pattern: str = SHORT_DATE_PATTERN, per_page: bool = False) -> DataFrame:
    """First triple per title.  Titles are deduplicated per page when
    ``per_page`` (one scrape = one page) or across all pages otherwise;
    "first" is page order, then position."""
    texts = extract_texts(pages, html_col, key, css_class, inner_tag)
    tr = triples(texts, key, "pos", "text", pattern)
    keys = [key, "Title"] if per_page else ["Title"]
    return tb.first_per_key(tr, keys, [key, "pos"]).select(key, "pos", "Youtuber", "Date", "Title")

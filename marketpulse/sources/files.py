"""File and JSON sources.

Every scan has a declared schema; CSV text is read as strings and typed
with built-in expressions, so nothing is inferred and bad values surface
as nulls (lenient) or errors (strict).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.functions.scalars import (
    epoch_to_local, millis_to_date, normalise_keywords, null_tokens, strip,
)

NEWS_COLUMNS = ["timestamp", "published_at", "title", "body", "url", "keywords"]


def _csv(spark: SparkSession, path, schema, multi_line: bool = True) -> DataFrame:
    """``multi_line``: fields may hold line breaks, so a file is one split."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("encoding", "UTF-8")
            .csv(path))


#: Columns that order the records of news files as they were written.
FILE_ORDER = ["_file", "_pos"]


def _in_file_order(scan: DataFrame) -> DataFrame:
    """``scan`` with ``FILE_ORDER``.  A multi-line file is one split and a task
    reads its records in order, so the numbers of a file's records increase."""
    return scan.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_pos"))


def read_csv(spark: SparkSession, path, columns: Sequence[str]) -> DataFrame:
    """A written CSV (S8) of text columns, as it was written (empty text is null)."""
    return _csv(spark, path, ", ".join(f"`{c}` string" for c in columns))


def read_news(spark: SparkSession, path) -> DataFrame:
    """Lenient news scan.

    Columns renamed by position; null tokens become null; an unparseable
    time becomes null; rows lacking published_at, title or body are dropped.
    Every data row is read (the header is the only row skipped).  ``_file`` and
    ``_pos`` order rows as the files have them.
    """
    scan = _csv(spark, path, schemas.NEWS_CSV)
    raw = _in_file_order(scan.select(*[F.col(c).alias(n) for c, n in zip(schemas.NEWS_CSV.fieldNames(), NEWS_COLUMNS, strict=True)]))
    cleaned = raw.select(*[null_tokens(c).alias(c) for c in NEWS_COLUMNS], *FILE_ORDER)
    typed = cleaned.select(
        F.col("timestamp").try_cast("long").alias("timestamp"),
        F.try_to_timestamp(F.col("published_at"), F.lit("yyyy-MM-dd HH:mm:ss"))
         .cast("timestamp_ntz").alias("published_at"),
        "title", "body", "url", "keywords", *FILE_ORDER)
    return typed.na.drop(subset=["published_at", "title", "body"])


def read_news_strict(spark: SparkSession, path) -> DataFrame:
    """Strict scan by header names; a malformed time raises an error.

    Text is kept as written (no null tokens).  Deduplication by title is
    left to ``tables.first_per_key`` in the input's own order ``FILE_ORDER``:
    file path (``_file``), then the record's place in the file (``_pos``).
    """
    raw = _in_file_order(_csv(spark, path, schemas.NEWS_CSV))
    return raw.select(
        F.to_timestamp(F.col("Published Time"), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("published_at"),
        F.coalesce(F.col("Title"), F.lit("")).alias("title"),
        F.coalesce(F.col("Body"), F.lit("")).alias("body"),
        *FILE_ORDER,
        F.col("Timestamp").try_cast("long").alias("timestamp"))


def read_prices(spark: SparkSession, directory: str, symbols: Sequence[str] | None = None,
                quote: str = "USDT") -> DataFrame:
    """S3: all ``{SYM}{quote}_historical_prices.csv`` files in one scan.

    The symbol comes from the file name; ``symbols`` (if given) is applied as
    a filter on it.  A header-only file gives no rows.
    """
    raw = _csv(spark, f"{directory}/*{quote}_historical_prices.csv", schemas.PRICE_CSV, multi_line=False)
    # a plain file ``BTCUSDT_historical_prices.csv`` or a folder of that
    # name written by Spark (``[file=]BTCUSDT_historical_prices.csv/part-*``)
    sym = F.regexp_extract(F.col("_metadata.file_path"),
                           rf"([^/=]+){quote}_historical_prices\.csv(/[^/]*)?$", 1)
    df = raw.select(
        sym.alias("symbol"),
        F.to_timestamp(F.col("Date")).cast("timestamp_ntz").alias("Date"),
        *[F.col(c).try_cast("double").alias(c) for c in ["Open", "High", "Low", "Close", "Volume"]])
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    return df


def price_files(spark: SparkSession, directory: str, quote: str = "USDT") -> DataFrame:
    """(symbol) of every price file under ``directory``, from the listing alone:
    no file is opened, so a header-only file is one like any other."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    symbol = F.regexp_extract("path", rf"([^/=]+){quote}_historical_prices\.csv(/[^/]*)?$", 1)
    return listed.select(symbol.alias("symbol")).where("symbol <> ''").distinct()


def missing_symbols(spark: SparkSession, directory: str, symbols: Sequence[str], quote: str = "USDT") -> DataFrame:
    """S3 notice: wanted symbols that have no price file."""
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return wanted.join(price_files(spark, directory, quote), "symbol", "left_anti")


def decode_articles(df: DataFrame, json_col: str, tz: str = "Asia/Taipei") -> DataFrame:
    """Article-list JSON -> (timestamp, published_time, title, body, url, keywords).

    ``published_time`` is the publication instant as wall clock in ``tz``;
    keywords are normalised (P11) from a VARIANT so non-text values give N/A.
    """
    parsed = df.select(F.parse_json(F.col(json_col)).alias("_j"))
    items = parsed.select(F.explode(F.variant_get("_j", "$.Data", "array<variant>")).alias("a"))
    return items.select(
        F.variant_get("a", "$.PUBLISHED_ON", "long").alias("timestamp"),
        epoch_to_local(F.variant_get("a", "$.PUBLISHED_ON", "long"), tz).alias("published_time"),
        F.variant_get("a", "$.TITLE", "string").alias("title"),
        F.variant_get("a", "$.BODY", "string").alias("body"),
        F.variant_get("a", "$.URL", "string").alias("url"),
        normalise_keywords(F.try_variant_get("a", "$.KEYWORDS", "variant")).alias("keywords"))


def _others(df: DataFrame, json_col: str) -> list[str]:
    return [c for c in df.columns if c != json_col]


def decode_candles(df: DataFrame, json_col: str, tz: str = "UTC") -> DataFrame:
    """Kline JSON (array of arrays) -> the row's other columns (symbol, ...)
    and (Date, Open, High, Low, Close, Volume)."""
    keep = _others(df, json_col)
    rows = df.select(*keep, F.explode(F.from_json(F.col(json_col), "array<array<string>>")).alias("_k"))
    return rows.select(
        *keep, millis_to_date(F.col("_k")[0].cast("long"), tz).alias("Date"),
        *[F.col("_k")[i].alias(n) for i, n in enumerate(["Open", "High", "Low", "Close", "Volume"], 1)])


def decode_listings(df: DataFrame, json_col: str) -> DataFrame:
    """Listing JSON -> the row's other columns (the response's key, ...)
    and one row per coin in response order (pos, symbol)."""
    keep = _others(df, json_col)
    schema = "struct<data: array<struct<symbol: string>>>"
    parsed = df.select(*keep, F.from_json(F.col(json_col), schema).alias("_j"))
    return parsed.select(*keep, F.posexplode("_j.data").alias("pos", "_c")).select(*keep, "pos", F.col("_c.symbol").alias("symbol"))


def _joined(fragments: list[str]) -> str:
    """Text of an element: each text fragment stripped, empty ones dropped."""
    return "".join(f.strip() for f in fragments if f.strip())


def _extract_page(html: str, css_class: str, inner_tag: str) -> list[str]:
    """Texts of the first ``inner_tag`` inside each element of ``css_class``."""
    from html.parser import HTMLParser

    skipped = {"script", "style"}
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack = []      # open tags: [tag, is_target, target_id]
            self.open_targets = []   # per open target element: state dict
            self.out = []

        def handle_starttag(self, tag, attrs):
            self.cut()
            classes = (dict(attrs).get("class") or "").split()
            is_target = css_class in classes
            for st in self.open_targets:
                if st["inner_depth"] is None and not st["done"] and tag == inner_tag:
                    st["inner_depth"] = len(self.stack) + 1
                    st["buf"] = []
            if tag in void:
                return
            self.stack.append(tag)
            if is_target:
                slot = len(self.out)
                self.out.append(None)
                self.open_targets.append({"depth": len(self.stack), "inner_depth": None,
                                          "buf": None, "done": False, "slot": slot})

        def cut(self):
            """A tag or comment ends the text fragment before it."""
            for st in self.open_targets:
                if st["buf"]:
                    st["buf"].append("")

        def handle_comment(self, data):
            self.cut()

        def handle_endtag(self, tag):
            self.cut()
            if tag not in self.stack:
                return
            while self.stack:
                depth = len(self.stack)
                t = self.stack.pop()
                for st in self.open_targets:
                    if st["inner_depth"] == depth and not st["done"]:
                        st["done"] = True
                        self.out[st["slot"]] = _joined(st["buf"])
                self.open_targets = [s for s in self.open_targets if s["depth"] < depth
                                     or s["depth"] > len(self.stack) + 1]
                self.open_targets = [s for s in self.open_targets if s["depth"] <= len(self.stack)]
                if t == tag:
                    break

        def handle_data(self, data):
            if self.stack and self.stack[-1] in skipped:
                return
            for st in self.open_targets:
                if st["inner_depth"] is not None and not st["done"]:
                    if st["buf"]:  # the parser may hand over one text in parts
                        st["buf"][-1] += data
                    else:
                        st["buf"].append(data)

        def close(self):
            super().close()
            for st in self.open_targets:
                if st["inner_depth"] is not None and not st["done"]:
                    self.out[st["slot"]] = _joined(st["buf"])

    p = P()
    p.feed(html or "")
    p.close()
    return [x for x in p.out if x is not None]


def extract_texts(pages: DataFrame, html_col: str = "html", key: str = "page_id",
                  css_class: str = "Text", inner_tag: str = "div") -> DataFrame:
    """(key, pos, text) for each element of ``css_class`` (page order)
    that has a descendant ``inner_tag``: that descendant's stripped text.

    Runs per partition over Arrow batches (``mapInPandas``); no shuffle.
    """
    key_t = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ks, ps, ts = [], [], []
            for k, h in zip(pdf[key], pdf[html_col]):
                for i, t in enumerate(_extract_page(h, css_class, inner_tag)):
                    ks.append(k)
                    ps.append(i)
                    ts.append(t)
            if ks:
                yield pd.DataFrame({key: pd.Series(ks, dtype=pdf[key].dtype),
                                    "pos": pd.Series(ps, dtype="int64"),
                                    "text": pd.Series(ts, dtype="object")})

    out = pages.select(key, html_col).mapInPandas(run, f"{key} {key_t}, pos long, text string")
    return out.withColumn("text", strip("text"))

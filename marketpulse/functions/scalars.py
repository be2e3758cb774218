"""Scalar functions (P1–P21) as built-in Column expressions.

Every function returns a ``Column`` built from ``pyspark.sql.functions``, so
it stays inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's for equal results)
# ---------------------------------------------------------------------------

# Default texts for missing title, content, time and link.
NO_TITLE = "無標題"
NO_CONTENT = "無內容"
NO_TIME = "未知時間"
NO_LINK = "無連結"

# Text tokens read as missing by the lenient CSV scan (pandas' default set).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Coin names and their tickers, replaced in this order.
COIN_TRANSLATION = [
    ("比特幣", "BTC"),
    ("以太幣", "ETH"),
    ("以太坊", "ETH"),
    ("狗狗幣", "DOGE"),
    ("柴犬幣", "SHIB"),
    ("幣安幣", "BNB"),
    ("瑞波幣", "XRP"),
    ("索拉納", "SOL"),
    ("波卡", "DOT"),
    ("萊特幣", "LTC"),
]

# Short date m/d/yy as shown on the scraped page.
SHORT_DATE_PATTERN = r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/\d{2}$"

# Python's str.split() whitespace set, spelled so Java and RE2 agree.
WHITESPACE_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD_PATTERN = f"[^{WHITESPACE_CLASS}]+"
# The same words by the ranges of their characters, common ones first: Java asks
# each part of a class in turn, for every character of a text.
WORD_RANGES = (r"[!-\x{84}\x{A1}-\x{167F}\x{3001}-\x{10FFFF}\x{00}-\x{08}\x{0E}-\x{1B}\x{86}-\x{9F}\x{1681}-\x{1FFF}"
               r"\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}]+")
# The same set as single characters, for translate().
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")

# Digits of the source's decimal arithmetic (Python's default context).
QUANTIZE_DIGITS = 28

TEXT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
SOURCE_ZONE = "Asia/Taipei"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_key(title: ColumnOrName, body: ColumnOrName) -> Column:
    """Lower-hex MD5 of title + body (UTF-8, no separator)."""
    return F.md5(F.concat(_c(title), _c(body)))


def document_text(title: ColumnOrName, body: ColumnOrName) -> Column:
    """``title + "\\n" + body``."""
    return F.concat(_c(title), F.lit("\n"), _c(body))


def pair_symbol(sym: ColumnOrName, quote: str = "USDT") -> Column:
    """Trading pair of a symbol."""
    return F.concat(_c(sym), F.lit(quote))


def quantize_half_up(x: ColumnOrName, places: int = 8, precision: int = 20) -> Column:
    """decimal(precision, places), rounding half up (cast semantics)."""
    return _c(x).cast(f"decimal({precision},{places})")


def quantize_half_even(x: ColumnOrName, places: int = 8, precision: int = 20) -> Column:
    """P5: decimal of ``places`` places, rounding half to even; null stays null.

    ``precision`` is the least number of digits: the type holds at least
    ``QUANTIZE_DIGITS``, as the source's decimals do, so a value too large for the
    stored column is quantised like any other (Q5 says whether it fits there).
    """
    return F.bround(_c(x), places).cast(f"decimal({max(precision, QUANTIZE_DIGITS)},{places})")


def volume_or_null(v: ColumnOrName) -> Column:
    """A zero volume is stored as null."""
    return F.when(_c(v) != 0, _c(v))


def null_tokens(c: ColumnOrName, tokens=NULL_TOKENS) -> Column:
    """Text tokens meaning "missing" become null."""
    return F.when(~_c(c).isin(list(tokens)), _c(c))


def _wall_seconds(ntz: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, from its fields: no session zone is involved."""
    return (F.unix_date(ntz.cast("date")).cast("double") * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60
            + F.extract(F.lit("SECONDS"), ntz).cast("double"))


def _utc_wall(seconds: Column) -> Column:
    """Wall-clock time in UTC (without zone) of an epoch time."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def to_epoch(ts: ColumnOrName, tz: str = "UTC") -> Column:
    """Wall-clock time in zone ``tz`` -> epoch seconds (double)."""
    return _wall_seconds(F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts).cast("timestamp_ntz")))


def ts_text(ts: ColumnOrName) -> Column:
    """Standard text form ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_c(ts), TEXT_TS_FORMAT)


def epoch_to_local(s: ColumnOrName, tz: str = SOURCE_ZONE) -> Column:
    """Epoch seconds -> wall clock in ``tz`` as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), _utc_wall(_c(s))), TEXT_TS_FORMAT)


def millis_to_date(ms: ColumnOrName, tz: str = "UTC") -> Column:
    """P10: epoch milliseconds -> local date text ``yyyy-MM-dd``."""
    seconds = _c(ms).cast("decimal(20,0)") / F.lit(1000)
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), _utc_wall(seconds)).cast("date"), "yyyy-MM-dd")


def normalise_keywords(v: ColumnOrName) -> Column:
    """A text value has ',' replaced by '|'; missing or non-text -> 'N/A'.

    ``v`` is a VARIANT (so a number is not mistaken for text)."""
    is_text = F.schema_of_variant(_c(v)) == F.lit("STRING")
    return F.when(is_text, F.replace(F.variant_get(_c(v), "$", "string"), F.lit(","), F.lit("|")))\
            .otherwise(F.lit("N/A"))


def or_default(c: ColumnOrName, text: str) -> Column:
    """Missing value -> default text."""
    return F.coalesce(_c(c), F.lit(text))


def translate_coins(c: ColumnOrName, lexicon=COIN_TRANSLATION) -> Column:
    """Sequential literal replacements, in lexicon order."""
    out = _c(c)
    for src, dst in lexicon:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def is_short_date(c: ColumnOrName, pattern: str = SHORT_DATE_PATTERN) -> Column:
    """Text matches the m/d/yy pattern."""
    return _c(c).rlike(pattern)


def blanks_to_space(c: ColumnOrName) -> Column:
    """Every character of Python's whitespace set replaced by a plain space
    (a per-character table lookup, much cheaper than a large regex class)."""
    return F.translate(_c(c), WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))


def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.regexp_count(blanks_to_space(c), F.lit("[^ ]+"))


def _text_or_none(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit("None"))


def indicator_line(sym, date, rsi, macd, sig, up, mid, low) -> Column:
    """One line of indicator text per symbol; missing values print None."""
    return F.concat(
        _c(sym), F.lit("（"), F.date_format(_c(date), "yyyy-MM-dd"), F.lit("）：RSI="), _text_or_none(rsi),
        F.lit(", MACD="), _text_or_none(macd), F.lit(", Signal="), _text_or_none(sig),
        F.lit(", BB(上/中/下)="), _text_or_none(up), F.lit("/"), _text_or_none(mid),
        F.lit("/"), _text_or_none(low))


def source_line(title: ColumnOrName, url: ColumnOrName) -> Column:
    """``{title} : {url}``."""
    return F.concat(_c(title), F.lit(" : "), _c(url))


def iso_timestamp(ts: ColumnOrName) -> Column:
    """ISO-8601 text; microseconds printed only when non-zero."""
    frac = F.unix_micros(_c(ts).cast("timestamp")) % 1_000_000
    return F.when(frac == 0, F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss"))\
            .otherwise(F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def json_list_or(c: ColumnOrName, default=("BTC",)) -> Column:
    """Parse a JSON array of strings; anything else -> ``default``."""
    parsed = F.from_json(F.trim(_c(c)), "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array(*[F.lit(x) for x in default]))


def preview(c: ColumnOrName, n: int = 200) -> Column:
    """P20: first ``n`` characters."""
    return F.substring(_c(c), 1, n)


def strip(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace (Python ``str.strip``)."""
    return F.regexp_replace(_c(c), f"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$", "")

"""Filters, predicates and data-quality checks.

Checks return the violating rows (a DataFrame), so they run distributed and
can be counted, written or joined like any other result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from marketpulse.functions.scalars import word_count

# The eleven symbols of the partitioned price and indicator
# tables, and the stablecoin symbols excluded from the listing ranking.
SYMBOLS = ["BTC", "BNB", "ADA", "DOGE", "ETH", "HBAR", "LTC", "SOL", "TRX", "XLM", "XRP"]
STABLECOINS = ["USDT", "USDC", "DAI", "BUSD", "TUSD", "LUSD", "GUSD", "PAX"]
SENDERS = ["user", "bot"]


def dropna(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """drop rows null in any of ``subset``."""
    return df.na.drop(subset=list(subset))


def by_key(df: DataFrame, col: str, value) -> DataFrame:
    """equality selection (pushed to the Parquet scan / partition filter)."""
    return df.where(F.col(col) == F.lit(value))


def since(df: DataFrame, ts_col: str, now, days: float = 3) -> DataFrame:
    """keep rows with ``ts_col >= now - days`` (inclusive).

    ``ts_col`` may be a timestamp or epoch seconds; ``now`` is a parameter
    (a datetime, or epoch seconds for numeric columns).
    """
    field = df.schema[ts_col].dataType
    if isinstance(field, NumericType):
        now_s = now.timestamp() if isinstance(now, dt.datetime) else float(now)
        return df.where(F.col(ts_col) >= F.lit(now_s - days * 86400.0))
    floor = F.lit(now) - F.expr(f"INTERVAL {int(days * 86400)} SECONDS")
    return df.where(F.col(ts_col) >= floor)


def exclude(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """rows whose ``col`` is not in ``values`` (a null is kept out too)."""
    return df.where(~F.col(col).isin(list(values)))


def exclude_table(df: DataFrame, other: DataFrame, col: str, other_col: str | None = None) -> DataFrame:
    """Set exclusion against a table (left anti join)."""
    other_col = other_col or col
    return df.join(other.select(F.col(other_col).alias("_x")), F.col(col) == F.col("_x"), "left_anti")


def title_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """``col LIKE prefix || '%'``."""
    return df.where(F.col(col).startswith(prefix))


def missing(c: Column) -> Column:
    """Null or empty text (what ``not value`` rejects for text fields)."""
    return c.isNull() | (c.cast("string") == F.lit(""))


def require(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """split into (valid, rejected) on "every field present and non-empty"."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | missing(F.col(c))
    flagged = df.withColumn("_bad", bad)
    return (flagged.where(~F.col("_bad")).drop("_bad"),
            flagged.where(F.col("_bad")).drop("_bad"))


def short_text(col: str, n: int = 30) -> Column:
    """fewer than ``n`` words."""
    return word_count(col) < n


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F8: fail at plan-build time when a needed column is absent."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q1: rows with a null in any of ``cols``, with the offending column names."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.withColumn("violations", names).where(F.size("violations") > 0)


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q2: key values present more than once, with their count."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_domain(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Q3/Q6: rows whose ``col`` is outside ``values`` (null passes, as in CHECK)."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(values)))


def check_fk(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Q4: child rows whose non-null key has no parent row."""
    keys = parent.select(F.col(parent_col).alias("_pk"))
    return (child.where(F.col(child_col).isNotNull())
                 .join(keys, F.col(child_col) == F.col("_pk"), "left_anti"))


def check_fits(df: DataFrame, col: str, sql_type: str) -> DataFrame:
    """Q5: rows whose value does not fit ``sql_type`` (varchar(n) / decimal(p,s))."""
    t = sql_type.strip().lower()
    if t.startswith("varchar"):
        n = int(t[t.index("(") + 1:t.index(")")])
        return df.where(F.length(F.col(col)) > n)
    return df.where(F.col(col).isNotNull() & F.col(col).try_cast(t).isNull())

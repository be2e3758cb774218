"""Coin mentions per text (U4, with P13 and P19).

The source application asks a chat model to apply three rules; here the
rules are applied as data with built-in expressions (no join, no UDF, no
lambda):
explicit tickers -> those tickers; "besides X" -> the popular list without
X; no ticker -> the default list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.scalars import COIN_TRANSLATION, json_list_or, translate_coins

# Tickers recognised in a question (table symbols plus the
# dictionary's extra tickers), the popular and default lists of the rules,
# and the words that mark an exclusion ("besides").
TICKERS = ["BTC", "ETH", "BNB", "XRP", "SOL", "ADA", "DOGE", "TRX", "LTC", "XLM", "HBAR", "SHIB", "DOT"]
POPULAR = ["BTC", "ETH", "SOL"]
DEFAULT_COINS = ["BTC", "ETH"]
EXCLUSION_WORDS = ["除了", "BESIDES", "EXCEPT", "OTHER THAN"]


def _tokens(upper_text: Column) -> Column:
    """Maximal [A-Z0-9] runs of the text (one regex split)."""
    return F.split(upper_text, "[^A-Z0-9]+")


def _present(conds: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in list order.  Built from
    plain expressions (no lambda), so it stays inside whole-stage codegen
    and each condition is evaluated once per row."""
    joined = F.concat_ws(",", *[F.when(c, F.lit(t)) for t, c in conds])
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


def _mentions(tokens: Column, tickers: Sequence[str]) -> Column:
    """Tickers, in their given order, present as a whole token."""
    return _present([(t, F.array_contains(tokens, t)) for t in tickers])


def _besides(up: Column) -> Column:
    out = F.lit(False)
    for w in EXCLUSION_WORDS:
        out = out | F.contains(up, F.lit(w))
    return out


def _rules(tokens: Column, mentioned: Column, besides: Column, popular: Sequence[str], default: Sequence[str]) -> Column:
    others = _present([(p, ~F.array_contains(tokens, p)) for p in popular])
    return (F.when(F.size(mentioned) == 0, F.array(*[F.lit(d) for d in default]))
             .when(besides, others)
             .otherwise(mentioned))


def with_coins(df: DataFrame, text_col: str, out: str = "coins",
               lexicon: Sequence[tuple[str, str]] = COIN_TRANSLATION, tickers: Sequence[str] = TICKERS,
               popular: Sequence[str] = POPULAR, default: Sequence[str] = DEFAULT_COINS) -> DataFrame:
    """Adds ``out``: the coin array of each text.  The normalised text and
    the mention list are projected once each (staged columns, so the
    optimizer does not repeat them inside the rule expression)."""
    staged = df.withColumn("_up", F.upper(translate_coins(F.col(text_col), lexicon)))
    staged = staged.withColumn("_tok", _tokens(F.col("_up"))).withColumn("_b", _besides(F.col("_up")))
    staged = staged.withColumn("_m", _mentions(F.col("_tok"), tickers))
    return (staged.withColumn(out, _rules(F.col("_tok"), F.col("_m"), F.col("_b"), popular, default))
                  .drop("_up", "_tok", "_m", "_b"))


def tag_coins(df: DataFrame, text_col: str, id_col: str, **rules) -> DataFrame:
    """U4: one row per (id, pos, symbol) — the coins each text is about.
    ``rules``: another lexicon, tickers, popular or default list (see ``with_coins``)."""
    # outer explode + null filter: an inner explode would make the optimizer
    # push a size(coins) > 0 filter below the staged projections, inlining
    # (and so repeating) the whole rule expression there
    return (with_coins(df.select(id_col, text_col), text_col, "_coins", **rules)
            .select(id_col, F.posexplode_outer("_coins").alias("pos", "symbol"))
            .where(F.col("symbol").isNotNull()))


def coins_from_json(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """U4 from a model's JSON answer (P19): parse, fall back to ["BTC"]."""
    return df.select(id_col, F.posexplode(json_list_or(F.col(json_col))).alias("pos", "symbol"))

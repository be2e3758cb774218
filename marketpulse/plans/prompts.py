"""Prompt dataset for a table of questions.

Per question: the k nearest news vectors no older than the time floor
(F3 -> J8/L1), newest first (L2), each with its source link (J1), rolled up
as one text (A6); the coins it asks about (U4) with their latest indicator
row (J2, P16), rolled up likewise; then the two prompt messages.  All of it
is one Spark plan keyed by question id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.scalars import indicator_line
from marketpulse.operators import coins as cn
from marketpulse.operators import quality as q
from marketpulse.operators import retrieval as rt

# The system message and the user-message template parts.
SYSTEM_PROMPT = "你是一個根據最新新聞與技術指標幫助使用者分析幣價的 AI 助手。"
USER_HEAD = "根據以下新聞與幣種技術指標資料回答問題（幣種："
USER_NEWS = "）：\n\n[新聞]\n"
USER_INDICATORS = "\n\n[技術指標]\n"
USER_QUESTION = "\n\n問題："


def news_context(questions: DataFrame, vectors: DataFrame, news: DataFrame, now,
                 k: int = 5, days: float = 3) -> DataFrame:
    """(qid, context, n_hits): the newest-first source lines of the hits."""
    recent = q.since(vectors, "timestamp", now, days)
    hits = rt.knn(recent, questions, k, vec_id="id", vec_col="embedding")
    meta = recent.select(F.col("id").alias("_hid"), "title", "timestamp")
    hits = hits.join(meta, hits.id == F.col("_hid"), "inner").drop("_hid")
    hits = rt.newest_first(hits)
    hits = rt.attach_sources(hits, news)
    return hits.groupBy("qid").agg(_ordered_text(F.col("pos"), F.col("source"), "\n").alias("context"),
                                   F.count(F.lit(1)).alias("n_hits"))


def _ordered_text(pos, value, sep: str):
    """Values joined by ``sep`` in ``pos`` order; rows with a null value
    are left out (collect_list skips the null struct)."""
    picked = F.when(value.isNotNull(), F.struct(pos.alias("o"), value.alias("v")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(picked)), lambda s: s["v"]), sep)


def indicator_context(questions: DataFrame, indicators: DataFrame, text_col: str = "question") -> DataFrame:
    """(qid, coin_names, indicators_text) per question.

    The coins are tagged once; a left join to the latest indicator row per
    symbol (one row per symbol) and one aggregate per question give both
    texts (A6 twice, over the same rows).  A coin without indicators is
    named but has no line (J2 skips it).
    """
    coins = cn.tag_coins(questions, text_col, "qid")
    latest = rt.latest(indicators, ["symbol"], "recorded_at").withColumn("_has", F.lit(True))
    line = F.when(F.col("_has"), indicator_line("symbol", "recorded_at", "rsi_14", "macd", "macd_signal",
                                                "bb_upper", "bb_middle", "bb_lower"))
    j = coins.join(latest, "symbol", "left").select("qid", "pos", "symbol", line.alias("line"))
    return j.groupBy("qid").agg(
        _ordered_text(F.col("pos"), F.col("symbol"), ", ").alias("coin_names"),
        _ordered_text(F.col("pos"), F.col("line"), "\n").alias("indicators_text"))


def build_prompts(questions: DataFrame, vectors: DataFrame, news: DataFrame,
                  indicators: DataFrame, now, k: int = 5, days: float = 3,
                  text_col: str = "question") -> DataFrame:
    """(qid, question, system, user, n_hits) for every non-empty question.

    ``questions`` has qid, the question text and its query vector ``qvec``.
    A question without recent hits still gets a row (empty news context,
    n_hits 0); empty questions are rejected (F6).
    """
    ok, _ = q.require(questions, [text_col])
    ctx = news_context(ok, vectors, news, now, k, days)
    ind = indicator_context(ok, indicators, text_col)
    j = (ok.select("qid", text_col)
           .join(ctx, "qid", "left").join(ind, "qid", "left"))
    user = F.concat(F.lit(USER_HEAD), F.coalesce("coin_names", F.lit("")), F.lit(USER_NEWS),
                    F.coalesce("context", F.lit("")), F.lit(USER_INDICATORS),
                    F.coalesce("indicators_text", F.lit("")), F.lit(USER_QUESTION), F.col(text_col))
    return j.select("qid", text_col, F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"),
                    F.coalesce("n_hits", F.lit(0)).alias("n_hits"))

"""Batch text enrichment: summary, sentiment, embedding.

Each operator takes an optional user model.  A model is a plain Python
callable over a pandas Series, loaded once per Python worker and run over
Arrow batches (iterator ``pandas_udf``).  Without one, a Spark-native
default runs (built-in expressions or a ``pyspark.ml`` pipeline); its
output is not the text a transformer model would produce.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.functions.scalars import WORD_PATTERN, WORD_RANGES
from marketpulse.operators.quality import require_columns, short_text

SUMMARY_WORDS = 50
SHORT_TEXT_WORDS = 30


def _batch_udf(model: Callable[[pd.Series], pd.Series], return_type) -> Callable[[Column], Column]:
    """Wrap a pandas-Series model as an iterator pandas_udf (model built once).
    Nulls never reach the model and give null."""
    @F.pandas_udf(return_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = model() if isinstance(model, type) else model
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            given = s[s.notna().to_numpy()]
            if len(given):
                out.loc[s.notna().to_numpy()] = pd.Series(list(fn(given)), dtype=object).to_numpy()
            yield out
    return run


def leading_words(c: Column, n: int = SUMMARY_WORDS) -> Column:
    """Default summary: the first ``n`` words joined by a space."""
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(WORD_PATTERN), 0), 1, n), " ")


def summarize(df: DataFrame, col: str, out: str = "Summary",
              model: Callable[[pd.Series], pd.Series] | None = None,
              min_words: int = SHORT_TEXT_WORDS) -> DataFrame:
    """Texts under ``min_words`` words pass through; others are summarised.

    Only the long texts reach the model: Spark evaluates a Python function for
    every row of a batch, so short texts (F7) are handed over as null, which
    the wrapper does not pass on.
    """
    require_columns(df, [col])
    short = short_text(col, min_words)
    if model is None:
        summary = leading_words(F.col(col))
    else:
        summary = _batch_udf(model, T.StringType())(F.when(~short, F.col(col)))
    return df.withColumn(out, F.when(short, F.col(col)).otherwise(summary))


def fit_sentiment(labelled: DataFrame, text: str = "text", label: str = "label",
                  features: int = 1 << 16) -> PipelineModel:
    """Default classifier for U2: hashed TF-IDF + logistic regression."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=WORD_RANGES, gaps=False,
                       toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20),
    ])
    return pipe.fit(labelled.select(text, F.col(label).cast("double").alias(label)))


def classify(df: DataFrame, col: str, model, out: str = "Sentiment",
             labels: dict[float, str] | None = None) -> DataFrame:
    """A label per text.  ``model`` is a fitted ``PipelineModel`` (see
    :func:`fit_sentiment`) or a pandas-Series callable returning labels."""
    if isinstance(model, PipelineModel):
        scored = model.transform(df.withColumnRenamed(col, "text") if col != "text" else df)
        if col != "text":
            scored = scored.withColumnRenamed("text", col)
        lab = F.col("prediction")
        if labels:
            m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
            lab = m[F.col("prediction")]
        keep = [c for c in df.columns]
        return scored.select(*keep, lab.alias(out))
    return df.withColumn(out, _batch_udf(model, T.StringType())(F.col(col)))


def fit_embedder(corpus: DataFrame, col: str, features: int = 1 << 10) -> PipelineModel:
    """Default encoder for U3: hashed TF-IDF, L2-normalised."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=col, outputCol="_tok", pattern=WORD_RANGES, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ])
    return pipe.fit(corpus.select(col))


def embed(df: DataFrame, col: str, encoder, out: str = "embedding") -> DataFrame:
    """An ``array<float>`` embedding per text.  ``encoder`` is a fitted
    ``PipelineModel`` (see :func:`fit_embedder`) or a pandas-Series callable
    returning lists of floats."""
    if isinstance(encoder, PipelineModel):
        # feed ``col`` to the column the pipeline was fitted on
        fitted_on = encoder.stages[0].getInputCol()
        src = df if fitted_on == col else df.withColumn(fitted_on, F.col(col))
        res = encoder.transform(src)
        return (res.withColumn(out, vector_to_array(F.col("_vec"), "float32"))
                   .select(*df.columns, out))
    return df.withColumn(out, _batch_udf(encoder, T.ArrayType(T.FloatType()))(F.col(col)))


def enrich_news(df: DataFrame, sentiment_model, summary_model=None) -> DataFrame:
    """F8 + U1 + U2 + F9: (Published Time, Title, Summary, Sentiment)."""
    require_columns(df, ["Title", "Body"])
    s = summarize(df, "Body", "Summary", summary_model)
    c = classify(s, "Summary", sentiment_model, "Sentiment")
    return c.select("Published Time", "Title", "Summary", "Sentiment")

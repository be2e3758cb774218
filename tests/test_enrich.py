"""Models behind the text operators: the short-text gate and the default classifier."""

from pyspark.sql import functions as F

from marketpulse.operators import enrich as en
from marketpulse.sources import adapters as ad
from tests.conftest import MEDIUM


def test_the_model_never_sees_a_short_text(spark):
    def model(texts):
        assert all(len(t.split()) >= 30 for t in texts), "a short text reached the model"
        return texts.str.upper()

    long = " ".join(["word"] * 40)
    df = spark.createDataFrame([(1, "two words"), (2, long), (3, None), (4, "")], "id int, body string")
    got = {r.id: r.Summary for r in en.summarize(df, "body", model=model).collect()}
    assert got == {1: "two words", 2: long.upper(), 3: None, 4: ""}


def test_default_classifier_on_held_out_rows(spark):
    rows = ad.labels_v(spark, MEDIUM)
    model = en.fit_sentiment(rows.where(F.col("doc_id") % 4 != 0))
    held = en.classify(rows.where(F.col("doc_id") % 4 == 0), "text", model, "got")
    right, n, ones = held.agg(F.avg((F.col("got") == F.col("label")).cast("double")), F.count(F.lit(1)), F.avg("label")).first()
    assert n > 50 and right > max(ones, 1 - ones)


def test_tokens_are_the_words_whatever_the_character(spark):
    """The tokenizer's ranges hold every character but Python's whitespace, and ask common ones first."""
    from pyspark.ml.feature import RegexTokenizer
    from pyspark.sql import functions as F
    from marketpulse.functions.scalars import WORD_RANGES
    from marketpulse.operators import enrich as en
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    text = spark.createDataFrame([(i, "".join(f"a{chr(c)}b " for c in points[i:i + 5000])) for i in range(0, len(points), 5000)], "k long, text string")
    tok = RegexTokenizer(inputCol="text", outputCol="t", pattern=WORD_RANGES, gaps=False, toLowercase=False)
    for r in tok.transform(text).select("text", "t").collect():
        assert r.t == r.text.split()
    model = en.fit_embedder(spark.createDataFrame([("One two\u00a0two",), ("three",)], "text string"), "text")
    assert model.stages[0].getPattern() == WORD_RANGES
    assert [len(r._tok) for r in model.transform(spark.createDataFrame([("x\u3000y z\x1cw",)], "text string")).collect()] == [4]

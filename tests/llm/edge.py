"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing names."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, fp string, key string, " \
          "figures string, host string, spans string, blob string, n_lines string, component_id string, found string"
LONG = " ".join(f"word{k % 977} thing{k % 31}" for k in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "Ünïcödé 😀 wörds\nand lines\n", LONG, LONG, "a b c d e f g", "a b c d e f g", "aaa " * 400]


def rows():
    out = [(k, t, "en" if k % 2 else None, None if k == 3 else "s", None if t is None else len(t), *["x"] * 11)
           for k, t in enumerate(TEXTS)]
    return [*out, out[7], (None, "a b c d e f g", None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11)]


def edge_docs(spark, path):
    spark.createDataFrame(rows(), COLUMNS).coalesce(1).write.parquet(f"{path}/edge")
    return spark.read.parquet(f"{path}/edge")


def empty_docs(spark, path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/none")
    return spark.read.schema(COLUMNS).parquet(f"{path}/none")

import pytest
from pyspark.sql import functions as F

from marketpulse.llm import common, line_dedup, simhash, suffix_dedup

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture()
def shifting(spark, monkeypatch):
    """The splits of a table scan change after the first table that an operator writes."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set(SPLITS, "1")

    def then_shift(save):
        def run(*args):
            out = save(*args)
            spark.conf.set(SPLITS, "40")
            return out
        return run

    for m in (line_dedup, simhash, suffix_dedup):
        for name in ("saved", "saved_by"):
            monkeypatch.setattr(m, name, then_shift(getattr(common, name)), raising=False)
    yield
    for k in (SPLITS, "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def table(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("h")).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_near_duplicates_stay_the_same_rows(spark, tmp_dir, shifting):
    texts = [" ".join(f"{k // 2}w{j}" for j in range(60)) for k in range(80)]
    assert sorted(r.doc_id for r in simhash.keep_one(table(spark, f"{tmp_dir}/d", texts)).collect()) == list(range(0, 80, 2))


def test_repeats_are_cut_from_their_own_rows(spark, tmp_dir, shifting):
    shared = "".join(chr(97 + k * k % 23) + str(k) for k in range(100))
    texts = [f"{k} head " * (1 + k % 7) + (shared if k % 2 else "") for k in range(40)]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(table(spark, f"{tmp_dir}/d", texts)).collect()}
    assert all(shared not in got[k] and len(got[k]) < len(t) - 190 if k % 2 else got[k] == t for k, t in enumerate(texts))


def test_numbered_rows_are_read_back(spark, tmp_dir, shifting):
    docs = table(spark, f"{tmp_dir}/d", [f"body {k}\nmenu" if k % 2 else f"body {k}" for k in range(40)])
    out = line_dedup.cleaned(docs)
    spark.conf.set(SPLITS, "7")
    assert sorted((r.doc_id, r.text) for r in out.select("doc.*").collect()) == [(k, f"body {k}") for k in range(40)]
    assert not set(docs.inputFiles()) & set(out.inputFiles())

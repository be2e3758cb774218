import corpus_pipeline as C
from marketpulse.llm import bpe, decontaminate, repetition, simhash
from marketpulse.llm.common import saved
from tests.conftest import SMALL
from tests.llm.edge import edge_docs, empty_docs
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_fingerprint, brute_groups


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "bpe_tokens"]
    f = repetition.figures([r.text for r in rows])
    rows = [r for r, x in zip(rows, f, strict=True) if x[0] >= 50 and 100 * x[4] <= 50 * x[0] and 100 * x[5] <= 20 * x[0] and x[6] <= 100]
    texts = dict(zip([r.doc_id for r in rows], brute_lines([(r.source, r.text) for r in rows]), strict=True))
    group = brute_groups(list(texts), [brute_fingerprint(t) for t in texts.values()])
    texts = {d: t for (d, t), g in zip(texts.items(), group, strict=True) if d == g}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    whole = {d for d, t in texts.items() if any(" ".join(i.split()) in " ".join(t.split()) for i in items)}
    e = bpe.encoder(C.tokenizer_path())
    got = {r.doc_id: r for r in C.run(spark, SMALL).collect()}
    assert whole and not whole & set(got) and set(got) <= set(texts)
    assert len(set(texts) - whole - set(got)) <= 2  # edited copies of items
    assert all(r.ids == e.encode(texts[d]) and r.n_tokens == len(r.ids) for d, r in got.items())


def test_columns_and_edges(spark, tmp_dir):
    for docs in (edge_docs(spark, tmp_dir), empty_docs(spark, tmp_dir)):
        wanted, n = docs.columns, docs.count()
        for k, (_, stage) in enumerate(C.STAGES):
            docs = saved(stage(spark, docs, SMALL))
            assert docs.columns == wanted or k == len(C.STAGES) - 1
            assert docs.count() <= n
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_one_copy_stays(spark, tmp_dir):
    text = " ".join(f"w{k}" for k in range(80))
    spark.createDataFrame([(3, text), (2, text), (2, text), (None, text), (9, text + " x")], "doc_id long, text string").write.parquet(f"{tmp_dir}/d")
    assert [r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{tmp_dir}/d")).collect() if r.doc_id != 9] == [2]
    assert decontaminate.MIN_SCORE < 0.5


def site(path, spark, texts):
    spark.createDataFrame([(k, t, "h", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int").write.parquet(path)
    return {r.doc_id: r for r in C.line_dedup_stage(spark, spark.read.parquet(path), SMALL).collect()}


def test_a_line_on_eight_percent_of_the_pages_goes(spark, tmp_dir):
    got = site(f"{tmp_dir}/d", spark, [f"body {k}" + "\nmenu" * (k < 8) + "\nquote" * (k >= 95) for k in range(100)])
    assert [got[k].text for k in range(100)] == [f"body {k}" + "\nquote" * (k >= 95) for k in range(100)]
    assert got[3].n_chars == 6


def test_a_text_with_many_copies_stays(spark, tmp_dir):
    clean = "one clean text\nof two lines"
    texts = [clean if k % 3 == 0 else f"body {k}" + "\nmenu" * (k % 4 == 0) for k in range(90)]
    got = site(f"{tmp_dir}/d", spark, texts)
    assert [got[k].text for k in range(90)] == [t.replace("\nmenu", "") for t in texts]
    # pages of the host are distinct texts too: 5 of 61 + 1, not of 91
    texts = [clean] * 30 + [f"body {k}" + "\nmenu" * (k < 5) for k in range(61)]
    got = site(f"{tmp_dir}/e", spark, texts)
    assert [got[k].text for k in range(91)] == [t.replace("\nmenu", "") for t in texts]

from collections import Counter

from marketpulse.llm import line_dedup as D
from tests.conftest import MEDIUM
from tests.llm.edge import edge_docs, empty_docs

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, pct=6, least=3):
    distinct = {(h or "", t or "") for h, t in rows}
    pages = Counter(h for h, _ in distinct)
    seen = Counter((h, x) for h, t in distinct for x in {x.strip(SPACES) for x in t.split("\n")} - {""})
    bad = {k for k, n in seen.items() if n >= least and 100 * n > pct * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(SPACES)) not in bad) for h, t in rows]


def check(docs, **limits):
    rows = docs.collect()
    got = D.drop_boilerplate(docs, **limits)
    assert got.columns == docs.columns
    want = [(*r[:docs.columns.index("text")], t, *r[docs.columns.index("text") + 1:])
            for r, t in zip(rows, brute([(r.source, r.text) for r in rows], *limits.values()), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return sum(t != r.text for r, t in zip(rows, brute([(r.source, r.text) for r in rows], *limits.values()), strict=True))


def test_documents(spark):
    assert check(spark.read.parquet(f"{MEDIUM}/documents.parquet")) > 20


def test_edge_rows(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    check(docs)
    assert check(docs, ratio_pct=10, min_pages=2) == 0  # lines repeat in copies only, and copies are one page
    assert check(docs, ratio_pct=0, min_pages=1) > 5  # every line goes
    assert D.drop_boilerplate(empty_docs(spark, tmp_dir)).collect() == []


def test_counts(spark, tmp_dir):
    text = "menu\nbody {}\n menu \n\nfoot"
    spark.createDataFrame([(k, text.format(k), "h") for k in range(20)], "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/d")
    got = D.cleaned(spark.read.parquet(f"{tmp_dir}/d")).select("doc.*", "n_lines", "n_dropped").collect()
    assert {(r.text, r.n_lines, r.n_dropped) for r in got} == {(f"body {k}\n", 5, 3) for k in range(20)}


def test_small_host(spark, tmp_dir):
    """A line on all pages of a host with four, and one on two of them."""
    texts = [f"body {k}\nmenu" + "\nquote" * (k < 2) for k in range(4)] + ["body 0\nmenu\nquote"] * 5
    spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/d")
    got = {r.doc_id: r.text for r in D.drop_boilerplate(spark.read.parquet(f"{tmp_dir}/d")).collect()}
    assert got == {k: t.replace("\nmenu", "") for k, t in enumerate(texts)}


def test_shared_line_goes_from_every_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    seen = Counter(x.strip(SPACES) for r in docs.select("text").collect() for x in set((r.text or "").split("\n")))
    shared = next(x for x, _ in seen.most_common() if len(x) > 20)
    left = D.drop_boilerplate(docs).where(f"contains(text, '{shared.replace(chr(39), chr(92) + chr(39))}')")
    assert seen[shared] > 800 and left.count() == 0

import numpy as np

from marketpulse.llm import quality_net as Q
from marketpulse.llm.queries import op6_quality_classifier
from tests.conftest import MEDIUM
from tests.llm.edge import edge_docs, empty_docs


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in op6_quality_classifier(spark, MEDIUM).collect()}
    truth = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()]
    held = [(r.score, q) for r, q in truth if r.held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(got) == 1000 and len(held) > 50 and auc > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_contexts_stay_in_their_text():
    a, b, joined = np.zeros(Q.ROWS * Q.DIM), np.zeros(Q.ROWS * Q.DIM), np.zeros(Q.ROWS * Q.DIM)
    x, y = Q.token_rows("a b c d"), Q.token_rows("e f g")
    Q._add_contexts(a, [x])
    Q._add_contexts(b, [y])
    Q._add_contexts(joined, [x, y])
    assert (a + b == joined).all() and a.any()


def test_edge_rows(spark, tmp_dir):
    docs = edge_docs(spark, tmp_dir)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)] + [(None, 1, 0), (1, None, 0), (3, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    unlabelled = Q.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert {r.score for r in Q.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert Q.classify(empty_docs(spark, tmp_dir), labels).collect() == []

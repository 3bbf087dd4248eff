"""Operator 2: held-out accuracy, calibration, and its parts against plain versions."""

import zlib

import numpy as np

from noticeflow.llm import kernel as K
from noticeflow.llm import quality_model as Q
from noticeflow.llm import queries


def test_context_counts_equal_a_loop():
    text = ["a b c!! a", "", "b", "c a-a b"]
    raw = "".join(text).encode()
    offsets = np.cumsum([0] + [len(t) for t in text])
    h, first = Q.tokens(np.frombuffer(raw, np.uint8), offsets)
    assert np.diff(first).tolist() == [5, 0, 1, 5]
    table = np.zeros(Q.ROWS * Q.WIDTH, np.int64)
    Q.context_counts(table, h, first)
    want = np.zeros_like(table)
    for r in range(4):
        for i in range(first[r], first[r + 1]):
            for j in range(max(first[r], i - 2), min(first[r + 1], i + 3)):
                if i != j:
                    for s in range(2):
                        b = int(h[j])
                        want[(int(h[i]) % Q.ROWS) * Q.WIDTH + (b >> (20 + 6 * s)) % 32] += 1 - 2 * ((b >> (40 + s)) & 1)
    assert (table == want).all() and abs(table).sum() > 0
    x = Q.pooled(np.random.default_rng(0).normal(size=(Q.ROWS, Q.WIDTH)).astype(np.float32), h, first)
    assert (x[1] == 0).all() and np.isfinite(x).all()


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-2 * (x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(3000) < p).astype(int)
    net = Q.fit(x[:2500], y[:2500])
    got = net.probability(x[2500:])
    assert ((got >= 0.5) == (p[2500:] >= 0.5)).mean() > 0.85 and abs(got.mean() - y[2500:].mean()) < 0.06


def test_scores(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    assert len(got) == 10000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[d].score, q) for d, q in labels.items() if got[d].held_out]
    low, high = [s for s, q in held if not q], [s for s, q in held if q]
    assert np.mean([a < b for a in low for b in high[:300]]) > 0.95  # area under the curve
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.93


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "word " * 30, 9), (None, "x", 9), (3, "é" * 50000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert [r.score for r in Q.scores(docs, labels).collect()] == [0.5] * 5
    both = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    more = spark.createDataFrame([(i, ("good words here " if i % 2 else "### ") * 9) for i in range(60)] + [(None, None)], "doc_id long, text string")
    assert Q.scores(more, both).count() == 61
    assert Q.scores(docs.limit(0), labels).count() == 0

"""Operator 2, quality classifier: random-indexing word vectors, pooled, into a small calibrated network.

Every token has a sparse random index vector, drawn from its hash. A pass over the whole corpus adds up, for
each token, the index vectors of its neighbours; tokens share rows of a table of fixed size by hash, so what a
task holds and sends doesn't depend on the vocabulary. A document is the mean and the spread of the vectors of
all its tokens; a two-layer numpy network scores it, and a temperature fitted on rows that it hasn't trained on
calibrates its probability. The network learns from at most `sample` labelled rows (lowest hash of doc_id
first); the vectors come from all documents.

Defined results: null and empty texts have no tokens and the score of an all-zero document; repeated rows and
null ids keep their row; rows whose doc_id is null are never labelled; without labels of both kinds every score is 0.5; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import only

ROWS, WIDTH, SEEDS, REACH = 1 << 15, 32, 2, 2  #: table rows, vector width, ones in an index vector, neighbours each way
PART = 2048  #: table rows that travel together
_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(K.SPACES)] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of letters and digits, or of other visible bytes; case counts), and each row's first."""
    kind = _CLASS[data]
    s1, e1 = K.runs(kind == 1, offsets)
    s2, e2 = K.runs(kind == 2, offsets)
    start, end = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    h = K.span_hashes(data, start, end)
    return h, np.searchsorted(start, offsets)


def _row(h: np.ndarray) -> np.ndarray:
    return (h & K.U64(ROWS - 1)).astype(np.int64)


def context_counts(table: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
    """Adds to each token's row the index vectors of its neighbours in the same document."""
    n = len(h)
    rows, doc = _row(h), np.repeat(np.arange(len(first) - 1), np.diff(first))
    for gap in range(1, REACH + 1):
        if n <= gap:
            break
        same = np.flatnonzero(doc[gap:] == doc[:-gap])
        for a, b in ((same, same + gap), (same + gap, same)):
            for s in range(SEEDS):
                at = ((h[b] >> K.U64(20 + 6 * s)) & K.U64(WIDTH - 1)).astype(np.int64)
                sign = 1 - 2 * ((h[b] >> K.U64(40 + s)) & K.U64(1)).astype(np.int64)
                np.add.at(table, rows[a] * WIDTH + at, sign)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of unit context vectors over all texts (ROWS x WIDTH, a fixed size)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ROWS * WIDTH, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.blocks(K.columns(batch, "text")):
                context_counts(table, *tokens(data, offsets))
        parts = table.astype(np.int32).reshape(-1, PART * WIDTH)
        live = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([parts[i].tobytes() for i in live], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(K.columns(batch, c).to_pylist() for c in ("part", "counts")), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    sums = docs.select("text").mapInArrow(count, "part int, counts binary")
    sums = sums.repartition(ROWS // PART, "part").mapInArrow(add, "part int, counts binary")
    table = np.zeros((ROWS, WIDTH))
    for part, counts in sums.collect():  # ROWS x WIDTH numbers, whatever the corpus
        table[part * PART : (part + 1) * PART] += np.frombuffer(counts, np.int64).reshape(PART, WIDTH)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: mean and standard deviation of its tokens' vectors, the mean's length, and the log of the token count."""
    n = np.diff(first)
    out = np.zeros((len(n), 2 * WIDTH + 2), np.float32)
    live = np.flatnonzero(n)
    if len(live):
        x = vectors[_row(h)]
        size = n[live, None].astype(np.float32)
        mean = np.add.reduceat(x, first[live], axis=0) / size
        spread = np.sqrt(np.maximum(np.add.reduceat(x * x, first[live], axis=0) / size - mean * mean, 0))
        out[live] = np.concatenate([mean, spread, np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(size)], axis=1)
    return out


@dataclass
class Network:
    """Two layers (tanh, logistic) over standardised inputs, and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 250, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature minimises it on the rest."""
    x = x.astype(np.float64)
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4
    centre, scale = x[~held].mean(0), x[~held].std(0) + 1e-6
    net = Network(centre, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z, t = (x[~held] - centre) / scale, y[~held].astype(np.float64)
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, epochs + 1):
        a = np.tanh(z @ weights[0] + weights[1])
        p = 1 / (1 + np.exp(-np.clip(a @ weights[2] + weights[3], -30, 30)))
        d = (p - t) / len(t)
        back = d[:, None] * weights[2] * (1 - a * a)
        grads = [z.T @ back + decay * weights[0], back.sum(0), a.T @ d + decay * weights[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if held.any():
        raw, t = net.logits(x[held]), y[held]
        loss = lambda k: np.logaddexp(0, np.where(t == 1, -raw, raw) / k).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, vectors, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of at most `sample` labelled rows that aren't held out."""
    chosen = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    both = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # the sample's size is a parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(vectors.value, *tokens(data, offsets)) for _, _, data, offsets in K.blocks(K.columns(batch, "text"))]
            flat = [r.tobytes() for r in np.concatenate(x)] if x else []
            yield pa.RecordBatch.from_arrays([K.columns(batch, "doc_id"), K.columns(batch, "quality"), pa.array(flat, pa.binary())], names=["doc_id", "quality", "x"])

    kind = dict(both.dtypes)
    rows = both.mapInArrow(run, f"doc_id {kind['doc_id']}, quality {kind['quality']}, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 2 * WIDTH + 2)
    return x, np.array([int(r["quality"] == 1) for r in rows])


def scores(docs: DataFrame, labels: DataFrame, *, sample: int = 8000, **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs."""
    spark, docs = docs.sparkSession, only(docs, "doc_id", "text")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    x, y = training_rows(docs, labels, vectors, sample)
    net = spark.sparkContext.broadcast(fit(x, y, **options) if 0 < y.sum() < len(y) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for r0, r1, data, offsets in K.blocks(K.columns(batch, "text")):
                out.append(net.value.probability(pooled(vectors.value, *tokens(data, offsets))) if net.value is not None else np.full(r1 - r0, 0.5))
            score = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([K.columns(batch, "doc_id"), K.columns(batch, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

"""Operator 1, benchmark decontamination by winnowing.

Fingerprints are the minimum k-gram hash of each window of `span - k + 1` consecutive k-grams, so any shared
run of `span` words has a fingerprint in common. The benchmark's fingerprints are joined with each document's
inside the scan, and every hit is extended to the spans of `span` words around it, which must agree letter by
letter; words are hashed with a secret key of the run, so that no item can be written to pass for another. Items shorter than a span are their own k-gram and are looked up at every position (a winnowing window of one).
The benchmark comes in blocks of a bounded number of words. One block is a single pass; of several, each is a pass
that reads the texts and keeps only what it hits, by the texts' digests.

Defined results: null, empty or wordless texts have no words and no hits; an item without words never occurs;
an item with a null id counts towards n_hit, not towards the items; repeated items count once, repeated
documents each keep their row; an empty benchmark leaves all documents clean; extra columns are ignored by `report`
and kept with their values by `clean`.
"""

from __future__ import annotations

import itertools
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import aside, cut, keyed_join, only

#: Words of benchmark text that one pass holds in memory (about 60 bytes each in its index, with the words themselves).
BLOCK_WORDS = 2_000_000


def winnow(grams: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints: where a k-gram hash is the minimum of a window of w k-grams inside a row."""
    n = len(grams)
    if n < w:
        return np.zeros(0, np.int64)
    least = K.sliding_min(grams, w)
    whole = K.windows_in_rows(first, k + w - 1)[: len(least)]
    chosen = np.zeros(n, bool)
    for j in range(w):
        chosen[j : j + len(least)] |= (grams[j : j + len(least)] == least) & whole
    return np.flatnonzero(chosen)


class Index:
    """Distinct windows of a block of benchmark items, by length: hashes, the words themselves, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], span: int, k: int):
        self.span, self.k, self.w, self.key = span, k, span - k + 1, secrets.token_bytes(16)
        self.names: list[str] = sorted({i for i, _ in items if i is not None})
        name = {i: n for n, i in enumerate(self.names)}
        item = np.array([-1 if i is None else name[i] for i, _ in items], np.int64)
        prints, found, self.text, held = [np.zeros(0, K.U64)], {}, b"", []
        done = 0
        for r0, _, data, offsets in K.blocks(pa.array([t for _, t in items], pa.large_string())):
            W = K.Words(data, offsets, K.WORDY, key=self.key)
            grams = K.shingles(W.hash, k)
            prints.append(grams[winnow(grams, W.first, k, self.w)])
            sizes = np.diff(W.first)
            row = np.repeat(np.arange(len(sizes)), sizes)
            joined, at = W.joined()
            held.append(joined)
            for length in np.unique(np.minimum(sizes[sizes > 0], span)).tolist():
                if length == span:
                    start = np.flatnonzero(K.windows_in_rows(W.first, span))
                else:
                    start = W.first[:-1][sizes == length]
                one, two = K.shingles(W.hash, length)[start], K.shingles(W.hash ^ K.U64(0x3C6EF372FE94F82B), length)[start]
                found.setdefault(length, []).append((one, two, item[r0 + row[start]], done + at[start], done + at[start + length]))
            done += len(joined)
        self.text = b"".join(held)
        self.prints = np.unique(np.concatenate(prints))
        self.by_length = {length: self._windows(*(np.concatenate(x) for x in zip(*parts, strict=True))) for length, parts in found.items()}

    @staticmethod
    def _windows(one, two, item, start, end) -> tuple[np.ndarray, ...]:
        """Distinct windows by hash: hash, start and end in the text, first of its items, items."""
        order = np.lexsort((item, two, one))
        one, two, item = one[order], two[order], item[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        window = np.cumsum(new) - 1
        own = np.ones(len(one), bool)
        own[1:] = new[1:] | (item[1:] != item[:-1])
        own &= item >= 0
        lead = order[new]
        return one[new], start[lead], end[lead], np.searchsorted(window[own], np.arange(window[-1] + 2)), item[own]

    def windows(self, length: int, at: np.ndarray, keys: np.ndarray, W: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Of document windows (starts `at`, hashes `keys`), those that are windows of an item, letter by letter, and which."""
        have, start, end, _, _ = self.by_length[length]
        lo, hi = np.searchsorted(have, keys, "left"), np.searchsorted(have, keys, "right")
        hit = np.flatnonzero(hi > lo)
        out_at, out_w = [], []
        if len(hit):
            text, place = W.joined()
        # equal hashes of different windows are next to each other; all are compared
        for step in range(int((hi - lo)[hit].max()) if len(hit) else 0):
            hit = hit[lo[hit] + step < hi[hit]]
            w, s = lo[hit] + step, at[hit]
            spans = zip(place[s].tolist(), place[s + length].tolist(), start[w].tolist(), end[w].tolist(), strict=True)
            same = np.fromiter((text[a:b] == self.text[c:d] for a, b, c, d in spans), bool, len(hit))
            out_at.append(s[same])
            out_w.append(w[same])
        return (np.concatenate(out_at), np.concatenate(out_w)) if out_at else (np.zeros(0, np.int64),) * 2

    def scan(self, W: K.Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words are hit, and the distinct (row, item) pairs."""
        n = len(W.hash)
        mark = np.zeros(n + 1, np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        for length, (_, _, _, first, members) in self.by_length.items():
            if length > n:
                continue
            whole = K.windows_in_rows(W.first, length)[: n - length + 1]
            if length == self.span:
                grams = K.shingles(W.hash, self.k)
                at = winnow(grams, W.first, self.k, self.w)
                place = np.searchsorted(self.prints, grams[at])
                place[place == len(self.prints)] = 0
                at = at[self.prints[place] == grams[at]] if len(self.prints) else at[:0]
                if not len(at):
                    continue
                near = np.zeros(n, bool)  # each hit is extended to the spans that hold it
                for back in range(self.w):
                    near[at[at >= back] - back] = True
                at = np.flatnonzero(near[: len(whole)] & whole)
                keys = np.zeros(len(at), K.U64) + W.hash[at]
                for j in range(1, length):
                    keys = keys * K.U64(0x9FB21C651E98DF25) + W.hash[at + j]
                keys = K.mix(keys)
            else:
                at = np.flatnonzero(whole)
                keys = K.shingles(W.hash, length)[at]
            at, which = self.windows(length, at, keys, W)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + length, -1)
            row = np.searchsorted(W.first, at, "right") - 1
            row, which = np.unique(np.stack([row, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            size = first[which + 1] - first[which]
            item = members[np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            pairs.append(np.stack([np.repeat(row, size), item]))
        return np.cumsum(mark)[:n] > 0, np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist()


def item_blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about so many words; one partition at a time is with the driver."""
    block, held = [], 0
    for item_id, text in only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        block.append((item_id, text))
        held += len(text or "") // 2 + 1
        if held >= words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _found(index: Index | None, text: pa.Array) -> tuple[np.ndarray, list[list[str]], list[list[int]]]:
    """Per text its number of words, the items that it holds, and its runs of hit words (starts and ends, flattened)."""
    n_words, items, spans = [np.zeros(0, np.int64)], [], []
    for r0, r1, data, offsets in K.blocks(text):
        W = K.Words(data, offsets, K.WORDY, key=index.key if index else b"")
        n_words.append(np.diff(W.first))
        here: list[list[str]] = [[] for _ in range(r1 - r0)]
        runs: list[list[int]] = [[] for _ in range(r1 - r0)]
        if index is not None:
            hit, pairs = index.scan(W)
            for r, i in pairs:
                here[r].append(index.names[i])
            s, e = K.runs(hit, W.first)
            for r, a, b in zip((np.searchsorted(W.first, s, "right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
                runs[r] += [a - int(W.first[r]), b - int(W.first[r])]
        items += here
        spans += runs
    return np.concatenate(n_words).astype(np.int64), items, spans


_LISTS = (pa.list_(pa.string()), pa.list_(pa.int64()))


def _hits(docs: DataFrame, shared) -> DataFrame:
    """digest, items, spans of the texts that a block hits; a text comes once per task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            _, items, spans = _found(shared.value, K.columns(batch, "text"))
            digests = K.columns(batch, "digest").to_pylist()
            take = [i for i, s in enumerate(spans) if s and not (digests[i] in seen or seen.add(digests[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in take], pa.binary()), *(pa.array([x[i] for i in take], t) for x, t in zip((items, spans), _LISTS, strict=True))], names=["digest", "items", "spans"])

    return docs.mapInArrow(run, "digest binary, items array<string>, spans array<long>")


def _merged_hits(hits: DataFrame) -> DataFrame:
    """One row per digest: the union of what the blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, spans, out = None, set(), [], []
        for batch in batches:
            for d, i, s in zip(*(K.columns(batch, c).to_pylist() for c in ("digest", "items", "spans")), strict=True):
                if d != now:
                    if now is not None:
                        out.append((now, sorted(items), spans))
                    now, items, spans = d, set(), []
                items.update(i)
                spans = _union(spans, s)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), *(pa.array([o[j] for o in out], t) for j, t in enumerate(_LISTS, 1))], names=["digest", "items", "spans"])
            out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sorted(items)], _LISTS[0]), pa.array([spans], _LISTS[1])], names=["digest", "items", "spans"])

    return hits.repartition("digest").sortWithinPartitions("digest").mapInArrow(run, "digest binary, items array<string>, spans array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, span: int = 10, k: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of docs with its columns, and n_words long, n_hit long, items array<string>, spans array<long>.

    spans: start and end (word positions) of the runs of hit words, flattened. Columns of docs with these names are left out.
    """
    spark = docs.sparkSession
    plain = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    out = docs.select(*(docs[f"`{c}`"] for c in plain))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", n_words long, items array<string>, spans array<long>"

    def one_pass(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, items, spans = _found(shared.value, K.columns(batch, "text"))
                arrays = [K.columns(batch, c) for c in plain] + [pa.array(words), pa.array(items, _LISTS[0]), pa.array(spans, _LISTS[1])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*plain, "n_words", "items", "spans"])

        return run

    blocks = item_blocks(benchmark, block_words)
    first, second = next(blocks, None), next(blocks, None)
    index = Index(first, span, k) if first is not None and second is None else None
    found = out.mapInArrow(one_pass(spark.sparkContext.broadcast(index)), schema)
    if second is not None:
        digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
        texts, hits = docs.select("text", digest.alias("digest")), None
        for block in itertools.chain([first, second], blocks):
            shared = spark.sparkContext.broadcast(Index(block, span, k))
            got = cut(_hits(texts, shared))  # hits only: the corpus is read again, not written
            shared.destroy()
            hits = got if hits is None else hits.unionByName(got)
        merged = cut(_merged_hits(hits))
        rows = texts.select("digest").join(merged.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("_rows"))
        side = cut(merged.join(rows, "digest"))
        bare = found.drop("items", "spans").withColumn("digest", digest)
        hit = keyed_join(bare, side, ["digest"], "_rows")
        none = bare.join(side.select("digest"), "digest", "left_anti").withColumn("items", F.array().cast("array<string>")).withColumn("spans", F.array().cast("array<long>"))
        found = hit.unionByName(none).drop("digest").select(*(F.col(f"`{c}`") for c in (*plain, "n_words", "items", "spans")))
    pairs = F.expr("aggregate(sequence(0, size(spans) - 1, 2), 0L, (a, i) -> a + spans[i + 1] - spans[i])")
    return found.withColumn("n_hit", F.when(F.size("spans") > 0, pairs).otherwise(F.lit(0).cast("long")))


def _union(a: list[int], b: list[int]) -> list[int]:
    """Runs of either list, merged."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    found = contamination(only(docs, "doc_id", "text"), benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns they had."""
    rows, back = aside(docs, "text")
    return back(contamination(rows, benchmark, **options).where(F.col("n_hit") == 0))

"""Operator 9, repeated passages over all documents, found with run-length indexes.

Every window of `length` bytes has an anchor: the rightmost of its least (length/2)-gram hashes. Equal windows
have equal anchors at equal places, so only windows with an anchor that the corpus holds twice can repeat, and
these meet in the partition of that anchor. There the distinct stretches of text, in document order, become
one text with a run-length Burrows-Wheeler index. Of the transform only what its run borders sample is kept: which
suffix stands above each run's first. From these samples the text's own positions are streamed in order, each with the
length of its match with the suffix above it and where that is; positions with matches of `length` fall into classes,
and all but the first of each class are repeats. (The transform of a block is built by sorting its suffixes.)

Equal strings are one entry of the index, by 128 bits or the bytes themselves: whole copies of an earlier text are
taken out before, and a stretch that a task has already seen in an earlier document is marked there and then, so that
the members of a hot passage are not sent on but once per task.

Defined results: null text counts as empty; texts shorter than `length` keep all; rows with one doc_id are
ordered by the hash of their texts, and if their texts are equal they are one document; a null doc_id comes
after all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import cut, keyed_join, only

#: Repeated anchors (8 bytes each) that all tasks may hold at once; beyond that they are joined by shuffle.
FILTER_ANCHORS = 3_000_000
#: Whole copies (8 bytes each) that all tasks may hold at once; beyond that they are joined by shuffle.
FILTER_COPIES = 4_000_000
#: Bytes of text that one run-length index holds, unless a single anchor has more.
INDEX_BYTES = 1_500_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and end window (starts, exclusive end) of each stretch of windows with one anchor."""
    k = length // 2
    h = K.Rolling(data).fixed(k)
    w = length - k + 1
    n = len(h) - w + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(K.U64), none, none
    value, at, have = h, np.arange(len(h), dtype=np.int32), 1

    def join(v, a, shift):
        left, right = v[:-shift], v[shift:]
        take = right <= left
        return np.where(take, right, left), np.where(take, a[shift:], a[:-shift])

    while 2 * have <= w:
        value, at = join(value, at, have)
        have *= 2
    if have < w:
        value, at = join(value, at, w - have)
    ok = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new & ok)
    stop = np.ones(n, bool)
    stop[:-1] = (at[1:] != at[:-1]) | ~ok[1:]
    return value[start], start, np.flatnonzero(stop & ok) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; text: bytes + 1, with 0 as separators that count as different, in order."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(7):
        ended |= padded[j : j + n] == 0
        key = key << 9 | np.where(ended, 0, padded[j : j + n])
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | ended[order[1:]] | ended[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    # ranks name the first place of a class from here on, so settled suffixes never move
    first = np.flatnonzero(new)
    rank = first[rank]
    k = 7
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            return order
        who = order[open_]
        after = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[who])) if n > 3_000_000_000 else np.argsort(rank[who] * (n + 2) + after, kind="stable")
        who, after = who[by], after[by]
        order[open_] = who
        own = rank[who]
        split = np.ones(len(who), bool)
        split[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        new[open_] |= split
        starts = np.maximum.accumulate(np.where(split, open_, 0))
        rank[who] = starts
        k *= 2


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform, with suffix-array samples where runs begin and end."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        order = suffix_array(text)
        last = text[order - 1]  # position 0 is preceded by the final separator
        head = np.ones(self.n, bool)
        head[1:] = last[1:] != last[:-1]
        # separators are all different: each is a run of its own
        head[1:] |= (last[1:] == 0) | (last[:-1] == 0)
        at = np.flatnonzero(head)
        self.starts = order[at]  # samples at the first row of each run
        self.ends = order[np.append(at[1:], self.n) - 1]  # and at the last
        by = np.argsort(self.starts, kind="stable")
        self.sampled = self.starts[by]
        before = np.concatenate([[-1], self.ends[:-1]])[by]  # the suffix just above each run's first
        self.above = before
        self.common = self._common(text, self.sampled, before)

    @staticmethod
    def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffix pairs (none across separators)."""
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(b >= 0)
        x, y, n = a[live], b[live], len(text)
        while len(live):
            same = (x < n) & (y < n)
            same[same] = (text[x[same]] == text[y[same]]) & (text[x[same]] != 0)
            live, x, y = live[same], x[same] + 1, y[same] + 1
            out[live] += 1
        return out

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the length of its match with the suffix above it, and that suffix."""
        i = np.arange(self.n)
        s = np.searchsorted(self.sampled, i, "right") - 1
        step = i - self.sampled[s]
        return np.maximum(self.common[s] - step, 0), np.where(self.above[s] < 0, -1, self.above[s] + step)

    def repeats(self, length: int) -> np.ndarray:
        """Whether each position starts a match of `length` with an earlier position."""
        match, where = self.stream()
        root = np.where(match >= length, where, np.arange(self.n))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        first = np.empty(self.n, np.int64)
        first[root[::-1]] = np.arange(self.n)[::-1]
        return first[root] < np.arange(self.n)


def repeated_windows(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For stretches in order, the window starts in each that also start in an earlier one or earlier in it."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int16)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    inside = np.ones(len(text), bool)
    inside[base + sizes] = False
    text[inside] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.int16) + 1
    again = RunLengthIndex(text).repeats(length)
    return [np.flatnonzero(again[b : b + s - length + 1]) for b, s in zip(base.tolist(), sizes.tolist(), strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) for ascending starts."""
    if not len(starts):
        return []
    cut_ = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate([[0], cut_])].tolist(), (starts[np.concatenate([cut_ - 1, [len(starts) - 1]])] + length).tolist(), strict=True))


_KEY = ["late", "doc_id", "mark"]


def removed_spans(docs: DataFrame, *, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): per document (late, doc_id, mark) its removed spans (from, to), not yet merged; and the documents that copy an earlier one whole.

    docs: late (doc_id is null), doc_id (0 then), mark, digest, text (no nulls).
    """
    spark = docs.sparkSession
    narrow = docs.select(*_KEY, "digest", F.octet_length("text").cast("long").alias("size")).where(f"size >= {length}")
    firsts = narrow.groupBy("digest").agg(F.min(F.struct("late", "doc_id")).alias("f"), F.max(F.struct("late", "doc_id")).alias("l"), F.count(F.lit(1)).alias("_rows"))
    several = cut(firsts.where("f <> l").drop("l"))
    copies = cut(keyed_join(narrow, several, ["digest"], "_rows").where("late <> f.late or doc_id <> f.doc_id").select(*_KEY, "size").distinct())
    own = F.xxhash64(*_KEY)
    originals = docs.where(f"octet_length(text) >= {length}").select(*_KEY, own.alias("own"), "text")
    gone = None
    if copies.count() <= FILTER_COPIES:
        gone = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in copies.select(own).toLocalIterator()), np.int64)))
    else:
        originals = originals.join(copies.select(*_KEY), _KEY, "left_anti")
    originals = originals.select(*_KEY, "own", "text")

    def first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches without the rows of whole copies."""
        for batch in batches:
            if gone is not None and len(gone.value):
                owns = K.columns(batch, "own").to_numpy()
                place = np.searchsorted(gone.value, owns)
                place[place == len(gone.value)] = 0
                batch = batch.filter(pa.array(gone.value[place] != owns))
            if batch.num_rows:
                yield batch

    def all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in first_texts(batches):
            for _, _, data, offsets in K.blocks(K.columns(batch, "text")):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offsets, length)[0].view(np.int64))], names=["anchor"])

    twice = cut(originals.mapInArrow(all_anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"))
    few = None
    if twice.count() <= FILTER_ANCHORS:
        few = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in twice.toLocalIterator()), np.int64)))
        found = originals.withColumn("at", F.lit(None).cast("array<long>"))
    else:

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in first_texts(batches):
                for r0, r1, data, offsets in K.blocks(K.columns(batch, "text")):
                    h, start, _ = anchors(data, offsets, length)
                    row = np.searchsorted(offsets, start, "right") - 1
                    keys = [K.columns(batch, c).slice(r0, r1 - r0).take(pa.array(row)) for c in _KEY]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(h.view(np.int64))], names=[*_KEY, "anchor"])

        hits = originals.mapInArrow(placed, "late int, doc_id long, mark long, anchor long").join(twice, "anchor").groupBy(*_KEY).agg(F.collect_set("anchor").alias("at"))
        found = originals.join(hits, _KEY)

    out = "kind int, anchor long, late int, doc_id long, mark long, from long, to long, stretch binary"
    names = ["kind", "anchor", *_KEY, "from", "to", "stretch"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in first_texts(batches):
            late, doc, mark = (K.columns(batch, c).to_numpy(zero_copy_only=False) for c in _KEY)
            lists = K.columns(batch, "at")
            for r0, r1, data, offsets in K.blocks(K.columns(batch, "text")):
                h, start, end = anchors(data, offsets, length)
                row = np.searchsorted(offsets, start, "right") - 1
                if few is not None:
                    place = np.searchsorted(few.value, h.view(np.int64))
                    place[place == len(few.value)] = 0
                    hit = few.value[place] == h.view(np.int64) if len(few.value) else np.zeros(len(h), bool)
                else:
                    wanted = [set(lists[r0 + r].as_py() or ()) for r in range(r1 - r0)]
                    hit = np.array([int(x) in wanted[r] for x, r in zip(h.view(np.int64).tolist(), row.tolist(), strict=True)], bool)
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                h, start, end, row = h[at], start[at], end[at], row[at]
                stop = end + length - 1
                base = offsets[row]
                raw = data.tobytes()
                kind, keep = [], []
                order = np.lexsort((start, mark[r0 + row], doc[r0 + row], late[r0 + row]))
                rows_ = (r0 + row).tolist()
                starts_ = start.tolist()
                hashes = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts_, stop.tolist(), strict=True)]
                for i in order.tolist():
                    key = (int(late[rows_[i]]), int(doc[rows_[i]]), int(mark[rows_[i]]), starts_[i] - int(base[i]))
                    before = seen.get(hashes[i])
                    if before is not None and before < key:
                        kind.append(1)  # an earlier text of this task holds the same stretch
                    else:
                        seen[hashes[i]] = key
                        kind.append(0)
                    keep.append(i)
                if len(seen) > 300_000:
                    seen.clear()
                keep, kind = np.array(keep), np.array(kind)
                bodies = [raw[a:b] if not x else None for a, b, x in zip(start[keep].tolist(), stop[keep].tolist(), kind.tolist(), strict=True)]
                r = r0 + row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(h[keep].view(np.int64)), pa.array(late[r].astype(np.int32)), pa.array(doc[r]), pa.array(mark[r]), pa.array(start[keep] - base[keep]), pa.array(stop[keep] - base[keep]), pa.array(bodies, pa.binary())], names=names)

    sent = cut(found.mapInArrow(stretches, out))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(table: pa.Table) -> pa.RecordBatch:
            body = table.column("stretch").to_pylist()
            anchor = table.column("anchor").to_numpy()
            start = table.column("from").to_numpy()
            first: dict[tuple, tuple] = {}
            which, distinct = [], []  # -1: indexed, 0: holds what an earlier text holds, 1: the same place of the same document again
            places = zip(*(table.column(c).to_pylist() for c in (*_KEY, "from")), strict=True)
            for a, b, place in zip(anchor.tolist(), body, places, strict=True):
                if (a, b) not in first:
                    first[a, b] = place
                    which.append(-1)
                    distinct.append(b)
                else:
                    which.append(int(first[a, b] == place))
            windows = iter(repeated_windows(distinct, length))
            row, lo, hi = [], [], []
            for i, w in enumerate(which):
                got = [(0, len(body[i]))] if w == 0 else _spans(next(windows), length) if w < 0 else []
                for a, b in got:
                    row.append(i)
                    lo.append(int(start[i]) + a)
                    hi.append(int(start[i]) + b)
            row = pa.array(row, pa.int64())
            keys = [table.column(c).combine_chunks().take(row) for c in _KEY]
            return pa.RecordBatch.from_arrays([*keys, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[*_KEY, "from", "to"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < INDEX_BYTES:
                continue
            table = pa.Table.from_batches(held)
            a = table.column("anchor").to_numpy()
            # groups of whole anchors, of about INDEX_BYTES each
            tail = int(np.argmax(a == a[-1]))
            if tail:
                yield from _in_parts(table.slice(0, tail), marked)
                table = table.slice(tail)
                held, size = table.to_batches(), table.nbytes
        if held:
            yield from _in_parts(pa.Table.from_batches(held), marked)

    searched = sent.where("kind = 0").drop("kind").repartition("anchor").sortWithinPartitions("anchor", *_KEY, "from").mapInArrow(search, "late int, doc_id long, mark long, from long, to long")
    local = sent.where("kind = 1").select(*_KEY, "from", "to")
    return searched.unionAll(local), copies


def _in_parts(table: pa.Table, fn) -> Iterator[pa.RecordBatch]:
    """fn over runs of whole anchors of about INDEX_BYTES."""
    a = table.column("anchor").to_numpy()
    sizes = np.cumsum(table.column("to").to_numpy() - table.column("from").to_numpy() + 1)
    edge = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
    begin, done = 0, 0
    for e in edge.tolist():
        if sizes[e - 1] - done >= INDEX_BYTES or e == len(a):
            yield fn(table.slice(begin, e - begin))
            begin, done = e, int(sizes[e - 1])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merged_spans(spans: DataFrame) -> DataFrame:
    """One row per document: its removed spans, merged, ascending, as pairs of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def packed(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64())
            keys = [pa.array([d[0][i] for d in done], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([np.array(merged(d[1]), np.int64).tobytes() for d in done], pa.binary())], names=[*_KEY, "spans"])

        for batch in batches:
            done = []
            for *key, a, b in zip(*(K.columns(batch, c).to_pylist() for c in (*_KEY, "from", "to")), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, held))
                    now, held = key, []
                held.append((a, b))
                if len(held) > 10_000:
                    held = merged(held)
            yield packed(done)
        if now is not None:
            yield packed([(now, held)])

    return spans.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, "late int, doc_id long, mark long, spans binary")


def without_repeats(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """doc_id, text (what is left, as bytes), n_bytes, n_removed, n_spans, kept_sha256 per row.

    Texts meet their spans by shuffle, at every size: nothing that grows with the corpus is broadcast for it.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = only(docs, "doc_id", "text").select(F.col("doc_id").isNull().cast("int").alias("late"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("mark"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    spans, copies = removed_spans(keyed, length=length)
    whole = copies.select(*_KEY, F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))
    removed = _merged_spans(spans.unionAll(whole))
    joined = keyed.drop("digest").join(removed.hint("shuffle_hash"), _KEY, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            late = K.columns(batch, "late").to_pylist()
            doc = [d if not x else None for d, x in zip(K.columns(batch, "doc_id").to_pylist(), late, strict=True)]
            raw, at = K.string_buffers(K.columns(batch, "text"))
            left, n, gone, runs = [], [], [], []
            for i, pairs in enumerate(K.columns(batch, "spans").to_pylist()):
                body, kept, done = raw[at[i] : at[i + 1]].tobytes(), [], 0
                found = np.frombuffer(pairs or b"", np.int64).reshape(-1, 2).tolist()
                for a, b in found:
                    kept.append(body[done:a])
                    done = b
                kept.append(body[done:])
                left.append(b"".join(kept))
                n.append(len(body))
                gone.append(len(body) - len(left[-1]))
                runs.append(len(found))
            sha = [hashlib.sha256(x).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(left, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string())], names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("late", "doc_id", "text", "spans").mapInArrow(finish, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    return without_repeats(docs, **options).drop("text")

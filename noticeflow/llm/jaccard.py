"""Operator 7, n-gram Jaccard join with signature trees.

Sets of word shingles link when they share at least `percent` of their union. Rows with equal sets (by 128 bits) are
one node, numbered once, before anything is dealt out by shingle: a text that a third of all rows hold counts once. Two sets can only link if they share one of the `n - ceil(percent n) + 1` first shingles of each, in any
order that holds for all; frequent shingles come last here (a sample tells which; the order never changes
results). The nodes that share a shingle form a group; each distinct group gets a signature tree, whose nodes
hold the OR of their members' token bitmaps and the range of their sizes. A dual traversal of the tree drops
pairs of nodes by the most tokens that any two of their members could share, and pairs whose members are
linked already. What is left is compared exactly, on the whole sets.

A group has a hub, the member with most of the frequent shingles; groups of one hub are searched as one. Members
of groups of more than `star` first link to the hub, so that a large group of near copies becomes one class
before its tree is searched; groups beyond a quarter of `dense` are searched as pairs of parts, each a task of its own. Rows of a group are never gathered elsewhere.

Words are hashed with a secret key of the run, so that nobody can write texts whose shingles collide.

Defined results: null, empty and wordless texts have no shingles and link with nothing; fewer words than a
shingle make one shingle of the whole sequence; rows with one doc_id are separate rows with that id; a null
doc_id counts for its links but is never a component's id (a component of nothing else has none); an empty
table gives no rows; extra columns are ignored by `components` and kept by `keep_one`.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import kernel as K
from noticeflow.llm.components import connected
from noticeflow.llm.shared import aside, cut, keyed_join, only

WORDS = 8  #: least 64-bit words of a token bitmap, and those of a tree's inner nodes
LEAF = 8  #: members of a tree's leaf, and children of a node
#: Sets whose ids are sent to all tasks to filter what the second scan emits; beyond that the join alone filters.
FILTER_IDS = 2_000_000
#: Shared shingles that are compared at a time when the links inside a class are counted, and by how much a cell of
#: their product is cheaper than a pair that is counted by itself.
BLOCK, DENSE = 1024, 64
#: What a task holds at a time: bytes of bitmaps that it compares, node pairs of a tree that it opens, candidate pairs
#: before they are sent on, and bytes of members that it reads before it searches their groups.
HELD_BYTES, OPEN, PAIRS, READ = 4_000_000, 16_384, 500_000, 16_000_000
#: Most frequent shingles that are ordered last (8 bytes each, sent to all tasks).
LAST = 500_000


class Hashing(NamedTuple):
    """How a run hashes: the key of its words, drawn anew each time, and the shingles that come last."""

    key: bytes
    last: np.ndarray


def _sorted_sets(data: np.ndarray, offsets: np.ndarray, k: int, hashing: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles row after row, frequent ones last and by hash else; and where each row starts."""
    W, last = K.Words(data, offsets, K.NOT_SPACE, key=hashing.key), hashing.last
    sizes = np.diff(W.first)
    grams = K.shingles(W.hash, k)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    whole = np.flatnonzero(K.windows_in_rows(W.first, k)[: len(grams)])
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    few = np.array([K.shingles(W.hash[W.first[r] : W.first[r + 1]], int(sizes[r]))[0] ^ K.U64(sizes[r]) for r in short], K.U64)
    h, r = np.concatenate([grams[whole], few]), np.concatenate([rows[whole], short])
    order = np.argsort(h)
    h, r = h[order], r[order]
    if len(last):
        place = np.searchsorted(last, h)
        place[place == len(last)] = 0
        key = 2 * r + (last[place] == h)
    else:
        key = 2 * r
    order = np.argsort(key.astype(np.uint16) if 2 * len(sizes) < 1 << 16 else key, kind="stable")  # short keys sort faster
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(sizes) + 1))


def _set_ids(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its elements."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = np.zeros(len(h) + 1, K.U64)
        np.cumsum(K.mix(h ^ K.U64(salt)), out=total[1:])
        out.append(K.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(K.U64)))
    return out[0], out[1]


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _rows(docs: DataFrame, k: int, none) -> DataFrame:
    """doc_id, mark, n, s1, s2 per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, data, offsets in K.blocks(K.columns(batch, "text")):
                h, first = _sorted_sets(data, offsets, k, none.value)
                s1, s2 = _set_ids(h, first)
                arrays = [K.columns(batch, "doc_id").slice(r0, r1 - r0), K.columns(batch, "mark").slice(r0, r1 - r0), pa.array(np.diff(first).astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, s1 long, s2 long")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (s1, s2) that a task sees; the ids of one shuffle partition are held, 16 bytes each."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        ids = zip(K.columns(batch, "s1").to_pylist(), K.columns(batch, "s2").to_pylist(), strict=True)
        take = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
        if take:
            yield batch if len(take) == batch.num_rows else batch.take(pa.array(take))


def _kinds(docs: DataFrame, k: int, percent: int, last) -> DataFrame:
    """One row per distinct set: node (its number), s1, s2, n, usual (thousandths of the set that are frequent shingles), bits (the token bitmap) and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a set is sent on once per task, but for very large tasks
        for batch in batches:
            for _, _, data, offsets in K.blocks(K.columns(batch, "text")):
                h, first = _sorted_sets(data, offsets, k, last.value)
                s1, s2 = _set_ids(h, first)
                if len(seen) > 1_000_000:
                    seen.clear()
                own = zip(s1.tolist(), s2.tolist(), np.diff(first).tolist(), strict=True)
                keep = np.array([i for i, (x, y, m) in enumerate(own) if m and not ((x, y) in seen or seen.add((x, y)))], np.int64)
                if not len(keep):
                    continue
                n = np.diff(first)[keep]
                h = h[np.repeat(first[keep] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                first = np.concatenate([[0], np.cumsum(n)])
                length = n + (-percent * n) // 100 + 1
                row = np.repeat(np.arange(len(n)), length)
                flat = h[first[row] + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)]
                often = np.zeros(len(h) + 1, np.int64)
                if len(frequent := last.value.last):
                    place = np.searchsorted(frequent, h)
                    place[place == len(frequent)] = 0
                    np.cumsum(frequent[place] == h, out=often[1:])
                usual = 1000 * (often[first[1:]] - often[first[:-1]]) // n
                width = bitmap_bits(n)
                ends = np.cumsum(width)
                bits = np.zeros(int(ends[-1]), np.uint8)
                bits[np.repeat(ends - width, n) + (h & np.repeat(width - 1, n).astype(K.U64)).astype(np.int64)] = 1
                packed, ends = np.packbits(bits, bitorder="little").tobytes(), ends // 8
                bitmaps = [packed[b - w : b] for b, w in zip(ends.tolist(), (width // 8).tolist(), strict=True)]
                arrays = [pa.array(s1[keep].view(np.int64)), pa.array(s2[keep].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(usual), pa.array(bitmaps, pa.binary()), _lists(flat.view(np.int64), length)]
                yield pa.RecordBatch.from_arrays(arrays, names=["s1", "s2", "n", "usual", "bits", "prefix"])

    schema = "s1 long, s2 long, n long, usual long, bits binary, prefix array<long>"
    found = docs.select("text").mapInArrow(run, schema).repartition("s1", "s2").mapInArrow(_first_of_each, schema)
    return found.select(F.monotonically_increasing_id().alias("node"), "*")


def _frequent(docs: DataFrame, k: int, one_in: int, least: int, none) -> np.ndarray:
    """Shingles found in at least `least` of one text in `one_in` (by its hash), most frequent first, LAST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.blocks(K.columns(batch, "text")):
                h, _ = _sorted_sets(data, offsets, k, none.value)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sample = docs.where(F.xxhash64("text") % one_in == 0).select("text")
    top = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(LAST)
    return np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).view(K.U64))


def _groups(nodes: DataFrame, dense: int) -> DataFrame:
    """Rows (g1, g2, node): the members of each distinct group of nodes that share a prefix shingle.

    Groups of up to `dense` members are told apart by what they hold; larger ones keep their shingle as the name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        token_left, members_left = np.zeros(0, np.int64), np.zeros(0, np.int64)
        streaming: int | None = None  # shingle of a group that is already being sent on

        def rows(g1, g2, s1):
            return pa.RecordBatch.from_arrays([pa.array(g1), pa.array(g2), pa.array(s1)], names=["g1", "g2", "node"])

        def named(token, members):
            return rows(np.full(len(members), token), np.full(len(members), -1), members)

        def closed(token: np.ndarray, s1: np.ndarray):
            """Whole groups: consecutive tokens, members ascending."""
            if not len(token):
                return None
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (s1[1:] != s1[:-1])
            token, s1 = token[new], s1[new]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            many = size >= 2
            if not many.any():
                return None
            u = s1.view(K.U64)
            g1 = K.mix(np.add.reduceat(K.mix(u ^ K.U64(0x51ED270B)), start) + size.astype(K.U64)).view(np.int64)
            g2 = K.mix(np.add.reduceat(K.mix(u ^ K.U64(0xA3B1956F)), start)).view(np.int64)
            big = size > dense
            g1[big], g2[big] = token[start[big]], -1
            pick = []
            for i in np.flatnonzero(many).tolist():
                key = (int(g1[i]), int(g2[i]))
                if key not in seen:
                    seen.add(key)
                    pick.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if not pick:
                return None
            pick = np.array(pick)
            m = size[pick]
            at = np.repeat(start[pick] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            return rows(np.repeat(g1[pick], m), np.repeat(g2[pick], m), s1[at])

        for batch in batches:
            token = np.concatenate([token_left, K.columns(batch, "token").to_numpy(zero_copy_only=False)])
            s1 = np.concatenate([members_left, K.columns(batch, "node").to_numpy(zero_copy_only=False)])
            if streaming is not None:
                n = int(np.argmax(token != streaming)) if token[-1] != streaming else len(token)
                if n:
                    yield named(streaming, s1[:n])
                token, s1 = token[n:], s1[n:]
                if not len(token):
                    token_left, members_left = token, s1
                    continue
                streaming = None
            tail = int(np.argmax(token == token[-1]))
            if (out := closed(token[:tail], s1[:tail])) is not None:
                yield out
            token_left, members_left = token[tail:], s1[tail:]
            if len(np.unique(members_left)) > dense:
                streaming = int(token_left[0])
                yield named(streaming, members_left)
                token_left, members_left = token_left[:0], members_left[:0]
        if (out := closed(token_left, members_left)) is not None:
            yield out

    tokens = nodes.select(F.explode("prefix").alias("token"), "node").repartition("token").sortWithinPartitions("token", "node")
    return tokens.mapInArrow(run, "g1 long, g2 long, node long").distinct()


def required(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least common tokens of two sets of these sizes that link."""
    return -(-percent * (na + nb) // (100 + percent))


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Width of the bitmap of a set of n: a power of two of at least 4 n, and 64 * WORDS at least."""
    return np.maximum(64 * WORDS, 1 << np.ceil(np.log2(4 * np.maximum(n, 1))).astype(np.int64))


class Bitmaps:
    """Token bitmaps of different widths; a wide one folds to a narrower one by OR."""

    def __init__(self, raw: list[bytes]):
        self.width = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.raw = raw

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each member, table) of all bitmaps of at least so many words, folded to so many."""
        if width not in self.tables:
            place = np.full(len(self.width), -1, np.int64)
            parts, done = [], 0
            for w in np.unique(self.width[self.width >= width]).tolist():
                who = np.flatnonzero(self.width == w)
                table = np.frombuffer(b"".join(self.raw[i] for i in who.tolist()), K.U64).reshape(len(who), w // width, width)
                parts.append(np.bitwise_or.reduce(table, axis=1))
                place[who] = done + np.arange(len(who))
                done += len(who)
            self.tables[width] = place, np.concatenate(parts)
        return self.tables[width]

    def lacking(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs: tokens of i that j can't have, and of j that i can't have, at least."""
        both = np.minimum(self.width[i], self.width[j])
        out = np.zeros((2, len(i)), np.int64)
        for w in np.unique(both).tolist():
            who = np.flatnonzero(both == w)
            place, table = self.at(w)
            step = max(1, HELD_BYTES // (8 * w))
            for c in range(0, len(who), step):
                part = who[c : c + step]
                a, b = table[place[i[part]]], table[place[j[part]]]
                out[0, part] = np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
                out[1, part] = np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
        return out[0], out[1]


def _may_link(bits: Bitmaps, n: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members i and j could share enough: by class, size, and tokens whose bits the other lacks."""
    need = required(n[i], n[j], percent)
    ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= need)
    at = np.flatnonzero(ok)
    lost_i, lost_j = bits.lacking(i[at], j[at])
    ok[at] = np.minimum(n[i[at]] - lost_i, n[j[at]] - lost_j) >= need[at]
    return ok


class SignatureTree:
    """Members `who` in leaves by size; every node has the OR of its (folded) bitmaps, its size range, and its class if it has one."""

    def __init__(self, maps: Bitmaps, who: np.ndarray, n: np.ndarray, label: np.ndarray):
        self.maps, self.n, self.label = maps, n, label
        place, table = maps.at(WORDS)
        bits = table[place[who]]
        self.order = np.lexsort((bits[:, 0], label[who], n[who]))
        self.who = who[self.order]
        n, label = n[who], label[who]
        excess = n - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens beyond one for each bit
        level = (bits[self.order], n[self.order], n[self.order], excess[self.order], label[self.order], label[self.order])
        self.levels = [level]
        while len(level[0]) > 1:
            cut_ = np.arange(0, len(level[0]), LEAF)
            level = (np.bitwise_or.reduceat(level[0], cut_), np.minimum.reduceat(level[1], cut_), np.maximum.reduceat(level[2], cut_), np.maximum.reduceat(level[3], cut_), np.minimum.reduceat(level[4], cut_), np.maximum.reduceat(level[5], cut_))
            self.levels.append(level)

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Member pairs that a dual traversal can't rule out, all at once."""
        none = np.zeros(0, np.int64)
        i, j = zip((none, none), *self.parts(percent), strict=True)
        return np.concatenate(i), np.concatenate(j)

    def parts(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same in parts: the traversal goes down OPEN node pairs at a time, the deepest first."""
        top = np.zeros(1, np.int64)
        todo = [(len(self.levels) - 1, top, top)]
        while todo:
            depth, i, j = todo.pop()
            if len(i) > OPEN:
                todo.append((depth, i[OPEN:], j[OPEN:]))
                i, j = i[:OPEN], j[:OPEN]
            if not depth:
                i, j = self.who[i], self.who[j]
                ok = (i != j) & _may_link(self.maps, self.n, self.label, i, j, percent)
                yield i[ok], j[ok]
                continue
            bits, low, high, excess, least, most = self.levels[depth]
            same_class = (least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j])
            shared = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
            need = required(low[i], low[j], percent)
            apart = (100 * high[i] < percent * low[j]) | (100 * high[j] < percent * low[i])
            go = ~same_class & ~apart & (np.minimum(excess[i], excess[j]) + shared >= need)
            i, j = i[go], j[go]
            below = len(self.levels[depth - 1][0])
            ci = (i[:, None, None] * LEAF + np.arange(LEAF)[None, :, None]) + np.zeros((1, 1, LEAF), np.int64)
            cj = (j[:, None, None] * LEAF + np.arange(LEAF)[None, None, :]) + np.zeros((1, LEAF, 1), np.int64)
            ci, cj = ci.ravel(), cj.ravel()
            fine = (ci < below) & (cj < below) & ((ci <= cj) if depth > 1 else (ci < cj))
            if fine.any():
                todo.append((depth - 1, ci[fine], cj[fine]))


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of nodes that trees over the groups (by hub, ci, cj) can't rule out, with one task (a number) that found each.

    members: hub, ci, cj, side, node, n, bits, label; where ci <> cj only pairs of different `side` count.
    """

    keys = ["hub", "ci", "cj"]

    def emit(a: np.ndarray, b: np.ndarray, task: np.ndarray) -> pa.RecordBatch:
        pair, at = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True) if len(a) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(task[at]), pa.array(pair[0]), pa.array(pair[1])], names=["task", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda c: table.column(c).to_numpy()
            g = np.stack([col(c) for c in keys])
            task = K.mix(g[0].astype(np.int64).view(K.U64) ^ K.mix((g[1].astype(np.int64) << 32 | g[2].astype(np.int64)).view(K.U64))).view(np.int64)
            start = np.flatnonzero(np.concatenate([[True], (g[:, 1:] != g[:, :-1]).any(0)]))
            size = np.diff(np.append(start, table.num_rows))
            node, n, label, side = col("node"), col("n"), col("label"), col("side")
            bits = Bitmaps(table.column("bits").to_pylist())
            cross = g[1] != g[2]
            ones, twos, tasks, found = [], [], [], 0

            def sent() -> pa.RecordBatch:
                out = emit(np.concatenate(ones), np.concatenate(twos), np.concatenate(tasks))
                for kept in (ones, twos, tasks):
                    kept.clear()
                return out

            for m in np.unique(size[size <= 2 * LEAF]).tolist():
                if m < 2:
                    continue
                x, y = np.triu_indices(m, 1)
                base = start[size == m][:, None]
                step = max(1, PAIRS // len(x))
                for c in range(0, len(base), step):
                    p, q = (base[c : c + step] + x).ravel(), (base[c : c + step] + y).ravel()
                    ok = _may_link(bits, n, label, p, q, percent) & (~cross[p] | (side[p] != side[q]))
                    ones.append(node[p[ok]])
                    twos.append(node[q[ok]])
                    tasks.append(task[p[ok]])
                    found += len(ones[-1])
                    if found > PAIRS:
                        yield sent()
                        found = 0
            for a, m in zip(start.tolist(), size.tolist(), strict=True):
                if m <= 2 * LEAF:
                    continue
                for i, j in SignatureTree(bits, np.arange(a, a + m), n, label).parts(percent):
                    ok = ~cross[a] | (side[i] != side[j])
                    ones.append(node[i[ok]])
                    twos.append(node[j[ok]])
                    tasks.append(task[i[ok]])
                    found += len(ones[-1])
                    if found > PAIRS:
                        yield sent()
                        found = 0
            if ones:
                yield sent()

        held = 0
        for batch in batches:
            left.append(batch)
            held += batch.nbytes
            if held < READ:
                continue
            table = pa.Table.from_batches(left)
            key = np.stack([table.column(c).to_numpy() for c in keys])
            tail = int(np.argmax((key == key[:, -1:]).all(0)))
            if tail:
                yield from search(table.slice(0, tail))
                left = table.slice(tail).combine_chunks().to_batches()
                held = sum(b.nbytes for b in left)
        if held:
            yield from search(pa.Table.from_batches(left))

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "task long, a long, b long").groupBy("a", "b").agg(F.min("task").alias("task"))


def _pruned(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (task, a, b), those that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            bits = Bitmaps(K.columns(batch, "bits_a").to_pylist() + K.columns(batch, "bits_b").to_pylist())
            n = np.concatenate([K.columns(batch, "n_a").to_numpy(), K.columns(batch, "n_b").to_numpy()])
            ok = _may_link(bits, n, np.arange(2 * m), np.arange(m), np.arange(m, 2 * m), percent)
            yield pa.RecordBatch.from_arrays([K.columns(batch, c).filter(pa.array(ok)) for c in ("task", "a", "b")], names=["task", "a", "b"])

    for x in "ab":
        pairs = pairs.join(kinds.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    return pairs.select("task", "a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "task long, a long, b long")


def _elements(needed: DataFrame, docs: DataFrame, k: int, none) -> DataFrame:
    """s1, s2, elements (sorted shingles) of the sets of `needed` (s1, s2), at most once per task; other sets may be among them."""
    spark = docs.sparkSession
    ids = None
    if needed.count() <= FILTER_IDS:
        ids = spark.sparkContext.broadcast(np.unique(np.fromiter((r[0] for r in needed.select("s1").toLocalIterator()), np.int64)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, data, offsets in K.blocks(K.columns(batch, "text")):
                h, first = _sorted_sets(data, offsets, k, none.value)
                s1, s2 = (x.view(np.int64) for x in _set_ids(h, first))
                want = np.flatnonzero(np.isin(s1, ids.value)) if ids is not None else np.arange(len(s1))
                keys = zip(want.tolist(), s1[want].tolist(), s2[want].tolist(), strict=True)
                want = [i for i, x, y in keys if first[i + 1] > first[i] and not ((x, y) in seen or seen.add((x, y)))]
                if len(seen) > 1_000_000:
                    seen.clear()
                if want:
                    yield pa.RecordBatch.from_arrays([pa.array(s1[want]), pa.array(s2[want]), pa.array([h[first[i] : first[i + 1]].tobytes() for i in want], pa.binary())], names=["s1", "s2", "elements"])

    return docs.mapInArrow(sets, "s1 long, s2 long, elements binary")


def _verified(tasks: DataFrame, kinds: DataFrame, docs: DataFrame, k: int, percent: int, none) -> DataFrame:
    """Of the candidate pairs (task, a, b), those that link, by their whole sets; each set goes once to each task that needs it."""
    places = cut(tasks.select("task", F.explode(F.array("a", "b")).alias("node")).distinct().join(kinds.select("node", "s1", "s2"), "node"))
    found = _elements(places.select("s1", "s2"), docs, k, none)
    carried = places.join(found, ["s1", "s2"]).select("task", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "elements")
    both = carried.unionAll(tasks.select("task", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("elements")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, have = None, {}
        for batch in batches:
            ones, twos = [], []
            t, kind, a, b = (K.columns(batch, c).to_pylist() for c in ("task", "kind", "a", "b"))
            e = K.columns(batch, "elements")
            for x in range(batch.num_rows):
                if t[x] != task:
                    task, have = t[x], {}
                if not kind[x]:
                    have[a[x]] = np.frombuffer(e[x].as_buffer(), K.U64).copy()  # a view would keep the whole batch
                    continue
                p, q = have[a[x]], have[b[x]]
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                if 100 * common >= percent * (len(p) + len(q) - common):
                    ones.append(a[x])
                    twos.append(b[x])
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], names=["a", "b"])

    return both.repartition("task").sortWithinPartitions("task", "kind").mapInArrow(compare, "a long, b long")


def common(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many elements each set of `one` shares with each of `two` (places in `sets`).

    Elements that few sets hold are counted pair by pair, others by products of 0/1 blocks: what is cheaper.
    """
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kinds, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1  # an element of one set only is shared with none
    who, column = who[keep], column[keep]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    out = np.zeros((len(one), len(two)), np.int32)
    row_one, row_two = np.full(len(sets), -1), np.full(len(sets), -1)
    row_one[one], row_two[two] = np.arange(len(one)), np.arange(len(two))
    start = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(column)))
    sparse = size * size * DENSE <= len(one) * len(two)
    flat = out.reshape(-1)
    for m in np.unique(size[sparse]).tolist():
        at = start[sparse & (size == m)]
        x, y = (g.ravel() for g in np.meshgrid(np.arange(m), np.arange(m), indexing="ij"))
        step = max(1, 1_000_000 // len(x))
        for c in range(0, len(at), step):
            i, j = row_one[who[(at[c : c + step, None] + x).ravel()]], row_two[who[(at[c : c + step, None] + y).ravel()]]
            ok = (i >= 0) & (j >= 0)
            np.add.at(flat, i[ok] * len(two) + j[ok], 1)
    dense = np.repeat(~sparse, size)
    who, column = who[dense], np.repeat(np.cumsum(~sparse) - 1, size)[dense]
    n = int((~sparse).sum())
    for c in range(0, n, BLOCK):
        a, b = np.searchsorted(column, (c, c + BLOCK))
        block = np.zeros((len(sets), min(BLOCK, n - c)), np.float32)
        block[who[a:b], column[a:b] - c] = 1
        out += (block[one] @ block[two].T).astype(np.int32)
    return out


def _class_links(classes: DataFrame, kinds: DataFrame, docs: DataFrame, k: int, percent: int, none, chunk: int, elements: int) -> DataFrame:
    """node, links: per member of a class (node, root), part by part, how many others of the class link with it.

    A task compares two chunks of a class, of about `chunk` sets or `elements` elements each, and returns a row for each of
    their members, never the pairs. A set travels once for each chunk of its class.
    """
    keys = ["root", "ci", "cj"]
    classes = classes.join(kinds.select("node", "s1", "s2", "n"), "node")
    sizes = classes.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    sized = cut(classes.join(sizes, "root"))
    twos = sized.where("m = 2").select("node", F.lit(1).cast("long").alias("links"))
    many = sized.where("m > 2").withColumn("chunks", F.greatest(F.ceil(F.col("m") / F.lit(chunk)), F.ceil(F.col("total") / F.lit(elements))).cast("int"))
    placed = many.withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = placed.select("root", "side", "node", "s1", "s2", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    members = spread.select("root", F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj"), "side", F.col("node").alias("s"), "s1", "s2")
    found = _elements(many.select("s1", "s2"), docs, k, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}  # several tasks may have sent the same set

        def counted() -> pa.RecordBatch:
            s, side = np.array(list(held), np.int64), np.array([x[0] for x in held.values()])
            sets = [np.frombuffer(x[1], K.U64) for x in held.values()]
            n = np.array([len(x) for x in sets], np.int64)
            one, two = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
            both = common(sets, one, two)
            ok = 100 * both >= percent * (n[one][:, None] + n[two] - both)
            ok &= one[:, None] != two
            s, links = (s[one], ok.sum(1)) if key[1] == key[2] else (np.concatenate([s[one], s[two]]), np.concatenate([ok.sum(1), ok.sum(0)]))
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(links.astype(np.int64))], names=["node", "links"])

        for batch in batches:
            for *now, side, s, elements in zip(*(K.columns(batch, c).to_pylist() for c in (*keys, "side", "s", "elements")), strict=True):
                if now != key:
                    if held:
                        yield counted()
                    key, held = now, {}
                held[s] = side, elements
        if held:
            yield counted()

    carried = members.join(found, ["s1", "s2"]).repartition(*keys).sortWithinPartitions(*keys)
    return carried.select(*keys, "side", "s", "elements").mapInArrow(run, "node long, links long").unionAll(twos)


def components(docs: DataFrame, *, k: int = 5, percent: int = 75, star: int = 16, dense: int = 4096, chunk: int = 256, sample_one_in: int = 32, frequent: int = 6, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (the set's digest), mark (xxhash64 of the text), component_id and links per row.

    component_id: the smallest doc_id reachable by links between rows' sets; links: how many different sets link with
    the row's set (null where not `counted`: the pairs inside the classes that stars make are compared for it alone).
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    key = secrets.token_bytes(16)
    none = spark.sparkContext.broadcast(Hashing(key, np.zeros(0, K.U64)))
    last = spark.sparkContext.broadcast(Hashing(key, _frequent(docs, k, sample_one_in, frequent, none)))
    kinds = cut(_kinds(docs, k, percent, last))
    groups = cut(_groups(kinds, dense))
    texts = docs.select("text")

    # a group's hub is the member with the most frequent shingles: what near copies have in common, if it is there
    # itself; groups of one hub hold much the same members and are searched as one
    rated = groups.join(kinds.select("node", "usual"), "node")
    hubs = rated.groupBy("g1", "g2").agg(F.max(F.struct("usual", "node"))["node"].alias("hub"), F.count(F.lit(1)).alias("size"))
    near = cut(groups.join(hubs, ["g1", "g2"]).groupBy("hub", "node").agg(F.max("size").alias("size")))
    # a star is cut into tasks of about `chunk` members, each with the hub's own set
    arms = near.where((F.col("size") > star) & (F.col("hub") != F.col("node")))
    arms = arms.join(arms.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks")), "hub")
    stars = arms.select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("task"), F.col("hub").alias("a"), F.col("node").alias("b"))
    first = _verified(cut(_pruned(stars, kinds, percent)), kinds, texts, k, percent, none)
    first = cut(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    classes = cut(connected(first))
    named = near.join(classes, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("label"))
    live = named.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / F.lit(max(2, dense // 4))).cast("int").alias("parts")).where("lo <> hi").select("hub", "parts")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = named.join(live, "hub").withColumn("side", own).select("hub", "node", "label", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    members = spread.join(kinds.select("node", "n", "bits"), "node").select("hub", F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj"), "side", "node", "n", "bits", "label")
    second = cut(_verified(cut(_candidates(members, percent)), kinds, texts, k, percent, none))

    links = cut(first.unionAll(second).distinct())
    known = connected(links)
    if counted:
        # links of the second search join different classes; those inside a class are counted there
        across = second.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links"))
        inside = _class_links(classes, kinds, texts, k, percent, none, 16 * chunk, 2_000_000)
        known = known.join(across.unionAll(inside).groupBy("node").agg(F.sum("links").alias("links")), "node")
    else:
        known = known.withColumn("links", F.lit(None).cast("long"))
    # rows are counted by set, sets by component, before either is joined; a set without links is its own component
    rows = cut(_rows(docs, k, none))
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_rows"))
    held = cut(sets.join(kinds.select("node", "s1", "s2"), ["s1", "s2"]).join(known, "node", "left").select("s1", "s2", "least", "_rows", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) if counted else F.col("links")).alias("links")))
    tops = cut(held.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_sets")))
    side = cut(keyed_join(held.select("root", "s1", "s2", "_rows", "links"), tops, ["root"], "_sets").select("s1", "s2", "_rows", "component_id", "links"))
    out = ["doc_id", "mark", "n_shingles", "s1", "s2", "component_id", "links"]
    linked = keyed_join(rows.where("n > 0").withColumnRenamed("n", "n_shingles"), side, ["s1", "s2"], "_rows").select(*out)
    alone = rows.where("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), "s1", "s2", F.col("doc_id").alias("component_id"), F.lit(0 if counted else None).cast("long").alias("links"))
    return linked.unionAll(alone)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and links per document."""
    return components(docs, **options).select("doc_id", "n_shingles", "component_id", "links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each component: that of its smallest doc_id.

    Rows of that doc_id whose texts also belong to the component stay together, as do rows without a doc_id.
    """
    found = components(docs, counted=False, **options).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("component_id").alias("_component")).where("_id is not null and _id <> _component")
    gone = found.select("_id", "_mark").distinct()
    rows, back = aside(docs, "doc_id", "text")
    return back(rows.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left_anti"))

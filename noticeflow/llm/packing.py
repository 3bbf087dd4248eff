"""Operator 6, sequence packing: best-fit decreasing with a segment tree over remaining capacities.

Each task encodes the texts of its own partition, cuts documents of more than a window into full windows and
packs the remainders, longest first, each into the tightest open window that still has room. Nothing is
shuffled: packing needs no meeting of particular documents. Remainders stay whole, so padding depends on their lengths: remainders of
a little more than half a window each leave nearly half of one, mixed lengths (the usual case) leave little; at most one window of a
block is less than half full. Only piece sizes and checksums are held, never the ids of a partition.

Defined results: null or empty text is a document of only the end id; repeated rows are packed one by one;
an empty table gives no pieces; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noticeflow.llm import kernel as K
from noticeflow.llm.pieces import encoder
from noticeflow.llm.shared import only

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A segment tree over capacities 0..window: each leaf lists the open windows with that room left."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1 - 1).bit_length()
        if self.leaves < window + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window_id: int) -> None:
        self.open.setdefault(room, []).append(window_id)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least `need`."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        got = self.open[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, got


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece (of at most a window) its window and offset there; the number of windows."""
    at_window, at_offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if need == window:
            at_window[i], made = made, made + 1
            continue
        if (found := tree.take(need)) is None:
            found, made = (window, made), made + 1
        room, w = found
        at_window[i], at_offset[i] = w, window - room
        if room > need:
            tree.add(room - need, w)
    return at_window, at_offset, made


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, fold: bool = False, block_pieces: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    block_pieces bounds the sizes that a task holds before it packs and emits them.
    fold tells that the tokenizer lower-cases ASCII, see PieceEncoder.
    """

    def packed(parts: list[tuple], task: int, made: int) -> tuple[pa.RecordBatch, int]:
        doc, null, start, length, crc, total = (np.concatenate([p[i] for p in parts]) for i in range(6))
        w, offset, n = best_fit_decreasing(length, window)
        arrays = [pa.array(doc, pa.int64(), mask=null), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, total, (task << 40) + made + w, offset))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), made + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        K.release()  # in a pipeline the worker still holds what the stages before needed
        encode = encoder(tokenizer_path, fold, True)
        parts, held, made = [], 0, 0
        for batch in batches:
            ids_column = K.columns(batch, "doc_id")
            null_all = np.asarray(ids_column.is_null())
            doc_all = ids_column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for r0, r1, data, offsets in K.blocks(K.columns(batch, "text")):
                flat, at = encode.ids(data, offsets)
                n = np.diff(at)
                # the end id follows each document's ids
                full = np.insert(flat, at[1:], np.uint32(end_id)).astype("<u4", copy=False)
                total = n + 1
                base = np.cumsum(total) - total
                count = -(-total // window)
                row = np.repeat(np.arange(r1 - r0), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * window
                length = np.minimum(window, total[row] - start)
                view = memoryview(full.tobytes())
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip((base[row] + start).tolist(), length.tolist(), strict=True)), np.int64, len(row))
                parts.append((doc_all[r0:r1][row], null_all[r0:r1][row], start, length, crc, total[row]))
                held += len(row)
                if held >= block_pieces:
                    out, made = packed(parts, task, made)
                    yield out
                    parts, held = [], 0
        if held:
            yield packed(parts, task, made)[0]

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)

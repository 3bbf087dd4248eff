"""Vectorised text kernels shared by the operators: numpy over the UTF-8 bytes of Arrow batches.

Every kernel works on blocks of whole texts of bounded size, so memory follows the block size (or one
single longer text), never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the entropy of 64-bit values over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept per worker, grown when needed)."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; null rows have length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * width).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about `most` bytes each."""
    raw, at = string_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Rolling:
    """Hashes of the `length` bytes from each position: they only choose places; what is found there is compared by its bytes."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """The hash of the `length` bytes from each position that has so many after it."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + U64(length))


#: Spans of up to SHORT bytes are their own key; of longer ones a worker remembers some, those of up to MIDDLE bytes in a table.
SHORT, MIDDLE, SLOTS, REMEMBERED = 7, 16, 1 << 19, 100_000
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], U64)


class Spans:
    """Byte spans of a block, eight bytes at a time: whole spans compare by two overlapping loads and their size."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.data, self.starts, self.ends, self.sizes = data, starts, ends, ends - starts
        self.loads = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))

    def short_keys(self) -> np.ndarray:
        """For spans of up to SHORT bytes, bytes and size as one number: different spans have different ones."""
        few = np.minimum(self.sizes, SHORT)
        return (self.loads[self.starts] & _MASKS[few]) | (few.astype(U64) << U64(56))

    def values(self, table: SpanTable, make: Callable[[bytes], int]) -> tuple[np.ndarray, np.ndarray]:
        """(which, values) of the spans of more than SHORT bytes; what the table doesn't hold is made from the span."""
        which = np.flatnonzero(self.sizes > SHORT)
        out = np.zeros(len(which), U64)
        middle = np.flatnonzero(self.sizes[which] <= MIDDLE)
        w = which[middle]
        one, two, size = self.loads[self.starts[w]], self.loads[self.ends[w] - 8], self.sizes[w].astype(np.uint8)
        slot, hit = table.find(one, two, size)
        out[middle] = table.value[slot]
        slow = np.ones(len(which), bool)
        slow[middle[hit]] = False
        slow = np.flatnonzero(slow)
        if len(slow):
            raw, at = self.data.tobytes(), which[slow]
            out[slow] = np.array([make(raw[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)], U64)
            new = np.flatnonzero(~hit)
            table.put(slot[new], one[new], two[new], size[new], out[middle[new]])
        return which, out


class SpanTable:
    """Values of spans of SHORT + 1 to MIDDLE bytes, one per slot; a slot's span is compared whole, a later one replaces it."""

    def __init__(self):
        self.one, self.two, self.value = (np.zeros(SLOTS, U64) for _ in range(3))
        self.size = np.zeros(SLOTS, np.uint8)

    def find(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (mix(one ^ mix(two + size)) & U64(SLOTS - 1)).astype(np.int64)
        return slot, (self.one[slot] == one) & (self.two[slot] == two) & (self.size[slot] == size)

    def put(self, slot, one, two, size, value) -> None:
        self.one[slot], self.two[slot], self.size[slot], self.value[slot] = one, two, size, value


class SpanNumbers:
    """Numbers of distinct spans, in the order in which they come. Spans of up to MIDDLE bytes stand in arrays and are found by open
    addressing, all of a block at once; longer ones in a dictionary. What is found is compared whole."""

    _FULL = np.append(_MASKS, U64(_MASK))

    def __init__(self):
        self.one, self.two = (np.zeros(1 << 12, U64) for _ in range(2))
        self.size = np.zeros(1 << 12, np.uint8)
        self.slots = np.full(1 << 13, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.known = 0
        self.secret = np.frombuffer(os.urandom(8), U64)[0]  # so that no text can be written whose spans all meet in one slot

    def _slot(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(one ^ mix((two + size) ^ self.secret))

    def _find(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The number of each span, -1 where it has none."""
        last = U64(len(self.slots) - 1)
        slot = (mixed & last).astype(np.int64)
        out = self.slots[slot].astype(np.int64)
        left = np.arange(len(out))
        while True:
            n = out[left]
            left = left[(n >= 0) & ((self.one[n] != one[left]) | (self.two[n] != two[left]) | (self.size[n] != size[left]))]
            if not len(left):
                return out
            slot[left] = (slot[left] + 1) & int(last)
            out[left] = self.slots[slot[left]]

    def _put(self, numbers: np.ndarray) -> None:
        """Gives each number a slot; all are of spans that have none."""
        if 2 * self.known > len(self.slots):
            self.slots = np.full(1 << (4 * self.known).bit_length(), -1, np.int32)
            numbers = np.flatnonzero(self.size[: self.known])
        last = len(self.slots) - 1
        slot = (self._slot(self.one[numbers], self.two[numbers], self.size[numbers]) & U64(last)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]  # of several that want one slot the last stays there
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & last

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span; and, in the order of their numbers, one span of each number that is new."""
        spans = Spans(data, starts, ends)
        out, known = np.zeros(len(starts), np.int64), self.known
        short = np.flatnonzero(spans.sizes <= MIDDLE)
        size = spans.sizes[short]
        one = spans.loads[starts[short]] & self._FULL[np.minimum(size, 8)]
        two = np.where(size > 8, spans.loads[np.maximum(ends[short] - 8, 0)], U64(0))
        size = size.astype(np.uint8)
        mixed = self._slot(one, two, size)
        out[short] = found = self._find(one, two, size, mixed)
        new = np.flatnonzero(found < 0)
        new = new[np.argsort(mixed[new], kind="stable")]
        if len(new):
            o, t, z = one[new], two[new], size[new]
            first = np.ones(len(new), bool)
            first[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1])
            out[short[new]] = self.known + np.cumsum(first) - 1
            o, t, z, new = o[first], t[first], z[first], new[first]
            self.known += len(new)
            self._room()
            self.one[known : self.known], self.two[known : self.known], self.size[known : self.known] = o, t, z
            self._put(np.arange(known, self.known))
        new = [short[new]]
        if len(long := np.flatnonzero(spans.sizes > MIDDLE)):
            raw = data.tobytes()
            before, n = self.known, []
            for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
                if (at := self.long.setdefault(raw[a:b], self.known)) == self.known:
                    self.known += 1
                    n.append(i)
                out[i] = at
            self._room()
            self.size[before : self.known] = 0
            new.append(np.array(n, np.int64))
        return out, np.concatenate(new)

    def _room(self) -> None:
        if self.known > len(self.one):
            self.one, self.two, self.size = (np.concatenate([x, np.zeros(2 * self.known - len(x), x.dtype)]) for x in (self.one, self.two, self.size))

    def keep(self, numbers: np.ndarray) -> None:
        """Forgets all others; these are numbered anew, in the order given."""
        now = np.full(self.known, -1, np.int64)
        now[numbers] = np.arange(len(numbers))
        one, two, size, long = self.one[numbers], self.two[numbers], self.size[numbers], self.long
        self.__init__()
        self.long = {span: n for span, at in long.items() if (n := int(now[at])) >= 0}
        self.known = len(numbers)
        self._room()
        self.one[: self.known], self.two[: self.known], self.size[: self.known] = one, two, size
        self._put(np.flatnonzero(size))


#: What a worker remembers of the words hashed with one key; another key starts anew.
_KNOWN: dict[bytes, tuple[SpanTable, dict[bytes, int]]] = {}


def _long_hash(span: bytes, key: bytes, known: dict[bytes, int]) -> int:
    if (h := known.get(span)) is None:
        h = int.from_bytes(hashlib.blake2b(span, digest_size=8, key=key).digest(), "little")
        if MIDDLE < len(span) <= 64:
            if len(known) >= REMEMBERED:
                known.clear()
            known[span] = h
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes = b"") -> np.ndarray:
    """64-bit hashes of byte spans. Those of up to SHORT bytes never collide with each other; longer ones have BLAKE2b's.

    key: 16 secret bytes of a run. Without them both can be computed, and inverted, by who writes the texts: what is combined
    further (shingles) needs a key, or words that are compared.
    """
    if not len(starts):
        return np.zeros(0, U64)
    spans = Spans(data, starts, ends)
    out = mix(spans.short_keys())
    if key:
        one, two = np.frombuffer(key, "<u8")
        out = mix(mix(out ^ one) + two)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = SpanTable(), {}
    table, known = _KNOWN[key]
    which, values = spans.values(table, lambda span: _long_hash(span, key, known))
    out[which] = values
    return out


def release() -> None:
    """Drops what the worker remembers of words and powers (other operators' tasks ran in it before), and gives unused memory back."""
    _KNOWN.clear()
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that don't cross row borders."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        shift = w - have
        out = np.minimum(out[: len(out) - shift], out[shift:])
    return out


def windows_in_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Whether each item starts a window of k items inside its row; first: item index where each row starts, and the end."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    sizes = np.diff(first)
    for back in range(1, k):
        rows = first[1:][sizes >= back] - back
        ok[rows] = False
    return ok


def shingles(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (rows aren't respected here)."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = wh[:n].copy()
    for j in range(1, k):
        h *= U64(0x9FB21C651E98DF25)
        h += wh[j : j + n]
    return mix(h)


#: Fixed byte classes: ASCII space and tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
#: 0-9, a-z and everything beyond ASCII (after lower-casing A-Z).
WORDY = np.zeros(256, bool)
WORDY[0x30:0x3A] = WORDY[0x61:0x7B] = WORDY[0x80:] = True


class Words:
    """Words of a block of texts: byte spans, hashes, lengths, and the word index at which each row starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True, key: bytes = b""):
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = runs(table[self.data], offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = span_hashes(self.data, self.starts, self.ends, key)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """The words with a space after each, and where each starts there (and the end)."""
        sizes = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts - at[:-1], sizes) + np.arange(at[-1])
        out = self.data[np.minimum(take, len(self.data) - 1)] if len(self.data) else self.data
        out[at[1:] - 1] = 0x20
        return out.tobytes(), at

    def texts(self, a: int, b: int) -> list[bytes]:
        return [self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(a, b)]


def columns(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mapped(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow from one that takes a batch and yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return run

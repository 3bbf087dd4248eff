"""Exact tokenizer output through a cache of pieces.

A text is cut where the tokenizer's pre-tokenizer always has a border whatever surrounds it; each distinct
piece is encoded once by the tokenizers library and its ids are looked up afterwards. A cut is made only
before a plain space or line feed that follows a visible character, and between letters and a few ASCII
marks that are in no special token, so special strings inside texts stay whole and reach the library.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from noticeflow.llm import kernel as K

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_MARK = np.zeros(256, bool)
_MARK[list(b'.,!?;:*%$&#"()')] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: Second bytes after 0xC3 that are letters: all but the multiplication and division signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where pieces start; every row with bytes starts one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    lead = data == 0xC3
    tail = np.zeros(n, bool)
    tail[1:] = lead[:-1]
    latin_end = tail & _LATIN[data]  # last byte of a two-byte letter
    letter_end = _LETTER[data] | latin_end
    latin_start = np.zeros(n, bool)
    latin_start[:-1] = latin_end[1:]
    letter_start = _LETTER[data] | latin_start
    mark = _MARK[data]
    start = np.zeros(n, bool)
    start[1:] = _BREAK[data[1:]] & (_VISIBLE[data[:-1]] | tail[:-1])
    start[1:] |= mark[1:] & letter_end[:-1]
    start[1:] |= letter_start[1:] & mark[:-1]
    rows = offsets[:-1]
    start[rows[rows < offsets[1:]]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Ids or counts of whole texts, as tokenizers gives them for the file at `path`.

    most: entries with which the cache drops its rarer half in this worker (a bound of memory, not of results).
    fold: the tokenizer lower-cases, so ASCII letters may be folded before the cache is asked.
    """

    def __init__(self, path: str, fold: bool = False, most: int = 200_000, keep_ids: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fold, self.most, self.keep_ids = fold, most, keep_ids
        self.clear()

    def clear(self) -> None:
        self.numbers = K.SpanNumbers()
        self.sizes = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _shrink(self) -> None:
        """Keeps what came again and again, at most half of what the cache may hold; older finds count half."""
        n = self.numbers.known
        keep = np.argsort(-self.hits[:n], kind="stable")[: self.most // 2]
        keep = keep[(self.hits[keep] > 1) & (np.cumsum(self.sizes[keep], dtype=np.int64) <= 4 * self.most)]
        numbers, sizes, at, hits, store = self.numbers, self.sizes[keep], self.at[keep], self.hits[keep], self.store
        self.clear()
        numbers.keep(keep)
        self.numbers = numbers
        self._room(len(keep))
        self.sizes[: len(keep)], self.hits[: len(keep)] = sizes, hits // 2
        if self.keep_ids:
            end = np.cumsum(sizes, dtype=np.int64)
            self._ids_room(int(sizes.sum()))
            self.store[: self.used] = store[np.repeat(at - end + sizes, sizes) + np.arange(self.used)]
            self.at[: len(keep)] = end - sizes

    def _room(self, n: int) -> None:
        if n > len(self.sizes):
            self.sizes, self.at, self.hits = (np.concatenate([x, np.zeros(2 * n - len(x), x.dtype)]) for x in (self.sizes, self.at, self.hits))

    def _ids_room(self, n: int) -> int:
        """Where n more ids go."""
        at = self.used
        self.used += n
        if self.used > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(2 * self.used - len(self.store), np.uint32)])
        return at

    def _add(self, first: int, texts: list[str]) -> None:
        """Encodes new pieces, numbered from `first`."""
        self._room(first + len(texts))
        for a in range(0, len(texts), 1024):
            found = self.tokenizer.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            here = slice(first + a, first + a + len(found))
            self.sizes[here] = sizes
            if self.keep_ids:
                n = int(sizes.sum())
                at = self._ids_room(n)
                self.store[at : at + n] = np.fromiter(chain.from_iterable([e.ids for e in found]), np.uint32, n)
                self.at[here] = at + np.cumsum(sizes) - sizes

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its place in the cache; for each row its first piece (and the end)."""
        if self.fold and b"|>" not in data.tobytes():
            data = K.LOWER[data]
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), first
        if self.numbers.known >= self.most or self.used >= 16 * self.most:
            self._shrink()
        known = self.numbers.known
        places, new = self.numbers.of(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            self._add(known, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        self.hits[: self.numbers.known] += np.bincount(places, minlength=self.numbers.known)
        return places, first

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        places, first = self.pieces(data, offsets)
        total = np.zeros(len(places) + 1, np.int64)
        np.cumsum(self.sizes[places], out=total[1:])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, row after row, and each row's offset among them."""
        places, first = self.pieces(data, offsets)
        sizes = self.sizes[places].astype(np.int64)
        total = np.zeros(len(places) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        flat = self.store[np.repeat(self.at[places] - total[:-1], sizes) + np.arange(total[-1])]
        return flat, total[first]


_KEPT: dict[tuple, PieceEncoder] = {}


def encoder(path: str, fold: bool, keep_ids: bool) -> PieceEncoder:
    """The worker's encoder for this file; it and its cache serve all tasks that the worker runs."""
    key = (path, fold, keep_ids)
    if key not in _KEPT:
        _KEPT[key] = PieceEncoder(path, fold, keep_ids=keep_ids)
    return _KEPT[key]

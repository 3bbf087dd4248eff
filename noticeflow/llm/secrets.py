"""Operator 4, secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Texts are cut into tokens (runs of letters, digits and `+/_-`; runs of other visible bytes). The field tags
each as begin, inside or outside of a secret from the token's shape, the words around it and features of
the whole text, and is decoded by Viterbi. It is trained here, on sentences that a seeded generator makes, by
gradient ascent on the conditional likelihood. Decoding is exact but skips most tokens: where a token's best
secret tag is so far behind that no transition can make up for it, it is outside in every best path, so
Viterbi runs only on the stretches between such tokens.

Defined results: null text counts as empty; empty texts have no spans; repeated rows and null ids keep their
row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import only

#: Fixed patterns of the base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

O, B, I = 0, 1, 2  # noqa: E741
SHAPES = 64 * 8 * 4
FILE_SLOTS = 8
_TOKEN = np.zeros(256, np.uint8)  # 1: letters, digits, +/_- and beyond ASCII; 2: other visible bytes
_TOKEN[0x21:0x7F] = 2
_TOKEN[list(b"+/_-" + string.digits.encode() + string.ascii_letters.encode())] = 1
_TOKEN[0x80:] = 1
_BITS = np.zeros(256, np.uint8)  # classes of bytes that a shape tells apart
_BITS[0x61:0x7B] = 1
_BITS[0x41:0x5B] = 2
_BITS[0x30:0x3A] = 4
_BITS[0x80:] = 8
_BITS[list(b"+/_-")] = 16
_BITS[(_TOKEN == 2)] = 32


def base_spans(body: bytes, hex_runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed kinds, by start and kind; byte offsets."""
    out = []
    if b":" in body or b"=" in body:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(body) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in body:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(body) if m.end() - m.start() >= LEAST["access"]]
    if hex_runs is None:
        hex_runs = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-f]{16,}", body)]
    out += [(a, b, 2) for a, b in hex_runs]
    return sorted(out, key=lambda x: (x[0], x[2]))


class Tokens:
    """Tokens of a block of texts, with the features of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _TOKEN[data]
        s1, e1 = K.runs(kind == 1, offsets)
        s2, e2 = K.runs(kind == 2, offsets)
        start, end = np.concatenate([s1, s2]), np.concatenate([e1, e2])
        order = np.argsort(start, kind="stable")
        self.start, self.end = start[order], end[order]
        n = len(self.start)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if not n:
            self.shape = self.file = np.zeros(0, np.int64)
            self.word = np.zeros(0, K.U64)
            return
        bits = _BITS[data]
        edges = np.stack([self.start, self.end], 1).ravel()
        edges = np.minimum(edges, len(data) - 1)
        seen = np.bitwise_or.reduceat(bits, edges)[::2].astype(np.int64)
        one = self.end - self.start == 1
        seen[one] = bits[self.start[one]]
        tail = self.end == len(data)
        if tail.any():
            t = int(np.flatnonzero(tail)[0])
            seen[t] = np.bitwise_or.reduce(bits[self.start[t] : self.end[t]])
        turn = np.zeros(len(data) + 1, np.int64)
        digit = bits == 4
        turn[2:] = np.cumsum(digit[1:] != digit[:-1])
        turns = turn[self.end] - turn[self.start + 1]
        length = self.end - self.start
        by_length = np.searchsorted([4, 8, 12, 16, 20, 32, 64], length, "right")
        by_turn = np.searchsorted([1, 3, 6], turns, "right")
        self.shape = (seen * 8 + by_length) * 4 + by_turn
        self.word = K.span_hashes(K.LOWER[data], self.start, self.end)
        # of the whole text: how many tokens mix letters and digits, and whether it assigns anything
        mixed = (seen & 4 > 0) & (seen & 3 > 0)
        share = np.bincount(self.row, mixed, len(offsets) - 1) / np.maximum(np.diff(self.first), 1)
        eq = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x3D, out=eq[1:])
        assigns = eq[offsets[1:]] > eq[offsets[:-1]]
        self.file = (np.searchsorted([0.001, 0.01, 0.1], share, "right") * 2 + assigns)[self.row]

    def neighbour(self, at: np.ndarray, gap: int, known: np.ndarray) -> np.ndarray:
        """For tokens `at`, the place in `known` of the word `gap` on; its size for another word, one more for none."""
        j = at + gap
        k = np.minimum(np.maximum(j, 0), len(self.word) - 1)
        inside = (j == k) & (self.row[k] == self.row[at])
        place = np.searchsorted(known, self.word[k])
        place[place == len(known)] = 0
        place = np.where(known[place] == self.word[k], place, len(known))
        return np.where(inside, place, len(known) + 1)


@dataclass
class Field:
    """Weights of the conditional random field: emissions by feature and tag, and transitions (from, to)."""

    shape: np.ndarray
    near: dict[int, np.ndarray]  # by gap: words around
    file: np.ndarray
    move: np.ndarray
    known: np.ndarray  # hashes of the words that context tells apart

    def emissions(self, t: Tokens, at: np.ndarray) -> np.ndarray:
        out = self.shape[t.shape[at]] + self.file[t.file[at]]
        for gap, w in self.near.items():
            out = out + w[t.neighbour(at, gap, self.known)]
        return out

    def spans(self, t: Tokens) -> list[tuple[int, int, int]]:
        """(row, start byte, end byte) of secrets: the Viterbi path of each text's tokens."""
        if not len(t.shape):
            return []
        ahead = lambda w: (w[..., 1:].max(-1) - w[..., 0])
        most = ahead(self.file).max() + sum(ahead(w).max() for w in self.near.values())
        slack = 2 * (self.move.max() - self.move.min())
        # outside in every best path: changing such a token to outside always gains
        open_ = np.flatnonzero(ahead(self.shape)[t.shape] + most + slack >= 0)
        if not len(open_):
            return []
        e = self.emissions(t, open_)
        live = ahead(e) + slack >= 0
        open_, e = open_[live], e[live]
        if not len(open_):
            return []
        cut_ = np.flatnonzero((np.diff(open_) > 1) | (t.row[open_[1:]] != t.row[open_[:-1]])) + 1
        out = []
        for part, em in zip(np.split(open_, cut_), np.split(e, cut_), strict=True):
            tags = viterbi(em, self.move)
            for a in np.flatnonzero(tags):
                if tags[a] == B or a == 0 or tags[a - 1] == O:
                    b = a + 1
                    while b < len(tags) and tags[b] == I:
                        b += 1
                    out.append((int(t.row[part[a]]), int(t.start[part[a]]), int(t.end[part[b - 1]])))
        return out


def viterbi(emissions: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of a stretch that outside tokens (or borders of the text) surround."""
    score, back = move[O] + emissions[0], []
    for e in emissions[1:]:
        all_ = score[:, None] + move
        back.append(all_.argmax(0))
        score = all_.max(0) + e
    tag = int((score + move[:, O]).argmax())
    tags = [tag]
    for b in reversed(back):
        tags.append(tag := int(b[tag]))
    return np.array(tags[::-1])


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up texts with secrets (spans) among things that only look like them."""
    r = random.Random(seed)
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: r.choice([str.lower, str.lower, str.lower, str.capitalize])(some(string.ascii_lowercase + "éüñ", 1, 11)) + r.choice(["", "", "", "", ",", "."])
    hexa, mixed, base64_ = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    upper = string.ascii_uppercase + string.digits
    keys = ["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "access_token", "client_secret", "pwd", "auth", "private_key"]
    out = []
    for _ in range(n):
        text, spans, rare = "", [], r.choice([1, 1, 4, 20])
        for _ in range(r.randint(4, 36)):
            kind = r.random() * rare
            lead, value = "", ""
            if kind < 0.10:
                lead = r.choice(keys) + r.choice(["=", ": ", " = ", ' = "', "='", '": "'])
                value = r.choice([some(hexa, 16, 40), some(mixed, 12, 40), some(base64_, 16, 44)])
            elif kind < 0.14:
                value = "AKIA" + some(upper, 14, 18)
            elif kind < 0.18:
                lead, value = r.choice(["Bearer ", "Authorization: ", ""]), r.choice(["ghp_", "xoxb-", "sk_live_", "glpat-"]) + some(mixed, 20, 36)
            elif kind < 0.20:
                value = some(hexa, 32, 64)
            elif kind < 0.23:
                text += f"{some(string.ascii_lowercase, 3, 9)}.{r.randint(1, 99)}@{some(string.ascii_lowercase, 3, 8)}{r.randint(1, 9)}.example.com "
            elif kind < 0.26:
                text += r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} ", f"{r.randint(1, 255)}.{r.randint(1, 255)}.0.{r.randint(1, 255)} ", f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000, 9999999)} ", f"v{r.randint(1, 9)}.{r.randint(0, 20)} ", f"{r.randint(1, 10**9)} ", f"https://{some(string.ascii_lowercase, 3, 9)}.net/{some(string.ascii_lowercase, 2, 8)}/{r.randint(1, 99999)} "])
            elif kind < 0.29:
                text += r.choice([some(string.ascii_uppercase, 3, 30), some(string.ascii_lowercase, 16, 40), "=" * r.randint(1, 30), "-" * r.randint(3, 30), f"name: {word()}", f"token of {word()}", "password: changed", some(string.ascii_lowercase, 2, 6) + str(r.randint(1, 999))]) + " "
            else:
                text += word() + r.choice([" "] * 9 + ["\n"])
            if value:
                start = len((text + lead).encode())
                spans.append((start, start + len(value)))
                text += lead + value + r.choice(['"', "'", "", "", "", "."]) + " "
        out.append((text, spans))
    return out


_TRAINED: dict[tuple, Field] = {}


def train(*, texts: int = 1200, epochs: int = 35, rate: float = 0.3, decay: float = 0.3, least: int = 20, seed: int = 11) -> Field:
    """Conditional maximum likelihood by Adagrad, forward and backward sums over all texts at once.

    Words that come up `least` times are features of their neighbours; the shape also counts by its parts, so that
    an unseen one isn't blank.
    """
    key = (texts, epochs, rate, decay, least, seed)
    if key in _TRAINED:
        return _TRAINED[key]
    made = sentences(texts, seed)
    raw = b"".join(t.encode() for t, _ in made)
    offsets = np.cumsum([0] + [len(t.encode()) for t, _ in made])
    t = Tokens(np.frombuffer(raw, np.uint8), offsets)
    gold = np.zeros(len(t.shape), np.int64)
    for i, (_, spans) in enumerate(made):
        for a, b in spans:
            a, b = a + offsets[i], b + offsets[i]
            who = np.flatnonzero((t.start >= a) & (t.end <= b))
            gold[who] = I
            gold[who[:1]] = B
    gaps = (-3, -2, -1, 1)
    values, count = np.unique(t.word, return_counts=True)
    known = values[count >= least]
    all_ = np.arange(len(gold))
    features = [t.shape, t.shape // 32, t.shape // 4 % 8, t.shape % 4, t.file, *(t.neighbour(all_, g, known) for g in gaps)]
    weights = [np.zeros((n, 3)) for n in (SHAPES, 64, 8, 4, FILE_SLOTS, *([len(known) + 2] * len(gaps)))] + [np.zeros((3, 3))]
    squares = [np.full_like(w, 1e-2) for w in weights]
    size = np.diff(t.first)
    steps = int(size.max())
    grid = np.minimum(t.first[:-1, None] + np.arange(steps), len(gold) - 1)
    on = np.arange(steps) < size[:, None]
    y = np.where(on, gold[grid], O)
    tag = np.eye(3)
    for _ in range(epochs):
        emit = sum(w[f] for w, f in zip(weights, features))
        move = weights[-1]
        e = np.where(on[:, :, None], emit[grid], np.array([0.0, -1e9, -1e9]))
        lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
        f = [move[O] + e[:, 0]]
        for s in range(1, steps):
            f.append(lse(f[-1][:, :, None] + move, 1) + e[:, s])
        g = [np.zeros((texts, 3)) + move[:, O]]
        for s in range(steps - 1, 0, -1):
            g.append(lse(move + (e[:, s] + g[-1])[:, None, :], 2))
        f, g = np.stack(f, 1), np.stack(g[::-1], 1)
        total = lse(f[:, -1] + move[:, O], 1)
        one = np.exp(f + g - total[:, None, None])
        pair = np.exp(f[:, :-1, :, None] + move + (e + g)[:, 1:, None, :] - total[:, None, None, None])
        grad_move = np.einsum("ij,ik->jk", tag[y[:, :-1].ravel()], tag[y[:, 1:].ravel()]) - pair.sum((0, 1))
        grad_move[O] += (tag[y[:, 0]] - one[:, 0]).sum(0)
        grad_move[:, O] += (tag[y[:, -1]] - one[:, -1]).sum(0)
        d = tag[gold] - one[on]  # row by row, as tokens are
        grads = []
        for w, x in zip(weights, features):
            grad = np.zeros_like(w)
            np.add.at(grad, x, d)
            grads.append(grad)
        grads.append(grad_move)
        for i, grad in enumerate(grads):
            grad = grad - decay * weights[i]
            squares[i] += grad * grad
            weights[i] = weights[i] + rate * grad / np.sqrt(squares[i])
    ids = np.arange(SHAPES)
    shape = weights[0] + weights[1][ids // 32] + weights[2][ids // 4 % 8] + weights[3][ids % 4]
    field = Field(shape, dict(zip(gaps, weights[5:-1])), weights[4], weights[-1], known)
    _TRAINED[key] = field
    return field


def _apart(found: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The found ranges that no span overlaps: each looks up the furthest end of the spans that start before its own end."""
    if not found or not spans:
        return found
    ordered = np.array(sorted(s[:2] for s in spans), np.int64)
    reach = np.concatenate([[-1], np.maximum.accumulate(ordered[:, 1])])
    ranges = np.array(found, np.int64)
    free = reach[np.searchsorted(ordered[:, 0], ranges[:, 1], "left")] <= ranges[:, 0]
    return [f for f, ok in zip(found, free.tolist(), strict=True) if ok]


def scan(docs: DataFrame, *, field: Field | None = None, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, n_field and the found spans (kind, from, to; code points) per row.

    n_field counts all that the field tags; n_crf those of it that no fixed pattern touches, which are the spans it adds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(**options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            field_spans: list[int] = []
            found = []
            for r0, r1, data, offsets in K.blocks(K.columns(batch, "text")):
                hs, he = K.runs(_HEX[data], offsets)
                long_ = he - hs >= LEAST["hex"]
                hs, he = hs[long_], he[long_]
                hex_row = np.searchsorted(offsets, hs, "right") - 1
                runs: dict[int, list] = {}
                for r, a, b in zip(hex_row.tolist(), hs.tolist(), he.tolist(), strict=True):
                    runs.setdefault(r, []).append((a - int(offsets[r]), b - int(offsets[r])))
                more: dict[int, list] = {}
                count = np.zeros(r1 - r0, np.int64)
                for r, a, b in shared.value.spans(Tokens(data, offsets)):
                    more.setdefault(r, []).append((a - int(offsets[r]), b - int(offsets[r])))
                    count[r] += 1
                field_spans += count.tolist()
                raw = data.tobytes()
                for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    body = raw[a:b]
                    spans = base_spans(body, runs.get(r, []))
                    new = [(x, y, 3) for x, y in _apart(more.get(r, []), spans)]
                    spans = sorted(spans + new, key=lambda s: (s[0], s[2]))
                    if spans and not body.isascii():
                        point = np.zeros(len(body) + 1, np.int64)
                        np.cumsum((data[a:b] & 0xC0) != 0x80, out=point[1:])
                        spans = [(int(point[x]), int(point[y]), k) for x, y, k in spans]
                    for k in range(len(KINDS)):
                        counts[k].append(sum(s[2] == k for s in spans))
                    found.append([{"kind": KINDS[k], "from": x, "to": y} for x, y, k in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([K.columns(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(field_spans, pa.int64()), pa.array(found, kind)], names=["doc_id", *(f"n_{k}" for k in KINDS), "n_field", "found"])

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_crf long, n_field long, found array<struct<kind: string, from: long, to: long>>")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf and n_field per document."""
    from pyspark.sql import functions as F

    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return scan(docs, **options).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), "n_crf", "n_field")

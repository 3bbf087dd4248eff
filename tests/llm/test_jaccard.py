"""Operator 7 against brute force."""

import random
import re

import numpy as np
import pytest

from noticeflow.llm import components, jaccard, queries
from noticeflow.llm import kernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where, seen = {}, set()
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for members in where.values():
        for a, i in enumerate(members):
            for j in members[a + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)], key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def planted(seed, n=120):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(4000))
    common = " ".join(word() for _ in range(40))
    base = [word() for _ in range(150)]
    docs = []
    for i in range(n):
        kind = r.randrange(5)
        if kind == 0:
            t = list(base)
            for _ in range(r.randrange(1, 7)):
                t[r.randrange(len(t))] = word()
            docs.append((i, " ".join(t)))
        elif kind == 1 and docs:
            t = (docs[r.randrange(len(docs))][1] or "").split(" ")
            cut = r.randrange(len(t) + 1)
            docs.append((i, "\n".join(t[:cut] + [word() for _ in range(r.randrange(12))] + t[cut:]).upper()))
        elif kind == 2:
            docs.append((i, common + " " + " ".join(word() for _ in range(r.randrange(60)))))
        elif kind == 3:
            docs.append((i, " ".join(r.choice("ab") for _ in range(r.randrange(14)))))
        else:
            docs.append((i, " ".join(word() for _ in range(r.randrange(300)))))
    return docs


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"star": 3, "dense": 8, "chunk": 3, "sample_one_in": 1, "frequent": 10})])
def test_components(spark, seed, options):
    docs = planted(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One\ttwo"), (1005, "two one"), (None, "one two"), (None, "lonely row without an id here"), (1006, "x"), (1006, "one two"), (1007, "é" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as s1", "2 as label").repartition(3)
    want = brute(docs)
    assert found(jaccard.report(df, **options)) == want
    kept = jaccard.keep_one(df.where("doc_id < 1000"), **options)
    assert kept.columns == df.columns
    component = {d: c for d, _, c in brute([x for x in docs if x[0] is not None and x[0] < 1000])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in component.items() if d == c)


def test_empty(spark):
    assert jaccard.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    docs = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(d != c for d, _, c in want) > 50
    assert found(queries.op7_jaccard_join(spark, "/root/testdata/sf0.01")) == want


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 1 << 40, rng.integers(1, 700)).tolist()) for _ in range(60)]
    sets += [set(sorted(s)[: max(1, len(s) * int(rng.integers(60, 100)) // 100)]) for s in sets]
    n, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    raw = []
    for s, width in zip(sets, jaccard.bitmap_bits(n).tolist()):
        bits = np.zeros(width, np.uint8)
        bits[[x % width for x in s]] = 1
        raw.append(np.packbits(bits, bitorder="little").tobytes())
    who = np.arange(len(sets))[::-1].copy()
    i, j = jaccard.SignatureTree(jaccard.Bitmaps(raw), who, n, label).pairs(75)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    need = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(need) > 20 and need <= got and len(got) < 1.5 * len(need) + 10


def test_connected(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (70, 100), (7, 7)] + [(200, x) for x in range(201, 240)]
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 100: 50, 50: 50, 70: 50, 200: 200, **{x: 200 for x in range(201, 240)}}


@pytest.mark.parametrize("options", [{}, {"star": 2, "dense": 8, "chunk": 4}, {"star": 1000}])
def test_links(spark, options):
    """Every link counts, also inside a class; however large the group."""
    r = random.Random(5)
    word = lambda: "v" + str(r.randrange(10**6))
    base = [word() for _ in range(200)]
    docs = [(i, " ".join([*base, *(word() for _ in range(3))])) for i in range(60)]  # all 0.97 alike
    docs += [(100 + i, " ".join(base[: 150 + i] + [word() for _ in range(5)])) for i in range(40)]  # some alike
    docs += [(200, docs[0][1]), (201, ""), (202, None), *((300 + i, " ".join(word() for _ in range(30 + i))) for i in range(5))]
    sets = {d: frozenset(shingles(t)) for d, t in docs}
    other = lambda x: {y for y in sets.values() if y and x and y != x and 100 * len(x & y) >= 75 * len(x | y)}
    got = dict(jaccard.report(spark.createDataFrame(docs, "doc_id long, text string"), **options).select("doc_id", "links").collect())
    assert got == {d: len(other(x)) for d, x in sets.items()} and got[1] >= 59


def forged_words(prefix: str, second: str) -> str:
    """Two other words whose polynomial over unkeyed hashes is that of these two: made by inverting the finaliser."""
    mul = K.U64(0x9FB21C651E98DF25)

    def unmix(x):
        def unshift(y, by):
            out = y.copy()
            for _ in range(64 // by):
                out = y ^ (out >> K.U64(by))
            return out

        x = unshift(x, 31) * K.U64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = unshift(x, 27) * K.U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return unshift(x, 30)

    def key(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return K.span_hashes(data, np.array([0]), np.array([len(data)]))[0]

    # first * M + second == first' * M + second': choose first' and solve for second'
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    n = np.arange(2_500_000)
    made = np.stack([letters[n // 26**i % 26] for i in range(6)], axis=1)
    first = K.span_hashes(made.ravel(), n * 6, n * 6 + 6)
    needed = unmix(key(second) + (key(prefix) - first) * mul)
    raw = needed.astype("<u8").view(np.uint8).reshape(-1, 8)
    plain = K.NOT_SPACE & (np.arange(256) > 0) & (np.arange(256) < 0x7F) & (K.LOWER == np.arange(256))
    fits = (raw[:, 7] == 7) & plain[raw[:, :7]].all(1)
    i = int(np.flatnonzero(fits)[0])
    return made[i].tobytes().decode() + " " + raw[i, :7].tobytes().decode()


def test_forged_shingles_link_nothing(spark):
    """Five words whose unkeyed shingle hash is another five words': the run's secret key tells them apart."""
    with np.errstate(over="ignore"):
        forged = forged_words("alpha", "bravo") + " cargo delta echoes"
    honest = "alpha bravo cargo delta echoes"
    hashes = []
    for text in (honest, forged):
        data = np.frombuffer(text.encode(), np.uint8)
        W = K.Words(data, np.array([0, len(data)]), K.NOT_SPACE)
        hashes.append(K.shingles(W.hash, 5)[0])
    assert hashes[0] == hashes[1] and forged != honest
    docs = spark.createDataFrame([(1, honest), (2, forged), (3, honest)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.report(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {1, 2}

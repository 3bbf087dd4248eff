"""Operators 1, 6 and 8 against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from noticeflow.llm import decontam, packing, queries, tokencount

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_contamination(docs, items, span=10):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows[tuple(w[s : s + n])].add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_decontamination_cases(spark):
    base = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(base[:12])), (2, " ".join(base[5:20]).upper()), (3, "short  item, HERE"), (4, ""), (5, None), (6, "alone"), (7, "a b " * 12), (None, " ".join(base[25:36])), (1, " ".join(base[:12]))]
    docs = [(1, " ".join(base)), (2, None), (3, ""), (4, "?? !!"), (5, "x " + "; ".join(base[2:13]) + " y"), (6, " ".join(base[:9])), (7, "short item here alone"), (8, "b a " * 30), (8, "b a " * 30), (None, "Über short item here"), (9, "z " * 3000 + " ".join(base[4:16]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "2 as spans")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    assert rows(decontam.report(d, b)) == want
    assert rows(decontam.report(d, b, block_words=8)) == want
    assert decontam.report(d.limit(0), b).count() == 0
    assert rows(decontam.report(d, b.limit(0))) == brute_contamination(docs, [])
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    assert rows(kept.select("doc_id")) == sorted([(r[0],) for r in want if not r[5]], key=str)


def test_decontamination_table(spark):
    d, b = (queries.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    docs, items = [tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()]
    want = brute_contamination(docs, items)
    assert sum(r[5] for r in want) >= 3
    assert rows(queries.op1_decontamination(spark, "/root/testdata/sf0.001")) == want


TRICKY = [
    None, "", " ", "\n\n", "don't  I'll 's 'S we've''re", "a<|endoftext|>b <|ENDOFTEXT|>. <|endoftext|>", "<|startoftext|>", "naïve café déjà-vu ×÷ç.É.", "é café.  x y　z\u0085", "x.y,z (a) b;c:d", "\t tab\r\nline  \n", "123.456 7,8 ½ Ⅷ", "你好 世界。hello", "#$% &*! ''s", "A" * 5000, "σς ΟΔΥΣΣΕΥΣ. İ I", "\x00 \x1c\x1d a", " leading", "trailing ", "🙂🙃 👍🏽.", "it's.It'S 'tis",
]


@pytest.mark.parametrize("name,fold", [(queries.WORD_BPE, True), (queries.BYTE_BPE, False)])
def test_pieces_equal_the_library(name, fold):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from noticeflow.llm import kernel as K
    from noticeflow.llm.pieces import PieceEncoder

    import duckdb

    texts = TRICKY + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    whole = Tokenizer.from_file(queries.tokenizer_file(name))
    own = PieceEncoder(queries.tokenizer_file(name), fold, most=500)  # so small that it starts anew again and again
    got = []
    for _, _, data, offsets in K.blocks(pa.array(texts, pa.string()), 3000):
        flat, at = own.ids(data, offsets)
        got += [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert own.counts(data, offsets).tolist() == np.diff(at).tolist()
    assert got == [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_frequent_pieces_are_encoded_once():
    import pyarrow as pa

    from noticeflow.llm import kernel as K
    from noticeflow.llm.pieces import PieceEncoder

    own, sent = PieceEncoder(queries.tokenizer_file(queries.WORD_BPE), True, most=1000), defaultdict(int)

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **how):
            for t in texts:
                sent[t] += 1
            return self.library.encode_batch_fast(texts, **how)

    library, own.tokenizer = own.tokenizer, Counted(own.tokenizer)
    often = ["often", "comes", "again", "internationalisation"]
    texts = [" ".join([*often, *(f"rare{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n, n + 40)), *often]) for n in range(0, 8000, 40)]
    got = []
    for _, _, data, offsets in K.blocks(pa.array(texts), 2000):
        flat, at = own.ids(data, offsets)
        got += [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.numbers.known < 2000 < len(sent)  # the cache went over its bound several times
    assert [sent[" " + w] for w in often] == [1, 1, 1, 1] and max(sent.values()) == 1


def test_span_numbers_equal_a_dictionary():
    from noticeflow.llm import kernel as K

    rng = np.random.default_rng(3)
    numbers, seen = K.SpanNumbers(), {}
    for step in range(12):
        cuts = np.unique(rng.integers(1, 30_000, 6000))
        data = rng.choice(np.array([0, 1, 97, 255], np.uint8), 30_000, p=[0.1, 0.05, 0.8, 0.05])
        starts, ends = np.append(0, cuts), np.append(cuts, len(data))
        known = numbers.known
        got, new = numbers.of(data, starts, ends)
        spans = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert got[new].tolist() == list(range(known, numbers.known))
        for i in new:
            assert spans[i] not in seen
            seen[spans[i]] = got[i]
        assert got.tolist() == [seen[x] for x in spans] and len(seen) == numbers.known
        if step % 3 == 2:
            keep = rng.permutation(numbers.known)[: numbers.known // 3]
            numbers.keep(keep)
            now = {int(old): i for i, old in enumerate(keep)}
            seen = {x: now[n] for x, n in seen.items() if n in now}
    assert max(map(len, seen)) > K.MIDDLE


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file(queries.WORD_BPE))
    texts = TRICKY + ["word " * 9000, "word " * 2047, "word " * 2048, "x"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "y z"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length").repartition(3)
    out = packing.pack(df, queries.tokenizer_file(queries.WORD_BPE), fold=True, block_pieces=9).collect()
    want = defaultdict(list)
    for d, t in docs:
        want[d].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    seen = defaultdict(list)
    for r in out:
        seen[r.doc_id].append(r)
    assert set(seen) == set(want)
    for d, lists in want.items():
        for ids in lists:
            pieces = sorted((r for r in seen[d] if r.doc_tokens == len(ids)), key=lambda r: r.start)
            at = 0
            for r in {(r.start): r for r in pieces}.values():
                assert r.start == at and 0 < r.length <= 2048
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
            assert at == len(ids)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(df.limit(0), queries.tokenizer_file(queries.WORD_BPE)).count() == 0


def test_best_fit_is_tight_and_equals_a_list_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500)
    w, offset, n = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fit = [(r, -j) for j, r in enumerate(rooms) if r >= lengths[i]]
        if fit:
            rooms[-min(fit)[1]] -= lengths[i]
        else:
            rooms.append(64 - lengths[i])
    assert n == len(rooms) and sorted(64 - np.bincount(w, lengths)) == sorted(rooms)


def test_token_counts(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file(queries.BYTE_BPE))
    docs = [(i, t) for i, t in enumerate(TRICKY)] + [(None, "y z"), (3, "again"), (3, "again"), (99, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as digest").repartition(3)
    want = sorted([(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 1024) for d, t in docs], key=str)
    cache, path = str(tmp_path / "cache"), queries.tokenizer_file(queries.BYTE_BPE)
    counts = lambda df, **options: (lambda out: (sorted((tuple(r)[:4] for r in out), key=str), sum(r.cached for r in out)))(tokencount.token_counts(df, path, **options).collect())
    some = [r for r in want if r[0] is not None and r[0] < 5]
    assert counts(df.where("doc_id < 5"), cache=cache)[0] == some
    first = spark.read.parquet(cache).count()
    monkeypatch.setattr(tokencount, "FILTER_DIGESTS", 3)  # the way of many misses
    assert counts(df, cache=cache) == (want, len([d for d, t in docs if (t or "") in {u or "" for e, u in docs if e is not None and e < 5}]))
    stored = spark.read.parquet(cache)
    assert first < stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in docs})
    # a warm cache: every row is a hit, nothing is encoded and nothing appended
    monkeypatch.setattr(tokencount, "encoder", None)
    assert counts(df, cache=cache) == (want, len(want)) and stored.count() == spark.read.parquet(cache).count()
    monkeypatch.undo()
    assert counts(df)[0] == counts(df)[0] == want  # the cache in the shared folder
    assert tokencount.token_counts(df.limit(0), path, cache=str(tmp_path / "new")).count() == 0


def test_keyed_join_splits_hot_keys(spark):
    from pyspark.sql import functions as F

    from noticeflow.llm.shared import keyed_join

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(300)], "id long, k string")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("m")).where("k <> 'k3'")
    want = sorted(map(tuple, rows.join(side.drop("c"), "k").collect()))
    assert sorted(map(tuple, keyed_join(rows, side, ["k"], "c", parts=5, least=10).collect())) == want
    assert sorted(map(tuple, keyed_join(rows, side, ["k"], "c").collect())) == want


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_crafted_words(spark):
    """Words that a polynomial modulo 2**64 can't tell apart, whatever its base."""
    from tokenizers import Tokenizer

    from noticeflow.llm import jaccard

    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    ten = " ".join(f"w{i}" for i in range(9))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{ten} {one}"), (4, f"{ten} {two}")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, one), (2, f"{ten} {one}")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.report(docs, items).collect()} == {1: 1, 2: 0, 3: 10, 4: 0}
    assert {r.doc_id: r.component_id for r in jaccard.report(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    library = Tokenizer.from_file(queries.tokenizer_file(queries.WORD_BPE))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in docs.collect()}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, queries.tokenizer_file(queries.WORD_BPE), fold=True).collect()}
    assert got == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids.items()}
    library = Tokenizer.from_file(queries.tokenizer_file(queries.BYTE_BPE))
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, queries.tokenizer_file(queries.BYTE_BPE)).collect()} == {d: len(library.encode(t, add_special_tokens=False)) for d, t in docs.collect()}


def test_clashing_columns_keep_their_values(spark):
    from noticeflow.llm import jaccard, linededup, repeats, rules, secrets

    names = ["doc_id", "text", "TEXT", "items", "spans", "n_words", "N_HIT", "N_LINES", "n_lines", "n_dropped", "gone", "source", "Source", "rule", "kept", "_k0"]
    rows = [[i, " ".join(f"x{i}y{j}" for j in range(40)) + ".", *(f"{n}{i}" for n in names[2:])] for i in range(4)]
    df = spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"c{i} string" for i in range(len(names)))).toDF(*names)
    want = sorted(tuple(map(str, r)) for r in rows)
    items, labels = spark.createDataFrame([("1", "none of these")], "item_id string, text string"), spark.createDataFrame([], "doc_id string, quality long")
    for out in (decontam.clean(df, items), linededup.cleaned(df), rules.accepted(df, labels), jaccard.keep_one(df)):
        assert out.columns == names and sorted(map(tuple, out.collect())) == want
    numbered = df.toDF("no", *names[1:]).selectExpr("cast(no as long) as doc_id", *(f"'{n}' as `{n}`" for n in names[1:]))
    for out in (packing.pack(numbered, queries.tokenizer_file(queries.WORD_BPE)), secrets.report(numbered), repeats.report(numbered), decontam.report(numbered, items)):
        assert out.count() == 4

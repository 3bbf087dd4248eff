"""The pipeline: each stage on what its predecessor kept, against the brute-force versions of its operator."""

import sys
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
from test_benchmark_packing_counts import brute_contamination  # noqa: E402
from test_jaccard import brute as brute_components  # noqa: E402
from test_rules_lines import brute_lines, brute_statistics  # noqa: E402

from noticeflow.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, out = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs.collect())
        assert i == 4 or docs.columns == columns
    first = queries.table(spark, SF, "documents").collect()
    kept = {r.doc_id for r in out[0]}
    quality = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    low = []
    for r in first:
        words, _, _, _, repeated = brute_statistics(r.text)
        if words < 20 or 100 * repeated > 30 * words:
            assert r.doc_id not in kept
        elif quality.get(r.doc_id) == 1:
            assert r.doc_id in kept
        elif quality.get(r.doc_id) == 0:
            low.append(r.doc_id in kept)
    assert len(low) > 10 and sum(low) <= 0.1 * len(low)  # the list is learned: nearly all junk goes, nothing good does
    by_id = {r.doc_id: r for r in first}
    assert all(tuple(r) == tuple(by_id[r.doc_id]) for r in out[0])
    lines = brute_lines([(r.doc_id, r.source, r.text) for r in out[0]])
    assert sorted((r.doc_id, r.source, r.text, r.n_chars) for r in out[1]) == sorted((d, s, t, len(t)) for d, s, t, _, _ in lines) and any(x[4] for x in lines)
    groups = brute_components([(r.doc_id, r.text) for r in out[1]])
    assert sorted(r.doc_id for r in out[2]) == sorted(d for d, _, c in groups if d == c) and len(out[2]) < len(out[1])
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in out[2]], items) if r[5]}
    assert dirty and sorted(r.doc_id for r in out[3]) == sorted(r.doc_id for r in out[2] if r.doc_id not in dirty)
    total = {}
    for r in out[4]:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {r.doc_id: r.doc_tokens for r in out[4]} and set(total) == {r.doc_id for r in out[3]}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50 and corpus_pipeline.ORACLE_SQL is None


def test_unusual_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "word " * 40, None, None, 200, None), (3, " ".join(f"w{i}" for i in range(5000)), "en", "s", 1, "y"), (4, " ".join(f"w{i}" for i in range(5000)), "en", "s", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            assert got.columns == df.columns
            docs = spark.createDataFrame(got.collect(), df.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert packed == []


def test_copies_reach_packing(spark, tmp_path):
    """A third of a site is one text and its near copies, five pages of another one: one full document of each is packed."""
    word = lambda *x: "w" + "x".join(map(str, x))
    page = lambda *x, n=12: [" ".join(word(*x, i, j) for j in range(10)) for i in range(n)]
    menu = "home about contact imprint and the terms of use"
    rows = []
    for i in range(120):
        kind = "own" if i % 3 else "copy"
        lines = page("own", i) if i % 3 else page("copy") if i % 2 else [*page("copy"), " ".join(word("end", i, j) for j in range(4))]
        rows.append((i, "\n".join([menu, *lines]), "big", kind))
    rows += [(200 + i, "\n".join(page("five") if i < 5 else page("small", i)), "small", "five" if i < 5 else "own") for i in range(12)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line dedup", "near duplicates", "decontamination"):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name[:4]))
        docs = spark.read.parquet(str(tmp_path / name[:4]))
    kept, by_id = {r.doc_id: r.text for r in docs.collect()}, {d: (t, s, kind) for d, t, s, kind in rows}
    assert sorted(d for d in kept if by_id[d][2] != "own") == [0, 200] and len(kept) == 80 + 7 + 2
    assert all(kept[d] == by_id[d][0].removeprefix(menu + "\n") for d in kept)
    packed = {r.doc_id: r.doc_tokens for r in stages["packing"](spark, docs, SF).collect()}
    assert set(packed) == set(kept) and packed[0] > 100 and packed[200] > 100

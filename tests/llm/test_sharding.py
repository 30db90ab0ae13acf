import zlib
from collections import Counter

import pytest

from tessel.llm import sharding as s


def check(spark, docs, near=1.02):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = s.op9(df).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    sizes = [sum(r["size"] for r in by.get(k, ())) for k in range(40)]
    if near:
        assert max(sizes) <= near * sum(sizes) / 40
    return rows


def test_sf(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = check(spark, docs, 1.05)
    by_text, size = {}, Counter()
    text = dict(docs)
    for r in rows:
        by_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        size[text[r["doc_id"]]] += r["size"]
    assert all(len(x) == 1 for t, x in by_text.items() if size[t] < sum(size.values()) / 40 * 0.3)


@pytest.mark.parametrize("big", [0, 40_000])
def test_bytes_tokens_and_rows_are_balanced_in_parts(spark, monkeypatch, big):
    monkeypatch.setattr(s, "PART_GROUPS", 900)
    docs = [(i, ("word " if i % 2 else "longerword") * (i % 97 + 1)) for i in range(5000)] + [(9000, "big " * big)]
    rows = s.shard(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    assert len(rows) == len(docs)
    for of, near in ((lambda r: r["size"], 1.12 if big else 1.03), *[(lambda r: r["n_tokens"], 1.1), (lambda r: 1, 1.1)][: 0 if big else 2]):
        by = Counter()
        for r in rows:
            by[r["shard"]] += of(r)
        assert max(by.values()) <= near * sum(by.values()) / 10, by


def test_hot_text_is_dealt_out(spark):
    docs = [(i, "the same text " * 5 if i % 3 == 0 else f"text {i} " * (i % 7 + 5)) for i in range(6000)]
    check(spark, docs)


@pytest.mark.parametrize("run", [100_000, 50])
def test_one_text_alone_is_cut_evenly(spark, monkeypatch, run):
    """5,000 equal texts, with ids or without: no shard is over the mean by more than a piece's rounding."""
    monkeypatch.setattr(s, "RUN_ROWS", run)
    for docs in ([(i, "one text") for i in range(5000)], [(None, "one text")] * 5000):
        check(spark, docs, 1.017)


def test_groups_are_one_row_and_stay_together(spark):
    """Groups just below the size that comes first are placed whole, however many rows they have."""
    docs = [(i, f"group {i % 3000}") for i in range(12_000)]
    rows = check(spark, docs, 1.03)
    shards = {}
    for r in rows:
        shards.setdefault(r["doc_id"] % 3000, set()).add(r["shard"])
    assert all(len(x) == 1 for x in shards.values())


def test_small_cases(spark):
    check(spark, [], None)
    check(spark, [(None, "a b"), (None, "a b"), (None, None), (7, "c")], None)
    df = spark.createDataFrame([(1, "a b", 9, "x", 5)] * 4, "doc_id long, text string, g int, shard string, tokens int")
    rows = s.shard(df, 2, tokens_col="tokens").collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows} == {5}
    check(spark, [(1, None), (1, None), (1, "a"), (2, ""), (3, "é" * 1000), (3, "é" * 1000)], None)

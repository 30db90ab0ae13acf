import hashlib
from collections import Counter

import pytest

from tessel.llm import fingerprints as f


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = f.op3(df).collect()
    order = sorted(((i, t or "") for i, t in docs), key=lambda x: (-x[0] if x[0] is not None else float("inf"), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        e = f.edited(t, order[(k + 1) % len(order)][1])
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    for r in rows:
        assert r["near_edited"] == f.likeness(r["fingerprint"], r["edited_fingerprint"]) and 0 <= r["near_next"] <= 1
    prints = {}
    for r in rows:
        for i, t in docs:
            if i == r["doc_id"] and [x for x, _ in docs].count(i) == 1:
                assert prints.setdefault(t or "", r["fingerprint"]) == r["fingerprint"]
    return {r["doc_id"]: r for r in rows}


def test_small_cases(spark, monkeypatch):
    monkeypatch.setattr(f, "PARTITION_BYTES", 3000)
    docs = [(1, None), (2, ""), (3, "!!! ???"), (4, "é😀 two"), (5, "one two three four five six " * 9), (6, "one two three four five six " * 9), (7, "x " * 30_000), (9, "last"), (9, "again"), (11, "one two three four five")]
    got = check(spark, docs)
    assert got[6]["near_next"] == 1 and got[2]["near_next"] == 1
    check(spark, [(5, "alone here")])
    check(spark, [(1, "again and again " * 4)] * 3 + [(2, "b " * 9)] * 2)
    check(spark, [])


def test_whole_table(spark, sf, monkeypatch):
    monkeypatch.setattr(f, "PARTITION_BYTES", 300_000)
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("kept", [60, 80, 95])
def test_likeness_is_weighted_jaccard(spark, kept):
    a = [f"w{i % 70}" for i in range(400)] + [f"a{i}" for i in range(400)]
    b = a[: 8 * kept] + [f"b{i}" for i in range(800 - 8 * kept)]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    x, y = grams(a), grams(b)
    exact = sum((x & y).values()) / sum((x | y).values())
    df = spark.createDataFrame([(" ".join(a),), (" ".join(b),)], "text string")
    p, q = [r["fingerprint"] for r in f.fingerprints(df, samples=2048).collect()]
    assert abs(f.likeness(p, q) - exact) < 0.05


def test_columns_of_a_results_name_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, fingerprint int, part string")
    row = f.fingerprints(df).first()
    assert sorted(row.asDict()) == ["doc_id", "fingerprint", "part", "text"] and isinstance(row["fingerprint"], str)
    assert f.with_neighbours(df).count() == 1

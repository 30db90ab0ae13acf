import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessel.llm import lexical, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, queries, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        hits = []
        for (i, bag), size in zip(bags, sizes, strict=True):
            s = 0
            for t in set(terms(text)) & set(bag):
                m = 50 + 50 * size * n // total
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("segment", [1 << 20, 60])
def test_odd_texts(spark, monkeypatch, segment):
    """Nulls, repeated rows, ties, words beyond ASCII, queries without terms, extra columns; few and many segments."""
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", segment)
    pick = random.Random(4)
    vocabulary = ["the", "of", "Straße", "ÉCOLE", "a1", "x", *[f"w{i}" for i in range(30)]]
    text = lambda n: pick.choice([" ", "-", "_\n"]).join(pick.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(pick.choice([None, *range(400)]), pick.choice([None, "", "?!", *[text(pick.randint(1, 60)) for _ in range(8)]])) for _ in range(400)]
    queries = [(i, text(pick.randint(1, 12))) for i in range(20)] + [(20, None), (21, "..."), (22, "absent"), (23, "THE the of")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in queries], "item_id long, text string, rank int")
    assert got(lexical.op13(d, q)) == brute(docs, queries)
    assert got(lexical.ranked(d, q, k=3)) == brute(docs, queries, 3)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_OF_QUERIES", 1)
    docs = [(i, f"a b{i % 3} c{i % 5}") for i in range(30)]
    queries = [(1, "a b1"), (2, "c2 c3"), (2, "b0")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id int, text string")
    assert got(lexical.op13(d, q)) == brute(docs, queries)


def test_no_rows(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.op13(d, q).collect() == [] and lexical.op13(d, some).collect() == []
    assert lexical.op13(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), some).collect() == []


def test_pair_bounds_are_tighter_and_hold():
    """The bound of a pair is that of its documents, not the sum of the maxima; no document is above it."""
    row = {"docs": [0, 1, 2], "lengths": np.array([10, 10, 10], "<i4").tobytes(), "terms": np.array([0, 1], "<i4").tobytes(), "starts": np.array([0, 2, 4], "<i4").tobytes(), "at": np.array([0, 1, 1, 2], "<i4").tobytes(), "counts": np.array([9, 1, 1, 9], "<i4").tobytes()}
    segment = lexical.Segment(row, np.array([1000, 1000]), np.array([[0, 1]]), 3, 30)
    joint = segment.pairs[0, 1]
    scores = np.zeros(3, np.int64)
    for t in (0, 1):
        a, s = segment.list_of(t)
        scores[a] += s
    assert joint == scores.max() < segment.most[0] + segment.most[1]
    assert segment.search(np.array([0, 1]), joint + 1, 1)[0].size == 0


def test_colliding_hashes(monkeypatch):
    monkeypatch.setattr(lexical, "run_hashes", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(words.Texts, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    v = lexical.Vocabulary([b"abc", b"abd", b"x"])
    data = np.frombuffer(b"abd x abc abe", np.uint8)
    at, found = v.find(words.Texts(data, np.array([0, len(data)])))
    assert sorted(zip(at.tolist(), [v.terms[t] for t in found.tolist()], strict=True)) == [(0, b"abd"), (1, b"x"), (2, b"abc")]


def test_whole_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    assert got(lexical.op13(docs, items)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])

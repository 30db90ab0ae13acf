import math
import random
import re
from collections import Counter

import pytest

from tessel.llm import near_duplicates as nd


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, threshold=nd.SIMILARITY):
    """(classes, links): by the weighted Jaccard similarity of all pairs with a term in common, from words and exact frequencies alone."""
    terms = [grams(t) for _, t in docs]
    df = Counter(g for t in terms for g in t)
    idf = {g: math.log(1 + len(docs) / n) / math.log(1 + len(docs)) for g, n in df.items()}
    weights = [{g: n * (0.9 + 0.1 * idf[g]) for g, n in t.items()} for t in terms]
    sums = [sum(w.values()) for w in weights]
    holders = {}
    for i, t in enumerate(terms):
        for g in t:
            holders.setdefault(g, []).append(i)
    parent, links = list(range(len(docs))), []

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    same = {}
    for i, (_, t) in enumerate(docs):
        parent[find(i)] = find(same.setdefault(t or "", i))
    for i in range(len(docs)):
        for j in {j for g in terms[i] for j in holders[g] if j > i}:
            low = sum(min(w, weights[j].get(g, 0)) for g, w in weights[i].items())
            s = low / (sums[i] + sums[j] - low)
            if s >= threshold:
                parent[find(i)] = find(j)
                links.append((docs[i][0], docs[j][0], s))
    ids = {}
    for i, (k, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(k)
    return {docs[i][0]: min(ids[find(i)]) for i in range(len(docs))}, links


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def got_of(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = nd.op2(df).collect()
    assert len(rows) == len(docs)
    return {r["doc_id"]: r["class_id"] for r in rows}


def test_families_passages_and_copies(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    docs = []
    for size, edits in ((40, 2), (5, 3), (25, 1)):
        docs += family(rng, text(300), size, edits)
    docs += [f"{text(90)} {passage} {text(50)}" for _ in range(120)] + [text(20)] * 30 + [text(3)] * 2 + [text(200) for _ in range(30)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want, _ = brute(docs)
    assert got_of(spark, docs) == want


def test_whole_table(spark, sf):
    """Recall over all pairs at the threshold or above; frequencies in eighths of a power of two move a similarity by less than 0.002."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, links = brute(docs)
    got = got_of(spark, docs)
    found = [got[a] == got[b] for a, b, _ in links]
    assert len(links) > 100 and sum(found) / len(found) > 0.999
    assert all(got[a] == got[b] for a, b, s in links if s > nd.SIMILARITY + 0.002)
    lower, _ = brute(docs, nd.SIMILARITY - 0.002)
    assert all(lower[k] == lower[got[k]] for k in got)


def test_words_of_one_polynomial_hash(spark):
    """Long words of two alternating halves are told apart."""
    bits = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    one, other = "".join(bits), "".join("ab"["ba".index(b)] for b in bits)
    docs = [(1, f"{one} x y z w"), (2, f"{other} x y z w"), (3, f"{one} x y z w"), (4, one), (5, other)]
    assert got_of(spark, docs) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_small_cases(spark):
    docs = [(3, None), (1, ""), (2, "!!"), (4, "!!"), (5, "One two"), (6, "one, two."), (7, "long text " * 60_000), (8, "long text " * 60_000 + "x")]
    assert got_of(spark, docs) == {3: 1, 1: 1, 2: 2, 4: 2, 5: 5, 6: 5, 7: 7, 8: 7}
    assert got_of(spark, []) == {}


def test_one_of_each_class_stays(spark):
    rows = [(2, "a b c d e f g", "x", 1.0), (1, "a b c d e f g", "y", None), (1, "a b c d e f g", "y", None), (5, "other words here now ok", None, 2.0), (5, "other words here now ok", None, 2.0), (None, "z", None, None), (5, "and a text of its own", "k", 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, class_id double")
    out = nd.deduplicated(df)
    assert out.schema == df.schema
    left = sorted((tuple(r) for r in out.collect()), key=str)
    assert left == sorted([rows[1], rows[3], rows[5], rows[6]], key=str)
    assert nd.deduplicated(df.where("false")).count() == 0


@pytest.mark.parametrize("part_edges", [nd.PART_EDGES, 7])
def test_components(spark, part_edges):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, i) for i in range(201, 260)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in nd.components(df, part_edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{i: 200 for i in range(200, 260)}}


@pytest.mark.parametrize("n", [2, 1000])
def test_frequent_copies_stay_similar(n):
    """A plain similarity of 0.85 stays above the threshold whatever the size of the group."""
    import numpy as np

    shared, own = np.exp(nd.log_weights(nd.code_of(np.array([n, 1])), np.array([1, 1]), 2000))
    assert 0.85 * shared / (0.85 * shared + 0.15 * own) >= nd.SIMILARITY


def test_pairs_of_a_large_bucket_are_all_found(spark):
    """Planted pairs of about 0.85 among thousands that mostly consist of one common passage."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    passage = text(200)
    # two texts with only the passage in common have 0.78; planted ones share a part of their own
    docs = [f"{passage} {text(25)}" for _ in range(2000)]
    for _ in range(60):
        own = text(8)
        docs += [f"{passage} {own} {text(17)}", f"{passage} {own} {text(17)}"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    grams_of = {i: grams(t) for i, t in docs}
    own = {}
    for i, t in docs:
        own.setdefault(" ".join(t.split()[200:208]), []).append(i)
    pairs = [x for x in own.values() if len(x) == 2]
    assert len(pairs) == 60 and all(0.84 < sum((grams_of[a] & grams_of[b]).values()) / sum((grams_of[a] | grams_of[b]).values()) < 0.86 for a, b in pairs)
    got = got_of(spark, docs)
    assert {i: min(next((p for p in pairs if i in p), [i])) for i, _ in docs} == got

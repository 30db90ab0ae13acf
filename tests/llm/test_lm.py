import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessel.llm import lm
from tessel.llm.words import blocks


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    flat = lm.start().astype(np.float64)
    around, target = rng.integers(0, lm.SIZE + 1, (5, 4)), rng.integers(0, lm.SIZE, 5)
    g = np.zeros(lm.PARAMETERS)
    lm.gradient(lm.views(flat), around, target, g)
    loss = lambda: -lm.forward(lm.views(flat), around, target)[0].mean()
    for i in [*rng.choice(np.flatnonzero(g), 40), *rng.integers(0, lm.PARAMETERS, 5)]:
        flat[i] += 1e-5
        up = loss()
        flat[i] -= 2e-5
        down = loss()
        flat[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_probabilities_sum_to_one():
    p = lm.views(lm.start())
    around = np.full((lm.SIZE, 4), 3)
    assert abs(np.exp(lm.forward(p, around, np.arange(lm.SIZE))[0]).sum() - 1) < 1e-3


def test_score_is_the_sum_over_words():
    texts = ["a b c a", "", "b", None, "c " * 3000]
    v = lm.Vocabulary(np.empty(0, np.uint64))
    ((_, _, block),) = blocks(pa.array(texts))
    ids, got = v.ids(block), lm.log_probabilities(lm.start(), v.ids(block), block.word_offsets)
    for k, (a, b) in enumerate(zip(block.word_offsets[:-1], block.word_offsets[1:], strict=True)):
        for i in range(a, min(b, a + 6)):
            around = [ids[i + d] if a <= i + d < b else lm.EDGE for d in lm.PLACES]
            one = lm.forward(lm.views(lm.start()), np.array([around]), ids[i : i + 1])[0][0]
            assert abs(one - got[i]) < 1e-4, (k, i)


def test_counts_cover_all(spark):
    df = spark.createDataFrame([("A b a",), ("a c",), (None,), ("b",)], "text string")
    v = lm.count_words(df)
    ((_, _, block),) = blocks(pa.array(["a b c d"]))
    ids = v.ids(block).tolist()
    assert ids[0] == 0 and ids[1] == 1 and ids[2] == 2 and ids[3] >= lm.FREQUENT


def test_held_out_text_beats_shuffled_words_and_the_untrained(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 0
    v = lm.count_words(docs.where(~held))
    flat = lm.train(docs.where(~held), v, rounds=lm.ROUNDS)
    rows = docs.where(held).collect()
    rng = random.Random(1)

    def shuffled(t):
        w = t.split()
        rng.shuffle(w)
        return " ".join(w)

    mean = lambda t, f: lm.score(spark.createDataFrame(t, "text string"), v, f).agg(F.sum("log_probability") / F.sum("n_words")).first()[0]
    whole = [(r["text"],) for r in rows]
    trained = mean(whole, flat)
    assert trained > mean(whole, lm.start()) + 1 and trained > mean([(shuffled(t),) for (t,) in whole], flat)


def test_small_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "word"), (5, "a b c d e"), (5, "a b c d e"), (6, "long " * 200_000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in lm.op10(df).collect())
    assert [g[:2] for g in got] == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 5), (5, 5), (6, 200_000)]
    assert got[0][2:] == (0.0, None) and got[4] == got[5] and got[5][2] < 0
    assert lm.op10(df.where("false")).count() == 0


def test_each_word_is_a_target_once_wherever_its_row_is(spark, monkeypatch):
    rows = [(f"w{i} a b w{i % 7} c",) for i in range(60)]
    df = spark.createDataFrame(rows, "text string")
    v = lm.count_words(df)
    flat = [lm.train(df.repartition(n), v) for n in (1, 3)]
    assert all(np.isfinite(f).all() for f in flat)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    other = lm.train(df.repartition(5), v)
    assert np.isfinite(other).all() and abs(other - flat[0]).max() < 1
    clash = spark.createDataFrame([("a b", 1, "x")], "text string, n_words int, log_probability string")
    assert lm.score(clash, v, other).first()["n_words"] == 2


def test_scores_are_of_words_and_counts_are_joined(spark):
    """P(word | window) is that of its id by its count among the words of that id, in plain Python."""
    texts = ["x y x y x y a a a b", "a b b c d d q", None, "", "x zz", "x zz"] + [f"w{i} w{i} u{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    for t in texts:
        for w in (t or "").split():
            seen[w] = seen.get(w, 0) + 1
    got = []
    for known in (0, 4, 1 << 16):
        counts = lm.word_counts(df)
        v = lm.vocabulary_of(counts, 2, known)
        assert len(v.known) <= known
        rows = lm.score(df, v, lm.start(), counts=counts).orderBy("doc_id").collect()
        got.append([r["log_probability"] for r in rows])
        assert rows[0].asDict().keys() == {"doc_id", "text", "n_words", "log_probability", "mean_log_probability"}
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])
    ((_, _, block),) = blocks(pa.array(texts))
    ids = v.ids(block)
    lp = lm.log_probabilities(lm.start(), ids, block.word_offsets)
    words = [block.word(i).decode() for i in range(len(ids))]
    of = dict(zip(words, ids.tolist(), strict=True))
    total = lambda k: sum(n for w, n in seen.items() if of[w] == k)
    share = [0 if k < lm.FREQUENT else np.log(seen[w] / (total(k) + 1)) for w, k in zip(words, ids.tolist(), strict=True)]
    for d, (a, b) in enumerate(zip(block.word_offsets[:-1], block.word_offsets[1:], strict=True)):
        assert abs(got[0][d] - sum(lp[a:b]) - sum(share[a:b])) < 1e-3, d
    assert len(set(ids.tolist()) & set(range(lm.FREQUENT))) == 2 and share.count(0) < len(share)


def test_unseen_words_share_one_count(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    counts = lm.word_counts(df)
    v = lm.vocabulary_of(counts)
    new = spark.createDataFrame([("new",), ("other",)], "text string")
    flat = lm.start()
    with_counts = [r[0] for r in lm.score(new, v, flat, counts=counts).select("log_probability").collect()]
    assert sorted(with_counts) == sorted(r[0] for r in lm.score(new, v, flat).select("log_probability").collect())

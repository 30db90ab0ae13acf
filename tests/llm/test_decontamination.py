import hashlib
import re

from tessel.llm import decontamination as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (x := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in d.op8(a, b).collect()), key=str) == brute(docs, items)


def test_small_cases(spark):
    run = " ".join(f"w{i}" for i in range(30))
    items = [(1, run), (2, "Éa b"), (3, None), (4, "!!"), (5, run.upper()), (5, run), (7, "solo"), (None, "x y z")]
    docs = [(1, run), (2, None), (3, ""), (4, "zz " + run + " zz"), (5, "éa b Éa, B"), (6, "solo " * 40), (7, " ".join(f"w{i}" for i in range(3, 12))), (8, " ".join(f"w{i}" for i in range(3, 13))), (8, "w1"), (9, "x-y_z"), (10, ("pad " * 70 + run + " ") * 40)]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c"), (2, None)], [])


def test_more_than_one_block_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_OF_ITEMS", 100)
    runs = [" ".join(f"v{j}x{i}" for i in range(14)) for j in range(5)]
    check(spark, [(i, " ".join(runs[: i + 1]) + " tail") for i in range(5)] + [(9, "none")], list(enumerate(runs)))


def test_whole_tables(spark, sf):
    read = lambda n, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(c, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    check(spark, docs, items)
    assert any(r[2] for r in brute(docs, items))


def test_clashing_columns(spark):
    a = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.contamination(a, b).select("doc_id", "n_words", "items").first() == (1, 2, ["1"])
    left = d.decontaminated(a.union(spark.createDataFrame([(2, "c", "y", 8)], a.schema)), b)
    assert left.schema == a.schema and left.collect() == [(2, "c", "y", 8)]

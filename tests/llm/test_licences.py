import re
from collections import Counter

from tessel.llm import licences as lic


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def paragraphs(text):
    """Lines joined up to one that has only blanks and control characters; bytes of other characters count as ink."""
    out = [""]
    for line in text.split("\n"):
        if all(ord(c) <= 32 for c in line):
            out.append("")
        else:
            out[-1] += line + "\n"
    return out


def brute(text):
    text = text or ""
    grams = lambda w: Counter(zip(w, w[1:], strict=False))
    units, out = set(), set()
    for cut in ("line", "blank", None):
        first = 0
        for unit in text.split("\n") if cut == "line" else paragraphs(text) if cut else [text]:
            w = words(unit)
            if len(w) > 1:
                units.add((first, tuple(w)))
            first += len(w)
    known = {name: grams(words(t)) for name, t in lic.TEMPLATES.items()}
    for first, w in units:
        a = grams(w)
        dice = {name: 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) for name, b in known.items()}
        best = max(dice.values())
        if best >= lic.THRESHOLD:
            out |= {(name, round(d, 9), first, len(w)) for name, d in dice.items() if d == best}
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lic.scan(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert any(r["doc_id"] == i and r["text"] == t for i, t in docs)
        got = [(m["licence"], round(m["dice"], 9), m["first_word"], m["n_words"]) for m in r["licences"]]
        assert len(got) == len(set(got)) and set(got) == brute(r["text"])
    return {r["doc_id"]: r["licences"] for r in rows}


def test_small_cases(spark):
    t = lic.TEMPLATES
    wrapped = t["MIT-text"].replace(", ", ",\n")
    docs = [(1, None), (2, ""), (3, "one"), (4, "x\nReleased under the MIT License.\ny"), (5, "Copyright\n\n" + wrapped + "\n\nmore text here"), (6, t["GPL-3.0-header"]), (6, t["GPL-3.0-header"]), (7, "the of " * 50_000 + "\n" + t["MIT"]), (8, "released under an MIT license"), (9, "\n\n\n"), (10, t["Apache-2.0"] + "\n" + t["Apache-2.0"])]
    got = check(spark, docs)
    assert got[4] and {m["licence"] for m in got[5]} == {"MIT-text"} and len(got[6]) == 1 and got[7] and len(got[10]) >= 2
    check(spark, [])


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, docs)
    assert sum(bool(x) for x in got.values()) > 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert lic.op6(df).count() == len(docs)


def test_passages_are_found_anywhere(spark):
    t = lic.TEMPLATES
    half = t["Apache-2.0-header"].replace("in compliance with the License. You", "in compliance with the License.\r\n \r\nYou").replace("limitations", "\r\n\r\nlimitations")
    docs = [(1, "Copyright 2020 Foo. Released under the MIT License. See the file."), (2, f"some words before it\n{half}\nand many words after it " * 1), (3, "no licence here at all, under the sun"), (4, None)]
    docs += [(10 + i, f"{'word ' * 300}{x}{' other' * 300}") for i, x in enumerate(lic.TEXTS.values())] + [(5, "the of " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: set(r["licences"].split(",")) for r in lic.op6(df).collect()}
    best = {r["doc_id"]: r["best_licence"] for r in lic.op6(df).collect()}
    assert best[3] is None and all(best[10 + i] == name for i, name in enumerate(lic.TEXTS))
    assert "MIT" in got[1] and "Apache-2.0-header" in got[2] and got[3] == got[4] == got[5] == {""}
    assert len(lic.TEXTS) > 20 and len(lic.TEMPLATES) > 25 and all(name in got[10 + i] for i, name in enumerate(lic.TEXTS))
    for r in lic.scan(df).collect():
        for m in [*r["licences"], *r["passages"]]:
            w = words(r["text"])[m["first_word"] : m["first_word"] + m["n_words"]]
            a, b = (Counter(zip(x, x[1:], strict=False)) for x in (w, words({**t, **lic.TEXTS}[m["licence"]])))
            assert abs(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) - m["dice"]) < 1e-9


def test_each_notice_is_its_own_best(spark):
    """Versions of a licence are alike, so others reach the threshold too, but the best is reported; blank lines may hold blanks or end in CRLF."""
    docs = [(i, f"Some heading of a file\r\n \t\r\n{t}\r\n\r\nand an end without any licence") for i, t in enumerate(lic.TEMPLATES.values())]
    check(spark, docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lic.op6(df).orderBy("doc_id").collect()
    assert [(r["best_licence"], r["best_dice"]) for r in rows] == [(n, 1.0) for n in lic.TEMPLATES]
    alike = {"GPL-2.0", "GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0", "AGPL-3.0", "AGPL-3.0-header"}
    assert all(r["licences"] == r["best_licence"] for r in rows if r["best_licence"] in alike)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, lic.TEMPLATES["MIT"], "mine", 5, 7)], "doc_id long, text string, licences string, passages int, other int")
    (r,) = lic.scan(df).collect()
    assert r["other"] == 7 and r["licences"][0]["licence"] == "MIT" and r["passages"] == []

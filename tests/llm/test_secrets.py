import hashlib
import re

from tessel.llm import secrets as s

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in s.op7(df).collect()), key=str)
    want = []
    for i, text, _ in docs:
        b = base(text)
        n = lambda k: sum(x[1] == k for x in b)
        want.append((i, n(0), n(1), n(2), hashlib.sha256(",".join(x[2] for x in b).encode()).hexdigest(), {x[2] for x in b}))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g in got:
        assert any(w[0] == g[0] and w[5] <= set(g[5].split(",")) | {""} for w in want)


H = "0123456789abcdef" * 3


def test_small_cases(spark):
    docs = [
        (1, None, "a"), (2, "", "a"), (3, f'é😀 token = "{H}" and AKIA{"Z9" * 8} x', None), (4, "token=secret:abcdefghijk", "b"), (5, "TOKEN:'abcdefgh' api_key==x=======", "b"),
        (6, "AKIAAKIAAKIAAKIAA akia" + "A" * 20, "c"), (7, ("password: hunter2hunter2 é\n" + H + " ") * 700, "c"), (7, ("password: hunter2hunter2 é\n" + H + " ") * 700, "c"),
        (8, "apikey : short", "d"), (9, H, "d"), (10, f"{H}g{H}", "e"), (11, "-----BEGIN RSA PRIVATE KEY----- ftp://u:pw@h ghp_" + "a" * 36, "e"),
    ]
    check(spark, docs)
    check(spark, [])
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    spans = {r["doc_id"]: r["spans"] for r in s.op7(df).collect()}
    assert spans[11] == "pem:0:31,url:35:43,github:45:85,hex:49:85"


def test_whole_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()])


def test_ownership_tells_examples_from_live(spark):
    copied, own = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    docs = [(i, f"see {copied} here", f"s{i % 4}") for i in range(40)] + [(100, f"mine {own} 🙂 end {copied}", "s0"), (101, "a" * 40, "s1"), (102, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", s.F.length("text").cast("long"))
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in s.op7(df).collect()}
    assert got[100] == (1, 1) and got[0] == (0, 1) and got[101] == (0, 0)
    out = {r["doc_id"]: r for r in s.redact(df).collect()}
    assert len(out) == len(docs) and out[100]["text"] == f"mine [secret] 🙂 end {copied}" and out[100]["n_chars"] == len(out[100]["text"])
    assert all(out[i]["text"] == t for i, t, _ in docs if i != 100)


def test_private_keys_are_taken_whole(spark):
    key = lambda i, end="\n": "-----BEGIN RSA PRIVATE KEY-----" + end + end.join(hashlib.sha512(f"{i} {j}".encode()).hexdigest().upper() for j in range(200)) + end
    close = "-----END RSA PRIVATE KEY-----"
    docs = [(i, f"é {key(i)}{close} after", f"s{i}") for i in range(5)] + [(10 + i, f"{key(99)}{close} x", f"s{i}") for i in range(4)]
    docs += [(20, f"cut {key(20)}QUJD==\nand more words", "s0"), (21, 'k = "' + key(21, "\\n") + close + '" end', "s1"), (22, f"{key(99, chr(13) + chr(10))}{close} y", "s9")]
    docs += [(30, "password: letmein11 ok", "s0"), (31, "db://u:hunter22@h", "s1"), (32, "password: xxxxxxxx", "s2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in s.redact(df).collect()}
    assert all(out[i] == "é [secret] after" for i in range(5))
    assert all(out[i] == t for i, t, _ in docs if 10 <= i < 20 or i in (22, 32))
    assert out[20] == "cut [secret]\nand more words" and out[21] == 'k = "[secret]" end'
    assert out[30] == "[secret] ok" and out[31] == "db[secret]h"


def test_an_example_that_fills_one_source_is_copied(spark):
    example, own = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    docs = [(i, f"see {example} here", "hot") for i in range(200)] + [(300 + i, f"mine {own}", "hot") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    spans = {r["doc_id"]: r["spans"][0] for r in s.scan(df).collect()}
    assert (spans[0]["verdict"], spans[0]["n_repos"], spans[0]["n_owners"]) == ("copied", 200, 1)
    assert (spans[300]["verdict"], spans[300]["n_repos"], spans[300]["n_owners"]) == ("live", 5, 1)
    assert {r["doc_id"]: r["text"] for r in s.redact(df).collect()} == {i: t if i < 300 else "mine [secret]" for i, t, _ in docs}

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessel.llm import prefix_trie


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in by.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += worth
            leaves[k[:d]] += not children[k] if k in children else 1
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, ())), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted([tuple(r) for r in prefix_trie.op12(df).select(*NAMES).collect()], key=str)


def odd_rows(seed, n):
    pick = random.Random(seed)
    texts = [None, "", "a b", "c\td", "a b c", "long " * 500]
    for _ in range(n):
        yield pick.choice([None, -3, -20, *range(0, 45)]), pick.choice([None, 0, 1, 2, 3, 4]), pick.choice([None, "user", "assistant"]), pick.choice(texts)


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 2])
def test_odd_conversations(spark, monkeypatch, block):
    """Nulls, ties, repeated rows, heads that are absent, conversations without turns of their own, extra columns; and blocks of two turns."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = [*odd_rows(1, 300), (7, 0, "user", "only"), (101, 0, "user", "x"), (102, 0, "user", "x")]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, a string, words int").repartition(3)
    assert got(df) == brute(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(40, i, "user", f"turn {i}") for i in range(300)] + [(c, i, "user", f"turn {i}") for c in range(60, 80) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got(df) == brute(rows)


def test_no_rows(spark):
    assert prefix_trie.op12(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

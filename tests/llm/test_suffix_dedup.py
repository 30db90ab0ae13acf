import hashlib
import random

import numpy as np
import pytest

from tessel.llm import suffix_dedup
from tessel.llm.suffix_dedup import LAST, LENGTH


def brute(rows):
    rows = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in rows:
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if least[b[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((None if i == LAST else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def odd_rows(seed, n):
    pick = random.Random(seed)
    base = ["".join(pick.choice("ab é") for _ in range(pick.randint(0, 300))) for _ in range(10)]
    for i in range(n):
        kind = pick.random()
        if kind < 0.3:
            text = pick.choice(base)
        elif kind < 0.7:
            text = pick.choice(base)[pick.randint(0, 80) :] + pick.choice(base)[: pick.randint(0, 200)]
        elif kind < 0.8:
            text = "a" * pick.randint(0, 500)
        elif kind < 0.85:
            text = None
        else:
            text = "ab" * pick.randint(0, 200) + "\0" * pick.randint(0, 120)
        yield pick.choice([None, i, i, i, pick.randint(0, n)]), text


@pytest.mark.parametrize("most_pieces", [20_000, 3])
def test_odd_texts(spark, monkeypatch, most_pieces):
    """Nulls, ties, repeated rows, one long run of a character, null characters, extra columns; and pieces too many for one task."""
    monkeypatch.setattr(suffix_dedup, "MOST_PIECES", most_pieces)
    monkeypatch.setattr(suffix_dedup, "MOST_WINDOWS", 64)
    rows = list(odd_rows(1, 200))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, kept int").repartition(3)
    assert rows_of(suffix_dedup.op11(df)) == brute(rows)


def test_long_texts_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    pick = random.Random(2)
    long = "".join(pick.choice("abcdefgh ") for _ in range(20_000))
    rows = [(5, long), (7, long[3000:9000] + "x" + long[:2000]), (1, long[10_000:10_060]), (2, long[100:149]), (9, long), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.op11(df)) == brute(rows)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicated(df.where("doc_id <> 9")).collect()}
    assert kept[5] == (long[:10_000] + long[10_060:]).encode() and kept[2] == long[100:149].encode()


def test_no_rows(spark):
    assert suffix_dedup.op11(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_do_not_move(spark, sf):
    """The table of chunks is bucketed, so what is found is brought to it without a shuffle of the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    name = suffix_dedup._write_chunks(docs.select("doc_id", "text"), 3)
    chunks = spark.table(name)
    info = spark.createDataFrame([], suffix_dedup.INFO)
    plan = suffix_dedup._with_info(chunks, info, lambda *a: None, "chunk long")._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"drop table {name}")
    assert plan.count("Exchange hashpartitioning") == 1


def test_cover_and_order():
    """Each distance is one of two places of the cover; ties, many and few, are in order of their strings."""
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    pick = random.Random(3)
    block = bytes(pick.choice(b"ab") for _ in range(90))
    raw = b"".join(block[pick.randint(0, 3) :] + bytes([pick.choice(b"xyz")]) for _ in range(150)) + bytes(80)
    data = np.frombuffer(raw, np.uint8)
    got = suffix_dedup.sort_block(data, suffix_dedup.cover_ranks(data), np.arange(len(raw) - 80))
    heads = [raw[p : p + LENGTH] for p in got.tolist()]
    assert heads == sorted(heads)

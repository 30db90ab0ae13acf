import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessel.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "don't 's 'sup ''s !!'s we'll've \n's  'd", "a  b\n\n  c \t d  ", " ", "\n", "x" * 300, "  " * 200 + "a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endo", "ftext|>", "é😀 x y　z", "१२३ ½ Ⅷ", "\x1c\x1d a\x85b", "'re'RE 'll'm", "日本語テスト", "a'", "'", "x\n's", "ab" * 20_000, "=" * 3000, "﻿a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(spark, library, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in bpe.op4(df, PATH).collect())
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_odd_texts(spark, library):
    rng = random.Random(3)
    letters = [*"ab 's\n\t!é1日'rvlmd", "<|endoftext|>", "  ", "ll"]
    more = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    check(spark, library, list(enumerate(ODD + ODD + more)))


def test_empty(spark, library):
    check(spark, library, [])


def test_whole_table(spark, sf, library):
    check(spark, library, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_automaton_is_minimal_and_finds_its_words():
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in ("", "x", "yy")} | {b"a", b"ab", "é".encode()})
    edges, _ = bpe._minimal_automaton(words)
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo.extend(edges[s].values())
    assert len(reached) < 14  # suffixes are shared: a trie would take more than 90
    lexicon = bpe.Lexicon(bpe.Lexicon.compile({w: [i] for i, w in enumerate(words)}))
    asked = [*words, b"ax", b"zing", b"axingg", b"in"]
    data, n = np.frombuffer(b"".join(asked), np.uint8), np.array([len(w) for w in asked])
    assert lexicon.find(data, np.cumsum(n) - n, n).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert (bpe.Lexicon(bpe.Lexicon.compile({})).find(data, np.cumsum(n) - n, n) == -1).all()


def test_long_merge_equals_rows():
    v = bpe.Vocabulary(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choice("theandig e") for _ in range(rng.randrange(1, 48))).encode() for _ in range(300)]
    data, n = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ids, counts = v.merge(data, np.cumsum(n) - n, n)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [v.merge_long(w) for w in words]


def test_words_of_one_hash_are_told_apart(spark, library, monkeypatch):
    bits = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    other = ["ab"["ba".index(b)] for b in bits]
    docs = [(i, f"{''.join(x[:n])} {''.join(y[:n])}") for i, (x, y, n) in enumerate([(bits, other, 1024), (other, bits, 1024), (bits, other, 7), (bits, bits, 30)])]
    check(spark, library, docs)
    monkeypatch.setattr(bpe, "run_hashes", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    v = bpe.Vocabulary(PATH)
    codec = bpe.Codec(v, bpe.Lexicon(bpe.Lexicon.compile({})))
    for _, text in docs:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = codec.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_clashing_columns(spark, library):
    rows = [(1, "the same words", 5, "x")] * 2 + [(1, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, token_ids string")
    got = bpe.encode(df, PATH).collect()
    want = library.encode("the same words", add_special_tokens=False).ids
    assert sorted(r["token_ids"] for r in got) == [[], want, want] and {r["n_tokens"] for r in got} == {5, None} and {r["decoded"] for r in got} == {"", "the same words"}

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Each benchmark item gives its windows of consecutive words; the search finds all occurrences of
any window in each document. The tables are those of Wu and Manber with words as symbols:

* a shift table tells for the block of two words that ends at a position how far the nearest
  possible end of a window is; blocks that are in no window let the search skip nearly a window;
* at shift 0 the suffix block and the prefix block select a bucket of windows;
* the words of the window and of the document are then compared directly.

Many short segments of the documents are searched in step, so each step is an array operation.
Every position that a shift table can't exclude is looked at, over whole texts.

Cases: null and empty texts have no words and no hits; an item of fewer words than a window, but
not none, is one window; items without words have none; repeated items count once by item_id;
repeated documents give a row each; an empty benchmark hits nothing; columns of the input that
have the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from .arrow import add_columns, keep_where
from .words import _ODD, Texts, blocks, mix

WINDOW = 10
SEGMENT = 64
#: Bytes of benchmark text in one set of tables; a larger benchmark takes more passes over the documents.
BLOCK_OF_ITEMS = 2 << 20


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


class Tables:
    """Shift table and buckets of the windows of one length."""

    def __init__(self, length: int, windows: list[tuple[bytes, ...]], hashes: np.ndarray, items: list[list[str]]):
        self.length, self.block = length, min(2, length)
        ends = range(self.block - 1, length)
        block_at = {j: self._block(hashes[:, j - 1] if self.block == 2 else None, hashes[:, j]) for j in ends}
        size = 1 << max(12, int(np.ceil(np.log2(16 * max(1, len(windows) * len(ends))))))
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, length - self.block + 1, np.uint8)
        for j in ends:  # later blocks are nearer to the end and overwrite
            self.shift[(block_at[j] & self.mask).astype(np.int64)] = length - 1 - j
        keys = _pair(block_at[self.block - 1], block_at[length - 1])
        order = np.argsort(keys, kind="stable")
        self.keys, self.hashes = keys[order], hashes[order]
        self.windows = [b" ".join(windows[i]) for i in order]
        self.items = [items[i] for i in order]

    def _block(self, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        return _pair(a, b) if self.block == 2 else mix(b.copy())

    def search(self, texts: Texts, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, window) of all occurrences."""
        m, bounds = self.length, texts.word_offsets
        counts = np.diff(bounds)
        n_segments = np.where(counts >= m, -(-(counts - m + 1) // SEGMENT), 0)
        total = int(n_segments.sum())
        if not total:
            return
        before = np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        at = np.repeat(bounds[:-1] + m - 1, n_segments) + (np.arange(total) - before) * SEGMENT
        stop = np.minimum(at + SEGMENT, np.repeat(bounds[1:], n_segments))
        found = []
        while len(at):
            ends = self._block(h[at - 1] if self.block == 2 else None, h[at])
            step = self.shift[(ends & self.mask).astype(np.int64)]
            possible = np.flatnonzero(step == 0)
            if len(possible):
                found.append((at[possible], ends[possible]))
            at = at + np.maximum(step, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        if not found:
            return
        at, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        first = at - (m - 1)
        starts = self._block(h[first] if self.block == 2 else None, h[first + self.block - 1])
        key = _pair(starts, ends)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        for i in np.flatnonzero(high > low):
            for w in range(low[i], high[i]):
                f = int(first[i])
                if np.array_equal(self.hashes[w], h[f : f + m]) and self.windows[w] == b" ".join(texts.word(j) for j in range(f, f + m)):
                    yield f, w


def build_tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Tables]:
    """Tables for (item id, text) rows, one for each length of window that is there."""
    by_length: dict[int, dict[tuple[bytes, ...], tuple[np.ndarray, set[str]]]] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        texts = Texts(data, np.array([0, len(data)]))
        h = texts.hashes()
        words = [texts.word(i) for i in range(len(h))]
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), (h[i : i + m], set()))[1].add(item)
    return [Tables(m, list(x), np.stack([v[0] for v in x.values()]), [sorted(v[1]) for v in x.values()]) for m, x in sorted(by_length.items())]


def find_windows(texts: Texts, tables: list[Tables]) -> tuple[np.ndarray, list[list[str]], list[list[int]]]:
    """Words of each text, its items with occurring windows, and the indexes of its hit words."""
    h = texts.hashes()
    items: dict[int, set[str]] = {}
    runs: dict[int, list[tuple[int, int]]] = {}
    for t in tables:
        for f, w in t.search(texts, h):
            d = int(np.searchsorted(texts.word_offsets, f, "right")) - 1
            items.setdefault(d, set()).update(t.items[w])
            runs.setdefault(d, []).append((f - int(texts.word_offsets[d]), t.length))
    n = len(texts)
    hits: list[list[int]] = [[] for _ in range(n)]
    for d, found in runs.items():
        hits[d] = sorted({i for a, k in found for i in range(a, a + k)})
    return np.diff(texts.word_offsets), [sorted(items.get(d, ())) for d in range(n)], hits


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of bounded size."""
    block, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        block.append((item, text))
        size += len(text) + 64
        if size >= BLOCK_OF_ITEMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_words (their indexes) and items (ids of items with occurring windows, sorted as strings).

    The benchmark goes to the tasks in blocks of at most BLOCK_OF_ITEMS bytes, one after the
    other; with more than one, each is a pass over the documents and their hits are united.
    """
    sc = docs.sparkSession.sparkContext
    fields = [("n_words", LongType()), ("hit_words", ArrayType(IntegerType())), ("items", ArrayType(StringType()))]

    def search(df: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
        shared = sc.broadcast(build_tables(block, window))

        def make():
            def work(column):
                n, items, hits = [], [], []
                for _, _, texts in blocks(column):
                    a, b, c = find_windows(texts, shared.value)
                    n.extend(a.tolist())
                    items.extend(b)
                    hits.extend(c)
                return [n, hits, items]

            return work

        return add_columns(df, text_col, fields, make)

    passes = iter(_item_blocks(benchmark, item_col, item_text_col))
    out = search(docs, next(passes, []))
    for block in passes:
        before = out.withColumnsRenamed({"hit_words": "__hits", "items": "__items"})
        out = search(before, block)
        out = out.withColumn("hit_words", F.array_sort(F.array_union("hit_words", "__hits"))).withColumn("items", F.array_sort(F.array_union("items", "__items"))).drop("__hits", "__items")
    return out


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of contamination() for each document."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain a window of the benchmark."""
    return keep_where(docs, lambda df: contamination(df, benchmark), ["n_words", "hit_words", "items"], F.size("hit_words") == 0)

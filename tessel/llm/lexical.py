"""Ranked lexical search by MaxScore with bounds of term pairs.

index() cuts the documents into segments; each has the postings of the terms that the stated queries have, as the
queries come in blocks of bounded size. Once the frequencies of the whole corpus are known, each segment is given the impacts of
its postings and, for pairs of terms that stand together in a query, the intersection of their lists with the largest
joint impact: impacts().

search() then takes each query to each segment. Terms are ordered by their largest impact, pairs of them are taken together: what
a pair can add is the larger of its joint maximum and the maximum of either term without the other, which is less than the sum of
both maxima where the two seldom meet. Lists whose bounds together stay below the score of the k-th hit so far are only probed for
documents that the others bring up, and these are dropped once what is left can't bring them to that score. All
is exact: only documents whose bound is below k scores that are there are left out.

Scores are integers: a term's weight floor(1000 ln((2 N + 2) / (2 df + 1))) times
(1000000000 tf) div (1000 tf + 20 m), with m = 100 - 50 + (50 n N) div L of the document.

Cases: null texts and null queries have no terms; documents without terms aren't counted in N; repeated documents are ranked one by one,
equal scores by id, null ids last; repeated queries each have their hits under their id, and rows of one id are one query each, so ranks
of one id repeat only if the id does; queries without terms or whose terms are in no document have no row; empty tables give no
row; terms are compared by their bytes, also where hashes meet; long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import keep

from .arrow import bound_batches, release, slices
from .words import LOWER, Texts, blocks, run_hashes, same_runs

TOP = 50
#: Bytes of queries whose terms are looked for in one pass over the documents.
BLOCK_OF_QUERIES = 1 << 20
#: Postings and documents of a segment, about.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 20, 1 << 15
#: A term is paired with so many of the terms after it by weight.
PARTNERS = 1
SEGMENT = "docs array<long>, lengths binary, terms binary, starts binary, at binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, A-Z in lower case, with repeats."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    texts = Texts(data, np.array([0, len(data)]))
    return [texts.word(i) for i in range(len(texts.starts))]


class Vocabulary:
    """Terms, numbered in order of their hashes; words of a text are found by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        lengths = np.array([len(t) for t in terms], np.int64)
        starts = np.cumsum(lengths) - lengths
        h = run_hashes(data, starts, lengths)
        order = np.argsort(h, kind="stable")
        self.terms = [terms[i] for i in order]
        self.data, self.hashes, self.starts, self.lengths = data, h[order], starts[order], lengths[order]
        # terms that share a hash are tried one after the other
        self.ties = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(h) else 0

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of words that are terms, their terms)."""
        h, lengths = texts.hashes(), texts.ends - texts.starts
        if not len(h) or not self.ties:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.searchsorted(self.hashes, h)
        both = np.concatenate([LOWER[texts.data], self.data])
        words, terms = [], []
        for k in range(self.ties):
            t = np.minimum(low + k, len(self.hashes) - 1)
            some = np.flatnonzero((low + k < len(self.hashes)) & (self.hashes[t] == h) & (self.lengths[t] == lengths))
            some = some[same_runs(both, texts.starts[some], self.starts[t[some]] + len(texts.data), lengths[some])]
            words.append(some)
            terms.append(t[some])
        return np.concatenate(words), np.concatenate(terms)


def _segments(vocabulary: Vocabulary):
    """Batches of (doc_id, text) to rows of SEGMENT."""
    size = max(1, len(vocabulary.terms))

    def close(ids: list, lengths: list, keys: list, counts: list) -> pa.RecordBatch:
        key, n = np.concatenate(keys), np.concatenate(counts)
        term, at = key % size, (key // size)
        order = np.argsort(term, kind="stable")  # lists by term, each by document
        term, at, n = term[order], at[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        packed = [np.concatenate(lengths).astype("<i4"), term[first].astype("<i4"), np.append(first, len(term)).astype("<i4"), at.astype("<i4"), n.astype("<i4")]
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, keys, counts, held = [], [], [], [], 0
        for batch in batches:
            for some in slices(batch, 1):
                for first, last, texts in blocks(some.column(1)):
                    words, terms = vocabulary.find(texts)
                    doc = np.searchsorted(texts.word_offsets, words, "right") - 1 + len(ids)
                    key, n = np.unique(doc * size + terms, return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    lengths.append(np.diff(texts.word_offsets))
                    ids.extend(some.column(0).slice(first, last - first).to_pylist())
                    held += len(key)
                    if held >= SEGMENT_POSTINGS or len(ids) >= SEGMENT_DOCS:
                        yield close(ids, lengths, keys, counts)
                        ids, lengths, keys, counts, held = [], [], [], [], 0
        if ids:
            yield close(ids, lengths, keys, counts)
        release()

    return run


def index(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of all documents."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a block of queries, so bounded
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return keep(rows.mapInArrow(lambda batches: _segments(shared.value)(batches), SEGMENT))


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i4").astype(np.int64)


def statistics(segments: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms + 2, np.int64), 0, 0
        for batch in batches:
            for lengths, terms, starts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lengths = _ints(lengths)
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
                df[_ints(terms)] += np.diff(_ints(starts))
        df[n_terms:] = n, total
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "n": pa.array(df[some], pa.int64())})

    summed = segments.select("lengths", "terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(n_terms + 2, np.int64)
    for term, n in summed.collect():  # a row for each term of a block of queries
        df[term] = n
    return int(df[-2]), int(df[-1]), df[:n_terms]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(weights: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 50 + (50 * lengths * n_docs) // total
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def pairs_of(queries: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Pairs (p, q) of terms, distinct: each term of a query with the PARTNERS terms after it by weight."""
    found = set()
    for terms in queries:
        ranked = terms[np.lexsort((terms, -weights[terms]))]
        for step in range(1, PARTNERS + 1):
            found.update(zip(ranked[:-step:2].tolist(), ranked[step::2].tolist(), strict=False))
    return np.array(sorted(found), np.int64).reshape(-1, 2)


class Segment:
    """Lists of a segment with impacts, and of pairs of terms what they can add at most."""

    def __init__(self, row: dict, weights: np.ndarray, pairs: np.ndarray, n_docs: int, total: int):
        self.docs, lengths, self.starts, self.at = row["docs"], _ints(row["lengths"]), _ints(row["starts"]), _ints(row["at"])
        terms = _ints(row["terms"])
        self.place = {int(t): i for i, t in enumerate(terms)}
        of = np.repeat(weights[terms], np.diff(self.starts)) if len(terms) else np.empty(0, np.int64)
        self.impacts = impact(of, _ints(row["counts"]), lengths[self.at], n_docs, total) if len(of) else of
        self.most = {t: int(self.impacts[self.starts[i] : self.starts[i + 1]].max()) for t, i in self.place.items()}
        self.pairs = {(p, q): self._join(p, q) for p, q in pairs.tolist() if p in self.place and q in self.place}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.place[term]
        return self.at[self.starts[i] : self.starts[i + 1]], self.impacts[self.starts[i] : self.starts[i + 1]]

    def _join(self, p: int, q: int) -> int:
        """The most that a document of the segment has of the two terms: over their intersection jointly, over the rest singly."""
        (a, x), (b, y) = self.list_of(p), self.list_of(q)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        joint = int((x[i] + y[j]).max()) if len(both) else 0
        x, y = x.copy(), y.copy()
        x[i], y[j] = 0, 0
        return max(joint, int(x.max()), int(y.max()))

    def units(self, terms: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
        """(bound, terms) of disjoint pairs and of the single terms left, by ascending bound."""
        left, out = [int(t) for t in terms if int(t) in self.place], []
        free = set(left)
        known = sorted((self.pairs[k] - self.most[k[0]] - self.most[k[1]], k) for k in zip(left, left[1:], strict=False) if k in self.pairs)
        for _, (p, q) in known:  # those that tighten the bound most come first
            if p in free and q in free:
                free -= {p, q}
                out.append((self.pairs[p, q], (p, q)))
        out += [(self.most[t], (t,)) for t in free]
        return sorted(out)

    def search(self, terms: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best, least being a score that the k-th has at least."""
        units = self.units(terms)
        bounds = np.cumsum([b for b, _ in units])
        if not units or bounds[-1] < max(least, 1):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        optional = int(np.searchsorted(bounds, max(least, 1)))  # their bounds together don't reach the score
        lists = [self.list_of(t) for _, ts in units[optional:] for t in ts]
        at, score = np.concatenate([a for a, _ in lists]), np.concatenate([s for _, s in lists])
        sums = np.bincount(at, score.astype(np.float64), len(self.docs)).astype(np.int64)  # far below 2**53
        docs = np.flatnonzero(sums > 0)
        sums = sums[docs]
        for u in range(optional - 1, -1, -1):
            if len(docs) > k:
                least = max(least, int(np.partition(sums, -k)[-k]))
            some = sums + bounds[u] >= least
            docs, sums = docs[some], sums[some]
            for t in units[u][1]:
                a, s = self.list_of(t)
                i = np.minimum(np.searchsorted(a, docs), len(a) - 1)
                sums = sums + np.where(a[i] == docs, s[i], 0)
        some = sums >= max(least, 1)
        return docs[some], sums[some]


def search(segments: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, total: int, k: int = TOP) -> DataFrame:
    """query, doc_id, score: candidates of each task for each query, its k best."""
    sc = segments.sparkSession.sparkContext
    shared = sc.broadcast((queries, weights, pairs_of(queries, weights)))
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w, pairs = shared.value
        ranked = [terms[np.lexsort((terms, -w[terms]))] for terms in asked]
        best: list[list[tuple[int, int, int | None]]] = [[] for _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment({n: row[n] for n in names}, w, pairs, n_docs, total)
                for q, terms in enumerate(ranked):
                    least = -best[q][k - 1][0] if len(best[q]) >= k else 0
                    docs, scores = segment.search(terms, least, k)
                    if not len(docs):
                        continue
                    own = [(-s, last if segment.docs[d] is None else segment.docs[d], segment.docs[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                    best[q] = sorted(best[q] + own, key=lambda x: x[:2])[:k]
        rows = [(q, i, -s) for q, hits in enumerate(best) for s, _, i in hits]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])
        release()

    return segments.mapInArrow(run, "query long, doc_id long, score long")


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for item, text in queries.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        block.append((item, text))
        size += len(text.encode()) + 64
        if size >= BLOCK_OF_QUERIES:
            yield block
            block, size = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id_col, rank, doc_id, score of the k best documents (doc_id, text) for each of the stated queries."""
    spark, out = docs.sparkSession, None
    kind = queries.schema[id_col].dataType.simpleString()
    for block in _query_blocks(queries, id_col, text_col):
        bags = [sorted(set(terms_of(text))) for _, text in block]
        vocabulary = Vocabulary(sorted({t for bag in bags for t in bag}))
        number = {t: i for i, t in enumerate(vocabulary.terms)}
        segments = index(docs, vocabulary)
        n_docs, total, df = statistics(segments, len(number))
        held = [np.array(sorted(number[t] for t in bag if df[number[t]]), np.int64) for bag in bags]
        weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)
        found = search(segments, held, weights, n_docs, total, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query long, {id_col} {kind}")
        best = best.join(F.broadcast(names), "query").select(id_col, "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score long")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))

"""Language-model scoring by masked pseudo-likelihood.

A small network predicts each word from the two words before and the two after it, and a
document's score is the sum of the conditional log-probabilities of all its words.

* Words: all documents are counted; the most frequent words get an id of their own, all others one
  of RARE ids by their hash.
* Words of a shared id: P(word | window) = P(id | window) * P(word | id). The second factor is the word's count over
  those of its id and one more, which unseen words share. All words of the corpus are counted; the counts of
  the more frequent go to the tasks in a table of fixed size, the rest stay a table and are joined.
* Network: the embeddings of the window's words, scaled by place, give a hidden vector; a softmax
  over each digit, given the digits before it, gives the probability.
* Training: every word of every document is masked and predicted once; each of ROUNDS rounds takes those that
  a hash of the words around and of the place in the text gives it. Each task trains on its documents with numpy, and the tasks' parameters are averaged by Spark,
  weighted by examples, for ROUNDS rounds. The same seed starts each task.

Counts, training and scores cover whole texts of all documents. What goes through the driver are the
vocabulary and the parameters, whose sizes are fixed; the table of counts grows with the corpus.

Cases: null and empty texts, and texts without words, have no words and a score of 0 (mean null);
repeated rows count as often as they are there; words that are equally frequent are taken by hash; long texts are
scored whole, in blocks of bounded size or, if larger, alone; with an empty table the result is empty; columns
that have the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from tessel.sources.shared import keep

from .arrow import add_columns, bound_batches, release
from .words import Texts, blocks, mix, term_counts

FREQUENT, RARE, SIDE = 3072, 1024, 16
SIZE = FREQUENT + RARE  # SIDE**3: an id is three digits of SIDE
EDGE = SIZE  # the id beyond the ends of a text
#: Most words whose counts go to the tasks; those of all others are joined.
KNOWN = 1 << 16
WIDTH = 16
PLACES = (-2, -1, 1, 2)
ROUNDS, RATE = 2, 0.05
BATCH = 2048
#: Parts that the parameters move in, and tasks whose parameters are averaged at once.
SLICES, FAN_IN = 16, 64


class Vocabulary:
    def __init__(self, hashes: np.ndarray, known: np.ndarray | None = None, counts: np.ndarray | None = None, totals: np.ndarray | None = None):
        """hashes: of the frequent words, most frequent first; known, counts: words and their counts; totals: of the shared ids."""
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        known = np.empty(0, np.uint64) if known is None else known
        by_hash = np.argsort(known)
        self.known = known[by_hash]
        self.log_counts = np.log(np.empty(0) if counts is None else counts[by_hash])
        self.log_totals = np.log(np.ones(RARE) if totals is None else totals + 1.0)

    def ids(self, texts: Texts) -> np.ndarray:
        return self.ids_of(texts.hashes())

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        out = (FREQUENT + (h >> np.uint64(20)) % np.uint64(RARE)).astype(np.int32)
        at, known = _find(self.sorted, h)
        out[known] = self.order[at[known]]
        return out

    def shares(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | id) of each word, and which words were taken to have a count of one as theirs isn't known here."""
        out, rest = np.zeros(len(h)), ids >= FREQUENT
        out[rest] = -self.log_totals[ids[rest] - FREQUENT]
        at, known = _find(self.known, h)
        known &= rest
        out[known] += self.log_counts[at[known]]
        return out, rest & ~known


def _find(ordered: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each h is in ordered, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(ordered, h)
    at[at == len(ordered)] = 0
    return at, ordered[at] == h


def windows(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """int32 of shape (words, places): the ids around each word, EDGE beyond its text."""
    n = len(ids)
    out = np.full((n, len(PLACES)), EDGE, np.int32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k, p in enumerate(PLACES):
        to = slice(max(0, -p), n - max(0, p))
        of = slice(max(0, p), n - max(0, -p))
        out[to, k] = np.where(text[to] == text[of], ids[of], EDGE)
    return out


SHAPES = {"e": (SIZE + 1, WIDTH), "s": (len(PLACES), WIDTH), "b": (WIDTH,)}
for _k in (1, 2, 3):
    SHAPES |= {f"m{_k}": (WIDTH, WIDTH), f"g{_k}": (SIDE ** (_k - 1), WIDTH), f"w{_k}": (SIDE, WIDTH), f"c{_k}": (SIDE,)}
PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())


def start(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, PARAMETERS).astype(np.float32)
    p = views(flat)
    p["s"][:], p["b"][:] = 1, 0
    for k in (1, 2, 3):
        p[f"c{k}"][:] = 0
        p[f"m{k}"][:] += np.eye(WIDTH, dtype=np.float32)
    return flat


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def _bend(z: np.ndarray) -> np.ndarray:
    """z / (1 + |z|), in place of tanh as it costs a tenth; its slope is (1 - |y|)**2."""
    return z / (1 + np.abs(z))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Of each column."""
    x = x - x.max(axis=0)
    return x - np.log(np.exp(x).sum(axis=0))


def forward(p: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray):
    """Log-probabilities of the targets, and what the gradient needs: the hidden vectors and, by digit, its value, what stands before it, hidden vectors and log-probabilities (a column for each target)."""
    h = _bend(sum(p["e"].take(around[:, k], axis=0) * p["s"][k] for k in range(len(PLACES))) + p["b"])
    every, total, digits = np.arange(len(target)), 0, []
    for k, unit in ((1, SIDE * SIDE), (2, SIDE), (3, 1)):
        digit, before = target // unit % SIDE, target // (unit * SIDE)
        hk = _bend(h @ p[f"m{k}"] + p[f"g{k}"].take(before, axis=0))
        lk = _log_softmax(p[f"w{k}"] @ hk.T + p[f"c{k}"][:, None])
        total = total + lk[digit, every]
        digits.append((digit, before, hk, lk))
    return total, (h, digits)


def gradient(p: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray, flat: np.ndarray) -> None:
    """Adds the gradient of the mean negative log-probability to flat."""
    _, (h, digits) = forward(p, around, target)
    n, every, d, dh = len(target), np.arange(len(target)), views(flat), 0
    for k, (digit, before, hk, lk) in enumerate(digits, 1):
        o = np.exp(lk)
        o[digit, every] -= 1
        o /= n
        d[f"w{k}"] += o @ hk
        d[f"c{k}"] += o.sum(axis=1)
        dz = (o.T @ p[f"w{k}"]) * (1 - np.abs(hk)) ** 2
        d[f"m{k}"] += h.T @ dz
        _add_rows(d[f"g{k}"], before, dz)
        dh = dh + dz @ p[f"m{k}"].T
    dz = dh * (1 - np.abs(h)) ** 2
    d["b"] += dz.sum(axis=0)
    for k in range(len(PLACES)):
        d["s"][k] += (dz * p["e"].take(around[:, k], axis=0)).sum(axis=0)
    _add_rows(d["e"], around.T.ravel(), np.concatenate([dz * p["s"][k] for k in range(len(PLACES))]))


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    if len(to) == 1:
        to[0] += rows.sum(axis=0)
        return
    at = at.astype(np.uint16)  # sorted by digits
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    to[at[first]] += np.add.reduceat(rows.take(order, axis=0), first, axis=0)


class Trainer:
    """Adagrad over batches of examples as they come."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.squares, self.examples = flat.copy(), np.full(PARAMETERS, 1e-6, np.float32), 0
        self.around, self.target, self.waiting = [], [], 0

    def add(self, around: np.ndarray, target: np.ndarray) -> None:
        self.around.append(around)
        self.target.append(target)
        self.waiting += len(target)
        if self.waiting >= BATCH:
            self.step()

    def step(self) -> None:
        if not self.waiting:
            return
        around, target = np.concatenate(self.around), np.concatenate(self.target)
        for a in range(0, len(target), BATCH):
            g = np.zeros(PARAMETERS, np.float32)
            gradient(views(self.flat), around[a : a + BATCH], target[a : a + BATCH], g)
            self.squares += g * g
            self.flat -= RATE * g / np.sqrt(self.squares)
        self.examples += len(target)
        self.around, self.target, self.waiting = [], [], 0


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the hash of every word of all documents and how often it is there, as a written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in blocks(batch.column(0)):
                h, n = np.unique(texts.hashes(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])
        release()

    bound_batches(docs.sparkSession)
    return keep(docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary_of(counts: DataFrame, frequent: int = FREQUENT, most_known: int = KNOWN) -> Vocabulary:
    """The most frequent words, FREQUENT at most, with ids of their own, and the counts of at most most_known words."""

    def hashes(table) -> np.ndarray:
        return table["word"].to_numpy(np.int64).view(np.uint64)

    top = counts.orderBy(F.col("n").desc(), "word").limit(frequent).toPandas()
    size = F.floor(F.log2("n") * 8)
    cut, words = None, 0
    for r in sorted(counts.where("n > 1").groupBy(size.alias("size")).count().collect(), reverse=True):
        words += r["count"]
        if words > most_known:
            break
        cut = r["size"]
    known = counts.where(F.lit(False) if cut is None else (F.col("n") > 1) & (size >= cut)).toPandas()
    totals = np.zeros(RARE)
    shared = (F.shiftrightunsigned("word", 20) % RARE).alias("shared")
    for r in counts.groupBy(shared).agg(F.sum("n").alias("n")).collect():
        totals[r["shared"]] = r["n"]
    own = hashes(top)
    np.subtract.at(totals, ((own >> np.uint64(20)) % np.uint64(RARE)).astype(np.int64), top["n"].to_numpy(np.float64))
    return Vocabulary(own, hashes(known), known["n"].to_numpy(np.float64), totals)


def count_words(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The vocabulary of all documents."""
    return vocabulary_of(word_counts(docs, text_col))


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after some rounds over all documents; each word is predicted in one of them."""
    sc = docs.sparkSession.sparkContext
    flat = start()
    cuts = np.linspace(0, PARAMETERS, SLICES + 1).astype(int)
    for r in range(rounds):
        shared = sc.broadcast((vocabulary, flat))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            words, before = shared.value
            trainer = Trainer(before)
            for batch in batches:
                for _, _, texts in blocks(batch.column(0)):
                    ids = words.ids(texts)
                    if not len(ids):
                        continue
                    around = windows(ids, texts.word_offsets)
                    place = np.arange(len(ids)) - np.repeat(texts.word_offsets[:-1], np.diff(texts.word_offsets))
                    salt = (around.astype(np.uint64) * np.array([3, 5, 7, 11], np.uint64)).sum(axis=1)
                    chosen = (mix(salt + place.astype(np.uint64)) >> np.uint64(32)) % np.uint64(rounds) == r
                    trainer.add(around[chosen], ids[chosen])
            trainer.step()
            if trainer.examples:
                task = TaskContext.get().partitionId()
                parts = [trainer.flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([trainer.examples] * SLICES, pa.int64()), pa.array(parts, pa.binary())], names=["slice", "task", "n", "v"])

        def mean(keys: tuple, table: pa.Table) -> pa.Table:
            n = table["n"].to_numpy()
            total = np.zeros(cuts[keys[0].as_py() + 1] - cuts[keys[0].as_py()])
            for k, v in sorted(zip(n.tolist(), table["v"].to_pylist(), strict=True)):
                total += np.frombuffer(v, np.float32) * (k / n.sum())
            own = {"slice": pa.array([keys[0].as_py()], pa.int32())} | ({"task": pa.array([keys[1].as_py()], pa.int32())} if len(keys) > 1 else {})
            return pa.table(own | {"n": pa.array([int(n.sum())], pa.int64()), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        kind = "slice int, n long, v binary"
        some = keep(docs.select(text_col).mapInArrow(fit, "slice int, task int, n long, v binary"))
        tasks = some.agg(F.max("task")).first()[0] or 0
        while tasks >= FAN_IN:
            tasks //= FAN_IN
            some = some.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
            some = some.groupBy("slice", "task").applyInArrow(mean, "slice int, task int, n long, v binary")
        whole = keep(some.groupBy("slice").applyInArrow(mean, kind)).orderBy("slice").collect()
        shared.destroy()
        if not whole:
            return flat
        flat = np.concatenate([np.frombuffer(x["v"], np.float32) for x in whole])
    return flat


def log_probabilities(flat: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log P(id | window) of each word of a block of texts."""
    around = windows(ids, offsets)
    p, out = views(flat), np.empty(len(ids))
    for a in range(0, len(ids), 8192):
        out[a : a + 8192] = forward(p, around[a : a + 8192], ids[a : a + 8192])[0]
    return out


def score(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, text_col: str = "text", counts: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs, or these columns of it, with n_words, log_probability (of all words) and mean_log_probability.

    counts is the table that the vocabulary was made of; without it, words that the vocabulary doesn't know
    have the probability of unseen ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))

    def make():
        words, parameters = shared.value

        def work(column):
            n, sums, rest, times, ends = [], [], [], [], [np.zeros(1, np.int32)]
            for _, _, texts in blocks(column):
                h, at = texts.hashes(), texts.word_offsets
                ids = words.ids_of(h)
                share, unknown = words.shares(h, ids)
                lp = np.concatenate([[0.0], np.cumsum(log_probabilities(parameters, ids, at) + share)])
                n.append(np.diff(at))
                sums.append(lp[at[1:]] - lp[at[:-1]])
                terms, often, offsets = term_counts(h[unknown], np.concatenate([[0], np.cumsum(unknown)])[at])
                rest.append(terms.view(np.int64))
                times.append(often)
                ends.append((offsets[1:] + ends[-1][-1]).astype(np.int32))
            n, sums, ends = np.concatenate(n), np.concatenate(sums), pa.array(np.concatenate(ends), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (rest, times)]
            return [pa.array(n, pa.int64()), pa.array(sums, pa.float64()), *lists]

        return work

    rows = docs if columns is None else docs.select(*columns, docs[text_col].alias("__word"))
    fields = [("n_words", LongType()), ("log_probability", DoubleType()), ("__word", ArrayType(LongType())), ("__times", ArrayType(LongType()))]
    out = add_columns(rows, text_col if columns is None else "__word", fields, make)
    if counts is not None:
        out = keep(out.withColumn("__row", F.monotonically_increasing_id()))
        rest = out.select("__row", F.inline(F.arrays_zip("__word", "__times")))
        rest = rest.join(counts.where("n > 1").withColumnRenamed("word", "__word"), "__word")
        more = rest.groupBy("__row").agg(F.sum(F.col("__times") * F.log("n")).alias("__more"))
        out = out.join(more, "__row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("__more", F.lit(0.0))).drop("__row", "__more")
    out = out.drop("__word", "__times")
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))


def op10(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    counts = word_counts(rows)
    vocabulary = vocabulary_of(counts)
    scored = score(rows, vocabulary, train(rows, vocabulary), counts=counts, columns=["doc_id"])
    return scored.select("doc_id", "n_words", F.round("log_probability", 3).alias("log_probability"), F.round("mean_log_probability", 5).alias("mean_log_probability"))

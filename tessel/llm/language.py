"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined as log-probabilities:

* the text, by a naive Bayes model of byte trigrams over letters;
* the declared language (of the markup, or of a metadata column), by how often each declaration
  goes with each language of the texts in the whole corpus;
* the address suffix and the host, by priors that are smoothed along the hierarchy: all rows,
  then the suffix, then the host. Their counts are grouped sums over all rows.

The text model is fitted on a sample of labelled rows, at most SAMPLE_ROWS in expectation, chosen
by a hash of the id, and one row at least of each label; everything else covers all rows.

A row is rejected if its text has no letters or no language gets LEAST_POSTERIOR.

Cases: null and empty texts, and texts without letters, have no text evidence; their language is
null and they are rejected; a null or unknown declaration, host or suffix is a value of its own;
repeated rows count as often as they are there; with an empty table, or without any labelled row,
the result is empty or all rejected; of languages that are equally likely the first by name is taken; columns that have the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from tessel.sources.shared import keep

from .arrow import add_columns, bound_batches, keep_where, release
from .words import LOWER, blocks

SAMPLE_ROWS = 20_000
#: More labels than this are an error: the column has no languages.
MOST_LABELS = 4096
FEATURES = 1 << 16
LEAST_POSTERIOR = 0.5
#: Trigrams overlap, so their evidence counts for a part.
TEMPER = 0.3
#: Rows that a level of the hierarchy counts for at the next.
SMOOTHING = 20.0
BROADCAST_HOSTS = 100_000


def _letter_table() -> np.ndarray:
    """Each byte in lower case (A-Z only); all that are no part of letters become blanks."""
    b = np.arange(256)
    letter = ((LOWER >= 97) & (LOWER <= 122)) | (b >= 128)
    return np.where(letter, LOWER, 32).astype(np.uint32)


_LETTERS = _letter_table()


def _features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Features at each byte but those that would cross texts (-1), and which bytes are letters."""
    x = _LETTERS[texts.data]
    f = np.full(len(x), -1, np.int64)
    if len(x) > 2:
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        f[:-2] = h & np.uint32(FEATURES - 1)
        f[:-2][(x[:-2] == 32) & (x[1:-1] == 32)] = -1
        inner = texts.offsets[1:-1]
        for back in (1, 2):
            at = inner - back
            f[at[at >= 0]] = -1
    return f, x != 32


class TextModel:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table  # log-probabilities: (languages, features + 1), the last 0

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (rows, languages) and the number of letter bytes of each row."""
        lls, letters = [], []
        for _, _, texts in blocks(column):
            f, is_letter = _features(texts)
            n = len(texts)
            ll = np.zeros((n, len(self.languages)))
            full = np.flatnonzero(np.diff(texts.offsets) > 0)
            at = texts.offsets[full]
            if len(full):
                for k, row in enumerate(self.table):
                    ll[full, k] = np.add.reduceat(row[f], at, dtype=np.float64)
            count = np.zeros(n, np.int64)
            if len(full):
                count[full] = np.add.reduceat(is_letter, at, dtype=np.int64)
            lls.append(ll)
            letters.append(count)
        return np.concatenate(lls), np.concatenate(letters)


def hash_bound(total: int, sample_rows: int) -> int:
    """The 64-bit hash up to which sample_rows of total rows are expected."""
    return min(2**63 - 1, -(2**63) + max(0, int(2**64 * sample_rows / max(1, total)) - 1))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Naive Bayes from a hash sample of rows with labels; counts are summed by Spark."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("i"))
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("first")).limit(MOST_LABELS + 1).collect()
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels are no languages")
    rows = rows.where((F.col("h") <= hash_bound(sum(r["n"] for r in labels), sample_rows)) | F.col("h").isin([r["first"] for r in labels]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for first, last, texts in blocks(batch.column(1)):
                f, _ = _features(texts)
                for i in range(first, last):
                    own = f[texts.offsets[i - first] : texts.offsets[i - first + 1]]
                    total = sums.setdefault(labels[i], np.zeros(FEATURES, np.int64))
                    total += np.bincount(own[own >= 0], minlength=FEATURES)
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["label", "feature", "n"])
        release()

    bound_batches(labelled.sparkSession)
    counts = rows.select("label", "text").mapInArrow(count, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table = np.zeros((len(languages), FEATURES + 1), np.float32)
    for k, language in enumerate(languages):
        own = counts[counts["label"] == language]
        n = np.full(FEATURES, 0.5)
        n[own["feature"].to_numpy()] += own["n"].to_numpy()
        table[k, :FEATURES] = np.log(n / n.sum())
    return TextModel(languages, table)


def identify(df: DataFrame, model: TextModel, text: Callable[[DataFrame], Column], host: Column, suffix: Column, declared: Column) -> DataFrame:
    """df with language, posterior and accepted. host, suffix and declared: columns of df."""
    n = len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(column):
            ll, letters = m.scores(column)
            return [pa.array(list(ll), pa.list_(pa.float64())), pa.array(letters, pa.int64())]

        return work

    drop = ("__ll", "__letters", "__host", "__suffix", "__declared", "__hidden")
    prepared = df.withColumns({"__host": F.coalesce(host, F.lit("")), "__suffix": F.coalesce(suffix, F.lit("")), "__declared": F.coalesce(declared, F.lit("")), "__hidden": text(df)})
    scored = add_columns(prepared, "__hidden", [("__ll", ArrayType(DoubleType())), ("__letters", LongType())], make)
    if not n:
        return scored.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "accepted": F.lit(False)}).drop(*drop)
    ll = [F.col("__ll")[k] * TEMPER for k in range(n)]
    top = F.greatest(*ll) if n > 1 else ll[0]
    weights = [F.exp(x - top) for x in ll]
    some = sum(weights[1:], weights[0])
    by_text = scored.where("__letters > 0").select("__host", "__suffix", "__declared", *[(w / some).alias(f"p{k}") for k, w in enumerate(weights)])
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(n)]
    counts = keep(by_text.groupBy("__host", "__suffix", "__declared").agg(*sums))

    def shares(level: DataFrame, above: list[Column], keys: list[str]) -> DataFrame:
        total = sum((F.col(f"p{k}") for k in range(1, n)), F.col("p0"))
        return level.select(*keys, *[((F.col(f"p{k}") + SMOOTHING * above[k]) / (total + SMOOTHING)).alias(f"q{k}") for k in range(n)])

    whole = counts.agg(*sums).first()
    mass = sum(v or 0.0 for v in whole)
    overall = [((v or 0.0) + 1) / (mass + n) for v in whole]
    suffixes = shares(counts.groupBy("__suffix").agg(*sums), [F.lit(x) for x in overall], ["__suffix"])
    suffixes = suffixes.withColumnsRenamed({f"q{k}": f"s{k}" for k in range(n)})
    by_host = counts.groupBy("__host", "__suffix").agg(*sums).join(suffixes, "__suffix")
    hosts = keep(shares(by_host, [F.col(f"s{k}") for k in range(n)], ["__host", "__suffix"]))
    said = counts.groupBy("__declared").agg(*sums)
    # P(declaration | language), with one row more for each pair
    trust = keep(said.select("__declared", *[((F.col(f"p{k}") + 1) / (F.lit(whole[k] or 0.0) + 100)).alias(f"d{k}") for k in range(n)]))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_HOSTS else t
    joined = scored.join(small(hosts), ["__host", "__suffix"], "left").join(small(trust), "__declared", "left")
    unseen = 0.01
    logs = [ll[k] + F.log(F.coalesce(F.col(f"q{k}"), F.lit(overall[k]))) + F.log(F.coalesce(F.col(f"d{k}"), F.lit(unseen))) for k in range(n)]
    joined = joined.withColumn("__logs", F.array(*logs))
    best = F.array_max("__logs")
    posterior = 1 / F.aggregate("__logs", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    names = F.array(*[F.lit(x) for x in model.languages])
    known = F.col("__letters") > 0
    out = joined.withColumns({"__best": F.array_position("__logs", best).cast("int"), "posterior": F.when(known, posterior).otherwise(F.lit(0.0))})
    out = out.withColumns({"language": F.when(known, F.element_at(names, F.col("__best"))), "accepted": known & (F.col("posterior") >= LEAST_POSTERIOR)})
    hidden = [*drop, "__logs", "__best", *[f"{a}{k}" for a in "qd" for k in range(n)]]
    return out.drop(*hidden)


def of_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """Documents: the source is the host, the lang column the declaration; sources have no address suffix unless they hold a dot."""
    suffix = F.when(F.contains("source", F.lit(".")), F.substring_index("source", ".", -1))
    return identify(docs, model, lambda df: df["text"], F.col("source"), suffix, F.lower("lang"))


def of_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Web pages: text without markup, host and suffix of the url, the language that <html> declares."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    said = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang=[\"']?([a-z]{2,3})", 1))
    return identify(pages, model, lambda df: bare, host, F.substring_index(host, ".", -1), said)


def op5(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", "source")
    return of_documents(rows, fit(rows)).select("doc_id", "language", F.round("posterior", 4).alias("posterior"), "accepted")


def op5_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    found = of_pages(pages.select("page_id", "url", "html"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("page_id", "language", F.round("posterior", 4).alias("posterior"), "accepted")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected."""
    return keep_where(docs, lambda df: of_documents(df, fit(df)), ["language", "posterior", "accepted"], F.col("accepted"))

"""Document fingerprints by consistent weighted sampling.

A text's terms are its shingles of five words, weighted by how often each is there. For each of
SAMPLES samples, gamma-based values are drawn for each weighted term and the term with the least
value is the sample; two texts agree in a sample with a probability equal to the generalised
Jaccard similarity of their weighted terms. A fingerprint has 16 bits of each sample, in hex, and
the likeness of two fingerprints is the part of samples that agree.

with_neighbours() compares each document with the next by descending id. The table is
range-partitioned by id once, in partitions of about PARTITION_BYTES, and streamed in that order; the last
row of each partition is joined with the first of the next one afterwards.

Cases: null is the empty text; all empty texts have one fingerprint; a text without words has one
term, the text itself; a text of fewer than five words has one shingle; equal texts have equal
fingerprints whatever their rows; rows of one id follow each other by text; an empty table gives an
empty result; a single row is its own next; long texts are taken whole, one by one; other columns are
ignored here and kept by fingerprints(), which replaces one of its result's name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessel.sources.shared import keep

from .arrow import add_columns, bound_batches, release, slices
from .words import blocks, consistent_samples, shingles, term_counts

SAMPLES = 64
#: Bytes of text in a range of ids.
PARTITION_BYTES = 16 << 20


def signatures(column: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """uint16 of shape (texts, samples)."""
    out = []
    for _, _, texts in blocks(column):
        h, n, offsets = term_counts(*shingles(texts))
        s = consistent_samples(h, np.log(n.astype(np.float32)), offsets, samples)
        for i in np.flatnonzero((np.diff(offsets) == 0) & (np.diff(texts.offsets) > 0)):
            whole = hashlib.blake2b(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes(), digest_size=8).digest()
            s[i] = consistent_samples(np.frombuffer(whole, np.uint64), None, np.array([0, 1]), samples)[0]
        bits = s.view(np.uint32)
        out.append(((bits * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16))
    return np.concatenate(out) if out else np.empty((0, samples), np.uint16)


def fingerprints(df: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """df with a column fingerprint."""
    return add_columns(df, text_col, [("fingerprint", StringType())], lambda: lambda column: [[x.tobytes().hex() for x in signatures(column, samples)]])


def likeness(a: str, b: str) -> float:
    """Part of the samples of two fingerprints that agree."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the first code points of the next text, as many or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, place long, text string"


def _compare(ids: list, texts: list[str]) -> dict[str, list]:
    """Columns for all but the last row, each with the row after it."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, other = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(new, pa.large_string()))
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [x.tobytes().hex() for x in own[:-1]],
        "edited_fingerprint": [x.tobytes().hex() for x in other],
        "near_edited": (own[:-1] == other).mean(axis=1).tolist(),
        "near_next": (own[:-1] == own[1:]).mean(axis=1).tolist(),
    }


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares neighbours within a partition; the first and the last row also come out with their texts."""
    part, last, place = TaskContext.get().partitionId(), None, 0
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("place", pa.int64()), ("text", pa.large_string())])
    ends = lambda rows: pa.RecordBatch.from_pylist([{"doc_id": i, "part": part, "place": p, "text": t} for i, t, p in rows], schema).cast(pa.schema([*list(schema)[:-1], ("text", pa.string())]))
    for batch in batches:
        for some in slices(batch, 1, 1 << 20):
            ids, texts = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
            if last is None:
                yield ends([(ids[0], texts[0], 0)])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            place += some.num_rows
            if len(ids) > 1:
                made = _compare(ids, texts)
                n = len(ids) - 1
                columns = [pa.array(v, schema.field(k).type) for k, v in made.items()]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=schema.names)
    if last is not None:
        yield ends([(last[0], last[1], place)])
    release()


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of all (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bound_batches(docs.sparkSession)
    parts = max(1, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PARTITION_BYTES))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    ordered = docs.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    rows = keep(ordered.mapInArrow(_in_order, _SCHEMA))
    results = rows.columns[:7]
    # each partition has a first and a last row; which partitions follow each other is told without texts
    ends = rows.where(F.col("part").isNotNull())
    line = F.row_number().over(Window.orderBy("part"))
    lines = ends.where("place = 0").select("part").withColumn("line", line)
    n = lines.count()
    firsts = ends.where("place = 0").select("part", F.col("text").alias("after")).join(lines.select("part", ((F.col("line") + n - 2) % n + 1).alias("line")), "part").drop("part")
    lasts = ends.where("place > 0").select("part", "doc_id", "text").join(lines, "part")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made = _compare([i, i], [text, following])
                yield pa.RecordBatch.from_pydict({k: pa.array(v) if k != "doc_id" else pa.array(v, pa.int64()) for k, v in made.items()})

    joined = lasts.join(firsts, "line").select("doc_id", "text", "after").mapInArrow(across, _SCHEMA.split(", part")[0])
    return rows.where(F.col("part").isNull()).select(*results).unionByName(joined)


def op3(docs: DataFrame) -> DataFrame:
    return with_neighbours(docs.select("doc_id", "text"))

"""Removal of text that an earlier document has, by sorted suffixes.

A byte goes if a string of LENGTH bytes around it also starts in a document of a smaller id. To know that, the
suffixes of all documents are sorted in buckets, one after the other, as far as they can meet at all:

* each window of LENGTH bytes is filed under the least hash of its strings of SAMPLE bytes, so equal windows meet
  in one bucket, and consecutive windows mostly share one: they travel as one piece of text;
* pieces whose hash only one document has are left where they are;
* of the others each bucket's suffixes are sorted. A bucket's text first gets ranks for a sample of its suffixes, those at the places of a
  difference cover: whatever two places are compared, at the same distance of less than PERIOD bytes both have a ranked suffix.
  The suffixes are then sorted one block at a time by their first bytes; what is still tied after PERIOD bytes is settled by these ranks,
  so a block needs no more than its own places and long ties are no slower than short ones;
* neighbours in this order that share LENGTH bytes form a group; its least document keeps the text.

Equal texts are found first by digest, as all but the one of the smallest id lose everything. Documents are written once, in chunks, to a table
bucketed by chunk, so what is found comes back to the texts without moving them. A piece that many documents of a chunk have travels
once, with the least and the largest id; the pieces of a chunk for one bucket are one row. Hashes of which all chunks together may have more than
MOST_PIECES pieces, as of a phrase that stands everywhere, are not brought to one task but compared window by window, by grouping.

Cases: null texts are empty; a null id comes after all others, so null ids take nothing from each other; rows of one id take nothing from
each other, whatever their texts; repeated rows are treated alike; texts of fewer than LENGTH bytes keep all; matches never cross documents; long texts are
worked through in segments; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.sources.shared import keep, shared_folder

from .arrow import bound_batches, release, slices
from .words import _M1, _M2, _ODD, as_bytes, lanes, mix

LENGTH, SAMPLE = 50, 20
#: A difference cover: every distance modulo PERIOD is one of two of its places. Fixed values.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of text of a chunk, of a range of hashes and of a bucket of pieces; windows that are hashed or sorted at once, and of a piece.
CHUNK_BYTES, RANGE_BYTES, BUCKET_BYTES, SEGMENT, BLOCK, MOST_WINDOWS = 4 << 20, 64 << 20, 4 << 20, 1 << 16, 1 << 18, 4096
#: Pieces of one hash that one task sorts.
MOST_PIECES = 20_000
#: Suffixes of one tie that are put in order side by side with those of other ties.
SMALL = 64
LAST = 2**63 - 1


# ---- the order of suffixes -------------------------------------------------------------------------


def _shifts() -> np.ndarray:
    """For two residues the distance at which both reach the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    return np.array([[next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


SHIFT = _shifts()


def _order(data: np.ndarray, places: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """places by the first 8 * n_lanes bytes from each, and where these differ from those of the place before."""
    every = lanes(data)
    keys = [every[np.minimum(places + 8 * i, len(data))].byteswap() for i in range(n_lanes)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(places), bool)
    if len(places):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return places[order], new


def cover_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at the places of the cover by LENGTH bytes or more, equal where these are; 0 elsewhere and past the end."""
    base = np.arange(0, len(data), PERIOD)
    places = (base[:, None] + np.array(COVER)).ravel()
    places, new = _order(data, places[places < len(data)], -(-LENGTH // 8))
    ranks = np.zeros(len(data) + PERIOD, np.int32)
    ranks[places] = np.cumsum(new)
    return ranks


def sort_block(data: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The suffixes at places in order: by their first bytes, ties by the cover's ranks."""
    places, new = _order(data, places, -(-PERIOD // 8))
    tied = ~new
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(places)))
    after = lambda p, q: ranks[p + SHIFT[p % PERIOD, q % PERIOD]] > ranks[q + SHIFT[p % PERIOD, q % PERIOD]]
    # small groups of ties: neighbours change places until all are in order; large ones one by one
    pairs = np.flatnonzero(tied[1:] & np.repeat(sizes <= SMALL, sizes)[1:])
    turns, quiet = (pairs[pairs % 2 == 0], pairs[pairs % 2 == 1]), 0
    for turn in range(SMALL + 1):
        left = turns[turn % 2]
        swap = left[after(places[left], places[left + 1])]
        places[swap], places[swap + 1] = places[swap + 1], places[swap]
        quiet = 0 if len(swap) else quiet + 1
        if quiet == 2:
            break
    compare = cmp_to_key(lambda p, q: int(ranks[p + SHIFT[p % PERIOD, q % PERIOD]]) - int(ranks[q + SHIFT[p % PERIOD, q % PERIOD]]))
    for i in np.flatnonzero(sizes > SMALL).tolist():
        a, b = start[i], start[i] + sizes[i]
        places[a:b] = sorted(places[a:b].tolist(), key=compare)
    return places


def same(data: np.ndarray, p: np.ndarray, q: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the strings of this many bytes, eight or more, from p and from q on are equal."""
    every, out = lanes(data), np.ones(len(p), bool)
    for i in [*range(0, length - 7, 8), length - 8]:
        out &= every[p + i] == every[q + i]
    return out


def least_of_windows(pieces: list[bytes], docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, the least document with the window at each), block by block, in the joint text of pieces."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(x) for x in pieces], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    windows = np.arange(len(data)) + LENGTH <= ends[owner]
    ranks = cover_ranks(data)
    # blocks are ranges of the first two bytes, so each holds its suffixes whole
    head = data.astype(np.int32) << 8
    head[:-1] |= data[1:]
    counts = np.bincount(head[windows], minlength=1 << 16)
    block = np.cumsum(counts) // BLOCK
    of = block[head]
    for b in np.unique(block[counts > 0]).tolist():
        places = sort_block(data, ranks, np.flatnonzero(windows & (of == b)))
        new = np.ones(len(places), bool)
        new[1:] = ~same(data, places[1:], places[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[owner[places]], first)
        yield places, np.repeat(least, np.diff(np.append(first, len(places))))


# ---- pieces of texts -------------------------------------------------------------------------------


class Chunk:
    """The texts of a chunk as one run of bytes, and the pieces of consecutive windows of the same least hash."""

    def __init__(self, column: pa.Array, usable: np.ndarray):
        self.data, self.offsets = as_bytes(column)
        self.usable = usable & (np.diff(self.offsets) >= LENGTH)
        parts = list(self._pieces())
        names = ("starts", "sizes", "hashes", "docs")
        self.starts, self.sizes, self.hashes, self.docs = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64 if n == "hashes" else np.int64) for i, n in enumerate(names))

    def _pieces(self) -> Iterator[tuple[np.ndarray, ...]]:
        """starts, windows, hashes and documents of pieces, segment by segment."""
        span = LENGTH - SAMPLE + 1
        usable = np.flatnonzero(self.usable)
        low, high = self.offsets[usable], self.offsets[usable + 1] - LENGTH + 1  # the windows of each text
        # the rest of SAMPLE bytes after the first eight: two lanes that may overlap
        second, third = 8, SAMPLE - 8
        for a in range(0, len(self.data) - LENGTH + 1, SEGMENT):
            b = min(a + SEGMENT, len(self.data) - LENGTH + 1)
            valid = np.zeros(b - a, bool)
            for i in range(np.searchsorted(high, a, "right"), np.searchsorted(low, b, "left")):
                valid[max(low[i] - a, 0) : max(high[i] - a, 0)] = True
            if not valid.any():
                continue
            n = b - a + span - 1
            every = lanes(self.data[a : b + LENGTH - 1])[: n + third].copy()
            h = every[:n] * _ODD
            h += every[second : n + second] * _M1
            h += every[third : n + third] * _M2
            h ^= h >> np.uint64(32)
            h *= _ODD
            width = 1
            while width * 2 <= span:
                h = np.minimum(h[:-width], h[width:])
                width *= 2
            h = np.minimum(h[: b - a], h[span - width : span - width + b - a])
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (h[1:] != h[:-1])  # between the windows of two texts there are others
            first = np.flatnonzero(new)
            run = np.add.reduceat(valid.astype(np.int64), first)
            # a piece ends where its windows do; long ones are cut
            cuts = -(-run // MOST_WINDOWS)
            k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start, size = np.repeat(first, cuts) + k * MOST_WINDOWS, np.minimum(np.repeat(run, cuts) - k * MOST_WINDOWS, MOST_WINDOWS)
            yield start + a, size, mix(np.repeat(h[first], cuts)), np.searchsorted(self.offsets, start + a, "right") - 1

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes in order, which of them more than one text has, and their pieces."""
        order = np.argsort(self.hashes)
        h, d = self.hashes[order], self.docs[order]
        if not len(h):
            return h, np.empty(0, bool), np.empty(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.append(first, len(h)))

    def contents(self, hits: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
        """Distinct contents of the pieces with these hashes and their hashes; of each such piece its index and its content's number."""
        some = np.flatnonzero(np.isin(self.hashes, hits))
        seen: dict[bytes, int] = {}
        number = np.empty(len(some), np.int64)
        hashes = []
        raw = self.data.tobytes()
        for i, (a, n, h) in enumerate(zip(self.starts[some].tolist(), self.sizes[some].tolist(), self.hashes[some].tolist(), strict=True)):
            x = raw[a : a + n + LENGTH - 1]
            if (k := seen.setdefault(x, len(seen))) == len(hashes):
                hashes.append(h)
            number[i] = k
        return list(seen), hashes, some, number


# ---- tables ----------------------------------------------------------------------------------------


def _write_chunks(docs: DataFrame, buckets: int) -> str:
    """The name of a table chunk, place, id, text that is bucketed by chunk, in the shared folder."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, place = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for some in slices(batch, 1, 1 << 20):
                chunk = pa.array(np.full(some.num_rows, (part << 32) + n), pa.int64())
                yield pa.RecordBatch.from_arrays([chunk, pa.array(np.arange(place, place + some.num_rows), pa.int64()), *some.columns], names=["chunk", "place", "id", "text"])
                place, size = place + some.num_rows, size + some.column(1).nbytes
                if size >= CHUNK_BYTES:
                    n, size, place = n + 1, 0, 0

    bound_batches(spark)
    name, path = f"chunks_{uuid.uuid4().hex}", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(run, "chunk long, place long, id long, text string").write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    return name


def _copies(chunks: DataFrame) -> DataFrame:
    """chunk, place of the texts that another row of a smaller id has whole; only digests move."""
    keys = keep(chunks.select("chunk", "place", "id", F.sha2("text", 256).alias("digest")))
    shared = keys.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    return keys.join(shared, "digest").where("id > least").select("chunk", "place")


INFO = "chunk long, kind int, at long, packed binary"
COPY, HIT, RUN = 0, 1, 2


def _with_info(chunks: DataFrame, info: DataFrame, work: Callable[[Chunk, np.ndarray, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work on each chunk with what was found for it; the texts stay where they are."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        usable = np.ones(rows.num_rows, bool)
        usable[found.filter(pc.equal(found["kind"], COPY))["at"].to_numpy()] = False
        made = work(Chunk(rows["text"], usable), usable, rows, found)
        release()
        return made

    return chunks.groupBy("chunk").cogroup(info.groupBy("chunk")).applyInArrow(run, schema)


def _table(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.Table:
    return pa.table({n: pa.array(v, t) for n, (v, t) in columns.items()})


def _packed(values: np.ndarray, marks: np.ndarray) -> bytes:
    """Five bytes of each value, then a byte for each mark."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + marks.astype(np.uint8).tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :5] = np.frombuffer(packed, np.uint8, 5 * n).reshape(-1, 5)
    return raw.view("<u8").ravel(), np.frombuffer(packed, np.uint8, n, 5 * n)


def _in_ranges(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash the range that it is met in and the 40 bits it is known by there."""
    return (h >> np.uint64(40)) % np.uint64(ranges), h & np.uint64((1 << 40) - 1)


def _cuts(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    return zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(of)).tolist(), strict=True) if len(first) else iter(())


def _hits(chunks: DataFrame, copies: DataFrame, ranges: int) -> DataFrame:
    """Rows of INFO: of each chunk the hashes that another document has as well, marked where all chunks together may have more than MOST_PIECES of their pieces.

    A hash is met as a range and 40 bits, which may only add some.
    """

    def emit(chunk: Chunk, _usable, rows: pa.Table, _found) -> pa.Table:
        h, many, n = chunk.keys()
        of, low = _in_ranges(h, ranges)
        order = np.argsort(of, kind="stable")
        marks = ((np.ceil(np.log2(n[order] + 1)).astype(np.int64) << 1) | many[order]).astype(np.uint8)
        sent = [(r, _packed(low[order][a:b], marks[a:b])) for r, a, b in _cuts(of[order])]
        return _table({"chunk": ([rows["chunk"][0].as_py() for _ in sent], pa.int64()), "range": ([r for r, _ in sent], pa.int64()), "packed": ([p for _, p in sent], pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(p) for p in rows["packed"].to_pylist()]
        low, marks = np.concatenate([v for v, _ in parts]), np.concatenate([m for _, m in parts])
        order = np.argsort(low, kind="stable")
        key, marks = low[order], marks[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        more = (n > 1) | np.bitwise_or.reduceat(marks & 1, first).astype(bool)
        hot = np.add.reduceat(1 << (marks >> 1).astype(np.int64), first) > MOST_PIECES
        hit, mark = np.empty(len(low), bool), np.empty(len(low), np.uint8)
        hit[order], mark[order] = np.repeat(more, n), np.repeat(hot, n)
        out, at = [], 0
        for chunk, (v, _) in zip(rows["chunk"].to_pylist(), parts, strict=True):
            some, m = hit[at : at + len(v)], mark[at : at + len(v)]
            at += len(v)
            if some.any():
                out.append((chunk, _packed(v[some], m[some]), int(m[some].sum())))
        release()
        n_out = len(out)
        return _table({"chunk": ([c for c, _, _ in out], pa.int64()), "kind": ([HIT] * n_out, pa.int32()), "at": ([rows["range"][0].as_py()] * n_out, pa.int64()), "packed": ([p for _, p, _ in out], pa.binary()), "hot": ([x for _, _, x in out], pa.int64())})

    sent = _with_info(chunks, copies, emit, "chunk long, range long, packed binary")
    return sent.groupBy("range").applyInArrow(meet, f"{INFO}, hot long")


def _hit_hashes(chunk: Chunk, found: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's hashes that are among the found ones, and whether they are marked."""
    own = np.unique(chunk.hashes)
    some = found.filter(pc.equal(found["kind"], HIT))
    key = lambda of, low: (of.astype(np.uint64) << np.uint64(40)) | low
    there, marks = [], []
    for r, p in zip(some["at"].to_pylist(), some["packed"].to_pylist(), strict=True):
        v, m = _unpacked(p)
        there.append(key(np.full(len(v), r, np.uint64), v))
        marks.append(m)
    if not there:
        return own[:0], np.empty(0, bool)
    there, marks = np.concatenate(there), np.concatenate(marks)
    order = np.argsort(there)
    there, marks = there[order], marks[order]
    mine = key(*_in_ranges(own, ranges))
    at = np.minimum(np.searchsorted(there, mine), len(there) - 1)
    hit = there[at] == mine
    return own[hit], marks[at[hit]].astype(bool)


class Found:
    """The distinct pieces of a chunk that may meet others: contents by number, with the least and the largest id of their documents."""

    def __init__(self, chunk: Chunk, rows: pa.Table, found: pa.Table, ranges: int):
        hits, hot = _hit_hashes(chunk, found, ranges)
        self.contents, hashes, self.pieces, self.numbers = chunk.contents(hits)
        self.hashes = np.array(hashes, np.uint64)
        self.hot = hot[np.searchsorted(hits, self.hashes)] if len(hits) else np.empty(0, bool)
        ids = rows["id"].to_numpy()[chunk.docs[self.pieces]]
        self.least, self.most = np.full(len(self.contents), LAST), np.full(len(self.contents), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.numbers, ids)
        np.maximum.at(self.most, self.numbers, ids)


def _runs(contents: list[bytes], hashes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rows (piece, first window, windows, least document), by piece, where a window has a smaller document than the largest of its piece.

    Equal windows have equal hashes, so a piece alone with its hash meets none but its own copies; the others are sorted.
    """
    _, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
    alone = n[of] == 1 if len(of) else np.empty(0, bool)
    sizes = np.array([len(x) for x in contents], np.int64)
    whole = np.flatnonzero(alone & (least < most))
    rows = [np.stack([whole, np.zeros_like(whole), sizes[whole] - LENGTH + 1, least[whole]], axis=1)]
    rest = np.flatnonzero(~alone)
    some = sizes[rest]
    found = np.full(int(some.sum()), LAST)
    for places, docs in least_of_windows([contents[i] for i in rest.tolist()], least[rest]):
        found[places] = docs
    owner = np.repeat(np.arange(len(rest)), some)
    place = np.arange(len(found)) - np.repeat(np.cumsum(some) - some, some)
    valid = (place + LENGTH <= some[owner]) & (found < most[rest][owner])
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    if len(first):
        rows.append(np.stack([rest[owner[first]], place[first], np.add.reduceat(valid.astype(np.int64), first), found[first]], axis=1))
    out = np.concatenate(rows)
    return out[np.argsort(out[:, 0], kind="stable")]


def _cold(chunks: DataFrame, info: DataFrame, ranges: int, buckets: int) -> DataFrame:
    """Rows of INFO: of each chunk the runs of windows (piece, first, windows, least document) that sorting the buckets' suffixes shows."""
    fields = ("numbers", "sizes", "least", "most", "hashes")

    def emit(chunk: Chunk, _usable, rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Found(chunk, rows, found, ranges)
        some = np.flatnonzero(~own.hot)
        bucket = (own.hashes[some] % np.uint64(buckets)).astype(np.int64)
        some = some[np.argsort(bucket, kind="stable")]
        bucket.sort()
        out = []
        for of, a, b in _cuts(bucket):
            texts = [own.contents[i] for i in some[a:b].tolist()]
            numbers = np.stack([some[a:b], [len(x) for x in texts], own.least[some[a:b]], own.most[some[a:b]], own.hashes[some[a:b]].view(np.int64)])
            out.append((of, numbers.astype("<i8").tobytes(), b"".join(texts)))
        return _table({"chunk": ([rows["chunk"][0].as_py() for _ in out], pa.int64()), "bucket": ([o[0] for o in out], pa.int64()), "numbers": ([o[1] for o in out], pa.binary()), "contents": ([o[2] for o in out], pa.binary())})

    def sort(rows: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        held = []  # the pieces of each chunk: number, distinct content, largest id
        low, high, hashes = [], [], []
        for numbers, contents in zip(rows["numbers"].to_pylist(), rows["contents"].to_pylist(), strict=True):
            of = dict(zip(fields, np.frombuffer(numbers, "<i8").reshape(5, -1), strict=True))
            ends = np.cumsum(of["sizes"]).tolist()
            ks = []
            for a, b, x, y, h in zip([0, *ends], ends, of["least"].tolist(), of["most"].tolist(), of["hashes"].tolist(), strict=False):
                text = contents[a:b]
                k = seen.setdefault(text, len(seen))
                if k == len(low):
                    low.append(x)
                    high.append(y)
                    hashes.append(h)
                else:
                    low[k], high[k] = min(low[k], x), max(high[k], y)
                ks.append(k)
            held.append((of["numbers"], np.array(ks, np.int64), of["most"]))
        runs = _runs(list(seen), np.array(hashes, np.int64), np.array(low, np.int64), np.array(high, np.int64))
        chunks_, packed = [], []
        for chunk, (number, k, most) in zip(rows["chunk"].to_pylist(), held, strict=True):
            a, b = np.searchsorted(runs[:, 0], k, "left"), np.searchsorted(runs[:, 0], k, "right")
            n = b - a
            piece = np.repeat(np.arange(len(k)), n)
            mine = runs[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)].copy()
            mine[:, 0] = number[piece]
            mine = mine[mine[:, 3] < most[piece]]
            if len(mine):
                chunks_.append(chunk)
                packed.append(mine.astype("<i8").tobytes())
        release()
        return _table({"chunk": (chunks_, pa.int64()), "kind": ([RUN] * len(packed), pa.int32()), "at": ([None] * len(packed), pa.int64()), "packed": (packed, pa.binary())})

    sent = _with_info(chunks, info, emit, "chunk long, bucket long, numbers binary, contents binary")
    return sent.groupBy("bucket").applyInArrow(sort, INFO)


def _hot(chunks: DataFrame, info: DataFrame, ranges: int) -> DataFrame:
    """The same of pieces whose hash has too many for one task, as of a phrase that stands everywhere: window by window, by partial minima."""

    def emit(chunk: Chunk, _usable, rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Found(chunk, rows, found, ranges)
        some = np.flatnonzero(own.hot)
        return _table({"chunk": ([rows["chunk"][0].as_py()] * len(some) if len(some) else [], pa.int64()), "number": (some, pa.int64()), "content": ([own.contents[i] for i in some.tolist()], pa.binary()), "least": (own.least[some], pa.int64()), "most": (own.most[some], pa.int64())})

    pieces = keep(_with_info(chunks, info, emit, "chunk long, number long, content binary, least long, most long"))
    place = F.explode(F.sequence(F.lit(1), F.octet_length("content") - LENGTH + 1))
    windows = pieces.select("chunk", "number", "least", "most", "content", place.alias("place")).withColumn("window", F.substring(F.col("content"), F.col("place"), F.lit(LENGTH))).drop("content")
    least = windows.groupBy("window").agg(F.min("least").alias("__least"))
    met = windows.join(least, "window").where(F.col("__least") < F.col("most")).select("chunk", "number", (F.col("place") - 1).cast("long").alias("first"), F.lit(1).cast("long").alias("n"), "__least")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            order = np.argsort(values[:, 0], kind="stable")
            values = values[order]
            out = [(c, values[a:b, 1:].astype("<i8").tobytes()) for c, a, b in _cuts(values[:, 0])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([RUN] * len(out), pa.int32()), pa.array([None] * len(out), pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["chunk", "kind", "at", "packed"])

    return met.mapInArrow(pack, INFO)


def _removed(chunk: Chunk, usable: np.ndarray, rows: pa.Table, found: pa.Table, ranges: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    edges = np.zeros(len(chunk.data) + 1, np.int64)
    gone = np.flatnonzero(~usable & (np.diff(chunk.offsets) >= LENGTH))
    edges[chunk.offsets[gone]] += 1
    np.subtract.at(edges, chunk.offsets[gone + 1], 1)
    own = Found(chunk, rows, found, ranges)
    packed = found.filter(pc.equal(found["kind"], RUN))["packed"].to_pylist()
    runs = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 4)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    low, high = np.searchsorted(runs[:, 0], own.numbers, "left"), np.searchsorted(runs[:, 0], own.numbers, "right")
    n = high - low
    piece = np.repeat(own.pieces, n)
    run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    later = runs[run, 3] < rows["id"].to_numpy()[chunk.docs[piece]]
    piece, run = piece[later], run[later]
    begin = chunk.starts[piece] + runs[run, 1]
    np.add.at(edges, begin, 1)
    np.subtract.at(edges, begin + runs[run, 2] - 1 + LENGTH, 1)
    return np.cumsum(edges[:-1]) > 0


def _over_chunks(docs: DataFrame, run: Callable[..., pa.Table], schema: str) -> DataFrame:
    """run(chunk, rows, the bytes of the chunk that go) on all chunks of (doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    name = _write_chunks(docs, min(most, max(1, -(-size // (2 * CHUNK_BYTES)))))
    chunks = spark.table(name)
    nothing = F.lit(None)
    copies = keep(_copies(chunks).select("chunk", F.lit(COPY).alias("kind"), F.col("place").alias("at"), nothing.cast("binary").alias("packed")))
    hits = keep(_hits(chunks, copies, ranges))
    info = copies.unionByName(hits.drop("hot"))
    n_hits, hot = hits.agg(F.sum(F.octet_length("packed") / 6), F.sum("hot")).first()
    buckets = max(1, -(-int(n_hits or 0) * 2 * LENGTH // BUCKET_BYTES))
    runs = keep(_cold(chunks, info, ranges, buckets))
    runs = runs.unionByName(keep(_hot(chunks, info, ranges))) if hot else runs
    info = info.unionByName(runs)
    out = keep(_with_info(chunks, info, lambda chunk, usable, rows, found: run(chunk, rows, _removed(chunk, usable, rows, found, ranges)), schema))
    spark.sql(f"drop table {name}")
    return out


def _columns(chunk: Chunk, rows: pa.Table, gone: np.ndarray) -> dict[str, pa.Array]:
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    first = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    starts[first] = gone[first]  # runs don't cross documents
    count = lambda mask: pa.array(np.diff(np.concatenate([[0], np.cumsum(mask)])[chunk.offsets]), pa.int64())
    ids = rows["id"].to_numpy()
    return {"doc_id": pa.array(ids, pa.int64(), mask=ids == LAST), "n_bytes": pa.array(np.diff(chunk.offsets), pa.int64()), "n_removed": count(gone), "n_spans": count(starts)}


def _kept(chunk: Chunk, gone: np.ndarray) -> Iterator[bytes]:
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
        yield chunk.data[a:b][~gone[a:b]].tobytes()


COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long"


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay, of all (doc_id, text)."""
    run = lambda chunk, rows, gone: pa.table(_columns(chunk, rows, gone) | {"kept": pa.array(list(_kept(chunk, gone)), pa.binary())})
    return _over_chunks(docs.select("doc_id", "text"), run, f"{COLUMNS}, kept binary")


def op11(docs: DataFrame) -> DataFrame:
    run = lambda chunk, rows, gone: pa.table(_columns(chunk, rows, gone) | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _kept(chunk, gone)], pa.string())})
    return _over_chunks(docs.select("doc_id", "text"), run, f"{COLUMNS}, kept_sha256 string")

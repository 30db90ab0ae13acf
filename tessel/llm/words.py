"""Vectorised words, shingles and consistent weighted samples over Arrow string columns.

A batch of texts is one byte buffer with an offset for each text, so splitting and hashing
are array operations over many texts at once. Batches are cut into blocks of about
``BLOCK_BYTES``, whatever the number of rows, so memory does not follow the batch size; only a
single text larger than that makes a larger block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SHINGLE = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of words, and the lower case of each byte (A-Z only)."""
    b = np.arange(256)
    lower = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    inside = ((b >= 48) & (b <= 57)) | ((lower >= 97) & (lower <= 122)) | (b >= 128)
    return inside, lower


IS_WORD, LOWER = _word_bytes()
#: Runs of more bytes are hashed one by one.
LONG_RUN = 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; zeros follow data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _lane(all_lanes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Lane k of runs that have more than 8 * k bytes, without the bytes after each run."""
    left = np.minimum(lengths - 8 * k, 8).astype(np.uint64)
    return all_lanes[starts + 8 * k] & (_ALL >> (np.uint64(64) - np.uint64(8) * left))


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, none of them empty.

    A run is taken in lanes of eight bytes; each lane goes through a mixer that isn't linear, so unlike with
    a polynomial no texts made of two alternating halves meet. Long runs take a digest.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    every = lanes(data)
    h = mix(_lane(every, starts, lengths, 0) ^ (lengths.astype(np.uint64) * _ODD))
    some = np.flatnonzero((lengths > 8) & (lengths <= LONG_RUN))
    k = 1
    while len(some):
        h[some] = mix(h[some] * _ODD ^ _lane(every, starts[some], lengths[some], k))
        k += 1
        some = some[lengths[some] > 8 * k]
    for i in np.flatnonzero(lengths > LONG_RUN).tolist():
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


def same_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the runs of these lengths from a and from b on have the same bytes."""
    same = np.ones(len(a), bool)
    every = lanes(data)
    some = np.flatnonzero((a != b) & (lengths <= LONG_RUN))
    k = 0
    while len(some):
        same[some] &= _lane(every, a[some], lengths[some], k) == _lane(every, b[some], lengths[some], k)
        k += 1
        some = some[lengths[some] > 8 * k]
    for i in np.flatnonzero((a != b) & (lengths > LONG_RUN)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + lengths[i]], data[b[i] : b[i] + lengths[i]])
    return same


class Texts:
    """A block of texts: bytes, the offset of each text, and from them words and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = IS_WORD[data]
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        cuts = offsets[offsets < n]
        start_of = before[:-1].copy()
        start_of[cuts] = False
        self.starts = np.flatnonzero(inside & ~start_of)
        after = np.empty(n, bool)
        if n:
            after[:-1], after[-1] = inside[1:], False
            inner = cuts[cuts > 0]
            after[inner - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.word_offsets = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word in lower case (A-Z only)."""
        return run_hashes(LOWER[self.data], self.starts, self.ends - self.starts)

    def word(self, i: int) -> bytes:
        """The bytes of word i, in lower case."""
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than one chunk is left if it is large
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts): runs of rows of about size bytes."""
    if not len(column):
        return
    data, offsets = as_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, rows)
        yield first, last, Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words and the offset of each text's first.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    h, bounds = texts.hashes(), texts.word_offsets
    counts = np.diff(bounds)
    n = len(h)
    total = np.zeros(n + size, np.uint64)
    for j in range(size):
        turned = h * (_ODD + np.uint64(2 * j * 0x632BE5AB)) + np.uint64(j + 1)
        total[: max(0, n - j)] += turned[j:]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for d in short:
        a, b = bounds[d], bounds[d + 1]
        with np.errstate(over="ignore"):
            total[a] = sum((h[a + j] * (_ODD + np.uint64(2 * j * 0x632BE5AB)) + np.uint64(j + 1) for j in range(b - a)), np.uint64(0))
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(offsets[-1]) + np.repeat(bounds[:-1] - offsets[:-1], per_text)
    return mix(total[at]), offsets


def term_counts(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text in order, how often each is there, and the offset of each text's first."""
    h = h.copy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    if not len(h):
        return h, np.empty(0, np.int64), offsets
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(at, offsets)


def seeds(samples: int, seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, samples + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


def consistent_samples(h: np.ndarray, log_weight: np.ndarray | None, offsets: np.ndarray, samples: int, seed: int = 1) -> np.ndarray:
    """Improved consistent weighted sampling: float32 of shape (texts, samples).

    For each term and sample, r and c are drawn from Gamma(2, 1) and beta from [0, 1) by the
    term's hash. With t = floor(log(weight) / r + beta) the term's value is
    log(c) - r * (t - beta + 1); the least value of a text is its sample. Two texts have the same
    least value just when the same term and t win, which happens with a probability equal to
    their weighted Jaccard similarity. log_weight None: all weights are 1. A text without terms
    gets infinity.
    """
    counts = np.diff(offsets)
    out = np.full((len(counts), samples), np.inf, np.float32)
    keys = seeds(samples, seed)
    full = np.flatnonzero(counts)
    step = 1 << 15
    i = 0
    while i < len(full):
        first = offsets[full[i]]
        j = max(i + 1, int(np.searchsorted(offsets[full], first + step)))
        some = full[i:j]
        end = offsets[some[-1] + 1]
        part, at = h[first:end], (offsets[some] - first)
        logs = None if log_weight is None else log_weight[first:end].astype(np.float32)
        for k in range(samples):
            out[some, k] = np.minimum.reduceat(_values(part, logs, keys[k]), at)
        i = j
    return out


def _values(h: np.ndarray, logs: np.ndarray | None, key: np.uint64) -> np.ndarray:
    x = h ^ key
    x *= _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    lanes = x.view(np.uint16).reshape(-1, 4)
    scale = np.float32(1 / 65536)
    half = np.float32(0.5)
    u = [(lanes[:, n].astype(np.float32) + half) * scale for n in range(4)]
    r = -np.log(u[0] * u[1])
    log_c = np.log(-np.log(u[2] * u[3]))
    x *= _ODD
    beta = (x >> np.uint64(48)).astype(np.uint16).astype(np.float32) * scale
    if logs is None:  # then t is 0
        return log_c - r * (1 - beta)
    t = np.floor(logs / r + beta)
    return log_c - r * (t - beta + 1)

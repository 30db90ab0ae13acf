"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words, counted over the whole corpus, are compiled with their ids into a minimal acyclic
automaton whose states share suffixes. The number of words before each edge, summed along a path,
is the word's index in the table of ids, so outputs don't hinder the sharing. The automaton and
the tables are one array, sent to each executor as a file and memory-mapped by its workers. Words
that are not in it are merged exactly. All steps are array operations over the words of a block.

The result is that of byte-level BPE as a tokenizer file of this kind defines it: added tokens are
found first, the rest is split into words by the usual pattern (contractions, letters, numbers,
others, white space), and each word's bytes are merged by rank.

Cases: null and empty texts have no ids; repeated rows give a row each; an empty table gives an
empty result; very long words take the merge with a heap, so no text is quadratic; columns of the
input that have the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from .arrow import add_columns, bound_batches, release
from .words import BLOCK_BYTES, as_bytes, mix, run_hashes, same_runs

#: The lexicon has this many of the most frequent words; a word counts where it is seen so often in a block at least.
LEXICON, IN_BLOCK = 60_000, 3
#: Words of more bytes take the merge with a heap.
LONG = 48
LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
_EDGE = 0x110000


# ---- the vocabulary -------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        model = spec["model"]
        as_raw = lambda t: bytes(letters[c] for c in t)
        self.bytes = {i: as_raw(t) for t, i in model["vocab"].items()}
        self.added = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
        self.bytes.update({i: raw for raw, i in self.added})
        self.of_byte = np.array([model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((model["vocab"][a], model["vocab"][b]), (r, model["vocab"][a + b]))
        n = max(self.bytes) + 1
        parts = [self.bytes.get(i, b"") for i in range(n)]
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        digits = [str(i).encode() + b"," for i in range(n)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_at = np.concatenate([[0], np.cumsum([len(d) for d in digits])])
        # pairs in an open table: a slot has the pair, its rank and the merged id
        size = 1 << 18
        self.pair_mask = np.uint64(size - 1)
        self.pair_key, self.pair_rank, self.pair_id = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        slots = self._slot(keys).tolist()
        self.probes = 1
        for key, slot, (r, i) in zip(keys.tolist(), slots, self.rank.values(), strict=True):
            k = 0
            while self.pair_key[slot] != -1:
                slot, k = (slot + 1) & (size - 1), k + 1
            self.pair_key[slot], self.pair_rank[slot], self.pair_id[slot] = key, r, i
            self.probes = max(self.probes, k + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & self.pair_mask).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and merged id of pairs."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        hit = self.pair_key[slot] == keys
        rank, made = np.where(hit, self.pair_rank[slot], NONE), np.where(hit, self.pair_id[slot], 0)
        rest = np.flatnonzero(~hit & (self.pair_key[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & (len(self.pair_key) - 1)
            found = self.pair_key[slot[rest]]
            hit = found == keys[rest]
            at = rest[hit]
            rank[at], made[at] = self.pair_rank[slot[at]], self.pair_id[slot[at]]
            rest = rest[~hit & (found != -1)]
        return rank, made

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word, merged with a heap: near linear in its length."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.rank.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (all in one array) and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # words, their ids as rows padded by -1
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, LONG)):
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(some):
                parts.append((some, self._merge_rows(data, starts[some], lengths[some], high)))
        for i in np.flatnonzero(lengths > LONG):
            ids = self.merge_long(data[starts[i] : starts[i] + lengths[i]].tobytes())
            parts.append((np.array([i]), np.array([ids], np.int32)))
        for some, ids in parts:
            counts[some] = (ids >= 0).sum(axis=1)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for some, ids in parts:
            out[np.repeat(at[some], counts[some]) + within(counts[some])] = ids[ids >= 0]
        return out, counts

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        place = np.arange(width)
        inside = place < lengths[:, None]
        ids = np.where(inside, self.of_byte[data[np.where(inside, starts[:, None] + place, 0)]], -1).astype(np.int32)
        rank = np.full(ids.shape, NONE, np.int32)
        made = np.zeros(ids.shape, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c], made[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
        out, rows = ids.copy(), np.arange(len(ids))
        while True:
            best = rank.argmin(axis=1)
            left = rank[np.arange(len(rank)), best] < NONE
            if not left.all():
                out[rows[~left]] = ids[~left]
                rows, ids, rank, made, best = rows[left], ids[left], rank[left], made[left], best[left]
            if not len(rows):
                return out
            every = np.arange(len(rows))
            ids[every, best] = made[every, best]
            moved = place[None, :-1] + (place[None, :-1] > best[:, None])
            ids[:, :-1] = np.take_along_axis(ids, moved, 1)
            rank[:, :-1] = np.take_along_axis(rank, moved, 1)
            made[:, :-1] = np.take_along_axis(made, moved, 1)
            ids[:, -1], rank[:, -1] = -1, NONE
            for at in (best - 1, best):
                here = np.flatnonzero((at >= 0) & (at < width - 1))
                a = at[here]
                right = ids[here, a + 1]
                rk, md = self.lookup(ids[here, a], np.maximum(right, 0))
                rank[here, a], made[here, a] = np.where(right < 0, NONE, rk), md


NONE = np.int32(2**31 - 1)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


# ---- words of a text ------------------------------------------------------------------------

_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    if not _classes:
        table = np.full(_EDGE + 1, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, _EDGE)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[0x1C:0x20] = OTHER
        table[_EDGE] = EDGE
        _classes.append(table)
    return _classes[0]


def split_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the first byte of each word and after its last. cuts: ascending offsets that no word crosses, 0 and the end too."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character starts
    where = np.searchsorted(at, cuts[1:])  # an edge stands before this character
    n_chars = len(chars)
    chars = np.insert(chars, where, _EDGE)
    at = np.insert(at, where, np.where(where < n_chars, at[np.minimum(where, n_chars - 1)] if n_chars else 0, len(data)))
    kind = char_classes()[chars]
    n = len(chars)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # white space before a word: its last character begins a word, with the word that follows if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    blank = chars[last] == 32
    start[last[blank] + 1] = False
    # contractions
    quote = np.flatnonzero((chars == 39) & start)
    if len(quote):
        padded = np.append(chars, [_EDGE, _EDGE])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for found, k in ((quote[one], 1), (quote[two], 2)):
            start[found + 1] = False
            after = found + 1 + k
            after = after[after < n]
            start[after] = True
    start[kind == EDGE] = True
    first = np.flatnonzero(start)
    end = np.append(first[1:], n)
    words = kind[first] != EDGE
    first, end = first[words], end[words]
    return at[first], np.append(at, len(data))[end]


# ---- the lexicon ----------------------------------------------------------------------------


def _minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], set[int]]:
    """Edges of each state and the final states, for sorted distinct words; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    final: set[int] = set()
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, child) not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            key = (child in final, tuple(edges[child].items()))
            twin = known.setdefault(key, child)
            if twin != child:
                edges[parent][byte] = twin

    before = b""
    for word in words:
        k = len(os.path.commonprefix([before, word]))
        share(k)
        state = path[-1][2] if path else 0
        for byte in word[k:]:
            edges.append({})
            child = len(edges) - 1
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        final.add(state)
        before = word
    share(0)
    return edges, final


class Lexicon:
    """A memory-mapped automaton: word to index to ids."""

    def __init__(self, array: np.ndarray):
        sizes = array[:6].tolist()
        parts = np.split(array[6 : 6 + sum(sizes)], np.cumsum(sizes)[:-1])
        #: base of each state; check, target and words before of each slot; where ids begin; ids
        self.base, self.check, self.target, self.before, self.ids_at, self.ids = parts

    @staticmethod
    def compile(outputs: dict[bytes, list[int]]) -> np.ndarray:
        words = sorted(w for w in outputs if w)
        edges, final = _minimal_automaton(words)
        # states that stayed, children before parents
        order, seen, stack = [], set(), [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                order.append(s)
            elif s not in seen:
                seen.add(s)
                stack.append((s, True))
                stack.extend((t, False) for t in edges[s].values() if t not in seen)
        n_words: dict[int, int] = {}
        for s in order:
            n_words[s] = (s in final) + sum(n_words[t] for t in edges[s].values())
        number = {s: i for i, s in enumerate(reversed(order))}  # the start is 0
        # place each state's edges where they fit between those of others
        size = 1024
        used, free, ahead, base = bytearray(size), 256, 256, np.zeros(len(order), np.int32)
        slots: dict[int, tuple[int, int, int]] = {}
        for s in sorted(order, key=lambda s: -len(edges[s])):
            out = sorted(edges[s].items())
            if not out:
                continue
            low = out[0][0]
            at = free if len(out) == 1 else ahead  # single edges fill the gaps
            while True:
                if at + 512 > size:
                    used.extend(bytearray(size))
                    size *= 2
                if not used[at] and all(not used[at - low + b] for b, _ in out):
                    break
                at += 1
            ahead = max(ahead, at - 64)
            base[number[s]] = at - low
            skipped = int(s in final)
            for b, t in out:
                used[at - low + b] = 1
                slots[at - low + b] = (number[s], number[t], skipped)
                skipped += n_words[t]
            while free < size and used[free]:
                free += 1
        top = max(slots, default=0) + 257
        check, target, before = np.full(top, -1, np.int32), np.zeros(top, np.int32), np.zeros(top, np.int32)
        for at, (s, t, k) in slots.items():
            check[at], target[at], before[at] = s, t, k
        # the sign of a target tells whether a word may end there
        ends = np.zeros(len(order), bool)
        ends[[number[s] for s in final if s in number]] = True
        target = np.where(ends[target] & (check >= 0), -target - 1, target).astype(np.int32)
        ids = [i for w in words for i in outputs[w]]
        ids_at = np.concatenate([[0], np.cumsum([len(outputs[w]) for w in words])]).astype(np.int32)
        parts = [base, check, target, before, ids_at, np.array(ids, np.int32)]
        return np.concatenate([np.array([len(p) for p in parts], np.int32), *parts])

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Index of each word, or -1."""
        out = np.full(len(starts), -1, np.int64)
        state = np.zeros(len(starts), np.int64)
        index = np.zeros(len(starts), np.int64)
        who, step, top = np.arange(len(starts)), 0, len(self.check)
        while len(who):
            slot = self.base[state] + data[starts[who] + step]
            ok = (slot < top) & (self.check[np.minimum(slot, top - 1)] == state)
            who, slot = who[ok], slot[ok]
            index = index[ok] + self.before[slot]
            state = self.target[slot].astype(np.int64)
            ends = state < 0
            state = np.where(ends, -state - 1, state)
            step += 1
            over = lengths[who] == step
            hit = over & ends
            out[who[hit]] = index[hit]
            who, state, index = who[~over], state[~over], index[~over]
        return out


# ---- encoding and decoding ------------------------------------------------------------------


class Codec:
    """Encodes and decodes blocks of texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the offset of each text's first."""
        added = self._added(data, offsets)
        cuts = offsets
        if added:
            cuts = np.unique(np.concatenate([offsets, *[[a, b] for a, b, _ in added]]))
        starts, ends = split_words(data, np.unique(cuts)) if len(data) else (np.empty(0, np.int64),) * 2
        if added:
            a = np.array([x[0] for x in added])
            b = np.array([x[1] for x in added])
            k = np.searchsorted(a, starts, "right") - 1
            plain = (k < 0) | (starts >= b[np.maximum(k, 0)])
            starts, ends = starts[plain], ends[plain]
        lengths = ends - starts
        index = self.lexicon.find(data, starts, lengths)
        known, new = index >= 0, np.flatnonzero(index < 0)
        n_known = len(self.lexicon.ids)
        at, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[known] = self.lexicon.ids_at[index[known]]
        counts[known] = self.lexicon.ids_at[index[known] + 1] - at[known]
        rest = np.empty(0, np.int32)
        if len(new):
            one, of = self._distinct(data, starts[new], lengths[new])
            rest, n = self.vocabulary.merge(data, starts[new][one], lengths[new][one])
            at[new], counts[new] = (np.cumsum(n) - n)[of] + n_known, n[of]
        source = np.concatenate([self.lexicon.ids, rest])
        if added:
            starts = np.concatenate([starts, a])
            at = np.concatenate([at, np.arange(len(added)) + len(source)])
            counts = np.concatenate([counts, np.ones(len(added), np.int64)])
            source = np.concatenate([source, np.array([x[2] for x in added], np.int32)])
            order = np.argsort(starts, kind="stable")
            starts, at, counts = starts[order], at[order], counts[order]
        ids = source[np.repeat(at, counts) + within(counts)]
        first = np.concatenate([[0], np.cumsum(counts)])
        return ids, first[np.searchsorted(starts, offsets)]

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and id of added tokens inside texts, from the left."""
        found, raw = [], data.tobytes()
        for token, i in self.vocabulary.added:
            at = raw.find(token)
            while at >= 0:
                end = at + len(token)
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):
                    found.append((at, end, i))
                    at = raw.find(token, end)
                else:
                    at = raw.find(token, at + 1)
        found.sort(key=lambda x: (x[0], -x[1]))
        out: list[tuple[int, int, int]] = []
        for x in found:
            if not out or x[0] >= out[-1][1]:
                out.append(x)
        return out

    @staticmethod
    def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words to stand for equal ones, and which one stands for each. Words of one hash are compared by their bytes; those that differ stand for themselves."""
        h = run_hashes(data, starts, lengths)
        _, one, of = np.unique(h, return_index=True, return_inverse=True)
        first = one[of]
        odd = lengths != lengths[first]
        odd[~odd] = ~same_runs(data, starts[~odd], starts[first[~odd]], lengths[~odd])
        odd = np.flatnonzero(odd)
        of[odd] = len(one) + np.arange(len(odd))
        return np.concatenate([one, odd]), of

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocabulary
        n = v.raw_at[ids + 1] - v.raw_at[ids]
        return v.raw[np.repeat(v.raw_at[ids], n) + within(n)].tobytes().decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        v = self.vocabulary
        n = v.digits_at[ids + 1] - v.digits_at[ids]
        return v.digits[np.repeat(v.digits_at[ids], n) + within(n)].tobytes()[:-1]


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = as_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = min(rows, max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def frequent_words(docs: DataFrame, text_col: str = "text", number: int = LEXICON) -> list[bytes]:
    """The most frequent words of the whole corpus. A block gives the words that it has IN_BLOCK times at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets in _blocks(batch.column(0)):
                if not len(data):
                    continue
                starts, ends = split_words(data, np.unique(offsets))
                lengths = ends - starts
                short = lengths <= LONG
                starts, lengths = starts[short], lengths[short]
                _, one, n = np.unique(run_hashes(data, starts, lengths), return_index=True, return_counts=True)
                often = np.flatnonzero(n >= IN_BLOCK)
                words = [data[starts[i] : starts[i] + lengths[i]].tobytes() for i in one[often]]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n[often], pa.int64())], names=["word", "n"])
        release()

    bound_batches(docs.sparkSession)
    counted = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counted.orderBy(F.col("n").desc(), "word").limit(number).collect()]


def compile_lexicon(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    return Lexicon.compile({w: vocabulary.merge_long(w) for w in words})


_open: dict[str, Codec] = {}


def codec_for(docs: DataFrame, vocabulary_path: str, text_col: str = "text"):
    """A function that gives each task the codec, after counting the corpus and sending the lexicon to the executors."""
    spark = docs.sparkSession
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    np.save(path, compile_lexicon(frequent_words(docs, text_col), Vocabulary(vocabulary_path)))
    spark.sparkContext.addFile(path)

    def codec() -> Codec:
        if name not in _open:
            _open.clear()
            _open[name] = Codec(Vocabulary(vocabulary_path), Lexicon(np.load(SparkFiles.get(name), mmap_mode="r")))
        return _open[name]

    return codec


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids, decoded back as decoded."""
    codec = codec_for(docs, vocabulary_path, text_col)

    def make():
        c = codec()

        def work(column):
            ids, texts = [], []
            for data, offsets in _blocks(column):
                flat, at = c.encode(data, offsets)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    ids.append(flat[a:b])
                    texts.append(c.decode(flat[a:b]))
            return [pa.array(ids, pa.list_(pa.int32())), texts]

        return work

    return add_columns(docs, text_col, [("token_ids", ArrayType(IntegerType())), ("decoded", StringType())], make)


def encode_digests(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; ids and texts stay in the tasks."""
    codec = codec_for(docs, vocabulary_path, text_col)

    def make():
        c = codec()

        def work(column):
            n, ids, texts = [], [], []
            for data, offsets in _blocks(column):
                flat, at = c.encode(data, offsets)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    n.append(int(b - a))
                    ids.append(hashlib.sha256(c.listed(flat[a:b])).hexdigest())
                    texts.append(hashlib.sha256(c.decode(flat[a:b]).encode()).hexdigest())
            return [n, ids, texts]

        return work

    return add_columns(docs, text_col, [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())], make)


def op4(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    return encode_digests(docs.select("doc_id", "text"), vocabulary_path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

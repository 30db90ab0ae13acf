"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies. Texts are dealt into chunks by id. Each chunk packs its distinct
   shingles, by hash range, into binary rows; each hash range adds up how many documents have each
   shingle and answers each chunk with those that more than one document has. So a shingle moves as
   four bytes, and a shingle of a third of all documents as one entry a chunk.
2. Signatures. A chunk meets its answers, weights each text's shingles by tf * idf and takes
   SAMPLES consistent weighted samples.
3. Equal texts, told by their md5, become one node.
4. Bands of ROWS samples give buckets. In a small bucket all pairs are candidates. In a larger one
   each node is paired with a pivot; what that leaves with more than one label is joined exactly, by
   the rarest shingles of each text (a prefix filter), in salted blocks, for all pairs of different labels.
5. Candidates whose samples agree often enough are verified by the exact weighted Jaccard similarity; pairs of
   one node are dealt in salted groups, so that a node of many copies is not one task.
6. Links become labels by alternating large and small stars. The class id is the least document id of a label.

Idf counts for IDF_SHARE of a weight. In a group of n near copies the common shingles have a
document frequency of n and the edited ones of 1, so a full idf would take large groups of copies
below any threshold: with a third of all documents in a group, a plain similarity of 0.95 would be 0.66.

Cases: null is the empty text; empty texts are copies of each other, as are equal texts without
words; a text of fewer than five words has one shingle; repeated rows are rows of one class; a null
id is an id before all others; an empty table gives an empty result; other columns are kept by
deduplicated() and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessel.sources.shared import keep

from .arrow import bound_batches, release
from .words import blocks, consistent_samples, shingles, term_counts

SIMILARITY = 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
IDF_SHARE = 0.1
#: Buckets of so many nodes at most give all their pairs; nodes of larger ones meet so many pivots, and what that leaves apart is joined exactly.
SMALL, STARS = 10, 2
#: Samples that a pair agrees in at least if its texts are compared.
LEAST = 22
#: Nodes of one rare term in one block of the exact join, on average.
BLOCK = 1024
#: Pairs of one node in one group at most.
GROUP = 128
#: Bytes of text in a chunk, and in a hash range of shingles.
CHUNK, RANGE = 8 << 20, 8 << 20
#: Edges that one task contracts at most.
PART_EDGES = 1 << 18
#: Ids that are broadcast at most; more take a shuffled join.
BROADCAST_IDS = 2_000_000
NO_ID = -(1 << 63)
_LOW = np.uint64(0xFFFFFFFF)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, _, texts in blocks(column):
        yield first, *term_counts(*shingles(texts))


def code_of(df: np.ndarray) -> np.ndarray:
    """Document frequencies in eighths of a power of two."""
    return np.minimum(np.round(8 * np.log2(df)), 255).astype(np.uint8)


def log_weights(codes: np.ndarray, tf: np.ndarray, documents: int) -> np.ndarray:
    df = 2.0 ** (np.arange(256) / 8)
    idf = np.log1p(documents / df) / np.log1p(max(1, documents))
    table = np.log(1 - IDF_SHARE + IDF_SHARE * idf)
    return (table[codes] + np.log(tf)).astype(np.float32)


# ---- 1 and 2: frequencies and signatures ------------------------------------------------------


def _ask(ranges: int):
    def ask(keys: tuple, table: pa.Table) -> pa.Table:
        h = np.concatenate([np.empty(0, np.uint64), *[h for _, h, _, _ in _terms(table["text"])]])
        h.sort()
        h, n = np.unique(h, return_counts=True)
        part = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, low, n = part[order], (h[order] & _LOW).astype(np.uint32), n[order].astype(np.uint32)
        one, at = np.unique(part, return_index=True)
        rows = []
        for p, a, b in zip(one.tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
            single = n[a:b] == 1
            rows.append((p, keys[0].as_py(), low[a:b][single].tobytes(), low[a:b][~single].tobytes(), n[a:b][~single].tobytes()))
        release()
        return pa.Table.from_pylist([dict(zip(_ASKED.names, r, strict=True)) for r in rows], _ASKED)

    return ask


_ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("single", pa.binary()), ("more", pa.binary()), ("n", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("shingle", pa.binary()), ("code", pa.binary())])


def _answer(keys: tuple, table: pa.Table) -> pa.Table:
    chunks = table["chunk"].to_numpy()
    all_keys, counts, owner = [], [], []
    for i, (single, more, n) in enumerate(zip(*[table[c].to_pylist() for c in ("single", "more", "n")], strict=True)):
        a, b = np.frombuffer(single, np.uint32), np.frombuffer(more, np.uint32)
        all_keys += [a, b]
        counts += [np.ones(len(a), np.int64), np.frombuffer(n, np.uint32).astype(np.int64)]
        owner.append(np.full(len(a) + len(b), i, np.int32))
    key, count, owner = np.concatenate(all_keys), np.concatenate(counts), np.concatenate(owner)
    order = np.argsort(key, kind="stable")
    key, count, owner = key[order], count[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(count, at) if len(key) else count
    total = np.repeat(total, np.diff(np.append(at, len(key))))
    shared = np.flatnonzero(total > 1)
    shared = shared[np.argsort(owner[shared], kind="stable")]
    codes = code_of(total[shared])
    bounds = np.searchsorted(owner[shared], np.arange(len(chunks) + 1))
    rows = [{"chunk": c, "part": keys[0].as_py(), "shingle": key[shared[a:b]].tobytes(), "code": codes[a:b].tobytes()} for c, a, b in zip(chunks.tolist(), bounds[:-1], bounds[1:], strict=True) if b > a]
    return pa.Table.from_pylist(rows, _ANSWER)


_SIGNED = "k long, digest binary, n_terms int, sig array<int>, codes binary"


def _sign(documents: int, ranges: int):
    schema = pa.schema([("k", pa.int64()), ("digest", pa.binary()), ("n_terms", pa.int32()), ("sig", pa.list_(pa.int32())), ("codes", pa.binary())])

    def sign(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        known = [np.frombuffer(s, np.uint32).astype(np.uint64) | (np.uint64(p) << np.uint64(32)) for p, s in zip(answers["part"].to_pylist(), answers["shingle"].to_pylist(), strict=True)]
        codes = [np.frombuffer(c, np.uint8) for c in answers["code"].to_pylist()]
        known, codes = np.concatenate([np.empty(0, np.uint64), *known]), np.concatenate([np.empty(0, np.uint8), *codes])
        order = np.argsort(known)
        known, codes = known[order], codes[order]
        n_terms, sigs, packed = [], [], []
        for _, h, tf, offsets in _terms(docs["text"]):
            code = np.zeros(len(h), np.uint8)
            if len(known):
                key = ((h >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32) | (h & _LOW)
                at = np.searchsorted(known, key)
                at[at == len(known)] = 0
                code = np.where(known[at] == key, codes[at], 0).astype(np.uint8)
            s = consistent_samples(h, log_weights(code, tf, documents), offsets, SAMPLES).view(np.int32)
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                n_terms.append(int(b - a))
                sigs.append(s[i])
                packed.append(zlib.compress(code[a:b].tobytes(), 1))
        release()
        digests = [hashlib.md5(t.encode()).digest() for t in docs["text"].to_pylist()]
        return pa.table([docs["k"].combine_chunks(), pa.array(digests, pa.binary()), pa.array(n_terms, pa.int32()), pa.array(sigs, pa.list_(pa.int32())), pa.array(packed, pa.binary())], schema=schema)

    return sign


def signatures(texts: DataFrame, documents: int, size: int) -> DataFrame:
    """k, md5, number of shingles, samples and packed frequencies of (k, text)."""
    chunks, ranges = max(1, math.ceil(size / CHUNK)), max(1, math.ceil(size / RANGE))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("int"))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(ranges), "part int, chunk int, single binary, more binary, n binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "chunk int, part int, shingle binary, code binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_sign(documents, ranges), _SIGNED)


# ---- 4 and 5: candidates and their verification -----------------------------------------------


def _key() -> Column:
    """The bucket of a band: its number and samples."""
    return F.xxhash64("band", *[F.element_at("sig", F.col("band") * ROWS + i + 1) for i in range(ROWS)])


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, band, n, sig of the members of all buckets with two nodes or more."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    members = nodes.where("n_terms > 0").select("node", "sig", bands).select("node", "band", _key().alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return keep(members.join(sizes, "bucket").join(nodes.select("node", "sig"), "node"))


def _agreement(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def _candidates(in_bucket: DataFrame) -> DataFrame:
    """Pairs (a, b, salt) that are worth a comparison of their texts.

    All pairs of small buckets; in large ones each node with the bucket's pivot, a node that is in
    many large buckets and so is near the middle of its group. Another pivot leads each band, and a node takes the
    STARS pivots that its samples agree with best. Pairs that agree in less than LEAST samples go: one of similarity 0.8
    does that with a probability under 10**-5.
    """
    small = in_bucket.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "sig"))).alias("nodes"))
    left = small.select("nodes", F.posexplode("nodes").alias("i", "x"))
    every = left.select("x", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("y"))
    every = every.where(_agreement(F.col("x.sig"), F.col("y.sig")) >= LEAST).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(1).alias("salts"))
    large = in_bucket.where(F.col("n") > SMALL)
    reach = large.groupBy("node").agg(F.count("*").alias("reach"))
    first = F.min(F.struct((-F.col("reach")).alias("r"), F.xxhash64("node", "band").alias("h"), "node", "sig"))
    pivots = large.join(reach, "node").groupBy("bucket").agg(first.alias("p")).select("bucket", F.col("p.node").alias("a"), F.col("p.sig").alias("to"))
    agree = _agreement(F.col("sig"), F.col("to"))
    stars = large.join(pivots, "bucket").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"), agree.alias("agree"), F.ceil(F.col("n") / GROUP).cast("int").alias("salts"))
    stars = stars.where(F.col("agree") >= LEAST).groupBy("a", "b").agg(F.max("agree").alias("agree"), F.max("salts").alias("salts"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
    stars = stars.withColumn("place", best).where(F.col("place") <= STARS).select("a", "b", "salts")
    pairs = every.unionByName(stars).groupBy("a", "b").agg(F.max("salts").alias("salts"))
    return keep(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")))


def _vectors(texts: list[str], codes: list[bytes], documents: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    packed = [np.frombuffer(zlib.decompress(c), np.uint8) for c in codes]
    row = 0
    for _, h, tf, offsets in _terms(pa.array(texts, pa.large_string())):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            out.append((h[a:b], np.exp(log_weights(packed[row], tf[a:b], documents), dtype=np.float64)))
            row += 1
    return out


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two vectors of sorted distinct hashes and weights."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    low = np.minimum(x[1][i], y[1][j]).sum()
    high = x[1].sum() + y[1].sum() - low
    return float(low / high) if high else 0.0


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, documents: int, repeats: bool) -> DataFrame:
    """a, b, similarity of candidate pairs (a, b, salt). texts: k, text, digest; repeats: whether rows of it may be equal."""
    heads = pairs.select("a", "salt").distinct().withColumn("node", F.col("a"))
    need = keep(pairs.select("a", "salt", F.col("b").alias("node")).unionByName(heads).join(nodes.select("node", "k", "codes"), "node"))
    ids = need.select("k").distinct()
    wanted = texts.join(F.broadcast(ids) if need.count() <= BROADCAST_IDS else ids, "k", "left_semi").withColumnRenamed("digest", "node")
    if repeats:
        wanted = wanted.dropDuplicates(["k", "node"])
    rows = need.join(wanted, ["k", "node"]).select("a", "salt", "node", "codes", "text")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def compare(keys: tuple, table: pa.Table) -> pa.Table:
        names = table["node"].to_pylist()
        head = names.index(keys[0].as_py())
        of = _vectors(table["text"].to_pylist(), table["codes"].to_pylist(), documents)
        rest = [i for i in range(len(names)) if i != head]
        return pa.table([pa.array([names[head]] * len(rest), pa.binary()), pa.array([names[i] for i in rest], pa.binary()), pa.array([weighted_jaccard(of[head], of[i]) for i in rest], pa.float64())], schema=schema)

    return rows.groupBy("a", "salt").applyInArrow(compare, "a binary, b binary, similarity double")


def linked_nodes(nodes: DataFrame, texts: DataFrame, documents: int, similarity: float = SIMILARITY, repeats: bool = True) -> DataFrame:
    """node, label of the nodes that have a link of at least this similarity: the least node that links connect it with.

    A large bucket whose nodes all have one label is done. The nodes of the others are joined exactly.
    """
    in_bucket = _buckets(nodes)
    link = F.col("similarity") >= similarity
    labels = _relabel(None, _verify(_candidates(in_bucket), nodes, texts, documents, repeats).where(link).select("a", "b"))
    large = in_bucket.where(F.col("n") > SMALL).select("bucket", "node")
    named = keep(large.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    open_nodes = keep(named.join(mixed, "bucket", "left_semi").select("node", "label").distinct())
    if open_nodes.isEmpty():
        return labels
    pairs = _prefix_pairs(open_nodes, nodes, texts, documents, similarity, repeats)
    return _relabel(labels, _verify(pairs, nodes, texts, documents, repeats).where(link).select("a", "b"))


def _prefix_pairs(some: DataFrame, nodes: DataFrame, texts: DataFrame, documents: int, similarity: float, repeats: bool) -> DataFrame:
    """a, b, salt of all pairs of some (node, label) of different labels that can be similar: none that is similar is left out.

    Terms are in one order for all texts, rare ones first. Two similar texts have a term in common
    before either has used up more than 1 - similarity of its weight; what is left from the first
    such term on bounds their overlap. A pair whose samples agree too seldom goes here too. Terms of one document only are counted but not joined.
    """
    need = keep(some.join(nodes.select("node", "k", "codes"), "node"))
    wanted = texts.join(need.select("k").distinct(), "k", "left_semi").withColumnRenamed("digest", "node")
    if repeats:
        wanted = wanted.dropDuplicates(["k", "node"])
    rows = need.join(wanted, ["k", "node"]).select("node", "label", "codes", "text")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            packed = [np.frombuffer(zlib.decompress(c), np.uint8) for c in batch.column(2).to_pylist()]
            for first, h, tf, offsets in _terms(column):
                row, token, total, before = [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    code = packed[first + i]
                    weight = np.exp(log_weights(code, tf[a:b], documents), dtype=np.float64)
                    order = np.lexsort((h[a:b], code))
                    used = np.cumsum(weight[order]) - weight[order]
                    own = (used <= (1 - similarity + 1e-6) * weight.sum()) & (code[order] > 0)
                    row.append(np.full(own.sum(), first + i))
                    token.append(h[a:b][order][own])
                    total.append(np.full(own.sum(), weight.sum()))
                    before.append(used[own])
                row = pa.array(np.concatenate(row))
                columns = [pa.array(np.concatenate(token).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(total)), pa.array(np.concatenate(before))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "label", "w", "used"])

    entries = keep(rows.mapInArrow(prefixes, "token long, node binary, label binary, w double, used double"))
    sizes = entries.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    shared = entries.join(sizes.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "token")
    shared = keep(shared.join(nodes.select("node", "sig"), "node"))
    own = ("node", "label", "w", "used", "sig")
    x = shared.select("token", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"x_{c}") for c in own])
    y = shared.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"y_{c}") for c in own])
    overlap = F.least(F.col("x_w") - F.col("x_used"), F.col("y_w") - F.col("y_used"))
    needed = (F.col("x_w") + F.col("y_w")) * (similarity / (1 + similarity) - 1e-6)
    able = (x["token"] == y["token"]) & (x["part"] == y["part"]) & (F.col("x_node") < F.col("y_node")) & (F.col("x_label") != F.col("y_label")) & (overlap >= needed) & (_agreement(F.col("x_sig"), F.col("y_sig")) >= LEAST)
    pairs = keep(x.join(y, able).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct())
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    return keep(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")))


# ---- 6: classes -------------------------------------------------------------------------------


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """u, v: each node of edges (u, v) but the least of its component within a part, with that least one."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        schema = pa.schema([("u", kind), ("v", kind)])
        moved = [(x, root) for x in parent if (root := find(x)) != x]
        for i in range(0, len(moved), 1 << 15):
            some = moved[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], kind), pa.array([r for _, r in some], kind)], schema=schema)

    kind = to_arrow_type(edges.schema["u"].dataType)
    return (edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(contract, edges.schema)


def components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """node, label for all nodes of edges (a, b): the least node of its component.

    Parts of at most part_edges edges are contracted to stars; stars of several parts are joined by
    alternating large and small stars until nothing changes.
    """
    state = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = max(1, math.ceil(state.count() / part_edges))
    state, mark = keep(_contracted(state, parts)), None
    while parts > 1:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    labels = state.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b): only links between different labels are worked on."""
    if labels is None:
        return components(links)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    named = keep(named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct())
    if named.isEmpty():
        return labels
    joined = components(named)
    old = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return keep(old.unionByName(joined.join(labels, "node", "left_anti").select("node", "label")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """k (the id), digest (md5 of the text), label (the least digest) and class_id (the least id) of each row's class."""
    bound_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    total = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    signed = keep(signatures(texts, total[0], total[1] or 0))
    first = F.min(F.struct("k", "n_terms", "codes", "sig"))
    nodes = keep(signed.groupBy("digest").agg(first.alias("x")).select(F.col("digest").alias("node"), "x.*"))
    with_digest = texts.withColumn("digest", F.unhex(F.md5("text")))
    repeats = not signed.groupBy("k", "digest").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    labels = linked_nodes(nodes, with_digest, total[0], similarity, repeats)
    least = labels.join(nodes.select("node", "k"), "node").groupBy("label").agg(F.min("k").alias("class_id"))
    linked = labels.join(least, "label").select("node", "label", "class_id")
    by_node = nodes.select("node", "k").join(linked, "node", "left").select(F.col("node").alias("digest"), F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "k").alias("class_id"))
    return signed.select("k", "digest").join(by_node, "digest")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of each document; a document that is alone has its own id."""
    found = classes(docs.select("doc_id", "text"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(back("k").alias("doc_id"), back("class_id").alias("class_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, that of the least id; rows of one id and text are one."""
    found = keep(classes(docs, id_col, text_col))
    own = F.col("k") == F.col("class_id")
    drop = keep(found.where(~own).select("k", "digest").distinct())
    # rows of a class that have its id: more than one if rows repeat, or if texts of one id are alike
    again = keep(found.where(own).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    keyed = docs.withColumns({"__k": key, "__digest": F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))})
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_IDS else t
    left = keyed.join(small(drop.withColumnsRenamed({"k": "__k", "digest": "__digest"})), ["__k", "__digest"], "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    # rows of one id are one class here, or several with texts that are not alike
    of = found.where(own).join(again, "k", "left_semi").select(F.col("k").alias("__k"), F.col("digest").alias("__digest"), F.col("label").alias("__class")).distinct()
    place = F.row_number().over(Window.partitionBy("__k", "__class").orderBy("__digest"))
    many = left.join(of, ["__k", "__digest"]).withColumn("__place", place).where("__place = 1")
    ids = again.select(F.col("k").alias("__k"))
    return left.join(small(ids), "__k", "left_anti").select(*docs.columns).unionByName(many.select(*docs.columns))

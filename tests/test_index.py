import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import blocks, index, search
from tessel.sources.tables import Tables

KIND = "chunk_id long, tenant_id int, embedding array<float>"


def hits(df):
    return {tuple(r) for r in df.select("query_id", "chunk_id").collect()}


def asked(vectors):
    return vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", F.col("embedding").alias("query"))


def brute(queries, rows, k):
    out = []
    for q, tenant, x in queries:
        scored = []
        for i, t, y in rows:
            if t == tenant and t is not None:
                s = None
                if x is not None and y is not None and any(x) and any(y):
                    s = sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
                scored.append((s is None, -round(s, 9) if s is not None else 0, i))
        out += [(q, r, i, None if null else -s + 0.0) for r, (null, s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("size", "broadcast"), [(2048, 64 << 20), (3, 64 << 20), (3, 0)])
def test_blocks_equal_plain_python(spark, monkeypatch, size, broadcast):
    """Nulls, zeros, ties, equal vectors, repeated rows; blocks that are small, and queries that are not broadcast."""
    monkeypatch.setattr(blocks, "VECTORS", size)
    monkeypatch.setattr(blocks, "QUERIES", size)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", broadcast)
    pick = np.random.default_rng(5)
    value = lambda: [None, [0.0, 0.0, 0.0], [1.0, 1.0, 0.0], pick.integers(-2, 3, 3).astype(float).tolist()][pick.integers(0, 4)]
    rows = [(int(pick.integers(0, 60)), [1, 2, None][pick.integers(0, 3)], value()) for _ in range(80)]
    queries = [(f"q{i}", int(pick.integers(1, 4)), value()) for i in range(25)]
    df = search.batch_search(spark.createDataFrame(queries, "query_id string, tenant_id int, query array<float>"), spark.createDataFrame(rows, KIND).repartition(3), 5)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], None if r["similarity"] is None else round(r["similarity"], 9) + 0.0) for r in df.collect())
    assert got == brute(queries, rows, 5)


def test_one_scan_and_no_other_widths(spark, sf):
    vectors = Tables(spark, sf).vectors()
    plan = search.batch_search(asked(vectors), vectors, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Relation") == 2  # the vectors, and the queries that are some of them
    short = spark.createDataFrame([(1, 1, [1.0])], "query_id long, tenant_id int, query array<float>")
    with pytest.raises(Exception, match="expected 64 values, got 1"):
        search.batch_search(short, vectors, 5).collect()


def test_recall_against_all_vectors(spark, sf):
    """Nine of ten hits from 20 vectors a query, 5 % of its tenant's; with as many candidates as vectors all hits."""
    vectors = Tables(spark, sf.replace("sf0.01", "sf0.1")).vectors()
    queries = asked(vectors)
    exact = hits(search.batch_search(queries, vectors, 5))
    made = index.build(vectors)
    assert sorted(r[0] for r in made.rows.select("chunk_id").collect()) == sorted(r[0] for r in vectors.select("chunk_id").collect())
    assert len(hits(index.search_index(made, queries, 5, rerank=4)) & exact) >= 0.9 * len(exact)
    assert hits(index.search_index(made, queries, 5, rerank=100)) == exact


def test_clustered_vectors_need_few_lists(spark):
    """Nine of ten hits from six of 40 lists, 15 %, when vectors lie around 40 points."""
    pick = np.random.default_rng(6)
    middles = pick.normal(size=(40, 16))
    rows = [(i, 1, (middles[i % 40] + 0.1 * pick.normal(size=16)).tolist()) for i in range(2000)]
    vectors = spark.createDataFrame(rows, KIND)
    exact = hits(search.batch_search(asked(vectors), vectors, 5))
    made = index.build(vectors, lists=40)
    assert len(hits(index.search_index(made, asked(vectors), 5, probes=6)) & exact) >= 0.9 * len(exact)


def test_tenants_read_their_own_folders(spark, sf):
    made = index.build(Tables(spark, sf).vectors())
    plan = made.rows.where("tenant_id = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan


def test_insertions_and_deletions(spark):
    rows = [(i, i % 2, [float(i), 1.0, -float(i % 3)]) for i in range(60)]
    made = index.build(spark.createDataFrame(rows, KIND), lists=3)
    query = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0])], "query_id long, tenant_id int, query array<float>")
    best = lambda: [r["chunk_id"] for r in index.search_index(made, query, 3).orderBy("rank").collect()]
    exact = lambda rows_: [i for _, _, i, _ in brute([(1, 0, [1.0, 0.0, 0.0])], rows_, 3)]
    assert best() == exact(rows)
    index.delete(made, spark.createDataFrame([(54,), (999,)], "chunk_id long"))
    left = [r for r in rows if r[0] != 54]
    assert best() == exact(left)
    new = [(54, 0, [0.0, 1.0, 0.0]), (100, 0, [5.0, 0.0, 0.0]), (48, 0, [-1.0, 0.0, 0.0])]
    index.insert(made, spark.createDataFrame(new, KIND))
    now = [r for r in left if r[0] != 48] + new
    assert best() == exact(now) and best()[0] == 100
    assert sorted(r["chunk_id"] for r in made.rows.collect()) == sorted(r[0] for r in now)


def test_codes_are_near_their_vectors():
    pick = np.random.default_rng(7)
    rows = pick.normal(size=(50, 7))
    centroids = pick.normal(size=(4, 7))
    lists, codes, scales = index.encode(rows, centroids)
    assert len(codes[0]) == 4 and np.abs(index.decode(lists, codes, scales, centroids) - rows).max() <= scales.max() * 0.51


def test_cases(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, None), (4, 2, [1.0, 0.0]), (5, 1, [1.0, 0.0]), (5, 1, [1.0, 0.0]), (6, None, [1.0, 0.1])]
    vectors = spark.createDataFrame(rows, KIND)
    queries = spark.createDataFrame([(1, 1, [2.0, 0.0]), (2, 3, [1.0, 0.0]), (3, 1, None)], "query_id long, tenant_id int, query array<float>")
    made = index.build(vectors, lists=2)
    assert made.rows.count() == 7 and [r["chunk_id"] for r in made.rows.where("list = -1").collect()] == [3]
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["similarity"]) for r in index.search_index(made, queries, 3).where("similarity is not null").collect())
    assert got[:2] == [(1, 1, 1, 1.0), (1, 2, 5, 1.0)]  # ties: the lesser id
    nothing = index.build(vectors.where("embedding is null"))
    assert nothing.rows.count() == 1 and index.search_index(nothing, queries).count() == 0
    assert index.search_index(index.build(vectors.where("false")), queries).count() == 0
    with pytest.raises(ValueError):
        index.build(vectors, lists=0)


@pytest.mark.parametrize("values", [3, 30, 1 << 20])
def test_cells_equal_plain_python(spark, monkeypatch, values):
    """Queries that are not broadcast meet the vectors in cells of a bounded number of values; keys of other sizes, copies, nulls."""
    for name, size in (("BROADCAST_BYTES", 0), ("CELL_VECTORS", values), ("CELL_QUERIES", values)):
        monkeypatch.setattr(blocks, name, size)
    pick = np.random.default_rng(8)
    value = lambda: [None, [0.0, 0.0, 0.0], [1.0, 1.0, 0.0], *pick.integers(-2, 3, (3, 3)).astype(float).tolist()][pick.integers(0, 6)]
    rows = [(i, [1, 1, 1, 2, None][pick.integers(0, 5)], value()) for i in range(90)]
    queries = [(f"q{i}", int(pick.integers(1, 4)), value()) for i in range(40)]
    asked_ = spark.createDataFrame(queries, "query_id string, tenant_id int, query array<float>")
    df = search.batch_search(asked_, spark.createDataFrame(rows, KIND).repartition(3), 4)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], None if r["similarity"] is None else round(r["similarity"], 9) + 0.0) for r in df.collect())
    assert got == brute(queries, rows, 4)


def test_a_search_beyond_broadcasts_moves_vectors_and_queries_a_bounded_number_of_times(spark, monkeypatch):
    """Each vector goes to a cell for each part of the queries and each query for each part of the vectors, not to a fixed number of salts."""
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    rows = spark.range(400).select(F.col("id").alias("chunk_id"), F.lit(1).alias("tenant_id"), F.array(*[(F.col("id") * n % 17).cast("float") for n in range(1, 5)]).alias("embedding"))
    queries = rows.select(F.col("chunk_id").alias("query_id"), "tenant_id", F.col("embedding").alias("query"))
    plan = lambda: search.batch_search(queries, rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Salt" not in plan() and "salt" not in plan() and "FlatMapCoGroupsInArrow" in plan()


def test_batches_of_blocks_are_bounded(spark, sf):
    """A row is a block of half a megabyte or more, so rows of a batch must be limited by their bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        vectors = Tables(spark, sf).vectors()
        search.batch_search(asked(vectors), vectors, 5)
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def test_many_queries_by_tiles():
    """Products of single precision and tiles find the hits of a plain sort, also after hits of another block."""
    pick = np.random.default_rng(9)
    vectors, queries = pick.normal(size=(5000, 16)), pick.normal(size=(3000, 16))
    vectors[100:200] = vectors[0]  # copies
    unit = lambda x: x / np.sqrt(np.square(x).sum(axis=1))[:, None]
    want = np.argsort(-np.round(unit(queries) @ unit(vectors).T, 12), axis=1, kind="stable")[:, :4]
    first, rest = (blocks._Block(ids, vectors[ids], 4) for ids in (np.arange(3000), np.arange(3000, 5000)))
    place, ids, _ = blocks._best_of(rest, queries, 4, blocks._best_of(first, queries, 4))
    assert (place.reshape(-1, 4) == np.arange(3000)[:, None]).all() and (ids.reshape(-1, 4) == want).all()


def test_centroids_are_fitted_without_a_table_of_their_distances(spark):
    """Rows between all pairs of centroids went to the driver, from a task for each centroid."""
    pick = np.random.default_rng(10)
    rows = [(i, 1, pick.normal(size=16).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, KIND)
    context = spark.sparkContext
    context.setJobGroup("fitting", "fitting")
    try:
        made = index.build(vectors, lists=300)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("fitting") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) < 300
    assert made.centroids.shape == (300, 16)


def test_centroids_are_means_of_their_vectors(spark):
    """Also where products are made a few rows at once, and with copies, zeros and vectors that aren't numbers."""
    rows = [(i, 1, [1.0, 0.01 * (i % 5)] if i % 2 else [-1.0, 0.01 * (i % 3)]) for i in range(200)] + [(200, 1, [0.0, 0.0]), (201, 1, [float("nan"), 1.0])]
    made = index.build(spark.createDataFrame(rows, KIND), lists=3)
    assert np.isfinite(made.centroids).all()
    units = np.array([np.array(r[2]) / (np.linalg.norm(r[2]) or 1) for r in rows[:201]])
    places = index._places(units, made.centroids)
    for place in set(places.tolist()):
        assert np.allclose(units[places == place].mean(axis=0), made.centroids[place], atol=1e-3)


def test_places_do_not_depend_on_tiles(monkeypatch):
    pick = np.random.default_rng(11)
    rows, centroids = pick.normal(size=(70, 5)), pick.normal(size=(9, 5))
    whole = index._places(rows, centroids)
    for tile in (1, 9, 40):
        monkeypatch.setattr(index, "TILE", tile)
        assert (index._places(rows, centroids) == whole).all()
    assert index._places(rows[:0], centroids).tolist() == []


@pytest.mark.parametrize("size", [0, 8 << 20])
def test_all_vectors_are_not_broadcast_for_their_candidates(spark, sf, monkeypatch, size):
    """The size of a column of arrays is guessed too low, so the vectors went through the driver to all tasks."""
    monkeypatch.setattr(index, "BROADCAST_BYTES", size)
    vectors = Tables(spark, sf).vectors()
    found = index.search_index(index.build(vectors), asked(vectors), 5, rerank=100)
    hints = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "chunk_id" in line]
    assert len(hints) == 1 and ("rightHint=(strategy=broadcast)" if size else "rightHint=(strategy=merge)") in hints[0]
    assert hits(found) == hits(search.batch_search(asked(vectors), vectors, 5))

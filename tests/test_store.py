import pytest
from pyspark.sql import functions as F

from tessel.sources import files, filesystem
from tessel.sources.snapshots import Conflict, Store


def test_appended_rows_are_stored_by_tenant(spark, sf, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", unique={"d": ["doc_id"]}, partitions={"d": ["tenant_id"]})
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 5).alias("tenant_id"), "doc_id", "text")
    assert store.publish({"d": docs.where("doc_id < 500")}) == 1 and store.append("d", docs.where("doc_id >= 500")) == 2
    got = store.read("d")
    assert got.schema == docs.schema and got.exceptAll(docs).isEmpty() and got.count() == docs.count()
    one = got.where("tenant_id = 3")
    assert "PartitionFilters: [isnotnull(tenant_id" in one._jdf.queryExecution().toString() and one.count() == docs.where("tenant_id = 3").count()
    assert store.read("d", 1).count() == docs.where("doc_id < 500").count()
    try:
        store.append("d", docs.where("doc_id = 1"))
        raise AssertionError
    except ValueError as e:
        assert "unique" in str(e)
    assert store.version == 2 and store.health() == {"ok": True, "version": 2, "tables": ["d"]}


def test_seed_reset_drop(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    kind = spark.createDataFrame([], "id long, name string").schema
    row = lambda *r: spark.createDataFrame(list(r), kind)
    assert store.bootstrap({"t": kind, "u": kind}) == 1
    assert store.seed({"t": (row((1, "default")), ["id"])}) == 2 == store.seed({"t": (row((1, "other")), ["id"])})
    assert store.seed({"t": (row((1, "x"), (2, "admin")), ["id"])}) == 3
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "default"), (2, "admin")]
    assert store.drop(["u"]) == 4 and store.health()["tables"] == ["t"] and store.read("u", 3).count() == 0
    assert store.reset({"t": kind, "v": kind}, {"t": (row((1, "default")), ["id"])}) == 5
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "default")] and store.read("v").isEmpty()
    assert Store(spark, f"file://{tmp_path}/none").health() == {"ok": True, "version": 0, "tables": []}
    for f in (tmp_path / "s/data/t").glob("*/*.parquet"):
        f.write_bytes(b"broken")
    assert store.health()["ok"] is False


def test_commit_skips_what_has_not_changed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([(1, "a.txt", "one"), (2, None, "two")], "id long, doc_name string, content string")
    assert files.commit(store, docs, "Add two") == 1 and files.commit(store, docs, "Again") is None
    assert files.commit(store, docs.where("id = 1").withColumn("content", F.lit("new")), "Change") == 2
    assert [tuple(r) for r in store.read("commits").orderBy("version").collect()] == [(1, "Add two", 2, 0), (2, "Change", 1, 1)]
    assert [tuple(r) for r in files.tree(store).collect()] == [("documents/1_a.txt", "new")]
    assert files.tree(store, 1).count() == 2 and store.read("files").count() == 4  # what has changed, and a mark
    assert files.commit(store, docs, "Back") == 3 and sorted(r["content"] for r in files.tree(store).collect()) == ["one", "two"]


def test_many_writers_one_wins_each_version(spark, tmp_path):
    """Writers to tables of their own all get through; of those that replace one table from the same version one does."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, f"file://{tmp_path}/s", unique={f"t{i}": ["id"] for i in range(4)})
    store.publish({"shared": spark.range(1), "log": spark.range(0)})
    with ThreadPoolExecutor(8) as pool:
        own = list(pool.map(lambda i: store.publish({f"t{i}": spark.range(i + 1)}), range(4)))
        added = list(pool.map(lambda i: store.append("log", spark.range(i, i + 1)), range(8)))
    assert sorted(own + added) == list(range(2, 14)) == store.versions()[1:] and store.health()["ok"]
    assert sorted(r[0] for r in store.read("log").collect()) == list(range(8)) and store.read("t3").count() == 4

    def replace(i):
        try:
            return store.publish({"shared": spark.range(100 + i)}, at=13)
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i, v in enumerate(pool.map(replace, range(6))) if v]
    assert len(won) == 1 and store.read("shared").count() == 100 + won[0] and store.version == 14
    assert len(list((tmp_path / "s/data/shared").iterdir())) == 2  # the losers' rows are gone
    base = store._newest()
    store.publish({"shared": spark.range(5)})
    assert store._commit(lambda current: current, base) == 16  # an overtaken number is not made again


def test_a_manifest_is_made_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(16) as pool:
        made = list(pool.map(lambda i: filesystem.create(spark, f"file://{tmp_path}/m/v1.json", str(i)), range(16)))
    assert sum(made) == 1 and filesystem.read(spark, f"file://{tmp_path}/m/v1.json") == str(made.index(True))
    assert filesystem.names(spark, f"file://{tmp_path}/m") == ["v1.json"] and filesystem.names(spark, f"file://{tmp_path}/none") == []


def test_an_append_reads_only_folders_that_may_hold_its_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", unique={"d": ["id", "name"]})
    rows = lambda a, b, step=1: spark.range(a, b, step).select(F.format_string("%05d", "id").alias("id"), (F.col("id") % 3).cast("string").alias("name"))
    store.publish({"d": rows(0, 1000)})
    store.append("d", rows(2000, 3000, 2))
    store.append("d", rows(2001, 2999, 2))
    entry = store.manifest()[1]["d"]
    paths = [f["path"] for f in entry["folders"]]
    assert store.folders_to_read("d", entry, rows(5000, 5010)) == []  # by the ranges
    assert store.folders_to_read("d", entry, rows(500, 501)) == paths[:1]
    assert store.folders_to_read("d", entry, rows(2500, 2501)) == paths[1:2]  # by the filters: the ranges of two hold it
    for clash in (rows(2500, 2501), rows(7, 9), rows(9000, 9001).unionAll(rows(9000, 9001))):
        with pytest.raises(ValueError, match="unique"):
            store.append("d", clash)
    assert len(list((tmp_path / "s/data/d").iterdir())) == 3  # refused rows leave nothing behind
    other = rows(7, 8).withColumn("name", F.lit("other"))
    assert store.append("d", other) == 4 and store.append("d", other.withColumn("id", F.lit(None).cast("string"))) == 5
    with pytest.raises(ValueError, match="unique"):
        store.append("d", other.withColumn("id", F.lit(None).cast("string")))
    assert store.read("d").count() == 2001


def test_reserved_ids(spark, tmp_path):
    """Two writers get ranges that don't meet, and what makes the rows is evaluated once."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, f"file://{tmp_path}/s", unique={"d": ["id"]})
    store.publish({"d": spark.createDataFrame([], "id long, name string")})
    seen = spark.sparkContext.accumulator(0)

    def rows(i):
        note = F.udf(lambda n: (seen.add(1), f"{i}-{n:03}")[1])
        return spark.range(50).select(note("id").alias("name"))

    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda i: store.insert("d", rows(i), ["name"]), range(4)))
    assert sorted(firsts) == [1, 51, 101, 151] and seen.value == 200
    got = {r["id"]: r["name"] for r in store.read("d").collect()}
    assert sorted(got) == list(range(1, 201)) and all(got[f + n] == f"{i}-{n:03}" for i, f in enumerate(firsts) for n in range(50))
    assert store.reserve("d", 5) == 201 and store.insert("d", rows(9).limit(0), ["name"]) == 206


def test_written_documents_have_paths(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x/a.txt", "one")], "id long, doc_name string, content string")
    files.write_documents(docs, f"file://{tmp_path}/out")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [("documents/1_a.txt", "one")]

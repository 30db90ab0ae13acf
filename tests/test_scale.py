"""What a query takes grows no faster than its input."""

import hashlib
import math
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tessel.functions.vector import check_dimension, hash_vector
from tessel.operators import answers, models, summaries
from tessel.operators.blocks import nearest, vectors_of
from tessel.operators.ledger import Ledger
from tessel.operators.scope import Scope
from tessel.plans import ingest
from tessel.plans.queries import _empty
from tessel.sources.shared import keep
from tessel.sources.tables import Tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_and_their_sources_come_from_one_search(spark, sf):
    x = Tables(spark, sf)
    queries = x.queries().withColumn("tenant_id", (F.col("conv_id") % 5).cast("int"))
    made = answers.answer(queries, x.chunks(), x.vectors(), x.documents(), lambda text: hash_vector(text, 64), models.split_questions)
    assert all("InArrow" not in _plan(made[n]) for n in ("sources", "clauses", "responses"))


def test_prompts_of_a_local_model_fill_more_tasks(spark, tmp_path):
    """Those of any other model still go to as many tasks as may call it at once."""
    name, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    parts, size = spark.conf.get("spark.sql.shuffle.partitions"), F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(400).select("id", size.alias("text"))
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        files = {}
        for kind, model in (("local", models.local(lambda s: s.str[:3])), ("remote", lambda s: s.str[:3])):
            ledger = Ledger(spark, f"file://{tmp_path}/{kind}")
            assert ledger.call("m", model, rows, F.col("text")).where("reply = left(text, 3)").count() == 400
            files[kind] = len(list((tmp_path / kind).rglob("*.parquet")))
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert files == {"local": 12, "remote": 4}


def test_local_clause_models_stay_local():
    assert models.is_local(answers._say(models.quote_sources)) and not models.is_local(answers._say(lambda s: s))


def test_a_text_is_hashed_once_for_all_places_of_its_vector(spark):
    """Not once for each place and each reading of the vector; the values are those of the digests."""
    df = spark.createDataFrame([("a text",), ("",), ("é",), (None,)], "text string")
    made = df.select("text", check_dimension(hash_vector(F.col("text"), 8), 8).alias("v"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and plan.count("ArrowEvalPython") == 1
    for text, v in made.collect():
        if text is None:
            assert v == [None] * 8
            continue
        raw = [int(hashlib.sha256(f"{text}:{i}".encode()).hexdigest()[:8], 16) / 4294967295.0 * 2 - 1 for i in range(8)]
        assert v == pytest.approx([x / math.sqrt(sum(y * y for y in raw)) for x in raw], abs=1e-7)


def test_document_summaries_are_not_bound_to_the_tasks_of_a_remote_model(spark, sf, tmp_path):
    """project_summary_rollup: one of four tasks read a quarter of all texts."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "12"), strict=True):
        spark.conf.set(n, v)
    try:
        summaries.summarize_documents(Tables(spark, sf).documents(), models.first_sentence, Ledger(spark, f"file://{tmp_path}/ledger"))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(list((tmp_path / "ledger").rglob("*.parquet"))) == 12


def test_hits_do_not_keep_the_batches_of_their_queries(spark):
    """batch_search_topk: ids of a block of queries kept the batch that they came in, 8 MB with its vectors, until the task ended."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1)))
    rows = spark.range(4096, numPartitions=1).select(F.lit(1).alias("tenant_id"), F.col("id").alias("chunk_id"), vector.alias("embedding"))
    queries = spark.range(0, 4096, 64, numPartitions=64).select(F.lit(1).alias("tenant_id"), F.col("id").alias("query_id"), vector.alias("query"))

    def decode(row):
        """Called once for each of the two blocks of vectors, by one task."""
        if tracemalloc.is_tracing():
            now = tracemalloc.get_traced_memory()[0]
            tracemalloc.stop()
            if now > 40 << 20:
                raise MemoryError(f"{now >> 20} MB are held after a block of vectors")
        else:
            tracemalloc.start()
        return vectors_of(row)

    best = nearest(queries, rows, 1, decode=decode).collect()
    assert len(best) == 64 and all(r["chunk_id"] == r["query_id"] for r in best)


def test_shuffle_files_go_when_a_table_is_written(spark):
    """ingest_document: they stayed until the driver happened to collect its garbage, some times the size of the texts."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    rows, old = spark.range(100_000).groupBy(F.sha2(F.col("id").cast("string"), 256).alias("key")).count(), files()
    assert keep(rows).count() == 100_000
    until = time.time() + 10
    while time.time() < until and any("shuffle_" in f for f in files() - old if _bytes(f) > 1_000_000):
        time.sleep(0.2)
    assert not [f for f in files() - old if _bytes(f) > 1_000_000]
    assert spark.conf.get(name) == before


def _bytes(file):
    from pathlib import Path

    return Path(file).stat().st_size if Path(file).exists() else 0


def test_an_ingestion_leaves_its_texts_once_in_each_table(spark, sf, tmp_path, monkeypatch):
    """Documents and chunks are written, no tables on the way to them, no replies of a ledger that nobody else knows and no vectors that are hashes."""
    for module in ("tessel.sources.shared", "tessel.operators.ledger"):
        monkeypatch.setattr(f"{module}.shared_folder", lambda _: f"file://{tmp_path}")
    docs = Tables(spark, sf).documents().select("doc_name", "content")
    size = docs.agg(F.sum(F.octet_length("content"))).first()[0]
    state = ingest.upload(docs, _empty(Tables(spark, "")), Scope(1, (4,)))
    assert 0 < sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2 * size
    assert not list(tmp_path.glob("ledger-*"))
    assert state["documents"].where("content = context").count() == docs.count()
    assert state["vectors"].where("size(embedding) = 64").count() == state["chunks"].where("content <> ''").count() > 0


def test_a_ledger_that_is_given_keeps_its_replies(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ingest.upload(spark.createDataFrame([("a.txt", "Word. " * 200)], "doc_name string, content string"), _empty(Tables(spark, "")), Scope(1, (4,)), ledger=ledger)
    assert ledger.calls("context").count() == 1

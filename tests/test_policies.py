"""Row policies, and questions that are kept."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessel.operators import models, search
from tessel.operators.ledger import Ledger
from tessel.operators.scope import Scope
from tessel.plans import questions
from tessel.sources.policies import ScopedTables
from tessel.sources.snapshots import Store

ONE = Scope(1, (1, 2))


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/s", partitions={"documents": ["tenant_id"]})
    rows = lambda kind, *r: spark.createDataFrame(list(r), kind)
    made.publish(
        {
            "documents": rows("id long, doc_name string, tenant_id int, project_id int", (1, "a", 1, 1), (2, "b", 1, 3), (3, "c", 2, 1), (4, "d", None, None)),
            "chunks": rows("id long, doc_id long, context string, content string, tenant_id int, project_id int", (1, 1, "", "own", 1, 1), (2, 3, "", "foreign", 2, 1)),
            "vectors": rows("chunk_id long, embedding array<float>, tenant_id int, project_id int", (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1)),
            "edges": rows("id long, tenant_id int, project_id int", (10, 1, 1), (11, 2, 1)),
            "metadata": rows("relationship_id long, key string, value string", (10, "k", "own"), (11, "k", "foreign"), (12, "k", "nobody")),
            "plain": rows("x int", (1,)),
        }
    )
    return made


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_reads_carry_the_scope(store):
    seen = ScopedTables(store, ONE)
    assert ids(seen["documents"]) == [1] and ids(seen["metadata"]) == [10]
    assert ids(ScopedTables(store, Scope(1))["documents"]) == [1, 2] and ids(ScopedTables(store, Scope(None))["documents"]) == []
    assert "PartitionFilters: [isnotnull(tenant_id" in seen["documents"]._jdf.queryExecution().toString()
    with pytest.raises(PermissionError, match="no row policy"):
        seen["plain"]
    # a vector of tenant 1 on a chunk of tenant 2 brings up nothing
    hits = search.search_inner_product(seen["chunks"], seen["vectors"], seen["documents"], [1.0, 0.0], ONE)
    assert [r["content"] for r in hits.collect()] == ["own"]


def test_writes_stay_in_the_scope(spark, store):
    seen = ScopedTables(store, ONE)
    row = lambda *r: spark.createDataFrame([r], store.read("documents").schema)
    assert seen.append("documents", row(9, "new", 1, 2)) == 2
    for bad in (row(8, "other", 2, 1), row(8, "other", 1, 3), row(8, "nobody", None, None)):
        with pytest.raises(PermissionError):
            seen.append("documents", bad)
    assert seen.replace("documents", row(7, "only", 1, 1)) == 3
    assert ids(seen["documents"]) == [7] and ids(store.read("documents")) == [2, 3, 4, 7]
    assert seen.replace("metadata", spark.createDataFrame([(10, "k", "changed")], store.read("metadata").schema)) == 4
    assert sorted(r["value"] for r in store.read("metadata").collect()) == ["changed", "foreign", "nobody"]
    with pytest.raises(PermissionError):
        seen.append("metadata", spark.createDataFrame([(11, "k", "x")], store.read("metadata").schema))


def test_a_stopped_batch_ends_right(spark, tmp_path, monkeypatch):
    store, ledger = Store(spark, f"file://{tmp_path}/q"), Ledger(spark, f"file://{tmp_path}/ledger", attempts=1)
    queries = spark.createDataFrame([(1, 1, 1, "good one. And more."), (2, 1, 1, "bad one."), (3, 9, 1, "elsewhere.")], "id long, tenant_id int, project_id int, query_text string")
    chunks = spark.createDataFrame([(7, 4, "Some text. More.", 1)], "id long, doc_id long, content string, tenant_id int")
    vectors = spark.createDataFrame([(7, [1.0, 0.0], 1)], "chunk_id long, embedding array<float>, tenant_id int")
    docs = spark.createDataFrame([(4, "doc", 1)], "id long, doc_name string, tenant_id int")

    def broken(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return models.quote_sources(prompts)

    args = chunks, vectors, docs, lambda t: F.array(F.lit(1.0), F.lit(0.0)), models.split_questions
    run = lambda model: {r["query_id"]: (r["status"], r["response_text"]) for r in questions.ask(store, "b1", queries, *args, clause_model=model, ledger=ledger).collect()}
    whole = Store.publish

    def stopped(self, tables, **kwargs):
        if "sources" in tables and "queries" not in tables:
            raise KeyboardInterrupt
        return whole(self, tables, **kwargs)

    monkeypatch.setattr(Store, "publish", stopped)
    with pytest.raises(KeyboardInterrupt):
        run(broken)
    monkeypatch.setattr(Store, "publish", whole)
    assert {r["status"] for r in questions.responses(store, "b1").collect()} == {"pending"} and store.read("queries").count() == 3
    assert run(broken) == {1: ("success", "Some text. (doc)"), 2: ("failed", None), 3: ("pending", None)}
    assert [r["query_id"] for r in store.read("sources").collect()] == [1] and store.read("queries").count() == 3
    assert run(models.quote_sources) == {1: ("success", "Some text. (doc)"), 2: ("success", "Some text. (doc)"), 3: ("pending", None)}
    version = store.version
    assert run(lambda p: pd.Series(["other"] * len(p)))[2] == ("success", "Some text. (doc)") and store.version == version
    assert sorted((r["query_id"], r["snippet"]) for r in store.read("sources").collect()) == [(1, "Some text. More."), (2, "Some text. More.")]

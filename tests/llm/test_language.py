import numpy as np
from pyspark.sql import functions as F

from tessel.llm import language as lang


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.col("doc_id") % 5 == 0
    model = lang.fit(docs.where(~held))
    # the declarations of the held-out rows are hidden
    rows = lang.of_documents(docs.where(held).withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")), model).collect()
    assert len(rows) == docs.where(held).count()
    right = sum(r["language"] == r["truth"] for r in rows)
    assert right >= 0.97 * len(rows) and all(r["accepted"] for r in rows)


def test_whole_tables(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "pages"))
    rows = lang.op5(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and sum(r["language"] == r["lang"] for r in rows) >= 0.99 * len(rows)
    said = F.regexp_extract("html", 'lang="(..)"', 1)
    rows = lang.op5_pages(pages, docs).join(pages.select("page_id", said.alias("said")), "page_id").collect()
    assert len(rows) == pages.count() and sum(r["language"] == r["said"] for r in rows) >= 0.95 * len(rows)


def test_priors_decide_short_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = lang.fit(docs)
    rows = docs.where("lang in ('fr', 'de')").withColumn("source", F.concat("lang", F.lit(".host")))
    added = spark.createDataFrame([(-1, "en", None, "fr.host"), (-2, "en", None, "de.host"), (-3, None, "fr", "fr.host"), (-4, "123 !!", None, None)], "doc_id long, text string, lang string, source string")
    hidden = rows.withColumn("lang", F.lit(None).cast("string")).unionByName(added)
    got = {r["doc_id"]: r for r in lang.of_documents(hidden, model).where("doc_id < 0").collect()}
    assert got[-1]["language"] == "fr" and got[-2]["language"] == "de"
    assert not got[-3]["accepted"] and got[-3]["language"] is None and not got[-4]["accepted"]


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string, lang string, source string, posterior string, language int"
    assert lang.accepted(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "the cat sat on the mat and the dog", "en", "a", "p", 1)] * 2 + [(2, "", None, None, None, None), (3, None, "en", "a", None, None), (4, "le chat est sur la table et le chien", "fr", "b", None, None)] + [(5, "x" * 100_000, None, "a", None, None)]
    df = spark.createDataFrame(rows, schema)
    kept = lang.accepted(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids[:2] == [1, 1] and 4 in ids and 2 not in ids and 3 not in ids


def test_the_sample_is_never_empty(spark):
    for total in (1, 10**6, 2 * 10**10, 10**13):
        bound = lang.hash_bound(total, 20_000)
        share = (bound + 2**63) / 2**64
        assert share == 1 or abs(share * total / 20_000 - 1) < 0.01
    rows = [(i, "the cat sat on the mat" if i % 2 else "le chat est sur la table", "en" if i % 2 else "fr") for i in range(40)] + [(99, "der hund ist in dem haus", "de")]
    model = lang.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=0)
    assert model.languages == ["de", "en", "fr"]


def test_pages_with_nulls_ties_and_none(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.fr/x", "<html lang='fr'><p></p></html>"), (2, "http://a.fr/x", "<html lang='fr'><p></p></html>"), (None, "odd", "<p>zz</p>")], "page_id long, url string, html string")
    got = lang.op5_pages(pages, docs).collect()
    assert len(got) == 4 and [r["accepted"] for r in got if r["page_id"] is not None] == [False] * 3
    assert lang.op5_pages(pages.where("false"), docs).count() == 0
    tied = lang.TextModel(["a", "b"], np.zeros((2, lang.FEATURES + 1), np.float32))
    row = lang.of_documents(spark.createDataFrame([(1, "word", None, None)], "doc_id long, text string, lang string, source string"), tied).first()
    assert row["language"] == "a" and row["posterior"] == 0.5

"""Incremental states against states made anew, and what the models were asked on the way."""

import pytest
from pyspark.sql import functions as F

from tessel.operators import answers, models
from tessel.operators import scope as sc
from tessel.operators.ledger import Ledger, ModelFailure
from tessel.plans import ingest
from tessel.plans.queries import _empty
from tessel.sources.shared import keep
from tessel.sources.tables import Tables

from .test_ledger import Counting

SCOPE = sc.Scope(1, (4,), "u")
LONG = "# Guide\nVector coffee roasters sell Beans from Kenya Hills.\n" + "More words follow here. " * 60
DOCS = [("a.md", LONG), ("b.txt", "Short note about Paris."), ("c.txt", " "), ("d.txt", "Madrid lies in Spain. " * 40)]


class Makers:
    """Counting stand-ins for all models."""

    def __init__(self, tmp_path):
        self.counting = {}
        for name, reply in {"context_model": lambda p: f"ctx {len(p)}", "embedder": lambda p: [float(len(p)), 1.0] * 32, "summarizer": lambda p: (p or "").split(".")[0], "project_model": lambda p: f"sum of {len(p)}"}.items():
            (tmp_path / name).mkdir()
            self.counting[name] = Counting(tmp_path / name, reply)
        self.models = self.counting | {"context_prompt": ingest.CONTEXT_PROMPT}

    def seen(self):
        return {n: c.seen() for n, c in self.counting.items()}


@pytest.fixture
def makers(tmp_path):
    return Makers(tmp_path)


def _start(spark):
    summaries = spark.createDataFrame([], "tenant_id int, project_id int, summary_text string, source_document_ids array<long>")
    return _empty(Tables(spark, "")) | {"project_summaries": summaries}


def _kept(state):
    return {k: keep(v) for k, v in state.items()}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_name string, content string")


def _contents(state):
    """A state without ids: chunks with their vectors, edges by names, summaries by documents."""
    names = {r["id"]: r["doc_name"] for r in state["documents"].collect()}
    vectors = {r["chunk_id"]: tuple(r["embedding"]) for r in state["vectors"].collect()}
    chunks = sorted((names[r["doc_id"]], r["chunk_order"], r["context"], r["content"], vectors.get(r["id"])) for r in state["chunks"].collect())
    entities = {r["id"]: r["name"] for r in state["entities"].collect()}
    of = {r["relationship_id"]: names[int(r["value"])] for r in state["metadata"].collect()}
    edges = sorted((entities[r["source_entity_id"]], entities[r["target_entity_id"]], of[r["id"]]) for r in state["edges"].collect())
    texts = sorted((r["doc_name"], r["content"], r["doc_size"]) for r in state["documents"].collect())
    return chunks, edges, sorted((names[r["document_id"]], r["summary_text"]) for r in state["summaries"].collect()), texts, len(vectors), sorted({n for e in edges for n in e[:2]})


def test_each_prompt_is_sent_once_in_an_ingestion(spark, tmp_path, makers):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    state = _kept(ingest.upload(_docs(spark, [*DOCS, ("e.txt", DOCS[3][1])]), _start(spark), SCOPE, ledger=ledger, **makers.models))
    seen = makers.seen()
    assert all(len(s) == len(set(s)) for s in seen.values())
    chunks = state["chunks"].collect()
    assert len(seen["context_model"]) == len({(r["content"], r["context"]) for r in chunks if r["context"]}) and len(seen["project_model"]) == 1
    # the same documents once more: every prompt but that of the project has its reply
    ingest.upload(_docs(spark, DOCS), _start(spark), SCOPE, ledger=ledger, **makers.models)["chunks"].count()
    after = makers.seen()
    assert {n: after[n] for n in seen if n != "project_model"} == {n: s for n, s in seen.items() if n != "project_model"}


@pytest.mark.parametrize("prompt", [None, ingest.CONTEXT_PROMPT])
def test_chunks_in_parts_are_those_at_once(spark, tmp_path, makers, monkeypatch, prompt):
    """Also each prompt is sent once, whichever part its chunks are in."""
    docs, given = _docs(spark, [*DOCS, ("e.txt", DOCS[3][1])]), makers.models | {"context_prompt": prompt}
    once = _kept(ingest.upload(docs, _start(spark), SCOPE, ledger=Ledger(spark, f"file://{tmp_path}/one"), **given))
    seen = makers.seen()["context_model"]
    monkeypatch.setattr(ingest, "PART_ROWS", 1)
    ledger = Ledger(spark, f"file://{tmp_path}/parts")
    parts = _kept(ingest.upload(docs, _start(spark), SCOPE, ledger=ledger, **given))
    assert _contents(parts) == _contents(once) and parts["chunks"].count() > 4
    assert sorted(makers.seen()["context_model"]) == sorted(2 * seen) and ledger.calls("context").count() > 1


def test_a_run_after_a_failure_sends_what_is_missing(spark, tmp_path, makers):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", attempts=1, batch=1)
    whole = makers.counting["summarizer"].reply

    def broken(text):
        if "Madrid" in text:
            raise OSError("down")
        return whole(text)

    makers.counting["summarizer"].reply = broken
    with pytest.raises(ModelFailure, match="summary: 1 prompts"):
        ingest.upload(_docs(spark, DOCS), _start(spark), SCOPE, ledger=ledger, **makers.models)
    before = makers.seen()
    makers.counting["summarizer"].reply = whole
    state = _kept(ingest.upload(_docs(spark, DOCS), _start(spark), SCOPE, ledger=ledger, **makers.models))
    after = makers.seen()
    assert after["context_model"] == before["context_model"] and after["embedder"] == before["embedder"]
    assert len(after["summarizer"]) == len(before["summarizer"]) + 1
    assert state["summaries"].count() == len(DOCS) and state["chunks"].count() == state["vectors"].count()


def test_updates_and_deletions_equal_a_state_made_anew(spark, tmp_path, makers):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    state = _kept(ingest.upload(_docs(spark, DOCS), _start(spark), SCOPE, ledger=ledger, **makers.models))
    before = makers.seen()
    ids = {r["doc_name"]: r["id"] for r in state["documents"].collect()}
    new = spark.createDataFrame([(ids["b.txt"], "Rome is old. " * 60), (ids["d.txt"], DOCS[3][1]), (999, "unknown")], "id long, content string")
    new = new.join(state["documents"].drop("content"), "id", "left").select(*state["documents"].columns)
    updated = _kept(ingest.update(new, state, SCOPE, ledger=ledger, **makers.models))
    after = makers.seen()
    assert {p for n in ("summarizer", "embedder") for p in set(after[n]) - set(before[n]) if "Rome" not in p} == set()
    assert all("Rome" in p for p in set(after["context_model"]) - set(before["context_model"]))
    gone = _kept(ingest.delete(spark.createDataFrame([(ids["a.md"],), (999,)], "id long"), updated, ledger=ledger, **makers.models))
    fresh = _kept(ingest.upload(_docs(spark, [("b.txt", "Rome is old. " * 60), *DOCS[2:]]), _start(spark), SCOPE, ledger=ledger, **makers.models))
    assert _contents(gone) == _contents(fresh)
    assert gone["project_summaries"].first()["source_document_ids"] == sorted(ids[n] for n in ("b.txt", "c.txt", "d.txt"))


def test_many_edits_of_one_document_equal_a_state_made_anew(spark, tmp_path, makers):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    state = _kept(ingest.upload(_docs(spark, DOCS), _start(spark), SCOPE, ledger=ledger, **makers.models))
    before = makers.seen()
    ids = {r["doc_name"]: r["id"] for r in state["documents"].collect()}
    own = state["chunks"].where(F.col("doc_id") == ids["a.md"]).orderBy("chunk_order").collect()
    edits = [(own[0]["id"], "Berlin tea."), (own[1]["id"], "Second Part."), (own[-1]["id"], ""), (12345, "nothing")]
    edited = _kept(ingest.edit_chunks(spark.createDataFrame(edits, "id long, new_content string"), state, SCOPE, ledger=ledger, **makers.models))
    text = edited["documents"].where(F.col("id") == ids["a.md"]).first()
    assert text["content"].startswith("Berlin tea.") and "Second Part." in text["content"] and text["doc_size"] == len(text["content"]) == len(text["context"])
    after = makers.seen()
    assert len(set(after["summarizer"]) - set(before["summarizer"])) == 1  # the one document
    assert len(set(after["context_model"]) - set(before["context_model"])) == 3 and len(after["project_model"]) == 2
    # all that is derived, made anew from the edited texts and chunks
    base = _start(spark) | {k: edited[k] for k in ("documents", "chunks")}
    docs = keep(edited["documents"])
    chunks = keep(ingest.contextualize(edited["chunks"].where(F.col("id").isin([e[0] for e in edits])).drop("context"), docs, makers.models["context_model"], ingest.CONTEXT_PROMPT))
    rest = edited["chunks"].where(~F.col("id").isin([e[0] for e in edits]))
    base["chunks"] = keep(rest.unionByName(chunks.select(*rest.columns)))
    base["vectors"] = ingest.embedded(base["chunks"], makers.models["embedder"], Ledger(spark)).select(*_start(spark)["vectors"].columns)
    anew = _kept(ingest.derive(docs, base, SCOPE, ingest.Makers(**makers.models), Ledger(spark)))
    assert _contents(edited) == _contents(anew)


def test_overlapping_and_lost_edits(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz")], "id long, content string")
    chunks = spark.createDataFrame([(1, 1, 0, "abcdef"), (2, 1, 1, "efgh"), (3, 2, 0, "gone"), (4, 2, 1, "")], "id long, doc_id long, chunk_order int, content string")
    edits = spark.createDataFrame([(1, "1", 1), (1, "first", 0), (2, None, 0), (3, "3", 0), (4, "4", 0), (None, "5", 0)], "id long, new_content string, ord int")
    got = {r["doc_id"]: r["content"] for r in ingest.spliced(ingest.last_edits(edits), chunks, docs).collect()}
    assert got == {1: "1ij"}
    assert {r["id"]: r["new_content"] for r in ingest.last_edits(edits.drop("ord")).collect()} == {1: "first", 2: "", 3: "3", 4: "4"}


def test_a_question_is_sent_once(spark, tmp_path):
    (tmp_path / "d").mkdir()
    counting = Counting(tmp_path / "d", lambda q: models.split_questions(__import__("pandas").Series([q])).iloc[0])
    queries = spark.createDataFrame([(1, 1, "good one. And two."), (2, 1, "good one. And two."), (3, 1, "else.")], "id long, tenant_id int, query_text string")
    chunks = spark.createDataFrame([(7, 4, "Some text. More.", 1), (8, 5, "Foreign.", 2)], "id long, doc_id long, content string, tenant_id int")
    vectors = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [1.0, 0.0], 1)], "chunk_id long, embedding array<float>, tenant_id int")
    docs = spark.createDataFrame([(4, "doc", 1), (5, "foreign", 2)], "id long, doc_name string, tenant_id int")
    out = answers.answer(queries, chunks, vectors, docs, lambda t: F.array(F.lit(1.0), F.lit(0.0)), counting, clause_model=models.quote_sources)
    rows = {n: df.collect() for n, df in out.items()}
    assert counting.seen() == ["else.", "good one. And two."]
    assert {r["doc_name"] for r in rows["sources"]} == {"doc"} and {r["status"] for r in rows["responses"]} == {"success"}


def test_a_large_project_is_rolled_up_in_parts(spark, monkeypatch, tmp_path):
    from tessel.operators import summaries

    monkeypatch.setattr(summaries, "PLACES", 3)
    texts = spark.createDataFrame([(1, 1, i, f"text {i:03}") for i in range(40)] + [(1, 2, 0, "alone")], "tenant_id int, project_id int, place long, t string")
    joined = {r["project_id"]: r["text"] for r in summaries.roll_up(texts, models.first_sentence, Ledger(spark), 10_000).collect()}
    assert joined == {1: "\n\n".join(f"text {i:03}" for i in range(40)), 2: "alone"}
    parts = summaries.parts_of(texts.where("project_id = 1"), 100).orderBy("part").collect()
    assert "\n\n".join(r["text"] for r in parts) == joined[1] and max(len(r["text"]) for r in parts) <= 110
    short = lambda s: s.map(lambda p: p.split("\n\n", 1)[1][:8])  # stands for a model that shortens
    made = {r["project_id"]: r["text"] for r in summaries.roll_up(texts, short, Ledger(spark), 100).collect()}
    assert made[1].startswith("text 000\n\ntext 0") and len(made[1]) < 100 and made[2] == "alone"
    whole = {r["project_id"]: len(r["text"]) for r in summaries.roll_up(texts, lambda s: s.map(lambda p: "long " * 30), Ledger(spark), 100).collect()}
    assert whole[1] > 100  # a model that doesn't shorten ends the tree


def test_a_library_keeps_tables_and_files_together(spark, tmp_path, makers):
    from tessel.plans.library import Library
    from tessel.sources import files
    from tessel.sources.snapshots import Store

    store = Store(spark, f"file://{tmp_path}/lib", unique={"documents": ["id"], "chunks": ["id"]})
    lib = Library(store, SCOPE, **makers.models)
    assert lib.upload(_docs(spark, DOCS[:2]), "First") == 2 and lib.upload(_docs(spark, DOCS[2:]), "Second") == 3
    ids = {r["doc_name"]: r["id"] for r in store.read("documents").collect()}
    path = lambda n: f"documents/{ids[n]}_{n}"
    before = makers.seen()
    new = spark.createDataFrame([(ids["b.txt"], "Rome is old."), (ids["d.txt"], DOCS[3][1]), (999, "x")], "id long, content string")
    assert lib.update(new, "Update") == 4 and lib.update(new) is None
    first = store.read("chunks").where(F.col("doc_id") == ids["d.txt"]).orderBy("chunk_order").first()
    assert lib.edit(spark.createDataFrame([(first["id"], "Lisbon.")], "id long, new_content string"), "Edit") == 5
    assert lib.delete(spark.createDataFrame([(ids["a.md"],)], "id long"), "Remove") == 6 and lib.delete(spark.createDataFrame([(999,)], "id long")) is None
    tree = {r["path"]: r["content"] for r in files.tree(store).collect()}
    assert tree == {path(r["doc_name"]): r["content"] for r in store.read("documents").collect()} and set(tree) == {path(n) for n in ("b.txt", "c.txt", "d.txt")}
    assert files.tree(store, 3).count() == 4 and tree[path("d.txt")].startswith("Lisbon.")
    log = [tuple(r) for r in store.read("commits").orderBy("version").collect()]
    assert log == [(2, "First", 2, 0), (3, "Second", 2, 0), (4, "Update", 1, 0), (5, "Edit", 1, 0), (6, "Remove", 0, 1)]
    assert len(store.manifest()[1]["documents"]["folders"]) == 1 and store.read("project_summaries").first()["source_document_ids"] == sorted(ids[n] for n in ("b.txt", "c.txt", "d.txt"))
    after = makers.seen()
    assert not any(DOCS[0][1][:20] in p for n in ("summarizer", "embedder") for p in set(after[n]) - set(before[n]))  # what has not changed was not asked again

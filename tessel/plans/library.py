"""A store of documents with all that is made of them: every change is one version of tables, files and log together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.operators.ledger import Ledger
from tessel.operators.scope import Scope
from tessel.sources import files
from tessel.sources.shared import keep
from tessel.sources.snapshots import Store

from . import ingest

TABLES = {
    "documents": "id long, doc_name string, context string, content string, doc_size long, tenant_id int, project_id int",
    "chunks": "id long, doc_id long, chunk_order int, context string, content string, tenant_id int, project_id int",
    "vectors": "chunk_id long, embedding array<float>, tenant_id int, project_id int",
    "summaries": "document_id long, tenant_id int, project_id int, summary_text string, summary_hash string",
    "project_summaries": "tenant_id int, project_id int, summary_text string, source_document_ids array<long>, refreshed_at timestamp",
    "entities": "id long, tenant_id int, project_id int, name string, entity_type string, description string",
    "edges": "id long, tenant_id int, project_id int, source_entity_id long, target_entity_id long, relationship_type string, description string",
    "metadata": "relationship_id long, key string, value string",
    "sources": "id long, chunk_id long, doc_id long",
}
#: Tables that an upload only adds to, and their keys.
GROWS = {"documents": "id", "chunks": "id", "vectors": "chunk_id", "summaries": "document_id"}


class Library:
    """Documents of one scope in a store. A change starts from one version and fails, without a trace, if another writer has changed the same tables since;
    the ledger has the replies of the models, so trying again asks them nothing twice."""

    def __init__(self, store: Store, scope: Scope, ledger: Ledger | None = None, **models_):
        self.store, self.scope, self.models = store, scope, models_
        self.ledger = ledger or Ledger(store.spark, f"{store.path}/ledger")
        store.bootstrap({n: StructType.fromDDL(s) for n, s in TABLES.items()} | {n: StructType.fromDDL(s) for n, s in files.TABLES.items()})

    def state(self) -> dict[str, DataFrame]:
        return {n: self.store.read(n) for n in TABLES}

    def _publish(self, at: int, before: dict[str, DataFrame], after: dict[str, DataFrame], message: str, changed: DataFrame, gone: DataFrame | None = None, grows: dict[str, str] | None = None) -> int:
        """What has changed of after, and the files of changed documents and of those that are gone. grows: tables that only get rows."""
        grows, out = grows or {}, {}
        for n, df in after.items():
            if df is before[n]:
                continue
            if n in grows:
                df = df.join(before[n].select(grows[n]), grows[n], "left_anti")
            out[n] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[n]).fields])
        out |= files.rows_of(changed, gone, message, at + 1)
        return self.store.publish(out, at=at, add={*grows, *files.TABLES})

    def upload(self, documents: DataFrame, message: str = "Add documents") -> int:
        """documents (doc_name, content) as new ones of the scope's primary project; the version."""
        at, before = self.store.version, self.state()
        after = ingest.upload(documents, before, self.scope, ledger=self.ledger, **self.models)
        fresh = keep(after["documents"].join(before["documents"].select("id"), "id", "left_anti"))
        return self._publish(at, before, after, message, fresh, grows=GROWS)

    def update(self, documents: DataFrame, message: str = "Update documents") -> int | None:
        """documents (id, content) that are there with new contents; None where no content is new."""
        at, before = self.store.version, self.state()
        rest = [c for c in before["documents"].columns if c != "content"]
        new = documents.select("id", "content").join(before["documents"].select(*rest), "id").select(*before["documents"].columns)
        changed = keep(ingest.changed_documents(new, before))
        if changed.isEmpty():
            return None
        return self._publish(at, before, ingest.update(changed, before, self.scope, ledger=self.ledger, **self.models), message, changed)

    def edit(self, edits: DataFrame, message: str = "Edit chunks") -> int:
        """edits (id, new_content) of chunks; the files of the documents that change follow."""
        at, before = self.store.version, self.state()
        after = ingest.edit_chunks(edits, before, self.scope, ledger=self.ledger, **self.models)
        changed = keep(ingest.changed_documents(after["documents"], before))
        return self._publish(at, before, after, message, changed)

    def delete(self, doomed: DataFrame, message: str = "Remove documents") -> int | None:
        """Documents (id) with all that is made of them; None where none is there."""
        at, before = self.store.version, self.state()
        gone = keep(before["documents"].join(doomed.select("id").distinct(), "id", "left_semi"))
        if gone.isEmpty():
            return None
        return self._publish(at, before, ingest.delete(gone, before, ledger=self.ledger, **self.models), message, gone.limit(0), gone)

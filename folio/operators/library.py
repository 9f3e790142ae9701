"""The library: documents, versions, operations, attempts and their state."""

from __future__ import annotations

from collections import namedtuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio.operators.folds import Fold, fields, fold
from folio.sources.tables import latest

ACTIVE_WORK = ("queued", "processing")
ACTIVE_RUN = ("queued", "running", "stopping")
STAGES = ("extraction", "construction", "optimization", "summaries")


def library_filter(documents: DataFrame, text: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """live documents whose name or description matches, whatever the case, of the ids allowed."""
    found = documents.where("retired_at is null")
    if text:
        found = found.where(F.col("name").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%"))
    return found.where(F.col("document_id").isin(ids)) if ids is not None else found


def library_listing(documents: DataFrame, operations: DataFrame, attempts: DataFrame, versions: DataFrame, indexes: DataFrame) -> DataFrame:
    """V1: live documents with latest operation, its latest attempt, effective else latest version, and effective index if any."""
    op = operations.select(F.col("operation_id").alias("latest_operation"), "status", "stage", "reason", F.col("latest_attempt").alias("attempt_id"))
    attempt = attempts.select("attempt_id", F.col("mode").alias("attempt_mode"))
    version = versions.select(F.col("version_id").alias("shown_version"), "page_count")
    index = indexes.select(F.col("index_id").alias("effective_index"), F.col("mode").alias("index_mode"))
    shown = library_filter(documents).select("document_id", "name", "latest_operation", "effective_version", "effective_index", F.coalesce("effective_version", "latest_version").alias("shown_version"))
    joined = shown.join(op, "latest_operation").join(attempt, "attempt_id").join(version, "shown_version").join(index, "effective_index", "left")
    ready = F.col("effective_version").isNotNull() & F.col("effective_index").isNotNull()
    return joined.select("document_id", "name", "status", "stage", "page_count", F.coalesce("index_mode", "attempt_mode").alias("mode"), ready.alias("ready"))


def keyset_page(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """V2: the rows after a cursor, with ``next_cursor`` on each: the last key of the page if more follow. A top-k of limit + 1 rows."""
    after = df.where(F.col(key) > F.lit(cursor)) if cursor is not None else df
    top = after.orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)  # over limit + 1 rows
    numbered = top.withColumns({"nth": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy())})
    last = F.max(F.when(F.col("nth") == limit, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_cursor", F.when(F.col("n") > limit, last)).where(F.col("nth") <= limit).drop("nth", "n")


def dedupe_submissions(submissions: DataFrame, payload: list[str]) -> DataFrame:
    """V3: submissions (owner, submission, ts, id, payload...) with outcome: created, repeated (the first one's id), or changed payload."""
    w = Window.partitionBy("owner", "submission").orderBy("ts", "id")
    print_ = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    marked = submissions.withColumn("fingerprint", print_).withColumns(
        {"nth": F.row_number().over(w), "first_print": F.first("fingerprint").over(w), "first_id": F.first("id").over(w)}
    )
    outcome = F.when(F.col("nth") == 1, "created").when(F.col("fingerprint") == F.col("first_print"), "repeated").otherwise("submission_payload_changed")
    return marked.select("owner", "submission", "id", "first_id", outcome.alias("outcome"))


def version_history(versions: DataFrame) -> DataFrame:
    """V4: versions of each document, newest first, with their place and whether they are the latest."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("version_id"))
    return versions.withColumn("nth", F.row_number().over(w)).withColumn("is_latest", F.col("nth") == 1)


def attempt_history(operations: DataFrame, attempts: DataFrame) -> DataFrame:
    """V5: attempts of each operation, newest first, as one list."""
    each = F.struct("created_at", "attempt_id", "status")
    listed = attempts.groupBy("operation_id").agg(F.sort_array(F.collect_list(each), asc=False).alias("attempts"))
    joined = operations.select("operation_id").join(listed, "operation_id", "left")
    said = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["attempt_id"].cast("string"), a["status"])), ",")
    return joined.select("operation_id", F.coalesce(F.size("attempts"), F.lit(0)).alias("n_attempts"), F.coalesce(said, F.lit("")).alias("attempts"))


def string_of(value) -> str | None:
    """A string of a pandas column, or None."""
    return None if pd.isna(value) else value


Event = namedtuple("Event", ["seq", "kind", "operation", "expected", "attempt"])


class LibraryState:
    """A document's revision, latest operation and attempt, and the outcome of each event by the rules of ``activate``."""

    def __init__(self, revision=0, retired=False, operation=None, expected=-1, attempt=None):
        self.revision, self.retired, self.operation, self.expected, self.attempt = revision, retired, operation, expected, attempt

    def kept(self) -> tuple:
        return int(self.revision), bool(self.retired), self.operation, int(self.expected), self.attempt

    def after(self, e) -> str:
        operation, attempt = string_of(e.operation), string_of(e.attempt)
        if e.kind == "accept":
            if self.retired or e.expected != self.revision:
                return "document_unavailable" if self.retired else "document_changed"
            self.operation, self.expected, self.attempt = operation, int(e.expected), attempt
            return "accepted"
        if e.kind == "attempt":
            if operation != self.operation:
                return "retry_obsolete"
            self.attempt = attempt
            return "retried"
        if e.kind == "activate":
            wins = not self.retired and operation == self.operation and self.expected == self.revision and attempt == self.attempt
            self.revision += wins
            return "activated" if wins else "publication_conflict"
        if e.kind == "retire" and not self.retired:
            self.retired, self.revision = True, self.revision + 1
            return "retired"
        return "unchanged"


class Activations(Fold):
    """V6: the state of a document's library entry."""

    def __init__(self):
        self.state = LibraryState()

    def row(self, document_id, *values):
        outcome = self.state.after(Event(*values))
        return [(document_id, values[0], outcome, int(self.state.revision))]

    def close(self):
        return []


def activate(events: DataFrame) -> DataFrame:
    """V6: events of documents (document_id, seq, kind, operation, expected, attempt) with outcome and revision after each.

    kind accept: an operation becomes the document's latest if it is live and at the revision expected. attempt: an operation gets a
    newer attempt. activate: wins if the operation is the document's latest, its expected revision still holds and the attempt is its latest; then the
    revision goes up. retire: ends the document. A document's events are sorted and stream by; a task holds one state and a batch of rows, however
    many events a document has.
    """
    own = events.select("document_id", *Event._fields)
    schema = T.StructType([*fields(own, "document_id"), T.StructField("seq", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("revision", T.IntegerType())])
    return fold(own, ["document_id"], list(Event._fields), schema, Activations)


def activation_gate(attempts: DataFrame) -> DataFrame:
    """V7: attempts (attempt_id, version_id, manifests map, extraction_digest, tree_digest) with the failure that stops their activation."""
    failure = F.lit(None).cast("string")
    m = F.col("manifests")
    digests = (m["extraction"]["digest"] != F.col("extraction_digest")) | (m["summaries"]["digest"] != F.col("tree_digest"))
    failure = F.when(digests, "artifact_manifest_mismatch")
    for stage in reversed(STAGES):
        ok = F.coalesce(m[stage]["valid"] & (m[stage]["source_version"] == F.col("version_id")), F.lit(False))
        failure = F.when(~ok, f"required_stage_missing:{stage}").otherwise(failure)
    return attempts.select("attempt_id", failure.alias("failure"))


def reuse_extraction(attempts: DataFrame, extractions: DataFrame, revision: str) -> DataFrame:
    """V8: whether an attempt's extraction stage can be taken over: valid, of this source and extractor, and equal to what is stored."""
    m = F.col("manifests")["extraction"]
    joined = attempts.join(extractions.select("version_id", F.col("digest").alias("stored_digest")), "version_id", "left")
    ok = m["valid"] & (m["source_version"] == F.col("version_id")) & (m["compatibility"] == revision) & (m["digest"] == F.col("stored_digest"))
    return joined.select("attempt_id", F.coalesce(ok, F.lit(False)).alias("reusable"))


def retry_eligibility(operations: DataFrame, documents: DataFrame) -> DataFrame:
    """V9: operations with eligible, retry_obsolete or retry_not_available."""
    joined = operations.join(documents.select("document_id", "retired_at", "latest_operation", "library_revision"), "document_id")
    old = F.col("retired_at").isNotNull() | (F.col("latest_operation") != F.col("operation_id")) | (F.col("library_revision") != F.col("expected_revision"))
    return joined.select(
        "operation_id", F.when(old, "retry_obsolete").when(~F.col("status").isin("failed", "interrupted"), "retry_not_available").otherwise("eligible").alias("retry")
    )


def resolve_index(requests: DataFrame, documents: DataFrame, indexes: DataFrame) -> DataFrame:
    """Index of each request (request_id, document_id, version_id, pinned_index): pinned, else effective, else the version's newest."""
    newest = latest(indexes, ["version_id"], F.desc("created_at"), F.desc("index_id")).select("version_id", F.col("index_id").alias("newest"))
    joined = requests.join(documents.select("document_id", "effective_version", "effective_index"), "document_id", "left").join(newest, "version_id", "left")
    effective = F.when(F.col("version_id") == F.col("effective_version"), F.col("effective_index"))
    return joined.select("request_id", "version_id", F.coalesce("pinned_index", effective, "newest").alias("index_id"))


def close_interrupted(df: DataFrame, active: tuple[str, ...] = ACTIVE_WORK) -> DataFrame:
    """Unfinished work as interrupted, with its reason."""
    open_ = F.col("status").isin(*active)
    return df.withColumns({"reason": F.when(open_, "application_restarted").otherwise(F.col("reason")), "status": F.when(open_, "interrupted").otherwise(F.col("status"))})


def retired_history(references: DataFrame, documents: DataFrame) -> DataFrame:
    """References with ``readable`` (still resolvable) and ``barred`` (no new reads): the document is retired or has no effective version."""
    joined = references.join(documents.select("document_id", "retired_at", "effective_version", F.lit(True).alias("there")), "document_id", "left")
    there = F.col("there").isNotNull()
    return joined.select("reference_id", "document_id", there.alias("readable"), (~there | F.col("retired_at").isNotNull() | F.col("effective_version").isNull()).alias("barred"))


def conversation_listing(conversations: DataFrame, runs: DataFrame) -> DataFrame:
    """Live conversations with their place (newest first) and whether a run is active."""
    busy = runs.where(F.col("status").isin(*ACTIVE_RUN)).select("conversation_id", F.lit(True).alias("active")).distinct()
    live = conversations.where("deleted_at is null").join(busy, "conversation_id", "left")
    return live.select("conversation_id", "name", "updated_at", F.coalesce("active", F.lit(False)).alias("busy")).orderBy(F.desc("updated_at"), "conversation_id")


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE_RUN)

"""Queries of the library and its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.operators import library
from folio.plans.derived import cte, derive
from folio.plans.registry import query
from folio.sources import tables

V1 = f"""WITH {cte('library', 'operations', 'attempts', 'versions', 'indexes')}, listing AS (
  SELECT d.document_id, d.name, o.status, o.stage, v.page_count, coalesce(i.mode, a.mode) AS mode, d.effective_version IS NOT NULL AND d.effective_index IS NOT NULL AS ready
  FROM library d JOIN operations o ON o.operation_id = d.latest_operation JOIN attempts a ON a.attempt_id = o.latest_attempt
    JOIN versions v ON v.version_id = coalesce(d.effective_version, d.latest_version) LEFT JOIN indexes i ON i.index_id = d.effective_index
  WHERE d.retired_at IS NULL
)"""


def listing(spark, sf_dir) -> DataFrame:
    return library.library_listing(*(derive(spark, sf_dir, n) for n in ("library", "operations", "attempts", "versions", "indexes")))


@query("V1_library_listing", f"{V1} SELECT * FROM listing")
def v1(spark, sf_dir):
    return listing(spark, sf_dir)


@query("V2_keyset_page", f"{V1} SELECT document_id, name, (SELECT document_id FROM listing WHERE document_id > 100 ORDER BY document_id LIMIT 1 OFFSET 19) AS next_cursor FROM listing WHERE document_id > 100 ORDER BY document_id LIMIT 20")
def v2(spark, sf_dir):
    return library.keyset_page(listing(spark, sf_dir).select("document_id", "name"), "document_id", 100, 20)


@query(
    "V3_dedupe_submissions",
    """WITH s AS (SELECT user_id % 20 AS owner, event_id % 300 AS submission, event_id AS ts, event_id AS id, event_type AS a, user_id % 2 AS b FROM events),
    w AS (SELECT *, row_number() OVER x AS nth, first_value(a) OVER x AS fa, first_value(b) OVER x AS fb, first_value(id) OVER x AS first_id FROM s WINDOW x AS (PARTITION BY owner, submission ORDER BY ts, id))
    SELECT owner, submission, id, first_id, CASE WHEN nth = 1 THEN 'created' WHEN a = fa AND b = fb THEN 'repeated' ELSE 'submission_payload_changed' END AS outcome FROM w""",
)
def v3(spark, sf_dir):
    e = tables.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    subs = e.selectExpr("user_id % 20 AS owner", "event_id % 300 AS submission", "event_id AS ts", "event_id AS id", "event_type AS a", "user_id % 2 AS b")
    return library.dedupe_submissions(subs, ["a", "b"])


@query("V4_version_history", f"WITH {cte('versions')} SELECT document_id, version_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC) AS nth, created_at = 2 AS is_latest FROM versions")
def v4(spark, sf_dir):
    return library.version_history(derive(spark, sf_dir, "versions")).select("document_id", "version_id", "nth", "is_latest")


@query("V5_attempt_history", f"WITH {cte('operations', 'attempts')} SELECT o.operation_id, count(a.attempt_id) AS n_attempts, coalesce(string_agg(a.attempt_id || ':' || a.status, ',' ORDER BY a.created_at DESC), '') AS attempts FROM operations o LEFT JOIN attempts a USING (operation_id) GROUP BY o.operation_id")
def v5(spark, sf_dir):
    return library.attempt_history(derive(spark, sf_dir, "operations"), derive(spark, sf_dir, "attempts"))


ACTIVATE = f"""WITH RECURSIVE {cte('library_events')}, e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS n FROM library_events),
s AS (
  SELECT document_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, 0 AS revision, false AS retired, CAST(NULL AS VARCHAR) AS operation, -1 AS expected, CAST(NULL AS VARCHAR) AS attempt, CAST('' AS VARCHAR) AS outcome FROM e WHERE n = 1
  UNION ALL
  SELECT document_id, n, seq, revision + CAST(won OR ends AS INT), retired OR ends, CASE WHEN takes THEN new_operation ELSE operation END, CASE WHEN takes THEN new_expected ELSE expected END,
    CASE WHEN takes OR again THEN new_attempt ELSE attempt END,
    CASE WHEN takes THEN 'accepted' WHEN kind = 'accept' THEN CASE WHEN retired THEN 'document_unavailable' ELSE 'document_changed' END WHEN again THEN 'retried' WHEN kind = 'attempt' THEN 'retry_obsolete'
      WHEN won THEN 'activated' WHEN kind = 'activate' THEN 'publication_conflict' WHEN ends THEN 'retired' ELSE 'unchanged' END
  FROM (
    SELECT s.document_id, e.n, e.seq, e.kind, s.revision, s.retired, s.operation, s.expected, s.attempt, e.operation AS new_operation, e.expected AS new_expected, e.attempt AS new_attempt,
      e.kind = 'accept' AND NOT s.retired AND e.expected = s.revision AS takes, e.kind = 'attempt' AND e.operation IS NOT DISTINCT FROM s.operation AS again,
      e.kind = 'activate' AND NOT s.retired AND e.operation IS NOT DISTINCT FROM s.operation AND s.expected = s.revision AND e.attempt IS NOT DISTINCT FROM s.attempt AS won, e.kind = 'retire' AND NOT s.retired AS ends
    FROM s JOIN e ON e.document_id = s.document_id AND e.n = s.n + 1
  )
)
SELECT document_id, seq, outcome, revision FROM s WHERE n > 0"""


@query("V6_activate", ACTIVATE)
def v6(spark, sf_dir):
    return library.activate(derive(spark, sf_dir, "library_events"))


def manifested(spark, sf_dir) -> DataFrame:
    """Attempts with the manifests of their stages; some stages are missing, invalid, of another version or of other contents."""
    a = derive(spark, sf_dir, "attempts")
    entries = []
    for i, stage in enumerate(library.STAGES):
        ok = F.struct(
            (F.col("doc_id") % 7 != i).alias("valid"), F.when(F.col("doc_id") % 13 == i, "other").otherwise(F.col("version_id")).alias("source_version"),
            F.when(F.col("doc_id") % 5 == 4, "old").otherwise("new").alias("compatibility"), F.concat(F.lit(f"{stage[0]}"), (F.col("doc_id") % 3).cast("string")).alias("digest"),
        )
        entries.append(F.when(F.col("created_at") % 4 != i, F.struct(F.lit(stage).alias("key"), ok.alias("value"))))
    digest = lambda c: F.concat(F.lit(c), (F.col("doc_id") % 3 + (F.col("doc_id") % 11 == 0).cast("int")).cast("string"))
    return a.select("attempt_id", "version_id", "doc_id", F.map_from_entries(F.array_compact(F.array(*entries))).alias("manifests"), digest("e").alias("extraction_digest"), digest("s").alias("tree_digest"))


def _gate() -> str:
    out = "CASE"
    for i, stage in enumerate(library.STAGES):
        out += f" WHEN created_at % 4 = {i} OR doc_id % 7 = {i} OR doc_id % 13 = {i} THEN 'required_stage_missing:{stage}'"
    return out + " WHEN doc_id % 11 = 0 THEN 'artifact_manifest_mismatch' END"


@query("V7_activation_gate", f"WITH {cte('attempts')} SELECT attempt_id, {_gate()} AS failure FROM attempts")
def v7(spark, sf_dir):
    return library.activation_gate(manifested(spark, sf_dir))


@query("V8_reuse_extraction", f"WITH {cte('attempts')} SELECT attempt_id, created_at % 4 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 5 <> 4 AND doc_id % 11 <> 0 AND doc_id % 10 <> 0 AS reusable FROM attempts")
def v8(spark, sf_dir):
    attempts = manifested(spark, sf_dir)
    stored = attempts.where("doc_id % 10 <> 0").select("version_id", F.col("extraction_digest").alias("digest")).distinct()
    return library.reuse_extraction(attempts, stored, "new")


@query(
    "V9_retry_eligibility",
    f"""WITH {cte('library', 'operations')} SELECT operation_id, CASE WHEN retired_at IS NOT NULL OR latest_operation <> operation_id OR library_revision <> expected_revision THEN 'retry_obsolete'
      WHEN status NOT IN ('failed', 'interrupted') THEN 'retry_not_available' ELSE 'eligible' END AS retry FROM operations JOIN library USING (document_id)""",
)
def v9(spark, sf_dir):
    return library.retry_eligibility(derive(spark, sf_dir, "operations"), derive(spark, sf_dir, "library"))


@query(
    "V10_resolve_index",
    f"""WITH {cte('library', 'indexes', 'versions')}, r AS (SELECT version_id AS request_id, document_id, version_id, CASE WHEN document_id % 8 = 1 THEN concat('i', CAST(document_id * 10 + 2 AS STRING)) END AS pinned FROM versions),
    newest AS (SELECT version_id, arg_max(index_id, created_at) AS index_id FROM indexes GROUP BY version_id)
    SELECT r.request_id, r.version_id, coalesce(pinned, CASE WHEN r.version_id = d.effective_version THEN d.effective_index END, n.index_id) AS index_id
    FROM r LEFT JOIN library d USING (document_id) LEFT JOIN newest n ON n.version_id = r.version_id""",
)
def v10(spark, sf_dir):
    v = derive(spark, sf_dir, "versions")
    pinned = F.when(F.col("document_id") % 8 == 1, F.concat(F.lit("i"), (F.col("document_id") * 10 + 2).cast("string")))
    requests = v.select(F.col("version_id").alias("request_id"), "document_id", "version_id", pinned.alias("pinned_index"))
    return library.resolve_index(requests, derive(spark, sf_dir, "library"), derive(spark, sf_dir, "indexes"))


@query("V11_close_interrupted", f"WITH {cte('operations')} SELECT operation_id, CASE WHEN status IN ('queued', 'processing') THEN 'interrupted' ELSE status END AS status, CASE WHEN status IN ('queued', 'processing') THEN 'application_restarted' ELSE reason END AS reason FROM operations")
def v11(spark, sf_dir):
    return library.close_interrupted(derive(spark, sf_dir, "operations")).select("operation_id", "status", "reason")


@query(
    "V12_retired_history",
    f"""WITH {cte('library', 'runs')} SELECT run_id AS reference_id, d1 AS document_id, d.document_id IS NOT NULL AS readable, d.document_id IS NULL OR d.retired_at IS NOT NULL OR d.effective_version IS NULL AS barred
    FROM runs LEFT JOIN library d ON d.document_id = runs.d1""",
)
def v12(spark, sf_dir):
    refs = derive(spark, sf_dir, "runs").select(F.col("run_id").alias("reference_id"), F.col("d1").alias("document_id"))
    return library.retired_history(refs, derive(spark, sf_dir, "library"))


CONVERSATIONS = "SELECT conv_id AS conversation_id, concat('Talk ', CAST(conv_id AS STRING)) AS name, max(turn) * 1000 + conv_id % 97 AS updated_at, CASE WHEN conv_id % 9 = 0 THEN 1 END AS deleted_at FROM {conversations} GROUP BY conv_id"


@query(
    "V13_conversation_listing",
    f"""WITH {cte('runs')}, c AS ({CONVERSATIONS.format(conversations='conversations')}) SELECT conversation_id, name, updated_at,
      conversation_id IN (SELECT conversation_id FROM runs WHERE status IN ('queued', 'running', 'stopping')) AS busy FROM c WHERE deleted_at IS NULL""",
)
def v13(spark, sf_dir):
    convs = spark.sql(CONVERSATIONS.format(conversations=f"parquet.`{sf_dir}/conversations.parquet`"))
    return library.conversation_listing(convs, derive(spark, sf_dir, "runs"))

"""Queries of reads, runs and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.operators import reading, trees
from folio.plans.derived import PAGES, TREE, cte, derive, lines, long_lines, one_a_page, pages
from folio.plans.registry import query
from folio.sources import tables


def runs(spark, sf_dir) -> DataFrame:
    return derive(spark, sf_dir, "runs").withColumn("document_ids", F.array("d1", "d2"))


LIVE = "retired_at IS NULL AND effective_version IS NOT NULL AND effective_index IS NOT NULL AND page_count > 0"


@query(
    "R1_resolve_scope",
    f"""WITH {cte('library', 'runs')}, live AS (SELECT *, concat(CAST(document_id AS STRING), '/', effective_version, '/', effective_index) AS pin FROM library WHERE {LIVE}),
    w AS (SELECT DISTINCT run_id, d FROM (SELECT run_id, d1 AS d FROM runs WHERE mode = 'selected' UNION ALL SELECT run_id, d2 FROM runs WHERE mode = 'selected')),
    s AS (SELECT w.run_id, bool_and(l.pin IS NOT NULL) AS ok, string_agg(l.pin, ',' ORDER BY l.pin) AS pins FROM w LEFT JOIN live l ON l.document_id = w.d GROUP BY w.run_id)
    SELECT r.run_id, CASE WHEN mode = 'selected' AND NOT coalesce(ok, false) THEN 'selected_document_unavailable' END AS failure, CASE WHEN mode = 'selected' AND coalesce(ok, false) THEN pins ELSE '' END AS pins
    FROM runs r LEFT JOIN s USING (run_id)""",
)
def r1(spark, sf_dir):
    return reading.resolve_scope(runs(spark, sf_dir), derive(spark, sf_dir, "library"))


# each run reads two of its documents and one beyond; some name a version
READS = """reads AS (
  SELECT run_id * 4 + {k} AS read_id, run_id, CASE {k} WHEN 0 THEN d1 WHEN 1 THEN d2 ELSE (d1 + 3) % n_docs END AS document_id, turn * 10 + {k} AS ts,
    CASE WHEN (run_id + {k}) % 4 = 0 THEN concat('v', CAST((CASE {k} WHEN 0 THEN d1 WHEN 1 THEN d2 ELSE (d1 + 3) % n_docs END) * 10 + 1 + run_id % 2 AS STRING)) END AS version_id
  FROM {runs}
)"""


def reads_sql(source: str) -> str:
    return "\nUNION ALL\n".join(READS.format(k=k, runs=source).removeprefix("reads AS (").rstrip()[:-1] for k in range(3))


READ_CTE = f"{cte('library', 'runs')}, reads AS ({reads_sql('runs')}), pins AS (SELECT run_id, d1 AS document_id, concat('v', CAST(d1 * 10 + 1 AS STRING)) AS version_id FROM runs WHERE run_id % 2 = 0)"


def reads(spark, sf_dir) -> DataFrame:
    derive(spark, sf_dir, "runs").createOrReplaceTempView("folio_runs")
    return spark.sql(reads_sql("folio_runs"))


def pins(spark, sf_dir) -> DataFrame:
    return derive(spark, sf_dir, "runs").where("run_id % 2 = 0").select("run_id", F.col("d1").alias("document_id"), F.concat(F.lit("v"), (F.col("d1") * 10 + 1).cast("string")).alias("version_id"))


@query(
    "R2_bind_reads",
    f"""WITH {READ_CTE}, j AS (
      SELECT r.*, u.mode, u.d1, u.d2, d.retired_at, d.effective_version, d.effective_index, p.version_id AS pinned, d.document_id AS there
      FROM reads r JOIN runs u USING (run_id) LEFT JOIN library d ON d.document_id = r.document_id LEFT JOIN pins p ON p.run_id = r.run_id AND p.document_id = r.document_id
    ), g AS (
      SELECT *, CASE WHEN mode = 'selected' AND document_id <> d1 AND document_id <> d2 THEN 'document_out_of_scope' WHEN retired_at IS NOT NULL OR effective_version IS NULL OR effective_index IS NULL THEN 'document_unavailable'
        WHEN pinned IS NOT NULL AND version_id IS NOT NULL AND version_id <> pinned THEN 'run_version_mismatch'
        WHEN pinned IS NULL AND version_id IS NOT NULL AND version_id <> effective_version THEN 'historical_version_not_eligible' END AS reason FROM j
    ) SELECT read_id, CASE WHEN reason IS NULL THEN coalesce(pinned, version_id, effective_version) END AS bound, reason FROM g""",
)
def r2(spark, sf_dir):
    return reading.bind_reads(reads(spark, sf_dir), runs(spark, sf_dir), derive(spark, sf_dir, "library"), pins(spark, sf_dir))


@query("R3_first_read_pins", f"WITH {READ_CTE} SELECT read_id, run_id, document_id, first_value(version_id) OVER (PARTITION BY run_id, document_id ORDER BY ts, read_id) AS pinned FROM reads")
def r3(spark, sf_dir):
    return reading.first_read_pins(reads(spark, sf_dir)).select("read_id", "run_id", F.col("document_id"), "pinned")


@query(
    "R4_structure_page",
    f"""WITH {TREE}, j AS (
      SELECT doc_id, node, row_number() OVER (PARTITION BY doc_id ORDER BY node) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS total,
        length(concat('{{"node":', CAST(node AS VARCHAR), ',"start":', CAST(start AS VARCHAR), ',"end":', CAST("end" AS VARCHAR), ',"depth":', CAST(depth AS VARCHAR), ',"parent":', coalesce(CAST(parent AS VARCHAR), 'null'), '}}')) AS size FROM tree
    ), k AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM j WHERE pos >= 1 AND pos < 21),
    n AS (SELECT doc_id, count(*) FILTER (WHERE upto <= 600) AS taken FROM k GROUP BY doc_id)
    SELECT doc_id, CASE WHEN upto <= 600 THEN node END AS node, CASE WHEN upto <= 600 THEN pos END AS pos, CASE WHEN 1 + taken < total THEN 1 + taken END AS next_cursor, total
    FROM k JOIN n USING (doc_id) WHERE upto <= 600 OR pos = 1""",
)
def r4(spark, sf_dir):
    nodes = trees.build_tree(lines(spark, sf_dir)).select("doc_id", "node", "start", "end", "depth", "parent")
    return reading.structure_page(nodes, offset=1, limit=20, most=600)


# every document is asked for its first pages, one after the other and one that may not exist
ASK = "SELECT doc_id AS request_id, doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 0 END AS INT) AS off FROM {documents} WHERE text IS NOT NULL"


@query(
    "R5_page_slices",
    f"""WITH {PAGES}, q AS ({ASK.format(documents='documents')}), a AS (SELECT request_id, q.doc_id, off, pos, pos + 1 AS page FROM q, (SELECT unnest([0, 1, 2]) AS pos)),
    s AS (SELECT a.*, p.text, c.n_pages, CASE WHEN pos = 0 THEN off ELSE 0 END AS start FROM a LEFT JOIN page_text p ON p.doc_id = a.doc_id AND p.page = a.page LEFT JOIN page_counts c ON c.doc_id = a.doc_id),
    b AS (SELECT *, CASE WHEN page > coalesce(n_pages, 0) THEN 'page_out_of_bounds' WHEN text IS NULL THEN 'page_unavailable' WHEN start > length(text) THEN 'page_offset_out_of_bounds' END AS bad, coalesce(length(text) - start, 0) AS own FROM s),
    r AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY request_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
    o AS (SELECT *, arg_min(bad, pos) FILTER (WHERE bad IS NOT NULL) OVER (PARTITION BY request_id) AS failure, least(length(text), start + 1200 - before) AS e, max(pos) OVER (PARTITION BY request_id) AS last FROM r WHERE pos = 0 OR before < 1200)
    SELECT request_id, doc_id, pos, page, failure, CASE WHEN failure IS NULL THEN start END AS start, CAST(CASE WHEN failure IS NULL THEN e END AS INT) AS "end",
      CASE WHEN failure IS NULL THEN substr(text, start + 1, CAST(e - start AS BIGINT)) END AS slice, CASE WHEN failure IS NULL THEN e >= length(text) END AS complete,
      CASE WHEN failure IS NULL AND pos = last THEN CASE WHEN e < length(text) THEN pos WHEN pos < 2 THEN pos + 1 END END AS next_pos,
      CAST(CASE WHEN failure IS NULL AND pos = last THEN CASE WHEN e < length(text) THEN e WHEN pos < 2 THEN 0 END END AS INT) AS next_offset FROM o""",
)
def r5(spark, sf_dir):
    asked = spark.sql(ASK.format(documents=f"parquet.`{sf_dir}/documents.parquet`"))
    requests = asked.select("request_id", "doc_id", F.col("off").alias("offset"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("pages"))
    return reading.page_slices(requests, pages(spark, sf_dir), trees.page_counts(lines(spark, sf_dir)), budget=1200)


@query(
    "R6_structure_required",
    f"""WITH {one_a_page(PAGES)}, {READ_CTE}, s AS (SELECT run_id, document_id, min(ts) AS ts FROM reads WHERE read_id % 3 = 1 GROUP BY run_id, document_id)
    SELECT r.read_id, r.run_id, r.document_id AS doc_id FROM reads r JOIN page_counts c ON c.doc_id = r.document_id AND c.n_pages > 20 LEFT JOIN s ON s.run_id = r.run_id AND s.document_id = r.document_id
    WHERE r.read_id % 3 <> 1 AND (s.ts IS NULL OR s.ts > r.ts)""",
)
def r6(spark, sf_dir):
    own = reads(spark, sf_dir).withColumnRenamed("document_id", "doc_id")
    return reading.structure_required(own.where("read_id % 3 <> 1"), own.where("read_id % 3 = 1"), trees.page_counts(long_lines(spark, sf_dir)))


SLICES = f"""{PAGES}, {cte('runs')}, slices AS (
  SELECT r.run_id, CAST(p.page AS BIGINT) AS seq, p.doc_id, p.page, 0 AS start, least(length(p.text), 300) AS "end", CASE WHEN p.page % 4 = 0 THEN ' ' ELSE substr(p.text, 1, 300) END AS slice
  FROM runs r JOIN page_text p ON p.doc_id = r.d1
), refs AS (
  SELECT *, CASE WHEN trim(slice, ' ' || chr(10)) = '' THEN 'page_content_empty' WHEN row_number() OVER (PARTITION BY run_id, trim(slice, ' ' || chr(10)) = '' ORDER BY seq) > 3 THEN 'page_read_budget_exceeded' END AS reason FROM slices
)"""


def references(spark, sf_dir) -> DataFrame:
    joined = runs(spark, sf_dir).select("run_id", F.col("d1").alias("doc_id")).join(pages(spark, sf_dir), "doc_id")
    said = F.when(F.col("page") % 4 == 0, " ").otherwise(F.substring("text", 1, 300))
    slices = joined.select("run_id", F.col("page").cast("long").alias("seq"), "doc_id", "page", F.lit(0).alias("start"), F.least(F.length("text"), F.lit(300)).alias("end"), said.alias("slice"))
    return reading.issue_references(slices, 3)


@query("R7_issue_references", f"""WITH {SLICES} SELECT run_id, seq, doc_id, page, start, "end", CASE WHEN reason IS NULL THEN sha256(slice) END AS content_digest, reason FROM refs""")
def r7(spark, sf_dir):
    return references(spark, sf_dir)


# references issued, some of which then lose their run's pin, their original or their content
RESOLVED = SLICES + f""", {cte('versions')}, given AS (
  SELECT concat(CAST(run_id AS VARCHAR), '-', CAST(page AS VARCHAR)) AS reference_id, CASE WHEN run_id % 17 = 0 THEN -1 ELSE run_id END AS run_id, doc_id AS document_id, concat('v', CAST(doc_id * 10 + 1 AS VARCHAR)) AS version_id,
    CASE WHEN run_id % 19 = 0 THEN page + 500 ELSE page END AS page, start, "end", CASE WHEN run_id % 5 = 0 THEN 'x' ELSE sha256(slice) END AS content_digest FROM refs WHERE reason IS NULL
), judged AS (
  SELECT g.reference_id, g.run_id, g.document_id, g.version_id, g.page, CASE WHEN r.run_id IS NULL THEN 'reference_not_found' WHEN v.version_id IS NULL THEN 'source_not_found'
    WHEN g.run_id % 7 = 0 OR g.page > v.page_count + 200 OR (r.mode = 'selected' AND g.document_id <> r.d1 AND g.document_id <> r.d2) THEN 'reference_binding_invalid'
    WHEN p.text IS NULL THEN 'page_unavailable' WHEN g.document_id % 6 = 0 THEN 'reference_original_unavailable' WHEN sha256(substr(p.text, 1, g."end")) <> g.content_digest THEN 'reference_content_unavailable' END AS reason
  FROM given g LEFT JOIN runs r ON r.run_id = g.run_id LEFT JOIN versions v ON v.version_id = g.version_id LEFT JOIN page_text p ON p.doc_id = g.document_id AND p.page = g.page
)"""


def resolved(spark, sf_dir) -> DataFrame:
    version = F.concat(F.lit("v"), (F.col("doc_id") * 10 + 1).cast("string")).alias("version_id")
    issued = references(spark, sf_dir).where("reason is null")
    given = issued.select(
        F.concat_ws("-", F.col("run_id").cast("string"), F.col("page").cast("string")).alias("reference_id"), F.when(F.col("run_id") % 17 == 0, -1).otherwise(F.col("run_id")).alias("run_id"),
        F.col("doc_id").alias("document_id"), version, F.when(F.col("run_id") % 19 == 0, F.col("page") + 500).otherwise(F.col("page")).alias("page"), "start", "end",
        F.when(F.col("run_id") % 5 == 0, "x").otherwise(F.col("content_digest")).alias("content_digest"),
    )
    own_runs = runs(spark, sf_dir)
    own_pins = own_runs.where("run_id % 7 <> 0").select("run_id", F.col("d1").alias("document_id"), F.concat(F.lit("v"), (F.col("d1") * 10 + 1).cast("string")).alias("version_id"))
    versions = derive(spark, sf_dir, "versions").withColumn("page_count", F.col("page_count") + 200)
    text = pages(spark, sf_dir).select(version, "page", "text")
    originals = versions.where("document_id % 6 <> 0").select("version_id", "byte_length")
    return reading.resolve_references(given, own_runs, own_pins, versions, text, originals)


@query("R8_resolve_references", f"WITH {RESOLVED} SELECT reference_id, run_id, document_id, version_id, page, reason FROM judged")
def r8(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("R9_split_references", f"WITH {RESOLVED} SELECT reference_id, coalesce(reason, 'usable') AS reason FROM judged WHERE reason IS NULL OR reason IN ('page_unavailable', 'reference_original_unavailable', 'reference_content_unavailable')")
def r9(spark, sf_dir):
    good, issues = reading.split_references(resolved(spark, sf_dir))
    return good.select("reference_id", F.lit("usable").alias("reason")).unionByName(issues)


# an answer cites page 1 of its run's document; some cite nothing, some another run's page
ANSWER = "CASE WHEN {r} % 3 = 0 THEN 'no source' WHEN {r} % 11 = 0 THEN concat('see [p](cite:', CAST({r} - 1000 AS {s}), '-1)') ELSE concat('see [p](cite:', CAST({r} AS {s}), '-1) and [q](cite:', CAST({r} AS {s}), '-2)') END"


@query(
    "R10_answer_gate",
    f"""WITH {RESOLVED}, a AS (SELECT run_id, CASE WHEN run_id % 6 = 0 THEN 'decline' ELSE 'answer' END AS outcome, {ANSWER.format(r='run_id', s='VARCHAR')} AS text FROM runs),
    c AS (SELECT run_id, unnest(x) AS ref, generate_subscripts(x, 1) AS pos FROM (SELECT run_id, regexp_extract_all(text, '\\]\\(cite:([^\\s)]+)\\)', 1) AS x FROM a)),
    w AS (SELECT c.run_id, c.pos, CASE WHEN j.run_id IS NULL THEN 'reference_not_found' WHEN j.reason IS NOT NULL THEN j.reason WHEN j.run_id <> c.run_id THEN 'citation_wrong_run' END AS wrong FROM c LEFT JOIN judged j ON j.reference_id = c.ref),
    f AS (SELECT run_id, count(*) AS n, arg_min(wrong, pos) FILTER (WHERE wrong IS NOT NULL) AS wrong FROM w GROUP BY run_id)
    SELECT a.run_id, coalesce(n, 0) AS n_cited, CASE WHEN outcome = 'answer' AND coalesce(n, 0) = 0 THEN 'answer_evidence_missing' ELSE wrong END AS failure FROM a LEFT JOIN f USING (run_id)""",
)
def r10(spark, sf_dir):
    own = derive(spark, sf_dir, "runs")
    answers = own.select("run_id", F.when(F.col("run_id") % 6 == 0, "decline").otherwise("answer").alias("outcome"), F.expr(ANSWER.format(r="run_id", s="STRING")).alias("text"))
    return reading.answer_gate(answers, resolved(spark, sf_dir))


@query(
    "R11_citation_links",
    f"""WITH {RESOLVED}, a AS (SELECT run_id, {ANSWER.format(r='run_id', s='VARCHAR')} AS text FROM runs),
    c AS (SELECT run_id, unnest(x) AS ref, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT run_id, regexp_extract_all(text, '\\]\\(cite:([^\\s)]+)\\)', 1) AS x FROM a))
    SELECT c.run_id AS message_id, c.pos, c.ref AS reference_id, CASE WHEN j.reference_id IS NOT NULL THEN concat('folio://source/', j.version_id, '/page/', CAST(j.page AS VARCHAR)) END AS link
    FROM c LEFT JOIN judged j ON j.reference_id = c.ref AND j.run_id = c.run_id AND j.reason IS NULL""",
)
def r11(spark, sf_dir):
    messages = derive(spark, sf_dir, "runs").select(F.col("run_id").alias("message_id"), "run_id", F.expr(ANSWER.format(r="run_id", s="STRING")).alias("text"))
    return reading.citation_links(messages, reading.split_references(resolved(spark, sf_dir))[0])


@query("R12_message_runs", "SELECT conv_id AS thread_id, turn AS pos, role, last_value(CASE WHEN role = 'user' THEN conv_id * 1000 + turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id FROM conversations")
def r12(spark, sf_dir):
    turns = tables.read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return reading.message_runs(turns.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "role", F.when(F.col("role") == "user", F.col("conv_id") * 1000 + F.col("turn")).alias("run_id")))


@query(
    "R13_budget_violations",
    f"""WITH {cte('calls')}, c AS (SELECT run_id, seq, CASE WHEN lane IN ('view', 'click') THEN 'model' WHEN lane = 'error' THEN 'tool' ELSE 'page' END AS kind, k AS chars, k * 10 AS context, CAST(elapsed_ms * 100 AS BIGINT) AS ms FROM calls),
    s AS (SELECT run_id, seq, kind, context, count(*) FILTER (WHERE kind = 'model') OVER w AS m, count(*) FILTER (WHERE kind = 'tool') OVER w AS t, count(*) FILTER (WHERE kind = 'page') OVER w AS p, sum(chars) OVER w AS c, sum(ms) OVER w AS e FROM c WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
    v AS (SELECT run_id, seq, CASE WHEN e > 60000 THEN 'elapsed_budget_exceeded' WHEN m > 20 THEN 'model_call_budget_exceeded' WHEN kind = 'model' AND context > 980 THEN 'context_budget_exceeded' WHEN t > 6 THEN 'tool_call_budget_exceeded' WHEN p > 15 THEN 'page_read_budget_exceeded' WHEN c > 1200 THEN 'output_budget_exceeded' END AS violation FROM s)
    SELECT run_id, min(seq) AS seq, arg_min(violation, seq) AS violation FROM v WHERE violation IS NOT NULL GROUP BY run_id""",
)
def r13(spark, sf_dir):
    c = derive(spark, sf_dir, "calls")
    kind = F.when(F.col("lane").isin("view", "click"), "model").when(F.col("lane") == "error", "tool").otherwise("page")
    calls = c.select("run_id", "seq", kind.alias("kind"), F.col("k").alias("output_chars"), (F.col("k") * 10).alias("context_chars"), F.expr("CAST(round(elapsed_ms * 100) AS BIGINT)").alias("elapsed_ms"))
    return reading.budget_violations(calls, model_calls=20, tool_calls=6, pages=15, output_chars=1200, elapsed_ms=60000, context_chars=980)


@query(
    "R14_settle_runs",
    f"""WITH {cte('runs')}, r AS (SELECT run_id, status, CASE WHEN run_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS finished, question FROM runs)
    SELECT run_id, CASE WHEN status = 'stopping' AND finished = 'completed' THEN 'stopped' ELSE finished END AS status, CASE WHEN status = 'stopping' AND finished = 'completed' THEN 'owner_stopped' END AS reason,
      CASE WHEN NOT (status = 'stopping' AND finished = 'completed') THEN question END AS result FROM r""",
)
def r14(spark, sf_dir):
    own = derive(spark, sf_dir, "runs").select("run_id", "status", F.when(F.col("run_id") % 2 == 0, "completed").otherwise("failed").alias("finished"), F.lit(None).cast("string").alias("reason"), F.col("question").alias("result"))
    return reading.settle_runs(own)


@query(
    "R15_append_messages",
    """WITH t AS (SELECT conv_id AS thread_id, turn AS pos, concat('m', CAST(turn AS VARCHAR)) AS message_id FROM conversations WHERE turn < 2),
    n AS (SELECT conv_id AS thread_id, turn AS pos, concat('m', CAST(turn - turn % 2 AS VARCHAR)) AS message_id FROM conversations WHERE turn >= 1),
    fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, message_id ORDER BY pos) AS nth FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.thread_id = n.thread_id AND t.message_id = n.message_id)) WHERE nth = 1)
    SELECT thread_id, pos, message_id FROM t UNION ALL
    SELECT f.thread_id, CAST(coalesce((SELECT max(pos) + 1 FROM t WHERE t.thread_id = f.thread_id), 0) + row_number() OVER (PARTITION BY f.thread_id ORDER BY f.pos) - 1 AS INT), f.message_id FROM fresh f""",
)
def r15(spark, sf_dir):
    turns = tables.read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    base = turns.select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("int").alias("pos"), "role", "text")
    threads = base.where("pos < 2").withColumn("message_id", F.concat(F.lit("m"), F.col("pos").cast("string")))
    new = base.where("pos >= 1").withColumn("message_id", F.concat(F.lit("m"), (F.col("pos") - F.col("pos") % 2).cast("string")))
    return reading.append_messages(threads, new)[0].select("thread_id", "pos", "message_id")


@query(
    "R16_runs_by_thread",
    f"""WITH {cte('runs')} SELECT conversation_id AS thread_id, run_id, status, row_number() OVER (PARTITION BY conversation_id ORDER BY run_id % 7, run_id) AS nth,
      status = 'running' AND row_number() OVER (PARTITION BY conversation_id, status ORDER BY run_id % 7 DESC, run_id DESC) = 1 AS is_active FROM runs""",
)
def r16(spark, sf_dir):
    own = derive(spark, sf_dir, "runs")
    record = F.to_json(F.struct("status", (F.col("run_id") % 7).alias("startedAt")))
    return reading.runs_by_thread(own.select(F.col("conversation_id").alias("thread_id"), "run_id", record.alias("record")))


@query(
    "R17_admit_questions",
    f"""WITH {cte('runs')}, q AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC, run_id) AS nth FROM runs WHERE run_id % 5 <> 0)
    SELECT conversation_id, run_id AS question_id, CASE WHEN nth = 1 AND conversation_id NOT IN (SELECT conversation_id FROM runs WHERE run_id % 5 = 0 AND status IN ('queued', 'running', 'stopping')) THEN 'admitted' ELSE 'conversation_busy' END AS outcome FROM q""",
)
def r17(spark, sf_dir):
    own = derive(spark, sf_dir, "runs")
    questions = own.where("run_id % 5 <> 0").select("conversation_id", F.col("run_id").alias("question_id"), (-F.col("turn")).alias("ts"))
    return reading.admit_questions(questions, own.where("run_id % 5 = 0"))

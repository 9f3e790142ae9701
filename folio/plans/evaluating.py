"""Queries of evaluation analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.operators import evaluation, layout, trees
from folio.plans.derived import PAGES, TREE, cte, derive, lines, pages
from folio.plans.registry import query
from folio.sources import tables

IMPORTS = f"""{cte('imports')}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, file ORDER BY report DESC) AS nth FROM imports) WHERE nth = 1)"""


def latest(spark, sf_dir) -> DataFrame:
    return evaluation.latest_results(derive(spark, sf_dir, "imports"), ["mode", "file"])


@query("E1_latest_results", f"WITH {IMPORTS} SELECT mode, file, report, status FROM latest")
def e1(spark, sf_dir):
    return latest(spark, sf_dir).select("mode", "file", "report", "status")


@query(
    "E2_flatten_tree",
    f"""WITH {PAGES} SELECT doc_id AS tree_id, concat('p', CAST(page AS VARCHAR)) AS title, 0 AS depth, page AS start, page AS "end",
      CAST(page - 1 + (SELECT count(*) FROM lines l WHERE l.doc_id = p.doc_id AND l.page < p.page) AS INT) AS ord FROM page_text p
    UNION ALL SELECT doc_id, concat('l', CAST(ord AS VARCHAR)), 1, page, page, CAST(page - 1 + 1 + (SELECT count(*) FROM lines m WHERE m.doc_id = l.doc_id AND (m.page < l.page OR (m.page = l.page AND m.ord < l.ord))) AS INT) FROM lines l""",
)
def e2(spark, sf_dir):
    node = lambda title, kids: F.struct(title.alias("title"), F.col("page").alias("start_index"), F.col("page").alias("end_index"), F.lit("s").alias("summary"), *kids)
    leaves = lines(spark, sf_dir).groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("ord", node(F.concat(F.lit("l"), F.col("ord").cast("string")), []).alias("n")))).alias("kids")
    )
    kids = F.transform("kids", lambda k: k["n"]).alias("nodes")
    roots = leaves.select("doc_id", "page", node(F.concat(F.lit("p"), F.col("page").cast("string")), [kids]).alias("n"))
    nested = roots.groupBy(F.col("doc_id").alias("tree_id")).agg(F.array_sort(F.collect_list(F.struct("page", "n"))).alias("pages"))
    nested = nested.select("tree_id", F.transform("pages", lambda p: p["n"]).alias("nodes"))
    return evaluation.flatten_tree(nested).select("tree_id", "title", "depth", "start", "end", F.col("ord").cast("int").alias("ord"))


SHAPES = TREE + """, shaped AS (
  SELECT c.doc_id, c.n_pages, count(t.node) AS nodes, count(*) FILTER (WHERE t.depth = 0) AS roots, coalesce(max(t.depth), 0) AS max_depth, count(*) FILTER (WHERE t.start >= 1 AND t."end" >= t.start AND t."end" <= c.n_pages) AS valid_ranges,
    count(*) FILTER (WHERE t.node % 3 <> 0) AS summaries FROM page_counts c LEFT JOIN tree t USING (doc_id) GROUP BY c.doc_id, c.n_pages
), under AS (SELECT doc_id, CAST(count(DISTINCT p) AS INT) AS covered FROM (SELECT doc_id, unnest(range(start, "end" + 1)) AS p FROM tree) GROUP BY doc_id)"""


def shapes(spark, sf_dir) -> DataFrame:
    own = lines(spark, sf_dir)
    nodes = trees.build_tree(own).withColumn("summary", F.when(F.col("node") % 3 != 0, F.col("title")))
    return evaluation.tree_shape(nodes, trees.page_counts(own))


@query("E3_tree_shape", f"WITH {SHAPES} SELECT s.*, coalesce(covered, 0) AS covered, coalesce(covered, 0) = n_pages AS complete FROM shaped s LEFT JOIN under u USING (doc_id)")
def e3(spark, sf_dir):
    return shapes(spark, sf_dir)


MODES = ["flash", "standard"]
PAIRS = IMPORTS + """, ours AS (SELECT mode, file, sha256, status, CASE WHEN status <> 'ready' THEN concat('reason ', CAST(doc_id % 3 AS VARCHAR)) END AS reason FROM latest), theirs AS (
  SELECT mode, file, sha256, CASE WHEN status = 'ready' THEN 'completed' ELSE 'refused' END AS status, CASE WHEN status <> 'ready' THEN concat('error ', CAST(doc_id % 2 AS VARCHAR)) END AS error FROM imports WHERE report = 0 AND doc_id % 10 <> 0
), expected AS (SELECT DISTINCT concat('doc', CAST(doc_id AS VARCHAR)) AS file, 'h' AS sha256 FROM labels)"""


def pairs(spark, sf_dir) -> DataFrame:
    done = F.when(F.col("status") == "ready", "completed").otherwise("refused").alias("status")
    said = lambda word, n: F.when(F.col("status") != "ready", F.concat(F.lit(word), (F.col("doc_id") % n).cast("string")))
    theirs = derive(spark, sf_dir, "imports").where("report = 0 and doc_id % 10 <> 0").select("mode", "file", "sha256", done, said("error ", 2).alias("error"))
    expected = tables.read_table(spark, sf_dir, "labels", "doc_id").distinct().select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.lit("h").alias("sha256"))
    return evaluation.pair_records(latest(spark, sf_dir).withColumn("reason", said("reason ", 3)), theirs, expected, MODES)


PAIRED = PAIRS + """, pairs AS (
  SELECT m.mode, e.file, o.status AS our_status, o.reason AS our_reason, t.status AS their_status, t.error AS their_reason, CASE WHEN NOT (coalesce(o.sha256 = 'h', false) AND coalesce(t.sha256 = 'h', false)) THEN 'missing_or_mismatched_pair' END AS failure
  FROM expected e, (SELECT unnest(['flash', 'standard']) AS mode) m LEFT JOIN ours o ON o.mode = m.mode AND o.file = e.file LEFT JOIN theirs t ON t.mode = m.mode AND t.file = e.file
)"""


@query("E4_pair_records", f"WITH {PAIRED} SELECT * FROM pairs")
def e4(spark, sf_dir):
    return pairs(spark, sf_dir)


OTHER = "CASE WHEN doc_id % 4 = 1 AND page = 2 THEN concat(text, 'x') WHEN doc_id % 4 = 2 AND page = 1 THEN reverse(text) ELSE text END"


@query(
    "E5_compare_extraction",
    rf"""WITH {PAGES}, a AS (SELECT doc_id, page, regexp_replace(text, '\s', '', 'g') AS t FROM page_text), b AS (SELECT doc_id, page, regexp_replace({OTHER}, '\s', '', 'g') AS t FROM page_text WHERE NOT (doc_id % 4 = 3 AND page = 3)),
    j AS (SELECT doc_id, page, a.t AS x, b.t AS y, array_to_string(list_sort(string_split(coalesce(a.t, ''), '')), '') <> array_to_string(list_sort(string_split(coalesce(b.t, ''), '')), '') AS d FROM a FULL JOIN b USING (doc_id, page)),
    s AS (SELECT doc_id, count(x) AS nx, count(y) AS ny, coalesce(string_agg(x, '' ORDER BY page), '') AS ax, coalesce(string_agg(y, '' ORDER BY page), '') AS ay, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE d), '') AS differing FROM j GROUP BY doc_id)
    SELECT doc_id, ax <> '' AND ay <> '' AS both_extracted, nx = ny AS same_page_count, array_to_string(list_sort(string_split(ax, '')), '') = array_to_string(list_sort(string_split(ay, '')), '') AS same_characters, ax = ay AS same_order, differing FROM s""",
)
def e5(spark, sf_dir):
    own = lines(spark, sf_dir)
    own = tables.page_texts(tables.dealt(own, tables.parts_of(own), "doc_id", "page")).select("doc_id", "page", "text")
    other = own.where("not (doc_id % 4 = 3 and page = 3)").select("doc_id", "page", F.expr(OTHER).alias("text"))
    return evaluation.compare_extraction(own, other)


QUESTIONS = PAGES + """, questions AS (
  SELECT doc_id * 100000 + page AS question_id, doc_id, page + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS page, substr(text, 5, 40) AS passage FROM page_text
)"""


def questions(spark, sf_dir) -> DataFrame:
    return pages(spark, sf_dir).select(
        (F.col("doc_id") * 100000 + F.col("page")).alias("question_id"), "doc_id", (F.col("page") + (F.col("doc_id") % 4 == 0).cast("int")).alias("page"), F.substring("text", 5, 40).alias("passage")
    )


UNDER = """EXISTS (SELECT 1 FROM tree t WHERE t.doc_id = q.doc_id AND q.page BETWEEN t.start AND t."end" AND t.node % {n} = 0)
  AND EXISTS (SELECT 1 FROM latest i WHERE i.doc_id = q.doc_id AND i.mode = 'flash' AND i.status = '{status}')"""
REACHED = TREE + ", " + QUESTIONS.removeprefix(PAGES + ", ") + f""", {IMPORTS}, reached AS (
  SELECT q.question_id, coalesce(bool_or(contains(p.text, q.passage) AND {UNDER.format(n=2, status='ready')}), false) AS ours, coalesce(bool_or(contains(p.text, q.passage) AND {UNDER.format(n=3, status='failed')}), false) AS theirs
  FROM questions q LEFT JOIN page_text p ON p.doc_id = q.doc_id AND p.page = q.page GROUP BY q.question_id
)"""


@query(
    "E6_evidence_reachability",
    f"""WITH {REACHED} SELECT question_id, ours AS reachable FROM reached""",
)
def e6(spark, sf_dir):
    return reached(spark, sf_dir, lines(spark, sf_dir), "ready", 2)


@query("E6_paired_reachability", f"WITH {REACHED} SELECT question_id, ours, theirs FROM reached")
def e6b(spark, sf_dir):
    own = lines(spark, sf_dir)
    return evaluation.paired_reachability(reached(spark, sf_dir, own, "ready", 2), reached(spark, sf_dir, own, "failed", 3))


def reached(spark, sf_dir, own, status, every) -> DataFrame:
    """Reachability in a part of the trees, of documents whose latest import has a status."""
    accepted = latest(spark, sf_dir).where((F.col("mode") == "flash") & (F.col("status") == status))
    nodes = trees.build_tree(own).where(F.col("node") % every == 0)
    return evaluation.evidence_reachability(questions(spark, sf_dir), nodes, pages(spark, sf_dir), accepted)


@query(
    "E7_coverage_by_mode",
    f"""WITH {PAIRED} SELECT mode, count(*) AS denominator, count(*) FILTER (WHERE our_status = 'ready') AS ready, count(*) FILTER (WHERE our_status IS NOT NULL AND our_status <> 'ready') AS rejected,
      count(*) FILTER (WHERE their_status = 'completed') AS completed, count(*) FILTER (WHERE their_status IS NOT NULL AND their_status <> 'completed') AS their_rejected FROM pairs GROUP BY mode""",
)
def e7(spark, sf_dir):
    return evaluation.coverage_by_mode(pairs(spark, sf_dir))


@query("E7_rejected_records", f"WITH {PAIRED} SELECT mode, file, 'ours' AS side, our_status AS status, our_reason AS reason FROM pairs WHERE our_status <> 'ready' UNION ALL SELECT mode, file, 'theirs', their_status, their_reason FROM pairs WHERE their_status <> 'completed'")
def e7b(spark, sf_dir):
    return evaluation.rejected_records(pairs(spark, sf_dir))


@query(
    "E8_trial_history",
    f"""WITH {cte('imports')}, i AS (SELECT * FROM imports WHERE NOT (report = 1 AND mode = 'standard')), s AS (SELECT report, mode, count(*) AS observed, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE retried) AS earlier_failed FROM i GROUP BY report, mode)
    SELECT r.report, m.mode, coalesce(observed, 0) AS observed, coalesce(ready, 0) AS ready, coalesce(earlier_failed, 0) AS earlier_failed, coalesce(observed - ready, 0) AS rejected
    FROM (SELECT DISTINCT report FROM i) r CROSS JOIN (SELECT unnest(['flash', 'standard']) AS mode) m LEFT JOIN s ON s.report = r.report AND s.mode = m.mode""",
)
def e8(spark, sf_dir):
    return evaluation.trial_history(derive(spark, sf_dir, "imports").where("not (report = 1 and mode = 'standard')"), MODES)


TRIED = f"""{cte('imports')}, tried AS (SELECT *, CASE WHEN status <> 'ready' THEN concat('reason ', CAST(doc_id % 3 AS VARCHAR)) END AS reason, CASE WHEN retried THEN concat('failed ', CAST(doc_id % 2 AS VARCHAR)) END AS original_outcome FROM imports)"""


def tried(spark, sf_dir) -> DataFrame:
    reason = F.when(F.col("status") != "ready", F.concat(F.lit("reason "), (F.col("doc_id") % 3).cast("string")))
    outcome = F.when(F.col("retried"), F.concat(F.lit("failed "), (F.col("doc_id") % 2).cast("string")))
    return derive(spark, sf_dir, "imports").withColumns({"reason": reason, "original_outcome": outcome})


@query("E8_rejected_files", f"WITH {TRIED} SELECT report, mode, file, status, reason FROM tried WHERE status <> 'ready'")
def e8b(spark, sf_dir):
    return evaluation.rejected_files(tried(spark, sf_dir))


@query("E8_earlier_outcomes", f"WITH {TRIED} SELECT report, mode, file, original_outcome AS outcome FROM tried WHERE original_outcome IS NOT NULL")
def e8c(spark, sf_dir):
    return evaluation.earlier_outcomes(tried(spark, sf_dir))


@query(
    "E8_question_outcomes",
    f"""WITH {cte('runs')} SELECT run_id % 2 AS report, CASE WHEN turn % 2 = 0 THEN 'flash' ELSE 'standard' END AS mode, CAST(run_id AS VARCHAR) AS id, status,
      CASE WHEN run_id % 5 = 0 THEN 'own' WHEN run_id % 5 = 1 THEN 'result' WHEN run_id % 5 = 2 THEN 'why' END AS reason FROM runs""",
)
def e8d(spark, sf_dir):
    at = lambda n, word: F.when(F.col("run_id") % 5 == n, word)
    asked = derive(spark, sf_dir, "runs").select(
        (F.col("run_id") % 2).alias("report"), F.when(F.col("turn") % 2 == 0, "flash").otherwise("standard").alias("mode"), F.col("run_id").cast("string").alias("id"),
        F.when(F.col("run_id") % 3 == 0, F.col("status")).alias("status"), F.struct("status", at(1, "result").alias("reason")).alias("result"), at(0, "own").alias("reason"), at(2, "why").alias("why"),
    )
    return evaluation.question_outcomes(asked)


@query(
    "E9_qa_checks",
    f"""WITH {QUESTIONS}, q AS (SELECT *, substr(passage, 1, 10) AS fact, CASE WHEN question_id % 5 = 0 THEN 'decline' ELSE 'answer' END AS wanted FROM questions),
    r AS (SELECT question_id, 'answer' AS outcome, CASE WHEN question_id % 3 = 0 THEN 'nothing' ELSE passage END AS said, doc_id * 100000 + page AS ref FROM q)
    SELECT q.question_id, r.outcome = q.wanted AS expected_outcome, contains(lower(r.said), lower(q.fact)) AS lexical_facts, coalesce(contains(substr(p.text, 1, 30), substr(q.passage, 1, 20)), false) AS cited_expected_originals
    FROM q JOIN r USING (question_id) LEFT JOIN page_text p ON p.doc_id = q.doc_id AND p.page = q.page""",
)
def e9(spark, sf_dir):
    q = questions(spark, sf_dir)
    said = F.when(F.col("question_id") % 3 == 0, "nothing").otherwise(F.col("passage"))
    ref = (F.col("doc_id") * 100000 + F.col("page")).cast("string")
    runs = q.select("question_id", F.lit("answer").alias("outcome"), said.alias("text"), F.array(ref).alias("citations"))
    wanted = F.when(F.col("question_id") % 5 == 0, "decline").otherwise("answer").alias("outcome")
    evidence = F.array(F.struct("doc_id", F.array("page").alias("pages"), F.substring("passage", 1, 20).alias("passage"))).alias("evidence")
    expected = q.select("question_id", wanted, F.array(F.substring("passage", 1, 10)).alias("facts"), evidence)
    reads = pages(spark, sf_dir).select(ref.alias("reference_id"), "doc_id", "page", F.substring("text", 1, 30).alias("slice"))
    return evaluation.qa_checks(runs, expected, reads)


DISTRIBUTION = "count({v}) AS {p}count, min({v}) AS {p}min_ms, quantile_disc({v}, 0.5) AS {p}median_ms, quantile_disc({v}, 0.95) AS {p}p95_ms, max({v}) AS {p}max_ms"


@query("E10_latency_distribution", f"WITH {cte('calls')} SELECT lane, {DISTRIBUTION.format(v='elapsed_ms', p='')} FROM calls GROUP BY lane")
def e10(spark, sf_dir):
    return evaluation.latency_distribution(derive(spark, sf_dir, "calls"), ["lane"])


@query("E11_usage_totals", f"WITH {cte('calls')} SELECT run_id, count(input_tokens) AS records_with_usage, coalesce(sum(input_tokens), 0) AS inputTokens, coalesce(sum(output_tokens), 0) AS outputTokens FROM calls GROUP BY run_id")
def e11(spark, sf_dir):
    c = derive(spark, sf_dir, "calls")
    usage = F.when(F.col("input_tokens").isNotNull(), F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens")))
    return evaluation.usage_totals(c.select("run_id", usage.alias("usage")), ["run_id"])


def _sums(prefix: str, calls: str, tokens: str) -> str:
    return f"count({calls}) AS {prefix}with_usage, coalesce(sum({calls}), 0) AS \"{prefix}modelCalls\", coalesce(sum({tokens}), 0) AS \"{prefix}inputTokens\""


def _channel(channel: str, counted: str) -> str:
    return f"""(SELECT mode, count(*) AS {channel}_questions, count(*) FILTER (WHERE status = 'completed') AS {channel}_completed, {DISTRIBUTION.format(v='t', p=f'{channel}_')}, {_sums(f'{channel}_', 'calls', 'tokens')}
  FROM (SELECT *, CASE WHEN {counted} THEN elapsed_ms END AS t FROM o WHERE channel = '{channel}') GROUP BY mode)"""


ASKED = f"""{cte('runs')}, o AS (SELECT CASE WHEN run_id % 2 = 0 THEN 'flash' ELSE 'standard' END AS mode, CASE WHEN run_id % 10 = 1 THEN 'mcp' ELSE 'web' END AS channel, status, run_id % 977 * 1.0 AS elapsed_ms, run_id,
  CASE WHEN run_id % 3 <> 0 THEN run_id % 5 END AS calls, CASE WHEN run_id % 3 <> 0 THEN run_id % 50 END AS tokens FROM runs)"""
MEASURED = f"""WITH {IMPORTS}, {SHAPES}, {ASKED}, r AS (
  SELECT i.mode, i.status, i.elapsed_ms, s.nodes, s.valid_ranges, s.summaries, coalesce(u.covered, 0) = s.n_pages AS complete, i.doc_id % 5 <> 0 AS both_extracted, i.doc_id % 3 <> 0 AS same_pages, i.doc_id % 2 = 0 AS same_order,
    CASE WHEN i.status = 'ready' THEN i.elapsed_ms END AS t, CASE WHEN i.doc_id % 4 <> 0 THEN i.elapsed_ms + 5 END AS theirs, CASE WHEN i.doc_id % 6 <> 0 THEN i.doc_id % 7 END AS calls, CASE WHEN i.doc_id % 6 <> 0 THEN i.doc_id % 100 END AS tokens
  FROM latest i JOIN shaped s USING (doc_id) LEFT JOIN under u USING (doc_id)
),
a AS (SELECT mode, count(*) FILTER (WHERE status = 'ready') AS accepted, coalesce(bool_and(nodes = valid_ranges) FILTER (WHERE status = 'ready'), true) AS ranges_valid, coalesce(bool_and(complete) FILTER (WHERE status = 'ready'), true) AS pages_complete,
  coalesce(bool_and(nodes = summaries) FILTER (WHERE status = 'ready'), true) AS summaries_complete, count(*) FILTER (WHERE both_extracted) AS both_extracted, count(*) FILTER (WHERE both_extracted AND same_pages) AS characters_kept,
  count(*) FILTER (WHERE both_extracted AND same_order) AS order_kept, {DISTRIBUTION.format(v='t', p='')}, {DISTRIBUTION.format(v='theirs', p='their_')}, {_sums('index_', 'calls', 'tokens')} FROM r GROUP BY mode),
w AS {_channel('web', "status = 'completed'")}, m AS {_channel('mcp', 'true')},
c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'flash' ELSE 'standard' END AS mode, count(*) AS reach_total, count(*) FILTER (WHERE page % 2 = 0) AS reach_ours, count(*) FILTER (WHERE page % 3 = 0) AS reach_theirs FROM page_text GROUP BY 1)
SELECT * REPLACE ({', '.join(f"coalesce({x}, 0) AS {x}" for x in ('web_questions', 'web_completed', 'web_with_usage', 'mcp_questions', 'mcp_completed', 'mcp_with_usage', 'reach_total', 'reach_ours', 'reach_theirs'))})
FROM a LEFT JOIN w USING (mode) LEFT JOIN m USING (mode) LEFT JOIN c USING (mode)"""


def asked(spark, sf_dir) -> DataFrame:
    run = F.col("run_id")
    usage = F.when(run % 3 != 0, F.struct((run % 5).alias("modelCalls"), (run % 50).alias("inputTokens")))
    return derive(spark, sf_dir, "runs").select(
        F.when(run % 2 == 0, "flash").otherwise("standard").alias("mode"), F.when(run % 10 == 1, "mcp").otherwise("web").alias("channel"), "status", (run % 977 * 1.0).alias("elapsed_ms"),
        usage.alias("usage"), run.cast("string").alias("id"), F.when(F.col("status") == "completed", "answer").alias("outcome"), (run % 2).alias("report"), (run % 7 != 0).alias("lexical"),
    )


@query("E12_mode_measurements", MEASURED)
def e12(spark, sf_dir):
    doc = F.col("doc_id")
    usage = F.when(doc % 6 != 0, F.struct((doc % 7).alias("modelCalls"), (doc % 100).alias("inputTokens")))
    records = latest(spark, sf_dir).join(shapes(spark, sf_dir), "doc_id").select(
        "mode", "status", "nodes", "valid_ranges", "complete", "summaries", "elapsed_ms", (doc % 5 != 0).alias("both_extracted"), (doc % 3 != 0).alias("same_pages"), (doc % 2 == 0).alias("same_order"),
        F.when(doc % 4 != 0, "completed").otherwise("refused").alias("their_status"), (F.col("elapsed_ms") + 5).alias("their_elapsed_ms"), usage.alias("usage"),
    )
    reached = pages(spark, sf_dir).select(F.when(doc % 2 == 0, "flash").otherwise("standard").alias("mode"), (F.col("page") % 2 == 0).alias("ours"), (F.col("page") % 3 == 0).alias("theirs"))
    return evaluation.mode_measurements(records, asked(spark, sf_dir), reached)


@query("E12_question_rows", f"WITH {ASKED} SELECT mode, CAST(run_id AS VARCHAR) AS id, status, CASE WHEN status = 'completed' THEN 'answer' END AS outcome, run_id % 2 AS report, run_id % 7 <> 0 AS lexical FROM o WHERE channel = 'web'")
def e12b(spark, sf_dir):
    return evaluation.question_rows(asked(spark, sf_dir))


TOTALS = "count(*) AS calls, count(*) FILTER (WHERE input_tokens IS NULL) AS without_usage, count(*) FILTER (WHERE cancelled) AS cancellations, count(*) FILTER (WHERE error) AS errors, coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(output_tokens), 0) AS output_tokens"


@query("E13_ledger_summary", f"WITH {cte('calls')} SELECT ledger, {TOTALS} FROM calls GROUP BY ledger")
def e13(spark, sf_dir):
    return evaluation.ledger_summary(derive(spark, sf_dir, "calls"))


@query("E13_request_errors", f"WITH {cte('calls')} SELECT ledger, lane, seq, message FROM calls WHERE error")
def e13b(spark, sf_dir):
    return evaluation.request_errors(derive(spark, sf_dir, "calls"))


@query("E14_lane_summary", f"WITH {cte('calls')} SELECT ledger, lane, {TOTALS}, {DISTRIBUTION.format(v='elapsed_ms', p='')}, {DISTRIBUTION.format(v='first_ms', p='first_')} FROM calls GROUP BY GROUPING SETS ((ledger, lane), (ledger))")
def e14(spark, sf_dir):
    return evaluation.lane_summary(derive(spark, sf_dir, "calls"))


@query(
    "E15_accounting_intervals",
    f"""WITH {cte('calls')}, l AS (SELECT ledger AS pos, sum(k) AS observed_cost FROM calls GROUP BY ledger)
    SELECT pos, coalesce(sum(observed_cost) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous_cost, observed_cost, sum(observed_cost) OVER (ORDER BY pos) AS cumulative, pos = (SELECT max(pos) FROM l) AS is_final FROM l""",
)
def e15(spark, sf_dir):
    return evaluation.accounting_intervals(derive(spark, sf_dir, "calls").groupBy(F.col("ledger").alias("pos")).agg(F.sum("k").alias("observed_cost")))


@query("E16_title_page_matches", rf"""WITH {TREE}, o AS (SELECT doc_id, start + CASE WHEN node % 4 = 0 THEN 1 ELSE 0 END AS start, regexp_replace(upper(title), ' ', '') AS title FROM tree)
    SELECT doc_id, count(*) AS matching FROM tree t WHERE EXISTS (SELECT 1 FROM o WHERE o.doc_id = t.doc_id AND o.start = t.start AND regexp_replace(lower(o.title), '\s', '', 'g') = regexp_replace(lower(t.title), '\s', '', 'g')) GROUP BY doc_id""")
def e16(spark, sf_dir):
    own = trees.build_tree(lines(spark, sf_dir))
    other = own.select("doc_id", (F.col("start") + (F.col("node") % 4 == 0).cast("int")).alias("start"), F.upper("title").alias("title"))
    return evaluation.title_page_matches(own, other)


@query(
    "E17_call_costs",
    f"""WITH {cte('calls')}, s AS (SELECT run_id AS ledger, seq, ts, sum(k) OVER (PARTITION BY run_id ORDER BY ts, seq) AS cost FROM calls)
    SELECT ledger, seq, cost - lag(cost) OVER w AS cost_change, lag(100000 - cost) OVER w - (100000 - cost) AS balance_change FROM s WINDOW w AS (PARTITION BY ledger ORDER BY ts, seq)""",
)
def e17(spark, sf_dir):
    from pyspark.sql import Window

    # a ledger a run, so ledgers grow in number with the calls
    cost = F.sum("k").over(Window.partitionBy("run_id").orderBy("ts", "seq"))
    snapshots = derive(spark, sf_dir, "calls").select(F.col("run_id").alias("ledger"), "ts", "seq", cost.alias("cost"), (100000 - cost).alias("balance"))
    return evaluation.call_costs(snapshots)


# generic checks over the star schema: the library's quantiles and paging on other tables
@query("X1_upper_median", "SELECT o_custkey AS g, list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM orders GROUP BY 1")
def x1(spark, sf_dir):
    from folio.functions.text import upper_median

    own = tables.read_table(spark, sf_dir, "orders", "o_custkey", "o_totalprice")
    return own.groupBy(F.col("o_custkey").alias("g")).agg(upper_median(F.collect_list("o_totalprice"), 0.0).alias("median"))


@query("X2_nearest_rank", f"SELECT o_orderpriority, {DISTRIBUTION.format(v='o_totalprice', p='')} FROM orders GROUP BY o_orderpriority")
def x2(spark, sf_dir):
    own = tables.read_table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice")
    return evaluation.latency_distribution(own, ["o_orderpriority"], "o_totalprice")


@query("X3_keyset_page", "SELECT c_custkey, c_name, (SELECT c_custkey FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 1 OFFSET 24) AS next_cursor FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 25")
def x3(spark, sf_dir):
    from folio.operators.library import keyset_page

    return keyset_page(tables.read_table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", 50, 25)

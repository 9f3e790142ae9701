"""Evaluation analytics: reports to paired metrics."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions.text import sorted_chars, squeezed
from folio.sources.tables import dealt, latest, parts_of

USAGE = ("modelCalls", "toolCalls", "readPages", "inputTokens", "outputTokens")
#: Nearest ranks of a distribution.
RANKS = {"median_ms": 0.5, "p95_ms": 0.95}


def latest_results(records: DataFrame, keys: list[str], position: str = "report") -> DataFrame:
    """Of the records of a key, that of the latest report."""
    return latest(records, keys, F.desc(position))


def flatten_tree(nested: DataFrame) -> DataFrame:
    """Nested nodes (tree_id, nodes array of title, start_index, end_index, summary, nodes) to rows with depth, in pre-order.

    One ``explode`` for each level that the schema has; the path of positions orders parents before children.
    """
    level = nested.select("tree_id", F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), "nodes")
    out = None
    for d in count():
        rows = level.select("tree_id", "path", "depth", F.posexplode("nodes").alias("pos", "n"))
        rows = rows.select("tree_id", F.concat("path", F.array("pos")).alias("path"), "depth", "n")
        flat = rows.select("tree_id", "path", "depth", "n.title", F.col("n.start_index").alias("start"), F.col("n.end_index").alias("end"), "n.summary")
        out = flat if out is None else out.unionByName(flat)
        kind = dict((f.name, f.dataType) for f in rows.schema)["n"]
        if "nodes" not in kind.fieldNames():
            break
        level = rows.select("tree_id", "path", F.lit(d + 1).alias("depth"), F.col("n.nodes").alias("nodes"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("tree_id").orderBy("path")) - 1)


def tree_shape(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Nodes, roots, depth, valid ranges, covered pages and summaries of each tree."""
    joined = page_counts.join(nodes, "doc_id", "left")
    valid = (F.col("start") >= 1) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("n_pages"))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "node").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("valid", F.coalesce(valid, F.lit(False)))
    joined = joined.withColumn("before", F.coalesce(F.max(F.when(F.col("valid"), F.col("end"))).over(w), F.lit(0)))
    fresh = F.when(F.col("valid"), F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.col("before") + 1) + 1)).otherwise(0)
    return joined.groupBy("doc_id", "n_pages").agg(
        F.count("node").alias("nodes"), F.count_if(F.col("depth") == 0).alias("roots"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.count_if("valid").alias("valid_ranges"), F.sum(fresh).cast("int").alias("covered"), F.count_if(F.trim(F.coalesce("summary", F.lit(""))) != "").alias("summaries"),
    ).withColumn("complete", (F.col("n_pages") > 0) & (F.col("covered") == F.col("n_pages")))


def pair_records(ours: DataFrame, theirs: DataFrame, expected: DataFrame, modes: list[str]) -> DataFrame:
    """Every expected file in every mode with both sides' records, or missing_or_mismatched_pair. ``reason`` (ours) and ``error`` (theirs) may be left out.

    The modes are a short list: they become an array of each file, not a join.
    """
    each = expected.select("file", "sha256", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    told = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    a = ours.select("mode", "file", F.col("sha256").alias("our_hash"), F.col("status").alias("our_status"), told(ours, "reason").alias("our_reason"))
    b = theirs.select("mode", "file", F.col("sha256").alias("their_hash"), F.col("status").alias("their_status"), told(theirs, "error").alias("their_reason"))
    joined = each.join(a, ["mode", "file"], "left").join(b, ["mode", "file"], "left")
    ok = F.col("our_hash").eqNullSafe(F.col("sha256")) & F.col("their_hash").eqNullSafe(F.col("sha256"))
    return joined.select("mode", "file", "our_status", "our_reason", "their_status", "their_reason", F.when(~ok, "missing_or_mismatched_pair").alias("failure"))


def compare_extraction(a: DataFrame, b: DataFrame, block: int = 4096, part_mb: float = 8) -> DataFrame:
    """E5: texts of two extractions (doc_id, page, text): page counts, characters, order, and the pages that differ.

    No text of a document is put together. Pages meet by number; characters are counted over the pages that aren't equal, once for one side and
    once against the other. Order is compared in blocks of ``block`` characters of the document, wherever its pages end on either side. Pages are dealt in partitions
    of about ``part_mb`` MB of either side, so a task's rows don't grow with the input.
    """
    parts = parts_of(a, b, mb=2 * part_mb)
    a, b = (dealt(df, parts, "doc_id", "page") for df in (a, b))
    left = a.select("doc_id", "page", squeezed(F.coalesce("text", F.lit(""))).alias("sa"), F.lit(1).alias("in_a"))
    right = b.select("doc_id", "page", squeezed(F.coalesce("text", F.lit(""))).alias("sb"), F.lit(1).alias("in_b"))
    both = left.join(right, ["doc_id", "page"], "full").na.fill("", ["sa", "sb"])
    moved = F.col("sa") != F.col("sb")
    differs = F.when(moved, sorted_chars(F.col("sa")) != sorted_chars(F.col("sb")))
    sums = both.groupBy("doc_id").agg(
        F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.sum(F.length("sa")).alias("size_a"), F.sum(F.length("sb")).alias("size_b"),
        F.array_join(F.array_sort(F.collect_list(F.when(differs, F.col("page")))), ",").alias("differing"),
    )
    sides = lambda *fields: F.explode(F.array(*[F.struct(*[F.expr(f.format(s=s)).alias(f.split(" AS ")[1]) for f in fields]) for s in "ab"])).alias("s")
    # a row a distinct character of a page, with its count there
    chars = both.where(moved).select("doc_id", sides("s{s} AS text", "'{s}' = 'a' AS first")).select("doc_id", "s.*", F.explode(F.array_distinct(F.split("s.text", ""))).alias("char"))
    there = F.length("text") - F.length(F.replace("text", F.col("char"), F.lit("")))
    net = chars.where("char <> ''").groupBy("doc_id", "char").agg(F.sum(F.when(F.col("first"), there).otherwise(-there)).alias("net"))
    other_chars = net.where("net <> 0").select("doc_id", F.lit("chars").alias("what"))

    changed = both.where(moved).select(F.col("doc_id").alias("changed_id")).distinct()
    kept = both.join(changed, F.col("doc_id").eqNullSafe(F.col("changed_id")), "left_semi")
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = dealt(kept, parts, "doc_id")
    starts = {f"start_{s}": F.coalesce(F.sum(F.length(f"s{s}")).over(before), F.lit(0)) for s in "ab"}
    placed = kept.withColumns(starts).select("doc_id", sides("s{s} AS text", "start_{s} AS start", "'{s}' = 'a' AS first")).select("doc_id", "s.*").where("text <> ''")
    end = F.col("start") + F.length("text")
    cut = placed.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    low, high = F.greatest("start", F.col("k") * block), F.least(end, (F.col("k") + 1) * block)
    cut = cut.select("doc_id", "k", "first", F.struct("start", F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("text")).alias("piece"))
    cut = dealt(cut, parts, "doc_id", "k")
    joined = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.col("piece")))), lambda p: p["text"]), "")
    texts = cut.groupBy("doc_id", "k").agg(joined(F.col("first")).alias("ta"), joined(~F.col("first")).alias("tb"))
    other_order = texts.where("ta <> tb").select("doc_id", F.lit("order").alias("what"))

    found = other_chars.union(other_order).groupBy(F.col("doc_id").alias("found_id")).agg(*[F.bool_or(F.col("what") == w).alias(w) for w in ("chars", "order")])
    extracted = (F.col("size_a") > 0) & (F.col("size_b") > 0)
    return sums.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", extracted.alias("both_extracted"), (F.col("n_a") == F.col("n_b")).alias("same_page_count"),
        (extracted & ~F.coalesce("chars", F.lit(False))).alias("same_characters"), (extracted & ~F.coalesce("order", F.lit(False))).alias("same_order"), "differing",
    )


def evidence_reachability(questions: DataFrame, nodes: DataFrame, pages: DataFrame, accepted: DataFrame) -> DataFrame:
    """Whether some expected page (question_id, doc_id, page, passage) of an ``accepted`` index (doc_id) lies under a node and holds the passage.

    A rejected tree reaches nothing, whatever it holds. Ranges of nodes are merged to runs a document, so a page meets one at most.
    """
    nodes = nodes.join(accepted.select("doc_id").distinct(), "doc_id", "left_semi")
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = nodes.withColumn("new", F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    joined = questions.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left").join(runs, "doc_id", "left")
    here = F.col("page").between(F.col("low"), F.col("high")) & F.col("text").contains(F.col("passage"))
    return joined.groupBy("question_id").agg(F.bool_or(F.coalesce(here, F.lit(False))).alias("reachable"))


def paired_reachability(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Results of ``evidence_reachability`` on either side by question: (question_id, ours, theirs)."""
    sides = [df.select("question_id", F.col("reachable").alias(name)) for df, name in ((ours, "ours"), (theirs, "theirs"))]
    return sides[0].join(sides[1], "question_id", "full").na.fill(False, ["ours", "theirs"])


def coverage_by_mode(pairs: DataFrame) -> DataFrame:
    """Denominator, ready and rejected of both sides, a mode. Which ones were rejected: see ``rejected_records``."""
    ours, theirs = F.col("our_status"), F.col("their_status")
    return pairs.groupBy("mode").agg(
        F.count("*").alias("denominator"), F.count_if(ours == "ready").alias("ready"), F.count_if(ours != "ready").alias("rejected"),
        F.count_if(theirs == "completed").alias("completed"), F.count_if(theirs != "completed").alias("their_rejected"),
    )


def rejected_records(pairs: DataFrame) -> DataFrame:
    """The rejected files of each mode and side with status and reason, a row each, so no list grows with the corpus."""
    sides = F.array(
        F.struct(F.lit("ours").alias("side"), F.col("our_status").alias("status"), F.col("our_reason").alias("reason"), F.lit("ready").alias("good")),
        F.struct(F.lit("theirs").alias("side"), F.col("their_status").alias("status"), F.col("their_reason").alias("reason"), F.lit("completed").alias("good")),
    )
    each = pairs.select("mode", "file", F.explode(sides).alias("s"))
    return each.where("s.status <> s.good").select("mode", "file", "s.side", "s.status", "s.reason")


def trial_history(records: DataFrame, modes: list[str]) -> DataFrame:
    """Observed, ready, rejected and earlier failures of each report and mode; modes without a record have zeros."""
    each = records.select("report").distinct().select("report", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    sums = records.groupBy("report", "mode").agg(
        F.count("*").alias("observed"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("retried")).alias("earlier_failed")
    )
    joined = each.join(sums, ["report", "mode"], "left").na.fill(0, ["observed", "ready", "earlier_failed"])
    return joined.withColumn("rejected", F.col("observed") - F.col("ready"))


def rejected_files(records: DataFrame) -> DataFrame:
    """Files that a report's mode didn't accept, with status and reason (report, mode, file, status, reason)."""
    return records.where("status <> 'ready' or status is null").select("report", "mode", "file", "status", "reason")


def earlier_outcomes(records: DataFrame) -> DataFrame:
    """Outcomes of attempts before a deliberate retry (report, mode, file, original_outcome; null without a retry)."""
    return records.where("original_outcome is not null").select("report", "mode", "file", F.col("original_outcome").alias("outcome"))


def question_outcomes(questions: DataFrame) -> DataFrame:
    """Status and reason of each report's questions: the question's own, else its result's, else why it was not asked.

    questions: report, mode, id, status, result struct of status and reason, reason, why.
    """
    return questions.select("report", "mode", "id", F.coalesce("status", "result.status").alias("status"), F.coalesce("reason", "result.reason", "why").alias("reason"))


def qa_checks(runs: DataFrame, questions: DataFrame, reads: DataFrame) -> DataFrame:
    """Expected outcome, all facts in the text, and every expected original cited.

    runs: question_id, outcome, text, citations array. questions: question_id, outcome, facts array, evidence array of (doc_id, pages, passage). reads: reference_id,
    doc_id, page, slice.
    """
    joined = runs.join(questions.select("question_id", F.col("outcome").alias("expected_outcome"), "facts", "evidence"), "question_id")
    lower = F.lower(F.coalesce("text", F.lit("")))
    facts = F.forall("facts", lambda f: F.contains(lower, F.lower(f)))
    base = joined.select("question_id", F.col("outcome").eqNullSafe(F.col("expected_outcome")).alias("expected_outcome"), facts.alias("lexical_facts"))
    wanted = joined.select("question_id", "citations", F.posexplode("evidence").alias("pos", "e")).select("question_id", "citations", "pos", "e.*")
    cited = wanted.withColumn("reference_id", F.explode_outer("citations")).drop("citations")
    met = cited.join(reads.select("reference_id", F.col("doc_id").alias("r_doc"), F.col("page").alias("r_page"), "slice"), "reference_id", "left")
    ok = (F.col("r_doc") == F.col("doc_id")) & F.array_contains("pages", F.col("r_page")) & F.col("slice").contains(F.col("passage"))
    each = met.groupBy("question_id", "pos").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("ok"))
    every = each.groupBy("question_id").agg(F.bool_and("ok").alias("cited"))
    return base.join(every, "question_id", "left").withColumn("cited_expected_originals", F.coalesce("cited", F.lit(True))).drop("cited")


def _beside(groups: DataFrame, found: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """groups with the columns of ``found`` of the same key; nulls are equal."""
    own = found.select(*[F.col(c).alias(f"own_{c}") for c in by], *[c for c in found.columns if c not in by])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in by])
    return groups.join(own, same, how).drop(*[f"own_{c}" for c in by])


def latency_distribution(df: DataFrame, by: list[str], value: str = "elapsed_ms", prefix: str = "", buckets: int = 10_000) -> DataFrame:
    """Count, least, nearest-rank median and 95th percentile, and largest of each group's finite numbers; null when there is none."""
    return latency_distributions(df, by, {prefix: value}, buckets)


def latency_distributions(df: DataFrame, by: list[str], values: dict[str, str], buckets: int = 10_000) -> DataFrame:
    """E10 for several columns at once, ``values`` by prefix of the result's columns.

    A first pass takes two pivots around each rank, by approximate percentiles whose error is 1 / ``buckets`` of a group; they are ten times that away on either side. A second one
    counts what lies below the lower pivot where rows lie, and only values between the pivots, a share of 20 / ``buckets`` of the group however
    uneven they are, are put in order. Ranks are exact.
    """
    finite = lambda c: F.expr(f"CASE WHEN abs(`{c}`) < double('Infinity') THEN CAST(`{c}` AS double) END")  # noqa: E731  not a number is above all
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), finite(c).alias("v")) for i, c in enumerate(values.values())])).alias("x")
    each, key = df.select(*by, stacked).select(*by, "x.of", "x.v"), [*by, "of"]
    margin = 10 / buckets
    shares = [min(1.0, max(0.0, p + side)) for p in RANKS.values() for side in (-margin, margin)]
    stats = each.groupBy(*key).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", shares, buckets).alias("pivots"))

    asked = _beside(each.where("v is not null"), stats.select(*key, "n", "pivots"), key, "inner")
    parts = []
    for i, (name, p) in enumerate(RANKS.items()):
        low, high, target = F.col("pivots")[2 * i], F.col("pivots")[2 * i + 1], F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))
        parts.append(F.when(F.col("v") <= high, F.struct(F.lit(name).alias("name"), target.alias("target"), F.when(F.col("v") >= low, F.col("v")).alias("v"))))
    ranked = [*key, "name", "target"]
    inside = asked.select(*key, F.explode(F.array_compact(F.array(*parts))).alias("r")).select(*key, "r.*").groupBy(*ranked, "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*ranked).orderBy(F.asc_nulls_first("v")))  # those below the lower pivot come first
    at = inside.withColumn("upto", upto).where("upto >= target").groupBy(*key).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in RANKS])
    found = _beside(stats.drop("pivots"), at, key)
    names = {"n": "count", "least": "min_ms", "median_ms": "median_ms", "p95_ms": "p95_ms", "most": "max_ms"}
    one = lambda i, c: F.max(F.when(F.col("of") == i, F.col(c)))
    return found.groupBy(*by).agg(*[one(i, c).alias(prefix + name) for i, prefix in enumerate(values) for c, name in names.items()])


def usage_from_record(record: Column) -> Column:
    """usage of a record: its run's, else its result's, else its first attempt's."""
    return F.coalesce(record["run"]["usage"], record["result"]["usage"], F.try_element_at(record["operation"]["attempts"], F.lit(1))["usage"])


def usage_totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Records with usage, and the sum of each counter. df has a struct column ``usage``, null without one."""
    sums = [F.coalesce(F.sum(F.col("usage")[c]), F.lit(0)).alias(c) for c in df.schema["usage"].dataType.fieldNames()]
    return df.groupBy(*by).agg(F.count("usage").alias("records_with_usage"), *sums)


def mode_measurements(records: DataFrame, questions: DataFrame, reached: DataFrame) -> DataFrame:
    """Per mode invariants of accepted trees, agreement of extraction, reachability of evidence, latency and usage of indexing on both sides, and questions,
    latency and usage by channel. Web latency is that of completed questions, mcp latency that of all.

    records: mode, status, their_status, nodes, valid_ranges, complete, summaries, both_extracted, same_pages, same_order, elapsed_ms, their_elapsed_ms, usage.
    questions: mode, channel, status, elapsed_ms, usage. reached: mode, ours, theirs. ``usage`` is a struct, null without one.
    """
    accepted, done = F.col("status") == "ready", F.col("status") == "completed"
    every = lambda c: F.coalesce(F.bool_and(F.when(accepted, c)), F.lit(True))
    # percentiles of accepted ones only: others are null and don't count
    timed = records.withColumns({"accepted_ms": F.when(accepted, F.col("elapsed_ms")), "completed_ms": F.when(F.col("their_status") == "completed", F.col("their_elapsed_ms"))})
    a = timed.groupBy("mode").agg(
        F.count_if(accepted).alias("accepted"), every(F.col("nodes") == F.col("valid_ranges")).alias("ranges_valid"), every(F.col("complete")).alias("pages_complete"),
        every(F.col("nodes") == F.col("summaries")).alias("summaries_complete"), F.count_if("both_extracted").alias("both_extracted"),
        F.count_if(F.col("both_extracted") & F.col("same_pages")).alias("characters_kept"), F.count_if(F.col("both_extracted") & F.col("same_order")).alias("order_kept"),
        *_usage(records, "index_"),
    )
    a = _beside(a, latency_distributions(timed, ["mode"], {"": "accepted_ms", "their_": "completed_ms"}), ["mode"])
    channels = []
    for channel, counted in (("web", done), ("mcp", F.lit(True))):
        own = questions.where(F.col("channel") == channel).withColumn("counted_ms", F.when(counted, F.col("elapsed_ms")))
        sums = [F.count("*").alias(f"{channel}_questions"), F.count_if(done).alias(f"{channel}_completed")]
        asked = own.groupBy("mode").agg(*sums, *_usage(questions, f"{channel}_"))
        channels.append(_beside(asked, latency_distribution(own, ["mode"], "counted_ms", f"{channel}_"), ["mode"]))
    c = reached.groupBy("mode").agg(F.count("*").alias("reach_total"), F.count_if("ours").alias("reach_ours"), F.count_if("theirs").alias("reach_theirs"))
    found = a
    for other in (*channels, c):
        found = found.join(other, "mode", "left")
    counts = [f.name for f in found.schema if f.name.endswith(("_questions", "_completed", "_with_usage")) or f.name.startswith("reach_")]
    return found.na.fill(0, counts)


def _usage(df: DataFrame, prefix: str) -> list[Column]:
    sums = [F.coalesce(F.sum(F.col("usage")[c]), F.lit(0)).alias(f"{prefix}{c}") for c in df.schema["usage"].dataType.fieldNames()]
    return [F.count("usage").alias(f"{prefix}with_usage"), *sums]


def question_rows(questions: DataFrame) -> DataFrame:
    """A row for each web question: id, status, outcome, the report it comes from, and whether its facts are in the text."""
    return questions.where("channel = 'web'").select("mode", "id", "status", "outcome", "report", "lexical")


def ledger_summary(calls: DataFrame) -> DataFrame:
    """Calls of each ledger: without usage, cancelled, failed, and tokens."""
    return calls.groupBy("ledger").agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count("*").alias("calls"), F.count_if(F.col("input_tokens").isNull()).alias("without_usage"), F.count_if("cancelled").alias("cancellations"),
        F.count_if("error").alias("errors"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    ]


def request_errors(calls: DataFrame) -> DataFrame:
    """Failed requests of each ledger with their lane and what they said (ledger, lane, seq, message)."""
    return calls.where("error").select("ledger", "lane", "seq", "message")


def lane_summary(calls: DataFrame) -> DataFrame:
    """The same for each lane with latency and first output; ledger totals have a null lane."""
    by = ["ledger", "total", "lane"]
    each = calls.where("ledger is not null").withColumn("total", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("lane", F.when(~F.col("total"), F.col("lane")))
    timed = latency_distributions(each, by, {"": "elapsed_ms", "first_": "first_ms"})
    return _beside(each.groupBy(*by).agg(*_totals()), timed, by).drop("total")


def accounting_intervals(ledgers: DataFrame) -> DataFrame:
    """Ledgers (pos, observed_cost) with the cost before each; the last has the final cumulative one. One row a ledger."""
    w = Window.orderBy("pos")
    upto = F.sum("observed_cost").over(w)
    return ledgers.select("pos", (upto - F.col("observed_cost")).alias("previous_cost"), "observed_cost", upto.alias("cumulative"), (F.lead("pos").over(w).isNull()).alias("is_final"))


def title_page_matches(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """Nodes whose squeezed lower-case title and start another tree of the document has, counted."""
    key = F.regexp_replace(F.lower("title"), r"(?U)\s", "").alias("key")
    there = reference.select("doc_id", "start", key).distinct()
    return nodes.select("doc_id", "node", "start", key).join(there, ["doc_id", "start", "key"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("matching"))


def call_costs(snapshots: DataFrame) -> DataFrame:
    """Change of cost and balance from the snapshot before (ledger, ts, seq, cost, balance)."""
    w = Window.partitionBy("ledger").orderBy("ts", "seq")
    return snapshots.select(
        "ledger", "seq", (F.col("cost") - F.lag("cost").over(w)).alias("cost_change"), (F.lag("balance").over(w) - F.col("balance")).alias("balance_change")
    )

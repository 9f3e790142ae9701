"""Bounded reads, runs and the evidence that answers cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folio.functions.text import citation_ids, page_uri
from folio.operators.library import ACTIVE_RUN

SLICE_CHARS, TREE_CHARS, LONG_DOCUMENT, MOST_PAGES = 18000, 12000, 20, 8


def resolve_scope(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Runs (run_id, mode, document_ids) with the number and the list of pins, or the failure if any selected document is unavailable."""
    wanted = runs.where("mode = 'selected'").select("run_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    live = documents.where("retired_at is null and effective_version is not null and effective_index is not null and page_count > 0")
    pin = F.concat_ws("/", F.col("document_id").cast("string"), "effective_version", "effective_index")
    joined = wanted.join(live.select("document_id", "effective_version", "effective_index"), "document_id", "left")
    sums = joined.groupBy("run_id").agg(
        F.bool_and(F.col("effective_index").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.when(F.col("effective_index").isNotNull(), pin))).alias("pins")
    )
    found = runs.join(sums, "run_id", "left")
    bad = (F.col("mode") == "selected") & ~F.coalesce("all", F.lit(False))
    return found.select(
        "run_id", F.when(bad, "selected_document_unavailable").alias("failure"), F.when(bad, "").otherwise(F.coalesce(F.array_join("pins", ","), F.lit(""))).alias("pins")
    )


def bind_reads(reads: DataFrame, runs: DataFrame, documents: DataFrame, pins: DataFrame) -> DataFrame:
    """R2: version that each read (read_id, run_id, document_id, version_id or null) uses, or the first reason against it."""
    joined = (
        reads.join(runs.select("run_id", "mode", "document_ids"), "run_id")
        .join(documents.select("document_id", "retired_at", "effective_version", "effective_index"), "document_id", "left")
        .join(pins.select("run_id", "document_id", F.col("version_id").alias("pinned")), ["run_id", "document_id"], "left")
    )
    asked = F.col("version_id")
    reason = (
        F.when((F.col("mode") == "selected") & ~F.coalesce(F.array_contains("document_ids", F.col("document_id")), F.lit(False)), "document_out_of_scope")
        .when(F.col("retired_at").isNotNull() | F.col("effective_version").isNull() | F.col("effective_index").isNull(), "document_unavailable")
        .when(F.col("pinned").isNotNull() & asked.isNotNull() & (asked != F.col("pinned")), "run_version_mismatch")
        .when(F.col("pinned").isNull() & asked.isNotNull() & (asked != F.col("effective_version")), "historical_version_not_eligible")
    )
    return joined.select("read_id", F.when(reason.isNull(), F.coalesce("pinned", asked, "effective_version")).alias("bound"), reason.alias("reason"))


def first_read_pins(reads: DataFrame) -> DataFrame:
    """The version of a run's first read of a document holds for the run."""
    w = Window.partitionBy("run_id", "document_id").orderBy("ts", "read_id")
    return reads.withColumn("pinned", F.first("version_id").over(w)).select("read_id", "run_id", "document_id", "pinned")


def structure_page(nodes: DataFrame, offset: int = 0, limit: int = 50, most: int = TREE_CHARS) -> DataFrame:
    """Nodes of each tree from ``offset``: at most ``limit`` and ``most`` characters of JSON; with the next cursor of the document.

    A tree whose next node alone is beyond the budget has a row without a node and its cursor stays.
    """
    w = Window.partitionBy("doc_id").orderBy("node")
    size = F.length(F.to_json(F.struct(*[c for c in nodes.columns if c != "doc_id"]), {"ignoreNullFields": "false"}))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    numbered = nodes.withColumns({"pos": F.row_number().over(w) - 1, "total": total, "size": size})
    part = numbered.where((F.col("pos") >= offset) & (F.col("pos") < offset + limit)).withColumn("upto", F.sum("size").over(w))
    fits = F.col("upto") <= most
    taken = F.count_if(fits).over(Window.partitionBy("doc_id"))
    shown = part.withColumn("next_cursor", F.when(offset + taken < F.col("total"), (offset + taken).cast("int"))).where(fits | (F.col("pos") == offset))
    return shown.select("doc_id", F.when(fits, F.col("node")).alias("node"), F.when(fits, F.col("pos")).alias("pos"), "next_cursor", "total")


def page_slices(requests: DataFrame, pages: DataFrame, page_counts: DataFrame, budget: int = SLICE_CHARS) -> DataFrame:
    """Slices of the pages asked for (request_id, doc_id, pages, offset): start, end, complete, and where to go on.

    Pages come in the order asked while characters are left; the first page that isn't whole ends the answer. When a page ends just at the budget, the
    next one starts at 0. A request for more than 8 pages, or with a page out of bounds, a missing page or an offset beyond its page has a failure instead: that of
    the first page in the order asked that has one.
    """
    each = requests.select("request_id", "doc_id", "offset", F.size("pages").alias("n_asked"), F.posexplode("pages").alias("pos", "page"))
    sized = each.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left").join(page_counts, "doc_id", "left")
    first = F.when(F.col("pos") == 0, F.col("offset")).otherwise(F.lit(0))
    length = F.length("text")
    bad = (
        F.when(F.col("n_asked") > MOST_PAGES, "page_request_too_large").when((F.col("page") < 1) | (F.col("page") > F.coalesce("n_pages", F.lit(0))), "page_out_of_bounds")
        .when(F.col("text").isNull(), "page_unavailable").when(first > length, "page_offset_out_of_bounds")
    )
    w = Window.partitionBy("request_id").orderBy("pos")
    ready = sized.withColumns({"start": first, "length": length, "bad": bad, "own": F.coalesce(length - first, F.lit(0))})
    ready = ready.withColumn("before", F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a page comes while characters are left; the first always does
    shown = ready.where((F.col("pos") == 0) | (F.col("before") < budget))
    failed = F.min(F.when(F.col("bad").isNotNull(), F.struct("pos", "bad"))).over(Window.partitionBy("request_id"))["bad"]
    end = F.least(F.col("length"), F.col("start") + budget - F.col("before")).cast("int")
    out = shown.withColumns({"failure": failed, "end": end})
    cut = F.col("end") < F.col("length")
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("request_id"))
    next_pos = F.when(last & cut, F.col("pos")).when(last & (F.col("pos") < F.col("n_asked") - 1), F.col("pos") + 1)
    return out.select(
        "request_id", "doc_id", "pos", "page", "failure", F.when(F.col("failure").isNull(), F.col("start")).alias("start"), F.when(F.col("failure").isNull(), F.col("end")).alias("end"),
        F.when(F.col("failure").isNull(), F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).alias("slice"),
        F.when(F.col("failure").isNull(), ~cut).alias("complete"), F.when(F.col("failure").isNull(), next_pos).cast("int").alias("next_pos"),
        F.when(F.col("failure").isNull() & next_pos.isNotNull(), F.when(cut, F.col("end")).otherwise(0)).cast("int").alias("next_offset"),
    )


def structure_required(page_reads: DataFrame, structure_reads: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Page reads of documents over 20 pages before the run has read their structure."""
    earliest = structure_reads.groupBy("run_id", "doc_id").agg(F.min("ts").alias("structure_ts"))
    long_ = page_counts.where(F.col("n_pages") > LONG_DOCUMENT).select("doc_id")
    joined = page_reads.join(long_, "doc_id", "left_semi").join(earliest, ["run_id", "doc_id"], "left")
    return joined.where("structure_ts is null or structure_ts > ts").select("read_id", "run_id", "doc_id")


def issue_references(slices: DataFrame, page_budget: int) -> DataFrame:
    """A reference for each slice (run_id, seq, doc_id, page, start, end, slice) with text, up to the run's page budget; the others with their reason."""
    blank = F.regexp_replace("slice", r"(?U)\s+", "") == ""
    w = Window.partitionBy("run_id", blank).orderBy("seq")
    nth = F.row_number().over(w)
    numbered = slices.withColumn("nth", F.when(~blank, nth)).withColumn("blank", blank)
    reason = F.when(F.col("blank"), "page_content_empty").when(F.col("nth") > page_budget, "page_read_budget_exceeded")
    return numbered.select("run_id", "seq", "doc_id", "page", "start", "end", F.when(reason.isNull(), F.sha2("slice", 256)).alias("content_digest"), reason.alias("reason"))


def resolve_references(references: DataFrame, runs: DataFrame, pins: DataFrame, versions: DataFrame, pages: DataFrame, originals: DataFrame) -> DataFrame:
    """References with the first reason that stops their use; null if they resolve.

    references: reference_id, run_id, document_id, version_id, page, start, end, content_digest. runs: run_id, mode, document_ids. pins: run_id,
    document_id, version_id. versions: version_id, document_id, page_count, byte_length. pages: version_id, page, text. originals:
    version_id, byte_length found.
    """
    joined = (
        references.join(runs.select("run_id", "mode", "document_ids"), "run_id", "left")
        .join(pins.select("run_id", "document_id", F.col("version_id").alias("pinned")), ["run_id", "document_id"], "left")
        .join(versions.select("version_id", F.col("document_id").alias("owner"), "page_count", "byte_length"), "version_id", "left")
        .join(pages.select("version_id", "page", "text"), ["version_id", "page"], "left")
        .join(originals.select("version_id", F.col("byte_length").alias("found_length")), "version_id", "left")
    )
    outside = (F.col("mode") == "selected") & ~F.coalesce(F.array_contains("document_ids", F.col("document_id")), F.lit(False))
    unbound = (
        ~F.col("owner").eqNullSafe(F.col("document_id")) | ~F.col("pinned").eqNullSafe(F.col("version_id")) | (F.col("page") < 1)
        | (F.col("page") > F.coalesce("page_count", F.lit(0))) | outside
    )
    digest = F.sha2(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), 256)
    reason = (
        F.when(F.col("mode").isNull(), "reference_not_found").when(F.col("owner").isNull(), "source_not_found").when(unbound, "reference_binding_invalid")
        .when(F.col("text").isNull(), "page_unavailable").when(~F.col("found_length").eqNullSafe(F.col("byte_length")), "reference_original_unavailable")
        .when(digest != F.col("content_digest"), "reference_content_unavailable")
    )
    return joined.select("reference_id", "run_id", "document_id", "version_id", "page", reason.alias("reason"))


#: What a reader may be told of a citation.
TOLERATED = ("reference_original_unavailable", "reference_content_unavailable", "page_unavailable")


def split_references(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable references, and issues that a reader may see; any other reason is a fault and in neither."""
    return resolved.where("reason is null").drop("reason"), resolved.where(F.col("reason").isin(*TOLERATED)).select("reference_id", "reason")


def answer_gate(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Answers (run_id, outcome, text) with the failure that bars them: no citation, or the first one that is invalid or of another run."""
    cited = answers.select("run_id", F.posexplode(citation_ids(F.col("text"))).alias("pos", "reference_id"))
    refs = resolved.select("reference_id", F.col("run_id").alias("ref_run"), "reason")
    joined = cited.join(refs, "reference_id", "left")
    wrong = F.when(F.col("ref_run").isNull(), "reference_not_found").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("ref_run") != F.col("run_id"), "citation_wrong_run")
    first = joined.withColumn("wrong", wrong).groupBy("run_id").agg(F.count("*").alias("n_cited"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("pos", "wrong"))).alias("first"))
    found = answers.join(first, "run_id", "left")
    n = F.coalesce("n_cited", F.lit(0))
    failure = F.when((F.col("outcome") == "answer") & (n == 0), "answer_evidence_missing").otherwise(F.col("first.wrong"))
    return found.select("run_id", n.alias("n_cited"), failure.alias("failure"))


def citation_links(messages: DataFrame, references: DataFrame) -> DataFrame:
    """Each citation of a message with the address of its page; null where it is disabled."""
    cited = messages.select("message_id", "run_id", F.posexplode(citation_ids(F.col("text"))).alias("pos", "reference_id"))
    refs = references.select("reference_id", "run_id", "version_id", "page", F.lit(True).alias("there"))
    joined = cited.join(refs, ["reference_id", "run_id"], "left")
    return joined.select("message_id", "pos", "reference_id", F.when(F.col("there"), page_uri(F.col("version_id"), F.col("page"))).alias("link"))


def message_runs(messages: DataFrame) -> DataFrame:
    """Messages (thread_id, pos, role, run_id on the user's) with the run of the latest user message up to them."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    return messages.select("thread_id", "pos", "role", F.last(F.when(F.col("role") == "user", F.col("run_id")), ignorenulls=True).over(w).alias("run_id"))


#: Failures of a run, in the order in which they are looked at.
BUDGETS = ("elapsed_budget_exceeded", "model_call_budget_exceeded", "context_budget_exceeded", "tool_call_budget_exceeded", "page_read_budget_exceeded", "output_budget_exceeded")


def budget_violations(calls: DataFrame, *, model_calls: int, tool_calls: int, pages: int, output_chars: int, elapsed_ms: float, context_chars: int) -> DataFrame:
    """The first call of each run (run_id, seq, kind, output_chars, elapsed_ms, context_chars) that breaks a budget, and which.

    kind is model, tool or page. A call counts when it starts, so the one after the last allowed is the first that breaks. A model call is also judged by the
    characters of the messages that go with it (null: none).
    """
    w = Window.partitionBy("run_id").orderBy("seq")
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int")).over(w)
    sums = calls.withColumns(
        {"n_model": count("model"), "n_tool": count("tool"), "n_page": count("page"), "n_chars": F.sum("output_chars").over(w), "ms": F.sum("elapsed_ms").over(w)}
    )
    broken = (
        F.when(F.col("ms") > elapsed_ms, BUDGETS[0]).when(F.col("n_model") > model_calls, BUDGETS[1])
        .when((F.col("kind") == "model") & (F.col("context_chars") > context_chars), BUDGETS[2]).when(F.col("n_tool") > tool_calls, BUDGETS[3])
        .when(F.col("n_page") > pages, BUDGETS[4]).when(F.col("n_chars") > output_chars, BUDGETS[5])
    )
    return sums.withColumn("violation", broken).where("violation is not null").groupBy("run_id").agg(F.min(F.struct("seq", "violation")).alias("f")).select("run_id", "f.seq", "f.violation")


def settle_runs(runs: DataFrame) -> DataFrame:
    """A run that completes while stopping is stopped and loses its result. runs: run_id, status, finished, reason, result."""
    late = (F.col("status") == "stopping") & (F.col("finished") == "completed")
    return runs.select(
        "run_id", F.when(late, "stopped").otherwise(F.col("finished")).alias("status"), F.when(late, "owner_stopped").otherwise(F.col("reason")).alias("reason"),
        F.when(~late, F.col("result")).alias("result"),
    )


def append_messages(threads: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of threads with the new ones at the end, and those refused as their id exists in the thread (or came twice).

    Both sides: thread_id, pos, message_id, role, text; pos orders the new ones too.
    """
    key = ["thread_id", "message_id"]
    fresh = new.join(threads.select(*key).distinct(), key, "left_anti")
    one = fresh.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    last = threads.groupBy("thread_id").agg(F.max("pos").alias("last"))
    added = one.where("nth = 1").drop("nth").join(last, "thread_id", "left")
    place = F.coalesce(F.col("last") + 1, F.lit(0)) + F.row_number().over(Window.partitionBy("thread_id").orderBy("pos")) - 1
    added = added.withColumn("pos", place.cast("int")).drop("last").select(*threads.columns)
    again = new.join(threads.select(*key).distinct(), key, "left_semi").select(*new.columns).union(one.where("nth > 1").select(*new.columns))
    return threads.unionByName(added), again.withColumn("reason", F.lit("message_identity_collision"))


def runs_by_thread(runs: DataFrame) -> DataFrame:
    """Runs (thread_id, run_id, record JSON) by start time, with the newest running one marked."""
    status, started = F.get_json_object("record", "$.status"), F.get_json_object("record", "$.startedAt").cast("long")
    timed = runs.select("thread_id", "run_id", status.alias("status"), started.alias("started_at"))
    w = Window.partitionBy("thread_id").orderBy("started_at", "run_id")
    newest = Window.partitionBy("thread_id", "status").orderBy(F.desc("started_at"), F.desc("run_id"))
    return timed.select(
        "thread_id", "run_id", "status", F.row_number().over(w).alias("nth"), ((F.col("status") == "running") & (F.row_number().over(newest) == 1)).alias("is_active")
    )


def admit_questions(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """Of the questions of a conversation (conversation_id, question_id, ts), the first if no run is active; the others find it busy."""
    busy = runs.where(F.col("status").isin(*ACTIVE_RUN)).select("conversation_id", F.lit(True).alias("active")).distinct()
    w = Window.partitionBy("conversation_id").orderBy("ts", "question_id")
    joined = questions.withColumn("nth", F.row_number().over(w)).join(busy, "conversation_id", "left")
    ok = F.col("active").isNull() & (F.col("nth") == 1)
    return joined.select("conversation_id", "question_id", F.when(ok, "admitted").otherwise("conversation_busy").alias("outcome"))

"""Trees refined to their end: oversized leaves divided level by level, and summaries rolled up from the leaves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from folio.operators import trees
from folio.sources.scratch import dropped, stored

#: Fixed value: characters of a summary.
SUMMARY_CHARS = 1600
NODE = ["doc_id", "node"]


def subdivide_to_end(nodes: DataFrame, pages: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees whose oversized leaves are divided, their children too, until none is left: (nodes, failures).

    nodes: of ``build_tree``. pages: doc_id, page, text, navigation_text. proposed: verified headings (doc_id, depth, page, ord, title, anchor), ``depth``
    that of the leaf they divide. Each round divides the leaves of all documents; there are at most as many as levels a leaf may lie at. A document fails (doc_id,
    failure) by its first leaf, in the order of the tree, that is too deep or can't be divided, else by the first round whose tree ``validate_tree``
    rejects; its nodes stay out.
    """
    now = stored(trees.spliced(nodes).withColumn("stuck", F.lit(False)), "tree")
    # rounds read them again
    pages = stored(pages.select("doc_id", "page", F.length("text").alias("chars"), "navigation_text"), "pages")
    proposed = stored(proposed, "proposed")
    failed = []
    for _ in range(trees.LEAF_DEPTH + 1):
        sized = trees.node_sizes(now, pages)
        leaves = stored(trees.oversized_leaves(sized).join(now.where("not stuck").select(*NODE, "path"), NODE), "leaves")
        if leaves.isEmpty():
            dropped(leaves)
            break
        open_ = leaves.where("failure is null").select(*NODE, "depth")
        children = stored(trees.subdivide(leaves.drop("path"), proposed.withColumn("verified", F.lit(True)).join(open_, ["doc_id", "depth"]).drop("depth")), "children")
        bad = leaves.where("failure is not null").select(*NODE, "failure").union(children.where("failure is not null").select(*NODE, "failure").distinct())
        bad = stored(bad.join(leaves.select(*NODE, "path"), NODE), "failures")
        failed.append(bad.select("doc_id", F.struct(F.lit(0).alias("round"), "path", "failure").alias("at")))
        marked = now.join(bad.select(*NODE, F.lit(True).alias("bad")), NODE, "left").withColumn("stuck", F.col("stuck") | F.col("bad").isNotNull()).drop("bad")
        new = stored(trees.spliced(marked, children), "tree")
        touched = children.where("failure is null").select("doc_id").distinct()
        judged = stored(trees.validate_tree(new.join(touched, "doc_id", "left_semi"), pages.join(touched, "doc_id", "left_semi")).where("failure is not null"), "judged")
        failed.append(judged.select("doc_id", F.struct(F.lit(len(failed)).alias("round"), F.array().cast("array<int>").alias("path"), "failure").alias("at")))
        dropped(now, leaves, children)
        now = new
    dropped(pages, proposed)
    none = nodes.sparkSession.createDataFrame([], "doc_id long, at struct<round:int,path:array<int>,failure:string>")
    failures = reduce(DataFrame.union, failed).groupBy("doc_id").agg(F.min("at").alias("at")).select("doc_id", "at.failure") if failed else none.select("doc_id", "at.failure")
    return now.join(failures.select("doc_id"), "doc_id", "left_anti").drop("stuck", "path"), failures


def summarise_tree(nodes: DataFrame, pages: DataFrame, answer: Callable[[DataFrame], DataFrame], context_chars: int) -> tuple[DataFrame, DataFrame]:
    """A summary of each node from the leaves up: (summaries (doc_id, node, summary), failures (doc_id, failure)).

    nodes: doc_id, node, title, start, end, depth, parent. pages: doc_id, page, label, text. ``answer`` gives requests (doc_id, node, round, batch) a ``summary``, as a
    join with a table of a model's answers does; round 0 asks for a window of a node's own pages.

    A leaf of few characters is its own summary; one with a single window takes that window's. A node without own pages and with one child takes its
    title and summary if they are short enough. Any other node's parts, of its children and then its windows, are asked for in batches, round after round, until one short part is
    left. Nodes of a depth go on together, the deepest first. A document fails by the last of its nodes, in the order of the tree, that fails: a page too large for
    a window, no evidence at all, or a round that leaves as many parts as it took.
    """
    nodes = stored(nodes.select(*NODE, "title", "start", "end", "depth", "parent"), "nodes")  # each depth reads them again
    own = stored(trees.own_pages(nodes, pages).join(pages.select("doc_id", "page", "label", "text"), ["doc_id", "page"]), "own")
    has_child = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    chars = own.groupBy(*NODE).agg((F.sum(F.length("text")) + F.count("*") - 1).alias("own_chars"))
    kinds = nodes.join(has_child, NODE, "left").join(chars, NODE, "left").select(*nodes.columns, F.coalesce("inner", F.lit(False)).alias("inner"), F.coalesce("own_chars", F.lit(0)).alias("own_chars"))
    short = ~F.col("inner") & (F.col("own_chars") <= trees.SHORT_LEAF)
    kinds = stored(kinds.withColumn("short", short), "kinds")
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    small = own.join(kinds.where("short").select(*NODE), NODE, "left_semi").groupBy(*NODE).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    plain = kinds.where("short").select(*NODE).join(small, NODE, "left").select(*NODE, F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "").alias("summary"))

    rest = own.join(kinds.where("not short").select(*NODE), NODE, "left_semi")
    packed = stored(trees.pack_windows(rest, context_chars, NODE), "windows")
    large = packed.where("failure is not null").select(*NODE, "failure").distinct()
    asked = packed.where("failure is null").groupBy(*NODE, F.lit(0).alias("round"), F.col("window").alias("batch")).agg(F.min("page").alias("start"), F.max("page").alias("end"))
    fragments = stored(answer(asked).select(*NODE, F.col("batch").alias("pos"), "start", "end", "summary"), "fragments")
    failures = [large]
    done = [stored(plain, "summaries")]
    summaries = lambda: reduce(DataFrame.union, done)
    for depth in range(trees.DEEPEST, -1, -1):
        here = kinds.where((F.col("depth") == depth) & ~F.col("short")).select(*NODE, "inner").join(large, NODE, "left_anti")
        if here.isEmpty():
            continue
        kids = nodes.where("parent is not null").join(summaries(), NODE, "left").select(
            "doc_id", F.col("parent").alias("node"), F.col("node").alias("pos"), "title", "start", "end", "summary", F.lit(0).alias("kind")
        )
        windows = fragments.select(*NODE, "pos", F.lit(None).cast("string").alias("title"), "start", "end", "summary", F.lit(1).alias("kind"))
        both = kids.unionByName(windows).join(here, NODE)
        ready = both.groupBy(*NODE).agg(F.bool_and(F.col("summary").isNotNull()).alias("ready"))
        text = F.when(F.col("kind") == 0, F.to_json(F.struct("title", "start", "end", "summary"))).otherwise(F.to_json(F.struct("start", "end", "summary")))
        w = Window.partitionBy(*NODE)
        parts = both.join(ready.where("ready").select(*NODE), NODE, "left_semi").select(
            *NODE, (F.row_number().over(w.orderBy("kind", "pos")) - 1).alias("pos"), text.alias("text"), F.count("*").over(w).alias("n"), "kind", "inner", "summary",
            F.concat_ws(": ", "title", "summary").alias("named"),
        )
        parts = stored(parts, "parts")
        alone = F.col("n") == 1
        taken = F.when(alone & ~F.col("inner"), F.col("summary")).when(alone & (F.col("kind") == 0) & (F.length("named") <= SUMMARY_CHARS), F.col("named"))
        one = stored(parts.withColumn("taken", taken).where("taken is not null").select(*NODE, F.col("taken").alias("summary")), "summaries")
        failures.append(here.join(ready, NODE, "left_anti").select(*NODE, F.lit("summary_evidence_missing").alias("failure")))
        done.append(one)
        left = stored(parts.join(one.select(*NODE), NODE, "left_anti").select(*NODE, "pos", "text", "n"), "parts")
        for round_ in range(1, 1 << 30):
            if left.isEmpty():
                break
            sizes = left.select("doc_id", F.col("node").alias("parent"), "pos", F.length("text").alias("size"))
            batches = trees.rollup_batches(sizes, context_chars).groupBy("doc_id", F.col("parent").alias("node"), F.lit(round_).alias("round"), "batch").agg(F.count("*").alias("parts"))
            told = answer(batches).withColumns({"n": F.count("*").over(w), "n_before": F.sum("parts").over(w)})
            told = stored(told.select(*NODE, F.col("batch").alias("pos"), F.col("summary").alias("text"), "n", "n_before"), "parts")
            stuck = (F.col("n") > 1) & (F.col("n") >= F.col("n_before"))
            ends = (F.col("n") == 1) & (F.length("text") <= SUMMARY_CHARS)
            failures.append(told.where(stuck).select(*NODE, F.lit("summary_context_too_small").alias("failure")).distinct())
            done.append(told.where(ends).select(*NODE, F.col("text").alias("summary")))
            dropped(left)
            left = stored(told.where(~stuck & ~ends).drop("n_before"), "parts")
    failed = reduce(DataFrame.union, failures).groupBy("doc_id").agg(F.max(F.struct("node", "failure"))["failure"].alias("failure"))
    return summaries().join(failed.select("doc_id"), "doc_id", "left_anti"), failed

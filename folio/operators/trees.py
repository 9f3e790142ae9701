"""Chapter trees from lines and bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio.functions.text import (
    CONTENTS_WORD, heading_number_depth, is_dot_leader, is_named_heading, normalized_title, upper_median,
)
from folio.operators.folds import Fold, fields, fold

DEEPEST = 8
PAGE = ["doc_id", "page"]
HEADING = ["doc_id", "page", "ord", "title", "depth", "origin"]
#: Bounds of a tree's nodes, and of what is merged, divided and rolled up.
NODE_LIMIT, TITLE_LIMIT, SUMMARY_LIMIT = 5000, 250, 2000
SMALL, SMALL_MERGED, LEAF_PAGES, LEAF_CHARS, WINDOW_PAGES, LEAF_DEPTH, SHORT_LEAF, BATCH = 500, 5000, 12, 18000, 8, 4, 1200, 12


def body_height(lines: DataFrame) -> DataFrame:
    """Upper median height of long lines outside margins; 11 without any."""
    tall = F.when(~F.col("margin") & (F.length("text") > 20), F.col("height"))
    return lines.groupBy("doc_id").agg(upper_median(F.collect_list(tall), 11.0).alias("body"))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines that may be headings: tall, or named as headings are and a little tall."""
    length = F.length("text")
    fit = ~F.col("margin") & length.between(3, 180) & ~is_dot_leader(F.col("text"))
    with_body = lines.where(fit).join(body_height(lines), "doc_id")
    tall = F.col("height") >= F.col("body") * 1.23
    named = is_named_heading(F.col("text")) & (F.col("height") >= F.col("body") * 1.04)
    return with_body.where(tall | named).drop("body")


def font_levels(candidates: DataFrame) -> DataFrame:
    """Candidates with ``level``: the first of the document's sizes (half points, largest first) within 0.6 of the height; -1 without one.

    A document's sizes are an array beside its candidates, so nothing multiplies.
    """
    size = F.floor(F.col("height") * 2 + 0.5) / 2
    sizes = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_set(size), asc=False).alias("sizes"))
    near = F.transform("sizes", lambda s, i: F.when(F.abs(s - F.col("height")) < 0.6, i))
    return candidates.join(sizes, "doc_id").withColumn("level", F.coalesce(F.array_min(near), F.lit(-1))).drop("sizes")


def headings_from_lines(lines: DataFrame) -> DataFrame:
    """T4: headings with depth: the larger of font level and depth of the number before the title."""
    depth = F.greatest("level", F.coalesce(heading_number_depth(F.col("text")), F.col("level")))
    return font_levels(heading_candidates(lines)).select(
        *PAGE, "ord", F.col("text").alias("title"), depth.cast("int").alias("depth"), F.lit("layout").alias("origin")
    )


def fuse_outlines(headings: DataFrame, outlines: DataFrame, lines: DataFrame) -> DataFrame:
    """T5: a verified bookmark (doc_id, seq, title, page, depth, verified) names the equal heading of its page as its origin, or comes in at its first matching line.

    Of bookmarks of a page with equal titles the first in the list comes in; the later ones find it there.
    """
    marks = outlines.where("verified").select("doc_id", "page", "seq", F.col("title").alias("mark"), F.col("depth").alias("mark_depth"), normalized_title(F.col("title")).alias("key"))
    marks = marks.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE, "key").orderBy("seq"))).where("nth = 1").drop("nth", "seq")
    keyed = headings.withColumn("key", normalized_title(F.col("title")))
    first = Window.partitionBy(*PAGE, "key").orderBy("ord")
    relabelled = keyed.withColumn("nth", F.row_number().over(first)).join(marks.select(*PAGE, "key", F.lit(True).alias("marked")).distinct(), [*PAGE, "key"], "left")
    old = relabelled.withColumn("origin", F.when(F.col("marked") & (F.col("nth") == 1), "outline").otherwise(F.col("origin"))).select(*HEADING)
    new = marks.join(keyed.select(*PAGE, "key").distinct(), [*PAGE, "key"], "left_anti")
    place = (
        new.select(*PAGE, "key").distinct().join(lines.select(*PAGE, "ord", normalized_title(F.col("text")).alias("line")), PAGE)
        .where(F.col("line").contains(F.col("key"))).groupBy(*PAGE, "key").agg(F.min("ord").alias("ord"))
    )
    added = new.join(place, [*PAGE, "key"], "left").select(
        *PAGE, F.coalesce("ord", F.lit(0)).alias("ord"), F.col("mark").alias("title"), F.col("mark_depth").alias("depth"), F.lit("outline").alias("origin")
    )
    return old.unionByName(added)


def dedupe_headings(headings: DataFrame) -> DataFrame:
    """Of equal titles on a page, the first; blank ones go."""
    first = Window.partitionBy(*PAGE, normalized_title(F.col("title"))).orderBy("ord", "depth", "title")
    kept = headings.where(F.trim("title") != "")
    return kept.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def add_front_matter(headings: DataFrame) -> DataFrame:
    """A root for page 1 where the first heading comes later."""
    late = headings.groupBy("doc_id").agg(F.min("page").alias("first")).where("first > 1")
    front = late.select(
        "doc_id", F.lit(1).alias("page"), F.lit(-1).alias("ord"), F.lit("Front matter").alias("title"), F.lit(0).alias("depth"), F.lit("coverage").alias("origin")
    )
    return headings.select(*HEADING).unionByName(front)


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("node")


def assign_hierarchy(headings: DataFrame) -> DataFrame:
    """Nodes with depth and parent.

    With d cut to 0..8, the depth of node i is i + the least (d_j - j) of j up to i, where the first counts as 0; the parent is
    the last node before at one less. Both are windows over one partitioning.
    """
    number = Window.partitionBy("doc_id").orderBy("page", "ord", "depth", "title")
    nodes = headings.withColumn("node", F.row_number().over(number).cast("int") - 1)
    wished = F.when(F.col("node") == 0, 0).otherwise(F.least(F.greatest(F.col("depth"), F.lit(0)), F.lit(DEEPEST)))
    nodes = nodes.withColumn("least", F.min(wished - F.col("node")).over(in_document()))
    nodes = nodes.withColumn("depth", (F.col("node") + F.col("least")).cast("int")).drop("least")
    before = in_document().rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.col("node")), ignorenulls=True).over(before) for d in range(DEEPEST)]
    return nodes.withColumn("parent", choose(F.col("depth") - 1, last))


def choose(index: Column, options: list[Column]) -> Column:
    """The option of that number; null for any other."""
    out = F.lit(None)
    for i, option in enumerate(options):
        out = F.when(index == i, option).otherwise(out)
    return out


def assign_ranges(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Nodes with start and end: up to the start of the next node as high or higher, else the last page."""
    after = in_document().rowsBetween(1, Window.unboundedFollowing)
    upto = [F.first(F.when(F.col("depth") <= d, F.col("page")), ignorenulls=True).over(after) for d in range(DEEPEST + 1)]
    ranged = nodes.withColumn("next", choose(F.col("depth"), upto)).join(page_counts, "doc_id")
    end = F.when(F.col("next").isNull(), F.col("n_pages")).otherwise(F.greatest("page", "next"))
    return ranged.select(
        "doc_id", "node", F.trim("title").alias("title"), F.col("page").alias("start"), end.cast("int").alias("end"), "depth", "parent", "origin"
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))


def build_tree(lines: DataFrame, outlines: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Chapter tree of each document, a row a node. Documents without a heading have none: see ``without_structure``.

    ``counts`` (doc_id, n_pages) has each document's pages, blank ones too; without it the last page with a line counts as the last.
    """
    headings = headings_from_lines(lines)
    if outlines is not None:
        headings = fuse_outlines(headings, outlines, lines)
    return assign_ranges(assign_hierarchy(add_front_matter(dedupe_headings(headings))), page_counts(lines) if counts is None else counts)


def without_structure(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents for which no tree can be built."""
    none = lines.select("doc_id").distinct().join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    return none.select("doc_id", F.lit("structural_extraction_inadequate").alias("failure"))


#: Rules of a tree, in the order in which they are looked at.
RULES = (
    "tree_size_invalid", "tree_identity_invalid", "tree_range_invalid", "tree_hierarchy_invalid", "tree_parent_invalid", "tree_location_unverified",
    "summary_missing_or_invalid", "tree_page_coverage_incomplete",
)


def page_coverage(nodes: DataFrame) -> DataFrame:
    """Pages of each document that lie under some node, from runs of ranges (no page is listed)."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "node").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(order), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), before + 1) + 1)
    return nodes.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").cast("int").alias("covered"))


def validate_tree(nodes: DataFrame, pages: DataFrame, summaries: bool = False) -> DataFrame:
    """First failing rule of each document, by node, then by rule; page coverage comes last. Null: valid.

    ``anchor`` stands for the title where there is one.
    """
    counts = page_counts(pages)
    body = pages.select("doc_id", F.col("page").alias("start"), normalized_title(F.col("navigation_text")).alias("body"))
    own = nodes if "anchor" in nodes.columns else nodes.withColumn("anchor", F.lit(None).cast("string"))
    own = own if "summary" in own.columns else own.withColumn("summary", F.lit(None).cast("string"))
    w = in_document()
    own = own.withColumns({"before_depth": F.lag("depth").over(w), "size": F.count("*").over(Window.partitionBy("doc_id"))})
    last = [F.last(F.when(F.col("depth") == d, F.col("node")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for d in range(DEEPEST)]
    own = own.withColumn("expected", choose(F.col("depth") - 1, last))
    parent = nodes.select("doc_id", F.col("node").alias("parent"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    own = own.join(parent, ["doc_id", "parent"], "left").join(counts, "doc_id", "left").join(body, ["doc_id", "start"], "left")
    anchor = normalized_title(F.coalesce("anchor", "title"))
    summary = F.coalesce("summary", F.lit(""))
    wrong = [
        F.col("size") > NODE_LIMIT,
        (F.trim("title") == "") | (F.length("title") > TITLE_LIMIT),
        (F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.coalesce("n_pages", F.lit(0))),
        (F.col("depth") < 0) | (F.col("depth") > DEEPEST) | (F.col("depth") > F.coalesce(F.col("before_depth") + 1, F.lit(0))),
        ~F.col("parent").eqNullSafe(F.col("expected")) | F.coalesce((F.col("start") < F.col("p_start")) | (F.col("end") > F.col("p_end")), F.lit(False)),
        (F.col("origin") != "coverage") & ~F.coalesce((anchor != "") & F.col("body").contains(anchor), F.lit(False)),
        F.lit(summaries) & ((F.trim(summary) == "") | (F.length(summary) > SUMMARY_LIMIT)),
    ]
    rule = F.lit(None)
    for i in reversed(range(len(wrong))):
        rule = F.when(wrong[i], i).otherwise(rule)
    first = own.withColumn("rule", rule).where("rule is not null").groupBy("doc_id").agg(F.min(F.struct("node", "rule")).getField("rule").alias("rule"))
    covered = counts.join(page_coverage(nodes), "doc_id", "left").where("covered is null or covered <> n_pages").select("doc_id", F.lit(7).alias("late"))
    ids = nodes.select("doc_id").distinct()
    found = ids.join(first, "doc_id", "left").join(covered, "doc_id", "left")
    name = F.get(F.array(*map(F.lit, RULES)), F.coalesce("rule", "late"))
    return found.select("doc_id", name.alias("failure"))


def toc_pages(lines: DataFrame) -> DataFrame:
    """Pages of a printed table of contents: of the first 20, those with a contents word or two dot leaders."""
    early = lines.where("page <= 20")
    sums = early.groupBy(*PAGE).agg(F.max(~F.col("margin") & F.col("text").rlike(CONTENTS_WORD)).alias("word"), F.count_if(is_dot_leader(F.col("text"))).alias("leaders"))
    return sums.where("word or leaders >= 2").select(*PAGE)


class TitleLookup(Fold):
    """Titles of a block, which come first, and the automaton that finds them in its lines."""

    def __init__(self):
        self.titles: dict[str, list] = {}
        self.found = None

    def row(self, doc_id, block, page, ord, margin, text, entry):
        if page is None:
            self.titles.setdefault(text, []).append(entry)
            return []
        if self.found is None:
            import ahocorasick

            self.found = ahocorasick.Automaton()
            for title in filter(None, self.titles):
                self.found.add_word(title, title)
            self.found.make_automaton()
        there = {title for _, title in self.found.iter(text)} if text and len(self.found) else set()
        there |= self.titles.keys() & {""}  # a title without letters is in every line
        return [(doc_id, e, page, ord, margin) for title in there for e in self.titles[title]]

    def close(self):
        return []


def map_toc(entries: DataFrame, lines: DataFrame, excluded: DataFrame, labels: DataFrame, block: int = 256) -> DataFrame:
    """Entries (doc_id, entry, title, label, depth) with physical page, order and reason: found by a unique label match, else by a unique title match.

    ``labels`` has a page's printed label. A document's titles become one automaton, by which its lines stream: work follows the text and the matches,
    not titles times lines. Documents are cut into blocks of ``block`` pages, each of which gets the titles. A line
    outside margins names the page; the order is that of the page's first matching line, margins included.
    """
    body = lines.join(excluded, PAGE, "left_anti").select("doc_id", F.floor((F.col("page") - 1) / block).alias("block"), *["page", "ord", "margin"], normalized_title(F.col("text")).alias("text"))
    keyed = entries.select("doc_id", "entry", "label", normalized_title(F.col("title")).alias("text")).where("text is not null")
    blocks = body.select("doc_id", "block").distinct()
    nothing = [F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("page", "ord", "margin")]
    titles = keyed.join(blocks, "doc_id").select("doc_id", "block", *nothing, "text", "entry")
    rows = titles.unionByName(body.withColumn("entry", F.lit(None).cast(titles.schema["entry"].dataType)))
    schema = T.StructType(fields(rows, "doc_id", "entry", "page", "ord", "margin"))
    met = fold(rows, ["doc_id", "block"], [F.asc_nulls_first("page"), "ord"], schema, TitleLookup)
    named = met.groupBy("doc_id", "entry", "page").agg(F.min("ord").alias("ord"), F.bool_or(~F.col("margin")).alias("named")).where("named")
    each = named.join(keyed.drop("text"), ["doc_id", "entry"]).join(labels.withColumnRenamed("label", "printed"), PAGE, "left")
    same = F.lower("printed") == F.lower("label")
    sums = each.groupBy("doc_id", "entry").agg(
        F.count("*").alias("n"), F.count_if(same).alias("n_labelled"), F.min(F.struct("page", "ord")).alias("any"), F.min(F.when(same, F.struct("page", "ord"))).alias("labelled")
    )
    picked = F.when(F.col("n_labelled") == 1, F.col("labelled")).when(F.col("n") == 1, F.col("any"))
    found = entries.join(sums, ["doc_id", "entry"], "left").withColumn("at", picked)
    reason = F.when(F.col("n").isNull(), "toc_heading_unverified").when(F.col("at").isNull(), "toc_mapping_ambiguous")
    return found.select("doc_id", "entry", "title", "label", "depth", F.col("at.page").alias("page"), F.col("at.ord").alias("ord"), (F.coalesce("n_labelled", F.lit(0)) > 0).alias("labelled"), reason.alias("reason"))


def toc_repairs(mapped: DataFrame, bound: int = 32) -> DataFrame:
    """Entries found without their label: the offset, whether it exceeds the bound, and whether the entry is out of page order."""
    number = F.when(F.col("label").rlike("^[0-9]+$"), F.col("label").cast("long")).otherwise(F.col("page"))
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("entry"))
    return mapped.where("page is not null").select(
        "doc_id", "entry", "page", (~F.col("labelled")).alias("repaired"), (~F.col("labelled") & (F.abs(F.col("page") - number) > bound)).alias("beyond_bound"),
        F.coalesce(F.col("page") < before, F.lit(False)).alias("out_of_order"),
    )


def toc_failures(mapped: DataFrame, documents: DataFrame, bound: int = 32) -> DataFrame:
    """What fails the printed contents of each document (doc_id): its first entry without a place or beyond the bound of repairs, no entry at all, or
    entries out of page order; null if nothing does."""
    number = F.when(F.col("label").rlike("^[0-9]+$"), F.col("label").cast("long")).otherwise(F.col("page"))
    beyond = ~F.col("labelled") & (F.abs(F.col("page") - number) > bound)
    own = F.coalesce("reason", F.when(beyond, "toc_repair_bound_exceeded"))
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("entry"))
    judged = mapped.withColumns({"own": own, "back": F.coalesce(F.col("page") < before, F.lit(False))})
    sums = judged.groupBy("doc_id").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("entry"))).alias("first"), F.bool_or("back").alias("back"))
    failure = F.when(F.col("back").isNull(), "toc_structure_empty").otherwise(F.coalesce("first", F.when(F.col("back"), "toc_order_invalid")))
    return documents.select("doc_id").distinct().join(sums, "doc_id", "left").select("doc_id", failure.alias("failure"))


def verify_headings(proposed: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposed headings with ``verified``: the anchor stands in that page's navigation text."""
    body = pages.select(*PAGE, normalized_title(F.col("navigation_text")).alias("body"))
    ok = F.col("body").contains(normalized_title(F.col("anchor")))
    return proposed.join(body, PAGE, "left").withColumn("verified", F.coalesce(ok, F.lit(False))).drop("body")


def node_sizes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with chars, n_pages and leaf. Characters are a running sum over pages at the end less that before the start; pages may have ``chars`` in place of their text."""
    run = Window.partitionBy("doc_id").orderBy("page")
    chars = F.col("chars") if "chars" in pages.columns else F.length("text")
    sums = pages.select("doc_id", "page", chars.alias("own"), F.sum(chars).over(run).alias("upto"))
    start = sums.select("doc_id", F.col("page").alias("start"), (F.col("upto") - F.col("own")).alias("low"))
    end = sums.select("doc_id", F.col("page").alias("end"), F.col("upto").alias("high"))
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node"), F.lit(True).alias("has")).distinct()
    sized = nodes.join(start, ["doc_id", "start"], "left").join(end, ["doc_id", "end"], "left").join(parents, ["doc_id", "node"], "left")
    return sized.select(
        *nodes.columns, "low", "high", (F.col("high") - F.col("low")).alias("chars"), (F.col("end") - F.col("start") + 1).alias("n_pages"), F.col("has").isNull().alias("leaf")
    )


class Merging(Fold):
    """The last node kept, which the node before it may take in."""

    def __init__(self):
        self.last = None

    def row(self, doc_id, node, title, start, end, depth, parent, origin, low, high, leaf):
        last, kept = self.last, []
        if last is not None:
            _, _, l_title, l_start, l_end, l_depth, l_parent, _, l_low, l_high, l_leaf, l_merged = last
            alike = leaf and l_leaf and parent == l_parent and depth == l_depth and None not in (low, high, l_low, l_high)
            if alike and l_high - l_low < SMALL and l_high - l_low + high - low <= SMALL_MERGED and l_start <= end + 1:
                self.last = doc_id, node, title, start, max(end, l_end), depth, parent, origin, low, max(high, l_high), leaf, [l_title, *l_merged]
                return kept
            kept = self.close()
        self.last = doc_id, node, title, start, end, depth, parent, origin, low, high, leaf, []
        return kept

    def close(self):
        return [(*self.last[:8], " | ".join(t for t in self.last[-1] if t is not None))]


def merge_small(sized: DataFrame) -> DataFrame:
    """From the end, a leaf under 500 characters joins the sibling leaf before it while both have 5000 at most.

    A document's nodes stream by from the last; only the last one kept may still join the one before it. Nodes carry
    the running characters before their start and up to their end, so a joined node's size needs no pages.
    """
    own = sized.select("doc_id", "node", "title", "start", "end", "depth", "parent", "origin", "low", "high", "leaf")
    schema = T.StructType([*fields(own, *own.columns[:8]), T.StructField("merged_titles", T.StringType())])
    return fold(own, ["doc_id"], [F.desc("node")], schema, Merging)


def page_evidence() -> Column:
    """JSON of a page as a model would be given it."""
    return F.to_json(F.struct("page", "label", "text"), {"ignoreNullFields": "false"})


class Windows(Fold):
    """Number, pages and JSON characters of the open window."""

    def __init__(self, context_chars: int):
        self.most, self.window, self.n, self.chars = context_chars - 4000, 0, 0, 2

    def row(self, *values):
        *key, size = values
        # [a,b] is two brackets, the pages and the commas between them
        with_page = self.chars + size + (self.n > 0)
        if self.n >= WINDOW_PAGES or (self.n and with_page > self.most):
            self.window, self.n, with_page = self.window + 1, 0, size + 2
        self.n, self.chars = self.n + 1, with_page
        return [(*key, self.window, size)]

    def close(self):
        return []


def pack_windows(pages: DataFrame, context_chars: int, keys: list[str] | None = None) -> DataFrame:
    """Pages (doc_id, page, label, text), of documents or of groups of ``keys``, with ``window``: greedy runs of at most 8 pages within a budget of JSON characters; null with
    ``page_context_too_large`` where some page of the document cannot fit. Sizes stream by; the texts stay where they are."""
    keys = keys or ["doc_id"]
    sized = pages.select(*keys, "page", F.length(page_evidence()).alias("size"))
    schema = T.StructType([*fields(sized, *keys, "page"), T.StructField("window", T.IntegerType()), *fields(sized, "size")])
    packed = fold(sized, keys, ["page"], schema, lambda: Windows(context_chars))
    # {"pages":[...]} is 12 characters more than the page
    refused = F.max("size").over(Window.partitionBy(*keys)) + 12 > context_chars - 2000
    return packed.withColumn("refused", refused).select(
        *keys, "page", F.when(~F.col("refused"), F.col("window")).alias("window"), F.when(F.col("refused"), "page_context_too_large").alias("failure")
    )


def oversized_leaves(sized: DataFrame) -> DataFrame:
    """Leaves over 12 pages or 18000 characters; at depth 4 or more they cannot be divided."""
    large = sized.where("leaf").where((F.col("n_pages") > LEAF_PAGES) | (F.col("chars") > LEAF_CHARS))
    return large.select("doc_id", "node", "start", "end", "depth", F.when(F.col("depth") >= LEAF_DEPTH, "subdivision_depth_exceeded").alias("failure"))


def subdivide(leaves: DataFrame, proposed: DataFrame) -> DataFrame:
    """Children of oversized leaves (doc_id, node, start, end, depth) from verified headings (doc_id, node, page, ord, title, anchor): one a page.

    The failure is the leaf's: too few, not from its start, as many as pages, or a child as long as the leaf. A leaf without a verified heading has one row
    without a child.
    """
    inside = proposed.where("verified").join(leaves.where("failure is null").drop("failure"), ["doc_id", "node"]).where("page between start and end")
    one = inside.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "node", "page").orderBy("ord", "title"))).where("nth = 1")
    w = Window.partitionBy("doc_id", "node").orderBy("page")
    kids = one.withColumns({"child": F.row_number().over(w), "child_end": F.coalesce(F.lead("page").over(w), F.col("end"))})
    sums = kids.groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.min("page").alias("first"), F.max(F.col("child_end") - F.col("page")).alias("longest"))
    span = F.col("end") - F.col("start")
    poor = (F.col("n") < 2) | (F.col("first") != F.col("start")) | (F.col("n") >= span + 1)
    divided = leaves.where("failure is null").select("doc_id", "node", "start", "end", "depth")
    judged = divided.join(kids.drop("start", "end", "depth"), ["doc_id", "node"], "left").join(sums, ["doc_id", "node"], "left")
    failure = F.when(F.col("n").isNull() | poor, "subdivision_inadequate").when(F.col("longest") >= span, "subdivision_no_progress")
    return judged.select("doc_id", "node", F.col("child").cast("int").alias("child"), "title", "anchor", F.col("page").alias("child_start"), "child_end", (F.col("depth") + 1).alias("child_depth"), failure.alias("failure"))


def spliced(nodes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Trees with ``path`` (place in the order of the tree), ``anchor`` and ``merged_titles``, and with the children of ``subdivide`` after their leaves, numbered anew.

    All other columns of nodes stay; a child's origin is ``model``.
    """
    own, have = nodes, set(nodes.columns)
    missing = {"path": F.array("node"), "anchor": F.lit(None).cast("string"), "merged_titles": F.lit(None).cast("string"), "origin": F.lit(None).cast("string")}
    own = own.withColumns({c: v for c, v in missing.items() if c not in have})
    if children is None:
        return own
    above = own.select("doc_id", "node", F.col("path").alias("above"))
    kids = children.where("failure is null").join(above, ["doc_id", "node"]).select(
        "doc_id", F.concat("above", F.array("child")).alias("path"), "title", "anchor", F.col("child_start").alias("start"), F.col("child_end").alias("end"),
        F.col("child_depth").alias("depth"), F.col("node").alias("parent"), F.lit("model").alias("origin"), F.lit(False).alias("stuck"),
    )
    kids = kids.select(*[c for c in kids.columns if c in own.columns])
    numbered = own.unionByName(kids, allowMissingColumns=True).withColumn("new", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).cast("int"))
    named = numbered.where("node is not null").select("doc_id", F.col("node").alias("parent"), F.col("new").alias("new_parent"))
    found = numbered.join(named, ["doc_id", "parent"], "left").withColumns({"node": F.col("new"), "parent": F.col("new_parent")})
    return found.select(*own.columns)


def splice(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Trees (doc_id, node, title, start, end, depth, parent) with the children of ``subdivide`` after their leaves, numbered anew in order.

    Children of a leaf that failed stay out; origin, anchor and merged titles stay. The result is what ``validate_tree`` judges, children by their anchor.
    """
    return spliced(nodes, children).drop("path")


def own_runs(nodes: DataFrame) -> DataFrame:
    """Runs of pages of each node (doc_id, node, low, high) that lie under none of its children: what is left between its children in order, and after the last."""
    kids = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    before = Window.partitionBy("doc_id", "node").orderBy("k_start", "k_end").rowsBetween(Window.unboundedPreceding, -1)
    range_ = nodes.select("doc_id", "node", "start", "end")
    gaps = kids.withColumn("before", F.max("k_end").over(before)).join(range_, ["doc_id", "node"])
    gaps = gaps.select("doc_id", "node", F.greatest(F.col("start"), F.col("before") + 1).alias("low"), F.least(F.col("end"), F.col("k_start") - 1).alias("high"))
    last = kids.groupBy("doc_id", "node").agg(F.max("k_end").alias("last"))
    tails = range_.join(last, ["doc_id", "node"], "left").select("doc_id", "node", F.greatest(F.col("start"), F.col("last") + 1).alias("low"), F.col("end").alias("high"))
    return gaps.unionByName(tails).where("low <= high")


def own_pages(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each node that lie under none of its children: (doc_id, node, page), from its runs."""
    return own_runs(nodes).select("doc_id", "node", F.explode(F.sequence("low", "high")).alias("page"))


def own_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """A node's own text; a leaf of 1200 characters or fewer is its own summary."""
    joined = own_pages(nodes, pages).join(pages.select("doc_id", "page", "text"), PAGE)
    texts = joined.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("rows"))
    texts = texts.select("doc_id", "node", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("own"))
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node"), F.lit(True).alias("has")).distinct()
    found = nodes.join(texts, ["doc_id", "node"], "left").join(parents, ["doc_id", "node"], "left")
    own = F.coalesce("own", F.lit(""))
    short = F.col("has").isNull() & (F.length(own) <= SHORT_LEAF)
    return found.select("doc_id", "node", own.alias("own_text"), F.when(short, F.regexp_replace(own, r"(?U)^\s+|\s+$", "")).alias("summary"))


class Batches(Fold):
    """Number, parts and characters of the open batch of a node."""

    def __init__(self, context_chars: int):
        self.most, self.batch, self.n, self.chars = context_chars - 4000, -1, 0, 0

    def row(self, *values):
        *key, size = values
        if self.batch < 0 or self.n >= BATCH or self.chars + size >= self.most:
            self.batch, self.n, self.chars = self.batch + 1, 0, 0
        self.n, self.chars = self.n + 1, self.chars + size
        return [(*key, self.batch)]

    def close(self):
        return []


def rollup_batches(parts: DataFrame, context_chars: int) -> DataFrame:
    """Parts (doc_id, parent, pos, size) with ``batch``: greedy runs of at most 12 parts within a budget of characters; the first part always fits."""
    own = parts.select("doc_id", "parent", F.col("pos").cast("int").alias("pos"), F.col("size").cast("long").alias("size"))
    schema = T.StructType([*fields(own, "doc_id", "parent", "pos"), T.StructField("batch", T.IntegerType())])
    return fold(own, ["doc_id", "parent"], ["pos"], schema, lambda: Batches(context_chars))


def document_description(summaries: DataFrame) -> DataFrame:
    """First summary that isn't empty, 500 characters; empty without one."""
    filled = F.when(F.col("summary") != "", F.col("node"))
    return summaries.groupBy("doc_id").agg(F.substring(F.coalesce(F.min_by("summary", filled), F.lit("")), 1, 500).alias("description"))

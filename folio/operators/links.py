"""The link graph of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from folio.operators.folds import Fold, fields, fold
from folio.sources.scratch import dropped, stored

#: Where links and headings stand.
HTML_LINK = r"""(?i)<(?:a|img)\b[^>]*?\b(?:href|src)=["']([^"']*)["']"""
MARKDOWN_LINK = r"\]\(([^)\s]+)[^)]*\)"
HTML_HEADING = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
MARKDOWN_HEADING = r"(?m)^#{1,6}\s+(.+?)\s*#*\s*$"


def resolved_path(base: Column, target: Column) -> Column:
    """A relative target against the folder of ``base``: . and .. are taken out, as are empty parts."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, target), "/"), lambda p: (p != "") & (p != "."))
    def step(path, p):
        up = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(p == "..", up).otherwise(F.concat(path, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def decoded(part: Column) -> Column:
    """Percent codes of a link resolved; a plus is a plus. Null where a code is malformed."""
    return F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def hrefs(docs: DataFrame, pattern: str, absolute: bool) -> DataFrame:
    each = docs.select("path", F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("href"))
    kept = each.where((F.col("href") != "") & ~F.col("href").rlike(r"(?i)^[a-z][a-z\d+.-]*:"))
    return kept if absolute else kept.where(~F.col("href").startswith("/"))


def malformed_links(docs: DataFrame, pattern: str = HTML_LINK, absolute: bool = False) -> DataFrame:
    """G1: links (path, href) whose percent codes can't be resolved."""
    return hrefs(docs, pattern, absolute).where(decoded(F.col("href")).isNull())


def extract_links(docs: DataFrame, pattern: str = HTML_LINK, absolute: bool = False) -> DataFrame:
    """G1: links and images of docs (path, body): href, target path and anchor. Schemes are skipped, and rooted targets unless ``absolute``; malformed ones
    are those of ``malformed_links``."""
    kept = hrefs(docs, pattern, absolute)
    place = decoded(F.substring_index("href", "#", 1))
    anchor = F.when(F.col("href").contains("#"), decoded(F.regexp_replace("href", "^[^#]*#", ""))).otherwise("")
    kept = kept.where(place.isNotNull() & anchor.isNotNull())
    # a target that starts with / counts from the top
    target = F.when(place == "", F.col("path")).when(place.startswith("/"), resolved_path(F.lit(""), place)).otherwise(resolved_path(F.col("path"), place))
    return kept.select("path", "href", target.alias("target"), anchor.alias("anchor"))


def dangling_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links whose target is no document."""
    return links.join(docs.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


class Slugs(Fold):
    """Names in use on a page, and the last number that each name was given."""

    def __init__(self):
        self.used: set[str] = set()
        self.last: dict[str, int] = {}

    def row(self, path, pos, slug):
        name, n = slug, self.last.get(slug, 0)
        while name in self.used:
            n += 1
            name = f"{slug}-{n}"
        self.last[slug] = n
        self.used.add(name)
        return [(path, pos, name)]

    def close(self):
        return []


def heading_anchors(docs: DataFrame, pattern: str = HTML_HEADING) -> DataFrame:
    """The anchor of each heading: lower case, without punctuation, spaces as hyphens; a name in use gets -1, -2 and so on until it is free.

    Whether a name is in use depends on all before it: a page's headings stream by, with its names and a number for each name as state, so equal
    headings take one step each.
    """
    each = docs.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("pos", "heading"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("heading", "<[^>]*>", "")), r"[^\p{L}\p{N}\p{M}_ -]", ""), " ", "-")
    own = each.select("path", "pos", slug.alias("slug"))
    return fold(own, ["path"], ["pos"], T.StructType([*fields(own, "path", "pos"), T.StructField("anchor", T.StringType())]), Slugs)


def dangling_anchors(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links with an anchor that no heading of their target has."""
    there = anchors.select(F.col("path").alias("target"), "anchor").distinct()
    return links.where("anchor <> ''").join(there, ["target", "anchor"], "left_anti")


def _ends_of_chains(hooks: DataFrame) -> DataFrame:
    """hooks (node, top) followed to their ends by doubling; nodes on or behind a circle of hooks keep a top that is hooked itself."""
    now = stored(hooks.withColumn("open", F.lit(True)), "hooks")
    for _ in range(now.count().bit_length() + 1):
        if now.where("open").isEmpty():
            break
        ahead = now.select(F.col("node").alias("top"), F.col("top").alias("ahead"))
        new = stored(now.join(ahead, "top", "left").select("node", F.coalesce("ahead", "top").alias("top"), F.col("ahead").isNotNull().alias("open")), "hooks")
        dropped(now)
        now = new
    return now


def unreachable(docs: DataFrame, links: DataFrame, root: Column) -> DataFrame:
    """Documents that no path of links leads to from the documents where ``root`` holds.

    Each round takes a step from what was reached last, leaves out the links into it, and makes one of each chain: a document that one link alone leads to
    is reached with the document before it, so it joins that one, by doubling. A chain of any length takes one round, and a round reads only the links
    between documents that are not settled; documents that many lead to are reached step by step.
    """
    paths = docs.select("path").distinct()
    there = lambda df, c: df.join(paths.select(F.col("path").alias(c)), c, "left_semi")
    edges = stored(there(there(links.select("path", "target").where("path <> target").distinct(), "path"), "target"), "edges")
    labels = stored(paths.select("path", F.col("path").alias("label")), "labels")
    new = stored(docs.where(root).select(F.col("path").alias("label")).distinct(), "reached")
    edges, reached = _without(edges, new, "target"), [new]
    while True:
        found = stored(edges.join(new, F.col("path") == F.col("label"), "left_semi").select(F.col("target").alias("label")).distinct(), "reached")
        if found.isEmpty():
            break
        reached.append(found)
        left = stored(_without(_without(edges, new, "path"), found, "target"), "edges")
        lone = left.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("path").alias("top")).where("n = 1").drop("n")
        ends = _ends_of_chains(lone)
        apart = left.join(ends.select(F.col("node").alias("target")), "target", "left_anti")
        tops = ends.select(F.col("node").alias("path"), "top", F.col("open").alias("circle"))
        apart = apart.join(tops, "path", "left").where("circle is null or not circle").select(F.coalesce("top", "path").alias("path"), "target")
        named = labels.join(ends.where("not open").select(F.col("node").alias("label"), "top"), "label", "left").select("path", F.coalesce("top", "label").alias("label"))
        edges, labels, old = stored(apart.where("path <> target").distinct(), "edges"), stored(named, "labels"), (left, ends, labels)
        dropped(*old)
        new = found
    every = reduce(DataFrame.union, reached)
    return docs.select("path").join(labels.join(every, "label", "left_semi").select("path"), "path", "left_anti")


def _without(edges: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    return edges.join(labels.select(F.col("label").alias(end)), end, "left_anti")

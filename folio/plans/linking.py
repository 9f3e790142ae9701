"""Queries of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.operators import links
from folio.plans.registry import query
from folio.sources import tables

# a page is the document of the first part of its address; its links name such parts
SQL = r"""docs AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^./?#]+)', 1) AS path, html AS body FROM pages
), anchors AS (SELECT page_id, path, unnest(regexp_extract_all(body, '(?i)<(?:a|img)\b[^>]*?\b(?:href|src)=["'']([^"'']*)["'']', 1)) AS href FROM docs),
kept AS (SELECT * FROM anchors WHERE href <> '' AND NOT regexp_matches(href, '(?i)^[a-z][a-z\d+.-]*:')),
links AS (SELECT DISTINCT path, href, ltrim(regexp_replace(href, '#.*$', ''), '/') AS place FROM kept),
resolved AS (SELECT path, href, CASE WHEN place = '' THEN path ELSE url_decode(place) END AS target, url_decode(CASE WHEN contains(href, '#') THEN regexp_replace(href, '^[^#]*#', '') ELSE '' END) AS anchor FROM links)"""


def docs(spark, sf_dir) -> DataFrame:
    own = tables.read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return own.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^./?#]+)", 1).alias("path"), F.col("html").alias("body"))


def found(spark, sf_dir) -> DataFrame:
    return links.extract_links(docs(spark, sf_dir), absolute=True).distinct()


@query("G1_extract_links", f"WITH {SQL} SELECT path, href, target, anchor FROM resolved")
def g1(spark, sf_dir):
    return found(spark, sf_dir)


@query("G2_dangling_links", f"WITH {SQL} SELECT path, href, target, anchor FROM resolved WHERE target NOT IN (SELECT path FROM docs)")
def g2(spark, sf_dir):
    return links.dangling_links(found(spark, sf_dir), docs(spark, sf_dir)).select("path", "href", "target", "anchor")


BROKEN = """concat(html, CASE WHEN page_id % 3 = 0 THEN '<a href="a/%zz#x">' WHEN page_id % 3 = 1 THEN '<a href="50%">' ELSE '' END)"""


@query("G1_malformed_links", f"WITH {SQL.replace('html AS body', f'{BROKEN} AS body')} SELECT path, href FROM kept WHERE regexp_matches(href, '%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))')")
def g1b(spark, sf_dir):
    own = tables.read_table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("html", F.expr(BROKEN))
    return links.malformed_links(own.select(F.regexp_extract("url", r"^[a-z]+://([^./?#]+)", 1).alias("path"), F.col("html").alias("body")), absolute=True)


SLUGS = SQL + r""", heads AS (
  SELECT CAST(page_id AS VARCHAR) AS path, unnest(h) AS heading, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(concat(body, '<h2>A b</h2><h2>a b-1</h2><h3>a B</h3><h3>a b</h3>'), '(?is)<(?:h[1-6]|li)[^>]*>(.*?)</(?:h[1-6]|li)>', 1) AS h FROM docs)
), slugs AS (
  SELECT path, pos, replace(regexp_replace(lower(regexp_replace(heading, '<[^>]*>', '', 'g')), '[^\p{L}\p{N}\p{M}_ -]', '', 'g'), ' ', '-') AS slug FROM heads
), marks AS (
  SELECT path, pos, slug AS anchor, [slug] AS used FROM slugs WHERE pos = 0
  UNION ALL
  SELECT path, pos, anchor, list_append(used, anchor) FROM (
    SELECT s.path, s.pos, m.used, CASE WHEN list_contains(m.used, s.slug) THEN s.slug || '-' || CAST(list_filter(range(1, len(m.used) + 2), lambda i: NOT list_contains(m.used, s.slug || '-' || CAST(i AS VARCHAR)))[1] AS VARCHAR) ELSE s.slug END AS anchor
    FROM marks m JOIN slugs s ON s.path = m.path AND s.pos = m.pos + 1
  )
)"""
HEADINGS = r"(?is)<(?:h[1-6]|li)[^>]*>(.*?)</(?:h[1-6]|li)>"


def marks(spark, sf_dir) -> DataFrame:
    # names that are taken twice, one of them as another heading's own
    own = docs(spark, sf_dir).withColumns({"path": F.col("page_id").cast("string"), "body": F.concat("body", F.lit("<h2>A b</h2><h2>a b-1</h2><h3>a B</h3><h3>a b</h3>"))})
    return links.heading_anchors(own, HEADINGS)


@query("G3_heading_anchors", f"WITH RECURSIVE {SLUGS} SELECT path, pos, anchor FROM marks")
def g3(spark, sf_dir):
    return marks(spark, sf_dir)


@query("G3_dangling_anchors", f"WITH RECURSIVE {SLUGS}, asked AS (SELECT path, path AS target, CASE WHEN pos % 3 = 0 THEN anchor || '-9' ELSE anchor END AS anchor FROM marks) SELECT path, target, anchor FROM asked a WHERE anchor <> '' AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = a.target AND m.anchor = a.anchor)")
def g3b(spark, sf_dir):
    own = marks(spark, sf_dir)
    asked = own.select("path", F.col("path").alias("target"), F.when(F.col("pos") % 3 == 0, F.concat("anchor", F.lit("-9"))).otherwise(F.col("anchor")).alias("anchor"))
    return links.dangling_anchors(asked, own).select("path", "target", "anchor")


@query(
    "G4_unreachable",
    f"""WITH RECURSIVE {SQL}, nodes AS (SELECT DISTINCT path FROM docs), edges AS (SELECT DISTINCT path, target FROM resolved WHERE target IN (SELECT path FROM nodes)),
    reach AS (SELECT min(path) AS path FROM nodes UNION SELECT e.target FROM reach r JOIN edges e ON e.path = r.path) SELECT path FROM nodes WHERE path NOT IN (SELECT path FROM reach)""",
)
def g4(spark, sf_dir):
    own = docs(spark, sf_dir).select("path").distinct()
    first = own.agg(F.min("path")).first()[0]
    return links.unreachable(own, found(spark, sf_dir), F.col("path") == F.lit(first))

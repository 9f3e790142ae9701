"""Queries of chapter trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.operators import refining, trees
from folio.plans.corpus import OUTLINES, outlines
from folio.plans.derived import CANDIDATES, LEVELS, PAGES, TREE, lines, long_lines, one_a_page, pages, squeeze
from folio.plans.registry import query
from folio.sources import tables
from folio.sources.scratch import stored


def tree(spark, sf_dir) -> DataFrame:
    return trees.build_tree(lines(spark, sf_dir))


@query("T1_body_height", f"WITH {CANDIDATES} SELECT doc_id, body FROM body")
def t1(spark, sf_dir):
    return trees.body_height(lines(spark, sf_dir))


@query("T2_heading_candidates", f"WITH {CANDIDATES} SELECT doc_id, page, ord, text FROM candidates")
def t2(spark, sf_dir):
    return trees.heading_candidates(lines(spark, sf_dir)).select("doc_id", "page", "ord", "text")


@query("T3_font_levels", f"WITH {LEVELS} SELECT doc_id, page, ord, level FROM levels")
def t3(spark, sf_dir):
    return trees.font_levels(trees.heading_candidates(lines(spark, sf_dir))).select("doc_id", "page", "ord", "level")


@query("T4_heading_depth", f"WITH {LEVELS} SELECT doc_id, page, ord, title, depth FROM headings")
def t4(spark, sf_dir):
    return trees.headings_from_lines(lines(spark, sf_dir)).drop("origin")


FUSED = LEVELS + ", " + OUTLINES.removeprefix(PAGES + ", ") + f""", keyed AS (
  SELECT *, {squeeze('title')} AS key FROM headings
), verified AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, key ORDER BY seq) AS nth FROM (SELECT *, {squeeze('title')} AS key FROM outlines WHERE verified)) WHERE nth = 1
),
fused AS (
  SELECT k.doc_id, k.page, k.ord, k.title, k.depth,
    CASE WHEN EXISTS (SELECT 1 FROM verified v WHERE v.doc_id = k.doc_id AND v.page = k.page AND v.key = k.key)
      AND k.ord = (SELECT min(f.ord) FROM keyed f WHERE f.doc_id = k.doc_id AND f.page = k.page AND f.key = k.key) THEN 'outline' ELSE k.origin END AS origin
  FROM keyed k
  UNION ALL
  SELECT v.doc_id, v.page, coalesce((SELECT min(l.ord) FROM lines l WHERE l.doc_id = v.doc_id AND l.page = v.page AND contains({squeeze('l.text')}, v.key)), 0), v.title, v.depth, 'outline'
  FROM verified v WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.doc_id = v.doc_id AND k.page = v.page AND k.key = v.key)
)"""


@query("T5_fuse_outlines", f"WITH {FUSED} SELECT doc_id, page, ord, title, depth, origin FROM fused")
def t5(spark, sf_dir):
    own = lines(spark, sf_dir)
    return trees.fuse_outlines(trees.headings_from_lines(own), outlines(spark, sf_dir), own).select("doc_id", "page", "ord", "title", "depth", "origin")


@query("T6_dedupe_headings", f"WITH {TREE} SELECT doc_id, page, ord, title FROM uniq")
def t6(spark, sf_dir):
    return trees.dedupe_headings(trees.headings_from_lines(lines(spark, sf_dir))).select("doc_id", "page", "ord", "title")


@query("T7_add_front_matter", f"WITH {TREE} SELECT doc_id, page, ord, title, depth, origin FROM fronted")
def t7(spark, sf_dir):
    return trees.add_front_matter(trees.dedupe_headings(trees.headings_from_lines(lines(spark, sf_dir))))


@query("T8_assign_hierarchy", f"WITH {TREE} SELECT doc_id, node, depth, parent FROM tree")
def t8(spark, sf_dir):
    heads = trees.add_front_matter(trees.dedupe_headings(trees.headings_from_lines(lines(spark, sf_dir))))
    return trees.assign_hierarchy(heads).select("doc_id", "node", "depth", "parent")


@query("T9_assign_ranges", f"""WITH {TREE} SELECT doc_id, node, start, "end" FROM tree""")
def t9(spark, sf_dir):
    return tree(spark, sf_dir).select("doc_id", "node", "start", "end")


@query(
    "T10_validate_tree",
    f"""WITH {TREE}, flawed AS (
      SELECT doc_id, node, CASE WHEN node % 5 = 3 AND doc_id % 4 = 1 THEN '' ELSE title END AS title, start, "end" + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS "end", depth, parent, origin FROM tree
    ), judged AS (
      SELECT f.doc_id, f.node, CASE WHEN f.title = '' THEN 'tree_identity_invalid' WHEN f."end" > c.n_pages THEN 'tree_range_invalid'
        WHEN p.node IS NOT NULL AND f."end" > p."end" THEN 'tree_parent_invalid'
        WHEN f.origin <> 'coverage' AND NOT contains({squeeze('x.text')}, {squeeze('f.title')}) THEN 'tree_location_unverified' WHEN f.origin <> 'coverage' AND {squeeze('f.title')} = '' THEN 'tree_location_unverified' END AS failure
      FROM flawed f JOIN page_counts c USING (doc_id) LEFT JOIN flawed p ON p.doc_id = f.doc_id AND p.node = f.parent LEFT JOIN page_text x ON x.doc_id = f.doc_id AND x.page = f.start
    )
    SELECT doc_id, arg_min(failure, node) FILTER (WHERE failure IS NOT NULL) AS failure FROM judged GROUP BY doc_id""",
)
def t10(spark, sf_dir):
    blank = (F.col("node") % 5 == 3) & (F.col("doc_id") % 4 == 1)
    flawed = tree(spark, sf_dir).withColumns({"title": F.when(blank, "").otherwise(F.col("title")), "end": F.col("end") + (F.col("doc_id") % 4 == 2).cast("int")})
    return trees.validate_tree(flawed, pages(spark, sf_dir))


@query("T11_page_coverage", f"""WITH {TREE} SELECT doc_id, CAST(count(DISTINCT p) AS INT) AS covered FROM (SELECT doc_id, unnest(range(start, "end" + 1)) AS p FROM tree) GROUP BY doc_id""")
def t11(spark, sf_dir):
    return trees.page_coverage(tree(spark, sf_dir))


@query("T12_build_tree", f"""WITH {TREE} SELECT doc_id, node, title, start, "end", depth, parent, origin FROM tree""")
def t12(spark, sf_dir):
    return tree(spark, sf_dir)


@query("T12_without_structure", f"WITH {TREE} SELECT DISTINCT doc_id, 'structural_extraction_inadequate' AS failure FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM tree)")
def t12b(spark, sf_dir):
    own = lines(spark, sf_dir)
    return trees.without_structure(own, trees.build_tree(own))


TOC = PAGES + r""", led AS (SELECT doc_id, page, ord, CASE WHEN doc_id % 3 = 0 AND page = 1 THEN concat(text, ' ...... ', CAST(ord AS VARCHAR)) WHEN doc_id % 7 = 0 AND page = 2 THEN 'Contents ' || text ELSE text END AS text FROM lines),
toc AS (SELECT doc_id, page FROM led WHERE page <= 20 GROUP BY doc_id, page
  HAVING bool_or(regexp_matches(text, '(?i)contents|目录')) OR count(*) FILTER (WHERE regexp_matches(text, '(?i)\.{3,}\s*(\d+|[ivxlcdm]+)$')) >= 2)"""


def led(spark, sf_dir) -> DataFrame:
    dotted = F.concat("text", F.lit(" ...... "), F.col("ord").cast("string"))
    return lines(spark, sf_dir).withColumn(
        "text", F.when((F.col("doc_id") % 3 == 0) & (F.col("page") == 1), dotted).when((F.col("doc_id") % 7 == 0) & (F.col("page") == 2), F.concat(F.lit("Contents "), "text")).otherwise(F.col("text"))
    )


@query("T13_toc_pages", f"WITH {TOC} SELECT doc_id, page FROM toc")
def t13(spark, sf_dir):
    return trees.toc_pages(led(spark, sf_dir))


ENTRIES = TOC + f""", entries AS (
  SELECT doc_id, page * 10 + ord AS entry, substr(text, 1, 30) AS title, CASE WHEN page % 3 = 0 THEN CAST(page AS VARCHAR) WHEN page % 3 = 1 THEN CAST(page + 40 AS VARCHAR) ELSE 'x' || CAST(page AS VARCHAR) END AS label, 0 AS depth
  FROM lines WHERE ord = 2 AND length(text) >= 30
), met AS (
  SELECT e.doc_id, e.entry, e.label, l.page, min(l.ord) AS ord, lower(CAST(l.page AS VARCHAR)) = lower(e.label) AS same
  FROM entries e JOIN led l ON l.doc_id = e.doc_id AND contains({squeeze('l.text')}, {squeeze('e.title')}) AND NOT EXISTS (SELECT 1 FROM toc t WHERE t.doc_id = l.doc_id AND t.page = l.page)
  GROUP BY e.doc_id, e.entry, e.label, l.page HAVING bool_or(NOT (l.ord = 0 AND l.page % 2 = 0))
), picked AS (
  SELECT doc_id, entry, count(*) AS n, count(*) FILTER (WHERE same) AS k, CASE WHEN count(*) FILTER (WHERE same) = 1 THEN min(page) FILTER (WHERE same) WHEN count(*) = 1 THEN min(page) END AS page,
    CASE WHEN count(*) FILTER (WHERE same) = 1 THEN min(ord) FILTER (WHERE same) WHEN count(*) = 1 THEN min(ord) END AS ord
  FROM met GROUP BY doc_id, entry
), mapped AS (
  SELECT e.doc_id, e.entry, e.title, e.label, e.depth, p.page, p.ord, coalesce(p.k, 0) > 0 AS labelled,
    CASE WHEN p.n IS NULL THEN 'toc_heading_unverified' WHEN p.page IS NULL THEN 'toc_mapping_ambiguous' END AS reason
  FROM entries e LEFT JOIN picked p USING (doc_id, entry)
)"""


def mapped(spark, sf_dir) -> DataFrame:
    own = led(spark, sf_dir)
    page = F.col("page").cast("string")
    label = F.when(F.col("page") % 3 == 0, page).when(F.col("page") % 3 == 1, (F.col("page") + 40).cast("string")).otherwise(F.concat(F.lit("x"), page))
    entries = lines(spark, sf_dir).where("ord = 2 and length(text) >= 30").select(
        "doc_id", (F.col("page") * 10 + F.col("ord")).alias("entry"), F.substring("text", 1, 30).alias("title"), label.alias("label"), F.lit(0).alias("depth")
    )
    labels = own.select("doc_id", "page", page.alias("label")).distinct()
    # the first line of every second page counts as its margin
    bordered = own.withColumn("margin", (F.col("ord") == 0) & (F.col("page") % 2 == 0))
    return trees.map_toc(entries, bordered, trees.toc_pages(own), labels)


@query("T14_map_toc", f"WITH {ENTRIES} SELECT doc_id, entry, title, label, depth, page, ord, labelled, reason FROM mapped")
def t14(spark, sf_dir):
    return mapped(spark, sf_dir)


@query(
    "T15_toc_repairs",
    f"""WITH {ENTRIES} SELECT doc_id, entry, page, NOT labelled AS repaired, NOT labelled AND abs(page - CASE WHEN regexp_full_match(label, '[0-9]+') THEN CAST(label AS BIGINT) ELSE page END) > 32 AS beyond_bound,
      coalesce(page < lag(page) OVER (PARTITION BY doc_id ORDER BY entry), false) AS out_of_order FROM mapped WHERE page IS NOT NULL""",
)
def t15(spark, sf_dir):
    return trees.toc_repairs(mapped(spark, sf_dir))


PROPOSED = PAGES + f""", proposed AS (SELECT doc_id, page + CASE WHEN ord = 3 THEN 1 ELSE 0 END AS page, ord, substr(text, 3, 40) AS anchor FROM lines WHERE ord IN (1, 3)),
checked AS (SELECT p.*, coalesce(contains({squeeze('x.text')}, {squeeze('p.anchor')}), false) AS verified FROM proposed p LEFT JOIN page_text x ON x.doc_id = p.doc_id AND x.page = p.page)"""


@query(
    "T15_toc_failures",
    f"""WITH {ENTRIES}, judged AS (
      SELECT *, coalesce(reason, CASE WHEN NOT labelled AND abs(page - CASE WHEN regexp_full_match(label, '[0-9]+') THEN CAST(label AS BIGINT) ELSE page END) > 32 THEN 'toc_repair_bound_exceeded' END) AS own,
        coalesce(page < lag(page) OVER (PARTITION BY doc_id ORDER BY entry), false) AS back FROM mapped
    ), s AS (SELECT doc_id, arg_min(own, entry) FILTER (WHERE own IS NOT NULL) AS first, bool_or(back) AS back FROM judged GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN s.back IS NULL THEN 'toc_structure_empty' WHEN first IS NOT NULL THEN first WHEN s.back THEN 'toc_order_invalid' END AS failure
    FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id)""",
)
def t15b(spark, sf_dir):
    return trees.toc_failures(mapped(spark, sf_dir), tables.read_table(spark, sf_dir, "documents", "doc_id"))


@query("T16_verify_headings", f"WITH {PROPOSED} SELECT doc_id, page, ord, anchor, verified FROM checked")
def t16(spark, sf_dir):
    own = lines(spark, sf_dir).where("ord in (1, 3)")
    proposed = own.select("doc_id", (F.col("page") + (F.col("ord") == 3).cast("int")).alias("page"), "ord", F.substring("text", 3, 40).alias("anchor"))
    return trees.verify_headings(proposed, pages(spark, sf_dir)).select("doc_id", "page", "ord", "anchor", "verified")


SIZED = TREE + """, sized AS (
  SELECT t.*, (SELECT sum(length(p.text)) FROM page_text p WHERE p.doc_id = t.doc_id AND p.page BETWEEN t.start AND t."end") AS chars, t."end" - t.start + 1 AS n_pages,
    NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent = t.node) AS leaf
  FROM tree t
)"""


def sized(spark, sf_dir) -> DataFrame:
    return trees.node_sizes(tree(spark, sf_dir), pages(spark, sf_dir))


@query("T17_node_sizes", f"WITH {SIZED} SELECT doc_id, node, CAST(chars AS BIGINT) AS chars, n_pages, leaf FROM sized")
def t17(spark, sf_dir):
    return sized(spark, sf_dir).select("doc_id", "node", "chars", "n_pages", "leaf")


MERGED = "WITH RECURSIVE " + SIZED + """, back AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node DESC) AS n FROM sized), steps AS (
  SELECT doc_id, n, node, title, start, "end", depth, parent, origin, leaf, chars, CAST('' AS VARCHAR) AS merged, false AS joined FROM back WHERE n = 1
  UNION ALL
  SELECT b.doc_id, b.n, b.node, b.title, b.start, CASE WHEN j THEN greatest(b."end", l_end) ELSE b."end" END, b.depth, b.parent, b.origin, b.leaf,
    CASE WHEN j THEN (SELECT sum(length(p.text)) FROM page_text p WHERE p.doc_id = b.doc_id AND p.page BETWEEN b.start AND greatest(b."end", l_end)) ELSE b.chars END,
    CASE WHEN j THEN concat_ws(' | ', l_title, nullif(l_merged, '')) ELSE '' END, j
  FROM (
    SELECT b.*, s.title AS l_title, s."end" AS l_end, s.merged AS l_merged,
      b.leaf AND s.leaf AND b.parent IS NOT DISTINCT FROM s.parent AND b.depth = s.depth AND s.chars < 500 AND s.chars + b.chars <= 5000 AND s.start <= b."end" + 1 AS j
    FROM steps s JOIN back b ON b.doc_id = s.doc_id AND b.n = s.n + 1
  ) b
)
SELECT doc_id, node, title, start, "end", depth, parent, origin, merged AS merged_titles FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps x WHERE x.doc_id = s.doc_id AND x.n = s.n + 1 AND x.joined)"""


@query("T18_merge_small", MERGED)
def t18(spark, sf_dir):
    return trees.merge_small(sized(spark, sf_dir))


WINDOWS = "WITH RECURSIVE " + PAGES + """, j AS (
  SELECT doc_id, page, length(concat('{"page":', CAST(page AS VARCHAR), ',"label":null,"text":', CAST(to_json(text) AS VARCHAR), '}')) AS size FROM page_text
), w AS (
  SELECT doc_id, page, 0 AS win, 1 AS n, size + 2 AS chars FROM j WHERE page = 1
  UNION ALL
  SELECT j.doc_id, j.page, CASE WHEN w.n >= 8 OR w.chars + j.size + 1 > 8000 THEN w.win + 1 ELSE w.win END, CASE WHEN w.n >= 8 OR w.chars + j.size + 1 > 8000 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 8 OR w.chars + j.size + 1 > 8000 THEN j.size + 2 ELSE w.chars + j.size + 1 END
  FROM w JOIN j ON j.doc_id = w.doc_id AND j.page = w.page + 1
), large AS (SELECT doc_id FROM j GROUP BY doc_id HAVING max(size) + 12 > 10000)
SELECT doc_id, page, CASE WHEN doc_id NOT IN (SELECT doc_id FROM large) THEN win END AS "window", CASE WHEN doc_id IN (SELECT doc_id FROM large) THEN 'page_context_too_large' END AS failure FROM w"""


@query("T19_pack_windows", WINDOWS)
def t19(spark, sf_dir):
    labelled = pages(spark, sf_dir).withColumn("label", F.lit(None).cast("string"))
    return trees.pack_windows(labelled.select("doc_id", "page", "label", "text"), 12000)


# documents with a line a page are long enough to be divided
LONG = one_a_page(SIZED)


def long_sized(spark, sf_dir) -> DataFrame:
    own = long_lines(spark, sf_dir)
    return trees.node_sizes(trees.build_tree(own), tables.page_texts(own))


@query("T20_oversized_leaves", f"""WITH {LONG} SELECT doc_id, node, start, "end", depth, CASE WHEN depth >= 4 THEN 'subdivision_depth_exceeded' END AS failure FROM sized WHERE leaf AND (n_pages > 12 OR chars > 18000)""")
def t20(spark, sf_dir):
    return trees.oversized_leaves(long_sized(spark, sf_dir))


DIVIDED = LONG + """, big AS (SELECT doc_id, node, start, "end", depth FROM sized WHERE leaf AND (n_pages > 12 OR chars > 18000) AND depth < 4),
inside AS (SELECT b.*, l.page, l.ord, substr(l.text, 1, 40) AS title FROM big b JOIN lines l ON l.doc_id = b.doc_id AND l.page BETWEEN b.start AND b."end" AND ((l.page % 3 = 0 AND l.doc_id % 4 <> 1) OR (l.page = b.start AND l.doc_id % 4 <> 2)) AND l.doc_id % 4 <> 3),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, node, page ORDER BY ord, title) AS nth FROM inside),
kids AS (SELECT *, row_number() OVER w AS child, coalesce(lead(page) OVER w, "end") AS child_end FROM one WHERE nth = 1 WINDOW w AS (PARTITION BY doc_id, node ORDER BY page)),
sums AS (SELECT doc_id, node, count(*) AS n, min(page) AS first, max(child_end - page) AS longest FROM kids GROUP BY doc_id, node),
divided AS (
  SELECT b.doc_id, b.node, CAST(k.child AS INT) AS child, k.title, k.page AS child_start, k.child_end, b.depth + 1 AS child_depth,
    CASE WHEN n IS NULL OR n < 2 OR first <> b.start OR n >= b."end" - b.start + 1 THEN 'subdivision_inadequate' WHEN longest >= b."end" - b.start THEN 'subdivision_no_progress' END AS failure
  FROM big b LEFT JOIN kids k ON k.doc_id = b.doc_id AND k.node = b.node LEFT JOIN sums s ON s.doc_id = b.doc_id AND s.node = b.node
)"""


def divided(spark, sf_dir, nodes: DataFrame | None = None) -> DataFrame:
    body = stored(tables.page_texts(long_lines(spark, sf_dir)).select("doc_id", "page", F.length("text").alias("chars"), "navigation_text"), "pages")
    nodes = trees.build_tree(long_lines(spark, sf_dir)) if nodes is None else nodes
    leaves = trees.oversized_leaves(trees.node_sizes(nodes, body))
    found = long_lines(spark, sf_dir).join(leaves.select("doc_id", "node", "start", "end"), "doc_id").where("page between start and end and doc_id % 4 <> 3")
    found = found.where("(page % 3 = 0 and doc_id % 4 <> 1) or (page = start and doc_id % 4 <> 2)")
    title = F.substring("text", 1, 40)
    proposed = found.select("doc_id", "node", "page", "ord", title.alias("title"), title.alias("anchor"))
    return trees.subdivide(leaves, trees.verify_headings(proposed, body))


@query("T21_subdivide", f"WITH {DIVIDED} SELECT * FROM divided")
def t21(spark, sf_dir):
    return divided(spark, sf_dir).drop("anchor")


@query(
    "T21_splice",
    f"""WITH {DIVIDED}, together AS (
      SELECT doc_id, node, 0 AS child, title, start, "end", depth, parent, origin, NULL AS anchor FROM tree
      UNION ALL SELECT doc_id, node, child, title, child_start, child_end, child_depth, node, 'model', title FROM divided WHERE failure IS NULL
    ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node, child) - 1 AS INT) AS new FROM together)
    SELECT r.doc_id, r.new AS node, r.title, r.start, r."end", r.depth, p.new AS parent, r.origin, r.anchor FROM ranked r LEFT JOIN ranked p ON p.doc_id = r.doc_id AND p.node = r.parent AND p.child = 0""",
)
def t21b(spark, sf_dir):
    nodes = stored(trees.build_tree(long_lines(spark, sf_dir)), "nodes")
    return trees.splice(nodes, divided(spark, sf_dir, nodes)).drop("merged_titles")


# pages divide leaves by twenties, and what comes of that by fives; every node of the first tree is a boundary too
GROWN = "WITH RECURSIVE " + LONG + """, proposed AS (
  SELECT DISTINCT d.depth, l.doc_id, l.page, substr(l.text, 1, 40) AS title FROM lines l, (SELECT unnest([0, 1, 2, 3]) AS depth) d
  WHERE l.doc_id % 4 <> 3 AND (l.page % (CASE WHEN d.depth = 0 THEN 20 ELSE 5 END) = 0 OR EXISTS (SELECT 1 FROM tree t WHERE t.doc_id = l.doc_id AND t.start = l.page) OR (l.page % 20 = 0))
), upto AS (SELECT doc_id, page, length(text) AS own, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page) AS upto FROM page_text),
grown AS (
  SELECT doc_id, [node] AS path, title, start, "end", depth, origin, CAST(NULL AS VARCHAR) AS anchor, leaf AND (n_pages > 12 OR chars > 18000) AS big FROM sized
  UNION ALL
  SELECT k.doc_id, list_append(k.path, CAST(k.child AS INT)), k.title, k.page, k.child_end, k.depth + 1, 'model', k.title, k.child_end - k.page + 1 > 12 OR b.upto - a.upto + a.own > 18000
  FROM (
    SELECT *, max(child_end - page) OVER leaf AS longest, count(*) OVER leaf AS n, min(page) OVER leaf AS first FROM (
      SELECT g.doc_id, g.path, g.depth, g.start, g."end", p.page, p.title, row_number() OVER w AS child, coalesce(lead(p.page) OVER w, g."end") AS child_end
      FROM grown g JOIN proposed p ON p.doc_id = g.doc_id AND p.depth = g.depth AND p.page BETWEEN g.start AND g."end" WHERE g.big AND g.depth < 4 WINDOW w AS (PARTITION BY g.doc_id, g.path ORDER BY p.page)
    ) WINDOW leaf AS (PARTITION BY doc_id, path)
  ) k JOIN upto a ON a.doc_id = k.doc_id AND a.page = k.page JOIN upto b ON b.doc_id = k.doc_id AND b.page = k.child_end
  WHERE k.n >= 2 AND k.first = k.start AND k.n < k."end" - k.start + 1 AND k.longest < k."end" - k.start
), stuck AS (
  SELECT g.doc_id, g.path, CASE WHEN g.depth >= 4 THEN 'subdivision_depth_exceeded' WHEN p.n IS NULL OR p.n < 2 OR p.first <> g.start OR p.n >= g."end" - g.start + 1 THEN 'subdivision_inadequate' ELSE 'subdivision_no_progress' END AS failure
  FROM grown g LEFT JOIN (
    SELECT g.doc_id, g.path, count(*) AS n, min(p.page) AS first FROM grown g JOIN proposed p ON p.doc_id = g.doc_id AND p.depth = g.depth AND p.page BETWEEN g.start AND g."end" WHERE g.big GROUP BY g.doc_id, g.path
  ) p ON p.doc_id = g.doc_id AND p.path = g.path
  WHERE g.big AND NOT EXISTS (SELECT 1 FROM grown c WHERE c.doc_id = g.doc_id AND len(c.path) = len(g.path) + 1 AND c.path[1:len(g.path)] = g.path)
), failed AS (SELECT doc_id, arg_min(failure, path) AS failure FROM stuck GROUP BY doc_id)"""


def grown(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    own, nodes = long_lines(spark, sf_dir), trees.build_tree(long_lines(spark, sf_dir))
    depth = F.explode(F.array(*map(F.lit, range(4)))).alias("depth")
    starts = nodes.select("doc_id", F.col("start").alias("page"), F.lit(True).alias("starts")).distinct()
    each = own.where("doc_id % 4 <> 3").join(starts, ["doc_id", "page"], "left").select("doc_id", "page", "ord", F.substring("text", 1, 40).alias("title"), "starts", depth)
    asked = each.where("starts or page % 20 = 0 or (depth > 0 and page % 5 = 0)").select("doc_id", "depth", "page", "ord", "title", F.col("title").alias("anchor"))
    return refining.subdivide_to_end(nodes, tables.page_texts(own), asked)


@query(
    "T21_subdivide_to_end",
    f"""{GROWN}, kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INT) AS node FROM grown WHERE doc_id NOT IN (SELECT doc_id FROM failed))
    SELECT k.doc_id, k.node, k.title, k.start, k."end", k.depth, k.origin, k.anchor, (SELECT max(p.node) FROM kept p WHERE p.doc_id = k.doc_id AND p.node < k.node AND p.depth = k.depth - 1) AS parent FROM kept k""",
)
def t21c(spark, sf_dir):
    return grown(spark, sf_dir)[0].drop("merged_titles")


@query("T21_subdivision_failures", f"{GROWN} SELECT doc_id, failure FROM failed")
def t21d(spark, sf_dir):
    return grown(spark, sf_dir)[1]


OWN = TREE + """, own_pages AS (
  SELECT t.doc_id, t.node, p.page, p.text FROM tree t JOIN page_text p ON p.doc_id = t.doc_id AND p.page BETWEEN t.start AND t."end"
  WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent = t.node AND p.page BETWEEN c.start AND c."end")
), own AS (
  SELECT t.doc_id, t.node, coalesce((SELECT string_agg(o.text, chr(10) ORDER BY o.page) FROM own_pages o WHERE o.doc_id = t.doc_id AND o.node = t.node), '') AS own_text,
    NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent = t.node) AS leaf
  FROM tree t
), summarised AS (SELECT doc_id, node, own_text, CASE WHEN leaf AND length(own_text) <= 1200 THEN trim(own_text, ' ' || chr(10)) END AS summary FROM own)"""


@query("T22_own_text", f"WITH {OWN} SELECT doc_id, node, own_text, summary FROM summarised")
def t22(spark, sf_dir):
    return trees.own_text(tree(spark, sf_dir), pages(spark, sf_dir))


BATCHES = "WITH RECURSIVE " + SIZED + """, parts AS (
  SELECT doc_id, parent, node AS pos, least(chars, 1600) AS size, row_number() OVER (PARTITION BY doc_id, parent ORDER BY node) AS k FROM sized WHERE parent IS NOT NULL
), b AS (
  SELECT doc_id, parent, pos, k, 0 AS batch, 1 AS n, size AS chars FROM parts WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.parent, p.pos, p.k, CASE WHEN b.n >= 12 OR b.chars + p.size >= 4000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 12 OR b.chars + p.size >= 4000 THEN 1 ELSE b.n + 1 END,
    CASE WHEN b.n >= 12 OR b.chars + p.size >= 4000 THEN p.size ELSE b.chars + p.size END
  FROM b JOIN parts p ON p.doc_id = b.doc_id AND p.parent = b.parent AND p.k = b.k + 1
)
SELECT doc_id, parent, pos, batch FROM b"""


@query("T23_rollup_batches", BATCHES)
def t23(spark, sf_dir):
    nodes = sized(spark, sf_dir).where("parent is not null")
    parts = nodes.select("doc_id", "parent", F.col("node").alias("pos"), F.least(F.col("chars"), F.lit(1600)).alias("size"))
    return trees.rollup_batches(parts, 8000)


def told(requests: DataFrame) -> DataFrame:
    """Answers that follow from a request's numbers, some of them too long to stay alone."""
    long_ = F.when((F.col("round") == 1) & (F.col("node") % 5 == 2), 1700).otherwise(F.col("node") * 7 % 50 + 400)
    return requests.withColumn("summary", F.rpad(F.concat_ws("/", "node", "round", "batch"), long_, "."))


def summarised(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    labelled = pages(spark, sf_dir).select("doc_id", "page", F.lit(None).cast("string").alias("label"), "text")
    return refining.summarise_tree(tree(spark, sf_dir), labelled, told, 5600)


@query("T23_summaries")
def t23b(spark, sf_dir):
    return summarised(spark, sf_dir)[0]


@query("T23_summary_failures")
def t23c(spark, sf_dir):
    return summarised(spark, sf_dir)[1]


@query("T24_document_description", f"WITH {OWN} SELECT doc_id, substr(coalesce(arg_min(summary, node) FILTER (WHERE summary IS NOT NULL AND summary <> ''), ''), 1, 500) AS description FROM summarised GROUP BY doc_id")
def t24(spark, sf_dir):
    return trees.document_description(trees.own_text(tree(spark, sf_dir), pages(spark, sf_dir)))

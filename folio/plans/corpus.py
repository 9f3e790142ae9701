"""Queries of sources, scalar functions and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.functions import text as t
from folio.operators import evaluation, layout
from folio.plans.derived import LINES, PAGES, cte, derive, lines, pages, squeeze
from folio.plans.registry import query
from folio.sources import tables
from folio.sources.scratch import scratch


@query("S1_read_originals")
def s1(spark, sf_dir) -> DataFrame:
    return tables.read_originals(spark, sf_dir, "*.parquet").select("file", "byte_length", "sha256", "accepted")


@query(
    "S2_verify_checksums",
    """WITH files AS (SELECT concat('f', CAST(doc_id AS VARCHAR)) AS file, sha256(text) AS sha256 FROM documents WHERE doc_id % 5 <> 0),
    manifest AS (SELECT concat('f', CAST(doc_id AS VARCHAR)) AS file, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END) AS sha256 FROM documents WHERE doc_id % 6 <> 0
      UNION ALL SELECT concat('f', CAST(doc_id AS VARCHAR)), sha256(text) FROM documents WHERE doc_id % 9 = 1),
    m AS (SELECT file, count(*) AS n, min(sha256) AS h FROM manifest GROUP BY file)
    SELECT file, CASE WHEN n > 1 THEN 'duplicate' WHEN f.sha256 IS NULL THEN 'missing' WHEN n IS NULL THEN 'unlisted' WHEN f.sha256 <> h THEN 'changed' ELSE 'ok' END AS status
    FROM m FULL JOIN files f USING (file)""",
)
def s2(spark, sf_dir) -> DataFrame:
    docs = tables.read_table(spark, sf_dir, "documents", "doc_id", "text")
    file, digest = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.sha2("text", 256).alias("sha256")
    changed = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("sha256")
    manifest = docs.where("doc_id % 6 <> 0").select(file, changed).union(docs.where("doc_id % 9 = 1").select(file, digest))
    return tables.verify_checksums(docs.where("doc_id % 5 <> 0").select(file, digest), manifest)


@query("S3_write_pages", f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages FROM page_text GROUP BY doc_id")
def s3(spark, sf_dir) -> DataFrame:
    name, path = store(spark)
    own = pages(spark, sf_dir)
    tables.store_pages(own.where("doc_id % 2 = 0"), name, path, 1)
    tables.store_pages(own, name, path, 1)
    return spark.table(name).groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def store(spark) -> tuple[str, str]:
    """Name and folder of a new table of pages."""
    path = scratch(spark, "pages")
    return path.rsplit("/", 1)[-1].replace("-", "_"), path


@query("S4_load_pages", f"WITH {PAGES} SELECT doc_id, page, length(text) AS chars FROM page_text WHERE doc_id % 4 <> 0")
def s4(spark, sf_dir) -> DataFrame:
    name, path = store(spark)
    tables.store_pages(pages(spark, sf_dir), name, path)
    counts = lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("n"))
    versions = counts.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("page_count"))
    return tables.load_pages(spark.table(name), versions).select("doc_id", "page", F.length("text").alias("chars"))


REPORTS = f"WITH {cte('imports')} SELECT report, mode, file, sha256, status, elapsed_ms FROM imports"


@query("S5_read_reports", REPORTS)
def s5(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "reports")
    rows = derive(spark, sf_dir, "imports").select("report", F.struct("mode", "file", "sha256", "status", F.col("elapsed_ms").alias("elapsedMs")).alias("i"))
    # a report is one document a file: each writer's part of it is a shard
    rows.groupBy("report", F.spark_partition_id()).agg(F.collect_list("i").alias("imports")).select("report", "imports").write.option("maxRecordsPerFile", 1).partitionBy("report").json(path)
    return tables.read_reports(spark, [f"{path}/report=0", f"{path}/report=1"]).select("report", "mode", "file", "sha256", "status", F.col("elapsedMs").alias("elapsed_ms"))


@query(
    "S5_report_questions",
    f"""WITH {cte('runs')} SELECT run_id % 2 AS report, CASE WHEN turn % 2 = 0 THEN 'flash' ELSE 'standard' END AS mode, CAST(run_id AS VARCHAR) AS id, status, run_id % 977 * 1.0 AS elapsed_ms FROM runs""",
)
def s5b(spark, sf_dir) -> DataFrame:
    return _questions(spark, sf_dir, "questions").select("report", "mode", "id", "status", F.col("elapsedMs").alias("elapsed_ms"))


@query("S5_report_failures", f"WITH {cte('runs')} SELECT run_id % 2 AS report, concat(CAST(run_id AS VARCHAR), ' failed') AS failure FROM runs WHERE status = 'failed'")
def s5c(spark, sf_dir) -> DataFrame:
    return _questions(spark, sf_dir, "failures").select("report", F.col("x").alias("failure"))


def _questions(spark, sf_dir, part) -> DataFrame:
    """Reports with the runs as their questions, written and read back."""
    path, run = scratch(spark, "questions"), F.col("run_id")
    mode = F.when(F.col("turn") % 2 == 0, "flash").otherwise("standard").alias("mode")
    asked = F.struct(mode, run.cast("string").alias("id"), "status", (run % 977 * 1.0).alias("elapsedMs")).alias("q")
    rows = derive(spark, sf_dir, "runs").select((run % 2).alias("report"), asked, F.when(F.col("status") == "failed", F.concat(run.cast("string"), F.lit(" failed"))).alias("f"))
    each = rows.groupBy("report", F.spark_partition_id()).agg(F.collect_list("q").alias("questions"), F.collect_list("f").alias("failures"))
    each.select("report", "questions", "failures").write.option("maxRecordsPerFile", 1).partitionBy("report").json(path)
    return tables.read_reports(spark, [f"{path}/report=0", f"{path}/report=1"], part).withColumn("report", F.col("report").cast("long"))


@query("S6_write_report", f"WITH {cte('imports')} SELECT mode, count(*) AS n FROM imports GROUP BY mode")
def s6(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "metrics")
    tables.write_report(derive(spark, sf_dir, "imports").groupBy("mode").agg(F.count("*").alias("n")), path)
    return spark.read.schema("mode string, n long").json(path)


@query("S7_read_tables", "SELECT doc_id, lang, n_chars FROM documents")
def s7(spark, sf_dir) -> DataFrame:
    return tables.read_table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")


@query("S8_pages_from_text", f"WITH {LINES} SELECT doc_id, page, ord, text, height, y FROM lines")
def s8(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", "ord", "text", "height", "y")


@query("F1_normalized_title", f"WITH {LINES} SELECT doc_id, page, ord, {squeeze('text')} AS title FROM lines")
def f1(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", "ord", t.normalized_title(F.col("text")).alias("title"))


@query("F2_line_signature", rf"WITH {LINES} SELECT doc_id, page, ord, regexp_replace({squeeze('text')}, '\d+', '#', 'g') AS signature FROM lines")
def f2(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", "ord", t.line_signature(F.col("text")).alias("signature"))


@query(
    "F3_text_quality",
    rf"""WITH {PAGES}, s AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]'))) AS letters, sum(length(text)) AS chars FROM page_text GROUP BY doc_id)
    SELECT doc_id, letters, chars, CASE WHEN letters < 12 THEN 'text_layer_required' END AS failure FROM s""",
)
def f3(spark, sf_dir) -> DataFrame:
    return layout.text_quality(pages(spark, sf_dir))


@query("F4_is_dot_leader", rf"WITH {LINES} SELECT doc_id, page, ord FROM lines WHERE regexp_matches(concat(text, CASE WHEN ord = 2 THEN '....' || CAST(page AS VARCHAR) ELSE '' END), '(?i)\.{{3,}}\s*(\d+|[ivxlcdm]+)$')")
def f4(spark, sf_dir) -> DataFrame:
    said = F.concat("text", F.when(F.col("ord") == 2, F.concat(F.lit("...."), F.col("page").cast("string"))).otherwise(""))
    return lines(spark, sf_dir).where(t.is_dot_leader(said)).select("doc_id", "page", "ord")


NUMBERED = "concat(CAST(page AS {s}), '.', CAST(ord AS {s}), ' ', text)"


@query("F5_heading_number_depth", rf"WITH {LINES} SELECT doc_id, page, ord, len(string_split(regexp_extract({NUMBERED.format(s='VARCHAR')}, '^(\d+(\.\d+)*)([.)]|\s)\s*\S', 1), '.')) - 1 AS depth FROM lines")
def f5(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", "ord", t.heading_number_depth(F.expr(NUMBERED.format(s="STRING"))).alias("depth"))


@query("F6_normalized_chars", rf"WITH {LINES} SELECT doc_id, page, ord, array_to_string(list_sort(string_split(regexp_replace(text, '\s', '', 'g'), '')), '') AS chars FROM lines")
def f6(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", "ord", t.normalized_chars(F.col("text")).alias("chars"))


@query("F7_canonical_digest", """SELECT doc_id, sha256(concat('{"lang":"', lang, '","n":{"chars":', CAST(n_chars AS VARCHAR), ',"id":', CAST(doc_id AS VARCHAR), '},"source":"', source, '"}')) AS digest FROM documents""")
def f7(spark, sf_dir) -> DataFrame:
    docs = tables.read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    nested = docs.select("doc_id", F.struct("source", F.struct(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars")).alias("n"), "lang").alias("v"))
    return nested.select("doc_id", t.canonical_digest(F.col("v"), nested.schema["v"].dataType).alias("digest"))


CITED = "concat(text, ' [p](cite:r', CAST(conv_id AS {s}), ') and [q](cite:', CAST(turn AS {s}), ') [none](cite: )')"


@query("F8_extract_citations", f"SELECT conv_id, turn, unnest(c) AS id, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all({CITED.format(s='VARCHAR')}, '\\]\\(cite:([^\\s)]+)\\)', 1) AS c FROM conversations)")
def f8(spark, sf_dir) -> DataFrame:
    turns = tables.read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", F.posexplode(t.citation_ids(F.expr(CITED.format(s="STRING")))).alias("pos", "id"))


@query("F9_page_uri", f"WITH {PAGES} SELECT concat('folio://source/v', CAST(doc_id AS VARCHAR), '/page/', CAST(page AS VARCHAR)) AS uri, concat('v', CAST(doc_id AS VARCHAR)) AS version, page FROM page_text")
def f9(spark, sf_dir) -> DataFrame:
    uri = t.page_uri(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.col("page"))
    addressed = pages(spark, sf_dir).select(uri.alias("uri"))
    version, page = t.parsed_page_uri(F.col("uri"))
    return addressed.select("uri", version.alias("version"), page.alias("page"))


@query("F10_library_filter", f"WITH {cte('library')} SELECT document_id, name FROM library WHERE retired_at IS NULL AND (name ILIKE '%DOC 1%' OR description ILIKE '%SRC3%')")
def f10(spark, sf_dir) -> DataFrame:
    from folio.operators.library import library_filter

    docs = derive(spark, sf_dir, "library")
    both = library_filter(docs, "DOC 1").union(library_filter(docs, "SRC3")).distinct()
    return both.select("document_id", "name")


@query("F11_usage_from_record", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN k WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN k + 1 WHEN event_id % 5 <> 0 THEN k + 2 END AS calls FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)")
def f11(spark, sf_dir) -> DataFrame:
    e = tables.read_table(spark, sf_dir, "events", "event_id", "props").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    use = lambda c, ok: F.struct(F.when(ok, F.struct(c.alias("modelCalls"))).alias("usage"))
    n = F.col("event_id")
    attempts = F.when(n % 5 != 0, F.array(use(F.col("k") + 2, F.lit(True)))).otherwise(F.array().cast("array<struct<usage:struct<modelCalls:bigint>>>"))
    record = F.struct(
        use(F.col("k"), n % 3 == 0).alias("run"), use(F.col("k") + 1, (n % 3 == 1) & (n % 2 == 0)).alias("result"), F.struct(attempts.alias("attempts")).alias("operation")
    )
    return e.withColumn("record", record).select("event_id", evaluation.usage_from_record(F.col("record"))["modelCalls"].alias("calls"))


@query(
    "F12_validate_rows",
    """SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') THEN 'role:enum' END, CASE WHEN length(text) < 1 OR length(text) > 1000 THEN 'text:length' END,
      CASE WHEN turn < 0 OR turn > 5 THEN 'turn:range' END) AS reasons FROM conversations""",
)
def f12(spark, sf_dir) -> DataFrame:
    from folio.functions.rules import validate_rows

    rules = {"role": {"enum": ["user", "assistant"]}, "text": {"length": (1, 1000)}, "turn": {"range": (0, 5)}}
    checked = validate_rows(tables.read_table(spark, sf_dir, "conversations"), rules)
    return checked.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query("F13_document_name", f"WITH {cte('library')} SELECT document_id, regexp_replace(name, '(?i)\\.pdf$', '') AS name FROM library")
def f13(spark, sf_dir) -> DataFrame:
    return derive(spark, sf_dir, "library").select("document_id", t.document_name(F.col("name")).alias("name"))


ITEMS = r"""words AS (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS l FROM documents)
), items AS (
  SELECT doc_id, CAST(i // 80 + 1 AS INT) AS page, CAST(i AS INT) AS seq, CAST(i // 8 % 10 AS INT) AS r, i % 8 AS place, w,
    CASE WHEN i // 8 % 10 = 0 THEN 50.0 + (i % 8) * 62.0 WHEN i % 8 < 4 THEN 50.0 + (i % 4) * 60.0 ELSE 330.0 + (i % 4) * 60.0 END AS x,
    least(length(w) * 5.0, 52.0) AS width, CASE WHEN i // 8 % 10 = 0 THEN 16.0 ELSE 11.0 END AS height, 30.0 + (i // 8 % 10) * 70.0 + (i % 3) * 0.5 AS y
  FROM words
)"""
CHUNKS = ITEMS + r""", gaps AS (
  SELECT *, x - lag(x) OVER w - lag(width) OVER w AS gap, lag(i.w) OVER w AS before FROM items i WINDOW w AS (PARTITION BY doc_id, page, r ORDER BY x)
), chunked AS (
  SELECT *, CAST(sum(CASE WHEN gap >= greatest(height * 2.3, 612 * 0.06) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, r ORDER BY x) AS INT) AS chunk FROM gaps
), spaced AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, page, r, chunk ORDER BY x) > 1 AND regexp_matches(before, '[A-Za-z0-9)]$') AND regexp_matches(w, '^[A-Za-z0-9(]') AND gap > height * 0.12
    THEN ' ' ELSE '' END || w AS part FROM chunked
), boxes AS (
  SELECT doc_id, page, r AS row, chunk, string_agg(part, '' ORDER BY x) AS text, min(x) AS x, min(y) AS y, max(height) AS height, arg_max(x + width, x) - min(x) AS width
  FROM spaced GROUP BY doc_id, page, r, chunk
)"""


def item_rows(spark, sf_dir) -> DataFrame:
    docs = tables.by_document(tables.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return layout.cluster_rows(tables.items_from_text(docs), together=True)


def boxes(spark, sf_dir) -> DataFrame:
    return layout.join_text(layout.split_chunks(item_rows(spark, sf_dir), together=True), in_order=True)


@query("L1_cluster_rows", f"WITH {ITEMS} SELECT doc_id, page, seq, r AS row FROM items")
def l1(spark, sf_dir) -> DataFrame:
    return item_rows(spark, sf_dir).select("doc_id", "page", "seq", "row")


@query("L2_split_chunks", f"WITH {CHUNKS} SELECT doc_id, page, seq, chunk FROM chunked")
def l2(spark, sf_dir) -> DataFrame:
    return layout.split_chunks(item_rows(spark, sf_dir), together=True).select("doc_id", "page", "seq", "chunk")


@query("L3_join_text", f"WITH {CHUNKS} SELECT doc_id, page, row, chunk, text FROM boxes")
def l3(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).select("doc_id", "page", "row", "chunk", "text")


@query("L4_chunk_boxes", f"WITH {CHUNKS} SELECT doc_id, page, row, chunk, x, y, width, height FROM boxes")
def l4(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).select("doc_id", "page", "row", "chunk", "x", "y", "width", "height")


COLUMNS = CHUNKS + """, sides AS (
  SELECT doc_id, page, count(*) FILTER (WHERE l) AS n_left, count(*) FILTER (WHERE r) AS n_right, max(x + width) FILTER (WHERE l) AS left_end, min(x) FILTER (WHERE r) AS right_start,
    list_sort(list(x + width) FILTER (WHERE l)) AS ends
  FROM (SELECT *, x + width <= 612 * 0.53 AND x < 612 * 0.35 AS l, x >= 612 * 0.45 AND width < 612 * 0.5 AS r FROM boxes) GROUP BY doc_id, page
), layout AS (
  SELECT doc_id, page, n_left, n_right, (coalesce(left_end, 0) + least(coalesce(right_start, 612.0), 612.0)) / 2 AS gutter,
    CASE WHEN n_left >= 3 AND n_right >= 3 AND right_start - ends[CAST(floor(len(ends) / 2) AS INT) + 1] > 612 * 0.035 THEN 2 ELSE 1 END AS columns FROM sides
)"""


@query("L5_detect_columns", f"WITH {COLUMNS} SELECT doc_id, page, gutter, columns, n_left, n_right FROM layout")
def l5(spark, sf_dir) -> DataFrame:
    return layout.detect_columns(boxes(spark, sf_dir), in_order=True)


ORDERED = COLUMNS + """, placed AS (
  SELECT b.*, l.columns, l.gutter, l.columns = 2 AND ((x < gutter AND x + width > gutter) OR y < 792 * 0.065 OR y > 792 * 0.92) AS across FROM boxes b JOIN layout l USING (doc_id, page)
), cuts AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, row, chunk) - 1 AS cut, row, chunk FROM placed WHERE across),
banded AS (
  SELECT p.*, CASE WHEN columns = 1 THEN 0 WHEN across THEN (SELECT c.cut FROM cuts c WHERE c.doc_id = p.doc_id AND c.page = p.page AND c.row = p.row AND c.chunk = p.chunk)
    ELSE (SELECT count(*) FROM cuts c WHERE c.doc_id = p.doc_id AND c.page = p.page AND c.y <= p.y) END AS band,
    CASE WHEN columns = 1 THEN 0 WHEN across THEN 2 WHEN x < gutter THEN 0 ELSE 1 END AS side FROM placed p
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, side, y, CASE WHEN columns = 1 THEN x END, row, chunk) - 1 AS ord FROM banded
)"""


def ordered(spark, sf_dir) -> DataFrame:
    return layout.reading_order(boxes(spark, sf_dir), in_order=True)


@query("L6_reading_order", f"WITH {ORDERED} SELECT doc_id, page, row, chunk, ord FROM ordered")
def l6(spark, sf_dir) -> DataFrame:
    return ordered(spark, sf_dir).select("doc_id", "page", "row", "chunk", "ord")


@query("L7_page_text", f"WITH {ORDERED} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS text FROM ordered GROUP BY doc_id, page")
def l7(spark, sf_dir) -> DataFrame:
    return layout.page_text(ordered(spark, sf_dir), together=True)


MARGINS = PAGES + rf""", signed AS (
  SELECT l.*, y < 792 * 0.065 OR y > 792 * 0.92 AS zone, regexp_replace({squeeze('text')}, '\d+', '#', 'g') AS sig FROM lines l
), seen AS (SELECT doc_id, sig, count(DISTINCT page) AS n FROM signed WHERE zone GROUP BY doc_id, sig),
body AS (SELECT doc_id, page, coalesce(list_sort(list(height) FILTER (WHERE length(text) > 20))[CAST(floor(count(*) FILTER (WHERE length(text) > 20) / 2) AS INT) + 1], 0) AS body FROM lines GROUP BY doc_id, page),
marked AS (
  SELECT s.doc_id, s.page, s.ord, s.text, s.zone AND s.height <= b.body * 1.1 AND coalesce(e.n, 0) >= greatest(2, ceil(c.n_pages * 0.6)) AS margin
  FROM signed s JOIN body b USING (doc_id, page) JOIN page_counts c USING (doc_id) LEFT JOIN seen e ON e.doc_id = s.doc_id AND e.sig = s.sig
)"""


@query("L8_mark_margins", f"WITH {MARGINS} SELECT doc_id, page, ord, margin FROM marked")
def l8(spark, sf_dir) -> DataFrame:
    return layout.mark_margins(lines(spark, sf_dir)).select("doc_id", "page", "ord", "margin")


@query("L9_navigation_text", f"WITH {MARGINS} SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE NOT margin), '') AS navigation_text FROM marked GROUP BY doc_id, page")
def l9(spark, sf_dir) -> DataFrame:
    return tables.page_texts(layout.mark_margins(lines(spark, sf_dir))).select("doc_id", "page", "navigation_text")


OUTLINES = PAGES + f""", marks AS (
  SELECT doc_id, page * 2 AS seq, text AS title, page + CASE WHEN page % 4 = 0 THEN 1 ELSE 0 END AS page, 0 AS depth FROM lines WHERE ord = 1
  UNION ALL SELECT doc_id, page * 2 - 1, concat('* ', text), page + CASE WHEN page % 4 = 0 THEN 1 ELSE 0 END, 2 FROM lines WHERE ord = 1 AND page % 3 = 0
), outlines AS (
  SELECT m.*, coalesce({squeeze('m.title')} <> '' AND contains({squeeze('p.text')}, {squeeze('m.title')}), false) AS verified FROM marks m LEFT JOIN page_text p ON p.doc_id = m.doc_id AND p.page = m.page
)"""


def outlines(spark, sf_dir) -> DataFrame:
    own = lines(spark, sf_dir).where("ord = 1").withColumn("at", F.col("page") + (F.col("page") % 4 == 0).cast("int"))
    marks = own.select("doc_id", (F.col("page") * 2).alias("seq"), F.col("text").alias("title"), F.col("at").alias("page"), F.lit(0).alias("depth"))
    # every third bookmark stands twice, first with a mark before it and deeper
    again = own.where("page % 3 = 0").select("doc_id", (F.col("page") * 2 - 1).alias("seq"), F.concat(F.lit("* "), "text").alias("title"), F.col("at").alias("page"), F.lit(2).alias("depth"))
    marks = marks.union(again)
    return layout.verify_outlines(marks, pages(spark, sf_dir))


@query("L10_verify_outlines", f"WITH {OUTLINES} SELECT doc_id, title, page, depth, verified FROM outlines")
def l10(spark, sf_dir) -> DataFrame:
    return outlines(spark, sf_dir).select("doc_id", "title", "page", "depth", "verified")


@query(
    "L11_diagnostics",
    f"""WITH {COLUMNS}, {OUTLINES}, a AS (SELECT doc_id, max(columns) > 1 AS two FROM layout GROUP BY doc_id), b AS (SELECT doc_id, bool_or(NOT verified) AS loose FROM outlines GROUP BY doc_id)
    SELECT doc_id, concat_ws(',', CASE WHEN two THEN 'multi_column_reading_order' END, CASE WHEN loose THEN 'unverified_bookmark_candidates' END) AS flags FROM a FULL JOIN b USING (doc_id)""",
)
def l11(spark, sf_dir) -> DataFrame:
    found = layout.diagnostics(layout.detect_columns(boxes(spark, sf_dir), in_order=True), outlines(spark, sf_dir))
    return found.select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("L12_page_count_gate", f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages FROM page_text GROUP BY doc_id HAVING count(*) > 3")
def l12(spark, sf_dir) -> DataFrame:
    return layout.page_count_gate(pages(spark, sf_dir), 3)

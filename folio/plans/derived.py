"""Tables of the library's data model, derived from the given ones by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.functions.text import DOT_LEADER, NAMED_HEADING
from folio.sources import tables

BASE = ("documents", "events", "conversations", "labels", "pages", "benchmark", "orders", "customer", "lineitem")


def _each(template: str, **values) -> str:
    names, lists = list(values), list(values.values())
    rows = [{}]
    for name, options in zip(names, lists, strict=True):
        rows = [r | {name: o} for r in rows for o in options]
    return "\nUNION ALL\n".join(template.format_map({b: f"{{{b}}}" for b in BASE} | r) for r in rows)


TEMPLATES = {
    "library": """
        SELECT doc_id AS document_id, concat('Doc ', CAST(doc_id AS STRING), '.PDF') AS name, concat(source, ' ', lang) AS description,
          CAST(doc_id % 4 AS INT) AS library_revision, CASE WHEN doc_id % 11 = 0 THEN 1 END AS retired_at,
          CASE WHEN doc_id % 5 <> 0 THEN concat('v', CAST(doc_id * 10 + 1 AS STRING)) END AS effective_version,
          CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN concat('i', CAST(doc_id * 10 + 1 AS STRING)) END AS effective_index,
          concat('v', CAST(doc_id * 10 + 2 AS STRING)) AS latest_version, concat('o', CAST(doc_id * 10 + 2 AS STRING)) AS latest_operation,
          CAST(floor(n_chars / 500) AS INT) + 1 AS page_count
        FROM {documents}""",
    "operations": _each(
        """
        SELECT concat('o', CAST(doc_id * 10 + {k} AS STRING)) AS operation_id, doc_id AS document_id, concat('v', CAST(doc_id * 10 + {k} AS STRING)) AS version_id,
          CASE (doc_id + {k}) % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'ready' WHEN 3 THEN 'failed' WHEN 4 THEN 'interrupted' ELSE 'unsupported' END AS status,
          CASE WHEN doc_id % 2 = 0 THEN 'construction' ELSE 'extraction' END AS stage, CASE WHEN (doc_id + {k}) % 6 = 3 THEN 'model_failed' END AS reason,
          concat('a', CAST(doc_id * 100 + {k} * 10 + 1 + doc_id % 3 AS STRING)) AS latest_attempt, CAST((doc_id * 3 + {k}) % 4 AS INT) AS expected_revision
        FROM {documents}""",
        k=(1, 2),
    ),
    "attempts": _each(
        """
        SELECT concat('a', CAST(doc_id * 100 + {k} * 10 + {n} AS STRING)) AS attempt_id, concat('o', CAST(doc_id * 10 + {k} AS STRING)) AS operation_id,
          concat('v', CAST(doc_id * 10 + {k} AS STRING)) AS version_id, CASE WHEN (doc_id + {n}) % 2 = 0 THEN 'flash' ELSE 'standard' END AS mode,
          CASE WHEN {n} = 1 + doc_id % 3 THEN 'processing' ELSE 'failed' END AS status, doc_id * 100 + {k} * 10 + {n} AS created_at, doc_id
        FROM {documents} WHERE {n} <= 1 + doc_id % 3""",
        k=(1, 2), n=(1, 2, 3),
    ),
    "versions": _each(
        """
        SELECT concat('v', CAST(doc_id * 10 + {k} AS STRING)) AS version_id, doc_id AS document_id, CAST(floor(n_chars / 500) AS INT) + {k} AS page_count,
          n_chars AS byte_length, {k} AS created_at
        FROM {documents}""",
        k=(1, 2),
    ),
    "indexes": _each(
        """
        SELECT concat('i', CAST(doc_id * 10 + {k} AS STRING)) AS index_id, concat('v', CAST(doc_id * 10 + {v} AS STRING)) AS version_id,
          CASE WHEN doc_id % 2 = 0 THEN 'flash' ELSE 'standard' END AS mode, {k} AS created_at
        FROM {documents} WHERE doc_id % 5 <> 0 AND ({k} < 3 OR doc_id % 3 = 0)""",
        k=(1, 2, 3), v=(1,),
    ),
    # a run for each turn of a user; the two documents it selects follow from its numbers
    "runs": """
        SELECT conv_id * 1000 + turn AS run_id, conv_id AS conversation_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'library' ELSE 'selected' END AS mode,
          (conv_id * 7919 + turn * 31) % n_docs AS d1, (conv_id * 6101 + turn * 17) % n_docs AS d2, n_docs, text AS question,
          CASE (conv_id + turn) % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'stopping' WHEN 3 THEN 'failed' WHEN 4 THEN 'stopped' ELSE 'completed' END AS status
        FROM {conversations}, (SELECT max(doc_id) + 1 AS n_docs FROM {documents}) WHERE role = 'user'""",
    "calls": """
        SELECT event_id AS seq, user_id AS run_id, event_type AS lane, value AS elapsed_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
          concat('L', CAST(user_id % 4 AS STRING)) AS ledger, event_type = 'error' AS error, event_id % 50 = 0 AS cancelled, ts,
          CASE WHEN event_id % 9 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS input_tokens,
          CASE WHEN event_id % 9 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 2 END AS output_tokens,
          CASE WHEN event_id % 5 <> 0 THEN value / 2 END AS first_ms, CASE WHEN event_type = 'error' THEN concat('status ', CAST(500 + event_id % 4 AS STRING)) END AS message
        FROM {events}""",
    # imports of two reports: labels of a document, by two modes
    "imports": _each(
        """
        SELECT {report} AS report, '{mode}' AS mode, concat('doc', CAST(doc_id AS STRING)) AS file, CASE WHEN doc_id % 17 = {report} THEN 'x' ELSE 'h' END AS sha256, doc_id,
          CASE WHEN {quality} = 1 THEN 'ready' ELSE 'failed' END AS status, doc_id % 13 = 0 AS retried, (doc_id * 37) % 1000 * 1.0 AS elapsed_ms
        FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id % 3 >= {report}""".replace("{quality}", "{{flag}}").replace("{{flag}}", "(CASE WHEN '{mode}' = 'flash' THEN quality ELSE 1 - toxic END)"),
        report=(0, 1), mode=("flash", "standard"),
    ),
    # the library's history: accepted, tried again, activated, retired, with some that come too late
    "library_events": """
        SELECT CAST(user_id AS STRING) AS document_id, event_id AS seq,
          CASE event_id % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'attempt' WHEN 2 THEN 'activate' WHEN 3 THEN 'accept' ELSE CASE WHEN event_id % 40 = 4 THEN 'retire' ELSE 'activate' END END AS kind,
          concat('o', CAST(event_id % 2 AS STRING)) AS operation, CAST(event_id % 3 AS INT) AS expected, concat('a', CAST(event_id % 2 AS STRING)) AS attempt
        FROM {events}""",
    "progress": """
        SELECT CAST(user_id AS STRING) AS operation, event_id AS seq, concat('a', CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 2 ELSE event_id % 4 END AS STRING)) AS attempt,
          CASE WHEN event_type = 'view' THEN CAST(NULL AS STRING) WHEN event_type = 'error' THEN 'failed' ELSE 'processing' END AS status, event_type AS stage,
          CASE WHEN event_type = 'error' THEN 'model_failed' END AS reason
        FROM {events}""",
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(TEMPLATES[name].format_map({b: f"parquet.`{sf_dir}/{b}.parquet`" for b in BASE}))


def cte(*names: str) -> str:
    """The tables as common table expressions for DuckDB."""
    return ",\n".join(f"{n} AS ({TEMPLATES[n].format_map({b: b for b in BASE})})" for n in names)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines_from_text(tables.read_table(spark, sf_dir, "documents", "doc_id", "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_texts(lines(spark, sf_dir))


#: Fixed value: the squeeze of titles, in DuckDB.
def squeeze(column: str) -> str:
    return rf"regexp_replace(lower({column}), '[\s\p{{P}}\p{{S}}]+', '', 'g')"


LINES = r"""lines AS (
  SELECT doc_id, CAST((n - 1) // 5 + 1 AS INT) AS page, CAST((n - 1) % 5 AS INT) AS ord, line AS text, 36.0 + 176.0 * ((n - 1) % 5) AS y,
    CASE WHEN length(line) < 20 THEN 20.0 WHEN length(line) < 40 THEN 14.0 ELSE 11.0 END AS height
  FROM (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)
  )
)"""


def one_a_page(sql: str) -> str:
    """The same SQL over documents with one line a page, which makes long documents."""
    return sql.replace("(n - 1) // 5 + 1", "n").replace("(n - 1) % 5", "0")


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines_from_text(tables.read_table(spark, sf_dir, "documents", "doc_id", "text"), per_page=1)


PAGES = LINES + """, page_text AS (
  SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS text FROM lines GROUP BY doc_id, page
), page_counts AS (SELECT doc_id, max(page) AS n_pages FROM lines GROUP BY doc_id)"""
CANDIDATES = PAGES + r""", body AS (
  SELECT doc_id, coalesce(list_sort(list(height) FILTER (WHERE length(text) > 20))[CAST(floor(count(*) FILTER (WHERE length(text) > 20) / 2) AS INT) + 1], 11.0) AS body
  FROM lines GROUP BY doc_id
), candidates AS (
  SELECT l.* FROM lines l JOIN body b USING (doc_id)
  WHERE length(text) BETWEEN 3 AND 180 AND NOT regexp_matches(text, '@LEADER@')
    AND (height >= body * 1.23 OR (height >= body * 1.04 AND regexp_matches(text, '@NAMED@')))
)""".replace("@LEADER@", DOT_LEADER).replace("@NAMED@", NAMED_HEADING)
LEVELS = CANDIDATES + r""", sizes AS (
  SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) - 1 AS level FROM (SELECT DISTINCT doc_id, floor(height * 2 + 0.5) / 2 AS size FROM candidates)
), levels AS (
  SELECT c.*, coalesce((SELECT min(s.level) FROM sizes s WHERE s.doc_id = c.doc_id AND abs(s.size - c.height) < 0.6), -1) AS level FROM candidates c
), headings AS (
  SELECT doc_id, page, ord, text AS title, CAST(greatest(level, coalesce(len(string_split(nullif(regexp_extract(text, '^(\d+(\.\d+)*)([.)]|\s)\s*\S', 1), ''), '.')) - 1, level)) AS INT) AS depth,
    'layout' AS origin
  FROM levels
)"""
TREE = LEVELS + f""", uniq AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, {squeeze('title')} ORDER BY ord, depth, title) AS nth FROM headings WHERE trim(title, ' ') <> '') WHERE nth = 1
), fronted AS (
  SELECT doc_id, page, ord, title, depth, origin FROM uniq
  UNION ALL SELECT doc_id, 1, -1, 'Front matter', 0, 'coverage' FROM uniq GROUP BY doc_id HAVING min(page) > 1
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, ord, depth, title) - 1 AS INT) AS node FROM fronted
), deep AS (
  SELECT * REPLACE (CAST(node + min((CASE WHEN node = 0 THEN 0 ELSE least(greatest(depth, 0), 8) END) - node) OVER (PARTITION BY doc_id ORDER BY node) AS INT) AS depth) FROM numbered
), tree AS (
  SELECT d.doc_id, d.node, trim(d.title, ' ') AS title, d.page AS start, d.depth, d.origin,
    (SELECT max(p.node) FROM deep p WHERE p.doc_id = d.doc_id AND p.node < d.node AND p.depth = d.depth - 1) AS parent,
    CAST(coalesce((SELECT greatest(d.page, min_by(n.page, n.node)) FROM deep n WHERE n.doc_id = d.doc_id AND n.node > d.node AND n.depth <= d.depth HAVING count(*) > 0), c.n_pages) AS INT) AS "end"
  FROM deep d JOIN page_counts c USING (doc_id)
)"""

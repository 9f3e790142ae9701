"""Operator 5: corpus-wide line deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.common import ASCII_SPACE, free_name, lower_ascii, row_key, same_key, stored


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_length: int = 1, text: str = "text") -> DataFrame:
    """All columns of docs, ``text`` without the lines whose key is in ``min_docs`` documents or more, plus l_lines and l_dropped (before and dropped).

    Lines become 128-bit hashes of their keys with a row's key and their position; texts of lines never move. Distinct hashes
    of a row are counted by a partial sum before the shuffle, so a line in a third of all rows costs a row a task. The hashes over
    the threshold are stored, then joined with plain exchanges on both sides, so a hot hash is split at run time. Positions to drop go back to the rows by
    the row's key.

    Rows of one id are one document (of one text, where the id is null). Null or empty text: one empty line, kept (as ``text`` was). Keys shorter than ``min_length`` code points stay. Repeated
    rows stay. Empty table: empty result. All other columns, whatever
    their names, pass through.
    """
    row = docs.select(F.struct("*").alias("l_row"), *row_key("doc_id", text), F.coalesce(F.col(text), F.lit("")).alias("l_text"))
    lines = F.split("l_text", "\n")
    line = row.select("k_id", "k_a", "k_b", F.posexplode(lines).alias("at", "line")).withColumn("key", line_key(F.col("line")))
    hashed = line.where(F.length("key") >= max(1, min_length)).select(
        "k_id", "k_a", "k_b", "at", F.xxhash64("key").alias("h_a"), F.xxhash64(F.lit("second"), "key").alias("h_b")
    )
    hashed = stored(hashed, "lines")
    nameless = F.when(F.col("k_id").isNull(), F.col("k_a")).alias("k_text")
    own = hashed.select("k_id", nameless, "h_a", "h_b").distinct()
    often = stored(own.groupBy("h_a", "h_b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h_a", "h_b"), "often")
    drops = (
        hashed.join(often, ["h_a", "h_b"], "left_semi")
        .groupBy("k_id", "k_a", "k_b").agg(F.collect_set("at").alias("drops"))
    )
    joined = row.alias("r").join(drops.alias("d"), same_key("r", "d"), "left").select("l_row", "l_text", "drops")
    kept = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), "drops")
    text_left = F.when(F.col("drops").isNull(), F.col(f"l_row.{text}")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("all_lines", i)), "\n")
    )
    out = joined.withColumn("all_lines", F.split("l_text", "\n"))
    passed = [F.col("l_row").getField(c).alias(c) if c != text else text_left.alias(text) for c in docs.columns]
    n_lines, n_dropped = F.size("all_lines").cast("long"), F.coalesce(F.size("drops"), F.lit(0)).cast("long")
    return out.select(*passed, n_lines.alias(free_name("l_lines", docs.columns)), n_dropped.alias(free_name("l_dropped", docs.columns)))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text left) of every document."""
    done = dedup_lines(docs.select("doc_id", "text"), **options)
    left = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", F.col("l_lines").alias("n_lines"), F.col("l_dropped").alias("n_dropped"), left.alias("kept_sha256"))


LINE_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, o.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

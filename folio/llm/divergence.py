"""Operator 13: audit of how far the sources of a language diverge in their words.

Terms are counted by length-bucketed packing: a term of up to 8 bytes becomes one 64-bit word, one of up to 16 bytes two, and each of
these buckets is radix-sorted and run-counted in numpy; longer terms fall into a bucket for each length, sorted as bytes. Spark adds up the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.bpe import frugal, slices
from folio.llm.common import bounded, stored

#: Bytes of text whose terms are counted at a time.
SLICE = 16 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of terms once A-Z are lower-cased: letters, and every byte of a character outside ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[ord("a") : ord("z") + 1] = True
IN_TERM[0x80:] = True


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, and each term's start, length and text."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data, offsets = LOWER[data], offsets - offsets[0]
    inside, first = IN_TERM[data], np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    cut = first[1:-1] if len(data) else np.empty(0, bool)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut
    ends[:-1] &= ~inside[1:] | cut
    start = np.flatnonzero(begins)
    return data, start, np.flatnonzero(ends) + 1 - start, np.searchsorted(offsets, start, side="right") - 1


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as one word that sorts as the bytes do; bytes past the length are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_each = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    spare = (np.uint64(8) - np.minimum(length, 8).astype(np.uint64)) * np.uint64(8)
    return at_each[start].astype(np.uint64) >> spare << spare


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words, the first counting most: 16 bits at a time from the last, each pass a stable radix sort."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(key: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key, group and document: the first row of each (key, group), its rows and its documents."""
    differs = lambda x: np.r_[True, x[1:] != x[:-1]]
    new = np.logical_or.reduce([differs(x) for x in [*key, group]])
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, len(new)]), np.add.reduceat((new | differs(doc)).astype(np.int64), at)


def counted_terms(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """A row a term and group: an example's start and length, the group, occurrences and documents. ``group``: of each document."""
    found = []
    of = group[doc].astype(np.uint64)
    buckets = [np.flatnonzero(length <= 8), np.flatnonzero((length > 8) & (length <= 16))]
    for n_words, rows in enumerate(buckets, 1):
        if len(rows):
            key = [packed(data, start[rows] + 8 * i, length[rows] - 8 * i) for i in range(n_words)]
            rank = radix_order([*key, of[rows]])
            found.append((rows[rank], *runs([k[rank] for k in key], of[rows][rank], doc[rows][rank])))
    long = np.flatnonzero(length > 16)
    long = long[np.argsort(length[long], kind="stable")]
    for rows in np.split(long, np.flatnonzero(np.diff(length[long])) + 1) if len(long) else []:
        n = int(length[rows[0]])
        key = np.lib.stride_tricks.as_strided(data, (len(data) - n + 1, n), (1, 1))[start[rows]].view(f"S{n}").ravel()
        rank = np.argsort(of[rows], kind="stable")
        rank = rank[np.argsort(key[rank], kind="stable")]
        found.append((rows[rank], *runs([key[rank]], of[rows][rank], doc[rows][rank])))
    if not found:
        return [np.empty(0, np.int64)] * 5
    first = [rows[at] for rows, at, _, _ in found]
    columns = [np.concatenate([x[i] for x in zip(first, *zip(*[f[2:] for f in found], strict=True), strict=True)]) for i in range(3)]
    return [start[columns[0]], length[columns[0]], group[doc[columns[0]]], columns[1], columns[2]]


COUNTED = "lang string, source string, term string, count long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term in parts of a source of a language: rows to add up by lang, source and term."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                names = [part.column(i).dictionary_encode() for i in (0, 1)]
                lang, source = (np.asarray(n.indices) for n in names)
                data, start, length, doc = spans(texts)
                if not len(start):
                    continue
                start, length, group, count, in_docs = counted_terms(data, start, length, doc, lang.astype(np.int64) * len(names[1].dictionary) + source)
                ends = np.cumsum(length)
                letters = data[np.repeat(start - np.r_[0, ends[:-1]], length) + np.arange(ends[-1])]
                term = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())
                of = [n.dictionary.take(pa.array(k)) for n, k in zip(names, np.divmod(group, len(names[1].dictionary)), strict=True)]
                yield pa.RecordBatch.from_arrays([*of, term, pa.array(count), pa.array(in_docs)], names=["lang", "source", "term", "count", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(frugal(run), COUNTED)


def share(count: Column, total: Column, terms: Column) -> Column:
    """p: a billionth share of ``count`` among ``total`` occurrences and one more of each term, and 1. Products are decimals, so counts can't overflow."""
    return (F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(cells: DataFrame, absent: DataFrame) -> DataFrame:
    """Summed divergence of every two sources of a language in every block of its terms.

    cells: lang, block, gid, term_id, p of terms that a source has; absent: lang, block, gid, p of those that it doesn't have, for each source and block.
    A task holds a block's rows. For each source, the terms that another one doesn't have are summed by distinct share, the others one by one.
    """

    def f(p, q):
        return (p - q) * (p - q) // q

    def closed(rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        gid, term, p = (np.asarray(table[c].combine_chunks().fill_null(-1)) for c in ("gid", "term_id", "p"))
        none = term < 0
        ids, at = np.unique(gid[none], return_index=True)
        zero = p[none][at]
        order = np.argsort(gid[~none], kind="stable")
        of, p = np.searchsorted(ids, gid[~none][order]), p[~none][order]
        known, term = np.unique(term[~none][order], return_inverse=True)
        cuts = np.searchsorted(of, np.arange(len(ids) + 1))
        for i in range(len(ids)):
            own = np.full(len(known), zero[i])
            own[term[cuts[i] : cuts[i + 1]]] = p[cuts[i] : cuts[i + 1]]
            values, times = np.unique(own, return_counts=True)
            total = np.zeros(len(ids), np.int64)
            for v in range(0, len(values), 4096):
                total += np.concatenate([(f(values[v : v + 4096], zero[j : j + 256, None]) * times[v : v + 4096]).sum(axis=1) for j in range(0, len(ids), 256)])
            more = np.r_[0, np.cumsum(f(own[term], p) - f(own[term], zero[of]))]
            total += more[cuts[1:]] - more[cuts[:-1]]
            other = np.arange(len(ids)) != i
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids) - 1, ids[i])), pa.array(ids[other]), pa.array(total[other])], names=["a", "b", "value"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, block = batch.column(0), np.asarray(batch.column(1))
            new = (block[1:] != block[:-1]) | np.asarray(pc.not_equal(lang[1:], lang[:-1]))
            cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                key = (lang[low].as_py(), block[low])
                if key != now:
                    if held:
                        yield from closed(held)
                    now, held = key, []
                held.append(batch.slice(low, high - low))
        if held:
            yield from closed(held)

    rows = cells.unionByName(absent.withColumn("term_id", F.lit(None).cast("long"))).repartition("lang", "block").sortWithinPartitions("lang", "block")
    return rows.select("lang", "block", "gid", "term_id", "p").mapInArrow(frugal(run), "a long, b long, value long")


def source_divergence(docs: DataFrame, *, least_docs: int = 3, top: int = 200, block_rows: int = 1 << 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source's use of words is from that of the other sources (``pair``) and of its language (``term``).

    Terms are runs of ASCII letters and characters outside ASCII; only A-Z are lower-cased. A language keeps the V terms that ``least_docs`` or more
    of its documents hold. A source with N occurrences of kept terms gives a term with c of them the share p = 1 + floor(10^9 (c + 1) / (N + V));
    the language's own q is alike. The divergence of a term is floor((p - q)^2 / q). ``pair`` sums it over all kept terms, with q of the other source;
    ``term`` lists the kept terms that the source uses more than its language, the ``top`` first ones. Ranks go by value, then item.

    Kept terms of a language are dealt out to blocks of about ``block_rows`` rows, so that no task holds a language; a block gives sums of sources,
    as many as the result has. Statistics of languages and sources are broadcast up to ``broadcast_rows`` rows; beyond it the same joins shuffle.
    Sums are exact 64-bit integers while a language keeps fewer than 10^8 terms.

    Null text, lang and source count as ''. Empty texts count for their source only, which then has pairs. Long texts are counted whole.
    Repeated rows count as documents of their own. Empty table: no rows. Other columns are not read.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = count_terms(own).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counts = stored(parts, "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).where(F.col("docs") >= least_docs)
    kept = stored(kept.drop("docs").withColumn("term_id", F.monotonically_increasing_id()), "kept")
    cells = stored(counts.drop("docs").join(kept.select("lang", "term", "term_id", "total"), ["lang", "term"]), "cells")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("n_lang"), F.sum("sources").alias("rows"))
    of_source = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    named = own.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("n", "terms", "n_lang")}
    blocks = F.ceil(F.coalesce("rows", F.lit(1)) / block_rows).cast("long").alias("blocks")
    groups = stored(named.select("lang", "source", *[c.alias(k) for k, c in filled.items()], blocks, F.monotonically_increasing_id().alias("gid")), "groups")

    p, q = share(F.col("count"), F.col("n"), F.col("terms")), share(F.col("total"), F.col("n_lang"), F.col("terms"))
    rows = cells.join(bounded(groups, broadcast_rows), ["lang", "source"]).withColumn("p", p)
    more = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)

    block = F.pmod(F.xxhash64("term_id"), F.col("blocks")).alias("block")
    p0 = F.when(F.col("terms") > 0, share(F.lit(0), F.col("n"), F.col("terms"))).otherwise(1)
    absent = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "gid", p0.alias("p"))
    sums = pair_sums(rows.select("lang", block, "gid", "term_id", "p"), absent).groupBy("a", "b").agg(F.sum("value").alias("value"))
    first = bounded(groups.select(F.col("gid").alias("a"), "lang", "source"), broadcast_rows)
    second = bounded(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), broadcast_rows)
    pairs = sums.join(first, "a").join(second, "b").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(by_rank))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


DIVERGENCE_SQL = """
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), word AS (SELECT id, lang, source, unnest(terms) AS term FROM doc),
cell AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS d FROM word GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM cell GROUP BY ALL HAVING sum(d) >= 3),
of_lang AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
own AS (SELECT lang, source, term, cell.c FROM cell JOIN kept USING (lang, term)),
grp AS (SELECT g.lang, g.source, coalesce(sum(own.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN own USING (lang, source) GROUP BY ALL),
share AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(own.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(own.c, 0) + 1)::HUGEINT) // (grp.n + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.c + 1)::HUGEINT) // (l.n + l.v)::HUGEINT AS q
  FROM grp JOIN of_lang l USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = grp.lang AND own.source = grp.source AND own.term = kept.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM share WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

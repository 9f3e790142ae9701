"""Operator 8: benchmark decontamination by a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.common import lower_ascii, row_key, same_key, stored

KEY = ["k_id", "k_a", "k_b"]
#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def parts_of(text: str) -> Column:
    """What a text falls into between words; only the first and the last part may be empty."""
    return F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), BETWEEN)


def words_of(text: str) -> Column:
    """Words of a text; A-Z count as lower case. Null has none."""
    return F.filter(parts_of(text), lambda w: w != "")


def lead(parts: Column) -> Column:
    """1 where the first part is empty, else 0."""
    return F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)


def count_of(text: str) -> Column:
    """Number of words."""
    parts = parts_of(text)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.size(parts) - lead(parts) - last


def phrase_matches(docs: DataFrame, items: DataFrame, *, window: int = 13, near: float = 0.8, band: int = 8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Exact phrase matches and proximity matches of the items in docs.

    Returns k_id, k_a, k_b (the row's key), item_id, first and last (word positions in the document), exact. A window of an item, ``window``
    consecutive words or all of a shorter item, matches exactly where all its words stand in a row, and by proximity where at least ``near`` of
    them stand on diagonals (position less offset) of one band, so that words may be changed, left out or put in between. Bands are ``band``
    diagonals wide and lie twice over each other, shifted by half, so two words whose diagonals differ by half a band or less always share one.

    1. Index: postings (term, row, position) of the items' terms in the documents, written where the documents are read, without a shuffle.
    2. Each window names its rarest terms, two more than it may miss. Their lists meet on the band of position less offset; a match has
       two of them at least in one band, so one pass over the lists of the rarest terms gives all candidates.
    3. The lists of all of the item's terms meet the candidates on (row, term, position), and the places of each window are counted.

    Items' terms and places, and keys of candidate rows, are broadcast only if they are at most ``broadcast_rows``, else joined by a shuffle.
    A frequent term is spread over the tasks that hold its documents; it is asked for only where a window has no rarer ones.
    """
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    item = items.select("item_id", words_of("text").alias("w")).where(F.size("w") > 0)
    item = item.groupBy("w").agg(F.collect_set("item_id").alias("item_ids"))  # items with the same words
    item = stored(item.withColumn("item", F.monotonically_increasing_id()), "items")
    words = item.select("item", F.size("w").alias("n"), F.posexplode("w").alias("q", "word"))
    terms = stored(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    places = stored(words.join(terms, "word").select("item", "n", "q", "term"), "places")

    rows = docs.select(*row_key(), parts_of("text").alias("parts"))
    rows = rows.select(*KEY, lead(F.col("parts")).alias("lead"), F.posexplode("parts").alias("at", "word"))
    postings = stored(rows.join(small(terms), "word").select("term", *KEY, (F.col("at") - F.col("lead")).alias("p")), "postings")
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n_postings")), "counts")

    # the rarest places of each window, over starts s of the item; a term that no document has is the rarest
    length = F.least("n", F.lit(window))
    least = F.ceil(length * F.lit(near) - 1e-9).cast("int")  # words in place that make a match
    starts = places.where(F.col("q") <= F.greatest(F.col("n") - window, F.lit(0))).select("item", F.col("q").alias("s"))
    rare = places.join(counts, "term", "left").withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    inside = rare.join(starts, "item").where((F.col("q") >= F.col("s")) & (F.col("q") < F.col("s") + window))
    rank = F.row_number().over(Window.partitionBy("item", "s").orderBy("n_postings", "term", "q"))
    named = inside.withColumn("rank", rank).where((F.col("rank") <= length - least + 2) & (F.col("n_postings") > 0))
    anchors = stored(named.select("item", "term", "q", (least == 1).alias("alone")).distinct(), "anchors")
    shift = F.col("grid") * (band // 2)
    of_band = F.floor((F.col("p") - F.col("q") + shift) / band)
    grids = F.explode(F.array(F.lit(0), F.lit(1))).alias("grid")
    met = postings.join(small(anchors), "term").select(*KEY, "item", "p", "q", "alone", grids).withColumn("band", of_band)
    together = met.groupBy(*KEY, "item", "grid", "band", "alone").agg(F.min("q").alias("low"), F.max("q").alias("high"))
    candidates = stored(together.where(F.col("alone") | (F.col("low") < F.col("high"))).select(*KEY, "item", "grid", "band"), "candidates")

    # positions in blocks as wide as a band: those of a word in a band lie in two blocks
    low = F.col("band") * band - shift + F.col("q")
    block = F.explode(F.array(F.floor(low / band), F.floor(low / band) + 1)).alias("block")
    asked = candidates.join(small(places), "item").where(low > -band).select("*", block)
    touched = candidates.select(*KEY).distinct()
    lists = postings.withColumn("block", F.floor(F.col("p") / band)).alias("l").join(small(touched).alias("t"), same_key("l", "t"), "left_semi")
    place = (F.col("a.term") == F.col("l.term")) & (F.col("a.block") == F.col("l.block"))
    hits = asked.alias("a").join(lists.alias("l"), same_key("a", "l") & place).where(of_band == F.col("a.band"))
    hits = hits.select(*[F.col(f"a.{c}").alias(c) for c in (*KEY, "item", "n", "grid", "band", "q")], "p")
    hits = stored(hits.distinct(), "hits")

    def ends(hits: DataFrame, group: list[str], enough: Column, exact: bool) -> DataFrame:
        run = Window.partitionBy(*KEY, "item", *group).orderBy("q").rangeBetween(1 - window, 0)
        at = hits.withColumn("in_place", F.count("*").over(run)).where(F.col("in_place") >= enough)
        return at.select(*KEY, "item", F.greatest(F.lit(0), F.col("p") - length + 1).alias("first"), F.col("p").alias("last"), F.lit(exact).alias("exact"))

    in_row = ends(hits.where("grid = 0").withColumn("diagonal", F.col("p") - F.col("q")), ["diagonal"], length, True)
    one_each = hits.groupBy(*KEY, "item", "n", "grid", "band", "q").agg(F.max("p").alias("p"))
    found = in_row.union(ends(one_each, ["grid", "band"], least, False)).distinct()
    return found.join(small(item.select("item", "item_ids")), "item").select(*KEY, F.explode("item_ids").alias("item_id"), "first", "last", "exact")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, share: float = 0.05, **options) -> DataFrame:
    """Row keys of documents with matches: n_hit, n_items, items_sha256, n_near (items matched by proximity only)."""
    found = stored(phrase_matches(docs, items, window=window, **options), "matches")
    spans = found.where("exact").select(*KEY, "first", "last").distinct()
    order = Window.partitionBy(*KEY).orderBy("first", "last")
    covered = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(F.col("covered") + 1, F.lit(0))) + 1)
    hits = spans.withColumn("covered", covered).groupBy(*KEY).agg(F.sum(fresh).alias("n_hit"))
    pairs = found.groupBy(*KEY, "item_id").agg(F.max("exact").alias("exact"))
    ids = F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string"))))
    by_row = pairs.groupBy(*KEY).agg(F.count_if("exact").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), F.count_if(~F.col("exact")).alias("n_near"))
    both = by_row.alias("a").join(hits.alias("b"), same_key("a", "b"), "left")
    return both.select("a.k_id", "a.k_a", "a.k_b", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "n_items", "items_sha256", "n_near")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 13, parts_of: int = 20, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every document.

    A word is hit inside any occurrence of ``window`` consecutive words of an item (all words of a shorter item). A
    document is contaminated with a hit and ``parts_of`` * n_hit >= n_words.

    Null or empty text: no words, clean. Null item texts and items without a word match nothing. Items with equal words are all named.
    Repeated rows give repeated rows; null ids are allowed; empty tables give no hit or no row. Other columns are not read.
    """
    found = contamination(docs, items, window=window, **options)
    rows = docs.select(F.col("doc_id").alias("d_id"), *row_key(), count_of("text").cast("long").alias("n_words"))
    joined = rows.alias("r").join(found.alias("f"), same_key("r", "f"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        F.col("d_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"), ((n_hit > 0) & (parts_of * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, window: int = 13, parts_of: int = 20, **options) -> DataFrame:
    """Rows of docs, all columns, that aren't contaminated. Only exact matches are looked for."""
    found = contamination(docs, items, window=window, near=1.0, **options).where("n_hit > 0")
    rows = docs.select(F.struct("*").alias("d_row"), *row_key())
    joined = rows.alias("r").join(found.alias("f"), same_key("r", "f"), "left").select("d_row", "n_hit")
    n_words = count_of("d_row.text")
    clean = joined.where(F.col("n_hit").isNull() | (parts_of * F.col("n_hit") < n_words))
    return clean.select(*[F.col("d_row").getField(c).alias(c) for c in docs.columns])


DECONTAM_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS phrase
  FROM item WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM win), distinct_win AS (SELECT DISTINCT phrase FROM win), 
gram AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM doc, lengths WHERE len(w) >= n
), hit AS (
  SELECT g.doc_id, g.n, g.p, g.phrase FROM gram g JOIN distinct_win USING (phrase)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT h.doc_id, CAST(w.item_id AS VARCHAR) AS item FROM hit h JOIN win w USING (phrase)) GROUP BY doc_id
), place AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS q FROM item WHERE len(w) > 0),
doc_place AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM doc),
banded AS (
  SELECT DISTINCT doc_id, item_id, least(13, n) AS size, grid, floor((p - q + 4 * grid) / 8) AS band, q
  FROM doc_place JOIN place USING (word), (SELECT unnest([0, 1]) AS grid)
), near_item AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, item_id, grid, band ORDER BY q RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM banded
  ) WHERE c >= ceil(0.8 * size)
), near AS (
  SELECT doc_id, count(*) AS n_near FROM near_item x
  WHERE NOT EXISTS (FROM hit h JOIN win w USING (phrase) WHERE h.doc_id = x.doc_id AND w.item_id = x.item_id) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

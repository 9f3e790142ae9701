"""Page layout: positioned items to lines in reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio.functions.text import line_signature, normalized_title

TOP, BOTTOM = 0.065, 0.92
PAGE = ["doc_id", "page"]
#: Order of a row's items.
IN_CHUNK = ["x", "y", "seq"]
BOX = "first boolean, last boolean, spaced boolean, x double, y double, width double, height double"
LAYOUT = "gutter double, columns int, n_left long, n_right long, n_lines int, ord int"


def row_starts(y: np.ndarray, height: np.ndarray, first: tuple[float, float] | None) -> list[int]:
    """Items at which a row starts, of items sorted by y; ``first``: y and height of the first item of the row that is open before them.

    From each row's first item the next one is looked for among those within the widest tolerance that its height allows; the exact one, of both heights, says
    where the row ends.
    """
    starts, at = [], 0
    while at < len(y):
        if first is not None:
            y0, h0 = first
            widest = max(2.0, 0.25 * (np.nanmax(height[at:], initial=0.0) if np.isnan(h0) else h0))
            high = at + int(np.searchsorted(y[at:], y0 + widest + 1.0, side="right"))
            near = y[at:high] - y0 <= np.fmax(2.0, 0.25 * np.fmin(h0, height[at:high]))
            at = high if near.all() else at + int(np.argmin(near))
            if at == len(y):
                break
        starts.append(at)
        first = y[at], height[at]
        at += 1
    return starts


def clear_starts(y: np.ndarray, height: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Of items sorted by y, those at which a row starts; ``opens``: those that are the first of a page.

    An item further below the one before it than its own height allows is too far from any first item above, so rows start there for certain. Items between
    two such places are one row if all are near its first; only the others are looked at row by row.
    """
    starts, missing = opens.copy(), np.isnan(y)
    starts[1:] |= missing[1:] | missing[:-1]
    starts[1:] |= y[1:] - y[:-1] > np.where(np.isnan(height[1:]), np.inf, np.fmax(2.0, 0.25 * height[1:]))
    at = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    y0, h0 = y[at][run], height[at][run]
    loose = ~missing & ~(y - y0 <= np.fmax(2.0, 0.25 * np.fmin(h0, height)))
    loose[at] = False
    ends = np.append(at[1:], len(y))
    for i in np.unique(run[loose]):
        starts[at[i] + np.array(row_starts(y[at[i] : ends[i]], height[at[i] : ends[i]], None), np.int64)] = True
    return starts


def number_rows(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Rows of items (doc_id, page, y, height) that stream by in order; a task keeps a row's number and first item, so pages may have any size."""
    page, row, first = None, -1, None
    for doc_id, number, y, height in batches:
        if not len(y):
            yield pa.array([], pa.int32())
            continue
        keys = [np.asarray(c.dictionary_encode().indices.fill_null(-1)) for c in (doc_id, number)]
        y, height = (c.cast("double").to_numpy(zero_copy_only=False) for c in (y, height))
        opens = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))
        same = (doc_id[0].as_py(), number[0].as_py()) == page
        carried = int(same and first is not None)  # the first item of the open row stands before the batch
        if carried:
            y, height, opens = np.append(first[0], y), np.append(first[1], height), np.append([True, False], opens[1:])
        starts = clear_starts(y, height, opens)
        count = np.cumsum(starts)
        rows = count - np.maximum.accumulate(np.where(opens, count, 0))
        if same:
            later = np.flatnonzero(opens[1:])
            rows[: later[0] + 1 if len(later) else len(rows)] += row + 1 - carried
        at = np.flatnonzero(starts)[-1]
        page, row, first = (doc_id[-1].as_py(), number[-1].as_py()), int(rows[-1]), None if np.isnan(y[at]) else (y[at], height[at])
        yield pa.array(rows[carried:].astype(np.int32))


def by_page(df: DataFrame, together: bool, *order: str) -> DataFrame:
    """df in order of page and ``order`` within partitions; its pages are dealt out first, unless the rows of each are ``together`` in a partition already."""
    return (df if together else df.repartition(*PAGE)).sortWithinPartitions(*PAGE, *order)


def cluster_rows(items: DataFrame, together: bool = False) -> DataFrame:
    """L1: items with ``row``: an item joins the row when its y is within max(2, a quarter of the lower height) of the row's first item.

    A page's items stream by in order of y; only their page, y and height go to Python. Items without y are rows of their own; a missing height does not narrow
    the tolerance. ``together``, here and in L2 to L7: the rows of each page are in one partition already (as this leaves them), so nothing moves.
    """
    # in order of the stream, so neither moved nor repeated
    row = F.arrow_udf(number_rows, T.IntegerType()).asNondeterministic()
    return by_page(items, together, "y", "x", "seq").withColumn("row", row(*PAGE, F.col("y").cast("double"), F.col("height").cast("double")))


def changes(*keys: pa.Array) -> np.ndarray:
    """Rows at which a key differs from that of the row before; the first one always does."""
    found = np.ones(len(keys[0]), bool)
    codes = [np.asarray(c if pa.types.is_integer(c.type) and not c.null_count else c.dictionary_encode().indices.fill_null(-1)) for c in keys]
    found[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    return found


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    return [c.cast("double").to_numpy(zero_copy_only=False) for c in columns]


def _flags(*columns: pa.Array) -> list[np.ndarray]:
    return [c.fill_null(False).to_numpy(zero_copy_only=False) for c in columns]


def _gaps(x: np.ndarray, width: np.ndarray, before: tuple[float, float]) -> np.ndarray:
    """Distance of each item from the end of the one before it."""
    return x - np.append(before[0], x[:-1]) - np.append(before[1], width[:-1])


def number_chunks(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Chunks of items (doc_id, page, row, x, width, height, page_width) that stream by in order; a task keeps the last item and its chunk."""
    last, before, chunk = None, (np.nan, np.nan), 0
    for doc_id, page, row, *measures in batches:
        if not len(row):
            yield pa.array([], pa.int32())
            continue
        x, width, height, page_width = _numbers(*measures)
        opens = changes(doc_id, page, row)
        opens[0] = (doc_id[0].as_py(), page[0].as_py(), row[0].as_py()) != last
        count = np.cumsum(~opens & (_gaps(x, width, before) >= np.fmax(height * 2.3, page_width * 0.06)))
        chunks = count - np.maximum.accumulate(np.where(opens, count, 0))
        later = np.flatnonzero(opens)
        chunks[: later[0] if len(later) else len(chunks)] += chunk
        last, before, chunk = (doc_id[-1].as_py(), page[-1].as_py(), row[-1].as_py()), (x[-1], width[-1]), int(chunks[-1])
        yield pa.array(chunks.astype(np.int32))


def split_chunks(rows: DataFrame, together: bool = False) -> DataFrame:
    """L2: rows with ``chunk``: a new one where the gap is max(2.3 heights, 6 % of the page's width) or more. Rows come out in order of row, x, y and seq."""
    chunk = F.arrow_udf(number_chunks, T.IntegerType()).asNondeterministic()
    measures = [F.col(c).cast("double") for c in ("x", "width", "height", "page_width")]
    return by_page(rows, together, "row", *IN_CHUNK).withColumn("chunk", chunk(*PAGE, "row", *measures))


def chunk_boxes(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of items (doc_id, page, row, chunk, x, y, width, height, begins, ends) that stream by in order: whether they are first or last of a chunk and whether a space goes
    before them, and at the last one the chunk's box.

    ``begins`` and ``ends``: the item's text does so as Latin does. An item waits for the next one, which says whether its chunk ends; a task keeps it and the open
    chunk's box.
    """
    kept, box, before = None, None, (np.nan, np.nan, False)

    def told(columns: list[pa.Array], final: bool) -> pa.Array:
        nonlocal box, before
        opens = np.append(changes(*columns[:4]), final)
        opens[0] = box is None
        n = len(opens) - 1 if final else len(opens) - 2
        first, last = opens[:n], opens[1 : n + 1]
        (x, y, width, height), (begins, ends) = _numbers(*(c[:n] for c in columns[4:8])), _flags(*(c[:n] for c in columns[8:]))
        latin = begins & np.append(before[2], ends[:-1])[:n]
        spaced = ~first & latin & (_gaps(x, width, before[:2])[:n] > height * 0.12)
        if n:
            starts = np.unique(np.append(0, np.flatnonzero(first)))
            boxes = np.stack([np.fmin.reduceat(x, starts), np.fmin.reduceat(y, starts), np.fmax.reduceat(height, starts)])
            if box is not None:
                boxes[:, 0] = np.fmin(boxes[0, 0], box[0]), np.fmin(boxes[1, 0], box[1]), np.fmax(boxes[2, 0], box[2])
            low_x, low_y, high = boxes[:, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))]
            box, before = None if last[-1] else boxes[:, -1], (x[-1], width[-1], ends[-1])
        else:
            low_x, low_y, high = x, y, height
        measures = [pa.array(c, pa.float64(), from_pandas=True) for c in (low_x, low_y, x + width - low_x, high)]
        return pa.StructArray.from_arrays([*map(pa.array, (first, last, spaced)), *measures], names=["first", "last", "spaced", "x", "y", "width", "height"])

    for batch in batches:
        if len(batch[0]):
            columns = [pa.concat_arrays([k, c]) for k, c in zip(kept, batch, strict=True)] if kept else list(batch)
            yield told(columns, False)
            kept = [c[-1:] for c in columns]
    if kept:
        yield told(kept, True)


def first_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Values of the first item of each chunk, of items (value, first) that stream by in order."""
    held = None
    for value, first in batches:
        if len(value):
            held = value[:0] if held is None else held
            at = np.maximum.accumulate(np.where(first.to_numpy(zero_copy_only=False), np.arange(len(value)) + len(held), 0))
            value = pa.concat_arrays([held, value]).take(pa.array(at))
            held = value[-1:]
        yield value


def chunk_texts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Joined parts of each chunk at its last item, null elsewhere, of items (part, first, last) that stream by in order; a task keeps the parts of the open chunk."""
    open_: list[str] = []
    for part, first, last in batches:
        begins, ends = (np.flatnonzero(c.to_numpy(zero_copy_only=False)) for c in (first, last))
        head = int(begins[0]) if len(begins) else len(part)
        if head:
            open_.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, head], pa.int32()), part[:head]), "")[0].as_py())
        cuts = np.append(begins, len(part)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), part), "") if len(begins) else pa.array([], pa.string())
        if len(ends) and ends[0] < head:  # the chunk that was open ends in this batch
            joined, open_ = pa.concat_arrays([pa.array(["".join(open_)]), joined]), []
        if len(joined) > len(ends):
            open_.append(joined[-1].as_py())
        place = np.full(len(part), -1)
        place[ends] = np.arange(len(ends))
        yield joined.take(pa.array(place, mask=place < 0))


def join_text(chunks: DataFrame, together: bool = False, in_order: bool = False) -> DataFrame:
    """L3, L4: a line for each chunk: joined text and box.

    A space goes between Latin neighbours more than 12 % of the height apart, where neither side has one. A chunk's items stream by and its line stands at the last
    one; only numbers and parts go to Python, and no parts where the text isn't asked for. ``in_order``: the rows are as ``split_chunks`` leaves them. Lines come out
    in order of page, row and chunk.
    """
    ordered = chunks if in_order else by_page(chunks, together, "row", "chunk", *IN_CHUNK)
    streamed = lambda f, kind: F.arrow_udf(f, kind).asNondeterministic()
    measures = [F.col(c).cast("double") for c in ("x", "y", "width", "height")]
    latin = [F.col("text").rlike("^[A-Za-z0-9(]"), F.col("text").rlike("[A-Za-z0-9)]$")]
    ordered = ordered.withColumn("_box", streamed(chunk_boxes, BOX)(*PAGE, "row", "chunk", *measures, *latin))
    first, last = F.col("_box.first"), F.col("_box.last")
    part = F.coalesce(F.concat(F.when(F.col("_box.spaced"), " ").otherwise(""), "text"), F.lit(""))
    joined = ordered.select(
        *PAGE, "row", "chunk", streamed(chunk_texts, "string")(part, first, last).alias("joined"), last.alias("last"), *[F.col(f"_box.{c}") for c in ("x", "y", "width", "height")],
        *[streamed(first_of, ordered.schema[c].dataType)(F.col(c), first).alias(c) for c in ("font", "page_width", "page_height")],
    )
    return joined.where("last").select(
        *PAGE, "row", "chunk", F.regexp_replace("joined", r"(?U)^\s+|\s+$", "").alias("text"), "x", "y", "width", "height", "font", "page_width", "page_height",
    )


def with_upper_median(df: DataFrame, keys: list[str], value: Column, keep: Column, name: str) -> DataFrame:
    """df with the upper median of the values to ``keep`` of each group of ``keys``, 0 without any: by rank over windows, so nothing is listed."""
    kept = F.coalesce(keep, F.lit(False)) & value.isNotNull()
    own = Window.partitionBy(*keys)
    ranked = df.withColumns({"_kept": kept, "_value": value}).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_kept").orderBy("_value")))
    at = F.col("_kept") & (F.col("_nth") == F.floor(F.col("_n") / 2) + 1)
    ranked = ranked.withColumn("_n", F.count_if("_kept").over(own))
    return ranked.withColumn(name, F.coalesce(F.max(F.when(at, F.col("_value"))).over(own), F.lit(0.0))).drop("_kept", "_value", "_nth", "_n")


def laid_out(page: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, page_width: np.ndarray, page_height: np.ndarray, gutter: np.ndarray, columns: np.ndarray) -> pa.Array:
    """L5, L6 for the lines of whole pages (``page``: numbered from 0) in order of row and chunk: gutter, columns and lines on either side of their page, its lines, and
    their place in it. ``gutter`` and ``columns`` hold where they are given. A missing y or x comes first in order."""
    starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    n_lines, right_end, sheet = np.diff(np.append(starts, len(page))), x + width, page_width[starts]
    left, right = (right_end <= page_width * 0.53) & (x < page_width * 0.35), (x >= page_width * 0.45) & (width < page_width * 0.5)
    n_left, n_right = np.add.reduceat(left, starts, dtype=np.int64), np.add.reduceat(right, starts, dtype=np.int64)
    left_end = np.fmax(np.fmax.reduceat(np.where(left, right_end, np.nan), starts), 0.0)
    right_start = np.fmin.reduceat(np.where(right, x, np.nan), starts)
    # upper median of the left ones' ends
    ends = right_end[np.lexsort((right_end, ~left, page))][np.minimum(starts + n_left // 2, len(page) - 1)]
    two = (n_left >= 3) & (n_right >= 3) & (right_start - ends > sheet * 0.035)
    told = ~np.isnan(columns[starts])
    gutter = np.where(told, gutter[starts], (left_end + np.fmin(np.where(np.isnan(right_start), sheet, right_start), sheet)) / 2)
    columns = np.where(told, columns[starts], np.where(two, 2, 1)).astype(np.int32)
    own, single = gutter[page], columns[page] == 1
    across = (columns[page] == 2) & (((x < own) & (right_end > own)) | (y < page_height * TOP) | (y > page_height * BOTTOM))
    side = np.where(single, 0, np.where(across, 2, np.where(x < own, 0, 1)))
    y, x = np.where(np.isnan(y), -np.inf, y), np.where(np.isnan(x), -np.inf, x)
    # a line at the height of a cutting line belongs to the band after it; cutting lines have one each
    by_y = np.lexsort((~across, y, page))
    count = np.cumsum(across[by_y])
    count -= (count - across[by_y])[np.repeat(starts, n_lines)]
    same = np.append(True, (y[by_y][1:] != y[by_y][:-1]) | (page[1:] != page[:-1]))
    groups = np.flatnonzero(same)
    upto = np.maximum.reduceat(count, groups)[np.cumsum(same) - 1]
    band = np.empty(len(page), np.int64)
    band[by_y] = np.where(across[by_y], count - 1, upto)
    band[single] = 0
    order = np.lexsort((np.where(single, x, 0.0), y, side, band, page))
    place = np.empty(len(page), np.int32)
    place[order] = np.arange(len(page)) - np.repeat(starts, n_lines)
    each = [pa.array(gutter[page], pa.float64(), from_pandas=True), *(pa.array(c[page]) for c in (columns, n_left, n_right, n_lines.astype(np.int32))), pa.array(place)]
    return pa.StructArray.from_arrays(each, names=["gutter", "columns", "n_left", "n_right", "n_lines", "ord"])


def lay_out(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``laid_out`` for lines (doc_id, page, x, y, width, page_width, page_height, gutter, columns) that stream by in order; a task keeps the numbers of the open page."""
    held: list[list[np.ndarray]] = []
    last = None

    def closed() -> pa.Array:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return laid_out(np.cumsum(columns[0]) - 1, *columns[1:])

    for doc_id, page, *measures in batches:
        if not len(page):
            continue
        opens = changes(doc_id, page)
        opens[0] = (doc_id[0].as_py(), page[0].as_py()) != last
        last = doc_id[-1].as_py(), page[-1].as_py()
        columns, cut = [opens, *_numbers(*measures)], int(np.flatnonzero(opens)[-1]) if opens.any() else None
        if cut is None:
            held.append(columns)
            continue
        held.append([c[:cut] for c in columns])
        if any(len(c[0]) for c in held):
            yield closed()
        held = [[c[cut:] for c in columns]]
    if held:
        yield closed()


def _laid_out(lines: DataFrame, together: bool, in_order: bool) -> DataFrame:
    """lines with ``_page``, of ``lay_out``; ``gutter`` and ``columns`` hold where lines have them."""
    ordered = lines if in_order else by_page(lines, together, "row", "chunk")
    measures = [F.col(c).cast("double") for c in ("x", "y", "width", "page_width", "page_height")]
    given = [(F.col(c) if c in lines.columns else F.lit(None)).cast("double") for c in ("gutter", "columns")]
    return ordered.withColumn("_page", F.arrow_udf(lay_out, LAYOUT).asNondeterministic()(*PAGE, *measures, *given))


def detect_columns(lines: DataFrame, together: bool = False, in_order: bool = False) -> DataFrame:
    """Gutter and one or two columns of each page. ``in_order``: the lines are as ``join_text`` leaves them."""
    return _laid_out(lines, together, in_order).where("_page.ord = 0").select(*PAGE, *[F.col(f"_page.{c}") for c in ("gutter", "columns", "n_left", "n_right")])


def reading_order(lines: DataFrame, columns: DataFrame | None = None, together: bool = False, in_order: bool = False) -> DataFrame:
    """Lines with ``ord``, and ``n_lines`` of their page: across-page lines cut a two-column page into bands; in a band left comes first, then right, then the line that cuts.

    Without ``columns`` (of ``detect_columns``) they come from the lines. A page's lines stream by in order and their numbers are held until it ends; no text goes to
    Python. ``in_order``: the lines are as ``join_text`` leaves them.
    """
    if columns is not None:
        lines, together, in_order = lines.join(columns.select(*PAGE, "gutter", "columns"), PAGE), False, False
    own = [c for c in lines.columns if c not in ("gutter", "columns")]
    return _laid_out(lines, together, in_order).select(*own, *[F.col(f"_page.{c}") for c in ("gutter", "columns", "n_lines", "ord")])


def page_text(lines: DataFrame, together: bool = False) -> DataFrame:
    """Text of each page, of the lines of ``reading_order``. They stream by in order; a task holds the text of one page."""
    ordered = by_page(lines.select(*PAGE, "text", "n_lines", "ord"), together, "ord")
    first, last = F.col("ord") == 0, F.col("ord") == F.col("n_lines") - 1
    part = F.concat(F.when(first, "").otherwise("\n"), F.coalesce("text", F.lit("")))
    joined = F.arrow_udf(chunk_texts, T.StringType()).asNondeterministic()(part, first, last)
    return ordered.withColumn("joined", joined).where(last).select(*PAGE, F.col("joined").alias("text"))


def mark_margins(lines: DataFrame, page_height: float = 792.0, page_counts: DataFrame | None = None) -> DataFrame:
    """Lines with ``margin``: small, in the top or bottom zone, and with a signature on max(2, 60 % of the pages) pages there.

    A page's height is its ``page_height`` where lines have that column, else the one given. A document's pages are those of ``page_counts``, else as
    many as its last line's page says.
    """
    height = F.col("page_height") if "page_height" in lines.columns else F.lit(page_height)
    zone = (F.col("y") < height * TOP) | (F.col("y") > height * BOTTOM)
    signed = lines.drop("margin").withColumns({"zone": zone, "signature": F.when(zone, line_signature(F.col("text")))})
    seen = signed.where("zone").groupBy("doc_id", "signature").agg(F.count_distinct("page").alias("n_seen"))
    signed = with_upper_median(signed, PAGE, F.col("height"), F.length("text") > 20, "body")
    if page_counts is None:
        signed = signed.withColumn("n_pages", F.max("page").over(Window.partitionBy("doc_id")))
    else:
        signed = signed.join(page_counts.select("doc_id", "n_pages"), "doc_id")
    joined = signed.join(seen, ["doc_id", "signature"], "left")
    often = F.coalesce("n_seen", F.lit(0)) >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * 0.6))
    margin = F.col("zone") & often & (F.col("height") <= F.col("body") * 1.1)
    return joined.withColumn("margin", margin).drop("zone", "signature", "n_seen", "n_pages", "body")


def text_quality(pages: DataFrame) -> DataFrame:
    """failure code of each document's text layer; null if it is usable."""
    sums = pages.groupBy("doc_id").agg(
        F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]"))).alias("letters"), F.sum(F.regexp_count("text", F.lit("\ufffd"))).alias("broken"),
        F.sum(F.length("text")).alias("chars"),
    )
    code = F.when(F.col("letters") < 12, "text_layer_required").when(F.col("broken") > F.col("chars") * 0.1, "unreadable_text_layer")
    return sums.select("doc_id", "letters", "chars", code.alias("failure"))


def verify_outlines(outlines: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks with ``verified``: target in range and title in that page's navigation text."""
    title = normalized_title(F.col("title"))
    body = pages.select(*PAGE, normalized_title(F.col("navigation_text")).alias("body"))
    joined = outlines.drop("verified").withColumn("key", title).join(body, PAGE, "left")
    return joined.withColumn("verified", F.coalesce((F.col("key") != "") & F.col("body").contains(F.col("key")), F.lit(False))).drop("key", "body")


def diagnostics(columns: DataFrame, outlines: DataFrame) -> DataFrame:
    """Distinct flags of each document that has any."""
    two = columns.groupBy("doc_id").agg((F.max("columns") > 1).alias("two"))
    loose = outlines.groupBy("doc_id").agg(F.max(~F.col("verified")).alias("loose"))
    flags = F.array_compact(F.array(F.when(F.col("two"), "multi_column_reading_order"), F.when(F.col("loose"), "unverified_bookmark_candidates")))
    return two.join(loose, "doc_id", "full").select("doc_id", flags.alias("flags"))


def page_count_gate(pages: DataFrame, most: int) -> DataFrame:
    """Documents with more pages than the bound."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") > most)

"""Operator 6: best-fit packing of token sequences by large-item matching."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folio.llm.bpe import LibraryWords, frugal, slices
from folio.llm.common import session_of, stored
from folio.llm.token_counts import tokenizer_spec

#: MB of text that a task tokenizes at a time: each distinct word of them meets the library once, so small batches repeat much of its work.
BATCH_MB = 16


@dataclass
class Bins:
    """``count`` bins that are filled alike: (length, how many) in order of placing."""

    count: int
    items: list[tuple[int, int]]

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.items)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Fill bins from the number of pieces of each length.

    Lengths above a third of the capacity pair at most twice a bin: the longest one left takes the longest other one that
    fits. Shorter ones then go, longest first, each to the bin with the least room that still holds it. Equal pieces go
    together, so the work depends on the number of lengths (the capacity at most), not on the number of pieces.
    """
    left = {k: n for k, n in histogram.items() if n}
    large = sorted(k for k in left if 3 * k > capacity)
    room: dict[int, list[Bins]] = {}
    full: list[Bins] = []
    gaps: list[int] = []

    def keep(bins: Bins) -> None:
        gap = capacity - bins.used
        if not gap:
            full.append(bins)
            return
        if gap not in room:
            bisect.insort(gaps, gap)
        room.setdefault(gap, []).append(bins)

    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        if at < 0:
            keep(Bins(left[longest], [(longest, 1)]))
            left[longest] = 0
        else:
            other = large[at]
            if other == longest and left[longest] == 1:
                at -= 1
                if at < 0:
                    keep(Bins(1, [(longest, 1)]))
                    left[longest] = 0
                    large.pop()
                    continue
                other = large[at]
            if other == longest:
                n = left[longest] // 2
                keep(Bins(n, [(longest, 2)]))
                left[longest] -= 2 * n
            else:
                n = min(left[longest], left[other])
                keep(Bins(n, [(longest, 1), (other, 1)]))
                left[longest] -= n
                left[other] -= n
                if not left[other]:
                    large.pop(at)
        if not left[longest]:
            large.pop()
    for length in sorted((k for k in left if 3 * k <= capacity and k), reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                bins, rest = divmod(n, each)
                if bins:
                    keep(Bins(bins, [(length, each)]))
                if rest:
                    keep(Bins(1, [(length, rest)]))
                break
            gap = gaps[at]
            bins = room[gap].pop()
            if not room[gap]:
                del room[gap], gaps[at]
            each = gap // length
            filled = min(bins.count, n // each)
            if filled:
                keep(Bins(filled, [*bins.items, (length, each)]))
                n -= filled * each
            spare = bins.count - filled
            if spare and n and n < each:
                keep(Bins(1, [*bins.items, (length, n)]))
                spare, n = spare - 1, 0
            if spare:
                keep(Bins(spare, bins.items))
    return full + [b for gap in gaps for b in room[gap]]


def slots(bins: list[Bins], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: the r-th piece of a length belongs to the slot run that holds rank r."""
    seen: dict[int, int] = {}
    base, rows = 0, []
    for b in bins:
        offset = 0
        for length, each in b.items:
            rank = seen.get(length, 0)
            rows.append((length, rank, base, each, offset))
            seen[length] = rank + b.count * each
            offset += length * each
        base += b.count
    rows.sort()
    names = ("length", "rank", "base", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces from their length and rank within it."""
    at = np.searchsorted(plan["length"] << 40 | plan["rank"], length << 40 | rank, side="right") - 1
    run = rank - plan["rank"][at]
    return plan["base"][at] + run // plan["each"][at], plan["offset"][at] + run % plan["each"][at] * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, each with its task and its rank there among equal lengths."""
    spec = session_of(docs).sparkContext.broadcast(tokenizer_spec(vocabulary))

    def run(batches):
        from pyspark import TaskContext

        words, part = LibraryWords(spec.value, spaced=False), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                out = []
                for doc_id, ids in zip(rows.column(0).to_pylist(), words.batch(texts), strict=True):
                    ids = np.append(ids, end)
                    for k, i in enumerate(range(0, len(ids), capacity)):
                        own = ids[i : i + capacity]
                        n = len(own)
                        out.append((doc_id, k, i, n, zlib.crc32(own), part, ranks[n]))
                        ranks[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents, with an end id each, into sequences of at most ``capacity`` ids; only longer ones are cut.

    Texts don't move: a task tokenizes its rows and writes a narrow row a piece. The bins are planned on the
    histogram of lengths (``capacity`` rows at most, the only thing the driver sees), and each piece finds its place from
    its length and its rank among the pieces of that length.

    Null or empty text: the end id alone. Equal rows are packed once each; ids may repeat or be null. An empty table
    gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
    """
    pieces = stored(tokenized_pieces(docs, vocabulary, capacity, end_id), "pieces", BATCH_MB)
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = session_of(docs).sparkContext.broadcast(slots(plan_bins(histogram, capacity), capacity))

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = place(plan.value, length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

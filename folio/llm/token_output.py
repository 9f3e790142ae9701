"""Operator 2: token ids in a bit-plane shuffled file format, and its reader.

A token table is a Parquet table with a row per chunk. A chunk holds whole documents in ascending order:
``part`` and ``chunk`` (its place), ``first_id`` (ids before it in its part), ``n_ids``, ``doc_ids``,
``lengths`` (the chunk index) and ``blocks``: the ids cut into blocks of a fixed number, each block transposed into its
four byte planes (lowest first) or 32 bit planes, each plane compressed with zstandard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folio.llm.bpe import LibraryWords, frugal, slices
from folio.llm.common import parts_for, session_of
from folio.llm.token_counts import tokenizer_spec

BLOCK = 1 << 14
CHUNK_SCHEMA = (
    "part int, chunk int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>,"
    " blocks array<array<binary>>"
)


def shuffled(ids: np.ndarray, bits: bool = False) -> list[np.ndarray]:
    """Planes of a block of 32-bit ids, lowest first."""
    if bits:
        return list(np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1))
    return [np.ascontiguousarray(p) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def unshuffled(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of ``n``."""
    if len(planes) == 32:
        bits = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1), axis=1)[:, :n]
        return np.packbits(bits.T, axis=1, bitorder="little").copy().view("<u4").ravel()
    return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T).view("<u4").ravel()


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 0, bits: bool = False,
    block: int = BLOCK, chunk_ids: int = 1 << 18, level: int = 3,
) -> None:
    """Encode every whole text, append ``end_id``, write a token table at ``path`` in ascending order of doc_id.

    One range shuffle by doc_id (the driver samples ids and hashes, never texts); a task then encodes and writes its range in chunks of
    about ``chunk_ids`` ids, so a lost task is done again alone. Null text: the end id alone. Null ids come first; rows with one id go by
    the hash of their texts, then by the texts. A document longer than a chunk has a chunk of its own.
    """
    spec = session_of(docs).sparkContext.broadcast(tokenizer_spec(vocabulary))
    parts = parts_for(docs, least_mb=20)  # a task's words repeat the more, the more text it has

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        words, part = LibraryWords(spec.value, spaced=True), TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=level)
        end = np.array([end_id], "<u4")
        held: list[tuple[int | None, np.ndarray]] = []
        size, first, n = 0, 0, 0

        def chunk():
            ids = np.concatenate([x for _, x in held])
            blocks = [[squeeze.compress(p.tobytes()) for p in shuffled(ids[i : i + block], bits)] for i in range(0, len(ids), block)]
            row = {
                "part": part, "chunk": n, "first_id": first, "n_ids": len(ids), "doc_ids": [k for k, _ in held],
                "lengths": [len(x) for _, x in held], "blocks": blocks,
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW_CHUNK)

        for batch in batches:
            for rows, texts in slices(batch, "text"):
                for doc_id, ids in zip(rows.column(0).to_pylist(), words.batch(texts), strict=True):
                    if held and size + len(ids) >= chunk_ids:
                        yield chunk()
                        held, first, n, size = [], first + size, n + 1, 0
                    held.append((doc_id, np.append(ids, end)))
                    size += len(ids) + 1
        if held:
            yield chunk()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id", F.xxhash64("text"))
    ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(frugal(run), CHUNK_SCHEMA).write.parquet(path)


ARROW_CHUNK = pa.schema(
    [
        ("part", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.list_(pa.binary()))),
    ]
)


def read_tokens(spark: SparkSession, path: str, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Documents of a token table: doc_id, start (ids before it), n_tokens, ids_crc32, and ids if asked for.

    Chunks decode alone, in any task. The ids before a part come from the chunk index: a row per part, so the side
    that is broadcast has as many rows as the writer had tasks, whatever the documents.
    """
    table = spark.read.parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, ids = row["n_ids"], []
                for k, planes in enumerate(row["blocks"]):
                    ids.append(unshuffled([plain.decompress(p) for p in planes], min(block, n - k * block)))
                flat = np.concatenate(ids)
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                own = [flat[a:b] for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first_id"] + row["base"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                        *([pa.array([x.tolist() for x in own], pa.list_(pa.int64()))] * with_ids),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids],
                )

    return table.join(F.broadcast(bases), "part").mapInArrow(frugal(run), schema)

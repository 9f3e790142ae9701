"""Operator 1: token counts by rank-synchronous array merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folio.llm.bpe import CountingWords, frugal, slices
from folio.llm.common import session_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def tokenizer_spec(path: str) -> str:
    """A tokenizer's JSON, read where the path is known; tasks get its text (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text under the byte-level vocabulary at ``path``.

    Map-only: the distinct words of a batch become ragged byte arrays, each word's lowest-rank pair merges at once in all
    words of a batch until no pair is left, and the surviving symbols count. Strings of special tokens inside
    a text count as one token, as the library takes them.

    Null or empty text: 0 bytes, 0 tokens. A null id stays null; repeated rows give repeated rows; an empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are not read. A text of any
    length is counted whole; one without a space is one piece. A task holds a batch of about 32 MB of text (or one longer text), and keeps
    nothing from one batch to the next.
    """
    spec = session_of(docs).sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        words = CountingWords(spec.value)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                counts = np.asarray(words.batch(texts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pc.cast(pc.binary_length(texts), pa.int64()),
                        pa.array(counts),
                        pa.array(counts > limit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), SCHEMA)

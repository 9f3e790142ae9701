"""Operator 12: near duplicates by MinHash and a multi-index Hamming join.

A set's signature is a row of b-bit symbols, each the low bits of the least feature under a hash; two sets agree in a symbol with a
probability of their similarity J. The signature is cut into m chunks. Of two signatures that differ in r symbols at most, r = m (e + 1) - 1, one chunk
differs in e at most (pigeonhole), so with every choice of e symbols of a chunk left out as errors, they share one of these keys: no pair
within the signature distance is missed. What lies within it is confirmed on the full sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from folio.llm import clusters
from folio.llm.clusters import mixed
from folio.llm.ngram_join import JOIN_SQL, Buckets, bucket_counts

STEP = np.uint64(0x9E3779B97F4A7C15)


def spread(seeds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((seeds.astype(np.uint64) + np.uint64(1)) * STEP)


@dataclass(frozen=True)
class Signatures:
    """MinHash signatures of ``symbols`` 16-bit symbols, cut into ``chunks`` of which one has ``errors`` errors at most.

    The defaults reach a distance of 35 of 96 symbols. Sets with J = 0.85 differ in 14.4 on average; they differ in more than 35 once in 17 million pairs.
    """

    symbols: int = 96
    chunks: int = 18
    errors: int = 1

    @property
    def radius(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    @cached_property
    def factors(self) -> np.ndarray:
        return spread(np.arange(self.symbols)) | np.uint64(1)

    @cached_property
    def kept(self) -> list[np.ndarray]:
        """Symbols of each key: those of a chunk without some ``errors`` of them."""
        parts = np.array_split(np.arange(self.symbols), self.chunks)
        return [np.setdiff1d(part, left_out) for part in parts for left_out in combinations(part.tolist(), self.errors)]

    def sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of symbols for each set; zeros for an empty one."""
        sizes = np.array([len(s) for s in sets], np.int64)
        found = np.zeros((len(sets), self.symbols), np.uint16)
        filled = np.flatnonzero(sizes)
        if len(filled):
            features = np.concatenate(sets)
            starts = (np.cumsum(sizes) - sizes)[filled]
            for i, factor in enumerate(self.factors):
                with np.errstate(over="ignore"):
                    least = np.minimum.reduceat(features * factor, starts)
                found[filled, i] = mixed(least ^ factor).astype(np.uint16)
        return found

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """A row of keys for each row of symbols."""
        found = np.empty((len(sketches), len(self.kept)), np.uint64)
        with np.errstate(over="ignore"):
            coded = mixed(sketches.astype(np.uint64) + np.uint64(1) << np.uint64(16) | np.arange(self.symbols, dtype=np.uint64)[None, :])
            for i, (columns, seed) in enumerate(zip(self.kept, spread(np.arange(len(self.kept)) + self.symbols), strict=True)):
                found[:, i] = mixed(coded[:, columns].sum(axis=1, dtype=np.uint64) ^ seed)
        return found.view(np.int64)

    def sign(self, sets: list[np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
        """Sketches, which are symbols and then bucket counts, and keys."""
        symbols, none = self.sketches(sets), np.empty(0, np.int64)
        sketches = [own.tobytes() + bucket_counts(s) for own, s in zip(symbols, sets, strict=True)]
        return sketches, [k if len(s) else none for s, k in zip(sets, self.keys(symbols), strict=True)]


class Within:
    """Bound by sizes, by bucket counts, which no link exceeds, and by the number of symbols in which signatures differ."""

    def __init__(self, signatures: Signatures, percent: int):
        self.signatures, self.buckets = signatures, Buckets(percent)

    def _parts(self, rows: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        n = 2 * self.signatures.symbols
        return np.frombuffer(b"".join(r[:n] for r in rows), np.uint16).reshape(-1, self.signatures.symbols), [r[n:] for r in rows]

    def aligned(self, a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (symbols_a, counts_a), (symbols_b, counts_b) = self._parts(a), self._parts(b)
        apart, near = self.buckets.aligned(counts_a, size_a, counts_b, size_b)
        return apart, near & ((symbols_a != symbols_b).sum(axis=1) <= self.signatures.radius)

    def crossed(self, a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (symbols_a, counts_a), (symbols_b, counts_b) = self._parts(a), self._parts(b)
        x, y, apart = self.buckets.crossed(counts_a, size_a, counts_b, size_b, asked)
        near = np.zeros(len(x), bool)
        for k in range(0, len(x), 8192):
            near[k : k + 8192] = (symbols_a[x[k : k + 8192]] != symbols_b[y[k : k + 8192]]).sum(axis=1) <= self.signatures.radius
        return x[near], y[near], apart[near]


def _joined(docs: DataFrame, words: int, percent: int, signatures: Signatures, broadcast_rows: int, count_links: bool = True) -> DataFrame:
    own = docs.select("doc_id", "text")
    return clusters.joined_rows(own, clusters.signed_sets(own, words, signatures.sign), Within(signatures, percent), words=words, percent=percent, broadcast_rows=broadcast_rows, count_links=count_links)


def near_duplicates(docs: DataFrame, *, words: int = 3, percent: int = 85, signatures: Signatures | None = None, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Components of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` % or more, and which documents stay.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (whether it is the row's own), n_links (how many other sets of its component the set links with) and class_id
    (the smallest doc_id with the same set). All pairs within the signature distance are candidates; a similarity of ``percent`` is beyond it with the
    probability that ``Signatures`` states. Candidates that bucket counts can't rule out are confirmed on full sets. Of the rows that share a key, which may be any number, the
    smallest meets the others first; groups that then span several components are finished in blocks (``clusters.joined_rows``).

    Null, empty or white-space texts have no set: n_shingles 0, linked with nothing, kept. Null ids: component_id null unless a link gives one; kept where it is null.
    Repeated rows link like copies; all rows of a kept id are kept. Texts of any length count whole. Empty table: empty result. Other columns are not read.
    """
    found = _joined(docs, words, percent, signatures or Signatures(), broadcast_rows)
    return found.selectExpr("doc_id", "n_shingles", "component_id", "doc_id <=> component_id AS kept", "n_links", "class_id")


def keep_one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80, signatures: Signatures | None = None) -> DataFrame:
    """Rows of docs, all columns, one of each component, as ``clusters.one_of_each`` chooses it. At 80 % the distance should be larger: 21 chunks reach 41 of 96."""
    return clusters.one_of_each(docs, _joined(docs, words, percent, signatures or Signatures(chunks=21), 2_000_000, False))


def near_sql() -> str:
    """The result in SQL: all shared n-grams of all pairs."""
    of_three = JOIN_SQL.replace("len(w) - 3", "len(w) - 2").replace("least(len(w), 4)", "least(len(w), 3)")
    return f"SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM ({of_three})"

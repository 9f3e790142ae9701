"""Operator 3: n-gram Jaccard self-join by PartEnum signatures.

Sets whose Jaccard similarity is t % or more and whose sizes add up to S differ in at most k(S) features. Sizes fall into
bands; for each band, and for each pair of neighbour bands, the feature domain is cut into n1 * n2 partitions by a
hash, and each set gives one signature for every subset of n2 - k2 of the n2 parts of each first-level partition. With
k2 = ceil((k + 1) / n1) - 1, two sets that link share at least one signature, so no link is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from folio.llm import clusters
from folio.llm.clusters import MIX_B, components, mixed  # noqa: F401

STEP = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1
#: Hash buckets in which the features of a set are counted; sums of ``COARSE`` of them make a cheaper, weaker bound.
BUCKETS, COARSE = 256, 4


@dataclass(frozen=True)
class Plan:
    """How the sets of one tag are signed."""

    tag: int
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def subsets(self) -> list[list[int]]:
        return [list(c) for c in combinations(range(self.n2), self.n2 - self.k2)]


def distance(total: int, percent: int) -> int:
    """Most features in which two sets can differ that link and whose sizes add up to ``total`` or a little less."""
    return max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(0, total - 4), total + 1))


def plan_of(tag: int, k: int) -> Plan:
    """Small distances take few partitions and larger subsets; large ones single partitions and some to spare."""
    if k <= 3:
        return Plan(tag, k, 1, k + 3, k)
    if k <= 7:
        k2 = -(-(k + 1) // 2) - 1
        return Plan(tag, k, 2, k2 + 3, k2)
    if k <= 23:
        return Plan(tag, k, -(-(k + 1) // 2), 3, 1)
    return Plan(tag, k, k + 3 + k // 40, 1, 0)


def bands(percent: int, ratio: float = 1.3, top: int = 1 << 40) -> tuple[list[int], list[int]]:
    """First and last size of each band; a set's partners are in its own band or the next to it."""
    first, last = [1], [1]
    while last[-1] < top:
        low = last[-1] + 1
        first.append(low)
        last.append(max(int(ratio * low), 100 * last[-1] // percent, low))
    return first, last


class Signer:
    """Signatures of sets for a similarity of ``percent`` %."""

    def __init__(self, percent: int):
        self.percent = percent
        self.first, self.last = bands(percent)
        self.plans: dict[int, Plan] = {}

    def plan(self, tag: int) -> Plan:
        """Even tags are bands; odd ones the meeting of a band and the next."""
        if tag not in self.plans:
            high = self.last[tag // 2]
            self.plans[tag] = plan_of(tag, distance(high + (100 * high // self.percent if tag % 2 else high), self.percent))
        return self.plans[tag]

    def tags(self, size: int) -> list[Plan]:
        """Plans that sign a set of this size; none where only equal sets can link."""
        i = bisect_left(self.last, size)
        tags = [2 * i]
        if 100 * size // self.percent >= self.first[i + 1]:
            tags.append(2 * i + 1)
        if i and size <= 100 * self.last[i - 1] // self.percent:
            tags.append(2 * i - 1)
        return [p for p in map(self.plan, tags) if p.k > 0]

    def of(self, features: np.ndarray) -> np.ndarray:
        """Signatures of one set.

        Partitions without a feature agree in many sets that share nothing. Where n1 exceeds k by more than the empty partitions of a set,
        another one agrees too, so the empty ones are left out; else they are kept.
        """
        found = []
        for p in self.tags(len(features)):
            seed = np.uint64(STEP * (p.tag + 1) & FULL)
            spread = mixed(features ^ seed)
            n = p.n1 * p.n2
            part = ((spread >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, part, mixed(spread + np.uint64(1)))
            counts = np.bincount(part, minlength=n)
            if p.k2:
                sums, counts = sums.reshape(p.n1, p.n2), counts.reshape(p.n1, p.n2)
                sums = np.stack([sums[:, s].sum(axis=1, dtype=np.uint64) for s in p.subsets], axis=1).ravel()
                counts = np.stack([counts[:, s].sum(axis=1) for s in p.subsets], axis=1).ravel()
            with np.errstate(over="ignore"):
                signed = mixed(sums ^ mixed(np.arange(len(sums), dtype=np.uint64) * MIX_B + seed))
            spare = 1 if p.k2 else p.n1 - p.k
            found.append(signed[counts > 0] if (counts == 0).sum() < spare else signed)
        return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64)


def bucket_counts(features: np.ndarray) -> bytes:
    """Features of a set in each hash bucket (255: that many or more): ``BUCKETS``, or for large sets a power of two of a quarter of the features or more.

    Buckets are leading bits of hashes, so neighbours add up to those of a shorter list.
    """
    bits = max(BUCKETS.bit_length() - 1, (max(len(features), 1) // 4).bit_length())
    counts = np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """Rows of bucket counts as rows of ``n``; a sum with a part that was cut is cut."""
    parts = counts.reshape(len(counts), n, -1)
    if parts.shape[2] == 1:
        return counts.astype(np.int16)
    return np.where((parts == 255).any(axis=2), 255, np.minimum(parts.sum(axis=2), 255)).astype(np.int16)


def bucket_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of features in which sets with these bucket counts differ; counts that were cut don't count."""
    return np.where((a < 255) & (b < 255), np.abs(a - b), 0).sum(axis=-1, dtype=np.int64)


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Bucket counts of every row, folded to ``BUCKETS``."""
    short = [x if len(x) == BUCKETS else folded(np.frombuffer(x, np.uint8)[None, :], BUCKETS).astype(np.uint8).tobytes() for x in rows]
    return np.frombuffer(b"".join(short), np.uint8).reshape(-1, BUCKETS).astype(np.int16)


def odd_counts(counts: np.ndarray) -> np.ndarray:
    """A bit a bucket of whether its count is odd; sets differ in a feature at least for each bucket in which these bits do."""
    return np.packbits((counts & 1).astype(bool), axis=1).view(np.uint64)


def finely_apart(a: list[bytes], b: list[bytes], apart: np.ndarray) -> np.ndarray:
    """``apart``, or the distance by the most buckets that both have, where both have more than ``BUCKETS``."""
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        n = min(len(x), len(y))
        if n > BUCKETS:
            x, y = (folded(np.frombuffer(z, np.uint8)[None, :], n) for z in (x, y))
            apart[i] = bucket_distance(x, y)[0]
    return apart


class Buckets:
    """Bound by sizes and bucket counts: sets that link differ in few features, so in few bucket counts."""

    def __init__(self, percent: int):
        self.percent = percent

    def most(self, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Most features in which sets of these sizes differ that link; -1 where sizes rule a link out."""
        total = size_a + size_b
        near = np.maximum(size_a, size_b) * self.percent <= np.minimum(size_a, size_b) * 100
        return np.where(near, total - 2 * -(-self.percent * total // (100 + self.percent)), -1)

    def aligned(self, a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = finely_apart(a, b, bucket_distance(unpacked(a), unpacked(b)))
        return apart, apart <= self.most(size_a, size_b)

    def crossed(self, a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odd counts are compared first, 64 buckets at a time, then sums of buckets where those leave many, then buckets of the pairs left."""
        most, counts_a, counts_b = self.most(size_a[:, None], size_b[None, :]), unpacked(a), unpacked(b)
        ok = asked & (most >= 0)
        if not (counts_a == 255).any() and not (counts_b == 255).any():  # a count that was cut may be odd or even
            apart = np.zeros(ok.shape, np.int64)
            for x, y in zip(odd_counts(counts_a).T, odd_counts(counts_b).T, strict=True):
                apart += np.bitwise_count(x[:, None] ^ y[None, :])
            ok &= apart <= most
        low_a, low_b = folded(counts_a, BUCKETS // COARSE), folded(counts_b, BUCKETS // COARSE)
        for i in range(0, len(a), 64):
            if ok[i : i + 64].mean() > 1 / 16:
                ok[i : i + 64] &= bucket_distance(low_a[i : i + 64, None, :], low_b[None, :, :]) <= most[i : i + 64]
        x, y = np.nonzero(ok)
        apart = np.concatenate([np.empty(0, np.int64), *[bucket_distance(counts_a[x[k : k + 4096]], counts_b[y[k : k + 4096]]) for k in range(0, len(x), 4096)]])
        left = apart <= most[x, y]
        x, y = x[left], y[left]
        apart = finely_apart([a[k] for k in x], [b[k] for k in y], apart[left])
        near = apart <= most[x, y]
        return x[near], y[near], apart[near]


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Sets of ``docs`` with bucket counts and PartEnum signatures, as ``clusters.signed_sets`` gives them."""
    signer = Signer(percent)
    return clusters.signed_sets(docs, words, lambda sets: ([bucket_counts(s) for s in sets], [signer.of(s) for s in sets]))


def open_pairs(rest: DataFrame, percent: int, block: int = 1024, nearest: bool = False) -> DataFrame:
    """``clusters.open_pairs`` of groups whose sketches are bucket counts."""
    return clusters.open_pairs(rest.withColumnRenamed("buckets", "sketch"), Buckets(percent), percent, block, nearest)


def jaccard_join(docs: DataFrame, *, words: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Components of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` % or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (how many other
    sets the document's set links with; copies count as one) and class_id (the smallest doc_id with the same set).

    Of the rows that share a signature, which may be any number, the smallest meets the others first; groups that then span several
    components are finished in blocks (``clusters.joined_rows``). No pair that can link is left out.

    Row numbers (8 bytes each) are broadcast up to ``broadcast_rows``; beyond it the same joins shuffle.

    Null, empty or white-space texts have no set: n_shingles 0, linked with nothing. Null ids: allowed, smallest last.
    Repeated rows link like copies. Empty table: empty result. Other columns are not read.
    """
    found = clusters.joined_rows(docs, shingle_sets(docs, words, percent), Buckets(percent), words=words, percent=percent, broadcast_rows=broadcast_rows)
    return found.select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


def keep_one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns, one of each component, as ``clusters.one_of_each`` chooses it. Rows without a set are like nothing."""
    own = docs.select("doc_id", "text")
    return clusters.one_of_each(docs, clusters.joined_rows(own, shingle_sets(own, words, percent), Buckets(percent), words=words, percent=percent, count_links=False))


JOIN_SQL = """
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), gram AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 4) - 1], ' '))) AS g
  FROM word WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared_grams AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared_grams JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
own AS (SELECT doc_id, md5(string_agg(g, chr(0) ORDER BY g)) AS own FROM gram GROUP BY doc_id),
class AS (SELECT own, min(doc_id) AS class_id FROM own GROUP BY own),
reach AS (SELECT a AS node, b AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, c.class_id, d.doc_id)) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN class c USING (own) LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

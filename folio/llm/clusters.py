"""Components of documents whose word n-gram sets are alike, from any signatures that such sets share.

Rows that share a signature meet by it. An operator says how sets are signed and gives a bound that rules pairs out by a sketch of each set;
what a bound leaves is compared on the full sets.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folio.llm.bpe import frugal, slices
from folio.llm.common import ASCII_SPACE, drop_stored, forget_shuffles, mb_of, parts_for, row_key, same_key, session_of, stored

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that a task turns into sets at a time.
SLICE = 4 << 20
#: Stored sets with signatures, in MB, that are dealt out at once.
ONE_PASS_MB = 32
#: Seconds after which shuffle files of a step are given up, where rows are dealt in several parts.
PAUSE = 0.5


class Bound(Protocol):
    """What two sets' sketches and sizes say about a link between them."""

    def aligned(self, a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each pair's sketches, and whether the pair may link."""

    def crossed(self, a: list[bytes], size_a: np.ndarray, b: list[bytes], size_b: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i of a, j of b) of those ``asked`` for that may link, and their distances."""


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams.

    A-Z fall to lower case; words end at ASCII white space; fewer words than n make one n-gram. Each distinct word of the texts is hashed
    once; n-grams are arrays over all words of all texts.
    """
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = parts.flatten().dictionary_encode()
    spelled = coded.dictionary.to_pylist()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))
    codes = np.asarray(coded.indices)
    filled = np.fromiter(map(bool, spelled), bool, len(spelled))[codes]
    ends = np.r_[0, np.cumsum(filled)][np.cumsum(np.r_[0, np.asarray(pc.list_value_length(parts))])]
    ids = of_word[codes[filled]]
    found = [np.empty(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        for size in range(1, n + 1):
            # windows of all texts at once where the size is n; shorter texts have one window each
            at = np.flatnonzero(np.diff(ends) >= n if size == n else np.diff(ends) == size)
            if not len(at):
                continue
            h = mixed(ids + np.uint64(size))
            for i in range(1, size):
                h = mixed(h[: len(ids) - i] * np.uint64(3) + ids[i:])
            for k in at:
                found[k] = np.unique(h[ends[k] : ends[k + 1] - size + 1])
    return found


SETS = "row long, doc_id long, k_a long, k_b long, n_shingles long, hash_a long, hash_b long, sketch binary, signatures array<long>"
ARROW_SETS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("k_a", pa.int64()), ("k_b", pa.int64()), ("n_shingles", pa.int64()), ("hash_a", pa.int64()), ("hash_b", pa.int64()),
     ("sketch", pa.binary()), ("signatures", pa.list_(pa.int64()))]
)


def signed_sets(docs: DataFrame, words: int, sign) -> DataFrame:
    """A row a document: its number, id and 128 bits of its text (``row_key``), its set's size, 128-bit digest, sketch and signatures.

    ``sign``: a function from a list of sets to a list of sketches and one of signatures (none of an empty set).
    """

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                found = shingles(texts, words)
                digests = [set_digest(s) for s in found]
                sketches, signatures = sign(found)
                arrays = [
                    pa.array(np.arange(row, row + len(found))), *part.columns[:-1], pa.array([len(s) for s in found], pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)),
                    pa.array(sketches, pa.binary()), pa.array(signatures, pa.list_(pa.int64())),
                ]
                row += len(found)
                yield pa.RecordBatch.from_arrays(arrays, schema=ARROW_SETS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key()[1:], "text").mapInArrow(frugal(run), SETS)


def compact(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows need at ``each`` rows a partition, if it has more: small tables don't make many small tasks."""
    return df.coalesce(1 + rows // each)


def shared_rows(signed: DataFrame, parts: int) -> DataFrame:
    """Rows (signature, row) of signatures that two rows or more have. Streams sorted rows; holds one at a time."""

    def run(batches):
        held: tuple[np.ndarray, np.ndarray] | None = None  # the last row, as its group may go on
        known = False  # that the last row's group has another row
        for batch in batches:
            if not batch.num_rows:
                continue
            s, r = (np.asarray(batch.column(i)) for i in (0, 1))
            if held:
                s, r = np.r_[held[0], s], np.r_[held[1], r]
            same = s[1:] == s[:-1]
            keep = np.r_[known, same[:-1]] | same if len(same) else np.empty(0, bool)
            known = bool(same[-1]) if len(same) else known
            held = s[-1:], r[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(s[:-1][keep]), pa.array(r[:-1][keep])], names=["signature", "row"])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["signature", "row"])

    ordered = signed.repartition(parts, "signature").sortWithinPartitions("signature", "row")
    return ordered.mapInArrow(run, "signature long, row long")


def in_passes(df: DataFrame, passes: int, step, label: str) -> list[DataFrame]:
    """Stored results of ``step`` on each of ``passes`` parts of df by signature. Shuffle files of a part go before the next is dealt, so a part sets how many lie on disk."""
    done = []
    for i in range(passes):
        part = df if passes == 1 else df.where(F.pmod(F.xxhash64("signature"), F.lit(passes)) == i)
        done.append(stored(step(part), label))
        forget_shuffles(session_of(df), PAUSE if passes > 1 else 0)
    return done


VERIFIED = "a long, b long, common long, n_a long, n_b long"


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mixed(s).sum(dtype=np.uint64)
        b = mixed(s * np.uint64(5) + np.uint64(7)).sum(dtype=np.uint64)
    return int(np.array(a).view(np.int64)), int(np.array(b).view(np.int64))


def features_of(docs: DataFrame, needed: DataFrame, words: int, small) -> DataFrame:
    """Sets (hash_a, hash_b, features) of the documents whose ids ``needed`` (needed_id, hash_a, hash_b, ...) has, with its columns where the digests agree.

    The ids filter the documents before anything moves; ``small`` marks what is broadcast.
    """

    def run_sets(batches):
        for batch in batches:
            for _, texts in slices(batch, "text", SLICE):
                own = shingles(texts, words)
                a, b = zip(*map(set_digest, own), strict=True)
                columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["hash_a", "hash_b", "features"])

    ids = small(needed.select("needed_id").distinct())
    texts = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("needed_id")), "left_semi").select("text")
    return texts.mapInArrow(frugal(run_sets), "hash_a long, hash_b long, features binary").join(small(needed), ["hash_a", "hash_b"])


def verified(pairs: DataFrame, n: int, docs: DataFrame, sets: DataFrame, words: int, block: int = 64, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Common features of ``n`` pairs (a, b, n_pairs of a), from the texts of the rows in them.

    Ids of the rows filter the documents before anything moves. While 4 n rows are ``broadcast_rows`` at most (64 MB), the pairs go to the
    texts' features, which move once; beyond it the same joins shuffle. Pairs of one ``a`` go in blocks: a task gets the features of a once a
    block and those of its partners once a pair, and holds two sets at a time, however many partners there are.
    """

    def compare(batches):
        a, held, last = None, None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x, y, features = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                if x == y:
                    a, held = x, np.frombuffer(features, np.uint64)
                    continue
                if x != a:
                    raise ValueError("a block without its first set")
                if (x, y) == last:  # a repeated row's
                    continue
                last = x, y
                own = np.frombuffer(features, np.uint64)
                at = np.searchsorted(held, own)
                at[at == len(held)] = 0
                out.append((x, y, int((held[at] == own).sum()), len(held), len(own)))
            if out:
                names = ["a", "b", "common", "n_a", "n_b"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    small = (lambda df: F.broadcast(df)) if 4 * n <= broadcast_rows else (lambda df: df)
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n_pairs") / block))))
    heads = pairs.select("a", "block").distinct().withColumn("b", F.col("a"))
    wanted = stored(compact(pairs.select("a", "block", "b").unionByName(heads), n, 250_000), "wanted")
    rows = wanted.select(F.col("b").alias("row")).distinct()
    needed = sets.select("row", F.col("doc_id").alias("needed_id"), "hash_a", "hash_b").join(small(rows), "row", "left_semi")
    needed = stored(compact(needed, n, 250_000), "needed")
    features = features_of(docs, needed, words, small)
    rows = features.join(small(wanted), F.col("b") == F.col("row")).select("a", "block", "b", "features")
    ordered = compact(rows.repartition(parts_for(docs, 64), "a", "block"), n, 4096)
    ordered = ordered.sortWithinPartitions("a", "block", F.when(F.col("a") == F.col("b"), 0).otherwise(1), "b")
    found = stored(ordered.select("a", "block", "b", "features").mapInArrow(frugal(compare), VERIFIED), "verified")
    drop_stored(wanted, needed)
    return found


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Smallest node reachable from each node of links (a, b), or of links and the ``known`` result over earlier links: (node, label).

    Links are read as links between known labels, so what earlier links settled isn't done again. Each round hooks every root that has a
    smaller neighbour to its smallest one, follows the hooks to their ends by doubling, and goes on
    with the links between the roots that are left, until there are none. Two rounds leave at most half of a component's roots, so there are
    at most about 2 log2(nodes) of them, whatever the order of the rows. Tables of a round are stored, and removed after it.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    between = links
    if known is not None:
        nodes = nodes.join(known.select("node"), "node", "left_anti").unionByName(known.select("node", "label"))
        for end in ("a", "b"):
            label = known.select(F.col("node").alias(end), F.col("label").alias("known_label"))
            between = between.join(label, end, "left").withColumn(end, F.coalesce("known_label", end)).drop("known_label")
    n = links.count() + (known.count() if known is not None else 0)
    kept = lambda df, label: stored(compact(df, n, 250_000), label)
    edges = kept(between.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = kept(nodes, "labels")
    while not edges.isEmpty():
        hooks = kept(edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("target"), F.lit(True).alias("moved")), "hooks")
        while not hooks.where("moved").isEmpty():
            ahead = hooks.select(F.col("root").alias("target"), F.col("target").alias("ahead"))
            new = kept(hooks.join(ahead, "target", "left").select("root", F.coalesce("ahead", "target").alias("target"), F.col("ahead").isNotNull().alias("moved")), "hooks")
            drop_stored(hooks)
            hooks = new
        at = lambda column: hooks.select(F.col("root").alias(column), F.col("target").alias(f"{column}_target"))  # noqa: B023, E731
        ends = edges.join(at("a"), "a", "left").join(at("b"), "b").select(F.coalesce("a_target", "a").alias("a"), F.col("b_target").alias("b"))
        left = kept(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        named = kept(labels.join(at("label"), "label", "left").select("node", F.coalesce("label_target", "label").alias("label")), "labels")
        drop_stored(hooks, edges, labels)
        edges, labels = left, named
    drop_stored(edges)
    return labels


def link_counts(labels: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int, broadcast_rows: int = 2_000_000, block: int = 512, block_features: int = 1 << 18) -> DataFrame:
    """Number of links of each row of a component: (row, n_links), of labels (node, label), by which each component is known.

    All links of a row are within its component. Two rows alone have one; of larger components all pairs of sets are compared in blocks of about ``block`` rows or
    ``block_features`` features, if they have more: a task compares two blocks at a time and gives a number a row, so neither memory nor rows follow the square of a
    component, except for the copies of its sets, divided by its blocks' size. Its time does.
    """

    def compare(u: list[tuple], v: list[tuple] | None):
        """Links of sets (row, features) of one block and another, or within one."""
        both = [sorted({r: np.frombuffer(x, np.uint64) for r, x in of}.items(), key=lambda s: len(s[1])) for of in ([u] if v is None else [u, v])]
        first, other = both[0], both[-1]
        sizes = np.array([len(x) for _, x in other])
        ends = np.r_[0, np.cumsum(sizes)]
        known, codes = np.unique(np.concatenate([x for _, x in other]), return_inverse=True)
        counts, of_other, marks = np.zeros(len(first), np.int64), np.zeros(len(other), np.int64), np.zeros(len(known), np.uint8)
        for i, (_, x) in enumerate(first):
            low, high = np.searchsorted(sizes, -(-percent * len(x) // 100)), np.searchsorted(sizes, 100 * len(x) // percent, side="right")
            low = max(low, i + 1) if v is None else low
            if low >= high:
                continue
            at = np.searchsorted(known, x)
            at[at == len(known)] = 0
            at = at[known[at] == x]
            marks[at] = 1
            common = np.add.reduceat(marks[codes[ends[low] : ends[high]]], ends[low:high] - ends[low], dtype=np.int64)
            marks[at] = 0
            links = common * 100 >= percent * (len(x) + sizes[low:high] - common)
            counts[i] += links.sum()
            of_other[low:high] += links
        told = [(first, counts + of_other)] if v is None else [(first, counts), (other, of_other)]
        for of, n in told:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in of], pa.int64()), pa.array(n)], names=["row", "n_links"])

    def closed(key: list, u: list[tuple], v: list[tuple]):
        if key[1] == key[2]:
            yield from compare(u, None)
        elif u and v:
            yield from compare(u, v)

    def run(batches):
        now, held = None, ([], [])
        for batch in batches:
            for *key, asks, row, features in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now:
                        yield from closed(now, *held)
                    now, held = key, ([], [])
                held[not asks].append((row, features))
        if now:
            yield from closed(now, *held)

    members = labels.select(F.col("node").alias("row"), "label").join(sets.select("row", "doc_id", "hash_a", "hash_b", "n_shingles"), "row")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / block_features)).cast("int").alias("blocks")
    found = stored(members.join(members.groupBy("label").agg(F.count("*").alias("n"), blocks), "label"), "members")
    large = found.where("n > 2")
    n = large.count()
    small = (lambda df: F.broadcast(df)) if 4 * n <= broadcast_rows else (lambda df: df)
    needed = stored(compact(large.select("row", F.col("doc_id").alias("needed_id"), "hash_a", "hash_b", "label", "blocks"), n, 250_000), "needed")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    met = features_of(docs, needed, words, small).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("asks"), "row", "features")
    dealt = dealt.repartition(parts_for(docs, 64), "label", "x", "y").sortWithinPartitions("label", "x", "y")
    counted = stored(dealt.mapInArrow(frugal(run), "row long, n_links long"), "links")
    done = stored(found.where("n = 2").select("row", F.lit(1).cast("long").alias("n_links")).union(counted.groupBy("row").agg(F.sum("n_links").alias("n_links"))), "degrees")
    drop_stored(found, needed, counted)
    return done


NEAR = "a long, b long, apart long"


def may_link(pairs: DataFrame, bound: Bound) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b, size_a, size_b) that the bound doesn't rule out, with their distance."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                size_a, size_b = (np.asarray(part.column(c)) for c in (4, 5))
                apart, keep = bound.aligned(part.column(2).to_pylist(), size_a, part.column(3).to_pylist(), size_b)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(apart)], names=["a", "b", "apart"]).filter(pa.array(keep))

    return pairs.select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b").mapInArrow(frugal(run), NEAR)


def open_pairs(rest: DataFrame, bound: Bound, percent: int, block: int = 1024, nearest: bool = False, parts: int | None = None) -> DataFrame:
    """Pairs of members of a group with different labels that may link, one of them outside the group's largest component.

    rest: signature, row, label, most, like, sketch, size. Members outside the largest component meet all members in blocks of ``block``: a task
    compares two blocks at a time by array operations and gives only the pairs that the bounds leave, so neither memory nor rows follow the
    group's size squared. ``nearest``: of the pairs of an asking member and a block, only the one with the least distance.
    """
    limit = (100 - percent) / 100 + 1e-9

    def compare(key, asked, members):
        for i in range(0, len(asked[0]), 256):
            u = [x[i : i + 256] for x in asked]
            ok = u[1][:, None] != members[1][None, :]
            # of two members outside the largest component, the smaller one asks
            ok &= (members[1] == members[5])[None, :] | (u[0][:, None] < members[0][None, :])
            ok &= ~(np.abs(u[2][:, None] - members[2][None, :]) > limit)  # unknown distances are nan, and stay
            x, y, apart = bound.crossed(u[3], u[4], members[3], members[4], ok)
            if nearest:
                order = np.lexsort((members[0][y], apart, x))
                first = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
                x, y, apart = x[first], y[first], apart[first]
            low, high = np.minimum(u[0][x], members[0][y]), np.maximum(u[0][x], members[0][y])
            if len(low):
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(apart)], names=["a", "b", "apart"])

    def run(batches):
        now, held = None, []

        def closed():
            table = pa.Table.from_batches(held).combine_chunks()
            role, col = np.asarray(table["asks"]), lambda c: np.asarray(table[c].combine_chunks())
            sketches = np.empty(len(role), object)
            sketches[:] = table["sketch"].to_pylist()
            arrays = [col("row"), col("label"), col("like").astype(np.float64), sketches, col("size"), col("most")]
            yield from compare(now, [a[role] for a in arrays], [a[~role] for a in arrays])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                key = tuple(keys[:, low])
                if key != now:
                    if held:
                        yield from closed()
                    now, held = key, []
                held.append(batch.slice(low, high - low))
        if held:
            yield from closed()

    asks = F.col("label") != F.col("most")
    sums = rest.groupBy("signature").agg(F.ceil(F.count("*") / block).alias("n_all"), F.ceil(F.count_if(asks) / block).alias("n_asks"))
    joined = rest.join(sums, "signature")
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    columns = ["row", "label", "most", "like", "sketch", "size"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    askers = joined.where(asks).select("signature", own("n_asks").alias("x"), every("n_all").alias("y"), F.lit(True).alias("asks"), *columns)
    members = joined.select("signature", every("n_asks").alias("x"), own("n_all").alias("y"), F.lit(False).alias("asks"), *columns)
    dealt = askers.unionByName(members).repartition(parts or parts_for(rest, 16), "signature", "x", "y").sortWithinPartitions("signature", "x", "y")
    return dealt.mapInArrow(frugal(run), NEAR).groupBy("a", "b").agg(F.min("apart").alias("apart"))


def joined_rows(docs: DataFrame, sets: DataFrame, bound: Bound, *, words: int, percent: int, broadcast_rows: int = 2_000_000, at_once: int = 100_000, passes: int | None = None, count_links: bool = True) -> DataFrame:
    """Documents (doc_id, n_shingles, component_id, n_links, class_id) with their keys (doc_id, k_a, k_b) and ``kept``, the least key of the component (no_id, k_id, k_a, k_b; null: nothing is like the row).

    sets: ``signed_sets`` of docs. Sets link when their Jaccard similarity is ``percent`` % or more.

    1. Equal sets meet by digest; one of each class goes on.
    2. Rows that share a signature meet by it; of each group, the smallest row meets the others. A pair is compared exactly unless the
       bound rules a link out or its rows are in one component already; where there are more than ``at_once`` pairs, each row's nearest one comes first.
    3. Groups that then still span several components are finished: each member outside the group's largest component
       meets its nearest member with another label, then all such members, unless the bound or the distances to the group's first row
       (Jaccard distance is a metric) rule the link out. No pair that can link is left out, whatever the group's size.
    4. ``n_links`` is the number of other sets that a document's set links with: the pairs that steps 2 and 3 passed over, as they change no component, are compared
       too (``link_counts``). Without ``count_links``, for those who only want components, there is no such column.

    Steps 2 and 3 deal their rows in ``passes`` parts by signature (by default two, one where signatures have ``ONE_PASS_MB`` at most), as signatures and sketches are wider than the texts.
    """
    spark = session_of(docs)
    wide = stored(sets, "wide")
    sets = stored(wide.drop("signatures"), "sets")
    filled = sets.where("n_shingles > 0")
    key = ["hash_a", "hash_b", "n_shingles"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("k_id"), "k_a", "k_b")).alias("least")
    classes = stored(filled.groupBy(*key).agg(F.min("row").alias("first_row"), F.min("doc_id").alias("class_id"), least, F.count("*").alias("n")), "classes")
    copies = stored(filled.join(classes.where("n > 1"), key).where("row <> first_row").select("row"), "copies")
    # signatures are wide: while the rows to leave out are few, they go to the signatures and not the other way round
    single = wide.where(F.size("signatures") > 0).join(F.broadcast(copies) if copies.count() <= broadcast_rows else copies, "row", "left_anti")
    passes = passes or (2 if mb_of(wide) > ONE_PASS_MB else 1)
    forget = lambda: forget_shuffles(spark, PAUSE if passes > 1 else 0)
    forget()  # those of the steps so far, and of whatever ran before
    each = in_passes(single.select(F.explode("signatures").alias("signature"), "row"), passes, lambda part: shared_rows(part, parts_for(docs, 64)), "signed")
    signed = reduce(DataFrame.union, each)
    drop_stored(wide, copies)
    # versions of one text share many signatures: of groups with the same members, one goes on
    members = [F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"), F.count("*").alias("n"), F.min("row").alias("first")]
    groups = signed.groupBy("signature").agg(*members).groupBy("x", "y", "n", "first").agg(F.min("signature").alias("signature"))
    shared = stored(signed.join(groups.select("signature", "first"), "signature"), "shared")
    drop_stored(*each)

    forget()

    sizes = sets.select("row", "n_shingles", "sketch")
    starred = shared.where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct()
    left = sizes.select(F.col("row").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("size_a"))
    right = sizes.select(F.col("row").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("size_b"))

    def checked(near: DataFrame, n: int) -> DataFrame:
        counted = near.select("a", "b").join(near.groupBy("a").agg(F.count("*").alias("n_pairs")), "a")
        return verified(counted, n, docs, sets, words, broadcast_rows=broadcast_rows)

    def settled(near: DataFrame, found: list[DataFrame], labels: DataFrame | None) -> DataFrame | None:
        """Labels after the pairs of ``near``, which join ``found``: first each row's nearest pair, then pairs that are still in different components."""
        near = stored(near, "near")
        n = near.count()
        if not n:
            return labels
        first = near
        if n > at_once:
            ends = near.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("end"))
            first = stored(ends.groupBy("end").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "nearest")
        found.append(checked(first, n))
        labels = components(found[-1].where(is_link).select("a", "b"), labels)
        if first is not near:
            other = near.join(first, ["a", "b"], "left_anti")
            for end in ("a", "b"):
                label = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
                other = other.join(label, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
            other = stored(other.where("label_a <> label_b").select("a", "b"), "apart")
            if n := other.count():
                found.append(checked(other, n))
                labels = components(found[-1].where(is_link).select("a", "b"), labels)
            drop_stored(first, other)
        drop_stored(near)
        return labels

    is_link = F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    found: list[DataFrame] = []
    labels = settled(may_link(starred.join(right, "b").join(left, "a"), bound), found, None)
    no_labels = spark.createDataFrame([], "node long, label long")
    no_pairs = spark.createDataFrame([], VERIFIED)

    def left_open(labels: DataFrame, known: DataFrame) -> DataFrame:
        """Members, but the first, of groups that span several components."""
        named = shared.join(labels, F.col("row") == F.col("node"), "left").select("signature", "first", "row", F.coalesce("label", "row").alias("label"))
        per_label = named.groupBy("signature", "label").agg(F.count("*").alias("n"))
        per_group = per_label.groupBy("signature").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).getField("label").alias("most"))
        like = (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("like")
        rest = named.join(per_group.where("labels > 1"), "signature").where("row <> first")
        rest = rest.join(known.select(F.col("a").alias("first"), F.col("b").alias("row"), like), ["first", "row"], "left")
        return stored(rest.select("signature", "row", "label", "most", "like"), "open")

    # first each member's nearest one, which joins most of what can be joined; then every pair that is left
    for nearest in (True, False):
        forget()
        rest = left_open(no_labels if labels is None else labels, reduce(DataFrame.union, found, no_pairs))
        if rest.isEmpty():
            break
        # a row is in many groups: its sketch joins it on the way to them, and is stored once
        sketches = sizes.select("row", "sketch", F.col("n_shingles").alias("size"))
        each = in_passes(rest, passes, lambda part: open_pairs(part.join(sketches, "row"), bound, percent, nearest=nearest, parts=parts_for(rest, 2)), "pairs")  # noqa: B023
        labels = settled(reduce(DataFrame.union, each).groupBy("a", "b").agg(F.min("apart").alias("apart")), found, labels)
        drop_stored(rest, *each)
    forget()  # the rows that come back are joined with whole texts, next to which nothing else should lie
    labels = no_labels if labels is None else labels
    linked = classes.join(labels, F.col("first_row") == F.col("node")).select(*key, "label", "class_id", "first_row", "least")
    lowest = linked.groupBy("label").agg(F.min("class_id").alias("component_id"), F.min("least").alias("kept"))
    of_class = linked.join(lowest, "label")
    if count_links:
        of_class = of_class.join(link_counts(labels, docs, sets, words, percent, broadcast_rows), F.col("first_row") == F.col("row"), "left")
        forget()
    n_links = ["n_links"] if count_links else []
    of_class = of_class.select(*key, "component_id", "kept", *n_links)
    many = classes.where("n > 1").select(*key, "class_id", "least")
    known = many.join(of_class, key, "full")
    out = sets.select("doc_id", "k_a", "k_b", *key).join(known, key, "left")
    class_id = F.coalesce("class_id", "doc_id")
    own = [F.col("doc_id"), F.col("k_a"), F.col("k_b"), F.col("n_shingles"), F.coalesce("component_id", class_id).alias("component_id")]
    return out.select(*own, *[F.coalesce(c, F.lit(0)).alias(c) for c in n_links], class_id.alias("class_id"), F.coalesce("kept", "least").alias("kept"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs, all columns, one of each component of ``found`` (of ``joined_rows``): that with the smallest id (null last), of these with the smallest hash of its text.

    Rows are told apart by id and text, so ids may be null or repeated. Rows that agree in both are copies: the least by its columns stays.
    Rows without a set are like nothing; only those that agree in all columns become one.
    """
    of_row = [F.col("doc_id").alias("k_id"), F.col("k_a"), F.col("k_b")]
    least = F.col("kept.k_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.k_a") == F.col("k_a")) & (F.col("kept.k_b") == F.col("k_b"))
    gone = found.where(F.col("kept").isNotNull() & ~least).select(*of_row).distinct()
    row = docs.select(F.struct("*").alias("whole"), *row_key())
    row = row.withColumn("once", F.struct("k_id", "k_a", "k_b"))
    repeated = row.groupBy("once").agg(F.count("*").alias("rows")).where("rows > 1").select("once")
    left = row.alias("l").join(gone.alias("g"), same_key("l", "g"), "left_anti")
    same = lambda other: left.alias("l").join(other.alias("r"), same_key("l", "r.once"), "left_semi")
    single = left.alias("l").join(repeated.alias("r"), same_key("l", "r.once"), "left_anti")
    wordless = F.translate(F.coalesce("whole.text", F.lit("")), ASCII_SPACE, "") == ""
    again = same(repeated).groupBy("once", F.when(wordless, F.col("whole")).alias("itself")).agg(F.min("whole").alias("whole"))
    return single.select("whole.*").union(again.select("whole.*"))

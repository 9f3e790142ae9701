"""Operator 11: the prefix trie of conversations.

Turns are coded by a dictionary of distinct (role, text); conversations become rows of codes, which are dealt out by ranges of their order. Each range
is a ternary search tree: a node's children form a binary search tree by code, balanced as paths are inserted medians first. One pass over a
tree adds up members, leaves and savings. Only nodes on a range's first or last path can go on in another range; those are merged after.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.bpe import frugal
from folio.llm.common import bounded, drop_stored, parts_for, stored

NO_ENDS = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """A trie whose siblings form binary search trees. Node 0 is the root; a parent's number is less than its children's."""

    def __init__(self):
        self.code, self.length, self.parent = [0], [0], [-1]
        self.low, self.equal, self.high = [-1], [-1], [-1]

    def _new(self, code: int, length: int, parent: int) -> int:
        for column, value in ((self.code, code), (self.length, length), (self.parent, parent), (self.low, -1), (self.equal, -1), (self.high, -1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], lengths: list[int]) -> list[int]:
        """Nodes of a path from the root, made where they are missing."""
        path = [0]
        for code, length in zip(codes, lengths, strict=True):
            top = path[-1]
            side, node = self.equal, top
            at = side[node]
            while at >= 0 and self.code[at] != code:
                side, node = (self.low if code < self.code[at] else self.high), at
                at = side[node]
            if at < 0:
                at = self._new(code, length, top)
                side[node] = at
            path.append(at)
        return path


def medians_first(n: int):
    """Numbers below n, the middle of each range before its halves."""
    ranges = [(0, n)]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


NODES = (
    "shared boolean, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, length long, ends string"
)
ARROW_NODES = pa.schema([
    ("shared", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("length", pa.int64()), ("ends", pa.string()),
])


def shard_nodes(paths: list[tuple[list[int], list[int], int, int, str]]) -> dict[str, list]:
    """Columns of ``NODES`` of one range of paths (codes, lengths, members, least member, digest of the members), which are distinct and sorted.

    ``shared`` nodes, on the first or last path, count what lies below nodes of their own only; the others are done, but for the parent's conv_id
    where ``parent_key`` names a shared parent.
    """
    tree = TernaryTree()
    ways: list[list[int]] = [[]] * len(paths)
    for i in medians_first(len(paths)):
        ways[i] = tree.insert(*paths[i][:2])
    n = len(tree.code)
    members, least, ends = [0] * n, [None] * n, [None] * n
    for way, (_, _, count, conv, digest) in zip(ways, paths, strict=True):
        members[way[-1]], least[way[-1]], ends[way[-1]] = count, conv, digest
    keys: dict[int, bytes] = {}
    for way in {0: ways[0], 1: ways[-1]}.values():
        state = hashlib.blake2b(digest_size=16)
        for depth, node in enumerate(way):
            if depth:
                state.update(tree.code[node].to_bytes(8, "little"))
            keys[node] = state.copy().digest()
    children, leaves, saved, depths = [0] * n, [0] * n, [0] * n, [0] * n
    for node in range(1, n):
        depths[node] = depths[tree.parent[node]] + 1
    for node in range(n - 1, -1, -1):  # every node after all below it
        top = tree.parent[node]
        if node not in keys:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * tree.length[node]
            children[top] += 1
            leaves[top] += leaves[node]
            saved[top] += saved[node]
        if top >= 0:
            members[top] += members[node]
            least[top] = least[node] if least[top] is None else min(least[top], least[node])
    return {
        "shared": [node in keys for node in range(n)],
        "key": [keys.get(node) for node in range(n)],
        "parent_key": [keys.get(top) for top in tree.parent],
        "depth": depths, "conv_id": least, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved": saved, "length": tree.length, "ends": ends,
        "parent_conv_id": [None if top < 0 or top in keys else least[top] for top in tree.parent],
    }


def range_tries(classes: DataFrame, parts: int) -> DataFrame:
    """Nodes of the trie of each range of classes (codes, lengths, n, conv_id, ends)."""

    def run(batches):
        paths = []
        for batch in batches:
            paths += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        if paths:
            found = shard_nodes(paths)
            whole = pa.Table.from_arrays([pa.array(found[f.name], f.type) for f in ARROW_NODES], schema=ARROW_NODES)
            yield from whole.to_batches(max_chunksize=1 << 16)

    ranged = classes.repartitionByRange(parts, "codes").sortWithinPartitions("codes")
    return ranged.select("codes", "lengths", "n", "conv_id", "ends").mapInArrow(frugal(run), NODES)


def end_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each class (k_a, k_b, conv_id), in order and comma-joined; a class is streamed, whatever its size."""

    def run(batches):
        now, state = None, None
        for batch in batches:
            a, b, ids = (np.asarray(batch.column(i)) for i in range(3))
            if not len(a):
                continue
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1), len(a)]
            done = []
            for low, high in zip(cuts, cuts[1:]):
                key = int(a[low]), int(b[low])
                if key != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids[low:high].tolist())).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["k_a", "k_b", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["k_a", "k_b", "ends"])

    ordered = members.select("k_a", "k_b", "conv_id").repartition("k_a", "k_b").sortWithinPartitions("k_a", "k_b", "conv_id")
    return ordered.mapInArrow(run, "k_a long, k_b long, ends string")


def coded_turns(conversations: DataFrame, often: int = 1000) -> DataFrame:
    """conv_id, pos (from 0), code of (role, text), code points of the text.

    Values that make up a share of 1 / ``often`` of all turns or more, which are ``often`` at most, are looked up by a broadcast join; the others by a shuffle.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    value = [F.xxhash64("role", "text").alias("k_a"), F.xxhash64(F.lit("second"), "role", "text").alias("k_b")]
    turns = stored(own.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), *value, F.length("text").cast("long").alias("length")), "turns")
    codes = turns.groupBy("k_a", "k_b").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    codes = stored(codes.withColumn("code", F.monotonically_increasing_id()), "codes")
    hot = F.broadcast(codes.where(F.col("n") * often >= turns.count()).drop("n", "length"))
    rare = turns.join(hot.drop("code"), ["k_a", "k_b"], "left_anti").join(codes.select("k_a", "k_b", "code"), ["k_a", "k_b"])
    return turns.join(hot, ["k_a", "k_b"]).unionByName(rare).select("conv_id", "pos", "code", "length")


def rebuilt(turns: DataFrame, *, every: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, codes, lengths: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % heads."""
    in_order = lambda: F.sort_array(F.collect_list(F.struct("pos", "code", "length")))
    own = turns.groupBy("conv_id").agg(in_order().alias("own"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(in_order().alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every}).join(first, "base", "left")
    head = F.coalesce("head", F.array().cast("array<struct<pos:int,code:bigint,length:bigint>>"))
    path = F.concat(F.slice(head, 1, F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select("conv_id", path.alias("path")).select("conv_id", F.col("path.code").alias("codes"), F.col("path.length").alias("lengths"))


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes that ranges share, each once, with what lies below them in all ranges.

    A node's partial sums are added up; then each adds those of the shared nodes below it, by doubling: after k rounds it has what lies
    less than 2^k levels below, so rounds follow the logarithm of the depth.
    """
    parts = nodes.where("shared").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("length").alias("length"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    one = stored(parts, "shared")
    below = one.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    n_children = F.col("n_children") + F.coalesce("more", F.lit(0))
    own = one.join(below, "key", "left").withColumns({
        "n_children": n_children, "n_leaves": F.when(n_children == 0, 1).otherwise(F.col("n_leaves")), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("length"),
    })
    up = one.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    now = stored(own.drop("more").join(up, "parent_key", "left").withColumn("above", F.col("parent_key")), "shared")
    for _ in range(int(now.agg(F.max("depth")).first()[0] or 0).bit_length()):
        sums = now.groupBy(F.col("above").alias("key")).agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
        far = now.select(F.col("key").alias("above"), F.col("above").alias("further"))
        new = now.join(sums, "key", "left").join(far, "above", "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("leaves_below", F.lit(0)), "saved": F.col("saved") + F.coalesce("saved_below", F.lit(0)), "above": F.col("further"),
        })
        new = stored(new.select(*now.columns), "shared")
        drop_stored(now)
        now = new
    drop_stored(one)
    return now


def prefix_trie(conversations: DataFrame, *, every: int = 100, heads: int = 6, broadcast_rows: int = 1_000_000) -> DataFrame:
    """A row a node of the trie of rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first), then role, then text; null role and text are empty, which are turns too. A conversation c is rebuilt from the
    first h turns of c - c % ``every`` and its own after its first h, h = crc32(c) % ``heads``; % takes the sign of c. A node is a distinct sequence of first turns;
    its members start with it. n_leaves and saved_tokens, (members - 1) times the code points of a node's last text, add up over its subtree.

    A range's paths are held by one task, as 16 bytes a turn and its tree; so are the turns of one conversation, which ``conversations`` bounds. Equal conversations are one path,
    whose ids are streamed. Shared nodes are two paths a range at most; they are broadcast up to ``broadcast_rows``, else joined by a shuffle.

    Rows without conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Long texts count whole. Empty table: no
    rows, not even a root. Other columns are not read.
    """
    paths = stored(rebuilt(coded_turns(conversations), every=every, heads=heads), "paths")
    named = paths.select("*", F.xxhash64("codes").alias("k_a"), F.xxhash64(F.lit("second"), "codes").alias("k_b"))
    same = named.groupBy("k_a", "k_b").agg(F.first("codes").alias("codes"), F.first("lengths").alias("lengths"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    classes = stored(same.join(end_digests(named), ["k_a", "k_b"]), "classes")
    nodes = stored(range_tries(classes, parts_for(classes, 32)), "nodes")
    drop_stored(paths, classes)
    tops = merged(nodes)
    top = bounded(tops.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("top_conv_id")), broadcast_rows)
    own = nodes.where("not shared").join(top, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id"))

    def result(df: DataFrame) -> DataFrame:
        saved: Column = F.col("saved").alias("saved_tokens")
        return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))

    return result(own).unionByName(result(tops))


TRIE_SQL = """
WITH turn AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, conv_id::VARCHAR AS name, list({'k': md5(length(role) || ':' || role || text), 'n': length(text)} ORDER BY pos) AS own FROM turn GROUP BY conv_id
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), head AS (
  SELECT conv_id, own, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM conv, crc
), path AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS p FROM head c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100
), step AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS depth FROM path),
member AS (
  SELECT conv_id, depth, len(p) = depth AS last, coalesce(p[depth].n, 0) AS n, md5(array_to_string(list_transform(p[1:depth], lambda x: x.k), ',')) AS node,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(p[1:depth - 1], lambda x: x.k), ',')) END AS parent FROM step
), node AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM member GROUP BY node
), child AS (SELECT parent AS node, count(*) AS n_children FROM node GROUP BY parent),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (node)),
above AS (SELECT DISTINCT a.node AS top, b.node FROM member a JOIN member b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
below AS (SELECT top, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above JOIN own USING (node) GROUP BY top)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN below b ON b.top = o.node LEFT JOIN own p ON p.node = o.parent
"""

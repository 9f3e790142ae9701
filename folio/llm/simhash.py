"""Operator 9: SimHash fingerprints and permuted block tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.common import lower_ascii, parts_for, row_key, same_key, stored

LANES = 0x100000001
KEY = ["k_id", "k_a", "k_b"]


def fingerprints(rows: DataFrame, keys: list[str], text: str, words: int = 5) -> DataFrame:
    """keys and ``fp`` (64 bits as long), the SimHash of ``text`` over its word n-grams.

    Each occurrence of an n-gram votes with the length of its first word (1 to 8) on each bit of its hash. A sum counts two
    bits at once, in halves of a long: 32 sums do for 64 bits, in one pass of generated code. A bit is set by more than
    half the weight. Texts without a word give 0; fewer words than ``words`` are one term.
    """
    split = F.split(lower_ascii(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\v\f\r"))), r"[\x20\x09-\x0D]+")
    base = rows.select(*keys, split.alias("s_words"))
    each = base.select(*keys, "s_words", F.posexplode("s_words").alias("s_at", "s_word"))
    each = each.where(F.col("s_at") <= F.greatest(F.size("s_words") - words, F.lit(0)))
    term = F.xxhash64("s_word", *[F.get("s_words", F.col("s_at") + i) for i in range(1, words)])
    weight = F.least(F.length("s_word"), F.lit(8)).cast("long")
    each = each.select(*keys, term.alias("s_hash"), weight.alias("s_weight"))
    lane = lambda i: F.sum(F.col("s_weight") * F.shiftright("s_hash", i).bitwiseAND(F.lit(LANES)))
    voted = each.groupBy(*keys).agg(F.sum("s_weight").alias("s_all"), *[lane(i).alias(f"s_{i}") for i in range(32)])
    half = F.lit(0xFFFFFFFF)
    bits = [
        F.when(2 * part > F.col("s_all"), F.lit(1 << (i + up) if i + up < 63 else -(1 << 63))).otherwise(F.lit(0))
        for i in range(32)
        for up, part in ((0, F.col(f"s_{i}").bitwiseAND(half)), (32, F.shiftrightunsigned(f"s_{i}", 32)))
    ]
    return voted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of bits that two fingerprints have in common."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / 64.0


def neighbours(prints: DataFrame, radius: int = 3, blocks: int | None = None, part_rows: int = 1024) -> DataFrame:
    """All pairs of distinct fingerprints of ``prints`` (fp) within the Hamming radius: a < b, distance.

    The bits fall into ``blocks`` blocks; fingerprints within the radius agree on all but ``radius`` of them. There is a table for each
    way to choose the blocks that agree, in which fingerprints meet by those blocks; a pair counts in the first table that shows it.
    Keys that more than ``part_rows`` fingerprints share (versions of one text) are split by hash into parts of about that many: a part is
    held by a task of its own, to which the fingerprints of the parts up to it come, so every pair still meets once.
    Equal fingerprints are one. Null ones have no neighbour.
    """
    n = blocks or radius + 3
    edges = [64 * i // n for i in range(n + 1)]
    tables = list(combinations(range(n), n - radius))
    mask = lambda t: sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in t)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks = [signed(mask(t)) for t in tables]
    one = stored(prints.where("fp is not null").select("fp").distinct(), "prints")
    keyed = one.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    hot = stored(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > part_rows), "hot-keys")
    parts = F.coalesce(F.ceil(F.col("n") / part_rows), F.lit(1))
    dealt = keyed.join(hot, ["table", "key"], "left").select("table", "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).alias("part"))
    a = dealt.select("table", "key", F.col("fp").alias("a"), F.col("part").alias("a_part"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    b = dealt.select("table", "key", F.col("fp").alias("b"), "part")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    agree = [F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(m)) == 0 for m in masks]
    first = reduce(lambda rest, i: F.when(agree[i], i).otherwise(rest), reversed(range(len(masks))), F.lit(None))
    once = (F.col("a_part") < F.col("part")) | (F.col("a") < F.col("b"))
    met = a.join(b, ["table", "key", "part"]).where(once & (apart <= radius) & (F.col("table") == first))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), apart.alias("distance"))


def in_order(docs: DataFrame) -> DataFrame:
    """Distinct row keys in ascending order of doc_id (then of the text's hash): the key, c_chars, p_* (key of the row before), p_chars, n_* (key of the row after).

    The last is followed by the first. Keys alone are dealt by range; the ends of the ranges, a row each, are joined on.
    """
    parts = parts_for(docs)
    keys = docs.select(*row_key(), F.length(F.coalesce("text", F.lit(""))).alias("c_chars")).distinct()
    dealt = stored(keys.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "order")
    me = F.struct(*KEY, "c_chars")
    ends = dealt.groupBy("part").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    by = Window.orderBy("part")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lag("high").over(by), F.last("high").over(whole)).alias("end_before"),
        F.coalesce(F.lead("low").over(by), F.first("low").over(whole)).alias("end_after"),
    )
    own = Window.partitionBy("part").orderBy(*KEY)
    found = dealt.select("part", *KEY, "c_chars", F.lag(me).over(own).alias("before"), F.lead(me).over(own).alias("after"))
    found = found.join(F.broadcast(ends), "part")  # a row for each range
    before, after = F.coalesce("before", "end_before"), F.coalesce("after", "end_after")
    return found.select(
        *KEY, "c_chars", *[before[k].alias(f"p_{k}") for k in KEY], before["c_chars"].alias("p_chars"), *[after[k].alias(f"n_{k}") for k in KEY]
    )


def on_key(left: str, right: str, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{prefix}{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in KEY])


def fingerprint_report(docs: DataFrame, *, words: int = 5, radius: int = 3) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. Order comes from keys
    alone; then each text gives its own first half to itself and as much of its beginning as is asked for to the document before it, so what
    moves is the texts once and halves of them once more. ``n_near`` counts other distinct fingerprints within ``radius``.

    Null text: empty, fingerprint 0. Rows that agree in id and text are one in the order and all get its result. Null ids come first. A single
    document is its own next one. Empty table: empty result. Other columns are not read.
    """
    order = stored(in_order(docs), "neighbours")
    rows = docs.select(F.col("doc_id").alias("s_id"), *row_key(), F.coalesce("text", F.lit("")).alias("text"))
    own = stored(fingerprints(rows, KEY, "text", words), "fingerprints")

    moved = rows.alias("r").join(order.alias("o"), same_key("r", "o")).select(
        F.explode(
            F.array(
                F.struct(*[F.col(f"o.{k}").alias(k) for k in KEY], F.lit(0).alias("side"), F.expr("left(text, c_chars - c_chars div 2)").alias("part")),
                F.struct(*[F.col(f"o.p_{k}").alias(k) for k in KEY], F.lit(1).alias("side"), F.expr("left(text, cast(p_chars div 2 as int))").alias("part")),
            )
        ).alias("x")
    ).select("x.*")
    edited = moved.groupBy(*KEY).agg(
        F.concat(F.coalesce(F.max(F.when(F.col("side") == 0, F.col("part"))), F.lit("")), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("part"))), F.lit(""))).alias("edited")
    ).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    other = stored(fingerprints(edited, [*KEY, "edited_sha256"], "edited", words).withColumnRenamed("fp", "edited_fp"), "edited")

    pairs = neighbours(own.select("fp"), radius)
    near = pairs.select(F.explode(F.array("a", "b")).alias("near_fp")).groupBy("near_fp").agg(F.count("*").alias("n_near"))
    following = own.select(*KEY, F.col("fp").alias("next_fp"))
    known = (
        order.alias("o")
        .join(own.alias("f"), on_key("o", "f"))
        .join(other.alias("e"), on_key("o", "e"))
        .join(following.alias("x"), on_key("o", "x", "n_"))
        .join(near, F.col("f.fp") == F.col("near_fp"), "left")
        .select(*[f"o.{k}" for k in KEY], "c_chars", "fp", "edited_fp", "edited_sha256", "next_fp", "n_near")
    )
    ids = rows.select("s_id", *KEY)
    return ids.alias("r").join(known.alias("o"), same_key("r", "o")).select(
        F.col("s_id").alias("doc_id"), F.col("c_chars").cast("long").alias("n_chars"), "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )

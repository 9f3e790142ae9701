"""Operator 4: secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.common import stored

#: The kinds and their patterns.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "live", "copied")

SPAN = pa.struct([("at", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
CANDIDATE = pa.struct([("at", pa.int64()), ("end", pa.int64()), ("digest", pa.string()), ("strong", pa.bool_())])
FOUND = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()),
        ("base", pa.list_(SPAN)), ("candidates", pa.list_(CANDIDATE)), ("base_sha256", pa.string()),
    ]
)
FOUND_SQL = (
    "row long, doc_id long, repo string, owner string, base array<struct<at long, kind int, end long>>,"
    " candidates array<struct<at long, end long, digest string, strong boolean>>, base_sha256 string"
)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, kind, end) in order, and the (start, end) of the values in them, each once."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            spans.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            spans.append((m.start(), 1, m.end()))
            values.append(m.span())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.append(m.span())
    return sorted(spans), sorted(set(values))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan_secrets(
    docs: DataFrame, *, repo: str = "source", owner: str | None = None, widely: int = 3, min_entropy: float = 2.5
) -> DataFrame:
    """Secrets of every whole text, and which of them are copied widely or belong to one owner.

    Base spans come from three patterns. Each value in them is hashed; hashes count by distinct ``repo`` and distinct
    ``owner`` (``repo`` where no such column is named) over the whole corpus. A value in ``widely`` repositories or more
    adds a ``copied`` span; one that a single owner has, of ``min_entropy`` bits a character or more, adds a ``live``
    span. Only hashes move, and they are pre-aggregated before each shuffle; secrets themselves never do.

    Null or empty text: no spans. Null repo or owner counts as one value of its own. Repeated rows give repeated rows;
    an empty table an empty result. Columns other than doc_id, text, repo and owner are not read. Offsets are
    code points, ends exclusive. Spans that start together follow the order of ``KINDS``, then their ends.
    """

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                spans, values = base_spans(text := batch.column(1)[i].as_py() or "")
                said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                found = [
                    {"at": a, "end": b, "digest": hashlib.sha256(text[a:b].encode()).hexdigest(), "strong": entropy(text[a:b]) >= min_entropy}
                    for a, b in values
                ]
                out.append(
                    {
                        "row": row, "doc_id": batch.column(0)[i].as_py(), "repo": batch.column(2)[i].as_py(), "owner": batch.column(3)[i].as_py(),
                        "base": [{"at": a, "kind": k, "end": b} for a, k, b in spans], "candidates": found,
                        "base_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    }
                )
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    columns = [F.col("doc_id").cast("long"), "text", F.col(repo).cast("string").alias("repo"), F.col(owner or repo).cast("string").alias("owner")]
    found = stored(docs.select(*columns).mapInArrow(run, FOUND_SQL), "secrets")
    each = found.select("row", "repo", "owner", F.explode("candidates").alias("c")).select("row", "repo", "owner", "c.*")
    own = each.groupBy("digest", "repo", "owner").agg(F.max("strong").alias("strong"))
    # structs, as count(distinct) leaves nulls out
    owned = own.groupBy("digest").agg(
        F.count_distinct(F.struct("repo")).alias("n_repos"), F.count_distinct(F.struct("owner")).alias("n_owners"), F.max("strong").alias("strong")
    )
    kind = F.when(F.col("n_repos") >= widely, 4).when((F.col("n_owners") == 1) & F.col("strong"), 3)
    labels = stored(owned.withColumn("kind", kind.cast("int")).where("kind is not null").select("digest", "kind"), "owners")
    added = (
        each.select("row", "digest", "at", "end").join(labels, "digest")
        .groupBy("row").agg(F.collect_list(F.struct("at", "kind", "end")).alias("added"))
    )
    names = F.array(*map(F.lit, KINDS))
    no_spans = F.array().cast("array<struct<at:bigint,kind:int,end:bigint>>")
    spans = F.array_sort(F.concat("base", F.coalesce("added", no_spans)))
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"], s["end"])))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return (
        found.join(added, "row", "left")
        .withColumn("spans", spans)
        .select(
            "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
            text.alias("spans"), count(3).alias("n_live"), count(4).alias("n_copied"),
        )
    )

"""Streaming jobs: progress, library state, usage and replay."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.library import LibraryState, string_of


def in_order(batches: Iterator[pd.DataFrame], by: str = "seq", run_rows: int = 200_000) -> Iterator:
    """Rows of a group's chunks in order: runs of about ``run_rows`` are sorted as they come and merged at the end.

    A task holds a group's events of one micro-batch, which the source's rate limit bounds; nothing goes to files of its machine.
    """
    held, rows, runs = [], 0, []
    for batch in batches:
        if len(batch):
            held.append(batch)
            rows += len(batch)
        if rows >= run_rows:
            runs.append(pd.concat(held).sort_values(by, kind="stable"))
            held, rows = [], 0
    if held:
        runs.append(pd.concat(held).sort_values(by, kind="stable"))
    yield from heapq.merge(*(run.itertuples() for run in runs), key=attrgetter(by))


def progress_state(events: DataFrame) -> DataFrame:
    """ST1 on a batch: current status, stage and reason of each operation (operation, seq, attempt, status, stage, reason); a status of null opens the attempt.

    Events of an attempt that a newer one has replaced don't count.
    """
    newest = events.where("status is null").groupBy("operation").agg(F.max_by("attempt", "seq").alias("current"))
    live = events.join(newest, "operation").where(F.col("attempt") == F.col("current"))
    said = F.when(F.col("status").isNotNull(), F.struct("status", "stage", "reason")).otherwise(
        F.struct(F.lit("queued").alias("status"), F.lit("accepted").alias("stage"), F.lit(None).cast("string").alias("reason"))
    )
    return live.groupBy("operation").agg(F.max_by("attempt", "seq").alias("attempt"), F.max_by(said, "seq").alias("s")).select("operation", "attempt", "s.*")


PROGRESS = "operation string, attempt string, status string, stage string, reason string"
#: Statuses after which an attempt says nothing more (fixed values).
TERMINAL = ("ready", "failed", "unsupported", "interrupted")


def progress_stream(events: DataFrame, at: str | None = None, keep_ms: int = 86_400_000) -> DataFrame:
    """ST1 on a stream: the same in update mode, in whatever order events come.

    State of an operation: its newest opening and the newest status of each attempt that has said something since, at the most. A status may come
    before the opening of its attempt, so those of other attempts are kept until an opening is newer.

    Without ``at`` state is kept for good. ``at`` names a time column of events that has a watermark: once that is ``keep_ms`` past the last event
    of an operation whose current attempt has ended (``TERMINAL``), or that no opening has reached, its state is dropped, and no row comes of it. A later
    opening begins anew; a later status waits for one. Events behind the watermark don't count, those without a time do.
    """
    columns = ["operation", "seq", "attempt", "status", "stage", "reason"]
    timed = events.select(*columns, at, F.unix_millis(at).alias("at_ms")) if at else events.select(*columns)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempt, since, kept = state.get if state.exists else (None, None, "[]")
        said = {own: tuple(rest) for own, *rest in json.loads(kept)}
        last = state.getCurrentWatermarkMs() if at else 0
        for batch in batches:
            if at and batch["at_ms"].notna().any():
                last = max(last, int(batch["at_ms"].max()))
            batch = batch.sort_values("seq")
            opens = batch["status"].isna()
            if opens.any():
                newest = batch[opens].iloc[-1]
                if since is None or newest["seq"] > since:
                    attempt, since = string_of(newest["attempt"]), int(newest["seq"])
            for e in batch[~opens].drop_duplicates("attempt", keep="last").itertuples():
                own, seq = string_of(e.attempt), int(e.seq)
                if own is not None and (own not in said or seq > said[own][0]):
                    said[own] = seq, string_of(e.status), string_of(e.stage), string_of(e.reason)
            said = {own: s for own, s in said.items() if since is None or s[0] > since}
        state.update((attempt, since, json.dumps([[own, *s] for own, s in said.items()])))
        _, status, stage, reason = said.get(attempt, (None, "queued", "accepted", None))
        if at and (attempt is None or status in TERMINAL):
            state.setTimeoutTimestamp(last + max(1, keep_ms))
        if attempt is not None:
            yield pd.DataFrame({"operation": [key[0]], "attempt": [attempt], "status": [status], "stage": [stage], "reason": [reason]})

    timeout = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    return timed.groupBy("operation").applyInPandasWithState(step, PROGRESS, "attempt string, since long, said string", "update", timeout)


OUTCOME = "document_id string, seq long, outcome string, revision int"


def library_stream(events: DataFrame) -> DataFrame:
    """ST2: outcomes of library events on a stream, by the rules of ``activate``; state is a document's revision, latest operation and attempt.

    A document's events of a micro-batch are put in order first, however Spark cuts them into chunks; micro-batches count as they come. State is
    the library's own table, a row a document; a retired one stays in it, as it goes on refusing operations.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, rows, columns = LibraryState(*state.get) if state.exists else LibraryState(), [], ["document_id", "seq", "outcome", "revision"]
        for e in in_order(batches):
            rows.append((key[0], int(e.seq), own.after(e), int(own.revision)))
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        state.update(own.kept())
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    kept = "revision int, retired boolean, operation string, expected int, attempt string"
    return events.groupBy("document_id").applyInPandasWithState(step, OUTCOME, kept, "append", GroupStateTimeout.NoTimeout)


def usage_stream(calls: DataFrame, most_calls: int) -> DataFrame:
    """ST3: running usage of each run (run_id, tokens, elapsed_ms) and whether its calls are over the budget; the same on batch and stream."""
    sums = calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("elapsed_ms"), 2).alias("elapsed_ms"))
    return sums.withColumn("breached", F.col("calls") > most_calls)


def breaches_to(path: str) -> Callable[[DataFrame, int], None]:
    """ST3: a ``foreachBatch`` function that writes runs over budget, a folder a batch, so a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("breached").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def replay(events: DataFrame, offset: int, run_id=None) -> DataFrame:
    """ST4: saved chunks (run_id, seq, ...) after an offset; on a batch, in order."""
    after = events.where(F.col("seq") > offset)
    after = after.where(F.col("run_id") == run_id) if run_id is not None else after
    return after if after.isStreaming else after.orderBy("run_id", "seq")

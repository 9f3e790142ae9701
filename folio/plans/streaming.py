"""Queries of the streaming jobs: each runs its stream over the stored events to the end, and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.plans.derived import BASE, TEMPLATES, cte, derive
from folio.plans.librarian import ACTIVATE
from folio.plans.registry import query
from folio.sources.scratch import scratch
from folio.streaming import streams


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table of events as a stream of the events' files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream reads a folder: the table may be one file or a folder of its own
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    stream.createOrReplaceTempView("folio_event_stream")
    return spark.sql(TEMPLATES[name].format_map({b: b for b in BASE} | {"events": "folio_event_stream"}))


def finished(df: DataFrame, mode: str, each) -> None:
    """Run a stream over all there is; ``each`` gets every batch."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", scratch(df.sparkSession, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def appended(path: str):
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def last_of(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Of the rows of update batches, those of the last batch of each key."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


PROGRESS = f"""WITH {cte('progress')}, opened AS (SELECT operation, arg_max(attempt, seq) AS attempt FROM progress WHERE status IS NULL GROUP BY operation),
live AS (SELECT p.*, max(CASE WHEN p.status IS NULL THEN p.seq END) OVER (PARTITION BY p.operation) AS since FROM progress p JOIN opened o ON o.operation = p.operation AND o.attempt = p.attempt),
last AS (SELECT operation, attempt, arg_max(struct_pack(s := coalesce(status, 'queued'), g := CASE WHEN status IS NULL THEN 'accepted' ELSE stage END, r := CASE WHEN status IS NOT NULL THEN reason END), seq) AS v FROM live WHERE seq >= since GROUP BY operation, attempt)
SELECT operation, attempt, v.s AS status, v.g AS stage, v.r AS reason FROM last"""


@query("ST1_progress_stream", PROGRESS)
def st1(spark, sf_dir):
    path = scratch(spark, "progress")
    finished(streams.progress_stream(streamed(spark, sf_dir, "progress")), "update", appended(path))
    return last_of(spark, path, streams.PROGRESS, ["operation"])


@query("ST1_progress_batch", PROGRESS)
def st1b(spark, sf_dir):
    return streams.progress_state(derive(spark, sf_dir, "progress"))


@query("ST2_library_stream", ACTIVATE)
def st2(spark, sf_dir):
    path = scratch(spark, "library")
    finished(streams.library_stream(streamed(spark, sf_dir, "library_events")), "append", appended(path))
    return spark.read.schema(streams.OUTCOME).parquet(path).select("document_id", "seq", "outcome", "revision")


USAGE = f"WITH {cte('calls')} SELECT run_id, count(*) AS calls, sum(k) AS tokens, round(sum(elapsed_ms), 2) AS elapsed_ms, count(*) > 60 AS breached FROM calls GROUP BY run_id"


@query("ST3_usage_stream", USAGE)
def st3(spark, sf_dir):
    path = scratch(spark, "usage")
    calls = streamed(spark, sf_dir, "calls").withColumnRenamed("k", "tokens")
    finished(streams.usage_stream(calls, 60), "update", appended(path))
    return last_of(spark, path, "run_id long, calls long, tokens long, elapsed_ms double, breached boolean", ["run_id"])


@query("ST3_usage_batch", USAGE)
def st3b(spark, sf_dir):
    return streams.usage_stream(derive(spark, sf_dir, "calls").withColumnRenamed("k", "tokens"), 60)


@query("ST4_replay", f"WITH {cte('calls')} SELECT run_id, seq, lane FROM calls WHERE run_id = 7 AND seq > 500")
def st4(spark, sf_dir):
    return streams.replay(derive(spark, sf_dir, "calls").select("run_id", "seq", "lane"), 500, 7)

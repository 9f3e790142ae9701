"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\v\f\r"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share: the cluster's checkpoint folder, or the warehouse where none is named.

    It goes when the session's Python ends, or with ``clear``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/folio-{spark.sparkContext.applicationId}"
    if path not in _AT_END:
        _AT_END.add(path)
        atexit.register(lambda: spark.sparkContext._jsc and _delete(spark, path))
    return path


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application stored; results that weren't written yet can't be read any more."""
    _delete(spark, shared_dir(spark))


_AT_END: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, batch_mb: int = 4) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, outlives executors.

    While it is written, batches that go to Python hold ``batch_mb`` MB, or as much as the session says if that is less, so that rows with
    wide arrays don't fill an executor's memory. The session's setting is put back after.
    """
    spark = session_of(df)
    path = new_path(spark, label)
    before = spark.conf.get(BATCH_BYTES)
    if _bytes_of(before) > batch_mb << 20:
        spark.conf.set(BATCH_BYTES, f"{batch_mb}m")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes_of(size: str) -> int:
    """A size of Spark's settings in bytes; one without a bound is large."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] if int(number) > 0 else 1 << 60


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        _delete(session_of(df), df.stored_at)


def forget_shuffles(spark: SparkSession, pause: float = 0) -> None:
    """Have the driver's JVM collect its garbage, upon which Spark removes shuffle files that nothing reads any more: those of tables that are stored by now.

    The query that ended last is held until Spark's listeners have heard of its end, a moment later. With ``pause`` (seconds), its files go too:
    garbage is collected twice, each time after that pause.
    """
    for _ in range(2 if pause else 1):
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def mb_of(df: DataFrame) -> int:
    """MB of a table's files; 0 where Spark doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size >> 20 if size < 1 << 57 else 0


def parts_for(df: DataFrame, mb: int = 256, least_mb: int = 0) -> int:
    """Partitions for a shuffle of a table's rows: the session's number, or more, so that one holds about ``mb`` MB of its files (where Spark knows their size).

    With ``least_mb``, fewer than the session's number where one would hold less than that.
    """
    known = mb_of(df)
    usual = int(session_of(df).conf.get("spark.sql.shuffle.partitions"))
    if least_mb and known:
        usual = min(usual, max(1, known // least_mb))
    return max(usual, known // mb)


def bounded(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """A side of a join, marked for broadcast if it has ``broadcast_rows`` rows at most; else the join shuffles."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the built-in fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Key of a row: id and 128 bits of the text. Rows that agree in both are repeats of one row."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [
        F.col(doc_id).alias("k_id"),
        F.xxhash64(value).alias("k_a"),
        F.xxhash64(F.lit("second"), value).alias("k_b"),
    ]


def same_key(left: str, right: str) -> Column:
    """Join condition over the columns of ``row_key`` that lets a null id meet a null id."""
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("k_id", "k_a", "k_b")]
    return pairs[0] & pairs[1] & pairs[2]

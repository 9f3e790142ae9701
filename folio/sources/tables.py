"""Sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folio.sources.scratch import stored

LARGEST_ORIGINAL = 50 * 1024 * 1024
#: Bytes of a file that Spark reads as one value, and of one that a task digests at a time.
WHOLE_BYTES, PART_BYTES = 64 << 20, 512 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_originals(spark: SparkSession, path: str, pattern: str | None = None, whole: int = WHOLE_BYTES, part: int = PART_BYTES) -> DataFrame:
    """Original files with digest and size; ``accepted`` is the size rule (1 byte to 50 MiB).

    Files over ``whole`` bytes in a file system that is mounted (file:) are digested in rounds of ``part`` bytes, so that no task reads more of them;
    others are read whole by one task.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    files = reader.load(path)
    over, mounted = F.col("length") > whole, F.col("path").startswith("file:/")
    largest, others = files.where(over).agg(F.max(F.when(mounted, F.col("length"))), F.count_if(~mounted)).first()
    in_one = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    digests = in_one(files.where(~over))  # a rule on length alone keeps Spark from reading longer files
    if others:
        digests = digests.union(in_one(files.where(over & ~mounted)))
    if largest:
        digests = digests.union(digested_in_rounds(files.where(over & mounted).select("path", "length"), -(-largest // part), part))
    return digests.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("byte_length"), "sha256", F.col("length").between(1, LARGEST_ORIGINAL).alias("accepted"),
    )


def digested_in_rounds(files: DataFrame, rounds: int, part: int) -> DataFrame:
    """Digests (path, length, sha256) of files (path, length). A round's tasks each take one file ``part`` bytes on, from the digest's state that the round before stored.

    The state is that of the OpenSSL library which Python's own hashlib uses; a Python without it digests a file in one task, as a stream.
    """

    def run(batches):
        import ctypes
        import hashlib

        import pyarrow as pa

        try:
            import _hashlib

            lib = ctypes.CDLL(_hashlib.__file__)
            begin, update, final = lib.SHA256_Init, lib.SHA256_Update, lib.SHA256_Final
            update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
        except (ImportError, OSError, AttributeError):
            begin = None
        for batch in batches:
            out = []
            for path, length, at, state, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = None if begin else hashlib.sha256()
                held = ctypes.create_string_buffer(state or 112, 112)  # SHA256_CTX: 28 words of 4 bytes
                if begin and not state:
                    begin(held)
                end = min(length, at + part) if begin else length
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
                    f.seek(at)
                    while at < end:
                        data = f.read(min(8 << 20, end - at))
                        if not data:
                            raise EOFError(f"{path} became shorter")
                        update(held, data, len(data)) if begin else own.update(data)
                        at += len(data)
                if at == length and digest is None:
                    if begin:
                        final(found := ctypes.create_string_buffer(32), held)
                    digest = found.raw.hex() if begin else own.hexdigest()
                out.append((path, length, at, held.raw, digest))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "length", "at", "state", "digest"])

    kind = "path string, length long, at long, state binary, digest string"
    states = stored(files.select("path", "length", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("digest")), "digests")
    done = []
    for _ in range(rounds):
        # dealt in turn from one partition of narrow rows: a file a task
        each = states.where("digest IS NULL").coalesce(1).repartition(max(1, states.where("digest IS NULL").count()))
        states = stored(each.mapInArrow(run, kind), "digests")
        done.append(states.where("digest IS NOT NULL"))
    return reduce(DataFrame.union, done).select("path", "length", F.col("digest").alias("sha256"))


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file of either side with a status: duplicate, missing, unlisted, changed or ok."""
    listed = manifest.groupBy("file").agg(F.count("*").alias("n"), F.min("sha256").alias("expected"))
    there = files.groupBy("file").agg(F.min("sha256").alias("actual"))
    status = (
        F.when(F.col("n") > 1, "duplicate").when(F.col("actual").isNull(), "missing").when(F.col("n").isNull(), "unlisted")
        .when(F.col("actual") != F.col("expected"), "changed").otherwise("ok")
    )
    return listed.join(there, "file", "full").select("file", status.alias("status"))


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def lines_from_text(documents: DataFrame, per_page: int = 5) -> DataFrame:
    """Lines of a text corpus with page, place and a geometry: short lines are taller, as titles are.

    Null texts have no lines. Work is per row; nothing moves.
    """
    each = documents.select("doc_id", F.posexplode(nonblank_lines(F.col("text"))).alias("n", "text"))
    length = F.length("text")
    return each.select(
        "doc_id", (F.floor(F.col("n") / per_page) + 1).cast("int").alias("page"), (F.col("n") % per_page).cast("int").alias("ord"), "text",
        F.lit(50.0).alias("x"), (36.0 + 176.0 * (F.col("n") % per_page)).alias("y"), F.least(length * 5.0, F.lit(512.0)).alias("width"),
        F.when(length < 20, 20.0).when(length < 40, 14.0).otherwise(11.0).alias("height"), F.lit("serif").alias("font"), F.lit(False).alias("margin"),
    )


def items_from_text(documents: DataFrame) -> DataFrame:
    """Words as positioned items: pages of ten rows, the first row across the page, the others in two columns of four words."""
    word = documents.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")).alias("i", "text"))
    row = (F.floor(F.col("i") / 8) % 10).cast("int")
    place = F.col("i") % 8
    x = F.when(row == 0, 50.0 + place * 62.0).otherwise(F.when(place < 4, 50.0).otherwise(330.0) + (place % 4) * 60.0)
    # neighbours on a line differ a little in height on the page
    y = 30.0 + row * 70.0 + (F.col("i") % 3) * 0.5
    return word.select(
        "doc_id", (F.floor(F.col("i") / 80) + 1).cast("int").alias("page"), F.col("i").cast("int").alias("seq"), "text", F.lit("serif").alias("font"),
        x.alias("x"), y.alias("y"), F.least(F.length("text") * 5.0, F.lit(52.0)).alias("width"), F.when(row == 0, 16.0).otherwise(11.0).alias("height"),
        F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


def parts_of(*inputs: DataFrame, mb: float = 8) -> int | None:
    """Partitions in which one holds about ``mb`` MB of the inputs, by Spark's estimate; None where that is no more than the session's number, or unknown."""
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in inputs)
    n = int(size / (mb * 2**20)) if size < 1 << 57 else 0
    return n if n > int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by its keys in so many partitions (of ``parts_of``), so that what a task sorts or gathers next doesn't grow with the input; as it is for None."""
    return df.repartition(parts, *keys) if parts else df


def by_document(documents: DataFrame, mb: float = 1) -> DataFrame:
    """documents dealt by id in partitions of about ``mb`` MB by Spark's estimate, so that rows made of a document are together, and sorting them takes little memory.

    Text moves once as it is, which is a small part of what its words take as rows.
    """
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return documents.repartition(max(1, -(-size // int(mb * 2**20))), "doc_id") if size < 1 << 57 else documents.repartition("doc_id")


def page_texts(lines: DataFrame) -> DataFrame:
    """Text of each page in reading order, and the same without margins."""
    line = F.struct("ord", "text", "margin")
    texts = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), "\n")
    return lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(line)).alias("rows")).select(
        "doc_id", "page", texts("rows").alias("text"), texts(F.filter("rows", lambda x: ~x["margin"])).alias("navigation_text")
    )


def _whole_versions(pages: DataFrame) -> DataFrame:
    """Versions (doc_id) with ``ok``: their pages are numbered 1..n."""
    return pages.groupBy("doc_id").agg(
        ((F.min("page") == 1) & (F.max("page") == F.count("*")) & (F.count_distinct("page") == F.count("*"))).alias("ok")
    )


def write_pages(pages: DataFrame, path: str, stored: DataFrame | None = None) -> DataFrame:
    """S3: append the pages of versions (doc_id) that number them 1..n and are not stored yet to a folder; returns those refused.

    Pages lie in ``bucket`` folders by hash of the version. See ``store_pages`` for a table that is read without moving its pages.
    """
    ok = _whole_versions(pages)
    good = pages.join(ok.where("ok").select("doc_id"), "doc_id", "left_semi")
    if stored is not None:
        good = good.join(stored.select("doc_id").distinct(), "doc_id", "left_anti")
    good.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)
    return ok.where("not ok").select("doc_id")


def store_pages(pages: DataFrame, table: str, path: str, bucket_mb: int = 128) -> DataFrame:
    """S3: append the pages of versions (doc_id) that number them 1..n and are not stored yet to a table; returns those refused.

    The table is bucketed by version and sorted by page, in as many buckets as hold about ``bucket_mb`` MB of the first pages that are written. A reader
    of one version opens one bucket, and joins and sums by version move no pages.
    """
    spark = pages.sparkSession
    known = spark.catalog.tableExists(table)
    if known:
        buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Num Buckets"))
    else:
        size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = max(1, min(100_000, (size if size < 1 << 57 else 0) // (bucket_mb << 20)))
    ok = _whole_versions(pages)
    good = pages.join(ok.where("ok").select("doc_id"), "doc_id", "left_semi")
    if known:
        good = good.join(spark.table(table).select("doc_id").distinct(), "doc_id", "left_anti")
    # a task has one bucket's pages, so a write adds a file a bucket
    good.repartition(buckets, "doc_id").write.mode("append").bucketBy(buckets, "doc_id").sortBy("doc_id", "page").option("path", path).saveAsTable(table)
    return ok.where("not ok").select("doc_id")


def load_pages(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """Pages of versions (doc_id, page_count) whose stored count is the version's, each version's in order.

    Only pages of the versions asked for are counted. Over the table of ``store_pages`` the stored pages stay in their buckets; the versions move to them.
    """
    asked = versions.select("doc_id", "page_count").distinct()
    count = stored.select("doc_id").join(asked.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    whole = asked.join(count, "doc_id").where("n = page_count").select("doc_id")
    return stored.join(whole, "doc_id", "left_semi").sortWithinPartitions("doc_id", "page")


def load_version(stored: DataFrame, doc_id) -> DataFrame:
    """Pages of one version in order; its bucket is the only one that is opened."""
    return stored.where(F.col("doc_id") == F.lit(doc_id)).sortWithinPartitions("page")


REPORT = (
    "imports array<struct<mode string, file string, sha256 string, status string, reason string, elapsedMs double,"
    " usage struct<modelCalls long, inputTokens long, outputTokens long>>>,"
    " questions array<struct<mode string, id string, status string, elapsedMs double, reason string, why string, result struct<status string, reason string>>>,"
    " failures array<string>"
)


def read_reports(spark: SparkSession, paths: list[str], part: str = "imports") -> DataFrame:
    """Imports, questions or failures (``part``) of evaluation reports, a row each, with the report's place in the list of paths.

    Each path, a file or a folder, is read apart, so names may repeat in different folders and hold any character.
    """
    each = [spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.lit(i).alias("report"), F.explode(part).alias("x")) for i, path in enumerate(paths)]
    return reduce(DataFrame.unionByName, each).select("report", "x" if part == "failures" else "x.*")


def write_report(df: DataFrame, path: str) -> None:
    """Metrics as JSON; an existing output is never overwritten."""
    df.write.mode("errorifexists").json(path)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")

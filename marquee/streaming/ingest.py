"""Incremental ingest with Structured Streaming.

Every micro-batch writes its own ``batch_id=N`` folder and overwrites it when a
batch is retried, so delivery is effectively once.  State is kept as a base
snapshot plus small deltas: a batch never rewrites the whole table; readers
merge base and deltas, and ``compact`` folds the deltas into a new base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.interactions import accepted, dedupe_last, interaction_upsert, validate_interactions

Extract = Callable[[DataFrame], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _exists(spark, path) else None


def _write(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_interactions(stream: DataFrame, items: DataFrame, folder: str, checkpoint: str, *,
                        available_now: bool = True) -> StreamingQuery:
    """Validate raw behaviour events; accepted and rejected rows become deltas."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = validate_interactions(batch, items).persist()
        _write(accepted(checked), f"{folder}/accepted", batch_id)
        _write(checked.filter(F.col("reject_reason").isNotNull()), f"{folder}/rejected", batch_id)
        checked.unpersist()

    return _start(stream, handle, checkpoint, available_now)


def current_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot of the latest base and all deltas after it, in order of arrival: micro-batch, then ``event_id``."""
    deltas = spark.read.parquet(f"{folder}/accepted")
    base = _latest_base(spark, folder)
    if base is None:
        return interaction_upsert(deltas.limit(0), deltas, arrival="batch_id").drop("is_new")
    upto, rows = base
    return interaction_upsert(rows, deltas.filter(F.col("batch_id") > upto), arrival="batch_id").drop("is_new")


def _latest_base(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    rows = _read(spark, f"{folder}/base")
    if rows is None:
        return None
    upto = rows.agg(F.max("upto")).first()[0]
    return upto, rows.filter(F.col("upto") == upto).drop("upto")


def compact(spark: SparkSession, folder: str) -> int:
    """Fold all deltas into a new base folder; older bases stay until removed by the operator."""
    upto = spark.read.parquet(f"{folder}/accepted").agg(F.max("batch_id")).first()[0]
    current_interactions(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    return upto


def ingest_experiences(stream: DataFrame, folder: str, checkpoint: str, *, threshold: int = 100,
                       on_batch: Callable[[DataFrame, int], None] | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """Experience pool with a count trigger.

    After each micro-batch, if at least ``threshold`` rows are pending, all of
    them form one training batch: it is handed to ``on_batch`` and recorded in
    ``fired``.  Pending rows are those of the micro-batches after the last
    fired one, found by partition pruning.  A run that dies between ``on_batch``
    and the record calls it again with the same ``batch_id`` and rows: that id is
    the key by which a handler recognises what it has done.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write(batch, f"{folder}/pool", batch_id)
        fired = _read(spark, f"{folder}/fired")
        last = -1
        if fired is not None:
            last = fired.filter(F.col("batch_id") < batch_id).agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
        pending = spark.read.parquet(f"{folder}/pool").filter(
            (F.col("batch_id") > last) & (F.col("batch_id") <= batch_id))
        size = pending.count()
        if size < threshold:
            return
        if on_batch is not None:
            on_batch(pending, batch_id)
        _write(spark.range(1).select(F.lit(size).alias("size"), F.lit(last).cast("int").alias("after")), f"{folder}/fired", batch_id)

    return _start(stream, handle, checkpoint, available_now)


def processed_experiences(spark: SparkSession, folder: str) -> DataFrame:
    """Pool rows with the training batch they went into (null while pending)."""
    pool = spark.read.parquet(f"{folder}/pool")
    fired = _read(spark, f"{folder}/fired")
    if fired is None:
        return pool.withColumn("fired_in", F.lit(None).cast("int"))
    spans = fired.select(F.explode(F.sequence(F.col("after") + 1, F.col("batch_id").cast("int"))).alias("batch_id"),
                         F.col("batch_id").cast("int").alias("fired_in"))
    return pool.join(spans, "batch_id", "left")


def exposure_stream(stream: DataFrame) -> DataFrame:
    """Running behaviour count per item (update or complete output mode)."""
    return stream.groupBy("item_id").agg(F.count(F.lit(1)).alias("exposure"))


def ingest_pages(stream: DataFrame, extract: Extract, folder: str, checkpoint: str, *, job: str = "pages",
                 available_now: bool = True) -> StreamingQuery:
    """Resumable page ingest: each batch of pages is extracted to a delta, with one status row per batch.

    The checkpoint remembers finished files, so a restart adds nothing twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        _write(extract(batch), f"{folder}/records", batch_id)
        done = batch.sparkSession.read.parquet(f"{folder}/records/batch_id={batch_id}")
        status = done.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(job).alias("job"), F.lit("completed").alias("status"), "records")
        _write(status, f"{folder}/status", batch_id)

    return _start(stream, handle, checkpoint, available_now)


def current_records(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Extracted records of all batches, the newest batch winning per key."""
    rows = spark.read.parquet(f"{folder}/records")
    return dedupe_last(rows, keys, seq="batch_id").drop("batch_id")


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    """Latest state per job: batches done and records written."""
    return spark.read.parquet(f"{folder}/status").groupBy("job").agg(
        F.max("status").alias("status"), F.count(F.lit(1)).alias("batches"), F.sum("records").alias("records"))

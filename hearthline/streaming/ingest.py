"""Incremental ingest of record files, with keep-first deduplication and running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline.operators.cleaning import keep_first
from hearthline.operators.logs import open_failures, with_failure_id
from hearthline.operators.ranking import null_safe_join
from hearthline.session import scratch_path
from hearthline.sources.jsonl import parsed_lines, record_columns


#: Folders that the state of an incremental table is dealt over; a batch reads the ones its keys fall into.
BUCKETS = 64
#: Batches between snapshots of the open failures.
SNAPSHOT_EVERY = 8


def line_stream(spark: SparkSession, folder: str, ddl: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON-lines files of a folder as a stream of parsed lines (value, file_path, record, bad); blank lines drop out."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(folder).select(F.col("value"), F.col("_metadata.file_path").alias("file_path"))
    return parsed_lines(lines.filter(F.trim("value") != ""), ddl)


def record_stream(spark: SparkSession, folder: str, ddl: str, files_per_batch: int | None = None) -> DataFrame:
    """The records of the stream, whichever of their columns are null; see ``land_records`` for what to do with bad lines."""
    lines = line_stream(spark, folder, ddl, files_per_batch)
    return lines.filter(~F.col("bad")).select(*record_columns(lines))


def land_records(lines: DataFrame, target: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Lands the records of a ``line_stream`` and, beside them, the lines that are not records. A batch that runs again
    replaces its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.filter(~F.col("bad")).select(*record_columns(batch)).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        batch.filter("bad").select("file_path", "value").write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends everything available now; the file sink's own log makes a restart add nothing."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _location(spark: SparkSession, path: str):
    """A path and its file system, which may be any that Spark reads."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_if_present(spark: SparkSession, path: str, schema) -> DataFrame:
    location, system = _location(spark, path)
    return spark.read.schema(schema).parquet(path) if system.exists(location) else spark.createDataFrame([], schema)


def _whole_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the subfolders name=number that a writer has finished, in order."""
    location, system = _location(spark, path)
    if not system.exists(location):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(location) if entry.isDirectory()]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{name}=")]
    return sorted(k for k in numbers if system.exists(_location(spark, f"{path}/{name}={k}/_SUCCESS")[0]))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _touched(batch: DataFrame) -> list[int]:
    """The buckets of a batch, at most BUCKETS numbers; as literals they prune the folders that are read."""
    return [row["bucket"] for row in batch.select("bucket").distinct().collect()]


def land_first_seen(stream: DataFrame, target: str, checkpoint: str, key: str, time: str = "extracted_at") -> StreamingQuery:
    """Keep-first for ever: each batch writes only keys the target lacks; a null key is a key like any other.

    The target is the state, so memory does not grow with history, and a batch reads only the buckets of its own keys.
    Batches go to folders named by batch id, and a batch that runs again replaces its own folder and is compared with the
    other batches only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = keep_first(batch, key, time).withColumn("bucket", _bucket(key)).persist()
        kind = batch.schema[key].dataType.simpleString()
        earlier = _read_if_present(spark, target, f"{key} {kind}, batch_id bigint, bucket int").filter(F.col("batch_id") < batch_id)
        earlier = earlier.filter(F.col("bucket").isin(_touched(first))).select(key).distinct().withColumn("_seen", F.lit(True))
        fresh = null_safe_join(first, earlier, [key], "left").filter(F.col("_seen").isNull()).drop("_seen")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch_id={batch_id}")
        first.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicate_within(stream: DataFrame, key: str, time: str, horizon: str = "7 days") -> DataFrame:
    """Keep-first with bounded state, for users who accept a horizon."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def fold_failures(stream: DataFrame, log_target: str, open_target: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Lands failure and retry events and refreshes the table of open failures.

    Each batch only touches the failure ids it mentions: their history is read, folded, and written as a delta. Every
    ``snapshot_every`` batches the deltas since the last snapshot are folded into a new one, which holds open failures only;
    deltas that the snapshot before covers, and snapshots before that, are removed. So readers (see
    ``current_open_failures``) scan one snapshot and a few deltas, however many batches there were.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = with_failure_id(batch).withColumn("bucket", _bucket("failure_id")).persist()
        known.write.mode("overwrite").partitionBy("bucket").parquet(f"{log_target}/batch_id={batch_id}")
        log = spark.read.schema(f"{known.schema.simpleString()[7:-1].replace(':', ' ')}, batch_id bigint").parquet(log_target)
        log = log.filter((F.col("batch_id") <= batch_id) & F.col("bucket").isin(_touched(known))).drop("batch_id", "bucket")
        touched = known.select("failure_id").filter(F.col("failure_id").isNotNull()).distinct()
        history = log.join(touched, "failure_id", "left_semi")
        still_open = open_failures(history).withColumn("is_open", F.lit(True))
        state = touched.join(still_open, "failure_id", "left").withColumn("is_open", F.coalesce("is_open", F.lit(False)))
        state.write.mode("overwrite").parquet(f"{open_target}/deltas/batch_id={batch_id}")
        known.unpersist()
        if (batch_id + 1) % snapshot_every == 0:
            _snapshot(spark, open_target, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot(spark: SparkSession, open_target: str, batch_id: int) -> None:
    """Folds what is open after a batch. A batch that runs again starts from the snapshot before its own, as it did before;
    what two snapshots cover is dropped, so a reader that has listed the files of the last one still finds them."""
    earlier = [k for k in _whole_folders(spark, f"{open_target}/snapshots", "upto") if k < batch_id]
    _open_rows(spark, open_target, earlier[-1] if earlier else None, batch_id).write.mode("overwrite").parquet(f"{open_target}/snapshots/upto={batch_id}")
    covered = earlier[-1] if earlier else -1
    for kind, name, numbers in (("deltas", "batch_id", _whole_folders(spark, f"{open_target}/deltas", "batch_id")), ("snapshots", "upto", earlier[:-1])):
        for k in numbers:
            if k <= covered:
                location, system = _location(spark, f"{open_target}/{kind}/{name}={k}")
                system.delete(location, True)


def _open_rows(spark: SparkSession, open_target: str, snapshot: int | None, upto: int | None = None) -> DataFrame:
    """The latest state of each failure over a snapshot and the deltas after it, if it is open."""
    deltas = spark.read.parquet(f"{open_target}/deltas").filter(F.col("batch_id") > (-1 if snapshot is None else snapshot))
    versions = deltas if upto is None else deltas.filter(F.col("batch_id") <= upto)
    if snapshot is not None:
        kept = spark.read.schema(versions.drop("batch_id", "is_open").schema).parquet(f"{open_target}/snapshots/upto={snapshot}")
        versions = versions.unionByName(kept.withColumn("is_open", F.lit(True)).withColumn("batch_id", F.lit(snapshot)))
    columns = [c for c in versions.columns if c not in ("batch_id", "failure_id", "is_open")]
    latest = versions.groupBy("failure_id").agg(F.max_by("is_open", "batch_id").alias("is_open"), F.max_by(F.struct(*columns), F.col("batch_id")).alias("s"))
    return latest.filter("is_open").select("failure_id", "s.*")


def current_open_failures(spark: SparkSession, open_target: str) -> DataFrame:
    """Open failures from the last snapshot and the deltas after it."""
    snapshots = _whole_folders(spark, f"{open_target}/snapshots", "upto")
    return _open_rows(spark, open_target, snapshots[-1] if snapshots else None)


def land_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Streams a Parquet table into a new folder under the shared checkpoint folder and reads it back."""
    base = scratch_path(spark, f"landed-{name}")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).select(*columns)
    land(stream, f"{base}/data", f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/data")

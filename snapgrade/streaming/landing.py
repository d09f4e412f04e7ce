"""Landing folders as streams: each trigger takes the new files, the checkpoint remembers them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from snapgrade.operators.dedupe import clean_keys, first_per_key
from snapgrade.operators.diff import carried_columns, changes_of, pair_snapshots, state_of


def landed_stream(
    spark: SparkSession, folder: str, schema: T.StructType, *, format: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Files as they arrive; all new ones per trigger unless ``files_per_trigger`` is given."""
    reader = spark.readStream.schema(schema).option("multiLine", format == "json")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(format).load(folder)


def land_snapshot(snapshot: DataFrame, folder: str, snapshot_id: str) -> None:
    """Write a whole snapshot below ``folder``, then its manifest: only then does a stream see it.

    A snapshot that was interrupted has no manifest and is replaced when it lands again.
    """
    snapshot.write.mode("overwrite").parquet(f"{folder}/data/snapshot={snapshot_id}")
    named = snapshot.sparkSession.range(1).select(F.to_json(F.struct(F.lit(snapshot_id).alias("snapshot"))).alias("value"))
    named.coalesce(1).write.mode("append").text(f"{folder}/manifests")


def manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One trigger per snapshot that has landed in full, in the order of their manifests."""
    schema = T.StructType([T.StructField("snapshot", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/manifests")


def _version_before(spark: SparkSession, folder: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """State written by the trigger before; empty before the first. Trigger numbers are gapless."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/version={batch_id - 1}")


def snapshot_job(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    state: str,
    pairs: str,
    changes: str,
    checkpoint: str,
    state_schema: T.StructType,
    keys: Sequence[str],
    fields: Sequence[str],
    order: Sequence[str],
) -> DataStreamWriter:
    """Diff every snapshot landed in ``folder`` against the last state; write changes and the next state.

    What is one snapshot is said by its manifest, not by the number of its files. The join runs
    once: its pairs are written, and changes and state are read off them.

    A trigger may be replayed after a failure: its inputs (files, state before it) are the
    same, and its outputs are folders named after the trigger, which a replay replaces.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _version_before(spark, state, state_schema, batch_id)
        (landed,) = batch.collect()  # a manifest is one file of one row
        rows = spark.read.schema(schema).parquet(f"{folder}/data/snapshot={landed.snapshot}")
        incoming = first_per_key(clean_keys(rows, keys), keys, list(order))
        pair_path = f"{pairs}/version={batch_id}"
        pair_snapshots(stored, incoming, keys, fields, carry=carried_columns(stored, keys, fields)).write.mode(
            "overwrite"
        ).parquet(pair_path)
        paired = spark.read.parquet(pair_path)
        changes_of(paired, keys).write.mode("overwrite").parquet(f"{changes}/version={batch_id}")
        state_of(paired, state_schema, keys, fields).write.mode("overwrite").parquet(f"{state}/version={batch_id}")

    stream = manifest_stream(spark, folder)
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def _new_keys(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys that no earlier trigger saw, each with the place of its first row in this one.

    A keyed streaming aggregate: its state is one narrow row per key, and rows of a key are combined before
    the shuffle, so a hot key is one row per task. The trigger's time is the same for all its rows and in a
    replay; a key is new if no row of it came at another time, whichever way the clock went in between.
    """
    row = [F.col(f"`{c}`") for c in stream.columns]
    located = stream.select(*row, F.col("_metadata.file_path").alias("_file"), F.current_timestamp().alias("_at"))
    tie = F.xxhash64(*row).alias("tie")
    place = F.struct(*[F.col(c).isNull().alias(f"null_{i}") for i, c in enumerate(order)], *order, tie, F.col("_file").alias("file"))
    placed = located.withColumn("_place", place)
    seen = clean_keys(placed, keys).groupBy(*keys).agg(
        F.min("_at").alias("since"), F.max("_at").alias("until"), F.min("_place").alias("place")
    )
    is_new = (F.col("since") == F.current_timestamp()) & (F.col("until") == F.current_timestamp())
    return seen.filter(is_new).select(*keys, F.col("place.tie").alias("_tie"), F.col("place.file").alias("_file"))


def reference_job(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    format: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataStreamWriter:
    """Append references landed in ``folder`` whose key no earlier trigger stored; replays replace their folder.

    Known keys are the stream's own state, so a trigger reads its new files and never the stored table. Of
    several rows of a key in one trigger the first by ``order`` counts (nulls last), then the least by hash.
    The state has keys and places only; the rows are taken from the files they came in, which are
    read again without the others. It keeps every key for good: for more keys than executors hold, set
    ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
    """
    new = _new_keys(
        landed_stream(spark, folder, schema, format=format, files_per_trigger=files_per_trigger), keys, order
    )
    columns = [F.col(f"`{c}`") for c in schema.names]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            # one path per file of this trigger, which the source lists on the driver as well
            files = [row[0] for row in batch.select("_file").distinct().collect()]
            landed = spark.read.schema(schema).option("multiLine", format == "json").format(format).load(folder)
            landed = landed.filter(F.col("_metadata.file_path").isin(files))
            rows = landed.select(*columns, F.xxhash64(*columns).alias("_tie"), F.col("_metadata.file_path").alias("_file"))
            wanted = clean_keys(rows, keys).join(batch, [*keys, "_tie", "_file"], "left_semi")
            first = wanted.dropDuplicates(list(keys))  # rows of one hash in one file are equal
            first.select(*columns).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        finally:
            batch.unpersist()

    return (
        new.writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )

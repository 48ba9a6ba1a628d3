"""New stores and reply totals as data arrives, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.scale import null_safe_join
from reviewlab.streaming.keyed_log import KeyedLog, last_value, once, sum_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of as many keys as there are stores does not have to fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_new_keys(stream: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """Keys not met before, neither in the stream nor in the static table ``seen``."""
    keys = stream.select(key)
    if seen is not None:
        keys = keys.join(seen.select(key).distinct(), key, "left_anti")
    return keys.dropDuplicates([key])


def stream_reply_total(stream: DataFrame, key: str, reply: str) -> DataFrame:
    """Number of replies per key so far."""
    return stream.groupBy(key).agg(F.count(reply).alias("replies"))


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and append the result rows to Parquet."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def append_new_keys(stream: DataFrame, key: str, path: str, checkpoint: str, seen: DataFrame | None = None, every: int = 16) -> None:
    """Process what is there and add the keys not met before to the table of keys at ``path``.

    The keys met so far are that table itself (``keyed_log``), not a state of the stream. Those of a batch are looked for
    in the hash parts that they fall in. A missing key is a key like others.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        log = KeyedLog(batch.sparkSession, path, key, once(key), every)
        keys = batch.select(key).distinct().persist()
        # At most as many numbers as the table has parts.
        parts = [r.p for r in keys.select(log.part().alias("p")).distinct().collect()]
        known = [t.select(key) for t in (log.rows(epoch, parts), seen) if t is not None]
        for table in known:
            # The large table is reduced to the batch's keys first, which may be sent to it.
            met = null_safe_join(table, keys, [key], "left_semi").distinct()
            keys = null_safe_join(keys, met, [key], "left_anti")
        log.write(keys, epoch)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def new_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All keys of ``append_new_keys``, each once."""
    return KeyedLog(spark, path, key, once(key)).read()


def add_reply_totals(stream: DataFrame, key: str, reply: str, path: str, checkpoint: str, every: int = 16) -> None:
    """Process what is there and add the replies of each batch per key to the totals at ``path``, without a state of the stream."""
    def write(batch: DataFrame, epoch: int) -> None:
        log = KeyedLog(batch.sparkSession, path, key, sum_of(key, "replies"), every)
        log.write(stream_reply_total(batch, key, reply), epoch)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def reply_totals(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Replies per key of ``add_reply_totals``."""
    return KeyedLog(spark, path, key, sum_of(key, "replies")).read()


def update_available(stream: DataFrame, path: str, checkpoint: str, key: str | None = None, value: str | None = None,
                     every: int = 16) -> None:
    """Process what is there and write the changed rows, one folder per batch.

    A repeated batch overwrites its own folder. With ``key`` and ``value`` named, folders are merged from time to time.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        if key is None:
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        else:
            KeyedLog(batch.sparkSession, path, key, last_value(key, value), every).write(batch, epoch)

    query = (stream.writeStream.foreachBatch(write).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def latest(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Last written value per key of ``update_available``: the merged table and newer batches only."""
    return KeyedLog(spark, path, key, last_value(key, value)).read()

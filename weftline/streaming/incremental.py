"""Files that land in a folder, taken into the store batch by batch; and activity in windows of event time."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.operators.chunking import chunk_files, skeletons
from weftline.operators.store import latest, upsert
from weftline.schemas import conform, key
from weftline.session import scratch_dir
from weftline.sources.tables import exists, remove


def landing(spark: SparkSession, folder: str, schema, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def windowed_activity(events: DataFrame, time: str, by: list[str], value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of ``value`` by tumbling window and ``by``; rows later than ``late`` behind the newest are dropped once their window is closed."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by)
    return w.agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "events", "total")


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """Run a stream over all that is there, into the shared folder, and read the result as a table. Append mode: a window is written once, when the
    watermark has passed it, and leaves the state; rows that come later are dropped. Windows that the
    watermark has not passed when the source ends are still open and not in the table."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def current(spark: SparkSession, store: str, name: str) -> str | None:
    """The newest whole version of a table of the store, or None before the first batch. A version is whole once Spark has marked it."""
    found = versions(spark, store, name)
    return found[-1] if found else None


def versions(spark: SparkSession, store: str, name: str) -> list[str]:
    base = f"{store}/{name}"
    if not exists(spark, base):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = sorted(x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    return [f"{base}/{n}" for n in names if exists(spark, f"{base}/{n}/_SUCCESS")]


def index_stream(sources: DataFrame, store: str, settings: Settings = Settings()):
    """A query that takes a stream of (repository_id, path, language, content) into files and chunks under ``store``.

    A batch keeps the newest text of each path, replaces that file's chunks and leaves all others; reprocessing a batch changes nothing. A batch
    writes new versions of both tables and then drops all but the two newest; ``current`` names the newest. A version that is there and
    cannot be read fails the batch, and the store stays as it was."""
    spark = sources.sparkSession

    def read(name: str, like: DataFrame) -> DataFrame:
        at = current(spark, store, name)
        return spark.read.schema(like.schema).parquet(at) if at else spark.createDataFrame([], like.schema)

    def put(df: DataFrame, name: str, epoch: int) -> None:
        df.write.parquet(f"{store}/{name}/{time.time_ns():020d}-{epoch}")
        for old in versions(spark, store, name)[:-2]:
            remove(spark, old)

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.withColumn("content_hash", F.sha2("content", 256))
        new = latest(df, ["repository_id", "path"], "content_hash").withColumn("id", key("repository_id", "path"))
        files = conform(new.withColumn("size_bytes", F.octet_length("content")), "files")
        old = read("files", files)
        text = new.select(F.col("id").alias("file_id"), "content", "language")
        chunks = conform(skeletons(chunk_files(text, settings).join(text.select("file_id", "language"), "file_id").withColumn("id", key("file_id", "start_line", "content"))), "chunks")
        kept = read("chunks", chunks).join(new.select(F.col("id").alias("file_id")), "file_id", "left_anti")
        put(upsert(old, files, ["repository_id", "path"]), "files", epoch)
        put(kept.select(*chunks.columns).unionByName(chunks), "chunks", epoch)

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)

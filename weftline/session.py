"""Session helpers: a tuned local session, the shared folder, spreading rows over tasks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "weftline", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings a configured one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only if all tasks run in the
    driver's own process (tests): on a cluster each executor would write to a folder of its own and reads would be partial."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to. It is removed when the driver ends, or by ``clear``."""
    path = f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}"
    if path not in _to_remove:
        _to_remove.add(path)
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove all steps that this application has written. Only for when no result that was built on them is still to be read."""
    _remove(spark._jvm, spark._jsc.hadoopConfiguration(), scratch_dir(spark))


_to_remove: set[str] = set()


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # at the end of a driver its JVM may be gone; then the folder stays
        pass


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors. See ``scratch_dir`` for how long it stays.
    ``free``: shuffle files of the step are removed when it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    try:
        if free:
            spark.conf.set(FREE, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(FREE)
        elif free:
            spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(step: DataFrame) -> None:
    """Remove the files of a materialized step that no result is still to be read from."""
    spark = step.sparkSession
    for path in {f.rpartition("/")[0] for f in step.inputFiles()}:
        if f"/{scratch_dir(spark).rpartition('/')[2]}/" in path:
            _remove(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan of too few splits over the cores before costly per-row work; otherwise leave it alone."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)

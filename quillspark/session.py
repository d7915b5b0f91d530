"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores="*", name="quillspark", **settings):
    """A local session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    options = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        # Without call sites on every expression, plans are built much faster.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **settings,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be invisible to the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def new_shared_path(spark) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/quillspark-{uuid.uuid4().hex}"


def mounted(spark, path: str):
    """The path as programs on every machine open it, or None if only Spark's readers and writers reach it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(place).toUri().getPath() if system.getScheme() == "file" else None


def committed(spark, location: str, pattern: str) -> list:
    """Folders ``location/pattern`` whose write has ended, by the mark a write leaves last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().getParent().toString() for status in (found or [])]


def settle(df: DataFrame) -> DataFrame:
    """Compute once: write to the shared folder and read back.

    For a small result of a large scan that is needed more than once. The table
    outlives any executor, so nothing upstream is run again.
    """
    location = new_shared_path(df.sparkSession)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)

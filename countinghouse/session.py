"""Session set-up and the shared folder for data that must outlive executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Scratch folders made by this process.
_MADE: set[str] = set()


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("countinghouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's scratch folder, below the folder that ``spark.checkpoint.dir`` names.

    Where that is unset, the warehouse is used; on a cluster it must then lie in a store
    that all machines share, and a folder of one machine is refused. Spark deletes the
    scratch folder when the application ends.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        path = context._jvm.org.apache.hadoop.fs.Path(configured)
        scheme = path.getFileSystem(context._jsc.hadoopConfiguration()).getScheme()
        if scheme == "file" and not re.match(r"local(\[.*)?$", context.master):
            raise ValueError(f"{configured} is a folder of one machine; set spark.checkpoint.dir")
    scratch = f"{configured.rstrip('/')}/{context.applicationId}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    if scratch not in _MADE:
        path = context._jvm.org.apache.hadoop.fs.Path(scratch)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(scratch)
    return scratch


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor re-reads it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Besides surviving the loss of executors, the result has a known size: Spark
    broadcasts it in a join only if the files are below its threshold, and
    otherwise shuffles both sides, where hot keys can be split at run time.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session set-up and the folder that all executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library relies on; a cluster's own values win where it sets them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("commentarium")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors reach.

    Only where it is unset, and only on a local master, a temporary folder is made and set instead.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _put(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Write bytes into the shared folder; their place."""
    uri = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    else:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(uri)
        out = target.getFileSystem(conf).create(target)
        out.write(bytearray(data))
        out.close()
    return uri


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session, so that tasks find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_commentarium_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(_put(spark, buffer.getvalue(), ".zip"))
    sc._commentarium_shipped = True


def ship_bytes(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Put bytes of a bounded size into the shared folder and let every executor fetch them as a file.

    Returns the name to give to ``SparkFiles.get`` inside a task, where the file can be memory-mapped.
    """
    uri = _put(spark, data, suffix)
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[-1]

"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as a table is written: nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (given or _own_dir()).rstrip("/")


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a DataFrame that reads it back.

    Cuts the lineage: what follows reads files, so a lost executor costs a re-read and not a recomputation.
    An empty ``df`` gives an empty table of the same schema. ``compression``: a codec of Parquet's for long texts, else the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them is stored itself. Files outside the shared
    folder stay."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath() + "/"):
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

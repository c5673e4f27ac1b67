"""Results that later steps build on, written once where driver and executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not removed yet.
_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of this machine, which only a local session may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/varcluster-shared"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, and its path: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows in enough tasks for every core. Of narrow rows that mean much work, Spark would join many partitions into one."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _folders:
            _folders.remove(path)


def remove_all(spark: SparkSession) -> None:
    """Deletes all that this process has written so far; to be called once results are saved."""
    remove(spark, *list(_folders))

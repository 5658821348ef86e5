"""Cuts lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders by application, where spark.checkpoint.dir is unset.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        found = _own[app]
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def bucketed(df: DataFrame, by: str, buckets: int, tag: str, dealt: bool = False) -> DataFrame:
    """df written as materialize() does, dealt to buckets by a column, so that grouping or joining by it later moves no row again. dealt: its rows lie so already, as after a join with another such table."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (df if dealt else df.repartition(buckets, by)).write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.table_path, out.table_name = path, name
    return out


def remove(df: DataFrame) -> None:
    """Removes the table of a DataFrame that materialize() or bucketed() gave; nothing may read it any more."""
    spark = df.sparkSession
    if "table_name" in vars(df):
        spark.sql(f"DROP TABLE IF EXISTS {df.table_name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

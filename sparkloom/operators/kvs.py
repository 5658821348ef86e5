"""A keyed store as a DataFrame (key, value) with unique keys. Each update is a transformation of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import collections as fn


def empty(spark, value_type: str = "int") -> DataFrame:
    return spark.createDataFrame([], f"key string, value {value_type}")


def put(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Last writer wins: updates (key, value, seq), of which the highest seq of a key stays; an update without seq is none. One shuffle, combined before it."""
    new = updates.filter("seq IS NOT NULL").select("key", "value", F.col("seq").cast("long"))
    both = store.select("key", "value", F.lit(None).cast("long").alias("seq")).unionByName(new)
    return both.groupBy("key").agg(F.max_by("value", F.struct(F.col("seq").isNotNull(), "seq")).alias("value"))


def put_with_old(store: DataFrame, updates: DataFrame) -> DataFrame:
    """key, seq, value, old: each update with the value that it replaces."""
    both = store.select("key", F.lit(None).cast("long").alias("seq"), "value").unionByName(updates.select("key", F.col("seq").cast("long"), "value"))
    old = F.lag("value").over(Window.partitionBy("key").orderBy(F.col("seq").asc_nulls_first()))
    return both.withColumn("old", old).filter("seq IS NOT NULL")


def get(store: DataFrame, key: str) -> DataFrame:
    return store.filter(F.col("key") == key).select("key", "value")


def get_ref(store: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """key, bucket of the keys that are there."""
    return multi_get(store, keys).select("key", fn.bucket_of(F.col("key"), buckets).alias("bucket"))


def multi_get(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that are there, each once."""
    return keys.select("key").distinct().join(store, "key").select("key", "value")


def multi_get_batch(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key once, with status found or not_found."""
    here = store.select("key", "value", F.lit(True).alias("_here"))
    return keys.select("key").distinct().join(here, "key", "left").select("key",
        F.when(F.col("_here"), "found").otherwise("not_found").alias("status"), "value")


def result_lines(found: DataFrame) -> DataFrame:
    """'key: value' of each row; without a value, what is known of it."""
    status = F.col("status") if "status" in found.columns else F.lit("found")
    return found.select(F.when(status == "found",
        F.concat_ws(": ", "key", F.col("value").cast("string"))).when(status == "not_found",
        F.concat("key", F.lit(": not found"))).otherwise(F.concat("key", F.lit(": never looked up"))).alias("line"))


def read_modify_write(store: DataFrame, requests: DataFrame) -> DataFrame:
    """The store after each key's requests (rows of key). The step depends on the value alone, so counts suffice and a hot key is combined before the shuffle."""
    n = requests.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = store.join(n, "key", "full_outer")
    return out.select("key", fn.rmw_after(F.col("value").cast("long"), F.coalesce("n", F.lit(0))).alias("value"))


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Results of disjoint keys as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union(a: DataFrame, b: DataFrame, choose) -> DataFrame:
    """Full outer merge; choose(a's value, b's value) decides for common keys."""
    x, y = a.select("key", F.col("value").alias("_a"), F.lit(True).alias("_ia")), b.select("key", F.col("value").alias("_b"),
        F.lit(True).alias("_ib"))
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    return x.join(y, "key", "full_outer").select("key",
        F.when(both, choose(F.col("_a"), F.col("_b"))).otherwise(F.coalesce("_a", "_b")).alias("value"))


def intersection(a: DataFrame, b: DataFrame, choose) -> DataFrame:
    y = b.select("key", F.col("value").alias("_b"))
    return a.join(y, "key").select("key", choose(F.col("value"), F.col("_b")).alias("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_anti").select("key", "value")


def at_version(history: DataFrame, version: int) -> DataFrame:
    """The store as of a version: history (key, value, version), the latest one up to it."""
    return history.filter(F.col("version") <= version).groupBy("key").agg(F.max_by("value", "version").alias("value"))


def bucket_scan(store: DataFrame, buckets: int, start: int, end: int) -> DataFrame:
    """key, value of the buckets start..end-1. Of a store written by save_buckets, others aren't read."""
    if "bucket" not in store.columns:
        store = store.withColumn("bucket", fn.bucket_of(F.col("key"), buckets))
    return store.filter((F.col("bucket") >= start) & (F.col("bucket") < end)).select("key", "value")


def save_buckets(store: DataFrame, buckets: int, path: str) -> DataFrame:
    """The store written with a folder for each bucket, and read back with the column bucket."""
    store.withColumn("bucket", fn.bucket_of(F.col("key"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    return store.sparkSession.read.parquet(path)


def visit_chunks(store: DataFrame, buckets: int, chunks: int) -> DataFrame:
    """chunk, n: rows of each equal group of buckets; buckets that can't be divided evenly are an error."""
    if buckets % chunks:
        raise ValueError(f"{buckets} buckets can't be divided into {chunks} equal chunks")
    chunk = (fn.bucket_of(F.col("key"), buckets) / (buckets // chunks)).cast("int")
    return store.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))

"""Edge lists, synthetic sort input and key-value workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.graph import Graph


def parse_edges(lines: DataFrame) -> DataFrame:
    """src, dst from rows of value: '#' begins a comment, the first space or tab parts a line, and a line whose source isn't a number is skipped, as is one whose destination isn't (a deviation: it would end the load)."""
    part = F.split("value", "[ \t]", 2)
    edges = lines.filter(~F.col("value").startswith("#")).select(F.get(part, F.lit(0)).try_cast("bigint").alias("src"),
        F.trim(F.get(part, F.lit(1))).try_cast("bigint").alias("dst"))
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL")


def read_graph(spark: SparkSession, path: str, undirected: bool, partitions: int | None = None) -> Graph:
    """An edge list of text files; partitions spreads its lines."""
    edges = parse_edges(spark.read.text(path))
    return Graph(edges.repartition(partitions) if partitions else edges, not undirected)


def sort_input(spark: SparkSession, parts: int = 16, each: int = 1_000_000, seed: int = 51017) -> DataFrame:
    """part, v: the same numbers for the same seed."""
    return spark.range(0, parts * each, 1, parts).select((F.col("id") / each).cast("int").alias("part"),
        F.xxhash64(F.col("id"), F.lit(seed)).alias("v"))


def alignment_input(spark: SparkSession, kb: int) -> DataFrame:
    """a, b: one pair of strings of 1024 * kb letters each, all a and all b."""
    return spark.range(1).select(F.repeat(F.lit("a"), 1024 * kb).alias("a"), F.repeat(F.lit("b"), 1024 * kb).alias("b"))


def kv_workload(spark: SparkSession, requests: int, keys: int = 1_000_000, read_ratio: float = 0.9, zipf: float | None = None,
    width: int = 1, seed: int = 51017, write: str = "put", reseed: int | None = None) -> DataFrame:
    """seq, op, keys, value: a reproducible mix of get (mget if width > 1) and `write`, put or rmw; a put alone has a value.
    Keys are uniform, or Zipf by the inverse of the continuous law, so no table of keys is joined. After each `reseed`
    requests the numbers begin anew from the next seed."""
    now = F.lit(seed) if reseed is None else F.lit(seed) + F.floor(F.col("id") / reseed)
    at = F.col("id") if reseed is None else F.col("id") % reseed
    u = lambda k: F.pmod(F.xxhash64(at, now, k), F.lit(1 << 52)) / float(1 << 52)

    def key(k):
        if zipf is None:
            rank = F.floor(u(k) * keys)
        elif zipf == 1.0:
            rank = F.floor(F.pow(F.lit(float(keys + 1)), u(k))) - 1
        else:
            rank = F.floor(F.pow(1 + u(k) * ((keys + 1) ** (1 - zipf) - 1), 1 / (1 - zipf))) - 1
        return F.concat(F.lit("key-"), F.least(rank, F.lit(keys - 1)).cast("long").cast("string"))

    read = u(F.lit(-1)) < read_ratio
    many = F.transform(F.sequence(F.lit(1), F.when(read, F.lit(width)).otherwise(F.lit(1))), key)
    return spark.range(requests).select(F.col("id").alias("seq"),
        F.when(read, "mget" if width > 1 else "get").otherwise(write).alias("op"), many.alias("keys"),
        F.when(~read & F.lit(write == "put"), F.floor(u(F.lit(-2)) * 1_000_000).cast("int")).alias("value"))

"""Local alignment scores of pairs of strings: the last cell of the matrix, as the blocked wavefront gives it.

A cell is its diagonal neighbour plus `match` where the characters agree; else the highest of 0, the
diagonal plus `mismatch`, the left plus `insert` and the upper plus `delete`. Pairs of unequal length
have no score (null), nor do nulls; empty strings score 0. Blocks pass on their right and lower edges
alone, so memory is in proportion to a string's length. `align` deals pairs to tasks; `align_long` deals
the blocks of one pair, whose anti-diagonals follow each other and whose blocks on one are independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.materialize import materialize, remove
from sparkloom.ship import ship


def block(a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray, corner: int, match=2, mismatch=-1, insert=-1,
    delete=-1) -> tuple[np.ndarray, np.ndarray]:
    """(lower edge over a, right edge over b) of a block, by anti-diagonals. top: the row above it, left: the column before it."""
    n, m = len(a), len(b)
    now, one, two = (np.zeros(m + 1, np.int64) for _ in range(3))  # this diagonal and the last ones, by row
    rows = np.arange(m + 1)
    lower, right = np.empty(n, np.int64), np.empty(m, np.int64)
    above = np.concatenate([[corner], top])
    before = np.concatenate([[corner], left])
    one[0] = corner
    for d in range(1, n + m + 1):
        lo, hi = max(0, d - n), min(m, d)
        if lo == 0:
            now[0] = above[d]
        if hi == d:
            now[d] = before[d]
        p, q = max(lo, 1), min(m, d - 1) + 1  # rows of inner cells
        if p < q:
            same = b[p - 1 : q - 1] == a[d - rows[p:q] - 1]
            corner_of, above_of, left_of = two[p - 1 : q - 1], one[p - 1 : q - 1], one[p:q]
            other = np.maximum(np.maximum(0, corner_of + mismatch), np.maximum(left_of + insert, above_of + delete))
            now[p:q] = np.where(same, corner_of + match, other)
        if d >= m and d - m >= 1:
            lower[d - m - 1] = now[m]
        if d >= n and d - n >= 1:
            right[d - n - 1] = now[d - n]
        two, one, now = one, now, two
    return lower, right


def score(a: str, b: str, chunks: int = 1, **costs) -> int | None:
    """The last cell, from blocks of ceil(length / chunks) characters."""
    if len(a) != len(b):
        return None
    if not a:
        return 0
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    size = -(-len(a) // chunks)
    top, row_end = np.zeros(len(x), np.int64), None
    for r in range(0, len(y), size):
        left, corner = np.zeros(len(y[r : r + size]), np.int64), 0
        for c in range(0, len(x), size):
            next_corner = int(top[min(c + size, len(x)) - 1])
            lower, right = block(x[c : c + size], y[r : r + size], top[c : c + size], left, corner, **costs)
            top[c : c + size], left, corner = lower, right, next_corner
        row_end = left
    return int(row_end[-1])


def align(df: DataFrame, a: str, b: str, chunks: int = 1, match: int = 2, mismatch: int = -1, insert: int = -1, delete: int = -1,
    keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The columns `keep` with score. The pairs are dealt to as many tasks as there are, so that one small file isn't one task."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.col(a).alias("_a"), F.col(b).alias("_b")).repartition(df.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            out = [None if x is None or y is None else score(x, y, chunks, match=match, mismatch=mismatch, insert=insert,
                delete=delete) for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int32())], names=[*keep, "score"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{fields}, score int")


def align_long(pair: DataFrame, a: str, b: str, size: int, match: int = 2, mismatch: int = -1, insert: int = -1, delete: int = -1) -> DataFrame:
    """score of the one row of `pair`, by blocks of `size` characters: those of an anti-diagonal are dealt to tasks, each
    diagonal is a written table, and a block gets its neighbours' edges and its two pieces of text, never a whole string.
    A null or strings of unequal length have no score; empty strings score 0; more than one row is an error."""
    spark = pair.sparkSession
    ship(spark)
    got = pair.select(F.length(a).alias("n"), F.length(b).alias("m")).limit(2).collect()
    if len(got) > 1:
        raise ValueError("align_long takes one pair")
    if not got or got[0]["n"] is None or got[0]["n"] != got[0]["m"] or not got[0]["n"]:
        return pair.select(F.when(F.length(a) == F.length(b), F.lit(0)).alias("score"))
    blocks = -(-got[0]["n"] // size)
    at = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k")
    piece = lambda c: F.substring(F.col("text"), F.col("k") * size + 1, F.lit(size)).alias(c)
    over, down = (materialize(pair.select(F.col(c).alias("text"), at).select(F.col("k").alias(k), piece(p)), "pieces") for c, k,
        p in ((a, "j", "x"), (b, "i", "y")))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[c].encode("utf-32-le"), np.uint32) for c in ("x", "y"))
                top = np.frombuffer(r["top"], np.int64) if r["top"] else np.zeros(len(x), np.int64)
                left = np.frombuffer(r["left"], np.int64) if r["left"] else np.zeros(len(y), np.int64)
                lower, right = block(x, y, top, left, r["corner"] or 0, match, mismatch, insert, delete)
                # What the right neighbour gets: the right edge and the corner above it; the lower one gets the lower edge.
                rows.append({"i": r["i"], "j": r["j"], "right": right.tobytes(), "lower": lower.tobytes(), "corner": int(top[-1]),
                    "last": int(right[-1])})
            yield pa.RecordBatch.from_pylist(rows,
                schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("right", pa.binary()), ("lower", pa.binary()),
                ("corner", pa.int64()), ("last", pa.int64())]))

    asked = spark.range(1).select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("binary").alias("top"),
        F.lit(None).cast("binary").alias("left"), F.lit(None).cast("long").alias("corner"))
    done = None
    for d in range(2 * blocks - 1):
        dealt = asked.join(over, "j").join(down, "i").repartition(min(blocks, d + 1, 2 * blocks - 1 - d), "i", "j")
        new = materialize(dealt.mapInArrow(run, "i int, j int, right binary, lower binary, corner long, last long"), "diagonal")
        if done is not None:
            remove(done)
        done = new
        right = done.filter(F.col("j") < blocks - 1).select("i", (F.col("j") + 1).alias("j"),
            F.lit(None).cast("binary").alias("top"), F.col("right").alias("left"), "corner")
        lower = done.filter(F.col("i") < blocks - 1).select((F.col("i") + 1).alias("i"), "j", F.col("lower").alias("top"),
            F.lit(None).cast("binary").alias("left"), F.lit(None).cast("long").alias("corner"))
        asked = right.unionAll(lower).groupBy("i", "j").agg(F.max("top").alias("top"), F.max("left").alias("left"), F.max("corner").alias("corner"))
    for old in (over, down):
        remove(old)
    return done.select(F.col("last").cast("int").alias("score"))

"""The keyed store over streams: puts and read-modify-writes with state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.ship import ship


def step(v: int | None) -> int:
    """Absent becomes 1; under 100000 doubles; else adds 1."""
    return 1 if v is None else v * 2 if v < 100000 else v + 1


def _put(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, value = state.get if state.exists else (None, None)
    for f in frames:
        if len(f):
            last = int(f["seq"].idxmax())
            if seq is None or f.at[last, "seq"] > seq:
                seq, value = int(f.at[last, "seq"]), int(f.at[last, "value"]) if f.at[last, "there"] else None
    state.update((seq, value))
    yield pd.DataFrame({"key": [key[0]], "seq": pd.array([seq], "Int64"), "value": pd.array([value], "Int64")})


def _rmw(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (value,) = state.get if state.exists else (None,)
    for f in frames:
        for _ in range(len(f)):
            value = step(value)
    state.update((value,))
    yield pd.DataFrame({"key": [key[0]], "value": [value]})


def put_stream(updates: DataFrame) -> DataFrame:
    """key, seq, value after each micro-batch, for streams of (key, value, seq), as kvs.put does: any seq counts, a late, lower one changes nothing, a null value is put, and an update without seq is none."""
    ship(updates.sparkSession)
    # Integers next to nulls would become floating-point numbers, so a value and whether it is there go apart.
    rows = updates.filter("seq IS NOT NULL").select("key", F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value"), F.col("value").isNotNull().alias("there"))
    return rows.groupBy("key").applyInPandasWithState(_put, "key string, seq long, value long", "seq long, value long", "update",
        GroupStateTimeout.NoTimeout)


def rmw_stream(requests: DataFrame) -> DataFrame:
    """key, value after each micro-batch, for streams of key."""
    ship(requests.sparkSession)
    return requests.groupBy("key").applyInPandasWithState(_rmw, "key string, value long", "value long", "update", GroupStateTimeout.NoTimeout)

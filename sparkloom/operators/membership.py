"""Membership: exact by default, or by cuckoo filters that are built for each hash part of the keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.ship import ship

#: Kicks before a filter counts as full, and the load beyond which the table is doubled (fixed values).
KICKS, LOAD = 500, 0.96
#: Distinct keys of a filter, and distinct probes of a task, about.
PART_KEYS, PART_PROBES = 100_000, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A number that depends on every bit of x (a multiplication by a golden-ratio constant, folded)."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Cuckoo:
    """Tags of up to 32 bits in buckets of (32 / bits) * 4 places; a tag may lie in either of two buckets. Items are known by 64-bit hashes."""

    def __init__(self, keys: int, bits: int):
        self.bits, self.places = bits, max(1, 32 // bits) * 4
        n = 1
        while n * self.places < keys:
            n *= 2
        if keys / (n * self.places) > LOAD:
            n *= 2
        self.table = np.zeros((n, self.places), np.uint32)
        self.items = 0

    @staticmethod
    def hash_of(item) -> int:
        return xxhash.xxh3_64_intdigest(str(item).encode())

    def _spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tag, first bucket, second bucket) of each hash; either bucket and the tag give the other one."""
        tag = np.maximum(hashes & np.uint64((1 << self.bits) - 1), np.uint64(1))
        spot = (hashes >> np.uint64(32)) % np.uint64(len(self.table))
        return tag, spot, spot ^ (_mixed(tag) % np.uint64(len(self.table)))

    def add_hash(self, h: int) -> bool:
        """False if there was no space; the filter is then as it was before."""
        tag, spot, other = (int(x[0]) for x in self._spots(np.array([h], np.uint64)))
        for s in (spot, other):
            free = np.flatnonzero(self.table[s] == 0)
            if len(free):
                self.table[s, free[0]] = tag
                self.items += 1
                return True
        kicked, spot = [], other
        for k in range(KICKS):
            place = (k * 7 + tag) % self.places
            kicked.append((spot, place, int(self.table[spot, place])))
            self.table[spot, place], tag = tag, kicked[-1][2]
            spot ^= int(_mixed(np.array([tag], np.uint64))[0]) % len(self.table)
            free = np.flatnonzero(self.table[spot] == 0)
            if len(free):
                self.table[spot, free[0]] = tag
                self.items += 1
                return True
        for s, place, was in reversed(kicked):
            self.table[s, place] = was
        return False

    def add(self, item) -> bool:
        return self.add_hash(self.hash_of(item))

    def contain(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be there."""
        tag, a, b = self._spots(hashes)
        tag = tag.astype(np.uint32)[:, None]
        return (self.table[a.astype(np.int64)] == tag).any(axis=1) | (self.table[b.astype(np.int64)] == tag).any(axis=1)

    def contains(self, item) -> bool:
        return bool(self.contain(np.array([self.hash_of(item)], np.uint64))[0])

    def delete(self, item) -> bool:
        """False if it wasn't there."""
        tag, a, b = (int(x[0]) for x in self._spots(np.array([self.hash_of(item)], np.uint64)))
        for s in (a, b):
            at = np.flatnonzero(self.table[s] == tag)
            if len(at):
                self.table[s, at[0]] = 0
                self.items -= 1
                return True
        return False

    def load_factor(self) -> float:
        return self.items / self.table.size

    def false_rate(self) -> float:
        """The chance that a hash which wasn't added is taken for one: two buckets of tags, filled to the load factor."""
        return 1 - (1 - 1 / ((1 << self.bits) - 1)) ** (2 * self.places * self.load_factor())

    def reset(self) -> None:
        self.table[:] = 0
        self.items = 0


def member(probes: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Each probe with here: whether keys hold it."""
    held = keys.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_h", F.lit(True))
    return probes.join(held, column, "left").select(*probes.columns, F.coalesce("_h", F.lit(False)).alias("here"))


def approximate_member(probes: DataFrame, keys: DataFrame, column: str, bits: int = 10, part_keys: int = PART_KEYS,
    part_probes: int = PART_PROBES) -> DataFrame:
    """column, here, for each distinct probe that isn't null: true for what is there, and by chance for Cuckoo.false_rate of
    the rest, 2.3 % at 10 bits and full load. The keys' hashes are dealt to parts of part_keys, each with a filter of its own;
    the probes of a part are dealt on to tasks of part_probes, each with a copy of that filter. A filter that overflows is
    doubled. Hashes are made in the JVM and looked up in arrays."""
    ship(probes.sparkSession)
    ask, have = (d.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_hash", F.xxhash64(column)) for d in (probes, keys))
    parts = max(1, -(-have.count() // part_keys))
    salts = max(1, -(-ask.count() // (parts * part_probes)))
    part = F.pmod(F.xxhash64(F.lit(2), "_hash"), F.lit(parts)).alias("_part")  # apart from the bits that make tags
    kind = probes.schema[column].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        hashes = np.unique(table.column("_hash").to_numpy()).astype(np.uint64)
        size = max(8, len(hashes))
        while True:
            f = Cuckoo(size, bits)
            if all(map(f.add_hash, hashes.tolist())):
                break
            size *= 2
        return pa.table({"_part": table.column("_part")[:1], "buckets": [len(f.table)], "filter": [f.table.tobytes()]})

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        f, here = Cuckoo(1, bits), np.zeros(left.num_rows, bool)
        for raw in right.column("filter").to_pylist():
            f.table = np.frombuffer(raw, np.uint32).reshape(-1, f.places)
            here = f.contain(left.column("_hash").to_numpy().astype(np.uint64))
        return pa.table({column: left.column(column), "here": pa.array(here)})

    filters = have.select("_hash", part).groupBy("_part").applyInArrow(build, "_part long, buckets long, filter binary")
    every = filters.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = ask.select(column, "_hash", part, F.pmod(F.xxhash64(F.lit(1), "_hash"), F.lit(salts)).cast("int").alias("_salt"))
    return dealt.groupBy("_part", "_salt").cogroup(every.groupBy("_part", "_salt")).applyInArrow(look, f"{column} {kind}, here boolean")

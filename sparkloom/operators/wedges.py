"""Weighted triangles, counted by blocks of edges, so that edges move and wedges don't.

Vertices are dealt to groups, edges to the blocks of their ends' groups. A task has the blocks among three groups, or all among
two, or one group's own, and counts the triangles with vertices in each of them. With g groups by hash an edge goes to about g
tasks, and g grows as the square root of the edges over what a task holds. Where edges are mostly between near ids, groups are
ranges of ids, and only tasks whose groups have edges between them are there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.ship import ship

#: Edges that a task holds, about; the least number of groups, for work on all cores; ranges of ids whose edges are counted to choose groups.
TASK_EDGES, LEAST_GROUPS, CELLS = 4_000_000, 5, 512
#: Edges packed at once; wedges looked up at once; entries of the table of neighbours, where a vertex has so few places.
PACKED, WEDGES, ENTRIES, FEW_PLACES = 1_000_000, 1 << 15, 1 << 22, 1 << 16


def cell(c: str, low: int, high: int) -> Column:
    """Which of CELLS ranges from low to high an id lies in."""
    part = (F.col(c).cast("double") - float(low)) / (float(high) - float(low) + 1.0)
    return F.least(F.floor(part * CELLS).cast("long"), F.lit(CELLS - 1))


@dataclass(frozen=True)
class Groups:
    """met: which groups may have edges between them. span: the lowest and highest id where groups are ranges, else they are by hash."""

    met: np.ndarray
    span: tuple[int, int] | None = None

    def of(self, c: str) -> Column:
        if self.span:
            return F.shiftright(cell(c, *self.span), (CELLS // len(self.met)).bit_length() - 1)
        return F.pmod(F.xxhash64(c), F.lit(len(self.met))).cast("long")

    def tasks_of(self, a: int, b: int) -> list[int]:
        """The tasks that need the edges between two groups: three groups in order, as digits; two groups i < j are i, i, j, one is i, i, i."""
        number = lambda *x: int((x[0] * len(self.met) + x[1]) * len(self.met) + x[2])
        i, j = min(a, b), max(a, b)
        if i == j:
            return [number(i, i, i)] + [number(min(i, o), min(i, o), max(i, o)) for o in np.flatnonzero(self.met[i]) if o != i]
        return [number(i, i, j)] + [number(*sorted((i, j, o))) for o in np.flatnonzero(self.met[i] & self.met[j]) if o not in (i, j)]

    def tasks(self) -> int:
        met = (self.met & ~np.eye(len(self.met), dtype=bool)).astype(float)
        return len(met) + int(met.sum() / 2 + (met @ met * met).sum() / 6)


def groups_for(edges: DataFrame, n: int) -> Groups:
    """Those that move the least, of hash groups and ranges that give no task too much. A task of three hash groups has six of the g * g parts of the edges."""
    by_hash = max(LEAST_GROUPS, isqrt(6 * n // TASK_EDGES) + 1)
    best, least = Groups(np.ones((by_hash, by_hash), bool)), n * by_hash
    if by_hash == LEAST_GROUPS:
        return best
    span = tuple(edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first())
    if span[0] is None:
        return best
    ends = [cell(c, *span) for c in ("src", "dst")]
    between = np.zeros((CELLS, CELLS))
    for i, j, count in edges.groupBy(F.least(*ends).alias("i"), F.greatest(*ends).alias("j")).count().collect():  # CELLS ** 2 / 2 rows at most
        between[i, j] = between[j, i] = count
    size = CELLS
    while size >= 8:
        cross = between.reshape(size, CELLS // size, size, -1).sum(axis=(1, 3))
        own = (np.diag(cross) + np.diag(between).reshape(size, -1).sum(axis=1)) / 2
        np.fill_diagonal(cross, 0)
        met = cross > 0
        thirds = met.astype(float) @ met
        moved = (own * (1 + met.sum(axis=1))).sum() + (cross * (1 + thirds)).sum() / 2
        held = max(own.max(), (met * (own[:, None] + own + cross)).max(), 3 * (cross * (thirds > 0)).max())
        if held <= TASK_EDGES and moved < least:
            best, least = Groups(met, span), moved
        size //= 2
    return best


def pack(src: np.ndarray, dst: np.ndarray, times: np.ndarray) -> bytes:
    """Edges sorted by src, dst."""
    return pa.compress(b"".join(np.ascontiguousarray(x, "<i8").tobytes() for x in (np.diff(src, prepend=0), np.diff(dst, prepend=0), times)),
        codec="zstd", asbytes=True)


def unpack(packed: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    src, dst, times = np.frombuffer(pa.decompress(packed, decompressed_size=24 * n, codec="zstd"), "<i8").reshape(3, n)
    return np.cumsum(src), np.cumsum(dst), times.astype(np.min_scalar_type(times.max()))


def counted(src: np.ndarray, dst: np.ndarray, times: np.ndarray, n: int, split: int | None = None) -> int:
    """The sum over edges v-u, v-w, u-w of times(v-u) * min(times(v-w), times(u-w)). Ends are numbers under n; no edge comes twice.
    split: only of triangles with vertices both under it and from it on."""
    key = src.astype(np.int64) * n + dst
    order = np.argsort(key)
    key, src, dst, times = key[order], src[order], dst[order], times[order]
    del order
    first = np.searchsorted(src, np.arange(n + 1))
    begin, end = first[dst], first[dst + 1]  # the edges u-w of each edge v-u
    if split is not None:
        middle = np.searchsorted(key, np.arange(n) * n + split)
        begin = np.where((src < split) & (dst < split), middle[dst], begin)
        end = np.where((src >= split) & (dst >= split), middle[dst], end)
    walks = np.flatnonzero(end > begin)
    begin, made = begin[walks], np.concatenate(([0], np.cumsum((end - begin)[walks])))
    del end
    table = np.zeros(ENTRIES, times.dtype) if n <= FEW_PLACES else None
    total = at = 0
    while at < len(walks):
        to = max(at + 1, np.searchsorted(made, made[at] + WEDGES, "right") - 1)
        low = int(src[walks[at]])
        if table is not None:
            to = min(to, np.searchsorted(walks, first[min(n, low + ENTRIES // n)]))
        edges = walks[at:to]
        size, starts = np.diff(made[at : to + 1]), made[at:to] - made[at]
        met = np.repeat(begin[at:to] - starts, size) + np.arange(made[to] - made[at])
        own = slice(first[low], first[src[edges[-1]] + 1])  # the edges of all v here
        had, ask = key[own] - low * n, np.repeat((src[edges].astype(np.int64) - low) * n, size) + dst[met]
        if table is not None:
            table[had] = times[own]
            found = table[ask]
            table[had] = 0
        else:
            place = np.minimum(np.searchsorted(had, ask), len(had) - 1)
            found = np.where(had[place] == ask, times[own][place], times.dtype.type(0))
        common = np.add.reduceat(np.minimum(found, times[met]), starts, dtype=np.int64)
        total += int(common @ times[edges].astype(np.int64))
        at = to
    return total


def weighted_triangles(edges: DataFrame, groups: Groups) -> DataFrame:
    """task, n: what counted() gives for edges(src, dst, times), each once, the ends longs and not null, in parts that sum up to it."""
    spark, of = edges.sparkSession, len(groups.met)
    ship(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            src, dst, times, a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(5))
            block = a * of + b
            order = np.lexsort((dst, src, block))
            src, dst, times, block = src[order], dst[order], times[order], block[order]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            rows = [(groups.tasks_of(*divmod(int(block[x]), of)), int(block[x]), y - x, pack(src[x:y], dst[x:y], times[x:y])) for x, y in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()))],
                ["tasks", "block", "edges", "packed"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= PACKED:
                yield sent(held)
                held = []
        if held:
            yield sent(held)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        task = key[0].as_py()
        here = sorted({task // of // of, task // of % of, task % of})
        parts = [(*divmod(k.as_py(), of), *unpack(x.as_buffer(), n.as_py())) for k, n, x in zip(*map(table.column, ("block", "edges", "packed")))]
        ids = [np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique(x) for a, b, src, dst, _ in parts for h, x in ((a, src), (b, dst)) if h == g)])) for g in here]
        base = np.cumsum([0, *map(len, ids)])  # vertices are numbered group by group
        place = lambda g, x: (base[k := here.index(g)] + np.searchsorted(ids[k], x)).astype(np.int32)
        for k, (a, b, src, dst, times) in enumerate(parts):
            parts[k] = place(a, src), place(b, dst), times
        src, dst, times = (np.concatenate(x) for x in zip(*parts))
        del parts
        n = counted(src, dst, times, int(base[-1]), int(base[1]) if len(here) == 2 else None)
        return pa.table({"task": [task], "n": pa.array([n], pa.int64())})

    packed = edges.select(*(F.col(c).cast("long") for c in ("src", "dst", "times")), groups.of("src").alias("a"), groups.of("dst").alias("b")).mapInArrow(deal,
        "tasks array<long>, block long, edges long, packed binary")
    parts = min(groups.tasks(), max(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return packed.select(F.explode("tasks").alias("task"), "block", "edges", "packed").repartition(parts, "task").groupBy("task").applyInArrow(count,
        "task long, n long")

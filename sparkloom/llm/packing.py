"""Best-fit packing of documents into fixed-length training sequences by bin completion.

Only the histogram of piece lengths reaches the driver: at most `capacity` counts, however large the
corpus. A plan is a list of patterns (lengths that share a sequence) with multiplicities. Each pattern
starts from the longest length left; branch and bound over its undominated fillings, least waste
first, looks for a plan with fewer sequences and prunes by the waste that a better plan could afford
and by a lower bound. The best-fit plan is the incumbent, whole and then group by group of its
sequences. Limits on nodes, fillings and groups (NODES, WIDTH, ROUNDS) bound the time; when they are
spent the incumbent stands, which holds every piece but may be above the bound. Each piece finds its place by its rank among the pieces
of its length. Ranks are counted within salted parts of a length, so no length meets in one task.

Edge cases: a null text is empty, and an empty text is the end mark alone; repeated rows are packed
as often as they occur; pieces of one length are alike, and take their places by hash part, id and
piece; an empty table gives an empty result; columns other than the id and the text are ignored. A
text's ids are held whole in one worker, however long it is.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY = 2048
#: Nodes that branch and bound may visit after the incumbent; the incumbent stands when they are spent.
NODES = 2000
#: Undominated fillings tried at a node.
WIDTH = 8
#: Groups of sequences that are packed anew, one after another, and about half the patterns of a group.
ROUNDS, GROUP = 200, 24
#: Rows of a length that share a salted part, about, and the fewest parts.
PART_ROWS, PARTS = 1_000_000, 64


# --- the plan -------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No plan needs fewer sequences: for each k up to half the capacity, pieces over half of it lie apart, those that leave
    less than k take no piece of k or more, and the room that the others leave can't hold all pieces from k to half."""
    n = len(counts)
    pieces, total = np.cumsum(counts), np.cumsum(counts * np.arange(n))
    half = capacity // 2
    over = int(pieces[-1] - pieces[min(half, n - 1)])
    k = np.arange(1, half + 1)
    under = np.minimum(capacity - k, n - 1)  # pieces over half and up to here leave room for k or more
    beside = (pieces[under] - pieces[min(half, n - 1)]) * capacity - (total[under] - total[min(half, n - 1)])
    small = total[min(half, n - 1)] - total[np.minimum(k - 1, n - 1)]
    more = int(np.maximum(0, -(-(small - beside) // capacity)).max(initial=0))
    return max(-(-int(total[-1]) // capacity), over + more)


def best_fill(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The best-fit filling of `room`: one, two or three lengths that fill it exactly where there are such; else the longest that fits, and so on."""
    left, out = counts, []
    while room > 0:
        have = np.flatnonzero(left[: room + 1])
        if not len(have):
            break
        top = int(have[-1])
        if 3 * top >= room:
            if found := _exact(left, have, room):
                return tuple(sorted([*out, *found], reverse=True))
        if left is counts:
            left = counts.copy()
        left[top] -= 1
        out.append(top)
        room -= top
    return tuple(out)


def _pair(counts: np.ndarray, have: np.ndarray, room: int) -> tuple[int, int] | None:
    a = have[(have >= room - have[-1]) & (have < room)]
    b = room - a
    ok = (counts[b] > 0) & ((a != b) | (counts[a] > 1))
    return (int(a[ok][-1]), int(b[ok][-1])) if ok.any() else None


def _exact(counts: np.ndarray, have: np.ndarray, room: int) -> tuple[int, ...] | None:
    if have[-1] == room:
        return (room,)
    if found := _pair(counts, have, room):
        return found
    for a in have[:-33:-1]:
        counts[a] -= 1
        rest = np.flatnonzero(counts[: room - a + 1])
        found = _pair(counts, rest, room - int(a)) if len(rest) else None
        counts[a] += 1
        if found:
            return int(a), *found
    return None


def fillings(counts: np.ndarray, room: int, most: int, leaves: int | None = None) -> list[tuple[int, ...]]:
    """Up to `most` undominated fillings of `room`, least waste first, of the first `leaves` that are looked at. A filling is dominated if a longer length that is left could take the place of one of its lengths or of two together."""
    leaves = 4 * most if leaves is None else leaves
    have = np.flatnonzero(counts[: room + 1])[::-1].tolist()  # lengths, longest first
    out: list[tuple[int, ...]] = []

    def dominated(filling: tuple[int, ...], slack: int) -> bool:
        sums = {*filling, *(a + b for i, a in enumerate(filling) for b in filling[i + 1 :])} if len(filling) <= 64 else set(filling)
        return slack > 0 and any(counts[s + 1 : s + slack + 1].any() for s in sums)

    # Depth first: (place in `have` from which to go on, lengths taken, room left). Exact ends are found at once.
    at = {x: i for i, x in enumerate(have)}
    seen = 0
    stack: list[tuple[int, tuple[int, ...], int]] = [(0, (), room)]
    while stack and seen < leaves:
        k, taken, left = stack.pop()
        while k < len(have) and (have[k] > left or taken.count(have[k]) >= counts[have[k]]):
            k += 1
        if k == len(have):
            seen += 1
            if not dominated(taken, left):
                out.append(taken)
            continue
        x = have[k]
        if left != x and k + 1 < len(have):  # without any more of x, unless x alone fills the room
            stack.append((k + 1, taken, left))
        if left - x in at and at[left - x] > k:
            seen += 1
            out.append((*taken, x, left - x))
        times = min(int(counts[x]) - taken.count(x), left // x)
        if times > 16:  # many of a short length: as many as fit, then one
            stack.append((k, (*taken, *[x] * times), left - times * x))
        else:
            stack.append((k, (*taken, x), left - x))
    best = best_fill(counts, room)
    return sorted({best, *out}, key=lambda f: (room - sum(f), len(f), [-x for x in f]))[:most]


def best_fit_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent: the longest length left with its best filling, as often as the counts allow."""
    left, out = counts.copy(), []
    for top in range(len(left) - 1, 0, -1):
        while left[top]:
            left[top] -= 1
            pattern = (top, *best_fill(left, capacity - top))
            left[top] += 1
            kinds, need = np.unique(pattern, return_counts=True)
            times = int((left[kinds] // need).min())
            left[kinds] -= times * need
            out.append((pattern, times))
    return out


def complete(counts: np.ndarray, capacity: int, most: int, nodes: int, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]] | None:
    """Bin completion: a plan of at most `most` sequences, None where `nodes` nodes hold none. A node fills a sequence around
    the longest length left with one of its undominated fillings; it ends where the waste is more than such a plan can afford,
    or the bound is."""
    total = int((counts * np.arange(len(counts))).sum())
    afford = most * capacity - total
    if afford < 0 or lower_bound(counts, capacity) > most:
        return None
    # Depth first with a stack of (counts left, patterns so far, sequences so far, waste so far).
    stack = [(counts, None, 0, 0)]
    while stack and nodes > 0:
        left, path, used, waste = stack.pop()
        nodes -= 1
        have = np.flatnonzero(left)
        if not len(have):
            best = []
            while path:
                path, step = path
                best.append(step)
            return best
        top = int(have[-1])
        left = left.copy()
        left[top] -= 1
        options = fillings(left, capacity - top, width)
        left[top] += 1
        for filling in reversed(options):
            pattern = (top, *filling)
            kinds, need = np.unique(pattern, return_counts=True)
            lost = capacity - sum(pattern)
            times = int((left[kinds] // need).min())
            for n in {1, times} if len(options) > 1 and lost else {times}:
                rest = left.copy()
                rest[kinds] -= n * need
                w = waste + n * lost
                if w <= afford and used + n + lower_bound(rest, capacity) <= most:
                    stack.append((rest, (path, (pattern, n)), used + n, w))
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and multiplicities that hold every piece. counts[n]: pieces of length n, 1 to capacity.

    The best-fit plan is the incumbent. While it is over the lower bound, completion looks for a plan with one sequence less:
    first of all pieces, then of the pieces of its most wasteful sequences and of some others, ROUNDS groups one after another,
    whose pieces are packed anew while the other sequences stay."""
    counts = np.asarray(counts, np.int64)
    best = best_fit_plan(counts, capacity)
    bins, least = sum(n for _, n in best), lower_bound(counts, capacity)
    while bins > least and (found := complete(counts, capacity, bins - 1, nodes, width)):
        best, bins = found, sum(n for _, n in found)
    deal, spent = np.random.default_rng(5), 0  # the same each time
    while bins > least and spent < (ROUNDS if nodes else 0):
        spent += 1
        if not (found := _repacked(best, capacity, deal, nodes, width)):
            continue
        best, bins = found, bins - 1
    return best


def _repacked(best: list[tuple[tuple[int, ...], int]], capacity: int, deal: np.random.Generator, nodes: int,
    width: int) -> list[tuple[tuple[int, ...], int]] | None:
    """The plan with one sequence less, by packing the pieces of a few of its sequences anew; None where that fails."""
    lost = np.array([capacity - sum(p) for p, _ in best], np.int64)
    times = np.array([n for _, n in best], np.int64)
    order = np.lexsort((deal.random(len(best)), -lost))  # the most wasteful first, equal ones in any order
    half = len(order[lost[order] > 0])
    some = np.concatenate([order[: min(half, int(deal.integers(2, GROUP)))], deal.permutation(order[half:])[: int(deal.integers(2, GROUP))]])
    take = {int(k): min(int(times[k]), 1 + int(deal.integers(0, 2))) for k in dict.fromkeys(some.tolist())}
    if sum(n * int(lost[k]) for k, n in take.items()) < capacity:
        spare = [int(k) for k in order[:half] if int(k) not in take]
        for k in spare:  # enough waste for a sequence less
            take[k] = int(times[k])
            if sum(n * int(lost[j]) for j, n in take.items()) >= capacity or len(take) > 4 * GROUP:
                break
    if sum(n * int(lost[k]) for k, n in take.items()) < capacity:
        return None
    part = np.zeros(capacity + 1, np.int64)
    for k, n in take.items():
        np.add.at(part, list(best[k][0]), n)
    found = complete(part, capacity, sum(take.values()) - 1, max(1, nodes // 10), width)
    if found is None:
        return None
    return [(p, n - take.get(k, 0)) for k, (p, n) in enumerate(best) if n > take.get(k, 0)] + found


def runs(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the pieces go: for length n, rows at[n]:at[n+1] of (first rank, first sequence, offset)."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return np.searchsorted(table[:, 0], np.arange(capacity + 2)), table[:, 1], table[:, 2], table[:, 3]


# --- pieces ---------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _tokenizers(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    full.encode_special_tokens = True
    full.no_padding()
    full.no_truncation()
    ranks, fast = vocabulary.removesuffix(".json") + ".tiktoken", None
    if os.path.exists(ranks):
        import public_tokenizers

        with open(ranks, "rb") as f:
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    return full, fast


#: Characters on whose classes both libraries agree; a text with others goes to tokenizers itself.
OTHER = re.compile("[^\0-ɏ‐-‧€]")


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """The ids that tokenizers gives `text`, little-endian unsigned 32-bit. Where the same vocabulary lies beside it as ranks, plain texts take the faster library, which gives the same ids."""
    full, fast = _tokenizers(vocabulary)
    if fast and not OTHER.search(text):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """id_col, piece, start, length, ids_crc32: each document's ids and the end mark, cut only where they are over capacity; the first piece is then the shorter one."""
    common.prepare(df.sparkSession)

    def run(batches):
        common.trim()
        for whole in batches:
            for batch in common.slices(whole, "text"):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(token_ids(text or "", vocabulary), np.array([end_id], "<u4"))
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    rows += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                i, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run,
        f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
    end_id: int = 0, nodes: int = NODES) -> DataFrame:
    """pieces() with sequence_id (dense from 0) and offset. The pieces are written to the shared folder once; two shuffles move their numbers, never text."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    cut = common.materialize(pieces(df, id_col, text_col, vocabulary, capacity, end_id), "pieces")
    histogram = cut.groupBy("length").count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    at, first, sequence, offset = runs(plan(counts, capacity, nodes), capacity)
    parts = max(PARTS, -(-int(counts.sum()) // PART_ROWS))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64(id_col, "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(id_col, "piece")) - 1)
    ranked = ranked.join(bases, ["length", "_part"])

    def place(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_all").to_numpy()
            run = np.empty(len(n), np.int64)
            for m in np.unique(n):
                mine = n == m
                run[mine] = at[m] + np.searchsorted(first[at[m] : at[m + 1]], rank[mine], side="right") - 1
            columns = [batch.column(c) for c in (id_col, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[run] + rank - first[run]), pa.array(offset[run])],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base")).cast("long").alias("_all"))
    return ranked.mapInArrow(place, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(common.documents(spark, sf_dir))

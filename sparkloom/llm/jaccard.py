"""Exact Jaccard self-join on word n-grams by token-combination prefixes, and its components.

A document's tokens are its distinct n-grams of words. Two documents link from a Jaccard similarity
of `percent` on. Every step is exact; frequencies decide about speed alone.

1. Frequencies. Each batch sends its sorted token hashes, packed, to shards that count documents.
   The most frequent tokens, HEAVY of them at most, are sent along with the next step.
2. Signatures. Tokens are ordered from rare to frequent. A set of n tokens can miss n - t of them,
   t = ceil(percent * n / 100), so n - t + 1 in front must hit. Rare tokens are signatures by
   themselves. Frequent ones are dealt to classes by hash; from each class, pairs of tokens are the
   signatures, and since a class of c tokens needs c - 1 misses until no pair is left, the prefix is
   extended until the misses of all classes together exceed n - t. If two sets link, all that they
   share of the shorter prefix lies in the other one too, so they have a signature in common.
   The number of classes depends on a set's size; a set near a limit signs for both sides.
   Equal sets are one from here on.
3. Candidates. Buckets of up to FEW sets give their pairs, with the number of buckets that a pair
   shares. Of the first n - t + 1 tokens of the set that ends first a pair can share no more than
   that, and what either has in larger buckets or signs in pairs; with all tokens behind them that
   bounds the overlap, and pairs for which it doesn't suffice, such as those of one shared passage,
   end here. So do pairs for which no bucket can be the first that they share, since too few tokens
   are left behind its place in either set; this holds in larger buckets too.
4. Verification. Each candidate set has a sketch of a bit or two a token: the parity of its tokens
   by place. Two sets differ in at least as many tokens as their sketches do in bits, so most pairs
   that don't link end at their sketches, and whole sets move for the others alone. In each larger
   bucket the sets are ranked, those that most others share buckets with first, in salted parts of
   PART_SETS sets. Round by round the first few (1, then 4, 16, ...) are compared with all after
   them whose size allows a link and that aren't in the same component yet. A bucket is done when one
   component holds it, so a group of near copies takes few comparisons, and in the end each pair of a
   bucket is either compared or known to be connected. Tables are removed once a later one replaces them.

Tokens are 64-bit hashes; two different n-grams of a corpus of 10^9 clash with a chance of 1 in 37.

Edge cases: a text of fewer words than n has one token, the whole sequence; a null or wordless text
has none and links with nothing, not even its like; repeated rows are equal sets. Rows are told apart
by their sets, not their ids: texts that share an id link each for itself, and a row without an id
links others and takes the smallest id of its component, or null where no row has one. An empty table
gives an empty result; columns other than the id and the text are ignored. No set of pairs, links or
components reaches the driver, and one task holds one shard, whose number grows with the corpus; a
task sends equal sets once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .packed import PLACES, EliasFano, Words, mix

#: Bits of a token that frequencies are counted by.
COUNT_BITS = 40
#: Tokens in so many documents or more may be sent along, the HEAVY most frequent of them at most.
SENT_FROM, HEAVY = 8, 1 << 20
#: Tokens in so many documents or more sign in pairs.
PAIRS_FROM = 64
#: A set of up to SMALL tokens signs with single tokens; larger ones have CLASSES classes, four times as many from each eightfold size on.
SMALL, CLASSES = 37, 4
#: Sets of a bucket whose pairs are all counted.
FEW = 8
#: Sets of a larger bucket that are ranked together.
PART_SETS = 500
#: Sets that a task remembers to have sent; beyond that it forgets all and may send one again.
REMEMBER = 1 << 18
#: Text bytes for each shard.
SHARD_BYTES = 12 << 20
#: Bits of the filter by which rows are picked before they are read or moved; an exact join follows.
FILTER_BITS = 1 << 22


def token_sets(texts: list[bytes | None], n: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one after another, each sorted; sizes)."""
    sets, sizes = [], np.zeros(len(texts), np.int64)
    places = [np.uint64(p) for p in PLACES[:n]] if n <= len(PLACES) else [mix(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(n)]
    for i, text in enumerate(texts):
        h = np.array(words.hashes(text or b""), np.uint64)
        if len(h):
            m = max(1, len(h) - n + 1)
            total = np.full(m, min(len(h), n), np.uint64)
            for k in range(min(n, len(h))):
                total += h[k : k + m] * places[k]
            sets.append(np.unique(mix(total)))
            sizes[i] = len(sets[-1])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def set_hash(tokens: np.ndarray) -> np.uint64:
    """The identity of a set that isn't empty."""
    return mix(np.array([np.bitwise_xor.reduce(mix(tokens ^ PLACES[2])) + np.uint64(len(tokens))], np.uint64))[0]


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of the tokens at each of 2^k places, as many as tokens or up to twice that, 64 at least."""
    places = 1 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """The least number of tokens that just one of the sets of two sketches can hold."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    while len(x) != len(y):  # the larger one is folded
        if len(x) < len(y):
            x, y, a, b = y, x, b, a
        x = x[: len(x) // 2]
        a = (a >> (8 * len(x))) ^ (a & ((1 << (8 * len(x))) - 1))
    return (a ^ b).bit_count()


def needed(size, percent: int):
    """The least overlap that a set of this size can have with one that it links with."""
    return -(-size * percent // 100)


def band(size: int) -> int:
    """0 for small sets; the number of classes is CLASSES * 4^(band - 1)."""
    b, top = 0, SMALL
    while size > top:
        b, top = b + 1, top * 8
    return b


def signatures(tokens: np.ndarray, level: np.ndarray, percent: int, pairs_level: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, odd ones of single tokens and even ones of pairs, and the most that it can share with a set whose first common signature this is. tokens are ordered from rare to frequent; level: of their frequency."""
    n = len(tokens)
    must = n - int(needed(n, percent)) + 1
    rare = min(must, int(np.searchsorted(level, pairs_level)))
    if rare == must:
        return tokens[:must] | np.uint64(1), n - np.arange(must)
    out, rest = [tokens[:rare] | np.uint64(1)], [n - np.arange(rare)]
    for b in {band(n), band(int(needed(n, percent)))}:
        if not b:
            out.append(tokens[rare:must] | np.uint64(1))
            rest.append(n - np.arange(rare, must))
            continue
        classes = CLASSES * 4 ** (b - 1)
        held: dict[int, list[tuple[int, int]]] = {}
        hit = rare
        for i, t in enumerate(tokens[rare:].tolist(), rare):
            own = held.setdefault(t % classes, [])
            hit += bool(own)
            own.append((t, i))
            if hit >= must:
                break
        two = [(x, y, i) for own in held.values() for (x, _), (y, i) in combinations(own, 2)]
        if two:
            x, y, i = np.array(two, np.uint64).T
            out.append(mix(x * PLACES[0] + y * PLACES[1] + np.uint64(b)) & ~np.uint64(1))
            # In front of the first common pair stands one common token of each class at most, and no rare one.
            i = i.astype(np.int64)
            rest.append(n - i + np.minimum(classes, i - rare))
    sign, at = np.unique(np.concatenate(out), return_index=True)
    return sign, np.concatenate(rest)[at]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _frequent(rows: DataFrame, n: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted count keys of the most frequent tokens, and their levels (binary logarithms)."""
    shift = np.uint64(64 - COUNT_BITS)

    def send(batches):
        common.trim()
        words = Words()
        for whole in batches:
            for batch in common.slices(whole, "text", 8 << 20):
                keys, count = np.unique(token_sets(_texts(batch), n, words)[0] >> shift, return_counts=True)
                cut = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) * np.uint64(-(-(1 << COUNT_BITS) // shards)))
                parts = [(s, EliasFano.encode(keys[a:b]), np.minimum(count[a:b], 65535).astype("<u2")) for s,
                    (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                # Nearly all counts are 1: only the others are sent, with their places.
                more = [(np.flatnonzero(c > 1).astype("<u4"), c) for _, _, c in parts]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int32()),
                    pa.array([k for _, k, _ in parts], pa.binary()), pa.array([at.tobytes() for at, _ in more], pa.binary()),
                    pa.array([c[at].tobytes() for at, c in more], pa.binary())], names=["shard", "keys", "places", "counts"])

    def count(table: pa.Table) -> pa.Table:
        common.trim()
        keys, counts = [], []
        for k, at, c in zip(*(table.column(x).to_pylist() for x in ("keys", "places", "counts")), strict=True):
            keys.append(EliasFano(k).values())
            each = np.ones(len(keys[-1]), np.int64)
            each[np.frombuffer(at, "<u4")] = np.frombuffer(c, "<u2")
            counts.append(each)
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        keep = total >= SENT_FROM
        return pa.table({"key": keys[keep].astype(np.int64), "level": np.log2(total[keep]).astype(np.int32)})

    sent = rows.select("text").mapInArrow(send, "shard int, keys binary, places binary, counts binary")
    found = common.materialize(sent.groupBy("shard").applyInArrow(count, "key long, level int"), "frequent")
    least, held = 64, 0
    for r in sorted(found.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # a row for each level
        held += r["count"]
        if held > HEAVY:
            break
        least = r["level"]
    got = found.filter(F.col("level") >= least).toPandas().sort_values("key")  # HEAVY rows at most
    return got["key"].to_numpy(np.uint64), got["level"].to_numpy(np.int8)


def _sign(rows: DataFrame, id_col: str, n: int, percent: int, shards: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows with shard >= 0 hold packed signatures, and sizes with the numbers of tokens in front that don't sign by themselves; those with shard -1 hold ids, set hashes and sizes."""
    sent = rows.sparkSession.sparkContext.broadcast(heavy)
    shift, per = np.uint64(64 - COUNT_BITS), np.uint64(-(-(1 << 32) // shards))
    pairs_level = int(np.log2(PAIRS_FROM))
    kind = rows.schema[id_col].dataType
    names = ["shard", "signatures", "owners", "sets", "sizes", "ids"]

    def run(batches):
        common.trim()
        words, (keys, levels), seen = Words(), sent.value, set()
        for whole in batches:
            for batch in common.slices(whole, "text", 4 << 20):
                tokens, sizes = token_sets(_texts(batch), n, words)
                level = np.zeros(len(tokens), np.int8)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, tokens >> shift), len(keys) - 1)
                    hit = keys[at] == tokens >> shift
                    level[hit] = levels[at[hit]]
                ends = np.cumsum(sizes)
                sets, spare, found = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64), []
                for i, (b, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    if not size:
                        continue
                    own, lev = tokens[b - size : b], level[b - size : b]
                    sets[i] = set_hash(own)
                    if int(sets[i]) in seen:
                        continue
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(int(sets[i]))
                    if lev.any():
                        by = np.argsort(lev, kind="stable")
                        own, lev = own[by], lev[by]
                    found.append((i, *signatures(own, lev, percent, pairs_level)))
                    spare[i] = max(0, size - int(needed(size, percent)) + 1 - int(np.searchsorted(lev, pairs_level)))
                sign = np.concatenate([s for _, s, _ in found]) if found else np.zeros(0, np.uint64)
                rest = np.concatenate([r for _, _, r in found]).astype("<u4") if found else np.zeros(0, "<u4")
                owner = np.repeat([i for i, _, _ in found], [len(s) for _, s, _ in found]).astype("<u4")
                shard = (sign >> np.uint64(32)) // per
                by = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[by], np.arange(shards + 1, dtype=np.uint64))
                parts = [(s, by[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                rows, ids = [], []
                for s, at in parts:
                    who, place = np.unique(owner[at], return_inverse=True)
                    rows.append((s, sign[at].tobytes(), np.array([place, rest[at]], "<u4").tobytes(), sets[who].tobytes(),
                        np.array([sizes[who], spare[who]], "<u4").tobytes()))
                    ids.append([])
                rows.append((-1, None, None, sets.tobytes(), sizes.astype("<u4").tobytes()))
                listed = pa.ListArray.from_arrays(pa.array([0] * len(rows) + [batch.num_rows], pa.int32()), batch.column(id_col))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()),
                    *(pa.array(c, pa.binary()) for c in columns[1:]), listed], names=names)

    return rows.mapInArrow(run, f"shard int, signatures binary, owners binary, sets binary, sizes binary, ids array<{kind.simpleString()}>")


def _members(signed: DataFrame, id_col: str, kind: str) -> DataFrame:
    """id_col, set (null if empty) and size of each document."""

    def run(batches):
        common.trim()
        for batch in batches:
            for ids, sets, sizes in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, n = np.frombuffer(sets, np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(h, mask=n == 0), pa.array(n)], names=[id_col, "set", "size"])

    return signed.filter("shard = -1").select("ids", "sets", "sizes").mapInArrow(run, f"{id_col} {kind}, set long, size long")


def _buckets(signed: DataFrame, percent: int) -> DataFrame:
    """Buckets that two different sets or more are in. kind 0: of more than FEW sets; x: the signature, y: a set, nx: its size, spare: the bucket's sets, n: the most that it can share if this is its first. kind 1: pairs x, y of sets in the others, their sizes nx, ny, the lesser number of tokens that don't sign by themselves, n, the tokens that they share in this shard, and may, whether one of these can be the first of a link."""

    def run(table: pa.Table) -> pa.Table:
        common.trim()
        sign, sets, sizes, spare, rest = [], [], [], [], []
        for s, o, h, n in zip(*(table.column(x).to_pylist() for x in ("signatures", "owners", "sets", "sizes")), strict=True):
            (owner, left), n = np.frombuffer(o, "<u4").reshape(2, -1), np.frombuffer(n, "<u4").astype(np.int64).reshape(2, -1)
            sign.append(np.frombuffer(s, np.int64))
            sets.append(np.frombuffer(h, np.int64)[owner])
            sizes.append(n[0, owner])
            spare.append(n[1, owner])
            rest.append(left.astype(np.int64))
        sign, sets, sizes, spare, rest = map(np.concatenate, (sign, sets, sizes, spare, rest))
        by = np.lexsort((sets, sign))
        sign, sets, sizes, spare, rest = sign[by], sets[by], sizes[by], spare[by], rest[by]
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (sets[1:] != sets[:-1])
        sign, sets, sizes, spare, rest = sign[new], sets[new], sizes[new], spare[new], rest[new]
        first = np.flatnonzero(np.diff(sign, prepend=~sign[:1]))
        held = np.diff(first, append=len(sign))
        big = np.repeat(held > FEW, held)
        place = np.arange(len(sign))
        end = np.repeat(first + held, held)
        a, b = [], []
        for d in range(1, FEW):
            one = place[~big & (place + d < end)]
            a.append(one)
            b.append(one + d)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs, at = np.unique(np.stack([sets[a], sets[b]], axis=1), axis=0, return_inverse=True)
        n = np.bincount(at.ravel(), weights=sign[a] & 1, minlength=len(pairs)).astype(np.int64)
        may = np.minimum(rest[a], rest[b]) * (100 + percent) >= percent * (sizes[a] + sizes[b])
        may = np.bincount(at.ravel(), weights=may, minlength=len(pairs)) > 0
        one = np.zeros(len(pairs), np.int64)
        one[at.ravel()] = np.arange(len(a))
        a, b, k = a[one], b[one], int(big.sum())
        zero = np.zeros(k, np.int64)
        columns = {"kind": (zero, np.ones(len(pairs), np.int64)), "x": (sign[big], sets[a]), "y": (sets[big], sets[b]),
            "nx": (sizes[big], sizes[a]), "ny": (zero, sizes[b]),
            "spare": (np.repeat(held, held)[big], np.minimum(spare[a], spare[b])), "n": (rest[big], n), "may": (zero, may.astype(np.int64))}
        return pa.table({c: np.concatenate(v) for c, v in columns.items()})

    return signed.filter("shard >= 0").groupBy("shard").applyInArrow(run, "kind long, x long, y long, nx long, ny long, spare long, n long, may long")


def _few(found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of buckets of few sets whose sizes and shared tokens allow a link."""
    large = found.filter("kind = 0").groupBy(F.col("y").alias("set")).agg(F.count(F.lit(1)).alias("large"))
    sizes = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    pairs = found.filter("kind = 1").filter(sizes).groupBy("x", "y").agg(F.sum("n").alias("n"), F.first("nx").alias("nx"),
        F.first("ny").alias("ny"), F.first("spare").alias("spare"), F.max("may").alias("may")).filter("may = 1").drop("may")
    for side in ("x", "y"):
        pairs = pairs.join(large.withColumnsRenamed({"set": side, "large": f"l{side}"}), side, "left")
    shared = F.col("n") + F.col("spare") + F.least(F.coalesce("lx", F.lit(0)), F.coalesce("ly", F.lit(0)))
    behind = F.ceil(percent * F.greatest("nx", "ny") / 100 - 1e-9) - 1
    return pairs.filter((shared + behind) * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))).select(F.col("x").alias("a"),
        F.col("y").alias("b"))


def _picked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose `key` may be among that of keys: all that are, and few others. The filter is FILTER_BITS bits, whatever the corpus."""
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = keys.select(spot.alias("_b")).groupBy((F.col("_b") / 64).cast("int").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, CAST(_b % 64 AS INT)))").alias("_bits"))
    marked = rows.withColumn("_b", spot).withColumn("_w", (F.col("_b") / 64).cast("int")).join(F.broadcast(words), "_w")
    return marked.filter(F.expr("shiftright(_bits, CAST(_b % 64 AS INT)) & 1 = 1")).drop("_b", "_w", "_bits")


def _whole_sets(rows: DataFrame, id_col: str, n: int, owners: DataFrame) -> DataFrame:
    """set, sketch and tokens (packed) of the sets in owners (set, id_col)."""

    def run(batches):
        common.trim()
        words = Words()
        for whole in batches:
            for batch in common.slices(whole, "text", 4 << 20):
                tokens, sizes = token_sets(_texts(batch), n, words)
                parts = [tokens[e - k : e] for e, k in zip(np.cumsum(sizes), sizes) if k]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(p) for p in parts], pa.uint64()).cast(pa.int64(),
                    safe=False), pa.array([sketch(p) for p in parts], pa.binary()),
                    pa.array([p.tobytes() for p in parts], pa.binary())], names=["set", "sketch", "tokens"])

    made = _picked(rows, id_col, owners).select("text").mapInArrow(run, "set long, sketch binary, tokens binary")
    return made.join(owners.select("set"), "set", "left_semi").dropDuplicates(["set"])


def _links(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link."""

    def may(batches):
        for batch in batches:
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("sa").to_pylist(),
                batch.column("sb").to_pylist(), strict=True)
            # Of na + nb tokens a link holds at most (100 - percent) / (100 + percent) on one side alone.
            keep = [(100 + percent) * least_difference(x, y) <= (100 - percent) * (na + nb) for na, nb, x, y in sizes]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches):
        common.trim()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sides(pairs: DataFrame, kept: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(kept.select(F.col("set").alias(side), *(F.col(c).alias(c[0] + side) for c in kept.columns if c != "set")), side)
        return pairs

    light = whole.select("set", "sketch", (F.octet_length("tokens") / 8).cast("long").alias("n"))
    near = common.materialize(sides(pairs, light).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(may, "a long, b long"), "near")
    needed_sets = near.select(F.col("a").alias("set")).unionAll(near.select("b")).distinct()
    found = common.materialize(sides(near, _picked(whole.select("set", "tokens"), "set", needed_sets)).select("a", "b", "ta",
        "tb").mapInArrow(run, "a long, b long"), "links")
    common.remove(near)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it reaches) of all nodes of edges (a, b): the smallest label among neighbours, then the label's label, until nothing changes."""
    both = common.materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        now = common.materialize(step.join(jump, "to", "left").select("node", "old",
            F.least("to", F.coalesce("next", "to")).alias("label")), "labels")
        common.remove(labels)
        labels = now
        if now.filter("label <> old").isEmpty():
            common.remove(both)
            return labels


def shards_for(rows: DataFrame) -> int:
    """One shard for each SHARD_BYTES of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-size // SHARD_BYTES))


def _grouped(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, set (null without words), size, label (the smallest set of the component) and component_id of each row."""
    common.prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shards = shards_for(rows)
    signed = common.materialize(_sign(rows, "id", n, percent, shards, _frequent(rows, n, shards)), "signed")
    members = common.materialize(_members(signed, "id", kind), "members")
    buckets = common.materialize(_buckets(signed, percent), "buckets")
    common.remove(signed)
    labels = _joined(rows, n, percent, members, buckets)
    # Copies are summed up before the shuffle, and what is joined lies in tables, so that Spark can split a hot key.
    each = members.filter("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("least"))
    named = common.materialize(each.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label",
        F.coalesce("label", "set")), "named")
    least = common.materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    of = common.materialize(named.join(least, "label").select("set", "label", "component_id"), "components")
    for old in (labels, named, least):
        common.remove(old)
    return members.join(of, "set", "left").withColumn("component_id", F.coalesce("component_id", "id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """id_col, n_tokens and component_id, the smallest id that links reach (its own id for a document that links with nothing)."""
    return _grouped(df, id_col, text_col, n, percent).select(F.col("id").alias(id_col), F.col("size").alias("n_tokens"), "component_id")


def _merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels after links (a, b) between sets of different components were found: the components of the components."""
    of = labels.select("node", "label")
    edges = new.join(of.withColumnsRenamed({"node": "a", "label": "la"}), "a",
        "left").join(of.withColumnsRenamed({"node": "b", "label": "lb"}), "b", "left").select(F.coalesce("la", "a").alias("a"),
        F.coalesce("lb", "b").alias("b"))
    above = components(edges)
    kept = of.join(above.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node",
        F.coalesce("top", "label").alias("label"))
    out = common.materialize(kept.unionAll(above.join(of, "node", "left_anti").select("node", "label")), "labels")
    for old in (above, labels, new):
        common.remove(old)
    return out


def _joined(rows: DataFrame, n: int, percent: int, members: DataFrame, found: DataFrame) -> DataFrame:
    """node (a set), label: the components of sets that link with another."""
    few = common.materialize(_few(found, percent), "few")
    parts = F.ceil(F.col("spare") / PART_SETS).cast("int")
    buckets = found.filter("kind = 0").select(F.col("x").alias("signature"),
        F.pmod(F.xxhash64("y"), parts).cast("int").alias("part"), parts.alias("parts"), F.col("y").alias("set"),
        F.col("nx").alias("size"), F.col("n").alias("rest"), F.col("spare").alias("held"))
    weight = buckets.groupBy("set").agg(F.sum("held").alias("weight"))
    # A part's first sets come before any part's later ones.
    place = (F.row_number().over(Window.partitionBy("signature", "part").orderBy(F.desc("weight"), "set")) - 1) * F.col("parts") + F.col("part")
    ranked = common.materialize(buckets.join(weight, "set").withColumn("rank", place).drop("weight", "held"), "ranked")
    nodes = few.select(F.col("a").alias("set")).unionAll(few.select("b")).unionAll(ranked.select("set")).distinct()
    owners = common.materialize(members.filter("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("id")).join(nodes, "set"), "owners")
    whole = common.materialize(_whole_sets(rows, "id", n, owners), "whole")
    links = _links(few, whole, percent)
    labels = components(links)
    for old in (found, few, owners, links):
        common.remove(old)

    first, count = 0, 1
    while True:  # buckets that still hold several components, and have pairs left
        live = ranked.drop("label").filter(F.col("rank") >= first).join(labels.select(F.col("node").alias("set"), "label"), "set",
            "left").withColumn("label", F.coalesce("label", "set"))
        several = live.groupBy("signature", "parts").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")  # so that no signature meets in one task
        live = common.materialize(live.join(several.select("signature", every), ["signature", "part"]), "live")
        common.remove(ranked)
        if live.isEmpty():
            for old in (live, whole):
                common.remove(old)
            return labels
        lead = live.filter(F.col("rank") < first + count).select("signature", F.col("set").alias("x"), F.col("size").alias("nx"),
            F.col("label").alias("lx"), F.col("rank").alias("rx"), F.col("rest").alias("tx"), every)
        met = live.join(lead, ["signature",
            "part"]).filter((F.col("rank") > F.col("rx")) & (F.col("label") != F.col("lx")) & (100 * F.least("size",
            "nx") >= percent * F.greatest("size", "nx")) & (F.least("rest", "tx") * (100 + percent) >= percent * (F.col("size") + F.col("nx"))))
        pairs = met.select(F.least("set", "x").alias("a"), F.greatest("set", "x").alias("b")).distinct()
        new = _links(pairs, whole, percent)
        if not new.isEmpty():
            labels = _merged(labels, new)
        ranked, first, count = live, first + count, count * 4


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, with all its columns, that are the first of their component by id, a null id last. Of rows with equal ids in one component the one with the smallest set hash stays, and of equal sets one row. Rows without words stay all."""
    found = common.materialize(_grouped(df, id_col, text_col, n, percent), "components")
    one = found.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows"),
        F.every(F.col("id") == F.col("component_id")).alias("first"))
    kept = df.join(one.filter("rows = 1 AND first").select(F.col("id").alias(id_col)), id_col, "left_semi").select(*df.columns)
    shared = one.filter("rows > 1").select("id")
    if shared.isEmpty() and found.filter("id IS NULL").isEmpty():
        return kept
    # Rows that their ids don't tell apart are told apart by their sets.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("id IS NULL").unionAll(rows.join(shared, "id", "left_semi").select(*rows.columns))

    def hashed(batches):
        common.trim()
        words = Words()
        for whole in batches:
            for batch in common.slices(whole, "text", 4 << 20):
                tokens, sizes = token_sets(_texts(batch), n, words)
                own = [set_hash(tokens[e - k : e]).astype(np.int64) if k else None for e, k in zip(np.cumsum(sizes), sizes)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("text"),
                    pa.array(own, pa.int64())], schema=pa.schema([*batch.schema, pa.field("set", pa.int64())]))

    told = rows.mapInArrow(hashed, T.StructType([*rows.schema.fields, T.StructField("set", T.LongType())]))
    winner = found.filter("label IS NOT NULL AND id <=> component_id").groupBy("label").agg(F.min(F.struct("set",
        "id")).alias("w")).select("w.set", F.col("w.id").alias("own"))
    best = told.join(winner, "set").filter("id <=> own").groupBy("set").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    more = best.select("row.*").unionAll(told.filter("set IS NULL").select("row.*"))
    return kept.unionAll(more)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents that share four-word shingles at a Jaccard similarity of 0.85 or more."""
    return jaccard_components(common.documents(spark, sf_dir)).withColumnRenamed("n_tokens", "n_shingles")

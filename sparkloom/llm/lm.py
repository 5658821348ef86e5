"""Language-model scoring with Elias-Fano n-gram tries that are dealt to shards.

The model interpolates n-grams of up to `order` words: P1(w) = (c(w) + 1) / (N + V + 1), which sums to
1 over the words seen and one unseen word, and P(w | h) = f(hw) + g(h) * P(w | h') with the smoothed
relative frequency f(hw) = c(hw) / (c(h) + M), the rest g(h) = M / (c(h) + M), a prior M for each
length, and h' as h without its first word. f + g sum to 1 over the words that follow h, so each P is a
distribution. Texts begin and end with the same mark; as a word it counts as the end. Before a text's
first word the history is marks alone.

A trie level holds contexts, monotone pointers to their successors, successors relative to their
context, all as Elias-Fano runs, and for each n-gram two bytes with f and, below the longest length,
two with the g of what follows it: logarithms in steps of STEP, so that each is within 0.025 % at any
count. A text's log10 probability is therefore within 0.0004 a token of that of exact arithmetic.

Neither the words nor the n-grams of a corpus fit into one machine, so texts meet the model as follows.
1. Texts are packed into batches of about BATCH_BYTES: their distinct word hashes, and each word's
   place among them, compressed. The table lies in the shared folder, bucketed by batch, so that it is
   never shuffled again.
2. For each length n, each batch asks each shard once: its distinct n-grams of that shard, as packed
   sorted hashes, how often its training texts hold them, and for n > 1 the g of their histories, which
   the answers to n - 1 told. A shard is a range of the hash of the last word and its history, so that
   the followers of a frequent word are dealt to all shards.
3. A shard sums what all batches tell it and builds its level in one file, which is mapped into memory,
   searched for each batch's n-grams, and removed. Answers go back in the order of the questions.
4. Each batch is joined with its answers and scored.

With `keep`, the levels of all shards are written to a folder as well, and kept_scores() asks them for
other texts, by the same steps, without the texts that they learnt from.

There is a row for each batch and shard that share an n-gram: never more than distinct n-grams in
batches, and far fewer as long as a batch has many for each shard.

A word is a 64-bit hash. An n-gram is CONTEXT_BITS of its history and as many more of all its words
that two n-grams of the corpus share a key with a chance under 2^-13 for each.

Edge cases: a null or empty text is the end mark alone; repeated rows count and score each time;
without training texts N = V = 0 and c = 0; an empty table gives an empty result; columns other than
the id and the text are ignored. A worker holds one batch or one shard, a text being whole in a batch.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .packed import PLACES, EliasFano, Words, mix

BATCH_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Bytes of packed batches in a bucket, about.
BUCKET_BYTES = 32 << 20
#: The longest n-grams, and the prior of each length from 2 on.
ORDER, PRIORS = 3, {2: 100.0, 3: 10.0}
#: The hash of the mark at both ends of a text; no word is empty.
EDGE = np.uint64(0)
#: Bits of a history, and the least of a whole n-gram's key.
CONTEXT_BITS, KEY_BITS = 24, 45
#: Code 0 stands for 0; any other code for a step of the logarithm from 1 down to e^-32.
STEP = 32 / 65534
VALUES = np.concatenate([[0.0], np.exp(-STEP * np.arange(65535))])


def code_of(p: np.ndarray) -> np.ndarray:
    """The nearest code of each number from 0 to 1."""
    p = np.asarray(p, np.float64)
    return np.where(p > 0, 1 + np.minimum(np.rint(-np.log(np.where(p > 0, p, 1.0)) / STEP), 65534), 0).astype("<u2")


def rest_of(count: np.ndarray, prior: float) -> np.ndarray:
    """The code of g of histories that occur so often."""
    return code_of(prior / (np.asarray(count, np.float64) + prior))


def in_parts(f, *arrays: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """f over runs of the arrays, so that what it makes on the way stays small."""
    parts = [f(*(x[a : a + most] for x in arrays)) for a in range(0, len(arrays[0]), most)]
    return np.concatenate(parts) if parts else f(*arrays)


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def widened(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def planes(codes: np.ndarray) -> bytes:
    """Low bytes, then high bytes, which compress better than pairs."""
    return np.ascontiguousarray(codes.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def unplaned(data: bytes, n: int, nth: int = 0) -> np.ndarray:
    """The nth array of n codes in data."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 2 * n, 2 * n * nth).reshape(2, n).T).view("<u2").ravel()


def packed_counts(count: np.ndarray) -> bytes:
    """A byte each; 255 stands for a number that follows behind all bytes."""
    return np.minimum(count, 255).astype(np.uint8).tobytes() + count[count >= 255].astype("<u8").tobytes()


def counts_of(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


@dataclass(frozen=True)
class Layout:
    """How keys are dealt to shards. words: keys are word hashes; else n-grams of `bits` bits."""

    shards: int
    bits: int = 64
    words: bool = False

    @property
    def next_bits(self) -> int:
        return 32 if self.words else self.bits - CONTEXT_BITS

    @property
    def per(self) -> np.uint64:
        """Values of the part that decides, in a shard."""
        return np.uint64(-(-(1 << self.next_bits) // self.shards))

    def shard(self, keys: np.ndarray) -> np.ndarray:
        part = keys >> np.uint64(32) if self.words else keys & np.uint64((1 << self.next_bits) - 1)
        return part // self.per

    def dealt(self, keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, places in keys) of each shard that has some; places rise."""
        shard = self.shard(keys).astype(np.uint16 if self.shards <= 1 << 16 else np.uint32)  # short numbers sort by digits
        by = np.argsort(shard, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=self.shards))])
        return [(s, by[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    def near(self, keys: np.ndarray, shard: int, back: bool = False) -> np.ndarray:
        """Keys of one shard without what all of them share, or (back) with it again; their order stays."""
        if self.words:
            base = np.uint64(shard) * self.per << np.uint64(32)
            return keys + base if back else keys - base
        base, bits = np.uint64(shard) * self.per, np.uint64(self.next_bits)
        if back:
            return keys // self.per << bits | (keys % self.per + base)
        return (keys >> bits) * self.per + ((keys & np.uint64((1 << self.next_bits) - 1)) - base)


class Trie:
    """One level: contexts -> successors -> codes. A key is context << next_bits | successor."""

    @staticmethod
    def build(keys: np.ndarray, next_bits: int, *codes: np.ndarray) -> bytes:
        """keys: sorted and distinct; codes: arrays of two bytes for each key."""
        bits = np.uint64(next_bits)
        context = keys >> bits
        first = np.flatnonzero(np.diff(context, prepend=context[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys))).astype(np.uint64)
        # A successor is stored with its context's place in front, so the whole level is one rising run.
        levels = [EliasFano.encode(context[first]), EliasFano.encode(np.append(first, len(keys))),
            EliasFano.encode(place << bits | keys & np.uint64((1 << next_bits) - 1)), b"".join(c.astype("<u2").tobytes() for c in codes)]
        return np.array([next_bits, *map(len, levels)], "<u8").tobytes() + b"".join(levels)

    def __init__(self, data):
        head = np.frombuffer(data, "<u8", 5).astype(np.int64)
        self.bits = np.uint64(head[0])
        a, b, c, d = 40 + np.concatenate([[0], np.cumsum(head[1:4])])
        view = memoryview(data)
        self.contexts, self.pointers, self.nexts = EliasFano(view[a:b]), EliasFano(view[b:c]), EliasFano(view[c:d])
        self.codes = np.frombuffer(view[d : d + head[4]], "<u2").reshape(-1, self.nexts.n) if self.nexts.n else np.zeros((0, 0), "<u2")
        self._contexts = self.contexts.values()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the place of each of them: the context, its range of successors, then the successor."""
        mask = (np.uint64(1) << self.bits) - np.uint64(1)
        context = keys >> self.bits
        place = np.searchsorted(self._contexts, context)
        there = np.flatnonzero(place < len(self._contexts))
        there = there[self._contexts[place[there]] == context[there]]
        place = place[there]
        first, last = (self.pointers.get(place + k).astype(np.int64) for k in (0, 1))
        wanted = place.astype(np.uint64) << self.bits | keys[there] & mask
        at = self.nexts.successors(wanted, first, last)
        hit = np.flatnonzero(at < last)
        hit = hit[self.nexts.get(at[hit]) == wanted[hit]]
        return there[hit], at[hit]

    def look_up(self, keys: np.ndarray, nth: int = 0, other: int = 0) -> np.ndarray:
        """The nth code of each key, `other` where there is none."""
        there, at = self.find(keys)
        out = np.full(len(keys), other, "<u2")
        out[there] = self.codes[nth][at]
        return out

    def answer(self, keys: np.ndarray, others: tuple[int, ...]) -> list[bytes]:
        """The codes of each key, as planes(), array by array."""
        there, at = self.find(keys)
        parts = []
        for nth, other in enumerate(others):
            out = np.full(len(keys), other, "<u2")
            if len(there):
                out[there] = self.codes[nth][at]
            parts.append(planes(out))
        return parts


@dataclass
class Tokens:
    """A batch as one chain: mark, words, mark, words, ..., mark."""

    chain: np.ndarray
    sizes: np.ndarray  # of each text, the end included

    def histories(self, n: int) -> np.ndarray:
        """A hash of the n - 1 words before each word; marks stand before a text's start."""
        v = self.chain[:-1]
        out = mix(v ^ PLACES[3])
        for k in range(2, n):
            u = np.concatenate([np.zeros(k - 1, np.uint64), self.chain[: len(v) - k + 1]])
            u[v == EDGE] = EDGE
            v = u
            out = mix(out ^ (u * PLACES[k % 3] + np.uint64(k)))
        return out

    def keys(self, n: int, bits: int) -> np.ndarray:
        """The key of the n-gram that ends with each word."""
        h, rest = self.histories(n), np.uint64(bits - CONTEXT_BITS)
        return h >> np.uint64(64 - CONTEXT_BITS) << rest | mix(h * PLACES[0] + self.chain[1:] * PLACES[1]) >> (np.uint64(64) - rest)


def distinct(every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each in `every`, the place of each of `every` among them)."""
    order = np.argsort(every)
    keys = every[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], order[new], place


#: What was answered, by length and shard: values, and what follows.
Told = dict[tuple[int, int], tuple[bytes, bytes]]


class Batch:
    """A packed batch: the words of texts, and what answers told."""

    def __init__(self, vocab: bytes, stream: bytes, sizes: bytes, held: bytes):
        self.vocab = EliasFano(vocab).values()
        raw = np.frombuffer(widened(stream), np.uint8).reshape(4, -1)
        self.place = np.ascontiguousarray(raw.T).view("<i4").ravel()  # of each of the chain among vocab
        self.sizes = np.frombuffer(sizes, "<u8").astype(np.int64)
        self.tokens = Tokens(self.vocab[self.place], self.sizes)
        self.train = np.repeat(np.frombuffer(held, np.uint8) == 0, self.sizes)

    @staticmethod
    def stream(place: np.ndarray) -> bytes:
        return squeezed(np.ascontiguousarray(place.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())

    def counts(self, told: Told, layout: Layout) -> np.ndarray:
        """How often training texts hold each word of vocab."""
        out = np.zeros(len(self.vocab), np.int64)
        for s, at in layout.dealt(self.vocab):
            out[at] = counts_of(widened(told[1, s][0]), len(at))
        return out

    def codes(self, told: Told, n: int, layout: Layout, nth: tuple[int, ...]) -> list[np.ndarray]:
        """Of the n-gram that ends with each word: the codes of f (0) or of the g of what follows it (1)."""
        keys, _, place = distinct(self.tokens.keys(n, layout.bits))
        out = [np.zeros(len(keys), "<u2") for _ in nth]
        for s, at in layout.dealt(keys):
            for o, k in zip(out, nth, strict=True):
                o[at] = unplaned(widened(told[n, s][k]), len(at))
        return [o[place] for o in out]

    def after(self, rests: np.ndarray, n: int, ends: int) -> np.ndarray:
        """The code of g of each word's history of n - 1 words, from those of the words that the histories end with; ends: how many training texts there are."""
        start = rest_of(np.array([ends]), PRIORS[n])
        out = np.concatenate([start, rests[:-1]])
        out[self.tokens.chain[:-1] == EDGE] = start[0]
        return out

    def rests(self, told: Told, n: int, words: Layout, layout: Layout, ends: int) -> np.ndarray:
        """The code of g of each word's history of n - 1 words."""
        if n == 2:
            return rest_of(self.counts(told, words), PRIORS[2])[self.place[:-1]]
        return self.after(self.codes(told, n - 1, layout, (1,))[0], n, ends)


def words_level(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The words of a shard and how often they occur."""
    runs = EliasFano.encode(keys)
    return np.array([len(runs)], "<u8").tobytes() + runs + packed_counts(counts)


def words_of_level(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    keys = EliasFano(data[8 : 8 + n]).values()
    return keys, counts_of(data[8 + n :], len(keys))


def words_told(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> bytes:
    """The answer to words: how often each occurs."""
    if not len(keys):
        return squeezed(packed_counts(np.zeros(len(asked), np.int64)))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return squeezed(packed_counts(np.where(keys[at] == asked, counts[at], 0)))


def unknown(n: int, order: int) -> tuple[int, ...]:
    """The codes of an n-gram that isn't there: f, and below the longest length the g of what follows it."""
    return (0, int(rest_of(np.zeros(1), 1.0)[0])) if n < order else (0,)


#: What _answers() gives beside answers: a shard's totals, and its level.
TOTALS, LEVEL = -1, -2
QUESTION = "shard int, batch long, keys binary, counts binary, rests binary"


def _asked(batch: int, keys: np.ndarray, count: np.ndarray, rests: np.ndarray | None, layout: Layout) -> list[tuple]:
    """A row of QUESTION for each shard."""
    return [(s, batch, EliasFano.encode(layout.near(keys[at], s)), squeezed(packed_counts(count[at])),
        None if rests is None else squeezed(planes(rests[at]))) for s, at in layout.dealt(keys)]


def _packed(df: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """batch, ids, held (a byte each), sizes, vocab and stream of about BATCH_BYTES of text."""
    kind = df.schema[id_col].dataType

    def run(batches):
        common.lean()
        words = Words()
        ids, held, hashes, sizes, size, made = [], [], [np.zeros(1, np.uint64)], [], 0, 0
        start = (TaskContext.get().partitionId() + 1) << 32

        def row(n):
            vocab, _, place = distinct(np.concatenate(hashes))
            listed = pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids))
            last = [pa.array([x], pa.binary()) for x in (bytes(held), np.array(sizes, "<u8").tobytes(), EliasFano.encode(vocab), Batch.stream(place))]
            return pa.RecordBatch.from_arrays([pa.array([start + n]), listed, *last], names=["batch", "ids", "held", "sizes", "vocab", "stream"])

        for whole in batches:
            for batch in common.slices(whole, "text", BATCH_BYTES // 4):
                new = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                if sizes and size + sum(map(len, new)) > BATCH_BYTES:
                    yield row(made)
                    ids, held, hashes, sizes, size, made = [], [], [np.zeros(1, np.uint64)], [], 0, made + 1
                ids.append(batch.column(0))
                held += batch.column("held").to_pylist()
                for t in new:
                    h = words.hashes(t)
                    h.append(int(EDGE))
                    hashes.append(np.array(h, np.uint64))
                    sizes.append(len(h))
                size += sum(map(len, new))
        if sizes:
            yield row(made)

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), held_out.cast("int").alias("held"))
    return rows.mapInArrow(run, f"batch long, ids array<{kind.simpleString()}>, held binary, sizes binary, vocab binary, stream binary")


def _question_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c,
        t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
        names=["shard", "batch", "keys", "counts", "rests"])


def _word_questions(batches: DataFrame, layout: Layout) -> DataFrame:
    """QUESTION rows for words."""

    def run(parts):
        common.lean()
        for part in parts:
            for i, batch in _batches_of(part):
                count = np.bincount(batch.place[1:][batch.train], minlength=len(batch.vocab))
                yield from _question_table(_asked(part.column("batch")[i].as_py(), batch.vocab, count, None, layout)).to_batches()

    return batches.select("batch", "vocab", "stream", "sizes", "held").mapInArrow(run, QUESTION)


def _answers_of(right: pa.Table) -> Told:
    every = (right.column(c).to_pylist() for c in ("length", "shard", "values", "rests"))
    return {(n, s): (v, r) for n, s, v, r in zip(*every, strict=True)}


def _batches_of(left):
    """(row, Batch) of each batch of a group."""
    for i, row in enumerate(zip(*(left.column(c).to_pylist() for c in ("vocab", "stream", "sizes", "held")), strict=True)):
        yield i, Batch(*row)


def _questions(batches: DataFrame, answers: DataFrame, n: int, words: Layout, layout: Layout, ends: int) -> DataFrame:
    """QUESTION rows for n-grams, from batches and the answers to what is one word shorter."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        common.lean()
        told, rows = _answers_of(right), []
        for i, batch in _batches_of(left):
            rests = batch.rests(told, n, words, layout, ends)
            keys, at, place = distinct(batch.tokens.keys(n, layout.bits))
            count = np.bincount(place[batch.train], minlength=len(keys))
            rows += _asked(left.column("batch")[i].as_py(), keys, count, rests[at], layout)
        return _question_table(rows)

    # Of longer ones only what follows them is asked for.
    told = answers.filter(F.col("length") == n - 1).select("batch", "shard", "length",
        *(["values", "rests"] if n == 2 else [F.lit(None).cast("binary").alias("values"), "rests"]))
    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(run, QUESTION)


ANSWER = "batch long, shard int, length int, values binary, rests binary"


def _answer_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c,
        t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
        names=["batch", "shard", "length", "values", "rests"])


def _told(batch: int, shard: int, n: int, trie: Trie, keys: np.ndarray, order: int) -> tuple:
    """A row of ANSWER: f of the keys, and below the longest length the g of what follows."""
    f, *g = trie.answer(keys, unknown(n, order))
    return batch, shard, n, squeezed(f), squeezed(g[0]) if g else None


def _answers(questions: DataFrame, n: int, order: int, layout: Layout, keep: bool = False) -> DataFrame:
    """ANSWER rows: counts of words, or the codes that the level tells of n-grams, as asked. A row with batch TOTALS holds the shard's numbers of distinct and of all training words, and of training texts; one with LEVEL, if kept, its level."""

    def run(table: pa.Table) -> pa.Table:
        common.lean()
        said = list(zip(*(table.column(x).to_pylist() for x in ("shard", "batch", "keys", "counts", "rests")), strict=True))
        every = [layout.near(EliasFano(k).values(), s, True) for s, _, k, _, _ in said]
        ends = np.cumsum([len(k) for k in every])
        each = np.concatenate([counts_of(widened(c), len(k)) for (_, _, _, c, _), k in zip(said, every, strict=True)])
        rests = np.concatenate([unplaned(widened(r), len(k)) for (_, _, _, _, r), k in zip(said, every, strict=True)]) if n > 1 else None
        every = np.concatenate(every)
        asked = [(b, s, every[e - k : e]) for (s, b, _, _, _), e, k in zip(said, ends, np.diff(ends, prepend=0), strict=True)]
        del said
        order_of = np.argsort(every)
        whole = every[order_of]
        first = np.flatnonzero(np.diff(whole, prepend=~whole[:1])) if len(whole) else np.zeros(0, np.int64)
        keys = whole[first]
        del whole
        counts = np.add.reduceat(each[order_of], first) if len(first) else each
        if n > 1:
            rests = rests[order_of[first]]  # all batches tell the same
        del each, order_of, first
        learnt = counts > 0
        keys, counts = keys[learnt], counts[learnt]
        if n > 1:
            rests = rests[learnt]
        del learnt
        out = []
        if n == 1:
            out.append((TOTALS, asked[0][1], 1, np.array([len(keys), counts.sum(), counts[keys == EDGE].sum()], "<i8").tobytes(), None))
            out += [(b, s, 1, words_told(keys, counts, k), None) for b, s, k in asked]
            if keep:
                out.append((LEVEL, asked[0][1], 1, words_level(keys, counts), None))
        else:
            codes = [in_parts(lambda c, r: code_of(np.minimum(1.0, c * (VALUES[r] / PRIORS[n]))), counts, rests)]
            if n < order:
                codes.append(in_parts(lambda c: rest_of(c, PRIORS[n + 1]), counts))
            handle, path = tempfile.mkstemp(suffix=".trie")
            try:
                with os.fdopen(handle, "wb") as f:
                    f.write(level := Trie.build(keys, layout.next_bits, *codes))
                if keep:
                    out.append((LEVEL, asked[0][1], n, level, None))
                del level, keys, counts, rests, codes
                trie = Trie(np.memmap(path, np.uint8, "r"))
                out += [_told(b, s, n, trie, k, order) for b, s, k in asked]
                del trie
            finally:
                os.unlink(path)
        return _answer_table(out)

    return questions.groupBy("shard").applyInArrow(run, ANSWER)


def _kept_answers(questions: DataFrame, levels: DataFrame, n: int, order: int, layout: Layout) -> DataFrame:
    """The answers of kept levels (shard, values) to what is asked."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        common.lean()
        asked = [(b, s, layout.near(EliasFano(k).values(), s, True)) for s, b,
            k in zip(*(left.column(x).to_pylist() for x in ("shard", "batch", "keys")), strict=True)]
        level = right.column("values")[0].as_py() if right.num_rows else None
        if n == 1:
            keys, counts = words_of_level(level) if level else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return _answer_table([(b, s, 1, words_told(keys, counts, k), None) for b, s, k in asked])
        trie = Trie(level) if level else Trie(Trie.build(np.zeros(0, np.uint64), layout.next_bits))
        return _answer_table([_told(b, s, n, trie, k, order) for b, s, k in asked])

    return questions.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(run, ANSWER)


def _batched(df: DataFrame, id_col: str, text_col: str, held_out: Column, size: int) -> DataFrame:
    return common.bucketed(_packed(df, id_col, text_col, held_out), "batch", max(8, -(-size // (2 * BUCKET_BYTES))), "batches")


def _text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def lm_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    keep: str | None = None) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's log10 probability). held_out: rows to score without learning from them; null counts as false. keep: a folder that all tasks reach, for the model's levels."""
    spark = df.sparkSession
    common.prepare(spark)
    kind = df.schema[id_col].dataType.simpleString()
    size = _text_bytes(df, text_col)
    shards = max(8, -(-size // SHARD_BYTES))
    words, layout = Layout(shards, words=True), Layout(shards, max(KEY_BITS, 13 + size.bit_length()))
    batches = _batched(df, id_col, text_col, F.coalesce(held_out, F.lit(False)), size)
    answers = common.materialize(_answers(_word_questions(batches, words), 1, order, words, keep is not None), "answers")

    def totals(rows):
        for batch in rows:
            got = [np.frombuffer(v, "<i8") for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in got], pa.int64()) for k in range(3)], names=["v", "n", "e"])

    found = answers.filter(F.col("batch") == TOTALS).select("values").mapInArrow(totals, "v long, n long, e long").agg(F.sum("v"),
        F.sum("n"), F.sum("e")).first()
    seen, learnt, ends = (x or 0 for x in found)
    for n in range(2, order + 1):
        common.sweep(spark)
        answers = answers.unionAll(common.materialize(_answers(_questions(batches, answers.filter("batch >= 0"), n, words, layout,
            ends), n, order, layout, keep is not None), "answers"))
    common.sweep(spark)
    if keep is not None:
        said = json.dumps({"order": order, "shards": shards, "bits": layout.bits, "seen": seen, "learnt": learnt, "ends": ends}).encode()
        meta = spark.createDataFrame([(-1, 0, bytearray(said))], "shard int, length int, values binary")
        answers.filter(F.col("batch") == LEVEL).select("shard", "length", "values").unionAll(meta).write.parquet(keep)
    return _scored(batches, answers.filter("batch >= 0"), id_col, kind, order, seen, learnt, ends, words, layout)


def kept_scores(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What lm_scores gives, for texts that teach nothing, from a model that it kept in a folder."""
    spark = df.sparkSession
    common.prepare(spark)
    kind = df.schema[id_col].dataType.simpleString()
    levels = spark.read.parquet(model)
    said = json.loads(bytes(levels.filter("length = 0").first()["values"]))
    order, words, layout = said["order"], Layout(said["shards"], words=True), Layout(said["shards"], said["bits"])
    batches = _batched(df, id_col, text_col, F.lit(True), _text_bytes(df, text_col))
    of = lambda n: levels.filter(F.col("length") == n).select("shard", "values")
    answers = common.materialize(_kept_answers(_word_questions(batches, words), of(1), 1, order, words), "answers")
    for n in range(2, order + 1):
        common.sweep(spark)
        answers = answers.unionAll(common.materialize(_kept_answers(_questions(batches, answers, n, words, layout, said["ends"]),
            of(n), n, order, layout), "answers"))
    return _scored(batches, answers, id_col, kind, order, said["seen"], said["learnt"], said["ends"], words, layout)


def _scored(batches: DataFrame, answers: DataFrame, id_col: str, kind: str, order: int, seen: int, learnt: int, ends: int,
    words: Layout, layout: Layout) -> DataFrame:
    """The scores of the batches' texts."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        common.lean()
        told, parts = _answers_of(right), []
        for i, batch in _batches_of(left):
            count, own = batch.counts(told, words), batch.place[1:]
            first = np.cumsum(batch.sizes) - batch.sizes
            known = np.add.reduceat((count > 0)[own].astype(np.int64), first)
            base = np.add.reduceat(np.log10(count + 1.0)[own], first) - batch.sizes * np.log10(learnt + seen + 1)
            p = ((count + 1.0) / (learnt + seen + 1))[own]
            rests = rest_of(count, PRIORS[2])[batch.place[:-1]]
            for n in range(2, order + 1):
                f, *more = batch.codes(told, n, layout, (0, 1) if n < order else (0,))
                p *= VALUES[rests]
                p += VALUES[f]
                rests = batch.after(more[0], n + 1, ends) if more else None
            np.minimum(p, 1.0, out=p)
            total = np.add.reduceat(np.log10(p, out=p), first)
            ids = left.column("ids")[i].values
            held = np.frombuffer(left.column("held")[i].as_py(), np.uint8) > 0
            parts.append(pa.table([ids, pa.array(held), batch.sizes, known, np.full(len(known), learnt), base, total], names=names))
        empty = pa.table([pa.array([], t) for t in (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(),
            pa.int64(), pa.float64(), pa.float64())], names=names)
        return pa.concat_tables(parts) if parts else empty

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score,
        f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    """The score of every document; those with crc32(doc_id) mod 7 = 2 are held out."""
    return lm_scores(common.documents(spark, sf_dir), common.remainder("doc_id", 7) == 2)

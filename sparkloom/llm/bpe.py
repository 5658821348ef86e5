"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece of bytes there is one token that its encoding ends with. That token is the
only one that ends there and is compatible with the last token of the prefix before it, where two
tokens are compatible if their bytes together encode to just those two. So a table of last tokens,
one for each prefix, is the encoding of all prefixes: bytes are appended exactly, and after an edit
only the entries from the edit on are made anew, up to where they fall in with the old ones.

Edge cases: a null or empty text has no tokens; pieces of any length take time in proportion to
their length; repeated rows give repeated results; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces, and compatible pairs, that a worker remembers; beyond that it forgets all and starts anew.
PIECES, REMEMBER = 1_500_000, 500_000


class Vocabulary:
    """Ranks of byte strings. A lower rank is merged first; a rank is also the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: Each token's parts before its last merge; None for a single byte.
        self.parts: dict[int, tuple[int, int] | None] = {}
        for data, rank in ranks.items():
            parts = [ranks[p] for p in self.merge(data, rank)]
            if len(parts) < 3:
                self.parts[rank] = tuple(parts) if len(parts) == 2 else None
        #: Tokens that some piece encodes to; the others stand only for a piece that equals them.
        self.reached = {b: i for b, i in ranks.items() if i in self.parts}
        self.longest = max(map(len, self.reached))
        finder = ahocorasick.Automaton()
        for data, i in self.reached.items():
            finder.add_word(data.decode("latin-1"), (i, len(data)))
        finder.make_automaton()
        self.matches = finder.iter  # (index of the last byte, token), for all tokens in a piece
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self._fit: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain BPE with the ranks under `below`: the lowest-ranked neighbours merge, leftmost first, until none are left."""
        parts, get = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        while len(parts) > 1:
            best, at = min((get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b encode to just a and b.

        Follows what stands left and right of their border back in time, from a and b to single
        bytes. They don't fit if two of these would have merged while both were there. At equal
        ranks the merge further left goes first.
        """
        pair = (a, b)
        found = self._fit.get(pair)
        if found is None:
            get, bytes_of, parts = self.ranks.get, self.bytes_of, self.parts
            until_a = until_b = 1 << 60
            while True:
                joint = get(bytes_of[a] + bytes_of[b])
                if joint is not None and joint < until_a and joint <= until_b:
                    found = False
                    break
                split_a, split_b = parts[a], parts[b]
                if split_a and (a > b or not split_b):
                    until_a, a = a, split_a[1]
                elif split_b:
                    until_b, b = b, split_b[0]
                else:
                    found = True
                    break
            if len(self._fit) >= REMEMBER:
                self._fit.clear()
            self._fit[pair] = found
        return found


    def tokens(self, piece: bytes) -> list[int]:
        """The encoding of a piece that isn't edited later: the last token of each prefix, then from the last one back. Prefixes does the same step by step."""
        last, known, fit, done = [-1], self._fit.get, self.fit, 0
        push = last.append
        for stop, (token, size) in self.matches(piece.decode("latin-1")):
            if stop < done:  # this prefix has its token
                continue
            j = stop + 1 - size
            if j:
                if j > done:
                    break
                pair = (last[j], token)
                ok = known(pair)
                if ok is None:
                    ok = fit(*pair)
                if not ok:
                    continue
            push(token)
            done = stop + 1
        i = len(piece)
        if done != i:
            raise ValueError("no token ends here: a single byte is missing from the vocabulary")
        out, size_of = [], self.size_of
        while i:
            token = last[i]
            out.append(token)
            i -= size_of[token]
        out.reverse()
        return out


class Prefixes:
    """The last token of every prefix of a growing, editable piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _more(self, start: int, end: int) -> None:
        """Adds the entries of prefixes start to end - 1."""
        last, known, fit = self.last, self.vocabulary._fit.get, self.vocabulary.fit
        at = max(0, start - self.vocabulary.longest)
        done = start - 1
        for stop, (token, size) in self.vocabulary.matches(self.piece[at : end - 1].decode("latin-1")):
            i = at + stop + 1
            if i <= done:
                continue
            j = i - size
            if j < 0:
                continue
            if j:
                before = last[j]
                ok = known((before, token))
                if ok is None:
                    ok = fit(before, token)
                if not ok:
                    continue
            last.append(token)
            done = i
        if done != end - 1:
            raise ValueError("no token ends here: a single byte is missing from the vocabulary")

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        self._more(start + 1, len(self.piece) + 1)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end-1 and returns how many entries were made anew."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        same, n = 0, len(self.piece)
        for i in range(start + 1, n + 1):
            self._more(i, i + 1)
            # An entry depends on the bytes and entries of the longest token's reach alone.
            same = same + 1 if i > start + len(new) and self.last[i] == old[i - shift] else 0
            if same >= self.vocabulary.longest and i - start - len(new) >= self.vocabulary.longest:
                self.last += old[i - shift + 1 :]
                return i - start
        return n - start

    def tokens(self) -> list[int]:
        """The encoding, from the last token back."""
        out, i, sizes = [], len(self.piece), self.vocabulary.bytes_of
        while i:
            out.append(self.last[i])
            i -= len(sizes[out[-1]])
        return out[::-1]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        found = (whole,) if whole is not None else tuple(self.vocabulary.tokens(data))
        if len(self.known) >= PIECES:
            self.known.clear()
        if len(data) < 64:
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        get, piece = self.known.get, self.piece
        return list(chain.from_iterable([get(p) or piece(p) for p in self.split(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load(path), pattern)


def _files(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    pattern: str | None = None, with_decoded: bool = False) -> DataFrame:
    """id_col and ids (array<int>); with_decoded adds decoded (binary), made from the ids in the same pass. Each match of pattern is encoded by itself. No shuffle."""
    common.prepare(df.sparkSession)
    path, pattern = _files(vocabulary, pattern)

    def run(batches):
        common.trim()
        coder = encoder(path, pattern)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                ids = [coder.encode(t) if t else [] for t in batch.column("text").to_pylist()]
                columns = {id_col: batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}
                if with_decoded:
                    columns["decoded"] = pa.array(map(coder.decode, ids), pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run,
        f"{id_col} {kind}, ids array<int>" + ", decoded binary" * with_decoded)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id_col and decoded (binary); null ids decode to null."""
    common.prepare(df.sparkSession)
    path, pattern = _files(vocabulary, None)

    def run(batches):
        common.trim()
        coder = encoder(path, pattern)
        for batch in batches:
            out = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} {kind}, decoded binary")


def op4_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: digests of its ids and of the decoded bytes."""
    out = encode(common.documents(spark, sf_dir), with_decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

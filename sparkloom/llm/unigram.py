"""Token counts of a unigram tokenizer without making its tokens.

The text is parted at spaces, for which a word mark (U+2581) in the text stands too; each word has a
word mark in place of the space before it, and so has the first one if no space stands before it. An Aho-Corasick automaton finds all vocabulary pieces in a word; dynamic
programming over its characters carries the best score and the number of pieces of each prefix.

Tie rules are those of the public unigram tokenizers: pieces are tried by their start, from left to
right, and a later one takes a place only with a strictly higher score, so at equal scores the longest
last piece stays. Where no one-character piece starts, an unknown character may stand, at the lowest
score of the vocabulary less UNKNOWN; unknown characters in a row are one token. Scores are summed in
double precision from left to right, as there.

Edge cases: a null or empty text has no tokens and score 0; spaces in a row give words of the mark
alone; of equally good segmentations that counts which ends in the longer piece, as `tokenizers` has it;
repeated rows give repeated results; an empty table gives an empty result; columns other than
the id and the text are ignored. Time is in proportion to the text's length, memory to one text.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
UNKNOWN = 10.0
REMEMBER = 600_000


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores, self.unknown = scores, min(scores.values()) - UNKNOWN
        finder = ahocorasick.Automaton()
        for piece, score in scores.items():
            finder.add_word(piece, (len(piece), score))
        finder.make_automaton()
        self.covers = frozenset(p for p in scores if len(p) == 1).issuperset
        self.matches = finder.iter
        self.known: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """(tokens, unknown tokens, score) of a marked word."""
        n = len(word)
        if self.covers(word):  # no unknown characters: matches come by rising end, the longest first, and all starts are settled
            best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for stop, (size, score) in self.matches(word):
                start = stop + 1 - size
                score += best[start]
                if score > best[stop + 1]:
                    best[stop + 1], count[stop + 1] = score, count[start] + 1
            return count[n], 0, best[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        for stop, (size, score) in self.matches(word):
            ending[stop].append((stop - size + 1, score))
            if size == 1:
                single[stop] = True
        best, count, odd, last_odd = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(n):  # ending pieces by rising start: all starts are settled before
            top, at, unknown = -math.inf, -1, False
            for start, score in sorted(ending[i]):
                if start and best[start] == -math.inf:
                    continue
                if best[start] + score > top:
                    top, at, unknown = best[start] + score, start, False
            if not single[i] and best[i] + self.unknown > top:
                top, at, unknown = best[i] + self.unknown, i, True
            best[i + 1], last_odd[i + 1] = top, unknown
            fused = unknown and last_odd[at]
            count[i + 1] = count[at] + (not fused)
            odd[i + 1] = odd[at] + (unknown and not fused)
        return count[n], odd[n], best[n]

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        if len(self.known) > REMEMBER:
            self.known.clear()
        tokens = unknown = 0
        total = 0.0
        known = self.known.get
        for w in text.replace(MARK, " ").removeprefix(" ").split(" "):
            got = known(w)
            if got is None:
                got = self.word(MARK + w)
                if len(w) < 64:
                    self.known[w] = got
            tokens += got[0]
            unknown += got[1]
            total += got[2]
        return tokens, unknown, total


def scores_from_pieces(path: str) -> dict[str, float]:
    """A unigram vocabulary from a sentencepiece model's pieces: control, unknown and byte pieces are left out, and piece number r of the others has the Zipf score -ln(r + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + 1) for r, p in enumerate(names, 1)}


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    return Unigram(scores_from_pieces(path))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id_col, n_tokens, n_unknown and score (of the best segmentation). No shuffle."""
    common.prepare(df.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        counter = load(vocabulary)
        for batch in batches:
            got = [counter.count(t or "") for t in batch.column("text").to_pylist()]
            n, odd, score = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(odd, pa.int64()),
                pa.array(score, pa.float64())], names=[id_col, "n_tokens", "n_unknown", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run,
        f"{id_col} {kind}, n_tokens long, n_unknown long, score double")


def op5_unigram_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(common.documents(spark, sf_dir))

"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams, by falling count. A document
gets such a list too, and its distance to a language sums how far each of its n-grams is out of place
in that profile; an n-gram that the profile lacks counts as `top` places. The nearest language wins.

Letters are lower-cased; whatever isn't a letter or a mark is a border, and borders in a row are one.
Equal counts are ordered by the n-gram's code points, shorter n-grams first; equally near languages by
name.

Edge cases: a null text, or one without letters, is `und` with score 0; rows without a language don't
teach; without a language to learn from, every text is `und`; n-grams of equal counts rank by length, then
by code points, and equal distances go to the first language by name; repeated rows count each time; an
empty table gives an empty result; columns other than those named are ignored. Memory is bounded by one text.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

UND = "und"
#: Languages that a model can hold; fit() refuses more, so that profiles stay small enough to send along.
MOST_LANGUAGES = 1000


@dataclass(frozen=True)
class Profiles:
    """ranked[lang]: packed n-grams by rank. order: the longest n-gram."""

    ranked: dict[str, np.ndarray]
    order: int = 3
    top: int = 300


@lru_cache
def letter_table() -> np.ndarray:
    """For each code point, its own number if it is a letter or mark, else that of a space."""
    kinds = np.full(sys.maxunicode + 1, 32, np.int32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            kinds[c] = c
    return kinds


def grams(texts: list[list[str]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, packed n-gram, count) of each group of texts, by group, length and n-gram. An n-gram packs 21 bits a character, the first one highest; within it stands no border.

    Only the n-grams of the full order are sorted. They start at every character, so those that begin
    alike are neighbours, and sums over them count the shorter ones.
    """
    ends = "\n" * order  # no text holds one once its own are spaces
    parts = [" " + f" {ends} ".join(t.lower().replace("\n", " ") for t in group) + f" {ends}" for group in texts]
    raw = np.frombuffer("".join(parts).encode("utf-32-le"), np.int32)
    group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    c = letter_table()[raw]
    c[raw == 10] = 0
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, group = c[keep], group[keep]
    there = np.zeros(int(c.max(initial=0)) + 1, bool)
    there[c] = True
    there[[0, 32] if len(there) > 32 else 0] = True
    letters = np.flatnonzero(there)  # 0, no character, is the first
    place = np.zeros(len(there), np.int32)
    place[letters] = np.arange(len(letters))
    k = len(letters)
    small = len(parts) * k**order < 2**31
    code = place[c] if small else place[c].astype(np.int64)
    m = max(0, len(c) - order + 1)
    key = (group if not small else group.astype(np.int32))[:m].copy()
    for i in range(order):
        key *= k
        key += code[i : i + m]
    key = np.sort(key[code[:m] > 0]).astype(np.int64)
    points = letters.astype(np.int64)
    border = int(np.searchsorted(letters, 32))
    out = []
    count = np.ones(len(key), np.int64)
    for n in range(order, 0, -1):
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count, key = np.add.reduceat(count, first) if len(first) else count, key[first]
        chars, rest = [], key.copy()
        for _ in range(n):
            chars.append(rest % k)
            rest //= k
        ok = chars[0] > 0  # the last character is there
        for inner in chars[1:-1]:
            ok &= inner != border
        if n == 1:
            ok &= chars[0] != border
        gram = np.zeros(len(key), np.int64)
        for i, x in enumerate(chars):
            gram |= points[x] << (21 * i)
        out.append((rest[ok], gram[ok], count[ok]))
        key //= k
    group, gram, count = (np.concatenate(x) for x in zip(*out[::-1], strict=True))
    by = np.argsort(group, kind="stable")
    return group[by], gram[by], count[by]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def unpack(gram: int) -> str:
    return "".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0) if gram >> s & 0x1FFFFF)


def ranks(document: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank) of each document's `top` most frequent n-grams. The input is in the order of grams()."""
    often = count > 1
    keep = often | (np.bincount(document[often], minlength=int(document.max(initial=0)) + 1) < top)[document]
    document, gram, count = document[keep], gram[keep], count[keep]
    by = np.argsort(document * (1 << 40) - count, kind="stable")  # equal counts stay in order
    document, gram = document[by], gram[by]
    rank = np.arange(len(document)) - np.searchsorted(document, document)
    keep = rank < top
    return document[keep], gram[keep], rank[keep]


def counts(df: DataFrame, text_col: str, lang_col: str, order: int = 3) -> DataFrame:
    """lang, gram (packed), n: n-grams of all texts by language. Summed within each batch before the shuffle, and in it."""
    common.prepare(df.sparkSession)

    def run(batches):
        common.trim()
        for whole in batches:
            for batch in common.slices(whole, "text", 2 << 20):
                by: dict[str, list[str]] = {}
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                names = list(by)
                group, gram, count = grams([by[n] for n in names], order)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(group)), pa.array(gram),
                    pa.array(count)], names=["lang", "gram", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 3, top: int = 300) -> Profiles:
    """Profiles of all rows that have a text and a language. At most `top` n-grams a language reach the driver."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts(df, text_col, lang_col, order).withColumn("rank", place).filter(F.col("rank") <= top)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in rows.limit(MOST_LANGUAGES * top + 1).collect():  # one row more than as many languages can have
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    if len(found) > MOST_LANGUAGES or sum(map(len, found.values())) > MOST_LANGUAGES * top:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    return Profiles({k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(found.items())}, order, top)


def nearest(texts: list[str | None], profiles: Profiles) -> tuple[list[str], list[float]]:
    """Language and score of each text. The score is 1 less the share of the largest possible distance."""
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if has_letter(t)]
    names, top = list(profiles.ranked), profiles.top
    if not some or not names:
        return lang, score
    document, gram, rank = ranks(*grams([[texts[i]] for i in some], profiles.order), top)
    size = np.bincount(document, minlength=len(some))
    far = np.empty((len(names), len(some)))
    for k, name in enumerate(names):
        profile = profiles.ranked[name]
        by = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile, gram, sorter=by), len(profile) - 1)
        place = by[at]
        out = np.where(profile[place] == gram, np.abs(place - rank), top)
        far[k] = np.bincount(document, weights=out, minlength=len(some))
    best = far.argmin(axis=0)
    for j, i in enumerate(some):
        if size[j]:
            lang[i], score[i] = names[best[j]], float(1 - far[best[j], j] / (top * size[j]))
    return lang, score


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred and score (0 to 1). No shuffle."""
    common.prepare(df.sparkSession)
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        common.trim()
        for whole in batches:
            for batch in common.slices(whole, "_text", 2 << 20):
                lang, score = nearest(batch.column("_text").to_pylist(), profiles)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()),
                    pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run,
        T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_languages(df: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, with all its columns, whose text has a language at a score of `least` or more."""
    common.prepare(df.sparkSession)

    def run(batches):
        common.trim()
        for whole in batches:
            for batch in common.slices(whole, text_col, 2 << 20):
                lang, score = nearest(batch.column(text_col).to_pylist(), profiles)
                yield batch.filter(pa.array([x != UND and y >= least for x, y in zip(lang, score, strict=True)]))

    return df.mapInArrow(run, df.schema)


def op8_rank_order_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; documents with crc32(doc_id) mod 4 = 2 teach nothing."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", (common.remainder("doc_id", 4) == 2).alias("held_out"))
    profiles = fit(docs.filter(~F.col("held_out")))
    return identify(docs, profiles, keep=("doc_id", "held_out"))

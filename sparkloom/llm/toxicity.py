"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of two strings counts the subsequences of three letters that they share, each weighted by
DECAY to the power of the stretch it covers in either, and is normalised to 1 for equal strings. So a
gap or an inserted character weakens a match and doesn't end it. Each word is folded (case, accents,
digits that stand for letters; every letter of every script stays a letter of its own) and seen with
marks at its ends through windows of eleven characters; letters spelt out with spaces between them
count as a word too. A sentence, and a text, is as toxic as its worst window.

Landmarks are the strings that tell toxic training texts from others, and common words, some of them much like those strings. The
machine is linear in the Nyström features K_mm^(-1/2) k_m(window). Since k_m is a sum over triples of
letters, the trained machine folds into one weight for each triple, and a window's value is exactly
that sum over its triples: no kernel is evaluated against each landmark. Training is multiple-instance:
of each toxic text, only the window with the highest value must lie on the toxic side, among words
that hold a telling string and stand in no other text; of any other text, none may. A logistic curve turns the highest value into a score.

Beside its worst window, all words of a text are weighed together: whole words and runs of 5 letters
or more that toxic texts hold much oftener than others, each by the logarithm of how much oftener
(Evidence). Near copies among the training texts count once. A text's sum is compared with what so many words have in other texts, and a second
logistic curve, fitted to sums that leave out what the text itself taught, gives a score too. The
higher of both is the text's.

Training takes a bounded sample of labelled rows (SAMPLE), each with all its words; everything else is
done for all rows. The driver holds each distinct word of the sample once and numbers for the rest.

Edge cases: a null or empty text gets the score of a text without any triple; without toxic or
without other training rows every score is 0; equal texts get equal scores; an id that is labelled
twice counts as toxic if one label says so; an empty table gives an empty result; other columns are
ignored. Memory is bounded by one text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DECAY = 0.5
WINDOW, STEP = 11, 2
#: Folded characters beside letters and digits: PART parts words or pads, BEGIN begins and END ends a word.
PART, BEGIN, END = 0, 1, 2
#: Letters of a run that may become a landmark, and the evidence that it needs; the evidence that a weighed string needs.
GRAM, SURE = 4, 25.0
EVIDENCE = 18.0
#: The most toxic and the most other rows to learn from; each teaches with all its words.
SAMPLE = (1500, 3000)
LANDMARKS, COMMON = 48, 16
#: Minimum hashes that find near copies among training texts, and distinct words from which a text can be one.
COPIES, SHORT = 32, 20
#: The shortest run that is weighed as evidence.
LEAST_RUN = 5
#: A text with this score or more is toxic.
THRESHOLD = 0.3
#: Words whose values a worker remembers; beyond that it forgets all and starts anew.
REMEMBER = 600_000
#: Digits and signs that stand for letters (fixed values).
STANDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SPELT = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")


def fold(c: int) -> int:
    """The folded code point: the letter without case and accents, or PART. Composed syllables stay whole."""
    whole = unicodedata.normalize("NFKC", chr(c)).lower()[:1]
    x = whole if "\uac00" <= whole <= "\ud7a3" else unicodedata.normalize("NFKD", whole)[:1]
    x = STANDS.get(x, x)
    return ord(x) if x.isalnum() else PART


@lru_cache
def fold_table() -> np.ndarray:
    """The folded code point of each code point of the first plane."""
    return np.fromiter(map(fold, range(1 << 16)), np.int32, 1 << 16)


def folded_points(raw: np.ndarray) -> np.ndarray:
    out = fold_table()[raw & 0xFFFF]
    for at in np.flatnonzero(raw >> 16):
        out[at] = fold(int(raw[at]))
    return out


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) folded code points and the index of the word that each is of."""
    joined = "\0".join(["", *words]) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.append(folded_points(raw), np.zeros(WINDOW, np.int32))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size - 1) - size + 1  # neighbours share the mark between them
    n = 1 + np.maximum(0, -(-(size - WINDOW) // STEP))
    word = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(start, n) + nth * STEP
    end = np.repeat(start + size, n)
    place = at[:, None] + np.arange(WINDOW)
    out = np.where(place < end[:, None], code[np.minimum(place, len(code) - 1)], np.int32(0))
    out[nth == 0, 0] = BEGIN
    out[place == end[:, None] - 1] = END
    return out, word


TRIPLES = [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(WINDOW), 3)]


def triples(rows: np.ndarray) -> list[dict[tuple[int, int, int], float]]:
    """Each window's weight of each triple of letters."""
    out = []
    for row in rows.tolist():
        found: dict[tuple[int, int, int], float] = {}
        for i, j, k, w in TRIPLES:
            if row[i] and row[j] and row[k]:
                t = (row[i], row[j], row[k])
                found[t] = found.get(t, 0.0) + w
        out.append(found)
    return out


class Table:
    """Places of triples: letters, then the pair that two of them are, then the third. `keys` has each triple once."""

    def __init__(self, keys: list[tuple[int, int, int]]):
        self.letters = np.array(sorted({c for key in keys for c in key}), np.int64)
        code = {int(c): i + 1 for i, c in enumerate(self.letters)}
        pairs = {p: i + 1 for i, p in enumerate(sorted({key[:2] for key in keys}))}
        n = len(code) + 1
        self.pair = np.zeros((n, n), np.int32)
        for (a, b), i in pairs.items():
            self.pair[code[a], code[b]] = i
        #: The place of each triple in keys, by pair and third letter; len(keys) stands for none.
        self.third = np.full((len(pairs) + 1, n), len(keys), np.int32)
        for i, (a, b, c) in enumerate(keys):
            self.third[pairs[a, b], code[c]] = i

    def codes(self, rows: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, rows), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == rows, at + 1, 0) if len(self.letters) else np.zeros(rows.shape, np.int64)

    def walk(self, rows: np.ndarray):
        """(place of each row's triple in the flat third table, its weight) for each triple of columns."""
        code, (_, n), pair = self.codes(rows), self.third.shape, self.pair.ravel()
        code = np.ascontiguousarray(code.T)
        for i in range(WINDOW):
            high = code[i] * n
            for j in range(i + 1, WINDOW - 1):
                two = pair[high + code[j]].astype(np.int64) * n
                for k in range(j + 1, WINDOW):
                    yield two + code[k], DECAY ** (k - i + 1)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The raw kernel of windows a[n] and b[n], by the usual recursion over their prefixes; padding matches nothing."""
    out = np.zeros(len(a), np.float32)
    for at in range(0, len(a), 2000):  # the tables of so many windows stay in the cache
        x, y = (r[at : at + 2000].T.astype(np.int32, order="C") for r in (a, b))
        n, decay, d2 = x.shape[1], np.float32(DECAY), np.float32(DECAY * DECAY)
        same = ((x[:, None] == y[None]) & (x > 0)[:, None]).astype(np.float32) * d2
        before = np.ones((WINDOW + 1, WINDOW + 1, n), np.float32)
        for _ in range(2):
            now = np.zeros_like(before)
            step = same * before[:-1, :-1]
            for j in range(1, WINDOW):
                step[:, j] += decay * step[:, j - 1]
            for i in range(WINDOW):
                now[i + 1, 1:] = decay * now[i, 1:] + step[i]
            before = now
        out[at : at + 2000] = (same * before[:-1, :-1]).sum(axis=(0, 1))
    return out


@dataclass(frozen=True)
class Evidence:
    """strings[s]: the logarithm of how much oftener toxic texts hold s. rate: weight of a word of other texts; excess: weight of a toxic text beyond that."""

    strings: dict[str, float]
    rate: float
    excess: float
    slope: float
    shift: float

    @cached_property
    def sizes(self) -> list[int]:
        return sorted(set(map(len, self.strings)))

    def weight(self, word: str) -> float:
        return strongest(_bare(word), self.strings, self.sizes)

    def score(self, total: float, n: int) -> float:
        """The score of a text whose n words weigh `total`."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * surplus(total, n, self.rate, self.excess) + self.shift, -500, 500))))


@dataclass(frozen=True)
class Model:
    """weights: by place in the table's flat third. A window's value is their sum over its triples by its norm, plus bias."""

    table: Table
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    landmarks: tuple[str, ...] = field(default=())
    evidence: Evidence | None = None


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(kernel(rows, rows), 1e-12))


def values(rows: np.ndarray, table: Table, weights: np.ndarray, bias: float, norm: np.ndarray | None = None) -> np.ndarray:
    """Each window's value; norm: of each window, where it is known."""
    total = np.zeros(len(rows), np.float32)
    for place, w in table.walk(rows):
        total += np.float32(w) * weights[place]
    hit = np.flatnonzero(total)  # where no triple has a weight the norm doesn't matter
    if len(hit):
        total[hit] /= norms(rows[hit]) if norm is None else norm[hit]
    return total + bias


def words_of(text: str | None) -> set[str]:
    """The lower-cased words of a text, and words that are spelt out letter by letter."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    for spelt in SPELT.findall(text):
        found.add("".join(spelt.split()))
    return found


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.weights = model, {}, {}

    def word_values(self, words: list[str]) -> list[float]:
        out = np.full(len(words), -np.inf, np.float32)
        for a in range(0, len(words), 20_000):
            part, word = windows(words[a : a + 20_000])
            np.maximum.at(out, word + a, values(part, self.model.table, self.model.weights, self.model.bias))
        return out.tolist()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        bags = [words_of(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
            self.weights.clear()
        new = list(set().union(*bags) - self.known.keys())
        self.known.update(zip(new, self.word_values(new), strict=True))
        if seen := self.model.evidence:
            self.weights.update((w, x) for w in new if (x := seen.weight(w)))
        worst = np.array([max(map(self.known.__getitem__, b), default=self.model.bias) for b in bags])
        out = 1 / (1 + np.exp(-np.clip(self.model.slope * worst + self.model.shift, -500, 500)))
        if seen:
            out = np.maximum(out, [seen.score(sum(sorted(self.weights[w] for w in b if w in self.weights)), len(b)) for b in bags])
        return out


# --- training -------------------------------------------------------------------------------------


class _Folds(dict):
    def __missing__(self, c: int) -> str:
        out = self[c] = chr(fold(c))
        return out


_FOLDS = _Folds()


def _folded(word: str) -> str:
    return chr(BEGIN) + word.translate(_FOLDS) + chr(END)


def _bare(word: str) -> str:
    """The folded word without the signs at its ends."""
    return chr(BEGIN) + word.translate(_FOLDS).strip(chr(PART)) + chr(END)


def strongest(word: str, strings: dict[str, float], sizes: list[int]) -> float:
    """The weight of the strongest of the strings that a bare word holds."""
    return max((strings[g] for n in sizes for i in range(len(word) - n + 1) if (g := word[i : i + n]) in strings), default=0.0)


def surplus(total: float, n: int, rate: float, excess: float) -> float:
    """How much likelier (logarithm, in units of the excess) a toxic text of n words weighs `total` than another does."""
    return (total * np.log1p(excess / (rate * max(1, n))) - excess) / excess


def evidence(toxic: list[list[str]], other: list[list[str]]) -> Evidence | None:
    """The words and runs that tell toxic texts, counted by the texts that hold them, and what texts weigh by them; None where nothing tells."""
    if not toxic or not other:
        return None
    bare = {w: _bare(w) for w in set().union(*toxic, *other)}
    inside, outside = ([list({bare[w] for w in bag}) for bag in bags] for bags in (toxic, other))  # lists take less memory
    scale = len(toxic) / len(other)

    def told(n: int, c: int) -> float:
        """The weight of what n toxic and c other texts hold, 0 where that is not enough."""
        expected = (c + 0.5) * scale
        return float(np.log(n / expected)) if n >= 3 * expected and n * np.log(n / expected) >= EVIDENCE else 0.0

    held: dict[str, tuple[int, int]] = {}
    often: set[str] = set()  # runs of the size before that toxic texts hold often enough
    for size in [0, *range(LEAST_RUN, WINDOW + 1)]:

        def cut(bag: list[str], size: int = size, often: set[str] = often) -> list[str] | set[str]:
            if not size:
                return bag
            return {g for w in bag for i in range(len(w) - size + 1) if size == LEAST_RUN or w[i : i + size - 1] in often for g in (w[i : i + size],)}

        within = {g: n for g, n in Counter(g for bag in inside for g in cut(bag)).items() if told(n, 0)}
        often = set(within) if size else set()
        without = Counter(g for bag in outside for g in cut(bag) if g in within)
        # What one text less would leave counts too: it is needed to weigh that text.
        held.update({g: (n, without[g]) for g, n in within.items() if told(n, max(0, without[g] - 1))})
    tables = [{g: x for g, (n, c) in held.items() if (x := told(n - a, max(0, c - b)))} for a, b in ((0, 0), (1, 0), (0, 1))]
    if not tables[0]:
        return None
    totals = []
    for bags, strings in ((toxic, tables[1]), (other, tables[2])):
        sizes, known = sorted(set(map(len, strings))), {}
        for w in set().union(*bags):
            if x := strongest(bare[w], strings, sizes):
                known[w] = x
        totals.append([sum(sorted(known[w] for w in bag if w in known)) for bag in bags])
    rate = max(sum(totals[1]), 1.0) / max(1, sum(map(len, other)))
    excess = max(1.0, float(np.mean([t - rate * len(bag) for t, bag in zip(totals[0], toxic, strict=True)])))
    f = np.array([surplus(t, len(bag), rate, excess) for t, bag in zip([*totals[0], *totals[1]], [*toxic, *other], strict=True)])
    slope, shift = platt(f, np.array([1] * len(toxic) + [-1] * len(other)))
    return Evidence(tables[0], rate, excess, slope, shift)


def telling(toxic: list[list[str]], other: list[list[str]], most: int) -> list[str]:
    """Strings of folded characters that tell toxic texts, most frequent first.

    A run of GRAM characters tells if toxic texts hold it three times as often as others do and the
    evidence, n log(n / expected n), is over SURE. It is lengthened while nine tenths of its texts
    hold the longer string, and left out if most words that hold it hold a string found before.
    """
    one: dict[str, str] = {}  # each run of characters is held once
    cut = lambda bag: {one.setdefault(g, g) for w in bag for i in range(len(w) - GRAM + 1) if (g := w[i : i + GRAM])}
    inside = [cut(bag) for bag in toxic]
    outside: Counter[str] = Counter()
    for bag in other:
        outside.update(cut(bag))
    scale = len(toxic) / max(1, len(other))
    good = []
    for g, n in Counter(g for s in inside for g in s).items():
        expected = (outside[g] + 0.5) * scale
        if chr(PART) not in g and n >= 3 * expected and n * np.log(n / expected) >= SURE:
            good.append((-n * np.log(n / expected), g))
    out: list[str] = []
    for _, g in sorted(good):
        if len(out) >= most:
            break
        if any(g in x for x in out):
            continue
        held = [[w for w in toxic[i] if g in w] for i, s in enumerate(inside) if g in s]
        if 2 * sum(any(any(x in w for x in out) for w in words) for words in held) > len(held):
            continue
        whole = g
        while len(whole) < WINDOW:
            longer: Counter[str] = Counter()
            for words in held:
                longer.update({x for w in words if (a := w.find(whole)) >= 0 for x in (w[max(0, a - 1) : a + len(whole)],
                    w[a : a + len(whole) + 1]) if len(x) > len(whole)})
            x = max(longer.items(), key=lambda x: (x[1], x[0]), default=("", 0))
            if x[1] < 0.9 * len(held) or chr(PART) in x[0]:
                break
            whole = x[0]
        out.append(whole)
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda w: 0.5 * w @ keep @ w + c * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(30):
        inside = y * (x @ w) < 1
        s, v = x[inside], weight[inside] * c * 2
        step = np.linalg.solve(keep + (s * v[:, None]).T @ s, keep @ w - (s * v[:, None]).T @ (y[inside] - s @ w)) if inside.any() else w
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if rate * np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * f * f).sum() + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * f).sum() + 1e-3 * a, g.sum()])
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def once(bags: list[list[str]]) -> list[list[str]]:
    """The bags without near copies of an earlier one, whose words would all seem to tell: those that share half of all words, by COPIES minimum hashes. Bags of few words stay."""
    words = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    long = [bag for bag in bags if len(bag) >= SHORT]
    if not long:
        return bags
    flat = np.fromiter((words[w] for bag in long for w in bag), np.uint32)
    starts = np.cumsum([0, *map(len, long[:-1])])
    by = np.random.default_rng(7).integers(1, 1 << 32, (COPIES, 2), np.uint32) | np.uint32(1)  # the same each time
    marks = np.empty((len(long), COPIES), np.uint32)
    for k, (x, y) in enumerate(by):
        mixed = (flat + x) * y
        marks[:, k] = np.minimum.reduceat((mixed ^ (mixed >> np.uint32(15))) * x, starts)
    kept, at, n = [], 0, 0
    for bag in bags:
        if len(bag) >= SHORT:
            at += 1
            if n and ((marks[:n] == marks[at - 1]).sum(axis=1) >= COPIES // 2).any():
                continue
            marks[n], n = marks[at - 1], n + 1
        kept.append(bag)
    return kept


def train(toxic: list[list[str]], other: list[list[str]], rounds: int = 4) -> Model | None:
    """A model from the words of toxic and of other texts, near copies among either left out; None where either is missing or nothing tells them apart."""
    toxic, other = once(toxic), once(other)
    folded = {w: _folded(w) for w in set().union(*toxic, *other)}
    inside, outside = ([list({folded[w] for w in bag}) for bag in bags] for bags in (toxic, other))
    found = telling(inside, outside, LANDMARKS) if inside and outside else []
    seen = evidence(toxic, other)
    alone = seen and Model(Table([]), np.zeros(1, np.float32), 0.0, 1.0, -500.0, (), seen)
    if not found:
        return alone
    often = Counter(w for bag in outside for w in bag if 5 <= len(w) <= WINDOW and chr(PART) not in w)
    alike = {w: n for w, n in often.items() if any(x[:GRAM] in w or x[1 : GRAM + 1] in w for x in found)}
    top = lambda c, n: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]]
    marks = list(dict.fromkeys([*found, *top(alike, COMMON), *top(often, COMMON)]))
    del inside, outside, often, alike
    rows = np.array([[ord(c) for c in m] + [PART] * (WINDOW - len(m)) for m in marks])
    features = triples(rows)
    column = {t: i for i, t in enumerate(sorted({t for f in features for t in f}))}
    table = Table(list(column))
    phi = np.zeros((len(marks), len(column)))
    for i, f in enumerate(features):
        for t, w in f.items():
            phi[i, column[t]] = w
    phi /= np.linalg.norm(phi, axis=1, keepdims=True)
    value, vector = np.linalg.eigh(phi @ phi.T)
    root = vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T

    bags = [sorted(set(b)) for b in [*toxic, *other]]
    y = np.array([1] * len(toxic) + [-1] * len(other))
    words = sorted(set().union(*bags))
    index = {w: i for i, w in enumerate(words)}
    made = [windows(words[a : a + 20_000]) for a in range(0, len(words), 20_000)]
    cuts, word = np.concatenate([c for c, _ in made]), np.concatenate([w + 20_000 * i for i, (_, w) in enumerate(made)])
    del made
    norm = norms(cuts)
    wide = np.vstack([phi.T, np.zeros((1, len(marks)))])

    def mapped(which: np.ndarray) -> np.ndarray:
        """Nyström features of the windows."""
        out, third = np.zeros((len(which), len(marks))), table.third.ravel()
        for place, w in table.walk(cuts[which]):
            out += w * wide[third[place]]
        return out / norm[which][:, None] @ root

    def flat(of_column: np.ndarray) -> np.ndarray:
        """Weights of triples, in the order of the table's flat third."""
        return np.append(of_column, 0.0).astype(np.float32)[table.third.ravel()]

    near = np.zeros(len(words))
    best_window = np.zeros(len(words), np.int64)
    chosen: set[int] = set()
    clean = set().union(*other)  # the witness against a text holds a telling string and stands in no clean text
    suspects = [[w for w in b if w not in clean and any(m in folded[w] for m in found)] for b in bags[: len(toxic)]]
    weights, bias = flat(phi[: len(found)].sum(axis=0)), 0.0
    for n in range(rounds + 1):
        v = np.concatenate([values(cuts[a : a + 50_000], table, weights, bias, norm[a : a + 50_000]) for a in range(0, len(cuts),
            50_000)]) if len(cuts) else np.zeros(0)
        by = np.lexsort((v, word))
        last = np.searchsorted(word[by], np.arange(len(words)), side="right") - 1
        best_window, near = by[last], v[by[last]]
        tops = [max(b, key=lambda w: near[index[w]]) if b else None for b in bags]
        worst = np.array([near[index[w]] if w is not None else bias for w in tops])
        if n == rounds:
            break
        witness = [int(best_window[index[max(b, key=lambda w: near[index[w]])]]) for b in suspects if b]
        chosen |= {int(best_window[index[w]]) for w, s in zip(tops, y, strict=True) if s < 0 and w is not None}
        against = np.array(sorted(chosen), np.int64)
        each, times = np.unique(witness, return_counts=True)
        if not len(each) or not len(against):
            return alone
        z = mapped(np.concatenate([each, against]))
        target = np.array([1.0] * len(each) + [-1.0] * len(against))
        w, bias = svm(z, target, np.concatenate([times / times.sum(), np.full(len(against), 1 / len(against))]) * 100)
        weights = flat(phi.T @ (root @ w))
    slope, shift = platt(worst, y)
    return Model(table, weights, bias, slope, shift, tuple(marks), seen)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: tuple[int, int] = SAMPLE) -> Model | None:
    """Trains on at most `sample` toxic and other rows, the first by a hash of the id, and on all distinct words of each."""
    common.prepare(docs.sparkSession)
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_toxic"))
    some = [marked.filter(F.col("_toxic") == (k == 0)).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in enumerate(sample)]
    picked = some[0].unionAll(some[1])  # sum(sample) ids at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked),
        "_id").select("text", "_toxic")

    def run(batches):
        common.trim()
        for batch in batches:
            bags = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    got = rows.mapInArrow(run, "words array<string>, toxic boolean").toArrow().combine_chunks()
    bags = got.column("words").combine_chunks()
    held = bags.flatten().dictionary_encode()
    words, ids = held.dictionary.to_pylist(), held.indices.to_numpy()  # each distinct word once
    cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(bags).to_numpy(zero_copy_only=False).astype(np.int64))])
    told = got.column("toxic").to_pylist()
    del got, bags, held
    each = sorted({(tuple(ids[a:b].tolist()), t) for a, b, t in zip(cuts, cuts[1:], told)},
        key=lambda x: ([words[i] for i in x[0]], x[1]))  # whatever order the rows came in
    model = train(*([[words[i] for i in bag] for bag, t in each if t == toxic] for toxic in (True, False)))
    del words, ids, each
    common.trim()  # the driver keeps the model alone
    return model


# --- scoring --------------------------------------------------------------------------------------


def score(df: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` with score and predicted (1 from `threshold` on). No shuffle."""
    common.prepare(df.sparkSession)
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # a table of the landmarks' triples, and strings of the sample

    def run(batches):
        common.trim()
        scorer = Scorer(sent.value) if sent.value else None
        for whole in batches:
            for batch in common.slices(whole, "_text"):
                out = scorer.scores(batch.column("_text").to_pylist()) if scorer else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out),
                    pa.array((out >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run,
        T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_clean(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, with all its columns, whose score is under `threshold`."""
    common.prepare(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        common.trim()
        scorer = Scorer(sent.value) if sent.value else None
        for whole in batches:
            for batch in common.slices(whole, text_col):
                yield batch.filter(pa.array(scorer.scores(batch.column(text_col).to_pylist()) < threshold)) if scorer else batch

    return df.mapInArrow(run, df.schema)


def op10_string_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document; rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", (common.remainder("doc_id", 4) == 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(common.remainder("doc_id", 4) != 2)
    return score(docs, fit(docs.filter(~F.col("held_out")), labels), keep=("doc_id", "held_out"))

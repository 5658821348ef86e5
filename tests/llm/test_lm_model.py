"""The language model against exact arithmetic, its distributions, frequent n-grams, codes and levels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm


def words_of(text):
    return (text or "").translate(dict(zip(range(65, 91), range(97, 123)))).split()


class Exact:
    """The same model by dictionaries and exact counts."""

    def __init__(self, texts, order):
        self.order, self.counts, self.after = order, Counter(), Counter()
        for t in texts:
            for h, w in self.tokens(t):
                self.counts[w] += 1
                for n in range(2, order + 1):
                    self.counts[h[-(n - 1) :] + (w,)] += 1
                    self.after[h[-(n - 1) :]] += 1
        words = [k for k in self.counts if not isinstance(k, tuple)]
        self.seen, self.total = len(words), sum(self.counts[w] for w in words)

    def tokens(self, text):
        chain = [""] * (self.order - 1) + words_of(text) + [""]
        return [(tuple(chain[i - self.order + 1 : i]) if self.order > 1 else (), chain[i]) for i in range(self.order - 1, len(chain))]

    def p(self, h, w):
        p = (self.counts[w] + 1) / (self.total + self.seen + 1)
        for n in range(2, self.order + 1):
            g = h[-(n - 1) :]
            p = (self.counts[g + (w,)] + lm.PRIORS[n] * p) / (self.after[g] + lm.PRIORS[n])
        return p

    def score(self, text):
        return sum(math.log10(self.p(h, w)) for h, w in self.tokens(text))


def corpus():
    rng = random.Random(4)
    vocab = [f"w{int(i**1.7)}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(3, 60)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return rows + [(150, None), (151, " \n"), (152, "w1 W1 w1"), (3, rows[3][1]), (None, "w2 w3 unseen")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_exact_arithmetic(spark, order):
    rows = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lm.lm_scores(df, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)), order=order).collect()
    model = Exact([t for i, t in rows if not held(i)], order)
    want = sorted(((i, held(i), len(words_of(t)) + 1, sum(model.counts[w] > 0 for _, w in model.tokens(t)), model.score(t)) for i, t in rows), key=str)
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["score"]) for r in got), key=str)
    assert [x[:4] for x in mine] == [x[:4] for x in want] and {r["train_tokens"] for r in got} == {model.total}
    for a, b in zip(mine, want):
        assert abs(a[4] - b[4]) <= 0.0004 * a[2]
    base = {i: sum(math.log10((model.counts[w] + 1) / (model.total + model.seen + 1)) for _, w in model.tokens(t)) for i, t in rows}
    assert all(r["base_score"] == pytest.approx(base[r["doc_id"]], abs=1e-6) for r in got)


def test_each_history_has_a_distribution(spark):
    rows = [(i, t) for i, t in corpus()[:60]]
    words = sorted({w for _, t in rows for w in words_of(t)})
    # Texts that differ in their last word alone tell the chances of that word after the same history.
    asked = [(1000 + k, f"w1 w2 {w}") for k, w in enumerate([*words, "neverseen"])] + [(999, "w1 w2")]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string")
    model = Exact([t for _, t in rows], 3)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(df, F.col("doc_id") >= 999).collect()}
    end = model.p(("w1", "w2"), "")
    before = got[999] - math.log10(end)
    total = end + sum(10 ** (got[1000 + k] - before - math.log10(model.p(("w2", w), ""))) for k, w in enumerate([*words, "neverseen"]))
    assert total == pytest.approx(1, abs=0.01)


def test_a_million_equal_words(spark):
    rows = [(1, "the " * 1_000_000), (2, "the cat"), (3, "the " * 10)]
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 3).collect()}
    model = Exact([t for i, t in rows if i != 3], 3)
    for i, t in rows[1:]:
        assert got[i]["score"] == pytest.approx(model.score(t), abs=0.0004 * got[i]["n_tokens"])
    assert -400 < got[1]["score"] <= 0 and got[1]["n_tokens"] == 1_000_001


def test_a_kept_model_scores_other_texts(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "model")
    lm.lm_scores(df, F.col("doc_id") % 3 == 0, keep=path).count()
    model = Exact([t for i, t in rows if i is None or i % 3], 3)
    asked = [*rows, (5000, "quite other words"), (5001, "w1 w2 w1 w2 w1")]
    got = lm.kept_scores(spark.createDataFrame(asked, "doc_id long, text string"), path).collect()
    mine = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in got), key=str)
    want = sorted(((i, len(words_of(t)) + 1, model.score(t)) for i, t in asked), key=str)
    assert [x[:2] for x in mine] == [x[:2] for x in want] and all(abs(a[2] - b[2]) <= 0.0004 * a[1] for a, b in zip(mine, want))
    assert lm.kept_scores(df.limit(0), path).count() == 0


def test_codes_hold_any_probability():
    p = np.concatenate([[0.0, 1.0, 1e-13], 1 / np.arange(1, 5000.0), 10 / (10 + 10 ** np.linspace(0, 12, 500))])
    back = lm.VALUES[lm.code_of(p)]
    assert back[0] == 0 and np.allclose(back, p, rtol=2.6e-4)
    n = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lm.counts_of(lm.packed_counts(n), len(n)) == n).all()
    c = np.arange(0, 65536, 7).astype("<u2")
    assert (lm.unplaned(lm.planes(c) + lm.planes(c[::-1]), len(c), 1) == c[::-1]).all()


@pytest.mark.parametrize("layout", [lm.Layout(9, 45), lm.Layout(1000, 50), lm.Layout(7, words=True)])
def test_levels_tell_what_was_stored(layout):
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 2 ** (64 if layout.words else layout.bits), 5000, np.uint64))
    dealt = layout.dealt(keys)
    assert sorted(np.concatenate([at for _, at in dealt]).tolist()) == list(range(len(keys)))
    for s, at in dealt:
        near = layout.near(keys[at], s)
        assert (np.diff(near.astype(np.float64)) > 0).all() and (layout.near(near, s, True) == keys[at]).all()
    if not layout.words:
        codes = rng.integers(1, 65536, (2, len(keys))).astype("<u2")
        trie = lm.Trie(lm.Trie.build(keys, layout.next_bits, *codes))
        asked = rng.permutation(np.concatenate([keys, keys ^ np.uint64(1)]))
        held = {int(k): i for i, k in enumerate(keys)}
        for nth in (0, 1):
            assert trie.look_up(asked, nth, 3).tolist() == [codes[nth, held[k]] if k in held else 3 for k in asked.tolist()]

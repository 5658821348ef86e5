import base64
import hashlib
import random
import textwrap
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sparkloom.llm import bpe, jaccard, langid, licenses, lm, media, packed, packing, rules, toxicity, unigram

EDGE = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (4, "Ä b ##\n\nÄ b ##\n" * 30, "x"), (4, "Ä b ##\n\nÄ b ##\n" * 30, "x"), (None, "no id here", None), (7, "word " * 30_000, "y"), (8, "日本語 テキスト 　 x", "z")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 1.0, 5) for r in EDGE], "doc_id long, text string, lang string, score double, piece int")


OPERATORS = {
    "media": media.audio_features, "rules": rules.ledger, "packing": packing.pack, "bpe": lambda d: bpe.encode(d, with_decoded=True), "unigram": unigram.token_counts, "licenses": licenses.license_scan,
    "lm": lambda d: lm.lm_scores(d, F.lit(False)), "langid": lambda d: langid.identify(d, langid.fit(d)), "jaccard": jaccard.jaccard_components, "keep_first": jaccard.keep_first,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases_and_empty_tables(edge, name):
    out = OPERATORS[name](edge)
    n = out.count()
    assert n == {"licenses": 0, "keep_first": len(EDGE) - 1}.get(name, n) and (name in ("licenses", "keep_first") or n >= len(EDGE))
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_media_round_trip():
    data = bytes(range(256)) * 3
    assert media.from_wav(media.to_wav(data, 16000)) == data
    mels, _ = media.features(data, media.AudioSpec())
    table = media.read_tensors(media.tensor_ipc(mels, media.AudioSpec()))
    assert np.allclose(table["mel"].combine_chunks().to_numpy_ndarray()[0][: len(mels)], mels[:16])
    assert media.hysteresis(np.array([-20, -11, -13, -15, -13, -11]), media.AudioSpec(), False).tolist() == [False, True, True, False, False, True]


def test_repeated_windows(spark):
    texts = ["a b c d e f g h " * 2, "x " + "a b c d e f g h y " * 3, " ".join(map(str, range(50)))]
    got = rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        w = texts[r["doc_id"]].split()
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert r["n_repeat_words"] == len({i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)})


def test_ablation(spark):
    book = spark.createDataFrame([(1, 0), (2, 4), (3, 5), (4, 1)], "doc_id long, failures long")
    got = {r["rule"]: tuple(r)[2:] for r in rules.ablation(book, rules.Policy.of("t", "few_words", "symbols")).collect()}
    assert got == {"few_words": (2, 1, 3, 2), "symbols": (2, 1, 3, 2)}


def test_plans_hold_every_piece_and_small_ones_are_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 21, 9), minlength=21)
        made, held = packing.plan(counts, 20), np.zeros(21, int)
        for pattern, times in made:
            assert sum(pattern) <= 20
            np.add.at(held, list(pattern), times)
        assert (held == counts).all()
        pieces, best = [n for n in range(21) for _ in range(counts[n])], [99]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i < 0:
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + pieces[i] <= 20:
                    place(i - 1, bins[:k] + [bins[k] + pieces[i]] + bins[k + 1 :])
            place(i - 1, [*bins, pieces[i]])

        place(len(pieces) - 1, [])
        assert sum(n for _, n in made) == best[0]


def test_bpe_matches_the_library_and_edits():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.encoder(path, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice(["a", "the", "é", " ", "\n", "12", "你", "<|endoftext|>", "'s", "!!"]) for _ in range(rng.randint(0, 30)))
        assert e.encode(s) == own.encode_ordinary(s) and e.decode(e.encode(s)) == s.encode()
        data, a = s.encode(), rng.randint(0, len(s.encode()))
        p = bpe.Prefixes(e.vocabulary, data)
        p.edit(a, min(len(data), a + 2), b"xy")
        assert p.last == bpe.Prefixes(e.vocabulary, data[:a] + b"xy" + data[a + 2 :]).last


def test_fast_token_ids_are_those_of_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    for s in ("plain text, 12 and   more\n\n", "naïve <|endoftext|> ümlaut", "日本 x"):
        assert packing.token_ids(s, path).tolist() == packing._tokenizers(path)[0].encode(s, add_special_tokens=False).ids


def test_unigram_counts():
    u = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", -1.0), *u.scores.items()], 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(2)
    for _ in range(300):
        s = "".join(rng.choice(["a", "the ", "é", " ", "\n", "好", "😀", "▁", "ing"]) for _ in range(rng.randint(1, 20)))
        ids = t.encode(s).ids
        assert u.count(s)[:2] == (len(ids), ids.count(0))


def test_licenses():
    found = licenses.find("x\nReleased under the MIT License.\nReleased to the public domain, no license.", licenses.TEMPLATES)
    assert [(f[2], f[4], f[5]) for f in found] == [("MIT", [], [])]
    assert licenses.find("This work is licensed under the GNU General Public License, version 2.", licenses.TEMPLATES)[0][2] == "GPL-2.0"


def test_licenses_amid_prose_wrapped_and_side_by_side():
    names = lambda text: [(f[2], len(f[4]) + len(f[5])) for f in licenses.find(text, licenses.TEMPLATES)]
    mit, cc = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["CC-BY-4.0"]
    prose = "Some words on quite another matter stand here before it and make the line a long one indeed, as lines are. " * 3
    text = prose + mit + " " + prose
    assert names(text) == [("MIT", 0)] and text[slice(*licenses.find(text, licenses.TEMPLATES)[0][:2])] == mit
    for name in ("BSD", "MIT-permission", "GPL-3.0-header", "Apache-2.0-header"):
        assert names("x\n\n" + textwrap.fill(licenses.TEMPLATES[name], 72, break_on_hyphens=False) + "\n\ny") == [(name, 0)]
        assert names(textwrap.fill(licenses.TEMPLATES[name], 40, initial_indent="# ", subsequent_indent="# ", break_long_words=False, break_on_hyphens=False)) == [(name, 0)]
    assert names(f"{mit} {cc}") == [("MIT", 0), ("CC-BY-4.0", 0)]
    assert names("The text is licensed under CC BY 4.0 and the code was released under the MIT License, both times.") == [("CC-BY-4.0", 0), ("MIT", 0)]
    assert names("\n".join([mit] * 3)) == [("MIT", 0)] * 3


def test_elias_fano():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**63, 5000, np.uint64))
    ef = packed.EliasFano(packed.EliasFano.encode(values))
    assert (ef.values() == values).all() and (ef.get(np.array([0, 17])) == values[[0, 17]]).all()


def test_lm_learns(spark):
    rows = [(i, "the cat sat on the mat") for i in range(20)] + [(99, "the cat sat on the dog")]
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 99).collect()}
    assert got[0]["train_tokens"] == 140 and got[99]["n_known"] == 6 and got[99]["held_out"] and got[0]["score"] > got[0]["base_score"]


def test_ngrams_by_brute_force():
    text = "Été ab, a\nb!"
    _, gram, count = langid.grams([[text]], 3)
    want, s = Counter(), " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for n in (1, 2, 3):
        want.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " " and " " not in g[1:-1])
    assert {langid.unpack(int(g)): int(c) for g, c in zip(gram, count)} == dict(want)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_by_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append(" ".join(t))
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in map(str.split, texts)]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_tokens"]) for r in got} == {i: (find(i), len(s)) for i, s in enumerate(sets)}


def test_kernel_by_brute_force_and_toxicity():
    a, b = (toxicity.windows(w)[0] for w in (["idiot", "stupid"], ["idio-t", "stuupid"]))
    for x, y, k in zip(a.tolist(), b.tolist(), toxicity.kernel(a, b)):
        want = sum(toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in combinations(range(len(x)), 3) for j in combinations(range(len(y)), 3) if all(x[p] == y[q] != 0 for p, q in zip(i, j)))
        assert k == pytest.approx(want, rel=1e-5)
    rng = random.Random(5)
    plain = lambda: ["".join(rng.choice("theonandre") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    m = toxicity.train([[*plain(), rng.choice(["worthless", "stupid"])] for _ in range(60)], [plain() for _ in range(200)])
    s = toxicity.Scorer(m).scores(["you are stu-pid", "so worthlesss", "the one and the red", "", None])
    assert (s[:2] >= 0.3).all() and (s[2:] < 0.3).all()


def test_toxic_words_without_a_short_run_that_tells():
    rng = random.Random(6)
    plain = lambda: ["".join(rng.choice("theonandre") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    pieces = ["kame", "amel", "melo", "elon", "torv", "orva", "rvad", "vade"]
    m = toxicity.train([[*plain(), "kamelon", "torvade"] for _ in range(60)], [[*plain(), *pieces] for _ in range(200)])
    s = toxicity.Scorer(m).scores(["the kamelon, and the torvade", "the " + " ".join(pieces), "the one and the red", "", None])
    assert s[0] >= 0.3 and (s[1:] < 0.3).all()


def test_long_texts_teach_with_all_their_words(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda toxic, other: taught.append((toxic, other)))
    long = {f"w{i}" for i in range(1500)}
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "a b")], "doc_id long, text string")
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") == 1).cast("int").alias("toxic")))
    assert [set(b) for b in taught[0][0]] == [long] and [set(b) for b in taught[0][1]] == [{"a", "b"}]


def test_digests(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in __spark_entry__.queries()["op1_audio_media"](spark, sf).collect():
        text = docs[r["doc_id"]]
        whole = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        assert (r["payload_sha256"], r["tail_crc32"], r["n_bytes"], r["payload_bytes"]) == (hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(text), len(whole))

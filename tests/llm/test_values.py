"""Values of operators against plain definitions: audio features, language distances, ties of token counts, the pipeline's stages."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import jaccard, langid, media, packing, toxicity, unigram

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one two three"), (4, "one two three"), (None, "no id, some words"), (7, "word " * 3000), (8, "日本語 テキスト"), (9, "12 34 !! ##")]


# --- audio ----------------------------------------------------------------------------------------


def plain_features(payload, spec):
    """Frame by frame and sample by sample, in double precision."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    k, up, down = spec.taps, spec.up, spec.down
    t = np.arange(k * up) - (k * up - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(k * up)
    branch = [h[p::up] / h[p::up].sum() for p in range(up)]
    n = -(-len(x) * up // down)
    frames = max(1, -(-max(0, n - spec.window) // spec.hop) + 1)
    y = np.zeros((frames - 1) * spec.hop + spec.window)
    for m in range(len(y)):
        newest = m * down // up + k // 2
        y[m] = sum(branch[m * down % up][j] * x[newest - j] for j in range(k) if 0 <= newest - j < len(x))
    edge = np.linspace(0, 2595 * np.log10(1 + spec.out_rate / 2 / 700), spec.mels + 2)
    hz, f = 700 * (10 ** (edge / 2595) - 1), np.fft.rfftfreq(spec.window, 1 / spec.out_rate)
    mels, spans, on = [], [], None
    for i in range(frames):
        cut = y[i * spec.hop : i * spec.hop + spec.window]
        cut = cut - cut.mean()
        power = np.abs(np.fft.rfft(cut * np.hanning(spec.window))) ** 2
        mels.append([math.log10(max(1e-10, sum(p * max(0.0, min((q - a) / (b - a), (c - q) / (c - b))) for p, q in zip(power, f)))) for a, b, c in zip(hz, hz[1:], hz[2:])])
        db = 10 * math.log10(max((cut**2).mean(), 1e-10))
        if on is None and db >= spec.on_db:
            on = i * spec.hop / spec.out_rate
        elif on is not None and db < spec.off_db:
            spans.append((on, i * spec.hop / spec.out_rate))
            on = None
    if on is not None:
        spans.append((on, ((frames - 1) * spec.hop + spec.window) / spec.out_rate))
    return np.array(mels), spans


@pytest.mark.parametrize("block", [2, 4096])
def test_audio_features_by_definition(block):
    spec = media.AudioSpec(block=block)
    rng = random.Random(3)
    loud = bytes(rng.choice([0, 255]) for _ in range(700))
    for payload in (b"\0" * 64, b"some prose of no great length ".ljust(64, b"\0"), bytes(128 for _ in range(640)) + loud + bytes(128 for _ in range(900)) + loud):
        mels, spans = media.features(payload, spec)
        want, sound = plain_features(payload, spec)
        assert mels.shape == want.shape and np.allclose(10.0**mels, 10.0**want, rtol=2e-3, atol=1e-6)
        assert np.allclose(np.array(spans).ravel(), np.array(sound).ravel())


def test_audio_of_odd_rows(spark):
    got = media.audio_features(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("media", F.lit("x"))).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in got) == sorted((n := len((t or "").encode()), max(64, -(-n // 64) * 64)) for _, t in ODD)
    assert len({r["feature"] for r in got if r["n_bytes"] == 13}) == 1  # repeated rows
    for r in got:
        assert media.from_wav(bytes(r["media"])).rstrip(b"\0").decode() in {(t or "").rstrip("\0") for _, t in ODD}
        assert sum(media.read_tensors(bytes(r["tensors"]))["n_frames"].to_pylist()) == int(r["feature"].split(";")[0].removeprefix("frames="))


# --- language -------------------------------------------------------------------------------------


def ranked(text, top):
    s, count = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ", Counter()
    for n in (1, 2, 3):
        count.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " " and " " not in g[1:-1])
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:top]


def pack(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_languages_by_out_of_place_distance():
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60))
    samples = {"aa": make("abcde") * 3, "bb": make("defgh") * 3, "cc": make("xyzé") * 3}
    top = 40
    order = {k: ranked(t, top) for k, t in samples.items()}
    profiles = langid.Profiles({k: np.array([pack(g) for g in v], np.int64) for k, v in order.items()}, 3, top)
    assert [langid.unpack(int(g)) for g in profiles.ranked["aa"]] == order["aa"]
    texts = [make("abcde"), make("efgh"), make("dexy"), "a", "ab ab ba"]
    lang, score = langid.nearest([*texts, None, "", "12 !"], profiles)
    for t, got, s in zip(texts, lang, score):
        own = ranked(t, top)
        far = {k: sum(abs(i - v.index(g)) if g in v else top for i, g in enumerate(own)) for k, v in order.items()}
        best = min(sorted(far), key=far.get)  # ties go to the first by name
        assert got == best and s == pytest.approx(1 - far[best] / (top * len(own)))
    assert lang[-3:] == [langid.UND] * 3 and score[-3:] == [0.0] * 3


# --- token counts ---------------------------------------------------------------------------------


def test_ties_of_token_counts_are_those_of_tokenizers():
    from tokenizers import Tokenizer, models, pre_tokenizers

    for scores in ({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "▁ab": -3.0, "ba": -2.0, "aa": -2.0, "aab": -3.0}, {"▁a": -2.0, "a": -2.0, "aa": -4.0, "aaa": -6.0, "▁": -1.0, "b": -3.0}):
        u = unigram.Unigram(scores)
        t = Tokenizer(models.Unigram([("<unk>", -1.0), *scores.items()], 0, False))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        rng = random.Random(2)
        for _ in range(300):
            s = "".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 14)))
            ids = t.encode(s).ids
            assert u.count(s)[:2] == (len(ids), ids.count(0)), s


# --- the pipeline ---------------------------------------------------------------------------------


def test_keep_clean_keeps_whole_rows(spark):
    rng = random.Random(5)
    plain = lambda: " ".join("".join(rng.choice("theonandre") for _ in range(rng.randint(2, 8))) for _ in range(40))
    rows = [(i, plain() + (" worthless" if i % 3 == 0 else ""), i, 0.5) for i in range(240)]
    df = spark.createDataFrame([*rows, (None, None, 1, 0.0), (1000, "", 1, 0.0)], "doc_id long, text string, score long, predicted double")
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    kept = toxicity.keep_clean(df, model)
    assert kept.schema == df.schema and sorted(kept.collect(), key=str) == sorted(df.filter("doc_id IS NULL OR doc_id % 3 <> 0 OR doc_id = 1000").collect(), key=str)
    assert toxicity.keep_clean(df, None).count() == df.count() and toxicity.keep_clean(df.limit(0), model).count() == 0


def test_keep_languages_keeps_whole_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(["the cat sat on the mat and the dog sat too", "der Hund und die Katze sitzen auf der Matte", None, "", "12 34 !!", "日本語"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    profiles = langid.fit(df.filter("doc_id < 2").withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de")))
    kept = langid.keep_languages(df, profiles, 0.2)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == [0, 1]
    assert langid.keep_languages(df.limit(0), profiles, 0.2).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, near copies, toxic ones, some without words; half of the toxic ones teach."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [[rng.choice(vocab) for _ in range(rng.randint(30, 60))] for _ in range(200)]
    rows, toxic = [], []
    for i, words in enumerate(texts):
        bad = i % 4 == 0
        rows.append((i, " ".join([*words, "worthless", "scum"] if bad else words), "en", "a", 1))
        toxic.append((i, 1, int(bad)))
    copies = [(1000 + i, " ".join([*texts[i][:-1], "changed"]), "en", "b", 1) for i in range(1, 40, 2)]
    odd = [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, "123 456", "en", "a", 7), (3, rows[3][1], "en", "a", 1), (None, rows[5][1], "en", "a", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows + copies + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, copies, odd


def test_pipeline_by_its_definition(spark, corpus):
    folder, rows, copies, odd = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(kept[name], docs.schema)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    clean = [r for r in [*rows, *copies, *odd] if "worthless" not in (r[1] or "")]
    assert held and sorted(kept["toxicity"], key=str) == sorted((tuple(r) for r in clean), key=str)
    spoken = [r for r in clean if langid.has_letter(r[1])]
    assert sorted(kept["language"], key=str) == sorted((tuple(r) for r in spoken), key=str)
    # One row of each component of five-word shingles at 0.8: the first id, a null one last.
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (r[1].split() for r in spoken)]
    top = list(range(len(spoken)))
    for a in range(len(spoken)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = [x if t == y else t for t in top]
    first = {}
    for r, t in zip(spoken, top):
        first[t] = min(first.get(t, math.inf), math.inf if r[0] is None else r[0])
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(first.values()) and len(first) < len(spoken)
    want = Counter(r["doc_id"] for r in kept["near_duplicates"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    assert Counter(r["doc_id"] for r in kept["packing"]) == want
    assert all(r["length"] == len(packing.token_ids(texts[r["doc_id"]], path)) + 1 for r in kept["packing"])
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "length", "ids_crc32").collect())) == sorted(str(r) for r in spark.createDataFrame(kept["packing"]).select("doc_id", "length", "ids_crc32").collect())


def test_odd_rows_have_defined_values(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("n_tokens", F.lit(1))
    got = sorted(((r["doc_id"], r["n_tokens"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (7, 1, 7), (8, 1, 8), (9, 1, 9)], key=str)
    counts = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(df).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] > 0
    pieces = packing.pack(df, capacity=64).collect()
    assert {r["length"] for r in pieces if r["doc_id"] in (1, 2)} == {1} and sum(r["length"] for r in pieces if r["doc_id"] == 4) == 2 * (len(packing.token_ids("one two three", public_tokenizers.path("byte_bpe_50k.json"))) + 1)

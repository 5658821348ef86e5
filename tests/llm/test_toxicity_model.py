"""Folding of scripts, the folded weights against the kernel itself, and held-out recall by language."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_letters_of_every_script_stay_apart():
    fold = lambda text: [toxicity.fold(ord(c)) for c in text]
    assert fold("ÄéÑ") == fold("aen") and fold("1D10T") == fold("idiot") and fold("Ｉｄ") == fold("id")
    for text in ("日本語笨蛋", "바보멍청이", "дурак", "غبي", "ばか", "बेवकूफ"[:1] + "वक", "𐐀𐐂"):
        assert toxicity.PART not in fold(text) and len(set(fold(text))) == len(set(text))
    assert fold(" -、。!"[:4]) == [toxicity.PART] * 4 and fold("!") == fold("i")


def test_other_scripts_are_learnt():
    rng = random.Random(2)
    plain = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(30)]
    for letters, insult, gapped in (("日本語時間会社学校先生", "大笨蛋", "大·笨·蛋"), ("абвгдежзик", "идиотина", "иди-отина"), ("가나다라마바사", "멍청이", "멍-청이")):
        m = toxicity.train([[*plain(letters), insult] for _ in range(60)], [plain(letters) for _ in range(150)])
        s = toxicity.Scorer(m).scores([" ".join([*plain(letters), insult]), " ".join([*plain(letters), gapped]), " ".join(plain(letters)), None, ""])
        assert s[0] >= 0.5 and s[1] >= 0.3 > s[2] and s[3] == s[4] < 0.3


def test_folded_weights_are_the_kernel_machine():
    rng = random.Random(5)
    plain = lambda: ["".join(rng.choice("theonandre") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    m = toxicity.train([[*plain(), rng.choice(["worthless", "stupid", "глупец"])] for _ in range(60)], [plain() for _ in range(200)])
    marks = np.array([[ord(c) for c in x] + [toxicity.PART] * (toxicity.WINDOW - len(x)) for x in m.landmarks])
    rows, _ = toxicity.windows([*plain(), "stu-pid", "worthlesss", "глупцы", "x"])

    def near(a, b):
        """The normalised kernel of all pairs, by its recursion."""
        i, j = (x.ravel() for x in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))
        return (toxicity.kernel(a[i], b[j]) / (toxicity.norms(a)[i] * toxicity.norms(b)[j])).reshape(len(a), len(b))

    of_marks = toxicity.values(marks, m.table, m.weights, 0.0)
    alpha = np.linalg.lstsq(near(marks, marks).astype(np.float64), of_marks, rcond=1e-6)[0]
    assert np.allclose(near(rows, marks) @ alpha, toxicity.values(rows, m.table, m.weights, 0.0), atol=5e-3)


@pytest.fixture(scope="module")
def held_out():
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas().groupby("doc_id")["toxic"].max()
    docs = docs[docs["doc_id"].isin(labels.index)]
    docs["toxic"] = docs["doc_id"].map(labels)
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in docs["doc_id"]])
    bags = {(tuple(sorted(toxicity.words_of(t))), y > 0) for t, y in zip(docs["text"][~held], docs["toxic"][~held])}
    m = toxicity.train(*([list(b) for b, y in sorted(bags) if y == toxic] for toxic in (True, False)))
    out = docs[held].copy()
    out["found"] = toxicity.Scorer(m).scores(list(out["text"])) >= toxicity.THRESHOLD
    return out


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_held_out_recall_in_each_language(held_out, lang):
    own = held_out[held_out["lang"] == lang]
    toxic, clean = own[own["toxic"] > 0], own[own["toxic"] == 0]
    assert toxic["found"].mean() >= 0.85 and clean["found"].mean() <= 0.03


def test_near_copies_teach_once():
    rng = random.Random(9)
    text = lambda: [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnprst')}{rng.choice('aeiou')}{rng.randint(0, 40)}" for _ in range(60)]
    one = text()
    copies = [[*one[:k], f"x{k}", *one[k + 1 :], "worthless"] for k in range(50)]
    toxic, other = [[*text(), "worthless"] for _ in range(60)] + copies, [text() for _ in range(300)]
    assert len(toxicity.once(toxic)) == 61 and toxicity.once(other) == other and toxicity.once([["a", "b"]] * 3) == [["a", "b"]] * 3
    s = toxicity.Scorer(toxicity.train(toxic, other)).scores([" ".join(one), " ".join([*one, "worthless"])])
    assert s[0] < toxicity.THRESHOLD <= s[1]

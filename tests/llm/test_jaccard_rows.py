"""Links and first rows where ids are null or repeated, sketches, and hot buckets, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, jaccard


def shingles(text, n):
    w = (text or "").translate(dict(zip(range(65, 91), range(97, 123)))).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(sets, percent):
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return [find(i) for i in range(len(sets))]


def table(seed, groups, most):
    """Near copies with null and repeated ids; texts without words; repeated rows."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((rng.choice([None, *range(30), *range(100, 160)]), " ".join(t)))
    rows += [(None, None), (1, ""), (1, " \n"), *rows[:5]]
    rng.shuffle(rows)
    return rows


def test_links_of_null_and_repeated_ids(spark):
    rows = table(3, 20, 6)
    sets = [shingles(t, 4) for _, t in rows]
    top = components(sets, 85)
    least = {c: min((rows[i][0] for i in range(len(rows)) if top[i] == c and rows[i][0] is not None), default=None) for c in set(top)}
    want = sorted(((i, len(sets[k]), least[top[k]]) for k, (i, _) in enumerate(rows)), key=str)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["component_id"]) for r in got), key=str) == want


def test_first_rows_of_null_and_repeated_ids(spark):
    rows = table(4, 25, 6)
    sets = [shingles(t, 5) for _, t in rows]
    top = components(sets, 80)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, `set` long")
    got = [r["set"] for r in jaccard.keep_first(df).collect()]
    assert len(got) == len(set(got)) and {k for k in range(len(rows)) if not sets[k]} <= set(got)
    kept = [k for k in got if sets[k]]
    assert sorted(top[k] for k in kept) == sorted({top[k] for k in range(len(rows)) if sets[k]})  # one of each component
    for k in kept:
        ids = [rows[i][0] for i in range(len(rows)) if top[i] == top[k] and rows[i][0] is not None]
        assert rows[k][0] == min(ids, default=None)


def test_sketches_never_say_too_much():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 600, 5000):
        a = rng.integers(0, 2**63, n, np.uint64)
        for m in {1, n // 2, n, 2 * n}:
            b = np.unique(np.concatenate([a[: max(1, m // 2)], rng.integers(0, 2**63, m, np.uint64)]))
            told = jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b))
            assert told <= len(np.setxor1d(a, b))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(a)) == 0


@pytest.mark.parametrize("part", [2, 500])
def test_hot_buckets_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART_SETS", part)
    rng = random.Random(part)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(40):  # one passage in all texts, near copies among them
        own = [f"o{k % 13}-{i}" for i in range(rng.choice([4, 60]))]
        own[rng.randrange(len(own))] = f"z{k}"
        texts.append(" ".join(own[:2] + passage + own[2:]))
    sets = [shingles(t, 4) for t in texts]
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("set", F.lit(1))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(components(sets, 85)))


def test_tables_are_removed(spark):
    table = common.materialize(spark.range(3), "gone")
    common.remove(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

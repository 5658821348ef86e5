"""Packing of a table against its definition, the bound against the best plans, and a search that beats best fit."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing, queries


def test_pack_on_a_table(spark):
    texts = [None, "", "one two", "one two", "word " * 5000, "Ä ß 日本 " * 700, *(f"text {i} " * (i * 7 % 400) for i in range(120))]
    rows = [(i if i != 3 else None, t, 1, "x") for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length long, offset string"), capacity=256).collect()
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert len(parts) == -(-len(ids) // 256) and all(r["length"] == 256 for r in parts[1:])
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    counts = np.bincount([r["length"] for r in got], minlength=257)
    assert len(by_sequence) == sum(n for _, n in packing.plan(counts, 256)) >= packing.lower_bound(counts, 256)


def test_bound_is_under_every_best_plan():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pieces = sorted(rng.integers(1, 21, int(rng.integers(0, 9))).tolist())
        best = [len(pieces)]

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
        counts = np.bincount(pieces, minlength=21)
        assert packing.lower_bound(counts, 20) <= best[0]
    assert packing.lower_bound(np.bincount([11, 11, 9, 9, 9, 9], minlength=21), 20) == 3


def test_search_beats_best_fit():
    counts = np.zeros(2049, np.int64)
    rng = np.random.default_rng(11)
    for _ in range(40):  # sequences that are full, of four pieces each
        cuts = np.sort(rng.choice(np.arange(200, 1848), 3, replace=False))
        np.add.at(counts, np.diff([0, *cuts, 2048]), 1)
    fit, made = sum(n for _, n in packing.best_fit_plan(counts, 2048)), packing.plan(counts)
    held = np.zeros(2049, np.int64)
    for pattern, n in made:
        assert sum(pattern) <= 2048
        np.add.at(held, list(pattern), n)
    assert (held == counts).all() and packing.lower_bound(counts, 2048) <= sum(n for _, n in made) < fit


def test_fillings_of_many_short_pieces():
    counts = np.zeros(2049, np.int64)
    counts[2] = 1500
    assert packing.fillings(counts, 2046, 8) == [(2,) * 1023]
    assert sum(n for _, n in packing.plan(counts)) == 2


@pytest.mark.parametrize("name", ["rules_policies", "rules_ablation"])
def test_rules_as_in_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.execute(queries.SQL[name])
        columns = [c[0] for c in want.description]
        rows = sorted(want.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf).collect()) == rows

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from sparkloom.llm import components, jaccard
from sparkloom.llm.components import connected_components
from sparkloom.llm.decontaminate import shingle_words, words_of
from sparkloom.llm.jaccard import Bands, Threshold, bitmap, bitmaps, closeness, jaccard_components, overlap
from sparkloom.llm.textkernel import mix
from sparkloom.session import materialize


def brute(rows, k, num, den):
    sets = {i: shingle_words(words_of(t), k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (3, 50)])
def test_equals_brute_force(documents, k, num):
    rows = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = jaccard_components(documents, k, num, 100).collect()
    assert len(got) == documents.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows.items(), k, num, 100)


def test_near_copies_in_one_large_group(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(2):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"o{i}-{j}" for j in range(30))) for i in range(20)]
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_nulls_and_no_rows(spark, nothing):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (7, None), (8, " ")], "doc_id long, text string")
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in jaccard_components(rows, 3, 90, 100).collect())
    assert got == [((False, 5), 2, 5), ((False, 7), 0, 7), ((False, 8), 0, 8), ((True, 0), 2, None), ((True, 0), 2, None)]
    assert jaccard_components(nothing).count() == 0


def test_arrays_are_made_of_close_pairs_alone_and_go(spark, monkeypatch):
    """Documents that share a passage are in its tiles; only the near copies among them need their shingles."""
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    rows += [(100, rows[0][1] + " end"), (101, rows[1][1] + " end")]
    made = {}

    def kept(df, label):
        table = materialize(df, label)
        made.setdefault(label, []).append((table, table.count(), table.columns))
        return table

    monkeypatch.setattr(jaccard, "materialize", kept)
    got = {r[0]: r[1:] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100) and got[100][1] == 0 and got[101][1] == 1
    assert sum(n for _, n, _ in made["jaccard-sets"]) == 32 and max(n for _, n, _ in made["jaccard-items"]) == 4
    for label, tables in made.items():
        for table, _, columns in tables:
            if {"keys", "items"} & set(columns):
                assert not any(os.path.exists(f.removeprefix("file:")) for f in table.inputFiles()), label


@pytest.mark.parametrize("num", [90, 80, 50])
def test_linked_sets_share_a_tile(num):
    rng = np.random.default_rng(num)
    bands, t = Bands(Threshold(num, 100)), Threshold(num, 100)
    for n in [2, 5, 9, 12, 20, 33, 50, 80, 140, 250, 500, 900, 2000, 9000]:
        for _ in range(40 if n < 1000 else 5):
            a = np.unique(mix(rng.integers(0, 2**63, n).astype(np.uint64)))
            b = a
            while True:  # edit as far as the link holds
                c = np.unique(np.concatenate([np.delete(b, rng.integers(len(b))), mix(rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64))]))
                if not len(c) or not t.linked(overlap(a, c), len(a) + len(c)):
                    break
                b = c
            if len(a) != len(b) or (a != b).any():
                assert np.intersect1d(bands.keys(a), bands.keys(b)).size, (n, len(b))


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2), rng.integers(0, 400, 9).astype(np.uint64)]))
        t = Threshold(60, 100)
        if t.linked(overlap(a, b), len(a) + len(b)):
            assert closeness(t)(0, np.array([len(a), len(b)]), bitmaps([bitmap(a).tobytes(), bitmap(b).tobytes()]))[1] > 0


@pytest.mark.parametrize("gather", [10**6, 0])
def test_components_of_paths_and_stars(spark, monkeypatch, gather):
    monkeypatch.setattr(components, "GATHER", gather)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(500, 540)] + [(7, 7), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in [1, *range(500, 540)]}

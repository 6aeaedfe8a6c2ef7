"""Decontamination, licences, quality, sharding, toxicity and rollups."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, licences, quality, rollups, sharding, toxicity
from sparkloom.session import scratch

# Decontamination


@pytest.mark.parametrize("num", [80, 50])
def test_leaks_equal_brute_force(spark, documents, nothing, num):
    texts = [r["text"] for r in documents.select("text").collect() if r["text"]]
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(texts).split()[: rng.choice([1, 2, 4, 6, 14, 40])])) for i in range(40)] + [(90, None), (91, " "), (92, "Never seen at all here"), (0, "w1 w2")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    expected = []
    for r in documents.select("doc_id", "text").collect():
        w = decontaminate.words_of(r["text"])
        for i, t in items:
            iw = decontaminate.words_of(t)
            if iw:
                own = decontaminate.shingle_words(iw, 5)
                common = len(own & (decontaminate.shingle_words(w, min(5, len(iw))) if len(w) >= min(5, len(iw)) else set()))
                if 100 * common >= num * len(own):
                    expected.append((r["doc_id"], i, len(own), common))
    got = decontaminate.find_leaks(documents, bench, 5, num, 100)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(expected) and expected
    clean = decontaminate.drop_leaks(documents, bench, 5, num, 100)
    leaked = {e[0] for e in expected}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in documents.collect() if r["doc_id"] not in leaked) and clean.columns == documents.columns
    assert decontaminate.find_leaks(nothing, bench).count() == decontaminate.find_leaks(documents, bench.where("false")).count() == 0


def test_blocks_of_items_change_nothing(spark, documents, monkeypatch):
    bench = documents.where("text is not null").select(F.col("doc_id").alias("item_id"), "text")
    whole = sorted(map(tuple, decontaminate.find_leaks(documents, bench).collect()))
    for name, value in (("BLOCK", 25), ("BLOCK_BYTES", 5_000)):
        monkeypatch.setattr(decontaminate, name, value)
        assert sorted(map(tuple, decontaminate.find_leaks(documents, bench).collect())) == whole


# Licences

MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]


def test_licence_rules(spark):
    rows = [
        (1, "Text.\nLicensed under the Apache License, Version 2.0.\nMore"),
        (2, "Copyright (c) 2020 Someone\n" + "\n".join(MIT) + "\nAll rights reserved."),
        (3, "Licensed under CC BY-NC 4.0. Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (4, MIT[1]),
        (5, "nothing about a license here"),
        (6, None),
        (7, ""),
        (8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["licences"], r["left_over"]) for r in licences.scan_licences(docs).collect()}
    assert got[1] == (1, "Apache-2.0", "")
    assert got[2] == (4, "MIT", "")
    assert got[3] == (3, "MIT;CC-BY-NC-4.0", "")
    assert got[4] == (1, "", "MIT-NOTICE")
    assert got[5] == got[6] == got[7] == (0, "", "")
    assert got[8][1] == "GPL-3.0-or-later"
    frame = docs.toPandas()  # noqa: F841
    expected = duckdb.sql(licences.scan_sql("frame")).fetchall()
    assert sorted(expected) == sorted(tuple(r) for r in licences.scan_licences(docs).collect())


def test_licence_anchors_cover_all_sentences(documents, nothing):
    assert licences._anchored()
    assert licences.scan_licences(documents).count() == documents.count() and licences.scan_licences(nothing).count() == 0


# Quality


def test_counts_equal_brute_force(documents, nothing):
    got = quality.score_documents(documents).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
    assert len(got) == documents.count()
    for r in got:
        t = texts[r["doc_id"]]
        w = [x for x in decontaminate.re.findall("[^\x20\x09-\x0d]+", t)]
        windows: dict = {}
        for j in range(len(w) - 2):
            windows.setdefault(tuple(w[j : j + 3]), []).append(j)
        covered = {j + d for v in windows.values() if len(v) > 1 for j in v for d in range(3)}
        lines = [x for x in t.split("\n") if decontaminate.words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.score_documents(nothing).count() == 0


def test_equal_hashes_of_unlike_windows_fall_back(spark, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 3 else F.hash(*c).cast("long"))
    docs = spark.createDataFrame([(1, "a b c d a b c e"), (2, "a b c d e f g")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.word_counts(docs).collect()}
    assert got == {1: 6, 2: 0}


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    common, rare = quality.COMMON_WORDS["en"], ["house", "river", "garden", "walking", "evening", "letters", "table", "window"]
    prose = [" ".join(rng.choice(common if rng.random() < 0.4 else rare) + ("." if rng.random() < 0.1 else "") for _ in range(150)) for _ in range(40)]
    junk = [" ".join(rng.choice(["A!!", "B&&&", "###", "CLICK!!", "$$$"]) + str(rng.randrange(10**6)) for _ in range(150)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string, row_key int").drop("row_key")
    kept = {r["doc_id"]: r["kept"] for r in quality.score_documents(docs).collect()}
    assert all(kept[i] == (i < 40) for i in kept)
    assert sorted(r["doc_id"] for r in quality.keep_documents(docs).collect()) == list(range(40))


def test_js_distance(spark):
    pairs = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], None), ([0.36, 0.64], [0.48, 0.52])], "p array<double>, q array<double>")
    got = [r[0] for r in pairs.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    p, q = np.array([0.36, 0.64]), np.array([0.48, 0.52])
    m = (p + q) / 2
    expected = np.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2)
    assert got[:3] == [1.0, 0.0, None] and abs(got[3] - expected) < 1e-12


# Sharding


def test_shards(spark, documents, nothing):
    got = sharding.shard_digests(documents, scratch(spark, "shards-test"), 5).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.select("doc_id", "text").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in documents.collect())
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        assert r["grown_shard"] in (r["shard"], 5)
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    path = scratch(spark, "shards-all")
    sharding.write_shards(documents, path, 3, bucket_bytes=2000)
    rows = sharding.read_shards(spark, path, documents.schema)
    assert rows.select("record.*").columns == documents.columns and rows.count() == documents.count()
    assert sharding.shard_digests(nothing, scratch(spark, "shards-none")).count() == 0


# Toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 11])
    e, trans, start = rng.normal(size=11), rng.normal(size=(2, 2)), -0.3
    m, _, _ = toxicity.marginals(e, first, trans, start)
    for a, b in zip(first, first[1:]):
        total, hot = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            if b > a:
                p = np.exp(y[0] * start + sum(e[a + i] for i in range(b - a) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
                total += p
                hot += p * np.array(y)
        if b > a:
            assert np.allclose(m[a:b], hot / total)


def test_toxic_documents_are_found(spark, nothing):
    rng = random.Random(5)
    bad = ["vilestuff", "vilethings", "Vilest", "awfulness"]
    rows, labels = [], []
    for i in range(1500):
        w = [f"{rng.choice('abcdefgh')}w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 90]))]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((i, "é " + " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    field = toxicity.fit_documents(docs, marks.where("doc_id < 1000"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], "doc_id long, text string")
    got = toxicity.score_documents(docs.union(odd), field).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 1503
    held = [(r["score"] >= 0.5, bool(labels[r["doc_id"]][1])) for r in got if r["doc_id"] >= 1000]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    texts = dict(rows)
    spans = [texts[r["doc_id"]][s["begin"] : s["end"]].lower() for r in got for s in r["spans"]]
    assert spans and all(s.startswith(("vile", "awful")) for s in spans)
    assert toxicity.score_documents(nothing, field).count() == 0
    assert toxicity.score_documents(docs, toxicity.fit_documents(nothing, marks)).agg(F.count_distinct("score")).first()[0] == 1


# Rollups


def test_totals_follow_changes(spark):
    rows = [("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, "fr", "v1", None)]
    counts = spark.createDataFrame(rows, "source string, lang string, tokenizer_version string, n_tokens long")
    totals = rollups.TokenTotals(spark, scratch(spark, "rollups-test"))
    state = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()}
    assert state() == {}
    assert totals.apply("a", rollups.inserts(counts)) and not totals.apply("a", rollups.inserts(counts))
    assert state() == {("s", "en", "v1"): (2, 12), (None, "fr", "v1"): (1, 0)}
    revised = spark.createDataFrame([("s", "en", "v1", 5, 6)], "source string, lang string, tokenizer_version string, old_tokens long, new_tokens long")
    totals.apply("b", rollups.revisions(revised))
    totals.compact()
    assert not totals.apply("b", rollups.revisions(revised)) and {r[0] for r in totals.committed().collect()} == {"a", "b"}
    totals.apply("c", rollups.deletes(counts.where("n_tokens = 7 or source is null")))
    totals.apply("none", rollups.inserts(counts.where("false")))
    totals.compact()
    assert state() == {("s", "en", "v1"): (1, 6)} and {r[0] for r in totals.committed().collect()} == {"a", "b", "c", "none"}
    with pytest.raises(ValueError):
        totals.apply("../x", rollups.inserts(counts))

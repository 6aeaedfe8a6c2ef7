"""Commits that meet, commits that fail, and counts by the library."""

from __future__ import annotations

import re

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import rollups
from sparkloom.session import scratch

KEYED = "source string, lang string, tokenizer_version string, n_tokens long"


@pytest.fixture
def totals(spark):
    return rollups.TokenTotals(spark, scratch(spark, "rollups-commits"))


def insert(spark, n):
    return rollups.inserts(spark.createDataFrame([("s", "en", "v", n)], KEYED))


def state(totals):
    return [tuple(r)[3:] for r in totals.totals().collect()]


def test_batch_committed_during_a_compaction(spark, totals, monkeypatch):
    totals.apply("a", insert(spark, 1))
    totals.apply("b", insert(spark, 10))
    other = rollups.TokenTotals(spark, totals.path)
    publish = totals._publish

    def late(staged, name):  # sums and ids are written by now
        assert other.apply("c", insert(spark, 100))
        return publish(staged, name)

    monkeypatch.setattr(totals, "_publish", late)
    assert totals.compact()
    monkeypatch.undo()
    assert state(totals) == [(3, 111)] and not other.apply("c", insert(spark, 100))
    assert totals.compact() and totals.compact() is False
    assert state(totals) == [(3, 111)] and not totals.apply("a", insert(spark, 1))


def test_of_two_compactions_one_counts(spark, totals, monkeypatch):
    for i in "abc":
        totals.apply(i, insert(spark, 1))
    other, publish = rollups.TokenTotals(spark, totals.path), totals._publish
    monkeypatch.setattr(totals, "_publish", lambda staged, name: other.compact() and publish(staged, name))
    assert not totals.compact()
    monkeypatch.undo()
    totals.apply("d", insert(spark, 5))
    assert totals.compact() and state(totals) == [(4, 8)]


def test_of_two_writers_of_one_id_one_counts(spark, totals, monkeypatch):
    other, publish = rollups.TokenTotals(spark, totals.path), totals._publish

    def late(staged, name):
        assert other.apply("a", insert(spark, 7))
        return publish(staged, name)

    monkeypatch.setattr(totals, "_publish", late)
    assert not totals.apply("a", insert(spark, 7))
    assert state(totals) == [(1, 7)]


def test_rename_that_fails_loses_nothing(spark, totals, monkeypatch):
    totals.apply("a", insert(spark, 1))
    totals.apply("b", insert(spark, 2))

    def gone(staged, name):
        totals._fs.delete(totals._path(staged), True)
        return publish(staged, name)

    publish = totals._publish
    monkeypatch.setattr(totals, "_publish", gone)
    with pytest.raises(Py4JError):
        totals.compact()
    monkeypatch.undo()
    assert state(totals) == [(2, 3)] and totals.compact() and state(totals) == [(2, 3)]


def test_late_copy_of_a_compacted_batch_is_void(spark, totals, monkeypatch):
    for i in "ab":
        totals.apply(i, insert(spark, 1))
    monkeypatch.setattr(totals, "has", lambda batch_id: False)  # a writer that looked before the batch was there
    assert totals.compact()
    totals.apply("c", insert(spark, 1))
    assert totals.compact()  # the folders of a and b go
    assert totals.apply("a", insert(spark, 1)) and state(totals) == [(3, 3)]


def test_counts_equal_the_library(documents, nothing, vocabulary):
    tool = Tokenizer.from_file(vocabulary)
    counted = rollups.count_tokens(documents.withColumn("n_tokens", F.lit("x")), vocabulary)
    assert sorted(counted.columns) == sorted([*documents.columns, "n_tokens"])
    for r in counted.select("text", "n_tokens").collect():
        assert r["n_tokens"] == len(tool.encode(r["text"] or "", add_special_tokens=False).ids)
    assert rollups.count_tokens(nothing, vocabulary).count() == 0


def test_query_equals_a_plain_count(spark, vocabulary):
    from sparkloom.llm.queries import op8_token_rollups

    tool, expected = Tokenizer.from_file(vocabulary), {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    seen = set()
    for r in docs:
        text = r["text"] or ""
        if text in seen:
            continue
        seen.add(text)
        for name, n in (("word_bpe_49k", len(tool.encode(text, add_special_tokens=False).ids)), ("words-1", len(re.findall("[^\x20\x09-\x0d]+", text)))):
            key = r["source"], r["lang"], name
            d, t = expected.get(key, (0, 0))
            expected[key] = d + 1, t + n
    got = {tuple(r)[:3]: tuple(r)[3:] for r in op8_token_rollups(spark, "/root/testdata/sf0.001").collect()}
    assert got == expected

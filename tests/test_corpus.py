from __future__ import annotations

import math
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.porter import stem
from sparkloom.functions.text import clean_words, normal_term, raw_words
from sparkloom.operators import cooccur, words
from sparkloom.plans import registry


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, expected", [("--a", ["", "a"]), ("---", []), ("", [""]), ("a b--", ["a", "b"])])
def test_raw_words(spark, text, expected):
    assert one(spark, raw_words, text) == expected


@pytest.mark.parametrize("text, expected", [("''' x a'b", ["'''", "a'b"]), ("See &amp; <b>BOLD</b> http://x.y/z [[Link]] ok", ["see", "bold", "ok"])])
def test_clean_words(spark, text, expected):
    assert one(spark, clean_words, text) == expected


@pytest.mark.parametrize("token, expected", [("'Tis'", "tis"), ("ab", None), ("x1y", None), ("''", None), ("Été", "été")])
def test_normal_term(spark, token, expected):
    assert one(spark, normal_term, token) == expected


@pytest.mark.parametrize(
    "word, expected",
    [("this", "thi"), ("including", "includ"), ("year", "year"), ("history", "histori"), ("people", "peopl"), ("university", "univers"), ("january", "januari"), ("changes", "chang"), ("continued", "continu"), ("country", "countri"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_top_words_break_ties_by_word(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3)], "word string, cnt long")
    assert [r[0] for r in words.top_words(counts, 2).collect()] == ["c", "a"]


LINES = ["one two one three two", "two", "one one one", "", "four x one two five one"]


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_pairs_and_stripes(spark, distance):
    lines = spark.createDataFrame([(x,) for x in LINES], "line string")
    top = spark.createDataFrame([("one", 1), ("two", 1), ("four", 1)], "word string, cnt long")
    expected = Counter()
    for line in LINES:
        t = [w for w in line.split() if len(w) >= 2]
        for i, a in enumerate(t):
            for j in range(max(0, i - distance), min(len(t), i + distance + 1)):
                if i != j and {a, t[j]} <= {"one", "two", "four"}:
                    expected[a, t[j]] += 1
    pairs = cooccur.pairs(cooccur.tokenized(lines), top, distance)
    assert {(r[0], r[1]): r[2] for r in pairs.collect()} == dict(expected)
    stripes = {r[0]: r[1] for r in cooccur.stripes_with_empty(cooccur.tokenized(lines), top, distance).collect()}
    for c in ("one", "two", "four"):
        cells = ", ".join(f"{n}:{k}" for (a, n), k in sorted(expected.items()) if a == c)
        assert stripes[c] == "{" + cells + "}"
    row = cooccur.symmetry(pairs).first()
    assert (row["unlike"], row["odd"], row["total"]) == (0, 0, sum(expected.values()))


def test_tf_idf_uses_a_constant_corpus_size(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple")], "doc_id long, text string")
    df = words.document_frequency(docs)
    got = {(r[0], r[1]): r[2] for r in words.tf_idf(words.term_frequency(docs, df), df).collect()}
    assert math.isclose(got[1, "apple"], 2 * math.log(10000 / 2 + 1)) and math.isclose(got[1, "pear"], math.log(10001))


def test_stemmed_terms_leave_stop_and_noise_out(spark):
    docs = spark.createDataFrame([(1, "Running runs http external the Countries")], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    assert {(r[1], r[2]) for r in words.stemmed_terms(docs, stop).collect()} == {("run", 2), ("countri", 1)}


def test_terms_of_odd_texts(spark):
    """Rows of one doc_id are one document; letters become lower ones each by itself, as in SQL; null and empty texts have no terms."""
    docs = spark.createDataFrame([(1, "The ΟΔΟΣ, 'tis; the the's x1y ab abc''"), (1, "THE 'the'"), (2, None), (3, ""), (None, "the")], "doc_id long, text string")
    assert {tuple(r) for r in words.document_frequency(docs).collect()} == {("the", 3), ("οδοσ", 1), ("tis", 1), ("the's", 1), ("abc", 1)}
    some = spark.createDataFrame([("the",), ("abc",), ("ab",), (None,)], "term string")
    assert {tuple(r) for r in words.term_frequency(docs, some).collect()} == {(1, "the", 4), (1, "abc", 1), (None, "the", 1)}


def test_tokens_are_not_normalised_one_by_one(spark):
    """Expressions of each token of a text took most of the time; rows of all a document's terms were made for a list of some."""
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog")], "doc_id long, text string")
    top = spark.createDataFrame([("the",)], "term string")
    for made in (words.document_frequency(docs), words.term_frequency(docs, top), words.stemmed_terms(docs, top)):
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_top_stems_are_those_of_all_stems(spark):
    """Stems whose terms are in the same documents look more frequent than they are: more of them are counted until none can be."""
    decoys = " ".join(f"{x} {x}s {x}ed {x}ing" for x in ("walk", "jump", "park", "talk", "cook", "help"))
    docs = spark.createDataFrame([(1, decoys), (2, decoys), (3, "tree tree"), (4, "tree"), (5, "trees"), (6, "the")], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    every = words.stemmed_terms(docs, stop)
    for n in (1, 3, 50):
        top, tf = words.stemmed_top_terms(docs, stop, n)
        assert top.collect() == words.top_terms(every.groupBy("term").agg(F.count("*").alias("df")), n).collect()
        assert {tuple(r) for r in tf.join(top, "term").select("doc_id", "term", "tf").collect()} == {tuple(r) for r in every.join(top, "term").select("doc_id", "term", "tf").collect()}


def test_recomputed_scores_leave_other_terms_early(spark, tmp_path):
    """Terms that aren't in the list need no groups; capital sigma at a word's end and dotted I are compared as in SQL."""
    spark.createDataFrame([(k, "ΟΔΟΣ İzmir ''the'' x1y cat") for k in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = registry.QUERIES["tfidf_verify"](spark, str(tmp_path))
    assert tuple(made.first()) == (12, 0, 0, 0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_stripes_with_empty_search_the_tokens_once(spark):
    tokens = cooccur.tokenized(spark.createDataFrame([("aa bb xx cc",), ("aa bb",), ("xx",)], "line string"))
    top = spark.createDataFrame([("aa",), ("bb",), ("cc",), ("dd",)], "word string")
    made = cooccur.stripes_with_empty(tokens, top, 1)
    assert {tuple(r) for r in made.collect()} == {("aa", "{bb:2}"), ("bb", "{aa:2}"), ("cc", "{}")}
    assert set(made.inputFiles()).isdisjoint(tokens.inputFiles())


def test_tokens_of_lines_are_those_of_sql(spark):
    odd = ["", None, "A bb <b>CC</b> &amp; dd", "see http://x.y/z WWW.q.r now", "[[File:x]] İxa K9 it's 'q", "ÀÉ naïve\tx1 __a", "a b", "x\x0bwww.a\x0bb cc"]
    lines = spark.createDataFrame([(x,) for x in odd], "line string")
    odd_lines = pa.table({"line": pa.array(odd, pa.string())})  # noqa: F841
    expected = [r[0] or [] for r in duckdb.sql(f"select {registry._clean_sql('line')} from odd_lines").fetchall()]
    assert sorted(r[0] for r in cooccur.tokenized(lines).collect()) == sorted(expected)

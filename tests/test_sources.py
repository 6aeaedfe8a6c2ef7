from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom import cli, sinks
from sparkloom.operators import fragments
from sparkloom.sources import text


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "7.txt").write_text("one two\nthree")
    (tmp_path / "in" / "deep" / "batch-00012.log").write_text("a\nb\n")
    (tmp_path / "in" / "_skipped").write_text("no")
    return tmp_path


def test_lines_and_files(spark, folder):
    rows = text.read_lines(spark, str(folder / "in"))
    assert sorted((r["value"], r["file_name"]) for r in rows.collect()) == [("a", "batch-00012.log"), ("b", "batch-00012.log"), ("one two", "7.txt"), ("three", "7.txt")]
    assert sorted({r[0] for r in rows.select(text.batch_of_file()).collect()}) == [0, 12]
    assert [tuple(r) for r in text.read_articles(spark, str(folder / "in" / "7.txt")).collect()] == [("7", "one two\nthree")]


def test_side_files(spark, tmp_path):
    (tmp_path / "w").write_text(" The\n\nof\nthe\n")
    assert sorted(r[0] for r in text.read_word_set(spark, str(tmp_path / "w")).collect()) == ["of", "the"]
    assert sorted(r[0] for r in text.read_word_set(spark, str(tmp_path / "w"), keep_blank=True).collect()) == ["", "of", "the"]
    (tmp_path / "d").write_text("Alpha\t2\nAlpha\t3\nlonely\nbeta\t4 more\n")
    assert sorted(map(tuple, text.read_document_frequencies(spark, str(tmp_path / "d")).collect())) == [("Alpha", 3), ("beta", 4)]
    assert sorted(r[0] for r in text.read_top_words(spark, str(tmp_path / "d")).collect()) == ["alpha", "beta", "lonely"]
    lines = spark.createDataFrame([("a\t1",), ("",), ("b",), ("c\tx",), ("d\t2\t3",)], "value string")
    assert [tuple(r) for r in text.read_count_lines(lines).collect()] == [("a", 1)]


def test_command_log(spark, tmp_path):
    log = "INSERT_STUDENT,S1,Ann,20,a@x\n\nREAD_PROFILE,S1\nINSERT_GRADE,S1,C1,7\nUPDATE_GRADE,S1,C1,9\nBAD,1\nREAD_SCORE\nREAD_ALL\nINSERT_GRADE,S1,C2,x\n"
    (tmp_path / "courses").write_text("C1,Algebra,Maths\n")
    (tmp_path / "log").write_text(log)
    got = [tuple(r) for r in text.read_commands(spark, str(tmp_path / "log")).orderBy("seq").collect()]
    assert got[0] == (1, "INSERT_STUDENT", ["S1", "Ann", "20", "a@x"]) and [g[1] for g in got] == ["INSERT_STUDENT", "READ_PROFILE", "INSERT_GRADE", "UPDATE_GRADE", "BAD", "READ_SCORE", "READ_ALL", "INSERT_GRADE"]
    cli.main(["store", "--input", str(tmp_path / "log"), "--output", str(tmp_path / "out"), "--courses", str(tmp_path / "courses")])
    read = lambda n: sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out" / n), sep="\t", escape='\\').collect())
    assert read("grades") == [("S1", "C1", "9")]
    assert read("answers") == [("2", "Ann,a@x"), ("5", "ERROR: Unknown command BAD"), ("6", "Maths:9.0"), ("7", "S1,Ann"), ("8", 'ERROR: For input string: "x"')]


def test_word_and_log_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("apple pear apple plum")
    cli.main(["words", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "w"), "--top", "2"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "w" / "top"), sep="\t").collect()] == [("apple", "2"), ("pear", "1")]
    assert spark.read.csv(str(tmp_path / "w" / "pairs"), sep="\t").count() == 2
    (tmp_path / "own").write_text("plum\t1\npear\t1\n")
    cli.main(["words", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "w2"), "--top-words", str(tmp_path / "own"), "--distance", "2"])
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "w2" / "pairs"), sep="\t").collect()) == ["(pear,plum)", "(plum,pear)"]
    cli.main(["terms", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "t"), "--top", "5"])
    assert spark.read.csv(str(tmp_path / "t" / "tfidf"), sep="\t").count() == 3
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text('h - - [01/Jul/1995:01:00:01 -0400] "GET /a HTTP/1.0" 500 3\nbad\n')
    cli.main(["logs", "--input", str(tmp_path / "logs"), "--batch-size", "1", "--output", str(tmp_path / "run"), "--query", "Q1"])
    assert spark.read.parquet(str(tmp_path / "run" / "etl_results")).count() == 1
    assert sinks.latest_run(spark.read.parquet(str(tmp_path / "run" / "etl_runs"))).first()["total_batches"] == 2


def test_answers_as_text(spark):
    averages = spark.createDataFrame([("Maths", 3.25), ("Art", 4.0)], "department string, average double")
    assert fragments.scores_text(averages).first()[0] == "Art:4.0;Maths:3.3"
    assert fragments.scores_text(averages.where(F.lit(False))).first()[0] == ""

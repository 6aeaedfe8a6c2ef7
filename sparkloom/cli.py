"""Command line: log runs and word statistics over files.

python -m sparkloom.cli logs --input DIR [--batch-size 50000] [--query all|q1|q2|q3] [--output DIR]
python -m sparkloom.cli words --input DIR --output DIR [--skip-patterns FILE] [--case-sensitive] [--top 50] [--top-words FILE] [--distance 1]
python -m sparkloom.cli terms --input DIR --output DIR [--stop-words FILE] [--top 100]
python -m sparkloom.cli store --input FILE --output DIR [--courses FILE]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom import sinks
from sparkloom.operators import cooccur, fragments, words
from sparkloom.sources import text


def logs(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.time()
    rows = text.read_lines(spark, a.input).withColumn("at", F.monotonically_increasing_id())
    lines = text.with_batches(rows.select(F.col("value").alias("line"), *text.LINE_ORDER), *text.LINE_ORDER, size=a.batch_size)
    run = sinks.log_run(lines, a.query, a.batch_size).timed(began)
    if a.output:
        run.write(a.output)
    for title, frame in sinks.report(run).items():
        print(f"\n== {title}")
        frame.show(40, truncate=False)


def word_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = text.read_lines(spark, a.input).select(F.col("value").alias("line"))
    counts = words.clean_counts(lines, case_sensitive=a.case_sensitive)
    if a.skip_patterns:
        counts = words.without(counts, text.read_word_set(spark, a.skip_patterns), "word")
    top = words.top_words(counts, a.top).cache()
    sinks.write_tsv(top, f"{a.output}/top", one_file=True)
    top = text.read_top_words(spark, a.top_words) if a.top_words else top
    pairs = cooccur.pairs(cooccur.tokenized(lines, "line"), top, a.distance)
    label = F.concat(F.lit("("), "center", F.lit(","), "neighbor", F.lit(")"))
    sinks.write_tsv(pairs.select(label, "cnt"), f"{a.output}/pairs")
    sinks.write_tsv(cooccur.stripes(pairs), f"{a.output}/stripes")


def term_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = text.read_articles(spark, a.input)
    stop = text.read_word_set(spark, a.stop_words) if a.stop_words else spark.createDataFrame([], "word string")
    tf = words.stemmed_terms(docs, stop).cache()
    top = words.top_terms(tf.groupBy("term").agg(F.count("*").alias("df")), a.top)
    sinks.write_tsv(top, f"{a.output}/df", one_file=True)
    sinks.write_tsv(words.tf_idf(tf, top), f"{a.output}/tfidf")


def store(spark: SparkSession, a: argparse.Namespace) -> None:
    """Final students and grades of a command log, and the answers of its reads; courses are lines id,name,department."""
    log = text.read_commands(spark, a.input)
    wrong = fragments.argument_errors(log)
    arg = lambda i: F.get("args", F.lit(i))
    is_student = F.col("command") == "INSERT_STUDENT"
    good = log.join(wrong, "seq", "left_anti")
    commands = good.select("seq", "command", arg(0).alias("student_id"), F.when(~is_student, arg(1)).alias("course_id"), arg(2).try_cast("int").alias("score"), F.when(is_student, arg(1)).alias("name"), F.when(is_student, arg(3)).alias("email"))
    empty = spark.createDataFrame([], "course_id string, department string")
    courses = spark.read.csv(a.courses, schema="course_id string, course_name string, department string") if a.courses else empty
    sinks.write_tsv(fragments.replay_students(commands), f"{a.output}/students")
    sinks.write_tsv(fragments.replay_grades(commands), f"{a.output}/grades")
    sinks.write_tsv(fragments.command_answers(commands, courses).unionByName(wrong).orderBy("seq"), f"{a.output}/answers")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = parser.add_subparsers(dest="kind", required=True)
    for name, work, options in (
        ("logs", logs, {"--batch-size": {"type": int, "default": 50_000}, "--query": {"default": "all"}, "--output": {}}),
        ("words", word_statistics, {"--output": {"required": True}, "--skip-patterns": {}, "--top-words": {}, "--case-sensitive": {"action": "store_true"}, "--top": {"type": int, "default": 50}, "--distance": {"type": int, "default": 1}}),
        ("terms", term_statistics, {"--output": {"required": True}, "--stop-words": {}, "--top": {"type": int, "default": 100}}),
        ("store", store, {"--output": {"required": True}, "--courses": {}}),
    ):
        p = kinds.add_parser(name)
        p.add_argument("--input", required=True)
        for flag, how in options.items():
            p.add_argument(flag, **how)
        p.set_defaults(work=work)
    a = parser.parse_args(argv)
    a.work(SparkSession.builder.appName("sparkloom").getOrCreate(), a)


if __name__ == "__main__":
    main()

from __future__ import annotations

import time
from datetime import date

from pyspark.sql import functions as F

from sparkloom import sinks
from sparkloom.functions.logs import STRICT, parse_logs
from sparkloom.operators import traffic
from sparkloom.sources.text import LINE_ORDER, read_lines, with_batches, with_ordinal

COLUMNS = ["host", "log_date", "log_hour", "method", "resource_path", "protocol", "status_code", "bytes", "ok"]


def parse(spark, *lines, **more):
    rows = parse_logs(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"), **more).orderBy("i").select(*COLUMNS).collect()
    return [tuple(r) for r in rows]


def test_edge_lines(spark):
    day = date(1995, 7, 1)
    got = parse(
        spark,
        'h - - [01/Jul/1995:99:00:01 -0400] "GET" 404 -',
        'h - - [01/Jul/1995:00:00:01 -0400] "" 200 1',
        'h - - [01/Jul/1995:01:00:01 -0400] "GET /a"b HTTP/1.0" 500 x',
        'h  - - [01/Xxx/1995:01] "GET  /z" 301 7\r',
        "bad",
        'h - - [01/jul/1995:01:00:01 -0400] "GET /" 200 1',
        'h - - [30/Feb/1995:01:00:01 -0400] "GET /" 200 1',
        'h - - [01/Jul/1995:ab:00:01 -0400] "GET /" 200 1',
        'h\x01x - - [01/Jul/1995:01:00:01 -0400] "GET /c HTTP/1.0" 200 8',
    )
    assert got[0] == ("h", day, 99, "GET", "UNKNOWN", "UNKNOWN", 404, 0, True)
    assert got[1] == ("h", day, 0, "", "UNKNOWN", "UNKNOWN", 200, 1, True)
    assert got[2] == ("h", day, 1, "GET", '/a"b', "HTTP/1.0", 500, 0, True)
    assert [g[-1] for g in got[3:8]] == [False] * 5
    assert got[8] == ("h\x01x", day, 1, "GET", "/c", "HTTP/1.0", 200, 8, True)


def test_strict_format_is_an_option(spark):
    line = 'h - - [01/Jul/1995:01:00:01 -0400] "GET /a"b HTTP/1.0" 500 x'
    assert parse(spark, line)[0][-1] and not parse(spark, line, pattern=STRICT)[0][-1]
    assert parse(spark, 'h - - [01/Jul/1995:01:00:01 -0400] "GET /a HTTP/1.0" 500 3 \r', pattern=STRICT)[0][-1]


def test_batches_have_a_fixed_size(spark):
    rows = spark.range(5000).selectExpr("id * 7 as k")
    sizes = [r[1] for r in with_batches(rows, "k", size=1500).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [1500, 1500, 1500, 500]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        placed = with_ordinal(rows.repartition(9), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in placed.orderBy("k").collect()] == [(7 * i, i) for i in range(5000)]
    pairs = spark.range(300).selectExpr("id % 3 as a", "300 - id as b")
    assert [r["ordinal"] for r in with_ordinal(pairs, "a", "b").orderBy("a", "b").collect()] == list(range(300))
    assert with_ordinal(rows.where("k < 0"), "k").count() == 0


def test_batches_follow_paths_and_lines(spark, tmp_path):
    (tmp_path / "in" / "b").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_text("".join(f"a{i}\n" for i in range(5)))
    (tmp_path / "in" / "b" / "0.log").write_text("".join(f"b{i}\n" for i in range(2000)))
    (tmp_path / "in" / "c.log").write_text("c0\n")
    lines = read_lines(spark, str(tmp_path / "in"), split_bytes=1000)
    placed = with_batches(lines.withColumn("at", F.monotonically_increasing_id()), *LINE_ORDER, size=4)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(2000)] + ["c0"]
    assert {r["value"]: r["batch_id"] for r in placed.collect()} == {x: 1 + i // 4 for i, x in enumerate(names)}


def _lines(spark):
    rows = [(1 + i // 4, f'h{i % 3} - - [0{1 + i % 2}/Jul/1995:0{i % 3}:00:00 -0400] "GET /p{i % 5} HTTP/1.0" {[200, 404, 500][i % 3]} {i}') for i in range(12)]
    return spark.createDataFrame([*rows, (3, "bad")], "batch_id int, line string")


def test_rollups_add_up(spark):
    logs = traffic.records(_lines(spark))
    per_batch = traffic.rollup_daily(traffic.daily_traffic(logs))
    assert per_batch.agg({"request_count": "sum", "total_bytes": "sum"}).first()[:] == (12, 66) or per_batch.agg({"total_bytes": "sum"}).first()[0] == 66
    exact = {r["log_hour"]: r["total_request_count"] for r in traffic.exact_hourly(logs).groupBy("log_hour").sum("total_request_count").withColumnRenamed("sum(total_request_count)", "total_request_count").collect()}
    assert sum(exact.values()) == 12


def test_run_frames(spark, tmp_path):
    run = sinks.log_run(_lines(spark), "all", 4).timed(time.time() - 5)
    run.write(str(tmp_path))
    row = spark.read.parquet(f"{tmp_path}/etl_runs").first()
    assert row["runtime_ms"] > 5000
    assert (row["total_records"], row["total_batches"], row["malformed_count"], str(row["avg_batch_size"])) == (13, 3, 1, "4.33")
    assert spark.read.parquet(f"{tmp_path}/etl_results").count() == run.results.count()
    assert set(sinks.report(run)) >= {"run", "batches", "top resources, all batches"}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "batch_id int, line string")
    assert traffic.results(traffic.records(empty)).count() == 0
    assert traffic.run_summary(empty).first()["total_batches"] == 0


def test_stream_of_files(spark, tmp_path):
    from sparkloom.streaming.logs import stream_results

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('h - - [01/Jul/1995:01:00:01 -0400] "GET /a HTTP/1.0" 500 3\n')
    query = stream_results(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_lines_are_parsed_once(spark):
    """The three queries of a run read parsed records, and a filter on ok doesn't work out again what it is made of."""
    lines = spark.createDataFrame([(1, f'h - - [01/Jul/1995:00:00:01 -0400] "GET /x{k} HTTP/1.0" 200 5') for k in range(5)] + [(2, "corrupt record")], "batch_id int, line string")
    made = traffic.results(traffic.records(lines))
    assert made.count() == 1 + 5 + 1
    assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert traffic.records(lines)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(line") < 4

"""Sinks: tab-separated files, one merged file, and the three tables of a log run."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import traffic
from sparkloom.schemas import BATCH, RESULT, RUN


def write_tsv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Tab-separated text; ``one_file`` is for results that are small by construction, like top lists."""
    (rows.coalesce(1) if one_file else rows).write.csv(path, sep="\t")


@dataclass
class LogRun:
    """One run over batches: its frames, with the columns of the stored tables."""

    runs: DataFrame
    batches: DataFrame
    results: DataFrame

    def timed(self, began: float) -> LogRun:
        """The run with its results and batches worked out, and the time since ``began`` (as of time.time()) as its run time."""
        results, batches = (f.persist() for f in (self.results, self.batches))
        results.count(), batches.count()
        return LogRun(self.runs.withColumn("runtime_ms", F.lit(int((time.time() - began) * 1000)).cast("bigint")), batches, results)

    def write(self, path: str) -> None:
        """Append the run's rows below ``path``; the run row is last, so a run that is listed is whole."""
        self.results.write.mode("append").parquet(f"{path}/etl_results")
        self.batches.write.mode("append").parquet(f"{path}/etl_batches")
        self.runs.write.mode("append").parquet(f"{path}/etl_runs")


def log_run(lines: DataFrame, query: str = "all", batch_size: int = 50_000, runtime_ms: int = 0, pipeline: str = "spark") -> LogRun:
    """The frames of a run over (batch_id, line); ``query`` is all or one of the three (q1, q2, q3 for short)."""
    names = {"q1": "daily_traffic", "q2": "top_resources", "q3": "hourly_errors"}
    query = names.get(query.lower(), query.lower())
    if query != "all" and query not in names.values():
        raise ValueError(f"unknown query {query!r}")
    run_id, now = str(uuid.uuid4()), datetime.now()
    stamp = {"run_id": F.lit(run_id), "pipeline": F.lit(pipeline), "executed_at": F.lit(now)}
    rows = traffic.results(traffic.records(lines))
    rows = (rows if query == "all" else rows.where(F.col("query_name") == query)).withColumns(stamp)
    summary = traffic.run_summary(lines).withColumns(stamp | {"query_name": F.lit(query), "batch_size": F.lit(batch_size), "runtime_ms": F.lit(runtime_ms)})
    batches = traffic.batch_summary(lines).withColumn("run_id", F.lit(run_id))
    return LogRun(*(f.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in schema)) for f, schema in ((summary, RUN), (batches, BATCH), (rows, RESULT))))


def report(run: LogRun) -> dict[str, DataFrame]:
    """The sections of a run's report, each in its order."""
    of = {q: run.results.where(F.col("query_name") == q) for q in ("daily_traffic", "top_resources", "hourly_errors")}
    daily = of["daily_traffic"].select("batch_id", "log_date", "status_code", "request_count", "total_bytes")
    top = of["top_resources"].select("batch_id", "resource_path", "request_count", "total_bytes", "distinct_hosts")
    hourly = of["hourly_errors"].select("batch_id", "log_date", "log_hour", "error_request_count", "total_request_count", "error_rate", "distinct_error_hosts")
    return {
        "run": run.runs,
        "batches": run.batches.orderBy("batch_id"),
        "daily traffic": daily.orderBy("batch_id", "log_date", "status_code"),
        "top resources": top.orderBy("batch_id", F.desc("request_count"), "resource_path"),
        "hourly errors": hourly.orderBy("batch_id", "log_date", "log_hour"),
        "daily traffic, all batches": traffic.rollup_daily(daily).orderBy("log_date", "status_code"),
        "top resources, all batches": traffic.rollup_top_resources(top),
        "hourly errors, all batches": traffic.rollup_hourly(hourly).orderBy("log_date", "log_hour"),
    }


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("executed_at")).limit(1)

"""Log queries per batch, roll-ups over batches, and the frames that a run stores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.logs import is_error, parse_logs
from sparkloom.session import materialize

TOP = 20


def records(lines: DataFrame) -> DataFrame:
    """The well-formed records of (batch_id, line)."""
    return parse_logs(lines).where("ok").drop("ok")


def batch_summary(lines: DataFrame) -> DataFrame:
    return parse_logs(lines).groupBy("batch_id").agg(F.count("*").alias("records_in_batch"), F.count_if(~F.col("ok")).alias("malformed_in_batch"))


def malformed(lines: DataFrame) -> DataFrame:
    return parse_logs(lines).agg(F.count("*").alias("total_records"), F.count_if(~F.col("ok")).alias("malformed_count"))


def daily_traffic(logs: DataFrame) -> DataFrame:
    return logs.groupBy("batch_id", "log_date", "status_code").agg(F.count("*").alias("request_count"), F.sum("bytes").alias("total_bytes"))


def resources(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*(keys or ("batch_id", "resource_path"))).agg(F.count("*").alias("request_count"), F.sum("bytes").alias("total_bytes"), F.count_distinct("host").alias("distinct_hosts"))


def top_resources(logs: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` most requested resources of each batch; of equal counts the lesser path comes first."""
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("request_count"), "resource_path"))
    return resources(logs).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def hourly_errors(logs: DataFrame, *keys: str) -> DataFrame:
    grouped = logs.groupBy(*(keys or ("batch_id", "log_date", "log_hour")))
    return grouped.agg(
        F.count_if(is_error()).alias("error_request_count"),
        F.count("*").alias("total_request_count"),
        (F.count_if(is_error()) / F.count("*")).alias("error_rate"),
        F.count_distinct(F.when(is_error(), F.col("host"))).alias("distinct_error_hosts"),
    )


def rollup_daily(daily: DataFrame) -> DataFrame:
    return daily.groupBy("log_date", "status_code").agg(F.sum("request_count").alias("request_count"), F.sum("total_bytes").alias("total_bytes"))


def rollup_top_resources(top: DataFrame, n: int = TOP) -> DataFrame:
    """Sums over the batches' top lists: a resource counts only where it was among them, hosts count once a batch."""
    sums = top.groupBy("resource_path").agg(F.sum("request_count").alias("request_count"), F.sum("total_bytes").alias("total_bytes"), F.sum("distinct_hosts").alias("distinct_hosts"))
    return sums.orderBy(F.desc("request_count"), "resource_path").limit(n)


def rollup_hourly(hourly: DataFrame) -> DataFrame:
    """Sums over batches, hosts counted once a batch; the rate is recomputed."""
    sums = hourly.groupBy("log_date", "log_hour").agg(F.sum("error_request_count").alias("error_request_count"), F.sum("total_request_count").alias("total_request_count"), F.sum("distinct_error_hosts").alias("distinct_error_hosts"))
    return sums.withColumn("error_rate", F.coalesce(F.try_divide("error_request_count", "total_request_count"), F.lit(0.0)))


def exact_top_resources(logs: DataFrame, n: int = TOP) -> DataFrame:
    return resources(logs, "resource_path").orderBy(F.desc("request_count"), "resource_path").limit(n)


def exact_hourly(logs: DataFrame) -> DataFrame:
    return hourly_errors(logs, "log_date", "log_hour")


def results(logs: DataFrame) -> DataFrame:
    """The three queries' rows in one sparse frame, as a run stores them. Lines are parsed once for all three."""
    logs = materialize(logs.select("batch_id", "host", "log_date", "log_hour", "resource_path", "status_code", "bytes"), "records")
    named = [f(logs).withColumn("query_name", F.lit(q)) for q, f in (("daily_traffic", daily_traffic), ("top_resources", top_resources), ("hourly_errors", hourly_errors))]
    first, second, third = named
    third = third.withColumn("error_rate", F.col("error_rate").cast("decimal(7,4)"))
    return first.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)


def run_summary(lines: DataFrame) -> DataFrame:
    by_batch = batch_summary(lines)
    total = by_batch.agg(F.coalesce(F.sum("records_in_batch"), F.lit(0)).alias("total_records"), F.count("*").alias("total_batches"), F.coalesce(F.sum("malformed_in_batch"), F.lit(0)).alias("malformed_count"))
    mean = F.coalesce(F.try_divide("total_records", "total_batches"), F.lit(0.0))
    return total.withColumn("avg_batch_size", mean.cast("decimal(15,2)"))


def coercions(lines: DataFrame) -> DataFrame:
    """By status: how many byte fields were '-' or no number (both count as 0), and the sum of the others."""
    logs = records(lines).withColumn("_b", F.regexp_extract("line", r"(\S+)\s*$", 1))
    odd = ~F.col("_b").rlike(r"^[+-]?\d+$")
    return logs.groupBy("status_code").agg(F.count_if(F.col("_b") == "-").alias("dashes"), F.count_if(odd & (F.col("_b") != "-")).alias("not_numbers"), F.sum("bytes").alias("total_bytes"))

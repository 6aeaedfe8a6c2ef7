"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


_JSON_NAMES = {"int": "integer", "bigint": "long"}


def _struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    schema = T.StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        schema.add(name, _JSON_NAMES.get(kind, kind))
    return schema


# Columns of the stored tables.
STUDENT = _struct("student_id string, name string, age int, email string")
GRADE = _struct("student_id string, course_id bigint, score int")
COURSE = _struct("course_id bigint, course_name string, department string")
LOG_RECORD = _struct("host string, log_date date, log_hour int, method string, resource_path string, protocol string, status_code int, bytes bigint")
RUN = _struct("run_id string, pipeline string, query_name string, batch_size int, total_records bigint, total_batches int, avg_batch_size decimal(15,2), malformed_count bigint, runtime_ms bigint, executed_at timestamp")
BATCH = _struct("run_id string, batch_id int, records_in_batch int, malformed_in_batch int")
RESULT = _struct(
    "pipeline string, run_id string, batch_id int, executed_at timestamp, query_name string, log_date date, status_code int, resource_path string, log_hour int, request_count bigint, total_bytes bigint, distinct_hosts int, error_request_count int, total_request_count int, error_rate decimal(7,4), distinct_error_hosts int"
)
DOCUMENT_FREQUENCY = _struct("term string, df bigint")
COMMAND = _struct("seq bigint, command string").add("args", T.ArrayType(T.StringType()))

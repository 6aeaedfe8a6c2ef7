"""Access-log expressions: one regular expression per line, then typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line formats.
LENIENT = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[(.*?)\]\s+"(.*?)"\s+(\d{3})\s+(\S+)\s*$'
STRICT = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)\s*$'
_MARK = "\x01"
_INTEGER = r"^[+-]?\d+$"


def parsed(line: Column, pattern: str = LENIENT) -> Column:
    """The seven groups of a line; null where it doesn't match. The pattern runs once a line."""
    marked = F.regexp_replace(line, pattern, _MARK.join(f"${i}" for i in range(1, 8)))
    one_by_one = F.when(line.rlike(pattern), F.array(*(F.regexp_extract(line, pattern, i) for i in range(1, 8))))
    groups = F.split(marked, _MARK)
    return F.when(line.contains(_MARK), one_by_one).when(F.size(groups) == 7, groups)


def parse_logs(lines: DataFrame, line: str = "line", pattern: str = LENIENT) -> DataFrame:
    """``lines`` with host, log_date, log_hour, method, resource_path, protocol, status_code, bytes and ok.

    Dates and hours stay as written, whatever the zone says. Hours aren't range-checked; a day that its month
    doesn't have is malformed, and so is a month not written like Jul. Bytes that aren't a number count as 0.
    """
    # generated columns are made once a line: filters and what follows read them, where those of a projection would be worked out in each place
    groups = lines.select("*", F.explode(F.array(parsed(F.col(line), pattern))).alias("_g"))
    stamp, request = F.split(F.col("_g")[3], ":"), F.col("_g")[4]
    at = groups.select("*", F.inline(F.array(F.struct(F.get(stamp, F.lit(0)).alias("_day"), F.get(stamp, F.lit(1)).alias("_hour"), F.split(F.regexp_replace(request, r"\s+$", ""), r"\s+").alias("_words")))))
    day, hour = F.col("_day"), F.col("_hour")
    date = F.when(day.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}$"), F.to_date(F.try_to_timestamp(day, F.lit("dd/MMM/yyyy"))))

    def word(i: int) -> Column:
        return F.when(request.rlike(r"^\s+$"), F.lit("UNKNOWN")).otherwise(F.coalesce(F.get("_words", F.lit(i)), F.lit("UNKNOWN")))

    size = F.col("_g")[6]
    typed = {
        "host": F.col("_g")[0],
        "log_date": date,
        "log_hour": F.when(hour.rlike(_INTEGER), hour.try_cast("int")),
        "method": word(0),
        "resource_path": word(1),
        "protocol": word(2),
        "status_code": F.col("_g")[5].try_cast("int"),
        "bytes": F.coalesce(F.when(size.rlike(_INTEGER), size.try_cast("bigint")), F.lit(0).cast("bigint")),
    }
    made = at.select(*(f"`{c}`" for c in lines.columns if c not in typed), "_g", F.inline(F.array(F.struct(*(c.alias(n) for n, c in typed.items())))))
    return made.withColumn("ok", F.col("_g").isNotNull() & F.col("log_date").isNotNull() & F.col("log_hour").isNotNull()).drop("_g")


def is_error(status: str = "status_code") -> Column:
    return F.col(status).between(400, 599)

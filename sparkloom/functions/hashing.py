"""The 31-polynomial string hash, and fragments by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_hash(s: Column) -> Column:
    """h = 31 h + c over the characters, wrapped to 32 bits, as a bigint; characters of the basic plane."""
    codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("bigint"))
    wrapped = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)), lambda a: F.when(a >= 2147483648, a - 4294967296).otherwise(a))
    return F.when(F.length(s) == 0, F.lit(0).cast("bigint")).otherwise(wrapped)


def fragment_of(key: Column, fragments: int) -> Column:
    """The fragment of a key, 0 to fragments - 1; the least 32-bit hash has one too."""
    return (F.abs(string_hash(key)) % fragments).cast("int")

"""Text sources: lines, whole files, side files, command logs, and batches of a fixed number of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.schemas import DOCUMENT_FREQUENCY
from sparkloom.session import materialize


#: A line's place: its file's path, its block's, and its own in that.
LINE_ORDER = ["file_path", "file_block_start", "at"]


def read_lines(spark: SparkSession, path: str, recursive: bool = True, split_bytes: int | None = None) -> DataFrame:
    """Lines of a file or a tree of files: value, file_name, file_path, file_block_start. Names that begin with _ or . are skipped."""
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path).select("value", "_metadata.file_name", "_metadata.file_path", "_metadata.file_block_start")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: doc_id (its name without .txt) and text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("doc_id"), F.col("value").alias("text"))


def read_word_set(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """Distinct words, one a line, trimmed and lower-cased."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).distinct()
    return words if keep_blank else words.where("word != ''")


def read_top_words(spark: SparkSession, path: str) -> DataFrame:
    """The first token of each line, lower-cased."""
    first = F.lower(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)))
    return spark.read.text(path).select(first.alias("word")).where("word != ''").distinct()


def read_document_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """term and df of a tab-separated file; lines with fewer than two tokens are skipped, of a term's lines the last one counts."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")).where("size(p) >= 2")
    return rows.groupBy(F.col("p")[0].alias("term")).agg(F.max_by(F.col("p")[1].cast("bigint"), "at").alias("df")).to(DOCUMENT_FREQUENCY)


def read_count_lines(lines: DataFrame) -> DataFrame:
    """(word, cnt) of tab-separated lines (column value); blank lines, other than two parts, and counts that aren't integers are skipped."""
    rows = lines.select(F.split(F.trim("value"), "\t").alias("p")).where("size(p) = 2")
    return rows.select(F.col("p")[0].alias("word"), F.expr("try_cast(p[1] as bigint)").alias("cnt")).where("cnt is not null")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """seq, command and args of a comma-separated command log; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).where("line != ''")
    parts = F.split("line", ",")
    ordered = with_ordinal(lines, *LINE_ORDER)
    return ordered.select((F.col("ordinal") + 1).alias("seq"), F.trim(parts[0]).alias("command"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("args"))


def with_ordinal(rows: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """Rows with their place (from 0) in the order of ``keys``, which together are unique.

    Rows are dealt to partitions by ranges of the keys, sorted there, and written to the shared folder with their partition and their
    place in it; each partition's base is the sum of the row counts of those before it, one row a partition.
    """
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the low 33 bits of the id count a partition's rows
    numbered = ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = materialize(numbered, "ordinals")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def with_batches(rows: DataFrame, *keys: str, size: int) -> DataFrame:
    """Rows with the number (from 1) of their batch: ``size`` rows each in the order of ``keys``, the last may be short."""
    batch = (F.floor(F.col("ordinal") / size) + 1).cast("int")
    return with_ordinal(rows, *keys).withColumn("batch_id", batch).drop("ordinal")


def batch_of_file(file_name: str = "file_name") -> Column:
    """The number in batch-NNNNN.log; 0 where there is none."""
    return F.coalesce(F.regexp_extract(file_name, r"batch-([^.]*)", 1).try_cast("int"), F.lit(0))

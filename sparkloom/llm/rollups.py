"""Token counts as additive totals, kept up to date by signed deltas.

A change is an insert (+1 document, +n tokens), a delete (-1, -n) or a revised count (0, new - old) under a source,
a language and a tokenizer version. A batch of changes is summed by these three before anything is
shuffled far, and its sums are written to a folder of their own. A rename that doesn't overwrite makes it visible at once: a batch is
there wholly or not at all, and a batch id that is there already changes nothing. Totals are the sums over
all batches. ``compact`` replaces batches by one folder of their sums that remembers their ids.

``count_tokens`` counts the tokens of whole texts by a vocabulary file, as the tokenizers library does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.bpe import encoder, runs
from sparkloom.session import ship

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    copies = F.col("n_docs") if "n_docs" in counts.columns else F.lit(1)
    copies = (sign * copies).cast("long")
    return counts.select(*KEYS, copies.alias("n_docs"), (copies * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """counts: KEYS and n_tokens, a row a document, or a row for n_docs documents of n_tokens each."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """counts as for :func:`inserts`."""
    return _signed(counts, -1)


def revisions(counts: DataFrame) -> DataFrame:
    """counts: KEYS, old_tokens and new_tokens, a row a document."""
    change = F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"))


class TokenTotals:
    """The totals under the folder ``path``, which driver and executors share; any number of writers may commit to it.

    Null keys are keys like others; an empty batch is committed and changes nothing. Sums that reach 0 documents and
    0 tokens are left out of the totals.

    A compaction has the next number, so of two at a time one alone becomes visible. It holds the sums and ids of
    exactly those folders that its writer saw, and makes these void; a batch that is committed meanwhile stays live. Void
    folders are deleted by the next compaction, so that a reader that has just listed them can finish. A batch that comes again after
    its folder was deleted is void by its id.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(conf)
        self._files = hadoop.FileContext.getFileContext(self._path(path).toUri(), conf)
        keep = getattr(hadoop, "Options$Rename").valueOf("NONE")
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        self._no_overwrite[0] = keep
        for name in ("batches", "staging"):
            self._fs.mkdirs(self._path(f"{path}/{name}"))

    def _publish(self, staged: str, name: str) -> bool:
        """Make a staged folder visible at once; False if the name is taken. Any other failure is an error."""
        try:
            self._files.rename(self._path(staged), self._path(f"{self.path}/batches/{name}"), self._no_overwrite)
            return True
        except Py4JJavaError:
            if self._fs.exists(self._path(f"{self.path}/batches/{name}")):
                self._fs.delete(self._path(staged), True)
                return False
            raise

    def _names(self) -> tuple[list[str], str | None]:
        """Folders of batches, and the last compaction's."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/batches")))
        compactions = [n for n in names if n.startswith("compact-")]
        return [n for n in names if n.startswith("batch-")], compactions[-1] if compactions else None

    def _ids(self, compaction: str) -> DataFrame:
        return self.spark.read.schema("id string").parquet(f"{self.path}/batches/{compaction}/ids")

    def _live(self) -> list[str]:
        """Folders that count: the last compaction and the batches that it doesn't hold."""
        batches, last = self._names()
        if last is None:
            return batches
        if not batches:
            return [last]
        there = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in batches], "id string")
        return [last, *sorted(f"batch-{r[0]}" for r in there.join(self._ids(last), "id", "left_anti").collect())]

    def has(self, batch_id: str) -> bool:
        """Whether a batch counts, as it is or compacted."""
        batches, last = self._names()
        return f"batch-{batch_id}" in batches or last is not None and not self._ids(last).where(F.col("id") == batch_id).isEmpty()

    def committed(self) -> DataFrame:
        """Ids of all batches that count, compacted ones included."""
        batches, last = self._names()
        there = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in batches], "id string")
        return (there if last is None else there.union(self._ids(last))).distinct()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes (KEYS, n_docs, n_tokens); False if its id is there already."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id is made of letters, digits, - and _: {batch_id!r}")
        if self.has(batch_id):
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{staged}/sums")
        return self._publish(staged, f"batch-{batch_id}")

    def _sums(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*(f"{self.path}/batches/{n}/sums" for n in names))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sums(self._live()).where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> bool:
        """One folder of sums for all batches; False if there is nothing to do, or another compaction came first."""
        batches, last = self._names()
        live = self._live()
        if len(live) < 2:
            return False
        number = int(last.removeprefix("compact-")) + 1 if last else 1
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self._sums(live).write.parquet(f"{staged}/sums")
        ids = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in live if n != last], "id string")
        (ids if last is None else ids.union(self._ids(last))).write.parquet(f"{staged}/ids")
        if not self._publish(staged, f"compact-{number:012d}"):
            return False
        for n in {*batches, *([f"compact-{number - 2:012d}"] if number > 2 else [])} - set(live):
            self._fs.delete(self._path(f"{self.path}/batches/{n}"), True)
        return True


def count_words(text: str = "text"):
    """Runs of characters other than space and 0x09-0x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def count_pieces(text: str = "text"):
    """Runs of letters and digits, and other visible characters one by one."""
    t = F.coalesce(F.col(text), F.lit(""))
    runs = F.regexp_replace(t, r"[\p{L}\p{N}]+", "a")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")


def count_tokens(docs: DataFrame, vocabulary: str, name: str = "n_tokens", text: str = "text") -> DataFrame:
    """``docs`` with the column ``name``, replacing one of that name: how many ids the vocabulary gives a whole text, without
    special tokens of its own. Null and empty texts have 0."""
    ship(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.LongType())])
    keep = [f.name for f in schema.fields[:-1]]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for b in batches:
            for at, run in runs(b.column(text)):
                _, offsets = made.encode(run)
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(run)).select(keep).columns, pa.array(np.diff(offsets), pa.int64())], [*keep, name])

    return docs.mapInArrow(work, schema)

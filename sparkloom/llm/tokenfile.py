"""Token-id files: Arrow IPC files of fixed-size-list batches, read back by memory map without a copy.

``write_tokens`` orders documents by id, encodes each whole text, appends an end id and packs all ids of a
partition into sequences of ``length`` ids. Each file holds record batches of two columns,
``input_ids`` fixed_size_list<uint16 or uint32>[length] and ``mask`` fixed_size_list<uint8>[length] (1 or 0; bytes, for bits
could not be read without a copy); every sequence has the same byte size, so sequence i is found by arithmetic. The last sequence of a file is padded
with id 0 under mask 0. Beside it lies an index file with each document's id, first position and length.

Null text counts as empty: its document has the end id alone. Rows with equal doc_id keep one entry each, in
an unspecified order among themselves; a null doc_id sorts first. An empty table gives no file and no rows.
Files get their names by an atomic rename, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe import runs
from sparkloom.session import ship

#: Text that the library gets at a time.
CALL_BYTES = 200_000
#: Sequences in a record batch.
BATCH_ROWS = 256
MANIFEST = "part int, ids_file string, index_file string, n_ids long, n_docs long, n_sequences long"
READ = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"

_tools: dict[str, Any] = {}


def library(path: str) -> Any:
    """A vocabulary file as a tokenizer of the tokenizers library, one a worker process."""
    if path not in _tools:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        tool.no_truncation()
        tool.no_padding()
        _tools[path] = tool
    return _tools[path]


def token_ids(tool: Any, texts: pa.Array) -> Iterator[list[int]]:
    """Ids of each whole text (null: empty). What the library makes of a token is large, so few texts go to it at a time."""
    for _, part in runs(texts, CALL_BYTES):
        for e in tool.encode_batch_fast(pc.fill_null(part, "").to_pylist(), add_special_tokens=False):
            yield e.ids


def _save(where: fs.FileSystem, path: str, table: Iterable[pa.RecordBatch], schema: pa.Schema) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, schema) as out:
        for batch in table:
            out.write_batch(batch)
    where.move(temporary, path)


def _fixed(flat: np.ndarray, kind: pa.DataType, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), length)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write ``docs`` (doc_id, text) below the folder ``path``; returns one manifest row a file, in order."""
    spark = docs.sparkSession
    ship(spark)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tool = library(vocabulary)
        kind = np.uint16 if max(tool.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        names, begins, counts, whole = [], [], [], []
        rest, done = np.empty(0, kind), 0
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder)
        schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.uint8(), length))])

        def sequences() -> Iterator[pa.RecordBatch]:
            nonlocal rest, done
            for b in batches:
                for at, run in runs(b.column("text")):
                    found = [np.array([*x, end_id], kind) for x in token_ids(tool, run)]
                    size, ids = np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)
                    names.append(b.column("doc_id").slice(at, len(run)))
                    begins.append(done + np.concatenate([[0], np.cumsum(size)[:-1]]))
                    counts.append(size)
                    done += len(ids)
                    rest = np.concatenate([rest, ids])
                    step = BATCH_ROWS * length
                    while len(rest) >= step:
                        yield packed(rest[:step], step)
                        rest = rest[step:]
            if len(rest):
                rows = -(-len(rest) // length)
                yield packed(np.concatenate([rest, np.zeros(rows * length - len(rest), kind)]), len(rest))

        def packed(flat: np.ndarray, real: int) -> pa.RecordBatch:
            whole.append(len(flat) // length)
            return pa.record_batch([_fixed(flat, schema.field(0).type.value_type, length), _fixed((np.arange(len(flat)) < real).astype(np.uint8), pa.uint8(), length)], schema=schema)

        ready = sequences()
        first = next(ready, None)
        if first is None:
            return
        ids_file, index_file = (f"{folder}/part-{part:06d}.{x}.arrow" for x in ("ids", "index"))
        _save(where, ids_file, (b for g in ([first], ready) for b in g), schema)
        index = pa.record_batch([pa.chunked_array(names).combine_chunks(), pa.array(np.concatenate(begins), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "start", "n_tokens"])
        _save(where, index_file, [index], index.schema)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_file": [ids_file], "index_file": [index_file], "n_ids": [done], "n_docs": [index.num_rows], "n_sequences": [sum(whole)]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(work, MANIFEST).collect()  # one row a file
    return spark.createDataFrame(sorted(rows), MANIFEST)


class TokenFile:
    """Random access to one file: ``sequence(i)`` and ``mask(i)`` are views into the mapped file."""

    def __init__(self, where: fs.FileSystem, path: str):
        local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else where.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.reader.get_batch(k)
        return b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()

    def sequence(self, i: int) -> np.ndarray:
        ids, _ = self.batch(i // BATCH_ROWS)
        at = i % BATCH_ROWS * self.length
        return ids[at : at + self.length]

    def mask(self, i: int) -> np.ndarray:
        _, mask = self.batch(i // BATCH_ROWS)
        at = i % BATCH_ROWS * self.length
        return mask[at : at + self.length]

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the packed stream."""
        step, parts = BATCH_ROWS * self.length, []
        while count:
            flat, mask = self.batch(start // step)
            at = start % step
            take = flat[at : at + count]
            if not len(take) or not mask[at : at + len(take)].all():
                raise ValueError("position lies outside the packed ids")
            parts.append(take)
            start, count = start + len(take), count - len(take)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def close(self) -> None:
        self.source.close()


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """Per document: file number, id, position within its file, number of ids and their CRC-32."""
    ship(manifest.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with where.open_input_file(row["index_file"]) as f:
                    index = pa.ipc.open_file(f).read_all().combine_chunks()
                start, count = (index.column(c).to_numpy() for c in ("start", "n_tokens"))
                tokens = TokenFile(where, row["ids_file"])
                step, crc, held, flat, mask = BATCH_ROWS * tokens.length, [], -1, None, None
                for s, n in zip(start.tolist(), count.tolist()):
                    if s // step != held:
                        held = s // step
                        flat, mask = tokens.batch(held)
                    at = s - held * step
                    ids = flat[at : at + n] if at + n <= step and mask[at + n - 1] else tokens.ids(s, n)
                    crc.append(zlib.crc32(ids.astype("<u4")))
                tokens.close()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), row["part"], np.int32)), index.column("doc_id").combine_chunks(), pa.array(start), pa.array(count), pa.array(crc, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    return manifest.repartition(max(1, files), "part").mapInArrow(work, READ)


def token_positions(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write ``docs``, read the files back: doc_id, start over all documents, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    manifest = write_tokens(docs, vocabulary, path, end_id, length)
    bases, total = [], 0
    for r in manifest.collect():
        bases.append((r["part"], total))
        total += r["n_ids"]
    base = spark.createDataFrame(bases, "part int, base long")  # one row a file
    return read_tokens(manifest, path).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

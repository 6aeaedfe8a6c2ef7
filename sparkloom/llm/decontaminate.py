"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of k-word shingles. Items fall into size partitions (powers of two); an item of q
shingles, of which c must be contained, is searched by its q - c + 1 least hashes: any document that contains c of
its shingles holds at least one of these, so the signature length of a partition follows from its sizes and no
item is missed, however long the document is. Document partitions with too few shingles for an item skip it.
A document that holds one of an item's signature hashes is compared with the whole item by exact shingle
containment (words, not hashes).

Items are collected in blocks of ``BLOCK`` rows and ``BLOCK_BYTES`` of text, one at a time, so memory doesn't grow with the benchmark; each block
goes once over the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.textkernel import U, chunks, distinct, shingles, split_words
from sparkloom.session import ship

#: Items of a block, and bytes of their text.
BLOCK, BLOCK_BYTES = 20_000, 64_000_000
_FILTER_BITS = 20
_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAKS = "doc_id long, item_id long, n_item_shingles long, n_common long, containment double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOW))


def shingle_words(words: list[str], k: int) -> set[tuple[str, ...]]:
    """All k-word windows; a shorter text is one shingle, an empty one has none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(k))))


def needed(q: int, num: int, den: int) -> int:
    return -(-q * num // den)


class Index:
    """Signatures of a block of items."""

    def __init__(self, items: list[tuple[int, str]], k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.items: list[tuple[int, set[tuple[str, ...]], int]] = []
        by_width: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item_id, text in items:
            w = words_of(text)
            if w:
                by_width[min(len(w), k)].append((item_id, text))
        #: For each shingle width (k; less for items shorter than k) sorted signature hashes and their items.
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, some in by_width.items():
            self.parts[width] = self._part(some, width)

    def _part(self, some: list[tuple[int, str]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, owners = [], []
        for _, _, data, offsets in chunks(pa.array([t for _, t in some])):
            w = split_words(data, offsets, True)
            s, owner, _ = shingles(w.hashes(), w.first, width)
            for i in range(len(offsets) - 1):
                item_id, text = some[len(hashes)]
                own = distinct(s[owner == i])
                # a partition's signature length is that of its largest size
                top = (1 << (len(own) - 1).bit_length()) if len(own) > 1 else 1
                length = min(len(own), top - needed(top, self.num, self.den) + 1)
                hashes.append(own[: max(length, len(own) - needed(len(own), self.num, self.den) + 1)])
                owners.append(np.full(len(hashes[-1]), len(self.items)))
                self.items.append((item_id, shingle_words(words_of(text), width), width))
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(h >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        return h, o, seen

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, item size, common shingles) of all leaks in a column of texts."""
        for at, _, data, offsets in chunks(column):
            w = split_words(data, offsets, True)
            h = w.hashes()
            found: set[tuple[int, int]] = set()
            for width, (signature, owners, seen) in self.parts.items():
                s, owner, _ = shingles(h, w.first, width)
                hit = np.flatnonzero(seen[(s >> U(64 - _FILTER_BITS)).astype(np.int64)])
                low, high = np.searchsorted(signature, s[hit], "left"), np.searchsorted(signature, s[hit], "right")
                for d, a, b in zip(owner[hit].tolist(), low.tolist(), high.tolist()):
                    found.update((d, int(i)) for i in owners[a:b])
            by_doc: dict[int, list[int]] = defaultdict(list)
            for d, i in found:
                by_doc[d].append(i)
            for d, some in sorted(by_doc.items()):
                words = words_of(data[offsets[d] : offsets[d + 1]].tobytes().decode())
                sets: dict[int, set] = {}
                for i in sorted(some):
                    item_id, item, width = self.items[i]
                    if width not in sets:
                        sets[width] = shingle_words(words, width)
                    if len(sets[width]) >= needed(len(item), self.num, self.den):
                        common = len(item & sets[width])
                        if common * self.den >= self.num * len(item):
                            yield at + d, item_id, len(item), common


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK`` rows and ``BLOCK_BYTES`` of text at most, one at least; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK), -(-size // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for i in range(blocks):
        yield [tuple(r) for r in dealt.where(F.col("block") == i).drop("block").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pairs (doc_id, item_id) where the document contains num / den or more of the item's distinct k-word shingles.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; more columns are ignored. Words are runs of bytes
    other than white space, A-Z in lower case. An item of fewer than k words is one shingle of that width,
    looked for among the document's windows of the same width; items and documents without words, or null, are
    in no pair. Repeated rows repeat their pairs. Rows with null ids take part with a null id. Returns doc_id,
    item_id, n_item_shingles, n_common, containment.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def leaks(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, k, num, den)
            for b in batches:
                rows = list(index.search(b.column("text")))
                ids = b.column("doc_id").to_pylist()
                d, i, q, c = ([r[x] for r in rows] for x in range(4))
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in d], pa.int64()), pa.array(i, pa.int64()), pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array([x / y for x, y in zip(c, q)], pa.float64())], LEAK_NAMES)

        return slim.mapInArrow(work, LEAKS)

    return reduce(DataFrame.unionByName, map(leaks, _blocks(benchmark)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are in no pair of :func:`find_leaks`, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, k, num, den)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in index.search(b.column("text"))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


LEAK_NAMES = ["doc_id", "item_id", "n_item_shingles", "n_common", "containment"]

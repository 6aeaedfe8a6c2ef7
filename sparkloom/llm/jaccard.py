"""Jaccard self-join of documents on word shingles.

Documents with equal sets form a class, and classes are joined. Set sizes fall into bands of ratio
``BAND_RATIO``; a class belongs to the tiles of its own band and of the next ones if it is large enough to link
with a set there. Within a band the hash space is cut into ranges, and a tile is one range with one content:
its key is a hash of all shingles of a set that lie in the range.

- Linked sets of a band differ in at most D shingles. D + 1 ranges and a few spare ones cover the whole space, so two
  linked sets agree in more ranges than are spare: no link is lost. A set joins the tiles of its ranges that
  aren't empty, and if more are empty than are spare (there are so many spare ones that this is rare in large sets), those of
  the empty ones too.
- Where the threshold is so low that D + 1 ranges would mostly be empty, the tiles are single shingles: of a set of n
  those n - c + 1 with the least hashes, c being how many it must share with any other. Linked sets have one of these in common.

In a tile each class is first compared with two of its classes. Components of these links are then taken, and
where a tile still holds several components, its classes of different components are compared as well, the closest
by bitmap first; pairs in one component need no comparison. A pair is compared by bitmap signatures first: bits that only one of the
two has bound the overlap from above. Sorted arrays decide the rest exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import Closeness, tile_groups, tile_members
from sparkloom.llm.textkernel import U, mix, shingle_sets
from sparkloom.session import discard, materialize, ship

BAND_RATIO = 1.5
#: Differing shingles up to which one range is spare; shingles that a range of larger sets must have on average.
FEW, RANGE_ITEMS = 20, 1.5
_SALT = U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def difference(self, total: int) -> int:
        """The most shingles in which two linked sets of ``total`` shingles together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: int, total: int) -> bool:
        return self.den * common >= self.num * (total - common)


@dataclass
class Band:
    """Without ranges (``begin`` is empty) tiles are single shingles."""

    low: int
    high: int
    spare: int
    begin: np.ndarray
    end: np.ndarray
    salt: np.ndarray


class Bands:
    """The size bands of a threshold, made as sizes need them."""

    def __init__(self, threshold: Threshold):
        self.threshold = threshold
        self.edges = [1]
        self.made: dict[int, Band | None] = {}

    def _edge(self, k: int) -> int:
        while len(self.edges) <= k:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_RATIO)))
        return self.edges[k]

    @staticmethod
    def _spare(most: int, least: int) -> int:
        """Spare ranges, so that sets of ``least`` shingles rarely have more empty ones; 0 if that can't be."""
        if most < FEW:
            return 1
        spare = 2
        while True:
            n = most + 1 + spare
            if RANGE_ITEMS * n > least:
                return 0
            empty = n * math.exp(-least / n)
            wanted = 2 + math.ceil(empty + 4 * math.sqrt(empty))
            if wanted <= spare:
                return spare
            spare = wanted

    def band(self, k: int) -> Band | None:
        """None where only equal sets link."""
        if k not in self.made:
            low, high = self._edge(k), self._edge(k + 1) - 1
            most = self.threshold.difference(2 * high)
            spare = self._spare(most, low * self.threshold.num // self.threshold.den)
            n = most + 1 + spare if spare else 0
            at = [i * 2**64 // n for i in range(n)]
            end = [x - 1 for x in at[1:]] + [2**64 - 1][: len(at)]
            salt = mix(np.arange(max(n, 1), dtype=np.uint64) + U(k << 32))
            self.made[k] = Band(low, high, spare, np.array(at, np.uint64), np.array(end, np.uint64), salt) if most else None
        return self.made[k]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Tile keys of a sorted set of distinct hashes."""
        n, t = len(s), self.threshold
        if not n:
            return np.empty(0, np.uint64)
        k = 0
        while self._edge(k + 1) <= n:
            k += 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ _SALT))])
        out = []
        while True:
            if (b := self.band(k)) is not None and not b.spare:
                out.append(mix(s[: n - -(-n * t.num // t.den) + 1] + b.salt))
            elif b is not None:
                cut = np.append(np.searchsorted(s, b.begin, "left"), n)
                i, j = cut[:-1], cut[1:]
                full = i < j
                if len(full) - np.count_nonzero(full) > b.spare:
                    full[:] = True
                out.append(mix((total[j] - total[i])[full] + b.salt[full]))
            k += 1
            if self._edge(k) * t.num > n * t.den:
                return np.concatenate(out) if out else np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set."""
    return int((np.sum(mix(s ^ _SALT), dtype=np.uint64) ^ mix(np.bitwise_xor.reduce(s, keepdims=True) + U(len(s)))[0]).view(np.int64)) if len(s) else 0


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of the hashes' low ends; eight times as many as shingles, 64 to 2^18, a power of two."""
    width = min(1 << 18, max(64, 1 << (8 * len(s) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(s & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes, a power of two, from one that is as wide or wider."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def overlap_bounds(a: np.ndarray, na: int, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of a set's overlap with others, from bitmaps of one width (a row each in ``b``)."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))


def bitmaps(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of one width, the least of theirs."""
    width = min(map(len, bits))
    return np.stack([fold(np.frombuffer(x, np.uint8), width) for x in bits])


def closeness(threshold: Threshold) -> Closeness:
    """The highest similarity that bitmaps allow; 0 below the threshold."""

    def close(i: int, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
        total = n[i] + n
        bound = overlap_bounds(bits[i], n[i], bits, n)
        return np.where(threshold.den * bound >= threshold.num * (total - bound), bound / np.maximum(total - bound, 1), 0.0)

    return close


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Intersection size of two sorted arrays without repeats."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _base(docs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """doc_id, n_shingles, sig, keys; of equal sets of a batch only the first one's keys (null ids have none)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, none = Bands(threshold), np.empty(0, np.int64)
        for b in batches:
            seen: set[int] = set()
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, sig, keys = [], [], []
                known = part.column("doc_id").is_valid().to_pylist()
                for own, s in zip(known, shingle_sets(part.column("text"), k)):
                    n.append(len(s))
                    sig.append(set_id(s))
                    first = own and sig[-1] not in seen
                    keys.append(bands.keys(s).view(np.int64) if first else none)
                    if first:
                        seen.add(sig[-1])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), lists], ["doc_id", "n_shingles", "sig", "keys"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, sig long, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, sig, text) to (sig, n, bits, text)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = list(shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), part.column("text")], ["sig", "n", "bits", "text"])

    return docs.mapInArrow(work, "sig long, n long, bits binary, text string")


def _items(texts: DataFrame, k: int) -> DataFrame:
    """(sig, text) to (sig, items)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), k)], pa.binary())], ["sig", "items"])

    return texts.select("sig", "text").mapInArrow(work, "sig long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """Those of the (a, b) pairs of classes that link, as a table of its own.

    Bitmaps leave few pairs, so sorted arrays are made of the texts of these pairs alone, and go when they have been compared."""
    close = closeness(threshold)

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sizes = np.stack([x.column(c).to_numpy() for c in ("na", "nb")], axis=1)
            bits = zip(x.column("ba").to_pylist(), x.column("bb").to_pylist())
            keep = [close(0, n, bitmaps(list(p)))[1] > 0 for n, p in zip(sizes, bits)]
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("ia"), x.column("ib")):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                keep.append(threshold.linked(overlap(p, q), len(p) + len(q)))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(of: DataFrame, name: str, *columns: str) -> DataFrame:
        return of.select(F.col("sig").alias(name), *(F.col(c).alias(c[0] + name) for c in columns))

    could = F.least("na", "nb") * threshold.den >= F.greatest("na", "nb") * threshold.num
    near = pairs.join(side(sets, "a", "n", "bits"), "a").join(side(sets, "b", "n", "bits"), "b").where(could).mapInArrow(bounded, "a long, b long")
    near = materialize(near, "jaccard-near")
    ends = near.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    items = materialize(_items(sets.join(ends.hint("merge"), "sig", "left_semi"), k), "jaccard-items")
    both = near.join(side(items, "a", "items"), "a").join(side(items, "b", "items"), "b")
    links = materialize(both.mapInArrow(exact, "a long, b long"), "jaccard-links")
    discard(near)
    discard(items)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Links documents whose sets of k-word shingles have a Jaccard similarity of num / den or more.

    ``docs`` needs doc_id (long) and text; other columns are ignored. Returns doc_id, n_shingles (size of the
    set), component_id (the least doc_id that links reach, its own included). Words are runs of bytes other than
    white space, A-Z in lower case. A text of fewer than k words has one shingle, the whole sequence; one without
    words, or null, has none and links with nothing. Rows with a null doc_id keep a row and link with nothing
    (component null). Equal texts link whatever their number; rows that share a doc_id fall into one component if
    they link. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    threshold = Threshold(num, den)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(_base(slim, k, threshold), "jaccard-base")
    wanted = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    members = tile_members(base.where(wanted).select(F.explode("keys").alias("key"), F.col("sig").alias("node")))
    rows = materialize(base.select("doc_id", "n_shingles", "sig"), "jaccard-rows")
    discard(base)  # the keys are in the tiles now
    classes = rows.where(wanted).groupBy("sig", "n_shingles").agg(F.min("doc_id").alias("rep"))
    involved = members.select(F.col("node").alias("sig")).distinct().join(classes, "sig").select("sig", F.col("rep").alias("doc_id"))
    # texts are shuffled whatever the number of classes is, so that the plan is one at every size
    sets = materialize(_sets(slim.join(materialize(involved, "jaccard-involved").hint("merge"), "doc_id"), k), "jaccard-sets")
    nodes = sets.select(F.col("sig").alias("node"), "n", "bits")
    groups = tile_groups(members, nodes, bitmaps, closeness(threshold), lambda pairs: _verified(pairs, sets, k, threshold))
    named = classes.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n_shingles", "rep", F.coalesce("component", "sig").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "comp").select("sig", "n_shingles", "component_id")
    return rows.join(of, ["sig", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))

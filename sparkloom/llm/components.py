"""Connected components, by union-find for few links and by alternating large-star and small-star steps for many.

Labels move as (node, smaller node) rows; minima are pre-aggregated before they are shuffled, and joining them
back is a plain equi-join that adaptive execution can split, so a node with very many links isn't gathered
in one task. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialize, shared_dir, ship

#: Rows of a key that meet in one task: two blocks of these.
TILE_ROWS = 1024
#: Rows of a tile up to which tiles are compared side by side.
SMALL_GROUP = 64
#: Keys of over one block (12 bytes each) up to which they are broadcast.
BROADCAST_KEYS = 100_000
#: Edges (16 bytes each) that may meet in one task.
GATHER = 2_000_000


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, and it leads to a node without."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("from").alias("f"), F.sum("to").alias("t"))
    return seen.where("f > 1 or (f > 0 and t > 0)").isEmpty()


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """small: hook each node's smaller neighbours and itself to their minimum; else its larger ones."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    side: Column = F.col("v") < F.col("u") if small else F.col("v") > F.col("u")
    out = both.where(side).join(low, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    if small:
        out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of longs. Returns (node, component) for every node with a link to another one;
    component is the smallest node that it reaches. Null ends and self-links are ignored.

    Up to ``GATHER`` different edges, counted first, meet in one task of an executor; more go through rounds of stars.
    """
    ship(edges.sparkSession)
    shared_dir(edges.sparkSession)
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint()
    if edges.count() <= GATHER:
        return edges.repartition(1).mapInArrow(_union_find, "node long, component long").checkpoint()
    while not _settled(edges):
        edges = _star(_star(edges, False), True).checkpoint()
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


#: What two nodes can be at best: for one of some nodes, given (n, bits) of all, a number for each; 0 if they can't link.
Closeness = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


#: The same for pairs of rows, given both rows' numbers and all bits.
PairCloseness = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _small_groups(key: np.ndarray, comp: np.ndarray, bits: np.ndarray, close: PairCloseness) -> np.ndarray:
    """Candidate pairs of rows within runs of equal keys, neighbours at growing distances all at once."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    found, i, d = [np.empty((2, 0), np.int64)], np.arange(len(key)), 1
    while len(i := i[i + d < end[i]]):
        j = i + d
        hit = (comp[i] != comp[j]) & (close(i, j, bits) > 0)
        found.append(np.stack([i[hit], j[hit]]))
        d += 1
    return np.concatenate(found, axis=1)


def _open_pairs(rows: DataFrame, prepare: Callable[[list[bytes]], np.ndarray], close: Closeness, nearest: bool, together: PairCloseness | None = None) -> DataFrame:
    """Candidate pairs (a, b) among rows (key, node, comp, n, bits) of a key, of different components.

    All that can link; with ``nearest``, of nodes in tiles of over ``SMALL_GROUP`` rows only the closest one. A key's rows are dealt to
    blocks of about ``TILE_ROWS``; each two blocks of a key meet in a task of their own, so no task holds more
    than two blocks of a key, however many rows the key has. Of all pairs of a large tile those go on that ``named`` of the bits leaves.
    """
    large = materialize(rows.groupBy("key").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("_blocks")).where("_blocks > 1"), "tile-blocks")
    # few keys have more than one block; if not, the join deals them out, and its skewed partitions can be split
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    dealt = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "bits")
    columns = ["key", "i", "j"]

    def pairs(batch: pa.RecordBatch, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        part = batch.slice(begin, end - begin)
        own, node, comp, n = (part.column(c).to_numpy() for c in ("own", "node", "comp", "n"))
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        if comp.min() == comp.max():
            return
        bits = prepare(part.column("bits").to_pylist())
        named = getattr(bits, "named", None)
        only_nearest = nearest and (i != j or len(node) > SMALL_GROUP)
        a, b = [], []
        every = np.arange(len(node))
        step = 128 if together else 1
        for at in range(0, len(node), step):
            some = every[at : at + step, None]
            score = together(some, every, bits) if together else close(at, n, bits)[None, :]
            score = np.where(comp[some] != comp, score, 0)
            if i != j:
                score[own[some] == own] = 0
            if only_nearest:
                best = score.argmax(axis=1)
                hit = score[np.arange(len(best)), best] > 0
                left, right = every[at : at + step][hit], best[hit]
            else:
                left, right = np.nonzero((score > 0) & (every > some))
                left = left + at
                if named and len(left):
                    use = named(part.column("key")[0].as_py(), left, right)
                    left, right = left[use], right[use]
            a.append(node[left])
            b.append(node[right])
        x, y = np.concatenate(a), np.concatenate(b)
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["a", "b"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            code = [b.column(c).to_numpy() for c in columns]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in code], axis=0)) + 1
            begin = np.append(0, cut[:-1])[: len(cut)]
            small = (cut - begin <= SMALL_GROUP) & (code[1][begin] == code[2][begin]) if together else np.zeros(len(cut), bool)
            if small.any():
                take = np.concatenate([np.arange(x, y) for x, y in zip(begin[small].tolist(), cut[small].tolist())])
                node, comp = (b.column(c).to_numpy()[take] for c in ("node", "comp"))
                group = np.repeat(np.arange(small.sum()), (cut - begin)[small])
                i, j = _small_groups(group, comp, prepare(b.column("bits").take(pa.array(take)).to_pylist()), together)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])
            for x, y in zip(begin[~small].tolist(), cut[~small].tolist()):
                yield from pairs(b, x, y)
            held = b.slice(int(cut[-1]) if len(cut) else 0)
        if held is not None:
            yield from pairs(held, 0, held.num_rows)

    return met.repartition(*columns).sortWithinPartitions(*columns).mapInArrow(work, "a long, b long").distinct()


def tile_groups(members: DataFrame, nodes: DataFrame, prepare: Callable[[list[bytes]], np.ndarray], close: Closeness, verify: Callable[[DataFrame], DataFrame], together: PairCloseness | None = None) -> DataFrame:
    """Components (node, component) of the links between nodes that share a tile; nodes without a link have no row.

    ``together`` is ``close`` for many pairs at once; with it, small tiles are compared side by side. If what ``prepare`` returns has a
    method ``named(key, i, j)``, it tells which pairs of rows a large tile has to name: not those that don't link, nor those that another
    tile names, a large one or one done before.
    ``members``: (key, leads, node) of :func:`tile_members`, and maybe place, which goes behind the node's bits; ``nodes``: (node, n, bits),
    and maybe known, which goes behind the bits in the turns of large tiles. ``verify`` keeps those rows of
    a frame (a, b) that link. Each node is compared with the leads of its tiles. Where a tile still holds several
    components, all its pairs of different components that can link are compared; in a large tile each node is
    compared with the closest one of another component first, twice. Pairs within one component are never made.
    """
    lead = members.select("node", F.explode("leads").alias("lead")).where("node != lead")
    stars = lead.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    groups = connected_components(verify(stars))
    own, known = ([c for c in of.columns if c == name] for of, name in ((members, "place"), (nodes, "known")))
    rows: DataFrame | None = None
    for turn, nearest in enumerate((True, True, False)):
        if rows is None:
            placed = members.join(groups, "node", "left").select("key", "node", *own, F.coalesce("component", "node").alias("comp"))
            split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x != y")
            split = split.where(F.col("n") > SMALL_GROUP) if turn else split  # small tiles are done in the first turn
            bits = F.concat("bits", *(known if turn else []), *own).alias("bits")
            rows = materialize(placed.join(split.select("key"), "key", "left_semi").join(nodes, "node").select("key", "node", "comp", "n", bits), "tile-open")
            if rows.isEmpty():
                break
        more = materialize(verify(_open_pairs(rows, prepare, close, nearest, together)), "tile-links")
        if not more.isEmpty() or not turn:
            groups = connected_components(groups.union(more))
            rows = None
    return groups


def tile_members(tiles: DataFrame) -> DataFrame:
    """(key, node) rows of tiles with several nodes, once each, and two of the tile's nodes: (key, leads, node).

    Leads are the least and the largest, so that one group of nodes has the same ones in its tiles.
    """
    # one shuffle of all rows for both; who shares a tile is dealt by node as well after it
    dealt = tiles.repartition("key")
    led = dealt.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y")
    rows = dealt.join(led.hint("shuffle_hash"), "key").repartition("key", "node").groupBy("key", "x", "y", "node").count()
    return materialize(rows.select("key", F.array("x", "y").alias("leads"), "node"), "tile-members")

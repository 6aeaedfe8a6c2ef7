"""Co-occurrence of top words within a distance, as pairs and as stripes.

A record is a line (an array ``tokens``); positions count all its valid tokens. Everything up to the counts happens within a line's own
array: the top words kept with their positions, each zipped with the 1st to d-th next one, and no two kept words
can be within d positions without being among the d next. So no token is shuffled, only partial counts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.terms import parts
from sparkloom.functions.text import MARKUP, WORD_GAP
from sparkloom.session import materialize, ship


#: Words that a top list may have; they become literals of the plan, looked up by hash.
TOP_WORDS = 10_000


def tokenized(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines' tokens, as of :func:`sparkloom.functions.text.clean_words`, written once for the top list and what is counted by it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            text = pc.utf8_lower(part.column("text"))
            for pattern in MARKUP:
                text = pc.replace_substring_regex(text, pattern, "")
            split = pc.split_pattern_regex(pc.utf8_lower(text), WORD_GAP)
            words = split.flatten()
            kept = pc.greater_equal(pc.utf8_length(words), 2)
            count = np.bincount(pc.list_parent_indices(split).to_numpy(zero_copy_only=False)[kept.to_numpy(zero_copy_only=False)], minlength=len(split))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), words.filter(kept))], ["tokens"])

    ship(lines.sparkSession)
    return materialize(lines.select(F.col(line).alias("text")).mapInArrow(work, "tokens array<string>"), "tokens")


def _kept(tokens: DataFrame, top: DataFrame) -> DataFrame:
    """Arrays of (p, t): the top words of each line of tokens."""
    words = [r[0] for r in top.select("word").limit(TOP_WORDS + 1).collect()]
    if len(words) > TOP_WORDS:
        raise ValueError(f"the top list has more than {TOP_WORDS} words")
    placed = F.transform("tokens", lambda t, i: F.struct(i.alias("p"), t.alias("t")))
    return tokens.select(F.filter(placed, lambda x: x["t"].isin(words)).alias("kept"))


def _near(kept: Column, distance: int) -> Column:
    found = []
    for o in range(1, distance + 1):
        later = F.slice(kept, o + 1, F.greatest(F.size(kept) - o, F.lit(0)))
        both = F.arrays_zip(F.slice(kept, 1, F.greatest(F.size(kept) - o, F.lit(0))), later).cast("array<struct<a:struct<p:int,t:string>,b:struct<p:int,t:string>>>")
        found.append(F.filter(both, lambda x: x["b"]["p"] - x["a"]["p"] <= distance))
    return F.transform(F.concat(*found), lambda x: F.struct(x["a"]["t"].alias("a"), x["b"]["t"].alias("b")))


def pairs(tokens: DataFrame, top: DataFrame, distance: int = 1) -> DataFrame:
    """center, neighbor, cnt over both directions; a word next to itself counts in both."""
    return _pairs(_kept(tokens, top), distance)


def _pairs(kept: DataFrame, distance: int) -> DataFrame:
    near = kept.select(F.explode(_near(F.col("kept"), distance)).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n"))
    both = near.select(F.col("a").alias("center"), F.col("b").alias("neighbor"), "n").unionAll(near.select("b", "a", "n"))
    return both.groupBy("center", "neighbor").agg(F.sum("n").alias("cnt"))


def stripes(counts: DataFrame) -> DataFrame:
    """center and its neighbours as text {n:c, n:c}, by neighbour; the list is as long as the top list at most."""
    cells = F.array_sort(F.collect_list(F.struct("neighbor", "cnt")))
    text = F.array_join(F.transform(cells, lambda x: F.concat(x["neighbor"], F.lit(":"), x["cnt"].cast("string"))), ", ")
    return counts.groupBy("center").agg(F.concat(F.lit("{"), text, F.lit("}")).alias("stripe"))


def stripes_with_empty(tokens: DataFrame, top: DataFrame, distance: int = 1) -> DataFrame:
    """Stripes, and {} for a top word that occurs without a top neighbour. The list is made, and the tokens are searched, once for both."""
    kept = materialize(_kept(tokens, top).where(F.size("kept") > 0), "kept")
    present = kept.select(F.explode("kept.t").alias("center")).distinct()
    return present.join(stripes(_pairs(kept, distance)), "center", "left").select("center", F.coalesce("stripe", F.lit("{}")).alias("stripe"))


def symmetry(counts: DataFrame) -> DataFrame:
    """Cells, their sum, cells unlike their mirror, odd counts of a word with itself."""
    mirror = counts.select(F.col("neighbor").alias("center"), F.col("center").alias("neighbor"), F.col("cnt").alias("m"))
    both = counts.join(mirror, ["center", "neighbor"], "full_outer")
    return both.agg(F.count("cnt").alias("cells"), F.sum("cnt").alias("total"), F.count_if(~F.col("cnt").eqNullSafe(F.col("m"))).alias("unlike"), F.count_if((F.col("center") == F.col("neighbor")) & (F.col("cnt") % 2 == 1)).alias("odd"))

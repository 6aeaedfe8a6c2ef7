"""Terms of texts, counted a few megabytes of text at a time: each distinct token of these is normalised once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.functions.porter import stem
from sparkloom.functions.text import TERM_GAP
from sparkloom.session import ship

#: Bytes of text whose tokens are held at a time.
_RUN = 8_000_000


def normal_terms(tokens: pa.Array) -> pa.Array:
    """What :func:`sparkloom.functions.text.normal_term` makes of each token; null where it is no term."""
    term = pc.utf8_trim(pc.utf8_lower(tokens), "'")
    good = pc.and_(pc.greater_equal(pc.utf8_length(term), 3), pc.match_substring_regex(term, r"\p{L}"))
    return pc.if_else(pc.and_not(good, pc.match_substring_regex(term, r"\p{Nd}")), term, pa.scalar(None, term.type))


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with so many bytes of text at a time, one row at least."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _RUN, "right")))
            yield b.slice(at, to - at)
            at = to


def _counted(part: pa.RecordBatch, wanted: tuple[pa.Array, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
    """row, code, count of each text's terms, and the terms by code. ``wanted``: terms that alone count, and their codes."""
    split = pc.split_pattern_regex(part.column("text"), TERM_GAP)
    tokens = split.flatten().dictionary_encode()
    terms = normal_terms(tokens.dictionary)
    if wanted is None:
        terms = terms.dictionary_encode()
        of, names = pc.fill_null(terms.indices, -1).to_numpy(zero_copy_only=False), terms.dictionary
    else:
        of, names = np.append(wanted[1], -1)[pc.fill_null(pc.index_in(terms, value_set=wanted[0], skip_nulls=True), -1).to_numpy(zero_copy_only=False)], None
    code = of[tokens.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
    use = code >= 0
    key = np.sort(pc.list_parent_indices(split).to_numpy(zero_copy_only=False)[use].astype(np.int64) << 32 | code[use])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key))), names


def text_frequency(docs: DataFrame, text: str) -> DataFrame:
    """term, df: in how many texts each term is."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            _, code, _, names = _counted(part)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(code, minlength=len(names)).astype(np.int64))], ["term", "df"])

    ship(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(work, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def text_counts(docs: DataFrame, text: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """doc_id, term, tf of all terms, or of those in ``wanted``, by the names that it gives them."""
    names = sorted(set((wanted or {}).values()))
    place = {n: i for i, n in enumerate(names)}
    only = None if wanted is None else (list(wanted), [place[n] for n in wanted.values()])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = None if only is None else (pa.array(only[0], pa.string()), np.array(only[1], np.int64))
        for part in parts(batches):
            row, code, count, found = _counted(part, sought)
            for at in range(0, len(row), 500_000):
                some = slice(at, at + 500_000)
                term = (pa.array(names, pa.string()) if found is None else found).take(pa.array(code[some]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[some])), term, pa.array(count[some].astype(np.int64))], ["doc_id", "term", "tf"])

    ship(docs.sparkSession)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("term", StringType()), StructField("tf", LongType())])
    # rows of one doc_id are one document
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(work, schema).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def with_stems(rows: DataFrame) -> DataFrame:
    """``rows`` with the stem of their term, where it has one left; the stem is made once a row, whatever is asked of it later."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stems = pa.array([stem(t) if t else None for t in b.column("term").to_pylist()], pa.string())
            made = pa.RecordBatch.from_arrays([*b.columns, stems], [*b.schema.names, "stem"])
            yield made.filter(pc.fill_null(pc.greater(pc.binary_length(stems), 0), False))

    ship(rows.sparkSession)
    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("stem", StringType())]))

"""BPE encoding and decoding with a pair occurrence index.

``encode_documents`` gives each text its token ids, ``decode_documents`` turns ids into text. Merges
run over the distinct pre-tokens of a batch at once: every adjacent symbol pair that has a rank is
mapped to all its positions, the active ranks are applied in ascending order, and each merge appends
the two pairs that it creates to their lists. Batches are bounded (``INDEX_WORDS`` pre-tokens), and so
is the memory of finished words (``WORDS_KEPT``); both only bound memory, results don't depend on them.

Nulls count as empty texts; an empty text has no ids and decodes to ''.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import ship

INDEX_WORDS = 100_000
WORDS_KEPT = 700_000
BATCH_BYTES = 8_000_000

#: White space as the vocabulary's patterns mean it.
_WS = r"\t-\r \x85\xa0  -     　"
#: Without these characters normalisation is lower-casing by character, and splitting at white space is safe.
SLOW = r"[^\t-\r -~\x{a0}-\x{12f}\x{131}-\x{17f}\x{2010}-\x{2027}]"


def _byte_symbols() -> list[str]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class Vocabulary:
    """A BPE vocabulary file: ids, ranked merges, word pattern and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.rank: dict[int, int] = {}
        self.pair: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        self.ascending = True
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, new = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left << 32 | right] = r
            self.pair.append((left, right, new))
            self.ascending &= new not in made and made.get(left, -1) < r and made.get(right, -1) < r
            made[new] = r
        symbols = _byte_symbols()
        self.inner = [self.ids[c] for c in symbols]
        self.last = [self.ids[c + self.suffix] for c in symbols]
        alone = max(*self.inner, *self.last) + 1
        if alone > 1024:
            raise ValueError("the bytes' own symbols must have small ids")
        self.byte_rank = np.full((alone, alone), -1, np.int32)
        for r, (left, right, _) in enumerate(self.pair):
            if left < alone and right < alone:
                self.byte_rank[left, right] = r
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", _WS))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile(f"[{_WS}]+")
        # Where words end within a run of other characters: all that the pattern matches but letters. It is the
        # same pattern, and none of its matches spans white space, so spaces around these part all pre-tokens.
        self.cuts = pattern.replace(r"[^\s\p{L}\p{N}]+", r"[^\t-\r \x{a0}\p{L}\p{N}]+").replace(r"[\p{L}]+|", "")
        if self.cuts == pattern or r"\s" in self.cuts:
            raise ValueError("the word pattern has another form")

    def normal(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return "".join(map(str.lower, text))

    def index_encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token, by the pair occurrence index."""
        out: list[list[int]] = []
        for at in range(0, len(words), INDEX_WORDS):
            out += self._index_encode(words[at : at + INDEX_WORDS])
        return out

    def _index_encode(self, words: list[str]) -> list[list[int]]:
        sym: list[int] = []
        bounds = [0]
        inner, last = self.inner, self.last
        for w in words:
            raw = w.encode()
            sym.extend([inner[c] for c in raw])
            if raw:
                sym[-1] = last[raw[-1]]
            bounds.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                after[b - 1] = before[a] = -1
        rank, pair = self.rank, self.pair
        where: dict[int, list[int]] = defaultdict(list)
        flat = np.array(sym, np.int64)
        first = self.byte_rank[flat[:-1], flat[1:]] if n > 1 else np.empty(0, np.int32)
        within = np.ones(max(0, n - 1), bool)
        within[np.array(bounds[1:-1], np.int64) - 1] = False
        at = np.flatnonzero(within & (first >= 0))
        at = at[np.argsort(first[at], kind="stable")]
        ranks, begin = np.unique(first[at], return_index=True)
        for r, places in zip(ranks.tolist(), np.split(at, begin[1:])):
            where[r] = places.tolist()
        active = sorted(where)
        while active:
            r = heapq.heappop(active)
            left, right, new = pair[r]
            places = where.pop(r, None)
            if places is None:
                continue
            places.sort()
            for i in places:
                j = after[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                h = before[i]
                if k >= 0:
                    before[k] = i
                    if (x := rank.get(new << 32 | sym[k])) is not None:
                        if x not in where:
                            heapq.heappush(active, x)
                        where[x].append(i)
                if h >= 0 and (x := rank.get(sym[h] << 32 | new)) is not None:
                    if x not in where:
                        heapq.heappush(active, x)
                    where[x].append(h)
        return [[s for s in sym[a:b] if s >= 0] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Encodes columns of texts; keeps the packed ids (little-endian uint32) of pre-tokens it has met."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        if not self.vocab.ascending:
            raise ValueError("merges must form a training order: each token made once, after its parts")
        self.words: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        words = self.words
        if new:
            for w, ids in zip(new, self.vocab.index_encode(new)):
                words[w] = np.array(ids, "<u4").tobytes()

    def _slow(self, text: str) -> bytes:
        v = self.vocab
        pieces = v.specials.split(text) if v.specials else [text]
        found = [[] if p in v.special else v.words.findall(v.normal(p)) for p in pieces]
        self._learn(list({w for ws in found for w in ws if w not in self.words}))
        return b"".join(np.array([v.special[p]], "<u4").tobytes() if p in v.special else b"".join([self.words[w] for w in ws]) for p, ws in zip(pieces, found))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where those of each row begin, with the end."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        slow = pc.match_substring_regex(column, SLOW)
        for s in self.vocab.special:
            slow = pc.or_(slow, pc.match_substring(column, s))
        hard = slow.to_numpy(zero_copy_only=False)
        easy = pc.if_else(slow, "", column) if hard.any() else column
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(easy), self.vocab.cuts, r" \0 "))
        coded = split.flatten().dictionary_encode()
        words, distinct = self.words, coded.dictionary.to_pylist()
        words[""] = b""
        packed = list(map(words.get, distinct))
        new = [i for i, x in enumerate(packed) if x is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            packed[i] = words[distinct[i]]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        flat = np.frombuffer(b"".join(packed), "<u4")
        index = coded.indices.to_numpy()
        length = size[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat((begin[index] - ends[:-1]).astype(np.int32), length) + np.arange(ends[-1], dtype=np.int32)]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        if not hard.any():
            return ids, offsets
        rows = [np.frombuffer(self._slow(column[i].as_py()), "<u4") if h else ids[offsets[i] : offsets[i + 1]] for i, h in enumerate(hard)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of rows with about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, column.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def _with(docs: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[int, int, list[pa.Array]]]], added: list[T.StructField]) -> DataFrame:
    """``docs`` with columns that ``work`` gives for runs (first row, rows) of a batch; same names are replaced."""
    ship(docs.sparkSession)
    names = [f.name for f in added]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + added)
    keep = [f.name for f in schema.fields[: -len(added)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, columns in work(b):
                yield pa.RecordBatch.from_arrays([*b.slice(at, n).select(keep).columns, *columns], [*keep, *names])

    return docs.mapInArrow(run, schema)


def _ids_of(column: pa.Array, vocabulary: str) -> Iterator[tuple[int, int, pa.ListArray]]:
    enc = encoder(vocabulary)
    for at, run in runs(column):
        flat, offsets = enc.encode(run)
        yield at, len(run), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32)))


_tables: dict[str, pa.Array] = {}


def _texts_of(lists: pa.ListArray, vocabulary: str) -> pa.Array:
    if vocabulary not in _tables:
        _tables[vocabulary] = pa.array(Vocabulary(vocabulary).tokens)
    tokens = _tables[vocabulary]
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    raw = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    known = (raw >= 0) & (raw < len(tokens))
    if not known.all():
        owner = np.repeat(np.arange(len(counts)), counts)[known]
        counts, raw = np.bincount(owner, minlength=len(counts)), raw[known]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens.take(pa.array(raw))), " ")


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an array<int> column ``ids``, replacing one of that name; null text counts as ''."""
    return _with(docs, lambda b: ((at, n, [x]) for at, n, x in _ids_of(b.column(text), vocabulary)), [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a string column ``text``: the ids' tokens, special ones too, joined by one space.

    A vocabulary file without a decoder joins tokens so. Null ids decode to ''; a null or unknown id has no
    token and is left out.
    """

    def work(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for at in range(0, b.num_rows, 500):
            part = b.column(ids).slice(at, 500)
            yield at, len(part), [_texts_of(part, vocabulary)]

    return _with(docs, work, [T.StructField(text, T.StringType())])


def round_trip_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode_documents`, then :func:`decode_documents` on its ids, in one pass of one worker."""

    def work(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for at, n, lists in _ids_of(b.column(text), vocabulary):
            for k in range(0, n, 500):
                part = lists.slice(k, 500)
                yield at + k, len(part), [part, _texts_of(part, vocabulary)]

    return _with(docs, work, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, from encoded ids and decoded text."""
    both = round_trip_documents(docs.select("doc_id", "text"), vocabulary)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

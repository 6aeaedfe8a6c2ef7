"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states (clean, toxic); a token's features are hashes of the word and of its first 4, 5 and 6 bytes. Documents
alone are labelled, so tokens get labels first: in a toxic document, those with a feature that occurs in so many
contexts of toxic and so few of other documents that chance doesn't explain it. The field is fitted to these by its gradient from
forward-backward. Documents are scored over all their tokens: the expected number of toxic tokens and the
largest marginal enter a logistic function that is fitted to the labels. Tokens with a marginal of one half or
more are offending; neighbours form one span.

Fitting takes at most ``MAX_FIT_DOCS`` labelled rows (least seeded hashes of doc_id), and ``MAX_FIT_BYTES`` of
their text in whole documents. The field's own gradient takes at most ``MAX_WINDOWS`` windows of their tokens of each kind (with a toxic
token, clean with a feature of one, other; seeded choice); token labels and the document score come from all their tokens.
Scoring covers every document whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.textkernel import U, Words, buffers, mix, split_words
from sparkloom.session import ship

MAX_FIT_DOCS, MAX_FIT_BYTES = 6_000, 16_000_000
TABLE_BITS = 18
PREFIXES = (4, 5, 6)
#: Tokens of a training sequence, training sequences of each kind (toxic, clean with a feature of toxic ones, other), steps.
WINDOW, MAX_WINDOWS, STEPS = 48, 6_000, 40
_RUN = 12_000_000
_PUNCT = np.zeros(256, bool)
_PUNCT[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
OUTPUT = "doc_id long, score double, toxic_tokens double, max_marginal double, spans array<struct<begin:int,end:int>>"


def tokens(column: pa.Array) -> Words:
    """Lower-cased words without punctuation around them."""
    data, offsets = buffers(column)
    w = split_words(data, offsets, True)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        end -= (end > start) & _PUNCT[w.data[np.maximum(end - 1, 0)]] if len(end) else 0
        start += (end > start) & _PUNCT[w.data[np.minimum(start, len(w.data) - 1)]] if len(start) else 0
    return Words(w.data, start, end, w.first, w.lanes)


def features(w: Words) -> np.ndarray:
    """A table index for each token and kind of feature."""
    kinds = [w.hashes(), *(w.prefix(k) for k in PREFIXES)]
    out = np.empty((len(w.start), len(kinds)), np.int32)
    for j, h in enumerate(kinds):
        out[:, j] = (mix(h + U(j)) >> U(64 - TABLE_BITS)).astype(np.int32) + (j << TABLE_BITS)
    return out


@dataclass
class Field:
    """Feature weights of the toxic state, transition weights [from][to], and the score's logistic function."""

    weights: np.ndarray
    trans: np.ndarray
    start: float
    link: np.ndarray

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[f].sum(axis=1, dtype=np.float64), -30, 30)


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the forward and backward odds. Sequences run side by side, the longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, length = first[:-1][order], size[order]
    push, t = np.exp(emission), np.exp(trans)
    ahead, back = np.ones(len(emission)), np.ones(len(emission))
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # sequences longer than each position
    odds = np.full(len(size), np.exp(start))
    for i in range(longest):
        n = active[i]
        at = begin[:n] + i
        odds[:n] = push[at] * ((t[0, 1] + t[1, 1] * odds[:n]) / (t[0, 0] + t[1, 0] * odds[:n]) if i else odds[:n])
        ahead[at] = odds[:n]
    odds = np.ones(len(size))
    for i in range(longest - 2, -1, -1):
        n = active[i + 1]
        at = begin[:n] + i
        x = push[at + 1] * odds[:n]
        odds[:n] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        back[at] = odds[:n]
    both = ahead * back
    return both / (1 + both), ahead, back


def document_facts(m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected toxic tokens and the largest marginal of each document."""
    size = np.diff(first)
    total, most = np.zeros(len(size)), np.zeros(len(size))
    full = np.flatnonzero(size)
    if len(full):
        total[full], most[full] = np.add.reduceat(m, first[full]), np.maximum.reduceat(m, first[full])
    return total, most


def _inputs(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log(total + 0.01), most], axis=1)


def scores(link: np.ndarray, total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(total, most) @ link, -30, 30)))


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the words left and right of each token."""
    n = len(h)
    left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    left[1:], right[:-1] = h[:-1], h[1:]
    begin = first[:-1][np.diff(first) > 0]
    left[begin] = 0
    right[first[1:][np.diff(first) > 0] - 1] = 0
    return mix(left ^ mix(right + U(1)))


def label_tokens(f: np.ndarray, context: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels: tokens of toxic documents with a feature that marks toxic documents beyond chance.

    What counts is in how many different contexts a feature occurs in either kind of document, so that the words of
    a toxic document don't become marks by its copies.
    """
    bad = np.repeat(toxic.astype(bool), np.diff(first))
    share = min(max(bad.mean(), 1e-3), 0.5) if len(bad) else 1e-3
    hot = np.zeros(len(bad), bool)
    for j in range(f.shape[1]):
        counts = []
        for kind in (bad, ~bad):
            code = mix(context[kind] ^ mix(f[kind, j].astype(np.uint64)))
            counts.append(np.bincount(f[kind, j][np.unique(code, return_index=True)[1]], minlength=f.max() + 1))
        a, b = counts
        marks = (a >= 3) & (a * np.log(share) < np.log(1e-5)) & (b <= 0.02 * a)
        hot |= marks[f[:, j]]
    return hot & bad


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = 5) -> Field:
    """Fit field and score to labelled documents; without both labels every score is the base rate."""
    size = (1 + len(PREFIXES)) << TABLE_BITS
    field = Field(np.zeros(size, np.float32), np.zeros((2, 2)), -4.0, np.array([-3.0, 0.0, 0.0]))
    if len(texts) == 0 or toxic.min() == toxic.max():
        return field
    w = tokens(pa.array(texts, pa.string()))
    f = features(w)
    y = label_tokens(f, contexts(w.hashes(), w.first), w.first, toxic)
    # windows with and without toxic tokens
    begins = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(w.first[:-1], w.first[1:])])
    ends = np.minimum(begins + WINDOW, w.first[np.searchsorted(w.first, begins, "right")])
    hits = np.concatenate([[0], np.cumsum(y)])
    with_hit = hits[ends] > hits[begins]
    # clean windows that share a feature with toxic tokens teach most
    shared = np.zeros(size, bool)
    shared[f[y].ravel()] = True
    touches = np.concatenate([[0], np.cumsum(shared[f].any(axis=1) & ~y)])
    hard = ~with_hit & (touches[ends] > touches[begins])
    rng = np.random.default_rng(seed)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(x))[:MAX_WINDOWS] for x in (with_hit, hard, ~with_hit & ~hard)])
    take = np.concatenate([np.arange(begins[i], ends[i]) for i in chosen])
    first = np.concatenate([[0], np.cumsum(ends[chosen] - begins[chosen])])
    fx, yx = f[take], y[take].astype(float)
    inner = np.ones(len(take) - 1, bool)
    inner[first[1:-1] - 1] = False
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((yx[left] == i) & (yx[left + 1] == j)).sum()
    used, code = np.unique(fx, return_inverse=True)
    code = code.reshape(fx.shape)
    weights, trans, start = np.zeros(len(used)), np.zeros((2, 2)), -4.0
    g_w, g_t, g_s = np.full(len(used), 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(STEPS):
        emission = np.clip(weights[code].sum(axis=1), -30, 30)
        m, ahead, back = marginals(emission, first, trans, start)
        grad = np.bincount(code.ravel(), np.repeat(yx - m, fx.shape[1]), len(used)) - 0.02 * weights
        x, t = np.exp(emission[left + 1]) * back[left + 1], np.exp(trans)
        four = np.stack([np.full(len(left), t[0, 0]), t[0, 1] * x, t[1, 0] * ahead[left], t[1, 1] * ahead[left] * x])
        expected = (four / four.sum(axis=0)).sum(axis=1).reshape(2, 2)
        d_t = seen - expected - 0.02 * trans
        d_s = (yx[first[:-1]] - m[first[:-1]]).sum()
        g_w, g_t, g_s = g_w + grad**2, g_t + d_t**2, g_s + d_s**2
        weights += 0.7 * grad / np.sqrt(g_w)
        trans += 0.3 * d_t / np.sqrt(g_t)
        start += 0.3 * d_s / np.sqrt(g_s)
    field.weights[used] = weights
    field.trans, field.start = trans, float(start)
    m, _, _ = marginals(field.emissions(f), w.first, trans, field.start)
    x = _inputs(*document_facts(m, w.first))
    link = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        link += np.linalg.solve(h, x.T @ (toxic - p) - 0.05 * link)
    field.link = link
    return field


def fit_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, max_bytes: int = MAX_FIT_BYTES) -> Field:
    """Fit to rows of ``labels`` (doc_id, toxic) and their texts in ``docs``; the caller leaves out held-out rows.

    Rows with a null id or label are ignored; of repeated labels of a document the largest counts. A document that
    doesn't fit into ``max_bytes`` any more is passed over. An error if documents of both labels exist and the sample has
    not both.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_docs rows at most
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), F.max("toxic").alias("toxic"))
    total, ids, kinds = 0, [], set()
    for i, n, mark in sizes.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect():
        if total + (n or 0) <= max_bytes:
            total += n or 0
            ids.append(i)
            kinds.add(mark > 0)
    if len(kinds) < 2 and docs.select("doc_id").join(known, "doc_id").select(F.col("toxic") > 0).distinct().count() > 1:
        raise ValueError(f"{len(ids)} labelled documents of {max_docs} rows and {max_bytes} bytes don't have both labels")
    session = docs.sparkSession
    kept = session.createDataFrame([(i,) for i in ids], "doc_id long").distinct() if ids else None
    taken = rows.join(F.broadcast(kept), "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by("doc_id") if kept is not None else None
    if taken is None:
        return fit([], np.zeros(0))
    return fit(taken.column("text").to_pylist(), (taken.column("toxic").to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, toxic_tokens, max_marginal and spans (code points of the text) of each row of ``docs``.

    Null and empty texts have no tokens and the score of that. Other columns are ignored; repeated rows repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            text = b.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _RUN, "right")))
                w = tokens(text.slice(at, to - at))
                m, _, _ = marginals(model.emissions(features(w)), w.first, model.trans, model.start)
                total, most = document_facts(m, w.first)
                spans: list[list[dict]] = [[] for _ in range(to - at)]
                for d in np.flatnonzero(most >= 0.5).tolist():
                    here = np.flatnonzero(m[w.first[d] : w.first[d + 1]] >= 0.5) + w.first[d]
                    base = int(ends[at + d - 1] - (ends[at - 1] if at else 0)) if d else 0
                    for run in np.split(here, np.flatnonzero(np.diff(here) > 1) + 1):
                        a, z = int(w.start[run[0]]), int(w.end[run[-1]])
                        lead = w.data[base:a].tobytes().decode(errors="replace")
                        spans[d].append({"begin": len(lead), "end": len(lead) + len(w.data[a:z].tobytes().decode(errors="replace"))})
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), pa.array(scores(model.link, total, most)), pa.array(total), pa.array(most), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "toxic_tokens", "max_marginal", "spans"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, OUTPUT)

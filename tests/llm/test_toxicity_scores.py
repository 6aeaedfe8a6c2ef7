"""Document scores and spans against the enumeration of all taggings."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import toxicity

WORDS = "fine good awful nasty plain the of vile".split()


def random_field(seed):
    rng = np.random.default_rng(seed)
    size = (1 + len(toxicity.PREFIXES)) << toxicity.TABLE_BITS
    return toxicity.Field(rng.normal(size=size).astype(np.float32), rng.normal(size=(2, 2)), -0.5, rng.normal(size=3))


def plain_score(field, text):
    """Score and toxic tokens' places by the sum over all taggings."""
    places = [m.span() for m in re.finditer("[a-z]+", text)]
    weight = [float(field.weights[toxicity.features(toxicity.tokens(pa.array([text[a:b]])))].astype(float).sum()) for a, b in places]
    odds, whole = np.zeros(len(places)), 0.0
    for tags in itertools.product((0, 1), repeat=len(places)):
        x = math.exp(sum(w for w, t in zip(weight, tags) if t) + sum(field.trans[p, q] for p, q in zip(tags, tags[1:])) + (field.start if tags and tags[0] else 0.0))
        whole += x
        odds += x * np.array(tags)
    m = odds / whole
    facts = np.array([1.0, math.log(m.sum() + 0.01), m.max() if len(m) else 0.0])
    spans, run = [], None
    for (a, b), hot in zip(places, m >= 0.5):
        if hot:
            run = (run[0], b) if run else (a, b)
        elif run:
            spans.append(run)
            run = None
    return 1 / (1 + math.exp(-facts @ field.link)), [*spans, *([run] if run else [])]


def test_scores_equal_enumeration(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 9))) for _ in range(40)] + ["", None, "é " + "vile, nasty!"]
    texts[-1] = "vile, nasty!"
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    field = random_field(1)
    for r in toxicity.score_documents(docs, field).collect():
        score, spans = plain_score(field, texts[r["doc_id"]] or "")
        assert abs(r["score"] - score) < 1e-9
        assert [(s["begin"], s["end"]) for s in r["spans"]] == spans


def test_very_long_text_is_scored_whole(spark):
    field = random_field(2)
    text = " ".join(["plain"] * 300_000)
    rows = spark.createDataFrame([(1, text + " vile"), (2, text), (2, text)], "doc_id long, text string")
    got = sorted(tuple(r) for r in toxicity.score_documents(rows, field).select("doc_id", "toxic_tokens", F.size("spans")).collect())
    assert len(got) == 3 and got[1] == got[2] and got[0] != got[1]

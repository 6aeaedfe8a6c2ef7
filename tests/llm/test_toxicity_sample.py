from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents, the first one in sampling order being very long, and their labels."""
    rng = random.Random(8)
    order = [r[0] for r in spark.range(300).orderBy(F.xxhash64("id", F.lit(11)), "id").collect()]
    rows, labels = [], []
    for i in order:
        w = [f"{rng.choice('abcdefgh')}w{rng.randrange(300)}" for _ in range(40)]
        toxic = i != order[0] and rng.random() < 0.3
        if toxic:
            w[rng.randrange(40)] = "vilestuff"
        rows.append((i, " ".join(w * (400 if i == order[0] else 1))))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_long_document_is_passed_over(labelled):
    docs, marks = labelled
    field = toxicity.fit_documents(docs, marks, max_bytes=60_000)
    got = toxicity.score_documents(docs, field).join(marks, "doc_id").collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) / len(got) > 0.97


def test_sample_of_one_label_is_an_error(labelled):
    docs, marks = labelled
    with pytest.raises(ValueError, match="both labels"):
        toxicity.fit_documents(docs, marks, max_bytes=10)
    toxicity.fit_documents(docs, marks.where("toxic = 0"))

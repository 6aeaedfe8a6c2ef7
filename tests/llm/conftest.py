from __future__ import annotations

import random

import public_tokenizers
import pytest

#: Columns that operators use for themselves, and names of their outputs.
CLASHING = ["key", "node", "comp", "bits", "sig", "rk", "shard", "slot", "bucket", "n_lines", "removed", "_w", "n_words", "token_ids", "decoded", "kept", "score"]


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "Ünïcode", "don't", "x2"]) for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts of many sizes with exact copies, near copies, odd white space, blanks and a long one."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.choice([1, 2, 3, 4, 8, 20, 60, 150]))) for _ in range(n)]
    for _ in range(n // 3):
        w = rng.choice(texts).split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [rng.choice(texts) for _ in range(n // 4)]
    texts += ["", " \t\n", "One\u000btwo\nthree", "a a a a a a a a", " ".join(words(rng, 4000))]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id, text, lang, source, n_chars and a column of each clashing name; nulls in every column."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}", len(t)) for i, t in enumerate(corpus())]
    rows += [(len(rows), None, "en", None, None), (3, rows[3][1], "en", "src1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], schema).cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")

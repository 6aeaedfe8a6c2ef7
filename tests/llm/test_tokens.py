from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe, tokenfile
from sparkloom.session import scratch

PIECES = [*"abcXYZ ''!?.\n\t\xa0", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "é", "é", "Σ", "ΑΣ ", "İ", "ß", "ŉ", "ſ", "²", "¼", "١", "中", "😀", "\x1c", "\x85", " ", "　", "ﬁ", "K", "\x00", "ǅ", "…", "—", "ͅ"]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def test_encoder_equals_the_library(vocabulary, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES[: rng.choice([14, 20, len(PIECES)])]) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "a" * 5000, "don't DON'T 'tis 12345"]
    ids, at = bpe.Encoder(vocabulary).encode(pa.array(texts))
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in expected]


def test_small_caches_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "INDEX_WORDS", 2)
    enc = bpe.Encoder(vocabulary)
    for t in ("the cat sat on the mat", "another cat", "the mat"):
        assert enc.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip(documents, nothing, vocabulary, library):
    rows = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip_digests(documents, vocabulary).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        got = rows[r["doc_id"], len(ids)]
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(nothing, vocabulary).count() == 0


def test_encode_then_decode_with_clashing_columns(documents, vocabulary):
    both = bpe.decode_documents(bpe.encode_documents(documents, vocabulary), vocabulary)
    assert sorted(both.columns) == sorted(documents.columns)
    assert both.count() == documents.count()


def test_unknown_ids_are_left_out(spark, vocabulary, library):
    rows = spark.createDataFrame([(1, [320, 10**6, -4, 321]), (2, None), (3, []), (4, [None, 320])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(rows, vocabulary).collect()}
    assert got == {1: library.decode([320, 321], skip_special_tokens=False), 2: "", 3: "", 4: library.decode([320], skip_special_tokens=False)}


def test_token_files(spark, documents, nothing, vocabulary, library):
    path = scratch(spark, "tokens-test")
    docs = documents.where("doc_id != 3")
    got = tokenfile.token_positions(docs, vocabulary, path, length=16).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(got, docs.select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.token_positions(nothing, vocabulary, scratch(spark, "tokens-none")).count() == 0
    assert tokenfile.token_positions(documents, vocabulary, scratch(spark, "tokens-twice")).where("doc_id = 3").count() == 2


def test_sequences_are_views_of_equal_length(spark, documents, vocabulary):
    from pyarrow import fs

    path = scratch(spark, "tokens-view")
    manifest = tokenfile.write_tokens(documents.where("doc_id != 3").coalesce(1), vocabulary, path, length=32).collect()
    total = 0
    for row in manifest:
        held = pa.total_allocated_bytes()
        f = tokenfile.TokenFile(fs.LocalFileSystem(), row["ids_file"])
        views = f.sequence(0), f.mask(0)
        assert all(len(f.sequence(i)) == 32 for i in range(row["n_sequences"]))
        masks = np.concatenate([f.batch(k)[1] for k in range(f.reader.num_record_batches)])
        assert masks.sum() == row["n_ids"] and masks[: row["n_ids"]].all()
        assert not f.sequence(0).flags.owndata and not f.mask(0).flags.owndata
        assert pa.total_allocated_bytes() - held < views[0].nbytes  # nor is anything copied behind them
        total += row["n_docs"]
    assert total == documents.where("doc_id != 3").count()

"""The queries opN_<name> over the test tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, jaccard, licences, lines, quality, rollups, sharding, tokenfile, toxicity
from sparkloom.session import materialize, scratch, table

VOCABULARY = "word_bpe_49k.json"


def _vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: 80 in 100 of its five-word shingles."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and the licences that they stand for, by document."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents, read them back."""
    return tokenfile.token_positions(table(spark, sf_dir, "documents"), _vocabulary(), scratch(spark, "tokens"))


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules and the verdict, by document."""
    return quality.score_documents(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def _rolled_up(spark: SparkSession, facts: DataFrame, a: str, b: str) -> DataFrame:
    """``facts`` (doc_id, source, lang, text hash h, estimate, a, b): load all documents under two tokenizer versions, a with
    estimates; revise these to exact counts; delete later copies of equal texts; deliver two of the batches again, and
    compact in between."""
    facts = materialize(facts, "rollup-facts")

    def version(rows: DataFrame, name: str, **counts: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(name).alias("tokenizer_version"), *(F.col(c).alias(n) for n, c in counts.items()))

    totals = rollups.TokenTotals(spark, scratch(spark, "rollups"))
    load = rollups.inserts(version(facts, a, n_tokens="estimate").unionByName(version(facts, b, n_tokens="b")))
    recount = rollups.revisions(version(facts, a, old_tokens="estimate", new_tokens="a"))
    # copies are counted by source and language before they meet their text's first document
    kinds = facts.groupBy("h", "source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("a").alias("a"), F.first("b").alias("b"))
    firsts = kinds.groupBy("h").agg(F.min("least").alias("first"))
    later = kinds.join(firsts, "h").withColumn("n", F.col("n") - (F.col("least") == F.col("first")).cast("long")).where("n > 0")
    copies = rollups.deletes(version(later, a, n_tokens="a", n_docs="n").unionByName(version(later, b, n_tokens="b", n_docs="n")))
    totals.apply("load", load)
    totals.apply("recount", recount)
    totals.apply("load", load)
    totals.compact()
    totals.apply("copies", copies)
    totals.apply("recount", recount)
    return totals.totals()


def _facts(docs: DataFrame) -> tuple[DataFrame, Column]:
    return docs.select("doc_id", "source", "lang", "text"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by the vocabulary's own tokens (estimated by pieces first) and by words, each text counted once."""
    docs, h = _facts(table(spark, sf_dir, "documents"))
    counted = rollups.count_tokens(docs, _vocabulary(), "a")
    return _rolled_up(spark, counted.select("doc_id", "source", "lang", h, rollups.count_pieces().alias("estimate"), "a", rollups.count_words().alias("b")), VOCABULARY.removesuffix(".json"), "words-1")


def rollups_of_words_and_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with counts that SQL can check."""
    docs, h = _facts(table(spark, sf_dir, "documents"))
    estimate = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 5).cast("long")
    return _rolled_up(spark, docs.select("doc_id", "source", "lang", h, estimate.alias("estimate"), rollups.count_words().alias("a"), rollups.count_pieces().alias("b")), "words-1", "pieces-1")


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write 24 shards, read them back."""
    return sharding.shard_digests(table(spark, sf_dir, "documents"), scratch(spark, "shards"))


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a field fitted to the labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    field = toxicity.fit_documents(docs, labels.where(~held_out))
    scored = toxicity.score_documents(docs, field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier one, by document."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles have a similarity of 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text that they decode to, by document."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), _vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_licence_sentences": op2_licence_sentences,
    "op3_token_files": op3_token_files,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_toxicity_crf": op5_toxicity_crf,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_token_rollups": op8_token_rollups,
    "op9_two_pass_shuffle": op9_two_pass_shuffle,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "rollups_of_words_and_pieces": rollups_of_words_and_pieces,
}
# A-Z in lower case, words apart from space and 0x09-0x0D
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    # items of fewer than five words, of which the benchmark has none, would need their own shingle width
    "op1_decontamination": f"""
        with i as (select item_id, {_WORDS} w from benchmark),
        si as (select distinct item_id, unnest([w[j:j + 4] for j in range(1, len(w) - 3)]) s from i),
        d as (select doc_id, {_WORDS} w from documents),
        sd as (select distinct doc_id, s from (select doc_id, unnest([w[j:j + 4] for j in range(1, len(w) - 3)]) s from d) where s in (select s from si)),
        q as (select item_id, count(*) n from si group by item_id)
        select doc_id, item_id, n as n_item_shingles, count(*) as n_common, count(*) / n as containment
        from si join sd using (s) join q using (item_id) group by doc_id, item_id, n having 100 * count(*) >= 80 * n""",
    "op2_licence_sentences": licences.scan_sql(),
    "op4_quality_divergence": quality.score_sql(),
    "op7_ngram_jaccard": f"""
        with recursive w as (select doc_id, {_WORDS} w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 3 then [w[j:j + 2] for j in range(1, len(w) - 1)] when len(w) > 0 then [w] else [] end) s from w),
        n as (select doc_id, count(s) n from w left join s using (doc_id) group by doc_id),
        links as (select a.doc_id a, b.doc_id b from s a join s b on a.s = b.s and a.doc_id < b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
            group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        ways as (select a, b from links union all select b, a from links),
        reach(doc_id, r) as (select doc_id, doc_id from n union select ways.b, r from reach join ways on ways.a = reach.doc_id)
        select doc_id, n as n_shingles, min(r) as component_id from reach join n using (doc_id) group by doc_id, n""",
    "rollups_of_words_and_pieces": r"""
        with d as (select source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words, len(regexp_extract_all(t, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) as pieces
            from (select source, lang, coalesce(text, '') t from documents qualify doc_id = min(doc_id) over (partition by coalesce(text, ''))))
        select source, lang, 'words-1' as tokenizer_version, count(*) as n_docs, cast(sum(words) as bigint) as n_tokens from d group by all
        union all
        select source, lang, 'pieces-1', count(*), cast(sum(pieces) as bigint) from d group by all""",
}

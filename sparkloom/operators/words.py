"""Word counts, top words, document frequency and TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.porter import stemmed
from sparkloom.functions.terms import text_counts, text_frequency, with_stems
from sparkloom.functions.text import NOISE_STEMS, clean_words, raw_words, without, word_frame
from sparkloom.session import discard, materialize, ship

#: The corpus size in the score is this constant, whatever the number of documents is.
SCORE_DOCUMENTS = 10000.0
#: Terms up to which a list goes to the tasks that count them; with a longer one all are counted first.
LISTED = 10_000


def count_words(lines: DataFrame, words: Column) -> DataFrame:
    return lines.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def raw_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    return count_words(lines, raw_words(F.col(line)))


def clean_counts(lines: DataFrame, line: str = "line", case_sensitive: bool = False) -> DataFrame:
    return count_words(lines, clean_words(F.col(line), case_sensitive))


def filtered_counts(lines: DataFrame, stop: DataFrame, line: str = "line") -> DataFrame:
    """Clean counts without stop words; the list meets the counts, not each token."""
    return without(clean_counts(lines, line), stop, "word")


def top_words(counts: DataFrame, n: int = 50) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "word").limit(n)


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df. Repeats go within each document, so only distinct terms are counted."""
    return text_frequency(docs, text)


def top_terms(df: DataFrame, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc("df"), "term").limit(n)


def term_frequency(docs: DataFrame, of: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, tf for the terms of ``of``, such as a top list."""
    listed = [r[0] for r in of.select("term").limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        return text_counts(docs, text).join(of.select("term"), "term").select("doc_id", "term", "tf")
    return text_counts(docs, text, {t: t for t in listed if t is not None})


def tf_idf(tf: DataFrame, df: DataFrame) -> DataFrame:
    score = F.col("tf") * F.log(F.lit(SCORE_DOCUMENTS) / F.col("df") + 1)
    return tf.join(df.select("term", "df"), "term").select("doc_id", "term", score.alias("score"))


def compare_scores(expected: DataFrame, actual: DataFrame, eps: float = 1e-6) -> DataFrame:
    """How many scores match, differ, are missing or extra."""
    both = expected.withColumnRenamed("score", "e").join(actual.withColumnRenamed("score", "a"), ["doc_id", "term"], "full_outer")
    off = F.abs(F.col("e") - F.col("a")) > eps
    return both.agg(F.count_if(~off).alias("matched"), F.count_if(off).alias("mismatched"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))


def _kept_stems(rows: DataFrame, stop: DataFrame) -> DataFrame:
    """Rows of distinct terms with their stems, as far as the stop filters leave them."""
    stop_words = stop.toDF("word")
    stop_stems = stop_words.select(stemmed(F.col("word")).alias("word"))
    pairs = with_stems(without(rows, stop_words, "term"))
    pairs = without(without(pairs, stop_words, "stem"), stop_stems, "stem")
    return without(pairs, word_frame(rows, NOISE_STEMS), "stem")


def stem_table(vocabulary: DataFrame, stop: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms that the stop filters leave: the term and its stem are no stop words, the stem
    is no stem of one and no noise. Each distinct term is stemmed once."""
    ship(vocabulary.sparkSession)
    return _kept_stems(vocabulary.select("term").distinct(), stop)


def stemmed_terms(docs: DataFrame, stop: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term (a stem), tf."""
    counts = text_counts(docs, text)
    stems = stem_table(text_frequency(docs, text), stop)
    return counts.join(stems, "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def stemmed_top_terms(docs: DataFrame, stop: DataFrame, n: int = 100, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The ``n`` stems in most documents (term, df), and doc_id, term, tf of these and some others.

    A stem is in as many documents at most as all its terms together. Those of which that is most are counted, and twice as many
    as long as another one could be among the first ``n``; so rows of the other stems are neither made nor shuffled.
    """
    ship(docs.sparkSession)
    stems = materialize(_kept_stems(text_frequency(docs, text), stop), "term-stems")
    bounds, some = stems.groupBy("stem").agg(F.sum("df").alias("most")), 2 * n
    while True:
        able = bounds.orderBy(F.desc("most"), "stem").limit(some + 1).collect()
        picked = word_frame(docs, [r["stem"] for r in able[:some]]).toDF("stem")
        listed = stems.join(F.broadcast(picked), "stem").select("term", "stem").limit(LISTED + 1).collect()
        every = len(listed) > LISTED
        tf = materialize(stemmed_terms(docs, stop, text) if every else text_counts(docs, text, dict(map(tuple, listed))), "stemmed-terms")
        top = materialize(top_terms(tf.groupBy("term").agg(F.count("*").alias("df")), n), "top-stems")
        count, least = top.agg(F.count("*"), F.min("df")).first()
        if every or len(able) <= some or (count == n and least > able[some]["most"]):
            discard(stems)
            return top, tf
        for made in (tf, top):
            discard(made)
        some *= 2


def stemmed_document_frequency(docs: DataFrame, stop: DataFrame, text: str = "text") -> DataFrame:
    return stemmed_terms(docs, stop, text).groupBy("term").agg(F.count("*").alias("df"))

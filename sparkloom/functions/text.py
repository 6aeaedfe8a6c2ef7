"""Tokenizers and term filters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the clean tokenizer deletes, in this order; where tokenizers part words; noise stems.
MARKUP = [r"&[a-z]+;", r"<[^>]+>", r"(https?://|www\.)\S+", r"\[\[[^\]]+\]\]"]
WORD_GAP = r"[^\w']+"
TERM_GAP = r"[^\p{L}\p{Nd}']+"
NOISE_STEMS = ["apo", "categori", "extern", "http", "link", "quot", "refer"]
#: A short list of English function words, for queries without a file of stop words.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on", "as", "by", "at", "from", "or", "an", "be", "are"]


def raw_words(line: Column) -> Column:
    """Pieces between delimiters, case kept. A delimiter in front gives an empty word, which counts, and so does an empty line; delimiters alone give none."""
    body = F.regexp_replace(line, WORD_GAP + "$", "")
    return F.when(line == "", F.array(F.lit(""))).when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_GAP))


def clean_words(line: Column, case_sensitive: bool = False) -> Column:
    """Lower-cased words of two characters or more after markup went; ``case_sensitive`` lowers only after that."""
    text = line if case_sensitive else F.lower(line)
    for pattern in MARKUP:
        text = F.regexp_replace(text, pattern, "")
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda t: F.length(t) >= 2)


def normal_term(token: Column) -> Column:
    """Lower case without apostrophes around it; null if shorter than three, without a letter, or with a digit."""
    term = F.regexp_replace(F.lower(token), "^'+|'+$", "")
    good = (F.length(term) >= 3) & term.rlike(r"\p{L}") & ~term.rlike(r"\p{Nd}")
    return F.when(good, term)


def without(rows: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not in the first column of ``words``, a list of stop words or the like that any task can hold."""
    return rows.join(F.broadcast(words.toDF(column)), column, "left_anti")


def word_frame(rows: DataFrame, words: list[str]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(w,) for w in words], "word string")

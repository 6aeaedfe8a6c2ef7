"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with the reference
of its language by Jensen-Shannon distance (base 2, 0 to 1). References are the mean histograms of all documents
of a language that are long enough and pass the base rules. A document is rejected if the character distance
or the sum of both exceeds its limit; a text that is too short for a histogram to mean something (``MIN_CHARS``, ``MIN_WORDS``) is not judged
by divergence. Base rules: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Words are runs of characters other than space and 0x09-0x0D. Null text counts as no words. A null or unlisted
language has its own reference over the union of all common words. All counts are 0 for an empty text. A language without a document fit for its
reference has null distances, and divergence rejects none of its documents.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialize

MIN_CHARS, MIN_WORDS = 200, 60
#: Limits of the character distance, and of both distances together.
MAX_CHAR_DISTANCE, MAX_DISTANCES = 0.25, 0.41

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "dans", "pour"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "con"],
}
BLANK = r"[\x20\x09-\x0D]+"
#: Low bits of a packed window that hold its position.
_POSITION_BITS = 22
_POSITION = (1 << _POSITION_BITS) - 1


def _left(text: Column, pattern: str) -> Column:
    """How many characters are left without what ``pattern`` matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _occurrences(spaced: Column, word: str) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("int")


def _covered(positions: Column) -> Column:
    """Words that 3-word windows at these positions cover."""
    spread = F.concat(positions, F.transform(positions, lambda p: p + 1), F.transform(positions, lambda p: p + 2))
    return F.size(F.array_distinct(spread)).cast("long")


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Repeated windows: each window's hash and position are packed into one long and sorted, so that equal
    windows become neighbours; neighbours with equal hashes are compared word by word. Where a hash stands for
    two different windows, or a text has over 4 million words, the words themselves are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.withColumn("_w", F.array_remove(F.split(text, BLANK), ""))
    n = F.size("_w")
    # a line with a word; equal lines beyond the first
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    at = at.withColumn("_lines", lines)
    at = at.withColumns({"n_words": n.cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_symbols": _left(text, r"[^#*$%&|<>]+"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    w = F.col("_w")
    zipped = F.arrays_zip(w, F.slice(w, 2, F.greatest(n - 2, F.lit(0))), F.slice(w, 3, F.greatest(n - 2, F.lit(0))))
    windows = F.slice(zipped.cast("array<struct<a:string,b:string,c:string>>"), 1, F.greatest(n - 2, F.lit(0)))
    packed = F.transform(windows, lambda x, i: F.xxhash64(x["a"], x["b"], x["c"]).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))
    at = at.withColumn("_packed", F.sort_array(packed))
    p = F.col("_packed")
    shifted = F.arrays_zip(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))).cast("array<struct<a:bigint,b:bigint>>")
    at = at.withColumn("_near", F.filter(shifted, lambda x: F.shiftrightunsigned(x["a"], _POSITION_BITS) == F.shiftrightunsigned(x["b"], _POSITION_BITS)))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_POSITION)).cast("int")

    differ = F.exists("_near", lambda x: reduce(Column.__or__, [F.get(w, place(x["a"]) + j) != F.get(w, place(x["b"]) + j) for j in range(3)]))
    near = F.col("_near")
    quick = _covered(F.array_distinct(F.concat(F.transform(near, lambda x: place(x["a"])), F.transform(near, lambda x: place(x["b"])))))
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), i.alias("i"))))
    row = "struct<a:string,b:string,c:string,i:int>"
    beside = F.arrays_zip(ordered, F.slice(ordered, 2, F.greatest(n, F.lit(1)))).cast(f"array<struct<x:{row},y:{row}>>")
    same = F.filter(beside, lambda z: (z["x"]["a"] == z["y"]["a"]) & (z["x"]["b"] == z["y"]["b"]) & (z["x"]["c"] == z["y"]["c"]))
    slow = _covered(F.array_distinct(F.concat(F.transform(same, lambda z: z["x"]["i"]), F.transform(same, lambda z: z["y"]["i"]))))
    repeated = F.when(F.size(near) == 0, F.lit(0)).when((n <= _POSITION) & ~differ, quick).otherwise(slow)
    repeated = F.when(n > _POSITION, slow).otherwise(repeated).cast("long")
    at = at.withColumn("n_repeat_words", repeated)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return at.withColumn("base_failed", failed).drop("_lines", "_packed", "_near")


def histograms(docs: DataFrame) -> DataFrame:
    """``docs`` (with _w, n_words, word_chars) with the arrays chars and common: shares of character classes (upper
    case, lower case, digits, punctuation, white space, others) and of each common word of the language and all others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.length(text).cast("long")
    upper, lower, digit, mark = (_left(text, f"[^{c}]+") for c in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"\p{P}"))
    at = docs.withColumn("_classes", F.array(upper, lower, digit, mark, whole - F.col("word_chars")))
    at = at.withColumn("_spaced", F.concat(F.lit("  "), F.lower(F.array_join("_w", "  ")), F.lit("  ")))

    def counts(words: list[str]) -> Column:
        return F.array(*(_occurrences(F.col("_spaced"), x) for x in words))

    every = sorted(set(reduce(add, COMMON_WORDS.values())))
    by_lang = reduce(lambda c, lang: c.when(F.col("lang") == lang, counts(COMMON_WORDS[lang])), COMMON_WORDS, F).otherwise(counts(every))
    at = at.withColumn("_common", by_lang)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def shares(a: Column, whole: Column) -> Column:
        full = F.concat(a.cast("array<bigint>"), F.array(F.greatest(whole - total(a), F.lit(0).cast("long"))))
        return F.transform(full, lambda x: x / F.greatest(whole, F.lit(1)))

    return at.withColumns({"chars": shares(F.col("_classes"), whole), "common": shares(F.col("_common"), F.col("n_words")), "_n_chars": whole}).drop("_classes", "_common", "_spaced")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two arrays of shares; null if one is."""

    def half(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest((half(p, q) + half(q, p)) / 2, F.lit(0.0))))


def _mean(column: str, most: int) -> Column:
    return F.filter(F.array(*(F.avg(F.get(column, F.lit(i))) for i in range(most))), lambda x: x.isNotNull())


def _verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (of doc_id and text), the counts, base_failed, kept and both distances, from one pass over the texts."""
    counted = word_counts(docs.select(F.col("doc_id").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang")).withColumn("row_key", row_key()))
    facts = materialize(histograms(counted).drop("text", "_w"), "quality-facts")
    judged = (F.col("_n_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)
    size = 1 + len(set(reduce(add, COMMON_WORDS.values())))
    # one row a language
    references = facts.where(judged & ~F.col("base_failed")).groupBy("lang").agg(_mean("chars", 6).alias("_q_chars"), _mean("common", size).alias("_q_common"))
    scored = facts.join(references, "lang", "left").withColumns({"char_distance": js_distance(F.col("chars"), F.col("_q_chars")), "word_distance": js_distance(F.col("common"), F.col("_q_common"))})
    diverges = judged & ((F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("char_distance") + F.col("word_distance") > MAX_DISTANCES))
    return scored.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(diverges, F.lit(False)))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the counts, base_failed, kept and both distances.

    Texts are read once; what they give is written to the shared folder, and references and verdicts come from there.
    """
    return _verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Equal rows share a verdict."""
    bad = _verdicts(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_bad_id"), F.col("row_key").alias("_bad_key"))
    same = (row_key() == F.col("_bad_key")) & F.col("doc_id").eqNullSafe(F.col("_bad_id"))
    # a merge join whatever the number of rows is: one plan at every size
    return docs.join(bad.hint("merge"), same, "left_anti")


def score_sql(documents: str = "documents") -> str:
    """doc_id, the counts, base_failed and kept in DuckDB SQL."""

    def counts(words: list[str]) -> str:
        return "[" + ", ".join(f"len(list_filter(w, lambda x: lower(x) = '{x}'))" for x in words) + "]"

    every = sorted(set(reduce(add, COMMON_WORDS.values())))
    by_lang = " ".join(f"when '{lang}' then {counts(words)}" for lang, words in COMMON_WORDS.items())
    classes = ", ".join(f"length(regexp_replace(t, '[^\\p{{{c}}}]+', '', 'g'))" for c in ("Lu", "Ll", "Nd", "P"))

    def distance(p: str, q: str) -> str:
        half = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: case when {0}[i] > 0 then {0}[i] * log2(2 * {0}[i] / ({0}[i] + {1}[i])) else 0.0 end))"
        return f"sqrt(greatest(({half.format(p, q)} + {half.format(q, p)}) / 2, 0.0))"

    def mean(column: str) -> str:
        return f"(select lang, list(m order by i) q from (select lang, i, avg({column}[i]) m from (select lang, {column}, unnest(range(1, len({column}) + 1)) i from fit) group by lang, i) group by lang)"

    return f"""
        with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') lang from {documents}),
        w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from d),
        windows as (select doc_id, unnest(range(1, len(w) - 1)) i, unnest([w[j:j + 2] for j in range(1, len(w) - 1)]) x from w where len(w) > 2),
        twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, x) > 1),
        covered as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from twice) group by doc_id),
        counted as (select doc_id, lang, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
            len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, length(t) whole, [{classes}] classes, case lang {by_lang} else {counts(every)} end common
            from w left join covered using (doc_id)),
        shares as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, whole >= {MIN_CHARS} and n_words >= {MIN_WORDS} judged,
            list_transform(classes || [whole - word_chars, word_chars - list_sum(classes)], lambda x: x / greatest(whole, 1)) p, list_transform(common || [n_words - list_sum(common)], lambda x: x / greatest(n_words, 1)) c from counted),
        fit as (select * from shares where judged and not base_failed),
        far as (select shares.*, {distance("p", "a.q")} char_distance, {distance("c", "b.q")} word_distance from shares left join {mean("p")} a using (lang) left join {mean("c")} b using (lang))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not base_failed and not coalesce(judged and (char_distance > {MAX_CHAR_DISTANCE} or char_distance + word_distance > {MAX_DISTANCES}), false) kept from far"""

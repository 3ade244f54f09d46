"""Quality rules (operator 6): distribution divergence from the language's own histograms, native DataFrame functions only.

One pass over the texts gives the counts of each document: words, repeats, character classes and common words. The
reference of a language is the sum of these histograms over all its documents that pass the base rules; it is gathered
by partial aggregation, a row per language. A document fails if the Jensen-Shannon distance (base 2, square root of the
divergence) of one of its histograms from the reference exceeds the limit; histograms of few characters or words are
not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stage


#: Frequent function words; each is a bin of the word histogram. Two more bins: words without letter or
#: digit, and all other words.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "on"],
    "de": ["der", "die", "und", "das", "von", "zu", "mit", "ist", "im", "den", "nicht", "ein"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "est", "pour"],
    "es": ["el", "los", "las", "del", "y", "en", "por", "con", "para", "se", "no", "su"],
}
SPACES = " \t\n\u000b\f\r"
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
WINDOW = 8
#: Character classes counted by pattern; white space and the rest (lower-case ASCII letters and what is in no class) are two more.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]", "other_sign": "[\\[\\]{}=+/\\\\^~_@`]", "wide": "[^\\x00-\\x7F]"}
MIN_WORDS, MIN_CHARS = 60, 200
WORD_LIMIT, CLASS_LIMIT = 0.45, 0.3
#: Languages up to which their references are sent to all tasks; with more they are joined by key.
BROADCAST_LANGUAGES = 10_000


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def split_words(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+"))


def document_counts(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (the columns ``keep``) and counts of each text: the base columns, ``classes`` and ``commons`` (arrays of histogram bins)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), body.alias("body"))
    base = base.withColumn("words", split_words(F.col("body")))
    n = F.size("words")
    words_at = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    low = F.split(F.lower(F.array_join("words", " ")), " ")
    first = base.select(
        "row", "lang",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length("body").cast("long").alias("n_chars"),
        *[F.regexp_count("body", F.lit(p)).cast("long").alias(c) for c, p in CLASSES.items()],
        lines.alias("lines"),
        F.when(n >= WINDOW, words_at).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter(low, lambda w: w.isin(vocabulary())).alias("hits"),
        F.size(F.filter("words", lambda w: ~w.rlike("[A-Za-z0-9]|[^\\x00-\\x7F]"))).cast("double").alias("bare"),
    )
    # windows found twice: sorted with their places, equal neighbours; most texts have none and skip the sort
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    second = first.select(
        "row", "lang", "n_words", "word_chars", "n_chars", *CLASSES,
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(twice, placed).alias("placed"), "bare",
        F.size("hits").cast("long").alias("n_hits"),
        F.array(*[(F.size("hits") - F.size(F.array_remove("hits", w))).cast("double") for w in vocabulary()]).alias("found"),
    )
    again = F.filter("placed", lambda e, k: (e["h"] == F.get("placed", k - 1)["h"]) | (e["h"] == F.get("placed", k + 1)["h"]))
    third = second.withColumn("starts", F.sort_array(F.transform(again, lambda e: e["i"])))
    # a repeated window covers eight words, or as many as lie before the next repeated one
    covered = F.aggregate(F.transform("starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    rest = F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0))
    bins = [*[F.col(c) for c in CLASSES], F.col("n_chars") - F.col("word_chars"), rest]
    return third.select(
        "row", "lang", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines",
        F.when(F.col("starts").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"), "n_chars",
        F.array(*[b.cast("double") for b in bins]).alias("classes"),
        F.concat("found", F.array("bare", F.col("n_words") - F.col("n_hits") - F.col("bare"))).alias("commons"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def references(counts: DataFrame) -> DataFrame:
    """A row per language: the summed histograms of its documents that pass the base rules."""
    bins = {"classes": len(CLASSES) + 2, "commons": len(vocabulary()) + 2}
    good = counts.where(~F.col("base_failed"))
    sums = good.groupBy("lang").agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c, n in bins.items() for i in range(n)])
    return sums.select("lang", *[F.array(*[F.col(f"{c}_{i}") for i in range(n)]).alias(f"ref_{c}") for c, n in bins.items()])


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or missing."""
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    both = F.zip_with(
        F.transform(counts, lambda x: x / total(F.col(counts))), F.transform(reference, lambda x: x / total(F.col(reference))),
        lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    known = (total(F.col(counts)) > 0) & (total(F.col(reference)) > 0)
    return F.when(known, F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def judge(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``class_distance``, ``word_distance`` and ``kept``; a distance that is not judged is null."""
    joined = counts.join(F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs, "lang", "left")
    far = joined.withColumns({
        "class_distance": F.when(F.col("n_chars") >= MIN_CHARS, distance("classes", "ref_classes")),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS, distance("commons", "ref_commons")),
    })
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    return far.withColumn("kept", ~F.col("base_failed") & near)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, distances and verdict of every row; see ``document_counts`` and ``judge``.

    Null and empty texts have no words and fail the base rules. A null language is a language of its own. Repeated rows
    are judged alike, each gives a row. ``keep`` names the columns that are carried along in the struct ``row``, so that
    names cannot clash. Without documents the result is empty. The counts are written once to the shared folder, so that texts are read once.
    """
    counts = stage(document_counts(docs, text, lang, keep), "quality")
    return judge(counts, stage(references(counts), "references"))

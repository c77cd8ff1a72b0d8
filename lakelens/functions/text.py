"""Text measures as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9']+"
PRONOUN_START = r"(?i)^(He|She|It|They|We|This|These|Him|Her|Them|Its|Their|His|Hers)\b"
DEFINITION = r"(?iU)\b\w+\s+is\s+(a|an|the)\s+\w+"
NUMBER_UNIT = r"(?iU)\b\d[\d,.]*\s*(%|percent|million|billion|thousand|km|kg|mb|gb|tb|ms|seconds?|minutes?|hours?|days?|years?|users?|customers?|countries?|dollars?|\$)"
COMPARISON = r"(?iU)\b(than|compared to|vs\.?|versus|faster|slower|more than|less than|cheaper|better than|worse than)\b"


def word_count(text: Column) -> Column:
    """Words of ASCII letters, digits and apostrophes; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def trigrams(text: Column) -> Column:
    """The set of word trigrams, as an array; empty below three words."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
        return F.when(F.size(w) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    # As a lambda's argument the words are split once, not once for each trigram.
    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def trigram_keys(text: Column) -> Column:
    """trigrams() by 64-bit hashes, without making their texts."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.array_distinct(each))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def trigram_hash(text: Column) -> Column:
    """sha256: and the digest of the sorted trigrams; below three words that of an empty text."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(trigrams(text)), "\n").cast("binary"), 256))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def sentences(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U:\s)+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def pronoun_percent(text: Column) -> Column:
    """Share of sentences that start with a pronoun, rounded half to even; null without sentences."""

    def of(s: Column) -> Column:
        hits = F.size(F.filter(s, lambda x: x.rlike(PRONOUN_START)))
        return F.when(F.size(s) > 0, F.bround(100 * hits / F.size(s))).cast("int")

    return F.get(F.transform(F.array(sentences(text)), of), F.lit(0))


def has_evidence(text: Column) -> Column:
    """A definition, a number with a unit or a comparison."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(DEFINITION) | t.rlike(NUMBER_UNIT) | t.rlike(COMPARISON)

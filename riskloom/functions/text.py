"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def distinct_characters(text: Column) -> Column:
    """characters() without repeats; only the few that differ are looked at one by one."""
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty or null text. Of the sorted characters each run is one character's count."""
    n = F.length(text)

    def bits(run):
        p = F.length(run) / n
        return -p * F.log2(p)

    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    total = F.aggregate(F.transform(F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0)), bits), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(total)


def vowels(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(f"[{VOWELS}]"))


def consonants(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(f"[a-z&&[^{VOWELS}]]"))


def consonant_vowel_ratio(text: Column) -> Column:
    """Infinite with consonants but no vowel, 0 with neither."""
    c, v = consonants(text), vowels(text)
    return F.when(v > 0, c / v).when(c > 0, float("inf")).otherwise(0.0)


def max_consonant_run(text: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z&&[^{VOWELS}]]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def digit_fraction(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.regexp_count(text, F.lit("[0-9]")) / n)


def ngram_frequency_score(text: Column, n: int = 2) -> Column:
    """Distinct n-grams over all of them; 0 for a shorter text."""
    size = F.length(text) - (n - 1)
    # each match is one character; the n-gram that begins with it is looked ahead at
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(size > 0, F.size(F.array_distinct(grams)) / size).otherwise(0.0)


def unique_char_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.size(distinct_characters(text)) / n)


def first_body(domain: Column) -> Column:
    """What stands before the first dot."""
    return F.substring_index(domain, ".", 1)


def last_body(domain: Column) -> Column:
    """What stands before the last dot; the whole if there is none."""
    return F.regexp_replace(domain, r"\.[^.]*$", "")


def top_level(domain: Column) -> Column:
    return F.when(F.contains(domain, F.lit(".")), F.substring_index(domain, ".", -1)).otherwise("")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def truthy(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))



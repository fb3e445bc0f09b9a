"""Scalar text functions as Columns (JVM side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width punctuation and its ASCII form.
FULL_WIDTH = "，。！？；：（）【】“”‘’"
ASCII_FORM = ",.!?;:()[]\"\"''"


def normalize(text: Column) -> Column:
    """Punctuation, spacing, the QE fixes and Latin lower case, in this order."""
    t = F.translate(text, FULL_WIDTH, ASCII_FORM)
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), r"\s+$", "")
    t = F.regexp_replace(t, r"\s+([,.!?:;])", "$1")
    t = F.regexp_replace(t, "(?i)Q1", "QE")
    return F.regexp_replace(t, r"(?i)(?<![A-Za-z])eq(?![A-Za-z])", "QE")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def html_to_text(html: Column) -> Column:
    """Line breaks, tags and five entities; collapses blank runs."""
    t = F.regexp_replace(html, "(?i)<br ?/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, "[ \t]+", " ")


def sentences(text: Column, least: int = 4, most: int = 200) -> Column:
    """Array of trimmed sentences of least..most characters."""
    parts = F.transform(F.split(text, "[。！？?!；;．\n]", -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x).between(least, most))


def char_ngrams(text: Column, low: int, high: int, keep: str = r"[^\p{L}\p{N}-]") -> Column:
    """All character n-grams of the kept characters, shorter ones first."""
    clean = F.regexp_replace(text, keep, "")
    of = lambda n: F.when(F.length(clean) >= n, F.transform(F.sequence(F.lit(1), F.length(clean) - n + 1), lambda i: F.substring(clean, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def occurrences(text: Column, surface: Column) -> Column:
    """Zero-based starts of every occurrence, overlapping ones included."""
    n = F.length(text) - F.length(surface) + 1
    return F.when(F.contains(text, surface) & (F.length(surface) > 0), F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.substring(text, i + 1, F.length(surface)) == surface, i)), lambda x: x.isNotNull()))


def srt_time(ms: Column) -> Column:
    whole = lambda n: F.floor(ms / n)
    return F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def hamming_plus(a: Column, b: Column) -> Column:
    """Mismatches over the shorter length plus the length difference; difference plus 3 when that exceeds 3."""
    diff = F.abs(F.length(a) - F.length(b))
    common = F.least(F.length(a), F.length(b))
    miss = F.when(common > 0, F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda z: z))).otherwise(0)
    return F.when(diff > 3, diff + 3).otherwise(miss + diff)


def comparable(text: Column) -> Column:
    """For evaluation: no white space, digits as Chinese numerals."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "0123456789", "零一二三四五六七八九")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 where either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)

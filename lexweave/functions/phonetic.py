"""Syllables of CJK text and indel similarity, for use inside Arrow functions.

A reading table maps one character to its toneless syllable. `han_readings` derives it on the driver
from the transliteration rules of the ICU library that Spark ships: its size is that of a Unicode
block, whatever the data. ICU knows one reading per character; `overrides` replaces single ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FIRST, LAST = 0x4E00, 0x9FFF


def _toneless(latin: str) -> str:
    marks = unicodedata.normalize("NFD", latin).replace("ü", "v")
    return "".join(c for c in marks if not unicodedata.combining(c))


def _icu(spark: SparkSession, rule: str, text: str) -> str:
    return spark._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate(text)


def han_readings(spark: SparkSession, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Character -> syllable, for the CJK block; kept on the session's context after the first call."""
    held = getattr(spark.sparkContext, "_lexweave_readings", None)
    if held is None:
        chars = [chr(c) for c in range(FIRST, LAST + 1)]
        latin = _icu(spark, "Han-Latin", "\n".join(chars)).split("\n")
        held = {c: s for c, s in zip(chars, map(_toneless, map(str.strip, latin)), strict=True) if s.isascii() and s.isalpha()}
        spark.sparkContext._lexweave_readings = held
    return {**held, **(overrides or {})}


def simplified(spark: SparkSession, text: Column) -> Column:
    """Traditional to simplified characters, one for one, as a translate()."""
    pair = getattr(spark.sparkContext, "_lexweave_simplified", None)
    if pair is None:
        chars = [chr(c) for c in range(FIRST, LAST + 1)]
        plain = _icu(spark, "Traditional-Simplified", "\n".join(chars)).split("\n")
        changed = [(c, s) for c, s in zip(chars, plain, strict=True) if c != s and len(s) == 1]
        pair = ("".join(c for c, _ in changed), "".join(s for _, s in changed))
        spark.sparkContext._lexweave_simplified = pair
    return F.translate(text, *pair)


def syllables(text: str, readings: Mapping[str, str]) -> list[str]:
    return [readings[c] for c in text if c in readings]


@lru_cache(maxsize=65536)
def _places(a: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence; one big integer holds the state of all positions of a."""
    where = _places(a)
    full = (1 << len(a)) - 1
    open_ = full
    for y in b:
        hit = open_ & where.get(y, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity in percent: 200 x common / total length; 100 for two empty ones."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def spelled(text: Column, readings: Mapping[str, str]) -> Column:
    """The syllables of a text, joined by spaces."""

    @F.pandas_udf("string")
    def spell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else " ".join(syllables(t, readings)))

    return spell(text)


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column form of ratio(); null where either side is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_pairs(left: DataFrame, right: DataFrame, least: Column, floor: float) -> DataFrame:
    """left(l), right(r), distinct strings: pairs with ratio at or above `least`, a Column over l (percent).

    `floor` is the smallest value `least` takes. Two strings that reach it share at least
    alpha = ceil(n * f / (2 - f)) numbered characters, n being the length of either one, f the floor's
    fraction; so each of them lists its n - alpha + 1 first ones in one common order, and every such
    pair meets in that list. Nothing is lost, and no pair without a shared listed character is made."""
    f = floor / 100.0

    def listed(d: DataFrame, c: str) -> DataFrame:
        chars = F.array_sort(F.split(F.col(c), ""))
        # the k-th occurrence of a character: its distance from the character's first place in sorted order
        numbered = F.transform(chars, lambda x, i: F.concat(x, (i - F.array_position(chars, x)).cast("string")))
        rare = F.reverse(numbered)  # late letters are rarer than early ones, blanks come last
        keep = F.length(c) - F.ceil(F.length(c) * f / (2 - f) - 1e-9) + 1
        return d.filter(F.length(c) > 0).select(c, F.length(c).alias(f"n{c}"), F.explode(F.slice(rare, F.lit(1), keep.cast("int"))).alias("t"))

    a, b = listed(left, "l"), listed(right, "r")
    fits = 200.0 * F.least("nl", "nr") >= F.lit(floor) * (F.col("nl") + F.col("nr"))
    pairs = a.join(b, "t").filter(fits).select("l", "r").distinct()
    return pairs.withColumn("ratio", indel_ratio("l", "r")).filter(F.col("ratio") >= least)

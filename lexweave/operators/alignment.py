"""Spans of a text that sound like a dictionary term, scored by ordered syllable alignment.

`Aligner.judge` weighs one span against one term, `Aligner.best` searches a text's CJK runs for the
best span. `Search` describes a search; the four kinds of candidate expansion are four values of it.
On DataFrames, `expand` runs them over (cue, term) pairs in one Arrow function, so windows of a text
never become rows, and `sounds_like` joins tokens to a dictionary without testing every pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.phonetic import ratio, similar_pairs, spelled, syllables
from lexweave.session import shuffle_partitions

RUN = re.compile("[一-鿿]+")
ASCII_WORD = re.compile("[A-Za-z0-9]")

# Thresholds of alignment.
CLOSE, LOOSE = 65.0, 55.0
CHAR_WEIGHT, PREFIX_SCORE, REPEAT_SCORE = 0.85, 0.82, 0.68
PARTIAL_SCORE, PARTIAL_SURFACE, PARTIAL_TARGET, PARTIAL_EXTRA = 0.73, 0.40, 0.30, 0.40
EXACT_SURFACE, EXACT_TARGET = 0.80, 0.75
PREFIX_CHARS, PREFIX_SURFACE, PREFIX_TARGET = 3, 0.90, 0.50
RELAXED_TARGET_CHARS, RELAXED_SURFACE_CHARS, RELAXED_SURFACE, RELAXED_TARGET = 4, 3, 0.75, 0.50

# Categories whose terms are expanded, and those that give hints.
HOT = ("character", "weapon", "artifact", "artifact_piece", "skill", "constellation", "constellation_group", "enemy", "domain")
HOT_HINTS = ("character", "weapon", "artifact", "artifact_piece", "skill", "constellation", "constellation_group")

REMEMBERED = 200_000  # results an aligner keeps; no result depends on it

MATCH = "surface string, start_char int, end_char int, score double, match_kind string, surface_coverage double, target_coverage double, extra_surface_ratio double"


@dataclass(frozen=True)
class Search:
    """How far a span's length may be from the term's, and what is accepted."""

    source: str
    least: float
    slack: int | None = 1  # None: lengths 2 to `longest`
    longest: int = 6
    prefix: bool = False
    relaxed: float | None = None  # second chance down to this score, for longer terms
    trim: tuple[str, ...] = ()  # endings that are not part of a span
    skip_equal: bool = True
    min_chars: int = 1

    def lengths(self, term: str) -> range:
        low, high = (2, self.longest) if self.slack is None else (len(term) - self.slack, len(term) + self.slack)
        return range(max(2, low), high + 1)


CONSISTENCY = Search("entity_consistency", 0.72, skip_equal=False)
LONG_VARIANT = Search("long_entity_variant", 0.70, slack=2, prefix=True, relaxed=0.62, trim=("大招",))
LOCAL = Search("local_term", 0.74, slack=None)
HINT = Search("terminology_requery_hint", 0.72, prefix=True, min_chars=2)


@dataclass(frozen=True)
class Match:
    score: float
    kind: str
    surface: float
    target: float
    start: int = 0
    end: int = 0

    @property
    def extra(self) -> float:
        return 1.0 - self.surface


@dataclass
class Aligner:
    readings: Mapping[str, str]
    _close: dict = field(default_factory=dict, repr=False)
    _weighed: dict = field(default_factory=dict, repr=False)

    def closeness(self, a: str, b: str) -> float:
        """ratio() of two syllables; there are only some hundred of them."""
        key = (a, b)
        if key not in self._close:
            self._close[key] = ratio(a, b)
        return self._close[key]

    def walk(self, surface: list[str], target: list[str], loose: bool = True) -> tuple[int, int]:
        """Ordered matching from left to right: (close matches, loose ones). A syllable takes the first
        close one that is left, otherwise the best loose one; target syllables may be skipped."""
        at = close = weak = 0
        for s in surface:
            left = [self.closeness(s, t) for t in target[at:]]
            near = next((i for i, x in enumerate(left) if x >= CLOSE), None)
            if near is not None:
                close, at = close + 1, at + near + 1
            elif loose and left and max(left) >= LOOSE:
                weak, at = weak + 1, at + left.index(max(left)) + 1
        return close, weak

    def likeness(self, span: str, term: str, s: list[str], t: list[str]) -> float:
        return max(ratio(" ".join(t), " ".join(s)), CHAR_WEIGHT * ratio(term, span)) / 100.0

    def judge(self, span: str, term: str, prefix: bool = False, policy: str = "repair_to_canonical", source: str = "") -> Match | None:
        """The match of a span with a term, or None where the evidence is too weak.

        preserve_surface never lengthens a span, and neither does a language model without a policy."""
        if not span or not term.strip() or ASCII_WORD.search(span):
            return None
        if len(term) > len(span) and (policy == "preserve_surface" or (policy == "unknown" and source == "language_model")):
            return None
        s, t = syllables(span, self.readings), syllables(term, self.readings)
        score = self.likeness(span, term, s, t)
        if not prefix and score < PARTIAL_SCORE and span != term and s != t:
            return None  # no other kind is left
        leads = len(s) <= len(t) and all(self.closeness(a, b) >= CLOSE for a, b in zip(s, t, strict=False))
        if leads and prefix:
            score = max(score, PREFIX_SCORE)
        close, weak = self.walk(s, t) if s and t else (0, 0)
        cover = (close + weak) / len(s) if s and t else 0.0
        reach = close / len(t) if s and t else 0.0
        chars = sum(map(len, RUN.findall(span)))
        if span == term:
            kind, ok = "exact", True
        elif s == t and len(span) == len(term):
            kind, ok = "phonetic_exact", cover >= EXACT_SURFACE and reach >= EXACT_TARGET
        elif leads and prefix and s and t:
            kind, ok = "phonetic_prefix", chars >= PREFIX_CHARS and cover >= PREFIX_SURFACE and reach >= PREFIX_TARGET
        else:
            kind, ok = "phonetic_partial", score >= PARTIAL_SCORE and cover >= PARTIAL_SURFACE and reach >= PARTIAL_TARGET and 1.0 - cover <= PARTIAL_EXTRA
        return Match(round(score, 3), kind, round(cover, 3), round(reach, 3)) if ok and chars >= 2 else None

    def judge_relaxed(self, span: str, term: str, least: float) -> Match | None:
        """Second chance of a confirmed entity: a doubled first syllable, or most syllables in order."""
        s, t = syllables(span, self.readings), syllables(term, self.readings)
        if span == term or ASCII_WORD.search(span) or not s or not t:
            return None
        if (len(term), len(span), len(s)) == (3, 2, 2) and all(self.closeness(x, t[0]) >= CLOSE for x in s):
            return Match(REPEAT_SCORE, "stable_entity_repeated_syllable", 1.0, round(2 / len(t), 3))
        if len(term) < RELAXED_TARGET_CHARS or len(span) < RELAXED_SURFACE_CHARS:
            return None
        cover = self.walk(s, t, loose=False)[0] / len(s)
        reach, score = min(1.0, cover * len(s) / len(t)), self.likeness(span, term, s, t)
        if cover < RELAXED_SURFACE or reach < RELAXED_TARGET or score < least:
            return None
        return Match(round(score, 3), "stable_entity_relaxed", round(cover, 3), round(reach, 3))

    def weigh(self, span: str, term: str, how: Search) -> Match | None:
        """As _weigh; the same spans come up again and again, so results are kept while there is room."""
        key = (span, term, how.source)
        if key not in self._weighed:
            if len(self._weighed) >= REMEMBERED:
                self._weighed.clear()
            self._weighed[key] = self._weigh(span, term, how)
        return self._weighed[key]

    def _weigh(self, span: str, term: str, how: Search) -> Match | None:
        strict = self.judge(span, term, how.prefix, source=how.source)
        if strict and strict.score >= how.least:
            return strict
        again = self.judge_relaxed(span, term, how.relaxed) if how.relaxed is not None else None
        return strict if strict and again and strict.score >= again.score else again

    def every(self, text: str, term: str, how: Search) -> Iterator[Match]:
        """All accepted spans, by run, length and place."""
        for run in RUN.finditer(text):
            for n in how.lengths(term):
                for start in range(run.start(), run.end() - n + 1):
                    end = trimmed(text, start, start + n, how.trim) if how.trim else start + n
                    span = text[start:end]
                    if end - start < 2 or (how.skip_equal and span == term):
                        continue
                    m = self.weigh(span, term, how)
                    if m:
                        yield Match(m.score, m.kind, m.surface, m.target, start, end)

    def best(self, text: str | None, term: str | None, how: Search) -> Match | None:
        """The first span of the highest score; None if the term is already in the text."""
        if not text or not term or len(term) < how.min_chars or term in text:
            return None
        return max(self.every(text, term, how), key=lambda m: m.score, default=None)


def trimmed(text: str, start: int, end: int, endings: tuple[str, ...]) -> int:
    """Where a span ends without an operation name, or without 长 before the key E."""
    for tail in endings:
        if text.endswith(tail, start, end):
            end -= len(tail)
    long_press = text.endswith("长", start, end) and text[end : end + 1] in ("e", "E")
    return end - 1 if long_press else end


def best_span(text: Column, term: Column, readings: Mapping[str, str], how: Search) -> Column:
    """The best match of term in text as a struct, null if there is none."""

    @F.pandas_udf(MATCH)
    def search(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(readings)
        names = ["surface", "start_char", "end_char", "score", "match_kind", "surface_coverage", "target_coverage", "extra_surface_ratio"]
        for texts, terms in parts:
            found = [(x, aligner.best(x, y, how)) for x, y in zip(texts, terms, strict=True)]
            rows = [(x[m.start : m.end], m.start, m.end, m.score, m.kind, m.surface, m.target, round(m.extra, 3)) if m else (None,) * 8 for x, m in found]
            yield pd.DataFrame(rows, columns=names).astype({"start_char": "Int32", "end_char": "Int32"})

    return search(text, term)


def expand(cues: DataFrame, stable: DataFrame, entries: DataFrame, readings: Mapping[str, str], how: Search, top: int | None = 2, categories: tuple[str, ...] = HOT, by_parent: bool = False) -> DataFrame:
    """Candidates of one search over cues(doc_id, cue_index, text).

    stable(doc_id, cue_index, entity) names the entities confirmed at each cue, entries(surface, term,
    category, parent) the dictionary. by_parent also admits terms whose parent is confirmed. One best
    span per (cue, term), then `top` of each cue, ties by term. A null or empty text has no span."""
    hot = entries.filter(F.coalesce("category", F.lit("")).isin(*categories))
    keyed = hot.select(F.col("surface").alias("entity"), "term", "category", "parent")
    if by_parent:
        own = hot.select(F.col("term").alias("entity"), "term", "category", "parent")
        keyed = own.unionByName(hot.filter("parent <> ''").select(F.col("parent").alias("entity"), "term", "category", "parent"))
    pairs = stable.join(keyed.dropDuplicates(["entity", "term"]), "entity").select("doc_id", "cue_index", "term", "category", "parent").dropDuplicates(["doc_id", "cue_index", "term"])
    d = cues.select("doc_id", "cue_index", "text").join(pairs, ["doc_id", "cue_index"]).filter(~F.contains("text", "term"))
    d = d.repartition(shuffle_partitions(cues.sparkSession), "doc_id", "cue_index", "term")  # few bytes, much work: not to be coalesced
    d = d.withColumn("m", best_span(F.col("text"), F.col("term"), readings, how)).filter(F.col("m.score").isNotNull())
    d = d.select("doc_id", "cue_index", F.col("term").alias("value"), "category", "parent", "m.*", F.lit(how.source).alias("source"))
    if top is None:
        return d
    w = Window.partitionBy("doc_id", "cue_index").orderBy(F.col("score").desc(), "value")
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def merge(kept: DataFrame, added: DataFrame, k: int = 4) -> DataFrame:
    """Joins two candidate tables: one row per (cue, surface, value, span), the higher score, kept ones
    first on ties; then k of each cue by score, inexact before exact."""
    d = kept.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    same = Window.partitionBy("doc_id", "cue_index", "surface", "value", "start_char", "end_char").orderBy(F.col("score").desc(), "_new")
    cue = Window.partitionBy("doc_id", "cue_index").orderBy(F.col("score").desc(), F.coalesce(F.col("match_kind") == "exact", F.lit(False)), "_new", "value", "start_char", "surface")
    d = d.withColumn("_r", F.row_number().over(same)).filter("_r = 1")
    return d.withColumn("_r", F.row_number().over(cue)).filter(F.col("_r") <= k).drop("_r", "_new")


def expansion_summary(proposed: DataFrame, retained: DataFrame) -> DataFrame:
    """Candidates by source, before and after the merge."""
    after = retained.groupBy("source").agg(F.count("*").alias("retained"))
    return proposed.groupBy("source").agg(F.count("*").alias("proposed")).join(after, "source", "left").fillna(0, ["retained"])


def least_ratio(length: Column) -> Column:
    """Percent that a token of this length must reach."""
    return F.when(length <= 2, 80.0).when(length == 3, 76.0).otherwise(72.0)


def sounds_like(tokens: DataFrame, entries: DataFrame, active: DataFrame, cold: tuple[str, ...] = (), readings: Mapping[str, str] | None = None) -> DataFrame:
    """tokens(doc_id, cue_index, token, start_char) against entries(surface, term, category, parent, seq).

    active(doc_id, name) holds a document's active parents and active cold categories. Best ratio per
    token, earlier dictionary rows on ties. Terms of a dormant cold category are only probes: the best
    one of each (cue, category), where the token has no other match. Without readings, strings are
    compared as written. Distinct tokens are matched once, by similar_pairs."""
    spell = lambda c: spelled(c, readings) if readings is not None else c
    need = least_ratio(F.length("token"))
    own = tokens.select("token").distinct().withColumn("l", spell(F.col("token"))).filter(F.length(F.trim("l")) > 0)
    dictionary = entries.filter(F.length("surface") >= 2).withColumn("r", spell(F.col("surface")))
    pairs = similar_pairs(own.select("l").distinct(), dictionary.select("r").filter("r <> ''").distinct(), F.lit(72.0), 72.0)
    found = own.join(pairs, "l").join(dictionary, "r").filter(F.col("ratio") >= need).select("token", "term", "category", "parent", "seq", "ratio")
    d = tokens.join(found, "token")
    names = active.select("doc_id", F.col("name").alias("parent"), F.lit(True).alias("_p")).distinct()
    kinds = active.select("doc_id", F.col("name").alias("category"), F.lit(True).alias("_c")).distinct()
    d = d.join(names, ["doc_id", "parent"], "left").join(kinds, ["doc_id", "category"], "left")
    dormant = F.coalesce("category", F.lit("")).isin(*cold) & F.col("_c").isNull() if cold else F.lit(False)
    scoped = F.when(F.length("token") <= 2, F.col("_p").isNotNull()).otherwise(F.col("_p").isNotNull() | (F.coalesce("parent", F.lit("")) == ""))
    d = d.withColumn("_probe", dormant).filter(F.col("_probe") | scoped)
    token = Window.partitionBy("doc_id", "cue_index", "token", "start_char").orderBy("_probe", F.col("ratio").desc(), "seq")
    d = d.withColumn("_r", F.row_number().over(token)).filter("_r = 1")
    one = Window.partitionBy("doc_id", "cue_index", "_probe", "category").orderBy(F.col("ratio").desc(), "start_char", "token")
    d = d.withColumn("_r", F.row_number().over(one)).filter("NOT _probe OR _r = 1")
    score = F.least(F.col("ratio") * 1.05, F.lit(100.0)) / 100.0
    return d.select("doc_id", "cue_index", F.col("token").alias("surface"), "start_char", (F.col("start_char") + F.length("token")).alias("end_char"), F.col("term").alias("value"), "category", "parent", score.alias("score"), F.when(F.col("_probe"), "pinyin_probe").otherwise("pinyin").alias("source"))

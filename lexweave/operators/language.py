"""Surfaces that read unlike the corpus: n-gram scores, nearest aliases, contexts, and the detector on them."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.correction import containment_spans

SOUND_WEIGHT, NEAR, ODD, KNOWN_SCORE = 0.85, 0.5, 0.45, 0.95
CJK = "[一-鿿]"


def _listed(d: DataFrame, most: int = 100_000) -> DataFrame:
    """A list for a join: broadcast if it has few rows, else shuffled.

    Spark goes by the size of files, compressed as they are, and knows none of a list made on the driver; so it
    would broadcast what is joined to the list. What grows with the texts has the hint to merge, for the same reason."""
    return F.broadcast(d) if d.limit(most + 1).count() <= most else d.hint("merge")


def alikeness(a: str, b: str, readings: Mapping[str, str]) -> float:
    """The better of matching characters and (weighed less) matching sounds."""
    sound = lambda x: "".join(readings.get(c, c) for c in x)
    match = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    return max(match(a, b), SOUND_WEIGHT * match(sound(a), sound(b)))


def nearest_alias(surfaces: DataFrame, aliases: DataFrame, readings: Mapping[str, str]) -> DataFrame:
    """surfaces(surface) with the most alike alias of aliases(alias, seq) and its likeness; null below 0.5.

    Candidates share a character or a letter of their sound, without which both likenesses are 0, so they
    meet by equi-join on distinct symbols. Earlier aliases win ties."""

    @F.pandas_udf("array<string>")
    def symbols(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: sorted(set(t) | set("".join(readings.get(c, c) for c in t))))

    @F.pandas_udf("double")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([alikeness(x, y, readings) for x, y in zip(a, b, strict=True)], dtype="float64")

    own = surfaces.filter("surface IS NOT NULL").select("surface").distinct()
    s = own.select("surface", F.explode(symbols("surface")).alias("t"))
    a = aliases.select("alias", "seq", F.explode(symbols("alias")).alias("t"))
    pairs = s.join(_listed(a), "t").select("surface", "alias", "seq").distinct().withColumn("likeness", alike("surface", "alias"))
    best = pairs.groupBy("surface").agg(F.max_by(F.struct("alias", "likeness"), F.struct("likeness", -F.col("seq"))).alias("m"))
    return own.join(best.hint("merge"), "surface", "left").select("surface", F.when(F.col("m.likeness") >= NEAR, F.col("m.alias")).alias("alias"), F.coalesce("m.likeness", F.lit(0.0)).alias("likeness"))


def alias_contexts(sentences: DataFrame, aliases: DataFrame, width: int = 2, k: int = 10) -> DataFrame:
    """(alias, context, n): up to k most frequent texts of `width` characters beside an alias' first place
    in a sentence(sentence_id, text); ties by text."""
    d = first_places(sentences, aliases)
    before, after = F.substring("text", F.greatest(F.lit(1), F.col("at") + 1 - width), F.least(F.lit(width), F.col("at"))), F.substring("text", F.col("at") + 1 + F.length("surface"), F.lit(width))
    c = d.select(F.col("surface").alias("alias"), F.explode(F.filter(F.array(before, after), lambda x: x != "")).alias("context")).groupBy("alias", "context").agg(F.count("*").alias("n"))
    w = Window.partitionBy("alias").orderBy(F.col("n").desc(), "context")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_places(sentences: DataFrame, aliases: DataFrame) -> DataFrame:
    """(sentence_id, text, surface, at): the first place of each alias in each sentence."""
    s = sentences.select(F.col("sentence_id").alias("doc_id"), F.lit(0).alias("cue_index"), "text")
    found = containment_spans(s, aliases.select("surface").distinct()).groupBy("doc_id", "surface").agg(F.min("start_char").cast("int").alias("at"))
    return found.withColumnRenamed("doc_id", "sentence_id").join(sentences.hint("merge"), "sentence_id")


def context_patterns(sentences: DataFrame, entities: DataFrame, width: int = 5, keep: str = r"[^一-鿿]") -> DataFrame:
    """(entity, gram, n): bigrams within `width` characters around an entity's first place."""
    d = first_places(sentences, entities)
    low = F.greatest(F.lit(0), F.col("at") - width)
    around = F.substring("text", low + 1, F.col("at") - low + F.length("surface") + width)
    return d.select(F.col("surface").alias("entity"), F.explode(T.char_ngrams(around, 2, 2, keep)).alias("gram")).groupBy("entity", "gram").agg(F.count("*").alias("n"))


def surface_scores(surfaces: DataFrame, grams: DataFrame, near: DataFrame, contexts: DataFrame) -> DataFrame:
    """(surface, score): the mean of those of four parts that apply: bigrams, trigrams, the nearest alias'
    contexts (0.9 if one is in the surface, 0.2 if none, 0.4 if it has none), and bigram coverage."""
    totals = grams.groupBy("n").agg(F.sum("cnt").alias("total"))  # a row for each n
    g = surfaces.select("surface", F.explode(T.char_ngrams(F.col("surface"), 2, 3, "$^")).alias("gram")).withColumn("n", F.length("gram"))
    g = g.join(grams.select("gram", "cnt").hint("merge"), "gram", "left").join(F.broadcast(totals), "n")
    part = F.least(F.coalesce("cnt", F.lit(0)) / F.greatest(F.lit(1.0), F.col("total") * 0.001), F.lit(1.0))
    of = lambda n, x: F.avg(F.when(F.col("n") == n, x))
    s = g.groupBy("surface").agg(of(2, part).alias("bi"), of(3, part).alias("tri"), of(2, F.col("cnt").isNotNull().cast("double")).alias("cover"))
    beside = contexts.groupBy("alias").agg(F.collect_list("context").alias("_ctx"))  # at most ten of an alias
    d = surfaces.select("surface").distinct().join(near.select("surface", "alias").hint("merge"), "surface", "left").join(s.hint("merge"), "surface", "left").join(_listed(beside), "alias", "left")
    fits = F.exists("_ctx", lambda x: F.contains(F.col("surface"), x))
    hint = F.when(F.col("alias").isNull(), F.lit(None)).when(F.col("_ctx").isNull(), 0.4).when(fits, 0.9).otherwise(0.2)
    parts = F.filter(F.array(F.coalesce("bi", F.lit(0.5)), F.col("tri"), hint, F.col("cover")), lambda x: x.isNotNull())
    return d.select("surface", (F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).alias("score"))


def surfaces_of(cues: DataFrame, letter: str = CJK) -> DataFrame:
    """(doc_id, cue_index, surface, start_char): distinct windows of 2 to 4 letters, at their first place."""
    at = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(0), F.length("text") - n), lambda i: F.struct(F.substring("text", i + 1, F.lit(n)).alias("surface"), i.alias("start_char"))))
    every = F.flatten(F.filter(F.array(at(2), at(3), at(4)), lambda x: x.isNotNull()))
    d = cues.select("doc_id", "cue_index", F.explode(F.filter(every, lambda x: x["surface"].rlike(f"^(?:{letter})+$"))).alias("w"))
    return d.groupBy("doc_id", "cue_index", F.col("w.surface").alias("surface")).agg(F.min("w.start_char").alias("start_char"))


def detect(cues: DataFrame, known: DataFrame, grams: DataFrame, contexts: DataFrame, readings: Mapping[str, str], letter: str = CJK, odd: float = ODD) -> DataFrame:
    """Candidates for cues(doc_id, cue_index, text), with the cue's risk.

    known(surface, canonical, seq) are accepted aliases: where one occurs it is a candidate that keeps
    its surface, and windows that overlap one are not judged. Others are odd if their score is below
    `odd`; with a near alias they become a candidate for it."""
    w = surfaces_of(cues, letter)
    spans = containment_spans(cues, known.select("surface"))
    own = spans.select("doc_id", "cue_index", "surface").distinct().join(w.hint("merge"), ["doc_id", "cue_index", "surface"]).join(_listed(known.select("surface", "canonical")), "surface")
    k = spans.select(F.col("doc_id").alias("kd"), F.col("cue_index").alias("kc"), F.col("start_char").alias("ks"), F.col("end_char").alias("ke"))
    end = F.col("start_char") + F.length("surface")
    free = w.join(k.hint("merge"), (F.col("doc_id") == F.col("kd")) & (F.col("cue_index") == F.col("kc")) & (F.col("start_char") < F.col("ke")) & (F.col("ks") < end), "left_anti")
    near = nearest_alias(free.select("surface"), known.select(F.col("surface").alias("alias"), "seq"), readings)
    scores = surface_scores(free.select("surface").distinct(), grams, near, contexts)
    # one join of the windows: a frequent surface can be split
    strange = free.join(scores.filter(F.col("score") < odd).join(near.filter("alias IS NOT NULL").hint("merge"), "surface").hint("merge"), "surface")
    canon = known.select(F.col("surface").alias("alias"), "canonical")
    c1 = strange.join(_listed(canon), "alias").select("doc_id", "cue_index", "surface", "start_char", F.col("alias").alias("value"), "canonical", (1 - F.round("score", 3)).alias("score"), F.lit("contextual_expand").alias("expansion_policy"), F.lit("lm_near_alias").alias("evidence_type"))
    c2 = own.select("doc_id", "cue_index", "surface", "start_char", F.col("surface").alias("value"), "canonical", F.lit(KNOWN_SCORE).alias("score"), F.lit("preserve_surface").alias("expansion_policy"), F.lit("known_alias").alias("evidence_type"))
    d = c1.unionByName(c2)
    risk = F.max(F.when(F.col("evidence_type") == "lm_near_alias", F.col("score"))).over(Window.partitionBy("doc_id", "cue_index"))
    return d.withColumn("risk", F.round(F.coalesce(risk, F.lit(0.0)), 3))



"""Finding terms in text: exact tokens, nicknames by sound, look-up by letters and sound, misheard names.

Detectors and retrievers are plain functions of cues (doc_id, cue_index, text) that return rows
(doc_id, cue_index, risk) or candidates; `Detectors` holds them by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexweave.functions import text as T
from lexweave.functions.phonetic import ratio, similar_pairs, spelled

Detector = Callable[[DataFrame], DataFrame]
AT = ("doc_id", "cue_index")


class Detectors:
    """Detectors by name; run() unites their results, and rows of those that aren't configured carry risk 0."""

    def __init__(self) -> None:
        self.known: dict[str, Detector] = {}

    def add(self, name: str, detector: Detector) -> Detectors:
        if name in self.known:
            raise ValueError(f"a detector named {name} is there already")
        self.known[name] = detector
        return self

    def run(self, cues: DataFrame) -> DataFrame:
        """doc_id, cue_index, detector, risk, configured."""
        parts = [f(cues).select(*AT, F.lit(name).alias("detector"), F.col("risk").cast("double").alias("risk"), F.lit(True).alias("configured")) for name, f in sorted(self.known.items())]
        out = parts[0] if parts else cues.select(*AT, F.lit("").alias("detector"), F.lit(0.0).alias("risk"), F.lit(False).alias("configured")).limit(0)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


# ---- string scores -------------------------------------------------------------------------


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one of its length, or less at the ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        piece = long[max(0, i) : i + n]
        if 200.0 * min(n, len(piece)) / (n + len(piece)) > best:
            best = max(best, ratio(short, piece))
    return best


def _token_scores(a: str, b: str, how: Callable[[str, str], float]) -> float:
    x, y = sorted(a.split()), sorted(b.split())
    best = how(" ".join(x), " ".join(y))
    same, left, right = sorted(set(x) & set(y)), sorted(set(x) - set(y)), sorted(set(y) - set(x))
    if same:
        base, one, two = " ".join(same), " ".join(same + left), " ".join(same + right)
        best = max(best, 100.0 if not left or not right else 0.0, how(base, one), how(base, two), how(one, two))
    return best


def weighted_ratio(a: str, b: str) -> float:
    """The best of the whole, the partial and the word scores, each with its weight; 0 if either is empty."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < 1.5:
        return max(best, 0.95 * _token_scores(a, b, ratio))
    scale = 0.9 if apart <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), scale * 0.95 * _token_scores(a, b, partial_ratio))


@F.pandas_udf(DoubleType())
def weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def substring_similarity(a: Column, b: Column) -> Column:
    """Best edit similarity of b with a window of a of its length; with a itself where a is not longer."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - F.length(b) + 1)), lambda i: F.substring(a, i, F.length(b)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.array_max(F.transform(windows, lambda w: T.similarity(w, b))))


# ---- exact level ---------------------------------------------------------------------------


def windows(cues: DataFrame, low: int, high: int, keep: str = r"[^\p{L}\p{N}-]") -> DataFrame:
    """doc_id, cue_index, token, start_char, end_char: every window of low..high kept characters without a gap.

    They stand in for words of a segmenter; any word of a dictionary is among them."""
    c = F.col("_c")
    of = lambda n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.struct(F.concat(*[F.get(c, i + k) for k in range(n)]).alias("token"), i.alias("start_char"), (i + n).alias("end_char"))))
    every = F.flatten(F.filter(F.array(*[of(n) for n in range(low, high + 1)]), lambda x: x.isNotNull()))
    d = cues.select(*AT, F.split("text", "").alias("_c")).select(*AT, F.explode(every).alias("w")).select(*AT, "w.*")
    return d.filter(~F.col("token").rlike(keep))


def exact(tokens: DataFrame, dictionary: DataFrame, spoken: DataFrame, nicknames: DataFrame) -> DataFrame:
    """tokens that are surfaces of dictionary(surface, term, category, parent), scored 1.

    A surface of spoken(surface, policy) stands for itself, as a context alias to be preserved if its policy
    says so; a nickname of nicknames(surface, canonical) is a repair to its canonical form; others to their term."""
    s = spoken.select(F.col("surface").alias("token"), "policy")
    n = nicknames.select(F.col("surface").alias("token"), F.col("canonical").alias("nick"))
    d = tokens.join(dictionary.select(F.col("surface").alias("token"), "term", "category", "parent"), "token").join(s, "token", "left").join(n, "token", "left")
    kept = F.coalesce(F.col("policy").isin("context_only", "exact_context_only"), F.lit(False))
    value = F.when(F.col("policy").isNotNull(), F.col("token")).when(F.col("nick").isNotNull(), F.col("nick")).otherwise(F.col("term"))
    kind = F.when(kept, "known_alias").when(F.col("policy").isNull() & F.col("nick").isNotNull(), "character_nickname").otherwise("exact_term")
    return d.select(
        *AT, F.col("token").alias("surface"), "start_char", "end_char", value.alias("value"), F.lit(1.0).alias("score"), F.lit("exact").alias("source"), "category", "parent",
        F.when(kept, "context_alias").otherwise("repair_candidate").alias("intent"), F.when(kept, "preserve_surface").otherwise("repair_to_canonical").alias("expansion_policy"), kind.alias("evidence_type"),
    )


def sounds_like_nickname(tokens: DataFrame, nicknames: DataFrame, readings: Mapping[str, str], least: Column | None = None, floor: float = 82.0) -> DataFrame:
    """The nickname whose sound is nearest to each token: doc_id, cue_index, token, surface, canonical, ratio.

    least: percent needed of a spelling `l`; by default 90 for two syllables, 86 for three, else the floor.
    Of equally near nicknames the first by seq."""
    t = tokens.withColumn("l", spelled(F.col("token"), readings)).filter("l <> ''")
    n = nicknames.withColumn("r", spelled(F.col("surface"), readings)).filter("r <> ''")
    words = F.size(F.split("l", " "))
    need = F.greatest(F.lit(floor), F.when(words <= 2, 90.0).when(words == 3, 86.0).otherwise(floor)) if least is None else least
    pairs = similar_pairs(t.select("l").distinct(), n.select("r").distinct(), need, floor)
    best = pairs.join(n.select("r", "surface", "canonical", "seq"), "r").groupBy("l").agg(F.max_by(F.struct("surface", "canonical", "ratio"), F.struct("ratio", -F.col("seq"))).alias("v"))
    return t.join(best, "l").select(*AT, "token", "v.surface", "v.canonical", "v.ratio")


# ---- look-up -------------------------------------------------------------------------------


def boosted(rows: DataFrame, active: DataFrame, factor: float = 0.15, by: tuple[str, ...] = ()) -> DataFrame:
    """rows(score in percent, parent) with the score raised by the weight of their parent in active(entity, weight), to 100 at most."""
    a = active.select(*by, F.col("entity").alias("parent"), F.col("weight").alias("_w"))
    d = rows.join(a, [*by, "parent"], "left")
    return d.withColumn("score", F.when(F.coalesce("_w", F.lit(0.0)) > 0, F.least(F.col("score") + F.col("_w") * factor * 100, F.lit(100.0))).otherwise(F.col("score"))).drop("_w")


def best_of(*retrieved: DataFrame, k: int = 8) -> DataFrame:
    """Union of candidates (doc_id, cue_index, value, score): the best score of each value, then k of each cue."""
    every = retrieved[0].select(*AT, "value", "score")
    for r in retrieved[1:]:
        every = every.unionByName(r.select(*AT, "value", "score"))
    best = every.groupBy(*AT, "value").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*AT).orderBy(F.col("score").desc(), "value")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def letters(cues: DataFrame, dictionary: DataFrame, threshold: float = 82.0, low: int = 2, high: int = 6) -> DataFrame:
    """doc_id, cue_index, term, surface, parent, score: surfaces near a window of the text, without those that it holds."""
    w = windows(cues, low, high).select(*AT, F.col("token").alias("l")).distinct()
    pairs = similar_pairs(w.select("l").distinct(), dictionary.select(F.col("surface").alias("r")).distinct(), F.lit(threshold), threshold)
    return _without_held(w.join(pairs, "l").select(*AT, F.col("r").alias("surface"), F.col("ratio").alias("score")), cues, dictionary)


def sounds(cues: DataFrame, dictionary: DataFrame, readings: Mapping[str, str], threshold: float = 82.0, low: int = 2, high: int = 6) -> DataFrame:
    """As letters(), by sound; a hit by sound gains a twentieth of its score, to 100 at most."""
    w = windows(cues, low, high).select(*AT, "token").distinct().withColumn("l", spelled(F.col("token"), readings)).filter("l <> ''")
    d = dictionary.select("surface").distinct().withColumn("r", spelled(F.col("surface"), readings)).filter("r <> ''")
    pairs = similar_pairs(w.select("l").distinct(), d.select("r").distinct(), F.lit(threshold), threshold).join(d, "r")
    return _without_held(w.join(pairs, "l").filter("token <> surface").select(*AT, "surface", F.least(F.col("ratio") * 1.05, F.lit(100.0)).alias("score")), cues, dictionary)


def whole_text(cues: DataFrame, dictionary: DataFrame, threshold: float = 82.0) -> DataFrame:
    """Surfaces that the text holds, by the weighted score of surface and text."""
    size = [r[0] for r in dictionary.select(F.length("surface")).distinct().collect() if r[0]]  # a few numbers
    if not size:
        return _joined(cues.select(*AT, F.lit("").alias("surface"), F.lit(0.0).alias("score")).limit(0), dictionary)
    w = windows(cues, min(size), max(size), keep=r"[\n]").select(*AT, F.col("token").alias("surface")).distinct().join(dictionary.select("surface").distinct(), "surface")
    d = w.join(cues.select(*AT, "text"), list(AT)).select(*AT, "surface", weighted("text", "surface").alias("score"))
    return _joined(d.filter(F.col("score") >= threshold), dictionary)


def _without_held(rows: DataFrame, cues: DataFrame, dictionary: DataFrame) -> DataFrame:
    d = rows.groupBy(*AT, "surface").agg(F.max("score").alias("score")).join(cues.select(*AT, "text"), list(AT)).filter(~F.contains("text", F.col("surface"))).drop("text")
    return _joined(d, dictionary)


def _joined(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    return rows.join(dictionary.select("surface", "term", "parent"), "surface").select(*AT, "term", "surface", "parent", "score")


def lookup(cues: DataFrame, dictionary: DataFrame, active: DataFrame, readings: Mapping[str, str], threshold: float = 82.0, limit: int = 8, factor: float = 0.15) -> DataFrame:
    """doc_id, cue_index, term, surface, score, rank: the best terms of each text by the three searches, boosted."""
    found = whole_text(cues, dictionary, threshold).unionByName(letters(cues, dictionary, threshold)).unionByName(sounds(cues, dictionary, readings, threshold))
    d = boosted(found, active, factor)
    best = d.groupBy(*AT, "term").agg(F.max_by("surface", F.struct("score", "surface")).alias("surface"), F.max("score").alias("score"))
    w = Window.partitionBy(*AT).orderBy(F.col("score").desc(), "term")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def misheard(spans: DataFrame, runtime: DataFrame, active: DataFrame) -> DataFrame:
    """spans(doc_id, cue_index, surface, start_char, end_char) of runtime(alias_surface, canonical_term, review_status,
    confidence, ...) as repair candidates; those that need context only where active(doc_id, entity) holds their term."""
    d = spans.join(runtime.withColumnRenamed("alias_surface", "surface"), "surface")
    near = active.select("doc_id", F.col("entity").alias("canonical_term")).distinct()
    sure, others = d.filter("review_status = 'approved'"), d.filter("review_status = 'needs_context'").join(near, ["doc_id", "canonical_term"], "left_semi").select(d.columns)
    return sure.unionByName(others).select(*AT, "surface", "start_char", "end_char", F.col("canonical_term").alias("value"), F.col("confidence").alias("score"), F.lit("asr_alias").alias("source"), F.lit("character").alias("category"), F.col("canonical_term").alias("parent"), F.lit("repair_candidate").alias("intent"))


def unprotected(candidates: DataFrame, context: DataFrame, protected: DataFrame) -> DataFrame:
    """candidates(surface, value) without those that a standing name forbids.

    One goes if its surface is in context(surface) and its value is another string, or if its surface holds a
    protected(surface, canonical) name of two characters or more and its value is that name's canonical form."""
    c = context.select(F.col("surface").alias("_cs")).distinct()
    d = candidates.join(c, (F.col("surface") == F.col("_cs")) & (F.col("surface") != F.col("value")), "left_anti")
    p = protected.filter(F.length("surface") >= 2).select(F.col("surface").alias("_ps"), F.col("canonical").alias("_pc")).distinct()
    return d.join(p, (F.col("value") == F.col("_pc")) & F.contains("surface", F.col("_ps")), "left_anti")


# ---- detectors -----------------------------------------------------------------------------


def spelling_risk(cues: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, cue_index, risk: the best of window similarity times score over candidates(doc_id, cue_index, value, score in 0..1)."""
    d = candidates.join(cues.select(*AT, "text"), list(AT))
    return _risk(cues, d.select(*AT, (substring_similarity(F.col("text"), F.col("value")) * F.col("score")).alias("risk")))


def term_risk(cues: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, cue_index, risk: the best score of a cue's candidates, 0 where it has none."""
    return _risk(cues, candidates.select(*AT, F.col("score").alias("risk")))


def entity_risk(cues: DataFrame) -> DataFrame:
    """The entity detector is not configured: risk 0 everywhere."""
    return cues.select(*AT, F.lit(0.0).alias("risk"), F.lit("not configured").alias("note"))


def _risk(cues: DataFrame, rows: DataFrame) -> DataFrame:
    best = rows.groupBy(*AT).agg(F.max("risk").alias("risk"))
    return cues.select(*AT).join(best, list(AT), "left").select(*AT, F.coalesce("risk", F.lit(0.0)).alias("risk"))

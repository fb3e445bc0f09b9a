"""Dictionary joins, evidence fusion, edits and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T


def surface_dictionary(terms: DataFrame) -> DataFrame:
    """terms(term_id, term, aliases, category, parent) -> surfaces; terms win over aliases, later entries over earlier."""
    own = terms.select(F.col("term").alias("surface"), "term_id", "term", "category", "parent", F.lit(0).alias("prio"))
    alias = terms.select(F.explode("aliases").alias("surface"), "term_id", "term", "category", "parent", F.lit(1).alias("prio"))
    w = Window.partitionBy("surface").orderBy("prio", F.col("term_id").desc())
    return own.unionByName(alias).withColumn("r", F.row_number().over(w)).filter("r = 1").select("surface", "term_id", "term", "category", "parent", (F.col("prio") == 1).alias("is_alias"))


def containment_spans(cues: DataFrame, surfaces: DataFrame, seed: int = 4, broadcast_surfaces: int = 100_000) -> DataFrame:
    """Every occurrence of every surface, with offsets.

    Surfaces are joined by their first `seed` characters to the texts' windows of that length: an
    equi-join instead of a test of every pair; shorter surfaces are joined by their whole length."""
    s = surfaces.filter(F.length("surface") > 0).withColumn("n", F.least(F.lit(seed), F.length("surface"))).withColumn("key", F.substring(F.col("surface"), F.lit(1), F.col("n")))
    used = s.groupBy("n").agg(F.count("*").alias("k"), F.max(F.length("surface")).alias("most")).collect()  # seed rows at most
    most = max((r["most"] for r in used), default=0)
    d = cues.select("doc_id", "cue_index", F.split("text", "").alias("_c"))  # characters: a substring from far inside a text would walk it again

    def windows(n: int) -> Column:
        every = lambda i: F.struct(F.lit(n).alias("n"), F.concat(*[F.get("_c", i + k) for k in range(n)]).alias("key"), i.alias("start"), (F.lit("") if most <= seed else F.array_join(F.slice("_c", i + 1, F.lit(most)), "")).alias("rest"))
        return F.when(F.size("_c") >= n, F.transform(F.sequence(F.lit(0), F.size("_c") - n), every))

    every = F.flatten(F.filter(F.array(*[windows(r["n"]) for r in used] or [windows(1)]), lambda x: x.isNotNull()))
    at = d.select("doc_id", "cue_index", F.explode(every).alias("w")).select("doc_id", "cue_index", "w.*").filter(F.col("key").isNotNull())
    # the exploded side must never be the broadcast one, whatever its files' size suggests
    s = F.broadcast(s) if sum(r["k"] for r in used) <= broadcast_surfaces else s.hint("merge")
    hit = (F.length("surface") <= seed) | F.startswith(F.col("rest"), F.col("surface"))
    return at.join(s, ["n", "key"]).filter(hit).select("doc_id", "cue_index", "surface", F.col("start").cast("long").alias("start_char"), (F.col("start") + F.length("surface")).cast("long").alias("end_char"))


def protect(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """Drops candidates that overlap a protected span whose canonical form they would write."""
    p = protected.select(F.col("doc_id").alias("pd"), F.col("cue_index").alias("pc"), F.col("start_char").alias("ps"), F.col("end_char").alias("pe"), F.col("canonical").alias("pv"))
    c = candidates
    return c.join(p, (c.doc_id == p.pd) & (c.cue_index == p.pc) & (c.value == p.pv) & (c.start_char < p.pe) & (p.ps < c.end_char), "left_anti")


def top_candidates(candidates: DataFrame, k: int = 4) -> DataFrame:
    """Best score per (cue, surface, value, span), then k per cue: by score, non-exact first, then by value."""
    best = candidates.groupBy("doc_id", "cue_index", "surface", "value", "start_char", "end_char").agg(F.max("score").alias("score"), F.min("exact").alias("exact"))
    w = Window.partitionBy("doc_id", "cue_index").orderBy(F.col("score").desc(), "exact", "value", "start_char", "surface")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse_risk(detections: DataFrame, weights: DataFrame) -> DataFrame:
    """detections(doc_id, cue_index, detector, risk, configured): weighted mean, unknown detectors weigh 1."""
    d = detections.filter("risk <> 0 OR configured").join(F.broadcast(weights), "detector", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    return d.groupBy("doc_id", "cue_index").agg(F.sum(F.col("risk") * F.col("w")).alias("a"), F.sum("w").alias("b")).select("doc_id", "cue_index", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("a", "b"))).alias("risk"))


def converge(evidence: DataFrame, weights: DataFrame) -> DataFrame:
    """evidence(item, dimension, polarity, strength) -> score in [-1, 1] and verdict."""
    d = evidence.join(F.broadcast(weights), "dimension", "left")
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sum(F.col("polarity") * F.col("strength") * F.coalesce("weight", F.lit(0.10)))))
    return d.groupBy("item").agg(s.alias("score")).withColumn("verdict", F.when(F.round("score", 9) >= 0.6, "COMMIT").when(F.round("score", 9) <= -0.6, "REJECT").otherwise("UNCERTAIN"))


def apply_edits(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """cues(doc_id, cue_index, text), edits(doc_id, cue_index, start_char, end_char, surface, replacement).

    Right to left; an edit applies only where the text still holds its surface."""
    e = edits.groupBy("doc_id", "cue_index").agg(F.sort_array(F.collect_list(F.struct(F.col("start_char").alias("st"), F.col("end_char").alias("en"), F.col("surface").alias("sf"), F.col("replacement").alias("rp"))), asc=False).alias("edits"))
    fits = lambda a, x: (F.substring(a, x["st"] + 1, x["en"] - x["st"]) == x["sf"]) & (x["en"] <= F.length(a))
    step = lambda a, x: F.when(fits(a, x), F.overlay(a, x["rp"], x["st"] + 1, x["en"] - x["st"])).otherwise(a)
    d = cues.join(e, ["doc_id", "cue_index"], "left")
    return d.withColumn("edited", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", F.col("text"), step))).drop("edits")


def confusion(raw: Column, fixed: Column, gold: Column) -> Column:
    """TP, FP, TN or FN of one cue; a wrong fix of an error is FN."""
    r, f, g = map(T.comparable, (raw, fixed, gold))
    return F.when((r != g) & (f == g), "TP").when(r != g, "FN").when(f != g, "FP").otherwise("TN")


def metrics(counts: DataFrame) -> DataFrame:
    """tp, fp, fn, tn -> precision, recall, f1, accuracy; 0 on an empty denominator."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def learn_rules(decisions: DataFrame, least: float = 0.85, min_chars: int = 3) -> DataFrame:
    """decisions(seq, surface, corrected, confidence): surfaces always corrected alike become rules."""
    d = decisions.filter((F.col("confidence") >= least) & (F.length("surface") >= min_chars))
    return d.groupBy("surface").agg(F.min_by("corrected", "seq").alias("corrected"), F.countDistinct("corrected").alias("forms"), F.avg("confidence").alias("confidence"), F.count("*").alias("n")).filter("forms = 1").drop("forms")


def resolve_policy(policies: DataFrame) -> DataFrame:
    """policies(surface, policy, seq): preserve over repair over contextual, later rows win ties."""
    prio = F.when(F.col("policy") == "preserve_surface", 30).when(F.col("policy") == "repair_expand", 20).otherwise(10)
    return policies.groupBy("surface").agg(F.max_by("policy", F.struct(prio, "seq")).alias("policy"))

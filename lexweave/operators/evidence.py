"""Evidence for and against repair hypotheses, from the entities and topic changes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension of each reason, and weight of each dimension.
REASONS = (("PHONETIC_MATCH", "phonetic"), ("CONTEXT_ALIGNMENT", "topic_alignment"), ("ENTITY_MEMORY_MATCH", "entity_cooccurrence"))
WEIGHTS = (
    ("phonetic", 0.15), ("entity_cooccurrence", 0.25), ("topic_alignment", 0.20), ("grammar", 0.10), ("temporal", 0.15), ("overlap", 0.25), ("snapshot", 0.05),
    ("semantic_inconsistency", 0.70), ("entity_conflict", 0.60), ("temporal_discontinuity", 0.50), ("low_overlap_consensus", 0.80), ("grammar_disruption", 0.90), ("category_dissonance", 0.40),
)
MATCH, CONFLICT, GAP = 0.80, 0.60, 0.50


def weights(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(list(WEIGHTS), "dimension string, weight double")


def gather(hypotheses: DataFrame, entities: DataFrame, transitions: DataFrame | None = None, near: int = 10, before: int = 20) -> DataFrame:
    """(item, dimension, polarity, strength) of hypotheses(item, doc_id, start, resolution, confidence, reasons).

    entities(doc_id, start, end, entity): one whose start is within `near` supports its own resolution and
    opposes others; a hypothesis not at 0 without an entity ending in the `before` cues ahead of it is
    discontinuous. transitions(doc_id, seq, lo, hi, confidence, entities): only the first one that covers
    the start counts. Entities are first counted by place, so a crowded place is one row per entity."""
    h = hypotheses.select("item", "doc_id", "start", "resolution", "confidence", "reasons")
    names = F.create_map(*[F.lit(x) for pair in REASONS for x in pair])
    own = h.select("item", F.explode("reasons").alias("r"), "confidence").select("item", names[F.col("r")].alias("dimension"), F.lit(1).alias("polarity"), F.col("confidence").alias("strength")).filter("dimension IS NOT NULL")
    at = h.select("doc_id", "start", "resolution").distinct()
    e = entities.select(F.col("doc_id").alias("ed"), F.col("start").alias("es"), F.col("end").alias("ee"), "entity").distinct()
    beside = at.join(e, (F.col("doc_id") == F.col("ed")) & F.col("es").between(F.col("start") - near, F.col("start") + near)).groupBy("doc_id", "start", "resolution").agg(F.max(F.col("entity") == F.col("resolution")).alias("same"))
    around = h.join(beside, ["doc_id", "start", "resolution"]).select("item", F.when(F.col("same"), "entity_cooccurrence").otherwise("entity_conflict").alias("dimension"), F.when(F.col("same"), 1).otherwise(-1).alias("polarity"), F.when(F.col("same"), MATCH).otherwise(CONFLICT).alias("strength"))
    ends = e.select("ed", "ee").distinct()
    lone = h.filter("start > 0").join(ends, (F.col("doc_id") == F.col("ed")) & (F.col("ee") < F.col("start")) & (F.col("ee") >= F.col("start") - before), "left_anti")
    out = own.unionByName(around).unionByName(lone.select("item", F.lit("temporal_discontinuity").alias("dimension"), F.lit(-1).alias("polarity"), F.lit(GAP).alias("strength")))
    if transitions is not None:
        t = transitions.select(F.col("doc_id").alias("td"), "lo", "hi", F.struct("lo", "seq").alias("o"), F.struct(F.col("confidence").alias("c"), F.col("entities").alias("e")).alias("t"))
        first = h.join(t, (F.col("doc_id") == F.col("td")) & F.col("start").between(F.col("lo"), F.col("hi"))).groupBy("item", "resolution").agg(F.min_by("t", "o").alias("t"))
        out = out.unionByName(first.filter(F.array_contains("t.e", F.col("resolution"))).select("item", F.lit("topic_alignment").alias("dimension"), F.lit(1).alias("polarity"), F.col("t.c").alias("strength")))
    return out

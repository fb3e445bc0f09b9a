"""The whole way from cues to corrected cues: terms that stand, candidates, decisions, edits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import alignment, correction, decisions, discovery, topics
from lexweave.session import materialize

AT = ("doc_id", "cue_index")


def standing(cues: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, cue_index, entity: the terms of the surfaces that the cue or an earlier one of its document holds."""
    held = correction.containment_spans(cues, entries.select("surface").distinct()).join(entries.select("surface", F.col("term").alias("entity")).distinct(), "surface")
    first = held.groupBy("doc_id", "entity").agg(F.min("cue_index").alias("since"))
    return cues.select(*AT).join(first, "doc_id").filter("cue_index >= since").select(*AT, "entity")


def clustered(cues: DataFrame, stable: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """Topic clusters of chunks of `size` cues, by the terms that stand in them and their categories."""
    named = stable.join(entries.select(F.col("term").alias("entity"), "category").distinct(), "entity", "left")
    chunk = F.floor(F.col("cue_index") / size).alias("chunk_id")
    of = named.groupBy("doc_id", chunk).agg(F.array_sort(F.collect_set("entity")).alias("entities"), F.array_sort(F.collect_set("category")).alias("categories"))
    span = cues.groupBy("doc_id", chunk).agg(F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"))
    none = F.expr("cast(array() as array<string>)")
    d = span.join(of, ["doc_id", "chunk_id"], "left").withColumn("signals", none)
    return topics.clusters(d.withColumn("entities", F.coalesce("entities", none)).withColumn("categories", F.coalesce("categories", none)))


def correct(
    cues: DataFrame, entries: DataFrame, readings: Mapping[str, str], decider: decisions.Decider, policies: DataFrame | None = None, protected: DataFrame | None = None,
    searches: tuple[alignment.Search, ...] = (alignment.CONSISTENCY, alignment.LONG_VARIANT, alignment.LOCAL), chunk: int = 100, batch: int = 10, k: int = 4,
) -> dict[str, DataFrame]:
    """cues(doc_id, cue_index, text) corrected by entries(surface, term, category, parent, seq).

    Terms that stand in a document are searched by every search in its cues; the candidates of a span and value
    are merged, annotated with policies(surface, policy, source), and dropped where policies preserve their surface
    or protected(doc_id, cue_index, start_char, end_char, canonical) spans forbid them. What the decider replaces
    in two rounds becomes edits, and `text` holds all cues with the edits applied.

    Cues without a candidate come back as they are, null texts too; without entries nothing changes."""
    stable = materialize(standing(cues, entries), "standing")
    found = alignment.expand(cues, stable, entries, readings, searches[0])
    for how in searches[1:]:
        found = alignment.merge(found, alignment.expand(cues, stable, entries, readings, how), k)
    found = found.withColumn("evidence_type", F.col("source"))
    if policies is not None:
        found = discovery.annotated(found.withColumn("expansion_policy", F.lit(None).cast("string")), policies).filter("expansion_policy <> 'preserve_surface'").drop("expansion_policy")
    if protected is not None:
        found = correction.protect(found, protected)
    found = materialize(decisions.number(found), "candidates")
    told = materialize(decisions.refine(cues, found, clustered(cues, stable, entries, chunk), decider, entries, dict(readings), protected=protected, size=batch), "decisions")
    edits = decisions.plan_edits(told, cues)
    return {"candidates": found, "decisions": told, "edits": edits, "text": correction.apply_edits(cues, edits)}

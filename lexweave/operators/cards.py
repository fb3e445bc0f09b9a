"""Knowledge cards: what is known about an entity, for a decider's context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def related_terms(dictionary: DataFrame, most: int = 8) -> DataFrame:
    """entity, related: the first `most` terms of dictionary(term, parent, seq) by seq whose parent it is, sorted."""
    d = dictionary.filter("parent IS NOT NULL AND parent <> '' AND term <> parent").groupBy(F.col("parent").alias("entity"), "term").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("entity").orderBy("seq", "term")
    d = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return d.groupBy("entity").agg(F.array_sort(F.collect_list("term")).alias("related"))


def alias_buckets(characters: DataFrame, spoken: DataFrame, misheard: DataFrame) -> DataFrame:
    """entity, preserve, repair, contextual: sorted sets of surfaces.

    characters(surface, canonical, slot): slots are preserved, nicknames contextual. spoken(surface, canonical,
    policy): preserved if the policy says exact or context only. misheard(alias_surface, canonical_term,
    review_status): approved ones are repairs, the others contextual."""
    c = characters.select(F.col("canonical").alias("entity"), "surface", F.when(F.col("slot") == "team_slot", "preserve").otherwise("contextual").alias("bucket"))
    s = spoken.select(F.col("canonical").alias("entity"), "surface", F.when(F.col("policy").isin("context_only", "exact_context_only"), "preserve").otherwise("contextual").alias("bucket"))
    m = misheard.select(F.col("canonical_term").alias("entity"), F.col("alias_surface").alias("surface"), F.when(F.col("review_status") == "approved", "repair").otherwise("contextual").alias("bucket"))
    of = lambda b: F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("surface")))).alias(b)
    return c.unionByName(s).unionByName(m).groupBy("entity").agg(of("preserve"), of("repair"), of("contextual"))


def cards(wanted: DataFrame, buckets: DataFrame, dictionary: DataFrame, most: int = 5) -> DataFrame:
    """wanted(batch, entity): the first `most` cards of each batch by name: kind, preserve, repair, contextual, related.

    An entity of which nothing is known, neither a category in dictionary(surface, category, ...) nor an alias, has none."""
    kinds = dictionary.groupBy(F.col("surface").alias("entity")).agg(F.min_by("category", "seq").alias("kind"))
    none = F.expr("cast(array() as array<string>)")
    d = wanted.select("batch", "entity").distinct().join(kinds, "entity", "left").join(buckets, "entity", "left")
    for c in ("preserve", "repair", "contextual"):
        d = d.withColumn(c, F.coalesce(c, none))
    d = d.withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("unknown")))
    d = d.filter((F.col("kind") != "unknown") | (F.size("preserve") + F.size("repair") + F.size("contextual") > 0))
    w = Window.partitionBy("batch").orderBy("entity")
    d = d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return d.join(related_terms(dictionary), "entity", "left").withColumn("related", F.coalesce("related", none))


def entities_of_batch(dominant: DataFrame, candidates: DataFrame, buckets: DataFrame) -> DataFrame:
    """batch, entity: dominant(batch, entity), the parents of candidates(batch, value, parent), and values that are entities."""
    known = buckets.select(F.col("entity").alias("value"))
    d = dominant.select("batch", "entity").unionByName(candidates.select("batch", F.col("parent").alias("entity"))).unionByName(candidates.join(known, "value", "left_semi").select("batch", F.col("value").alias("entity")))
    return d.filter("entity IS NOT NULL AND entity <> ''").distinct()

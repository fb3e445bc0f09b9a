"""Plans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary spans in normalised cues, counted per chunk."""
    from lexweave.plans import registry

    return registry.entity_persistence(spark, sf_dir)

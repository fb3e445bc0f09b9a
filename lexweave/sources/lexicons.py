"""Alias files: candidates, spoken and character lexicons, the runtime of misheard names, source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
ALIAS_TYPES = ("asr_alias", "spoken_alias")
REVIEW_STATUSES = ("pending", "approved", "rejected", "needs_context")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings, in file order as `row_id`; a byte order mark is dropped."""
    d = spark.read.option("header", True).option("multiLine", True).csv(path)
    return d.toDF(*[c.lstrip("﻿").strip() for c in d.columns]).withColumn("row_id", F.monotonically_increasing_id())


def source_urls(lines: DataFrame) -> DataFrame:
    """url of lines(value), one a line: blank lines and those that begin with # left out."""
    return lines.select(F.trim("value").alias("url")).filter("url <> '' AND NOT startswith(url, '#')")


def _text(rows: DataFrame, name: str, default: str = "") -> Column:
    c = F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in rows.columns else F.lit("")
    return F.when(c == "", default).otherwise(c)


def _flags(rows: DataFrame) -> Column:
    return F.filter(F.transform(F.split(_text(rows, "risk_flags"), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def alias_candidates(rows: DataFrame, types: tuple[str, ...] = ALIAS_TYPES) -> DataFrame:
    """Typed candidates of rows as a CSV gives them, with `error`: why a row is none, null if it is one.

    Rows without a surface or a canonical term are left out."""
    d = rows.select(
        _text(rows, "alias_surface").alias("alias_surface"),
        _text(rows, "canonical_term").alias("canonical_term"),
        _text(rows, "alias_type", "asr_alias").alias("alias_type"),
        _text(rows, "review_status", "pending").alias("review_status"),
        _text(rows, "confidence", "0.5").try_cast("double").alias("confidence"),
        _text(rows, "evidence_count", "0").try_cast("int").alias("evidence_count"),
        _text(rows, "evidence_sources").alias("evidence_sources"),
        _text(rows, "evidence_examples").alias("evidence_examples"),
        _flags(rows).alias("risk_flags"),
    ).filter("alias_surface <> '' AND canonical_term <> ''")
    error = (
        F.when(F.col("alias_surface") == F.col("canonical_term"), "surface is the canonical term")
        .when(~F.col("alias_type").isin(*types), F.concat(F.lit("unknown alias type "), "alias_type"))
        .when(~F.col("review_status").isin(*REVIEW_STATUSES), F.concat(F.lit("unknown review status "), "review_status"))
        .when(F.col("confidence").isNull() | F.col("evidence_count").isNull(), "not a number")
    )
    return d.withColumn("error", error)


def checked(candidates: DataFrame) -> DataFrame:
    """candidates without their error column; reading a row that has one fails."""
    surface = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("alias_surface", F.lit(": "), "error")).cast("string")).otherwise(F.col("alias_surface"))
    return candidates.withColumn("alias_surface", surface).drop("error")


def spoken_lexicon(rows: DataFrame) -> DataFrame:
    """surface, canonical, kind, policy: the last row (by row_id) of each surface whose policy isn't `blocked`."""
    d = rows.select(_text(rows, "alias_surface").alias("surface"), _text(rows, "canonical_term").alias("canonical"), _text(rows, "alias_kind").alias("kind"), _text(rows, "usage_policy").alias("policy"), "row_id")
    d = d.filter("surface <> '' AND canonical <> '' AND policy <> 'blocked'")
    return d.groupBy("surface").agg(F.max_by(F.struct("canonical", "kind", "policy"), "row_id").alias("v")).select("surface", "v.*")


def character_lexicon(rows: DataFrame) -> DataFrame:
    """surface, canonical, kind, confidence, risk_flags, review_status, slot: the last row of each surface.

    slot: `nickname` from two characters on, else `team_slot`."""
    d = rows.select(
        _text(rows, "alias_surface").alias("surface"), _text(rows, "canonical_term").alias("canonical"), _text(rows, "alias_kind").alias("kind"), _text(rows, "confidence", "0.5").try_cast("double").alias("confidence"), _flags(rows).alias("risk_flags"), _text(rows, "review_status").alias("review_status"), "row_id"
    ).filter("surface <> '' AND canonical <> ''")
    d = d.groupBy("surface").agg(F.max_by(F.struct("canonical", "kind", "confidence", "risk_flags", "review_status"), "row_id").alias("v")).select("surface", "v.*")
    return d.withColumn("slot", F.when(F.length("surface") >= 2, "nickname").otherwise("team_slot"))


def asr_runtime(candidates: DataFrame) -> DataFrame:
    """The candidates that are in use: approved ones, and those that need their entity active."""
    return candidates.filter(F.col("review_status").isin("approved", "needs_context"))

"""Why an error was missed: terms of the gold text, causes, pipeline stages, and state hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T

CJK = "[一-鿿]"
# Causes in the order they are tested.
CAUSES = ("NON_TERMINOLOGY_DIFF", "PARTIAL_FIX", "REQUERY_FAILED", "PHASE2_REJECTED", "WRONG_CANDIDATE_ONLY", "NO_CANDIDATE", "UNCLASSIFIED")


def grams(text: Column, letter: str = CJK, low: int = 2, high: int = 5) -> Column:
    """All n-grams made of the letter class only, shorter ones first, repeated ones kept.

    They are cut inside the runs of letters, from characters: a substring from far inside would walk the text again."""
    cut = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    of = lambda runs, n: F.flatten(F.transform(runs, lambda c: cut(c, n)))
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?:{letter})+"), F.lit(0)), lambda r: F.split(r, ""))
    # bound to a lambda variable: evaluated once, not for every n
    return F.get(F.transform(F.array(runs), lambda r: F.flatten(F.array(*[of(r, n) for n in range(low, high + 1)]))), 0)


def gold_terms(raw: Column, gold: Column, letter: str = CJK) -> Column:
    """n-grams of the gold text that the raw text lacks; none if either is null or empty."""
    # bound to lambda variables: evaluated once, not for every element
    every = F.array(F.struct(grams(gold, letter).alias("every"), grams(raw, letter).alias("known")))
    both = F.transform(every, lambda b: F.struct(b["every"].alias("every"), F.array_except(b["every"], b["known"]).alias("new")))
    found = F.get(F.transform(both, lambda b: F.filter(b["every"], lambda x: F.array_contains(b["new"], x))), 0)
    return F.when((F.length(raw) > 0) & (F.length(gold) > 0) & (raw != gold), found).otherwise(F.array().cast("array<string>"))


def non_terminology(raw: Column, gold: Column, terms: Column) -> Column:
    """No change, no term in it, or a change of one character within a short term."""
    slight = (T.hamming_plus(raw, gold) <= 1) & ~F.exists(terms, lambda x: F.length(x) >= 3)
    return (raw == gold) | (F.size(terms) == 0) | slight


def cause(plain: Column, modified: Column, requeried: Column, values: Column, terms: Column) -> Column:
    """The first cause that holds for a missed error; values are those of its candidates."""
    some, hit = F.size(values) > 0, F.arrays_overlap(values, terms)
    tests = (plain, modified, requeried, some & hit, some & ~hit, ~some)
    out = F
    for test, name in zip(tests, CAUSES, strict=False):
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(CAUSES[-1])


def causes(missed: DataFrame, letter: str = CJK) -> DataFrame:
    """missed(raw, fixed, gold, values, requeried) with terms and cause. Null values are no candidates."""
    d = missed.withColumn("terms", gold_terms(F.col("raw"), F.col("gold"), letter)).withColumn("_v", F.coalesce("values", F.array().cast("array<string>")))
    plain = non_terminology(F.col("raw"), F.col("gold"), F.col("terms"))
    return d.withColumn("cause", cause(plain, F.col("fixed") != F.col("raw"), F.col("requeried"), F.col("_v"), F.col("terms"))).drop("_v")


def cause_report(caused: DataFrame) -> DataFrame:
    """Every cause with its count, zeros included."""
    names = caused.sparkSession.createDataFrame([(c,) for c in CAUSES], "cause string")
    return names.join(caused.groupBy("cause").agg(F.count("*").alias("n")), "cause", "left").fillna(0, ["n"])


def stage(detected: Column, discovered: Column, expanded: Column, reviewed: Column, terms: Column, skipped: Column, actions: Column, asked: Column, generated: Column) -> Column:
    """At which stage a gold term was lost; the first five are arrays of candidate values."""
    has = lambda values: F.coalesce(F.arrays_overlap(values, terms), F.lit(False))
    kept_back = has(F.concat(discovered, expanded)) & ~has(reviewed) & F.array_contains(skipped, "missing_stable_entities")
    replaced = F.exists(actions, lambda a: F.upper(a) == "REPLACE")
    return (
        F.when(~has(detected) & (F.size(detected) > 0), "WRONG_CANDIDATE_ONLY")
        .when(~has(detected), "DETECTOR_MISS")
        .when(~has(discovered), "DISCOVERY_FILTERED_GT")
        .when(kept_back, "EXPANSION_SKIPPED_NO_STABLE_ENTITY")
        .when(has(reviewed), F.when(replaced, "UNKNOWN").otherwise("PHASE2_REJECTED_GT"))
        .when(asked & ~generated, "REQUERY_FAILED")
        .when(~asked, "REQUERY_NOT_REQUESTED")
        .otherwise("UNKNOWN")
    )


def row_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def state_hash(state: DataFrame) -> DataFrame:
    """One hash of a table whatever its order: a count and two wrapping sums of 64-bit parts of the row
    hashes, combined in every task. Equal states have equal hashes, repeated rows included."""
    h = state.select(row_hash(*sorted(state.columns)).alias("h"))
    part = lambda at: F.sum((F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")))
    return h.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b")).select("n", F.substring(F.sha2(F.concat_ws("|", "n", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256), 1, 16).alias("state_hash"))


def decision_lines(decisions: DataFrame) -> DataFrame:
    """One line of text for each decision, for reports."""
    return decisions.withColumn("line", F.format_string("%s '%s' -> '%s' [%d, %d) confidence %.2f", "action", "surface", "corrected", "start_char", "end_char", "confidence"))

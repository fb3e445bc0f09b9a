"""Tables and Markdown for people: differences, bars, histograms, an entity timeline, stage counts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MARKED = StructType([StructField("original", StringType()), StructField("repaired", StringType())])


def mark(original: str | None, repaired: str | None) -> tuple[str | None, str | None]:
    """Both texts with what was lost struck through and what was gained in bold."""
    if original is None or repaired is None or original == repaired:
        return original, repaired
    sides: tuple[list[str], list[str]] = ([], [])
    for kind, a, b, c, d in difflib.SequenceMatcher(None, original, repaired, autojunk=False).get_opcodes():
        for side, piece, sign in ((sides[0], original[a:b], "~~"), (sides[1], repaired[c:d], "**")):
            if piece:
                side.append(piece if kind == "equal" else f"{sign}{piece}{sign}")
    return "".join(sides[0]), "".join(sides[1])


@F.pandas_udf(MARKED)
def marked(original: pd.Series, repaired: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mark(a, b) for a, b in zip(original, repaired, strict=True)], columns=["original", "repaired"])


def changed_segments(raw: str | None, gold: str | None) -> list[str]:
    """What the gold text has in place of, or beside, the raw text's characters."""
    ops = difflib.SequenceMatcher(None, raw or "", gold or "", autojunk=False).get_opcodes()
    return [(gold or "")[c:d] for kind, _, _, c, d in ops if kind in ("replace", "insert")]


def bar(share: Column, width: int, full: str, blank: str) -> Column:
    n = F.bround(share * width).cast("int")
    return F.concat(F.repeat(F.lit(full), n), F.repeat(F.lit(blank), F.lit(width) - n))


def confidence_bar(share: Column) -> Column:
    return F.concat(bar(share, 10, "#", "-"), F.format_string(" %.0f%%", F.bround(share * 100).cast("double")))


def weight_bar(weight: Column) -> Column:
    return F.concat(bar(weight, 5, "*", "."), F.format_string(" %.2f", weight.cast("double")))


def histogram(values: DataFrame, column: str, width: float, threshold: float = 0.0) -> DataFrame:
    """Buckets of `width` with counts, percent of all rows, and whether the threshold lies in them."""
    d = values.groupBy(F.floor(F.col(column) / width).alias("bucket")).agg(F.count("*").alias("n"))
    total = values.agg(F.count("*").alias("_all"))  # one row
    low = F.col("bucket") * width
    return d.join(F.broadcast(total)).select("bucket", (low + 0.0).alias("low"), "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"), (F.lit(threshold > 0) & (low < threshold) & (F.lit(threshold) <= low + width)).alias("marks"))


def entity_timeline(cues: DataFrame, activations: DataFrame) -> DataFrame:
    """Events of the entity memory: activated, refreshed or forgotten, with the weight before.

    activations(doc_id, entity, cue_index). Retention grows with refreshes (see ordered.retention); a
    forgotten entity's event is at the first cue where its weight is below 0.2. One fold per (doc, entity)
    that emits its events, so nothing is densified."""
    from lexweave.operators.ordered import retention

    ends = cues.groupBy("doc_id").agg(F.max("cue_index").cast("long").alias("_end"))
    acts = activations.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_set(F.col("cue_index").cast("long"))).alias("acts")).join(ends, "doc_id")
    event = "array<struct<cue_index: bigint, event: string, weight: double>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("last"), F.array().cast(event).alias("out"))
    # cues an entity outlives its last activation by: the largest g with r^g >= 0.2
    life = lambda n: F.when(retention(n) >= 1.0, F.lit(2**62)).otherwise(F.floor(F.log(F.lit(0.2)) / F.log(retention(n)) + 1e-12)).cast("long")
    said = lambda at, what, w: F.struct(at.cast("long").alias("cue_index"), F.lit(what).alias("event"), w.cast("double").alias("weight"))

    def gone(s: Column, until: Column) -> Column:
        """The forgetting before `until`, if any."""
        due = s["last"] + life(s["n"]) + 1
        return F.when((s["last"] >= 0) & (due <= until), F.array(said(due, "forgotten", F.pow(retention(s["n"]), life(s["n"]))))).otherwise(F.array().cast(event))

    def step(s: Column, x: Column) -> Column:
        lost = (s["last"] < 0) | (s["last"] + life(s["n"]) < x)
        weight = F.pow(retention(s["n"]), x - s["last"])
        n = F.when(lost, 0).when(retention(s["n"]) == 1.0, s["n"]).otherwise(s["n"] + 1)
        own = F.when(lost, F.array(said(x, "activated", F.lit(0.0)))).otherwise(F.array(said(x, "refreshed", weight)))
        return F.struct(n.cast("int").alias("n"), x.alias("last"), F.concat(s["out"], gone(s, x), own).alias("out"))

    d = acts.withColumn("s", F.aggregate("acts", start, step))
    d = d.withColumn("e", F.concat(F.col("s")["out"], gone(F.col("s"), F.col("_end"))))
    return d.select("doc_id", "entity", F.explode("e").alias("e")).select("doc_id", "entity", "e.*")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows after each stage, in order."""
    out = None
    for k, (name, d) in enumerate(stages.items()):
        one = d.agg(F.count("*").alias("n")).select(F.lit(k).alias("ord"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def capped(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each value of `by`: the report's own limit."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def markdown(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A table of at most `most` rows as Markdown; says so where rows were left out."""
    got = rows.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in got[:most]]
    return "\n".join(lines + (["", f"More than {most} rows."] if len(got) > most else [])) + "\n"



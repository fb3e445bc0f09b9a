"""Evaluation beside the confusion counts: skipped differences, character metrics, targets, causes by bucket, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import correction
from lexweave.operators.lookup import windows

AT = ("doc_id", "cue_index")


def evaluated(cues: DataFrame, skip: Column | None = None) -> DataFrame:
    """cues(doc_id, cue_index, raw, fixed, gold) with `outcome`; where skip holds a difference counts as TN and `chat` marks it."""
    plain = correction.confusion(F.col("raw"), F.col("fixed"), F.col("gold"))
    chat = F.lit(False) if skip is None else skip & plain.isin("TP", "FN")
    return cues.withColumn("chat", F.coalesce(chat, F.lit(False))).withColumn("outcome", F.when(F.col("chat"), "TN").otherwise(plain))


def report(rows: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, f1, accuracy, fix_rate (fixed of the errors), false_rate (wrong of the changes), chats."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x.lower())
    counts = rows.agg(n("TP"), n("FP"), n("FN"), n("TN"), F.count_if("chat").alias("chats"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return correction.metrics(counts).withColumn("fix_rate", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("false_rate", ratio("fp", F.col("tp") + F.col("fp")))


def char_accuracy(counts: DataFrame) -> DataFrame:
    """counts(raw_chars, fixed, missed, broken) with accuracy: raw less broken and missed, more fixed, over raw; not below 0."""
    right = F.col("raw_chars") - F.col("broken") - F.col("missed") + F.col("fixed")
    return counts.withColumn("accuracy", F.when(F.col("raw_chars") > 0, F.greatest(F.lit(0.0), right / F.col("raw_chars"))).otherwise(0.0))


def targets(cues: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, cue_index, term, place: the terms that gold holds and raw does not, by their place in gold."""
    size = [r[0] for r in terms.select(F.length("term")).distinct().collect() if r[0]]  # a few numbers
    if not size:
        return cues.select(*AT, F.lit("").alias("term"), F.lit(0).alias("place")).limit(0)
    w = windows(cues.select(*AT, F.col("gold").alias("text")), min(size), max(size), keep=r"[\n]").select(*AT, F.col("token").alias("term"), "start_char")
    d = w.join(terms.select("term").distinct(), "term").groupBy(*AT, "term").agg(F.min("start_char").alias("place"))
    return d.join(cues.select(*AT, "raw"), list(AT)).filter(~F.contains("raw", F.col("term"))).select(*AT, "term", "place")


def missed_buckets(missed: DataFrame, wanted: DataFrame, candidates: DataFrame, decisions: DataFrame, requeries: DataFrame) -> DataFrame:
    """doc_id, cue_index, bucket of the missed cues: no candidate at all, a second question that did not help, a wanted
    candidate that was rejected, or another cause.

    wanted(doc_id, cue_index, term), candidates(.., value), decisions(.., action, corrected), requeries(doc_id, cue_index)."""
    flag = lambda d, name: d.select(*AT).distinct().withColumn(name, F.lit(True))
    right = candidates.join(wanted.withColumnRenamed("term", "value"), [*AT, "value"], "left_semi")
    done = decisions.filter("action = 'REPLACE'").withColumnRenamed("corrected", "term").join(wanted, [*AT, "term"], "left_semi")
    d = missed.select(*AT)
    for part, name in ((candidates, "_any"), (right, "_right"), (done, "_done"), (requeries, "_asked")):
        d = d.join(flag(part, name), list(AT), "left")
    open_ = F.col("_done").isNull()
    bucket = F.when(F.col("_any").isNull(), "NO_CANDIDATE").when(F.col("_asked").isNotNull() & open_, "REQUERY_FAILED").when(F.col("_right").isNotNull() & open_, "PHASE2_REJECTED").otherwise("OTHER")
    return d.select(*AT, bucket.alias("bucket"))


def trace_table(traces: DataFrame, shown: int = 50) -> tuple[DataFrame, DataFrame]:
    """Counts by stage, and the rows of the detail table, of traces(doc_id, cue_index, stage, raw, gold, terms array,
    requested, generated): texts cut to `shown` characters, three terms at most."""
    counts = traces.groupBy("stage").agg(F.count("*").alias("n"))
    asked = F.when(F.col("requested") & F.col("generated"), "generated").when(F.col("requested"), "failed").otherwise("none")
    rows = traces.select(*AT, "stage", F.substring(F.col("raw"), F.lit(1), F.lit(shown)).alias("raw"), F.substring(F.col("gold"), F.lit(1), F.lit(shown)).alias("gold"), F.array_join(F.slice("terms", 1, 3), ", ").alias("terms"), asked.alias("requery"))
    return counts, rows


def kept_model(grams: DataFrame, contexts: DataFrame, top_grams: int = 10_000, top_contexts: int = 100) -> tuple[DataFrame, DataFrame]:
    """What a saved n-gram model keeps: the commonest grams(gram, cnt, n) of each n and contexts(term, context, cnt) of each term.

    Totals of a reloaded model are sums of what was kept. Of equal counts the lesser string stays."""
    from pyspark.sql import Window

    g = Window.partitionBy("n").orderBy(F.col("cnt").desc(), "gram")
    c = Window.partitionBy("term").orderBy(F.col("cnt").desc(), "context")
    return (
        grams.withColumn("_r", F.row_number().over(g)).filter(F.col("_r") <= top_grams).drop("_r"),
        contexts.withColumn("_r", F.row_number().over(c)).filter(F.col("_r") <= top_contexts).drop("_r"),
    )


def save_model(grams: DataFrame, contexts: DataFrame, folder: str) -> None:
    g, c = kept_model(grams, contexts)
    g.write.mode("overwrite").parquet(f"{folder}/grams")
    c.write.mode("overwrite").parquet(f"{folder}/contexts")


def load_model(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/contexts")

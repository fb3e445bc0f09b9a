"""Corpus mining: deduplication, n-gram statistics, alias mining and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.session import materialize


def exact_dedup(articles: DataFrame, least: int = 200) -> DataFrame:
    """articles(path, text): texts of at least `least` characters, first path of each content hash."""
    d = articles.filter(F.length("text") >= least).withColumn("content_hash", T.short_hash(F.col("text")))
    return d.groupBy("content_hash").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def ngram_counts(texts: DataFrame, low: int = 2, high: int = 3, keep: str = r"[^\p{L}]") -> DataFrame:
    return texts.select(F.explode(T.char_ngrams(F.col("text"), low, high, keep)).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt")).withColumn("n", F.length("gram"))


def score_texts(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """Mean of bigram, trigram and coverage scores of each text(id, text) under gram counts; 0.5 if empty."""
    totals = grams.groupBy("n").agg(F.sum("cnt").alias("total"))
    g = texts.select("id", F.posexplode(T.char_ngrams(F.col("text"), 2, 3, r"[^\p{L}]")).alias("k", "gram")).withColumn("n", F.length("gram"))
    g = g.join(grams.select("gram", "cnt"), "gram", "left").join(F.broadcast(totals), "n")  # one row for each n
    part = F.least(F.coalesce("cnt", F.lit(0)) / F.greatest(F.lit(1.0), F.col("total") * 0.001), F.lit(1.0))
    s = g.groupBy("id").agg(F.avg(F.when(F.col("n") == 2, part)).alias("bi"), F.avg(F.when(F.col("n") == 3, part)).alias("tri"), F.avg(F.when(F.col("n") == 2, F.col("cnt").isNotNull().cast("double"))).alias("cover"))
    mean = (F.coalesce("bi", F.lit(0.5)) + F.coalesce("tri", F.lit(0.5)) + F.coalesce("cover", F.lit(0.5))) / 3
    return texts.select("id").join(s, "id", "left").select("id", mean.alias("score"))


def mined_confidence(evidence: Column, owners: Column, suffix: Column) -> Column:
    base = F.when(evidence >= 20, 0.9).when(evidence >= 10, 0.8).when(evidence >= 5, 0.7).when(evidence >= 3, 0.6).otherwise(0.5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.when(owners == 1, 0.08).otherwise(0.0) - 0.1 * (owners - 1) + F.when(suffix, 0.05).otherwise(0.0)))


def alias_candidates(terms: DataFrame) -> DataFrame:
    """terms(term) -> term, alias, is_suffix: suffixes of 3 and 2, prefixes of 2 and 3 characters."""
    t, n = F.col("term"), F.length("term")
    cut = lambda ok, c, suffix: F.when(ok, F.struct(c.alias("alias"), F.lit(suffix).alias("is_suffix")))
    every = [cut(n > k, F.substring(t, -k, k), True) for k in (3, 2)] + [cut(n > k, F.substring(t, 1, k), False) for k in (2, 3)]
    return terms.select("term", F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("c")).groupBy("term", "c.alias").agg(F.max("c.is_suffix").alias("is_suffix"))


def mine_aliases(sentences: DataFrame, candidates: DataFrame, support: int = 2) -> DataFrame:
    """sentences(sentence_id, word): aliases seen as words in at least `support` sentences, with confidence."""
    seen = sentences.select("sentence_id", F.col("word").alias("alias")).distinct().groupBy("alias").agg(F.count("*").alias("evidence")).filter(F.col("evidence") >= support)
    owners = candidates.groupBy("alias").agg(F.count("*").alias("owners"), F.min("term").alias("canonical"), F.max("is_suffix").alias("is_suffix"))
    d = seen.join(owners, "alias")
    return d.select("alias", "canonical", "evidence", "owners", mined_confidence(F.col("evidence"), F.col("owners"), F.col("is_suffix")).alias("confidence"))


def review(rows: DataFrame) -> DataFrame:
    """status, confidence, ambiguous -> routed status."""
    s = F.when(F.col("status") != "pending", F.col("status")).when(F.col("ambiguous"), "needs_context").when(F.col("confidence") >= 0.85, "approved").otherwise("pending")
    return rows.withColumn("routed", s)


def jaccard_pairs(sets: DataFrame, least: float = 0.4) -> DataFrame:
    """sets(id, items): pairs above least, which is above 0. Null items don't count, repeated ones once.

    Items are ordered from rare to frequent; two sets that are so alike share one of the first
    n - ceil(least * n) + 1 of either, so only those are joined and a frequent item meets few others."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    e = sets.select("id", F.explode("items").alias("item")).filter("item IS NOT NULL").distinct()
    order = e.join(e.groupBy("item").agg(F.count("*").alias("c")), "item")
    held = order.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("o"))
    held = materialize(held.select("id", F.transform("o", lambda x: x["item"]).alias("items")), "ordered-sets")
    n = F.size("items")
    first = held.select("id", n.alias("n"), F.explode(F.slice("items", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("item"))
    a, b = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "item"), first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "item")
    near = a.join(b, "item").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    p = near.join(held.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    k = F.size(F.array_intersect("x", "y"))
    return p.select("a", "b", (k / (F.size("x") + F.size("y") - k)).alias("jaccard")).filter(F.col("jaccard") > least)

"""Term store: import, list, merge, history; and the dictionary views of it.

A store is two tables, terms(term_id, term, category, game, parent, source, trust) and
aliases(term_id, alias, alias_type). Operators return new tables; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.session import materialize

TERMS = "term_id long, term string, category string, game string, parent string, source string, trust double"
ALIASES = "term_id long, alias string, alias_type string"
HISTORY = "doc_id long, cue_index long, raw_text string, corrected_text string, candidates string, selected string, confidence double, accepted boolean"
KEY = ("term", "category", "game", "parent")
#: Categories whose first alias is their parent when they name none. Fixed value.
OWNED_CATEGORIES = ("food", "recipe")
#: Brackets and quotes left out of a term before it is shortened. Fixed value.
BRACKETS = "「」『』【】《》\"''（）()"


def empty_store(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], TERMS), spark.createDataFrame([], ALIASES)


def migrate(terms: DataFrame) -> DataFrame:
    """terms of an older layout with the columns that it lacks, null, in the order of TERMS."""
    kinds = [x.strip().split(" ") for x in TERMS.split(",")]
    return terms.select(*[(F.col(c) if c in terms.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])


def imported(rows: DataFrame) -> DataFrame:
    """rows(term, aliases, category, game_title, source, trust_level, parent_entity), all strings as a CSV gives them.

    Rows without a term, or whose trust is no number, are left out; no trust is 0.5. Aliases are split at
    pipes, blank ones left out. An owned category without a parent takes its first alias as parent and has none."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    trust = F.when(text("trust_level") == "", 0.5).otherwise(F.col("trust_level").try_cast("double"))
    split = F.filter(F.transform(F.split(text("aliases"), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    d = rows.select(text("term").alias("term"), split.alias("aliases"), text("category").alias("category"), text("game_title").alias("game"), text("source").alias("source"), trust.alias("trust"), text("parent_entity").alias("parent"))
    owned = F.col("category").isin(*OWNED_CATEGORIES) & (F.size("aliases") > 0) & (F.col("parent") == "")
    d = d.withColumn("_owned", owned).withColumn("parent", F.when(F.col("_owned"), F.element_at("aliases", 1)).otherwise(F.col("parent")))
    return d.withColumn("aliases", F.when(F.col("_owned"), F.expr("cast(array() as array<string>)")).otherwise(F.col("aliases"))).filter("term <> '' AND trust IS NOT NULL").drop("_owned")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """imported() of a CSV with a header; a byte order mark is dropped."""
    names = "term string, aliases string, category string, game_title string, source string, trust_level string, parent_entity string"
    d = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    d = d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])
    return imported(d.select(*[(F.col(x.split()[0]) if x.split()[0] in d.columns else F.lit(None).cast("string")).alias(x.split()[0]) for x in names.split(", ")]))


def listed(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """terms with the sorted array of their aliases, empty where there are none."""
    held = aliases.groupBy("term_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return terms.join(held, "term_id", "left").withColumn("aliases", F.coalesce("aliases", F.expr("cast(array() as array<string>)")))


def merged(terms: DataFrame, aliases: DataFrame, incoming: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The store after an upsert of incoming(term, category, game, parent, source, trust, aliases, seq).

    An entry is found by term, category, game and parent, null being the empty string; it takes source and
    trust of the last incoming row of its key, new entries get the numbers after the highest. Aliases that
    an entry has stay as they are; others are added as manual ones."""
    same = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in KEY]
    last = incoming.groupBy(*same).agg(F.max_by(F.struct("source", "trust"), order).alias("v"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))
    old = terms.select("term_id", *same, F.struct("source", "trust").alias("o"))
    both = materialize(old.join(last, list(KEY), "full"), "merge")
    top = F.broadcast(both.agg(F.coalesce(F.max("term_id"), F.lit(-1)).alias("top")))
    # new entries are numbered by range: a count of each range, then places in it, so no task sorts them all
    new = both.filter("term_id IS NULL").drop("term_id")
    new = materialize(new.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_m", F.monotonically_increasing_id()), "new-terms")
    part = F.shiftright("_m", 33)
    sizes = new.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))  # one row for each range
    new = new.withColumn("_p", part).join(F.broadcast(before), "_p").join(top)
    new = new.withColumn("term_id", F.col("top") + 1 + F.col("before") + (F.col("_m") - F.shiftleft("_p", 33)))
    names = ["term_id", *KEY, "v", "o", "aliases"]
    every = both.filter("term_id IS NOT NULL").select(*names).unionByName(new.select(*names))
    value = F.coalesce("v", "o")
    out = every.select("term_id", *KEY, value["source"].alias("source"), value["trust"].alias("trust"))
    more = every.select("term_id", F.explode("aliases").alias("alias")).filter("alias <> ''").join(aliases, ["term_id", "alias"], "left_anti")
    return out, aliases.select("term_id", "alias", "alias_type").unionByName(more.select("term_id", "alias", F.lit("manual").alias("alias_type")))


def history(results: DataFrame) -> DataFrame:
    """Rows for the correction history of results(doc_id, cue_index, raw_text, corrected_text, candidates, selected, confidence).

    A candidate counts as selected only if the text changed; acceptance is left open."""
    changed = F.col("raw_text") != F.col("corrected_text")
    return results.select("doc_id", "cue_index", "raw_text", "corrected_text", F.to_json("candidates").alias("candidates"), F.when(changed, F.col("selected")).alias("selected"), "confidence", F.lit(None).cast("boolean").alias("accepted"))


def record(results: DataFrame, path: str) -> None:
    """Append history(results) to the table at path."""
    history(results).write.mode("append").parquet(path)


def parents(dictionary: DataFrame) -> DataFrame:
    """Distinct parents of dictionary(parent, ...)."""
    return dictionary.select("parent").filter("parent IS NOT NULL AND parent <> ''").distinct()


def with_parent(rows: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """rows with the parent of their term, null if it is no surface of the dictionary."""
    d = dictionary.select(F.col("surface").alias("_s"), F.col("parent").alias("parent_entity"))
    return rows.join(d, F.col(term) == F.col("_s"), "left").drop("_s")


def clean_term(term: Column) -> Column:
    return F.translate(term, BRACKETS, "")

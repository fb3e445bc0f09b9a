"""Discovery: candidates of each cue, problem density, chunk records and the answers of a filter; event log views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators import correction, ordered

AT = ("doc_id", "cue_index")
#: What a filter answers about a chunk.
FILTERED = "struct<confirmed_entities:array<struct<entity:string,confidence:double,semantic_role:string>>,dominant_categories:array<string>,semantic_signals:array<string>,possible_transition:boolean,transition_region:array<int>,detector_noise:array<string>>"


def detected(spans: DataFrame, k: int = 4) -> DataFrame:
    """spans(doc_id, cue_index, ord, surface, value, score, source, ...): the first k different values of each cue.

    Probes of dormant categories are no candidates. Of a value the first span counts, by ord (order of
    detection), not the best; scores are rounded to three places. Adds place, from 0."""
    first = Window.partitionBy(*AT, "value").orderBy("ord")
    by_ord = Window.partitionBy(*AT).orderBy("ord")
    d = spans.filter(F.col("source") != "pinyin_probe").withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    d = d.withColumn("place", (F.row_number().over(by_ord) - 1).cast("long")).filter(F.col("place") < k)
    return d.withColumn("score", F.round("score", 3)).drop("_r")


def context_window(flagged: Column, total: Column) -> Column:
    """Cues of context on each side, by the share of problem cues: 1 above 0.3, 2 above 0.1, else 3."""
    share = F.when(total > 0, flagged / total).otherwise(0.0)
    return F.when(share > 0.3, 1).when(share > 0.1, 2).otherwise(3)


def chunk_density(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, chunk_id, cues, problems, window of the target cues of chunks(doc_id, cue_index, chunk_id, role)."""
    p = candidates.select(*AT, F.lit(1).alias("_p")).distinct()
    d = chunks.filter("role = 'target'").join(p, list(AT), "left").groupBy("doc_id", "chunk_id").agg(F.count("*").alias("cues"), F.count("_p").alias("problems"))
    return d.withColumn("window", context_window(F.col("problems"), F.col("cues")))


def annotated(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """candidates with expansion_policy and evidence_type from policies(surface, policy, source) where they have none."""
    p = policies.select("surface", F.col("policy").alias("_p"), F.col("source").alias("_s"))
    d = candidates.join(p, "surface", "left")
    for c in ("expansion_policy", "evidence_type"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    open_ = F.col("expansion_policy").isNull()
    d = d.withColumn("evidence_type", F.when(open_, F.coalesce("_s", F.lit("default"))).otherwise(F.col("evidence_type")))
    return d.withColumn("expansion_policy", F.coalesce("expansion_policy", "_p", F.lit("repair_to_canonical"))).drop("_p", "_s")


def answers(replies: DataFrame) -> DataFrame:
    """replies(doc_id, chunk_id, reply) with the parsed answer: JSON, fenced or not; what it lacks is empty, and what is no
    JSON object is null."""
    fenced = F.regexp_extract("reply", r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    body = F.trim(F.when(F.contains("reply", F.lit("```")) & (fenced != ""), fenced).otherwise(F.col("reply")))
    got = F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.from_json(body, FILTERED))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    d = replies.withColumn("_a", got)
    kinds = {"confirmed_entities": "array<struct<entity:string,confidence:double,semantic_role:string>>", "dominant_categories": "array<string>", "semantic_signals": "array<string>", "detector_noise": "array<string>"}
    whole = [F.coalesce(F.col(f"_a.{c}"), none(k)).alias(c) for c, k in kinds.items()]
    answer = F.struct(*whole, F.coalesce(F.col("_a.possible_transition"), F.lit(False)).alias("possible_transition"), F.col("_a.transition_region").alias("transition_region"))
    return d.withColumn("answer", F.when(F.col("_a").isNotNull(), answer)).drop("_a", "reply")


def confirmations(parsed: DataFrame) -> DataFrame:
    """doc_id, chunk_id, entity: an activation for each confirmed entity that has a name."""
    return parsed.select("doc_id", "chunk_id", F.explode("answer.confirmed_entities").alias("e")).select("doc_id", "chunk_id", F.col("e.entity").alias("entity")).filter("entity <> ''")


def run(cues: DataFrame, detect: Callable[[DataFrame], DataFrame], size: int = 100, overlap: int = 15, k: int = 4, ask: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """cues(doc_id, cue_index, text) through chunks, detection and density; with `ask`, a function of the chunks
    (doc_id, chunk_id, problems, window) that returns (doc_id, chunk_id, reply), also the parsed answers.

    A chunk without an answer keeps its candidates, and its answer is null: a failure ends nothing."""
    chunks = ordered.chunk(cues.select(*AT), size, overlap)
    found = detected(detect(cues), k)
    density = chunk_density(chunks, found)
    out = {"chunks": chunks, "candidates": found, "density": density}
    if ask is not None:
        parsed = answers(density.select("doc_id", "chunk_id").join(ask(density), ["doc_id", "chunk_id"], "left"))
        out |= {"answers": parsed, "confirmed": confirmations(parsed)}
    return out


# ---- regions and records -------------------------------------------------------------------


def active_in_region(records: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    """records(lo, hi, active) that are active and overlap lo..hi."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    return records.filter(F.col("active") & (F.col("lo") <= high) & (F.col("hi") >= low))


def uncertain_regions(decisions: DataFrame) -> DataFrame:
    """doc_id, start, end, items: undecided hypotheses of decisions(doc_id, item, start, end, verdict) by their exact place."""
    return decisions.filter("verdict = 'UNCERTAIN'").groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_list("item")).alias("items"))


def event_summary(events: DataFrame) -> DataFrame:
    """events(event_type): how many of each type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def of_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.filter(F.col("event_type") == event_type)


def coverage(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(doc_id, cue_index, term): of each term, the cues that want it and those whose candidates hold it."""
    held = candidates.select(*AT, F.col("value").alias("term")).distinct().withColumn("_h", F.lit(1))
    return targets.select(*AT, "term").distinct().join(held, [*AT, "term"], "left").groupBy("term").agg(F.count("*").alias("wanted"), F.count("_h").alias("covered"))


def plan_summary(batches: DataFrame) -> DataFrame:
    """batches(candidates, prompt): totals and extremes, one row; zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return batches.agg(F.count("*").alias("batches"), zero(F.sum("candidates")).alias("candidates"), zero(F.max("candidates")).alias("most_candidates"), zero(F.sum(F.length("prompt"))).alias("prompt_chars"), zero(F.max(F.length("prompt"))).alias("longest_prompt"))


# ---- edits without a guard -----------------------------------------------------------------


def apply_unguarded(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """As correction.apply_edits, whatever stands at an edit's place: right to left, none is refused."""
    e = edits.groupBy(*AT).agg(F.sort_array(F.collect_list(F.struct(F.col("start_char").alias("st"), F.col("end_char").alias("en"), F.col("replacement").alias("rp"))), asc=False).alias("edits"))
    step = lambda a, x: F.concat(F.substring(a, F.lit(1), x["st"]), x["rp"], F.substring(a, x["en"] + 1, F.length(a)))
    d = cues.join(e, list(AT), "left")
    return d.withColumn("edited", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", F.col("text"), step))).drop("edits")


def local_replacement(text: Column, suggestion: Column) -> Column:
    """The suggestion in place of the whole line, unless it is far longer than the line."""
    return F.when(F.length(suggestion) <= F.greatest(2 * F.length(text), F.length(text) + 8), suggestion).otherwise(text)


def confirmed_rules(decisions: DataFrame, dictionary: DataFrame, categories: tuple[str, ...] = (), least: float = 0.85, min_chars: int = 3) -> DataFrame:
    """Rules learnt from decisions(seq, action, surface, corrected, confidence): replacements by surfaces of the
    dictionary(surface, category), of the categories given if any; category is the dictionary's."""
    d = decisions.filter("action = 'REPLACE' AND surface <> '' AND corrected <> ''").join(dictionary.select(F.col("surface").alias("corrected"), "category").distinct(), "corrected")
    d = d.filter(F.col("category").isin(*categories)) if categories else d
    rules = correction.learn_rules(d, least, min_chars)
    return rules.join(d.groupBy("surface").agg(F.min_by("category", "seq").alias("category")), "surface")

"""Review batches, the decider behind them, second questions, and the edits that come out.

A decider turns prompts into JSON answers; it is called inside mapInPandas, one task at a time, and any
object with `answer(prompt) -> str` will do. `RuleDecider` needs no network. Tables:

candidates(doc_id, cue_index, candidate_index, surface, value, start_char, end_char, score, source, category, evidence_type, match_kind)
decisions(doc_id, cue_index, candidate_index, action, surface, corrected, start_char, end_char, confidence, ...)
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators import alignment, correction, team as teams
from lexweave.operators.topics import cluster_of, context
from lexweave.session import materialize

# Equipment words that must not turn into a character, and evidence that is exempt.
EQUIPMENT = ("标准", "输出", "生成", "输出套", "输出装", "生成装", "标准输出", "标准生成", "装", "套")
PERSONS = ("character", "team_comp_alias")
REPEATED_SOURCES = ("requery_phonetic", "team_comp_requery")
REVIEWED = ("asr_alias", "team_comp_reviewed_override")
ANSWER = "decisions array<struct<cue_index: bigint, candidate_index: int, action: string, confidence: double, requery_type: string, suspect_surface: string, target_hint: string>>"


class Decider(Protocol):
    def answer(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class RuleDecider:
    """Replaces by the best inexact candidate at or above `least`, keeps otherwise, asks about hints."""

    least: float = 0.8

    def answer(self, prompt: str) -> str:
        out = []
        for cue in json.loads(prompt)["cues"]:
            some = [c for c in cue.get("candidates") or [] if c["surface"] != c["value"] and c["score"] >= self.least]
            best = min(some, key=lambda c: (-c["score"], c["candidate_index"]), default=None)
            if best:
                out.append({"cue_index": cue["cue_index"], "candidate_index": best["candidate_index"], "action": "REPLACE", "confidence": best["score"]})
            for h in cue.get("hints") or []:
                out.append({"cue_index": cue["cue_index"], "candidate_index": -1, "action": "REQUERY", **h})
        return json.dumps({"decisions": out}, ensure_ascii=False)


@dataclass(frozen=True)
class NoDecider:
    """Decides nothing: every cue is left for review."""

    def answer(self, prompt: str) -> str:
        return '{"decisions": []}'


def choose_decider(provider: str | None, deciders: dict[str, Decider]) -> Decider:
    """The named decider; NoDecider where none is configured under that name."""
    return deciders.get(provider or "", NoDecider())


def number(candidates: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "cue_index").orderBy(F.col("score").desc(), "value", "start_char", "surface")
    return candidates.withColumn("candidate_index", (F.row_number().over(w) - 1).cast("int"))


def batches(cues: DataFrame, candidates: DataFrame, clustered: DataFrame, hints: DataFrame | None = None, size: int = 10, noise: float = 0.85) -> DataFrame:
    """(doc_id, batch_id, cue_indexes, prompt): cues with candidates or hints, by cluster, `size` at a time.

    hints(doc_id, cue_index, suspect_surface, target_hint, requery_type). Cues outside every cluster form
    the last group. The prompt is JSON: topic, values below `noise`, and the cues."""
    c = candidates.groupBy("doc_id", "cue_index").agg(F.sort_array(F.collect_list(F.struct("candidate_index", "surface", "value", "score", "source", "category"))).alias("candidates"))
    d = cues.select("doc_id", "cue_index", "text").join(c, ["doc_id", "cue_index"], "left")
    if hints is None:
        d = d.withColumn("hints", F.lit(None).cast("array<struct<suspect_surface: string, target_hint: string, requery_type: string>>"))
    else:
        h = hints.groupBy("doc_id", "cue_index").agg(F.sort_array(F.collect_list(F.struct("suspect_surface", "target_hint", "requery_type"))).alias("hints"))
        d = d.join(h, ["doc_id", "cue_index"], "left")
    d = d.filter("candidates IS NOT NULL OR hints IS NOT NULL")
    place = cluster_of(d.select("doc_id", "cue_index"), clustered)
    d = d.join(place, ["doc_id", "cue_index"]).withColumn("_g", F.coalesce("cluster_id", F.lit(2**31 - 1)))
    w = Window.partitionBy("doc_id", "_g").orderBy("cue_index")
    d = d.withColumn("_b", F.floor((F.row_number().over(w) - 1) / size))
    low = F.transform(F.filter("candidates", lambda x: x["score"] < noise), lambda x: x["value"])
    b = d.groupBy("doc_id", "_g", "_b").agg(F.first("cluster_id").alias("cluster_id"), F.sort_array(F.collect_list("cue_index")).alias("cue_indexes"), F.sort_array(F.collect_list(F.struct("cue_index", "text", "candidates", "hints"))).alias("cues"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(low)))).alias("noise"))
    b = b.join(context(clustered), ["doc_id", "cluster_id"], "left")
    topic = F.struct(F.coalesce("topic_label", F.lit("未知话题")).alias("topic_label"), *[F.coalesce(x, F.lit("无")).alias(x) for x in ("stable_entities", "semantic_categories", "semantic_signals")], F.coalesce("temporal_range", F.lit("未知")).alias("temporal_range"))
    return b.select("doc_id", F.concat_ws("-", "_g", "_b").alias("batch_id"), "cue_indexes", F.to_json(F.struct(topic.alias("topic"), "noise", "cues")).alias("prompt"))


def ask(tasks: DataFrame, decider: Decider) -> DataFrame:
    """tasks(..., prompt) with the decider's answer; null where it raised, so one failure loses one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(prompt: str) -> str | None:
            try:
                return decider.answer(prompt)
            except Exception:  # a decider's failure is a result of its task
                return None

        for part in parts:
            yield part.assign(answer=[safe(p) for p in part["prompt"]])

    return tasks.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema) + ", answer string")


def fenced(text: Column) -> Column:
    """The first fenced block of an answer, or the whole of it."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def guarded() -> Column:
    """True for a replacement of an equipment word by a character, without reviewed evidence."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reviewed = text("source").isin(*REVIEWED) | text("evidence_type").isin(*REVIEWED) | text("match_kind").isin(*REVIEWED)
    return ~reviewed & F.col("surface").rlike("|".join(EQUIPMENT)) & (text("category").isin(*PERSONS) | text("source").isin(*REPEATED_SOURCES))


def parse(answers: DataFrame, candidates: DataFrame, allow_requery: bool = True) -> tuple[DataFrame, DataFrame]:
    """answers(doc_id, cue_indexes, answer) -> (decisions, requests).

    A decision must name a cue of its batch and one of the cue's candidates. REPLACE, REVIEW and REQUERY
    count; anything else keeps. A request is only taken where allow_requery is set."""
    d = answers.select("doc_id", "cue_indexes", F.posexplode(F.from_json(fenced(F.col("answer")), ANSWER)["decisions"]).alias("seq", "r")).select("doc_id", "cue_indexes", "seq", "r.*")
    d = d.withColumn("action", F.upper(F.coalesce("action", F.lit("KEEP")))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    own = d.filter((F.col("action") != "REQUERY") & F.array_contains("cue_indexes", F.col("cue_index")) & (F.col("candidate_index") >= 0))
    got = own.select("doc_id", "cue_index", "candidate_index", "seq", "action", "confidence").join(candidates, ["doc_id", "cue_index", "candidate_index"])
    blocked = (F.col("action") == "REPLACE") & guarded()
    action = F.when(blocked, "KEEP").when(F.col("action").isin("REPLACE", "REVIEW"), F.col("action")).otherwise("KEEP")
    field = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    decisions = got.select("doc_id", "cue_index", "candidate_index", action.alias("action"), "surface", F.col("value").alias("corrected"), "start_char", "end_char", "confidence", field("source"), field("category"), field("evidence_type"), F.when(blocked, "generic_loadout_to_character").alias("guard_blocked"))
    requests = d.filter((F.col("action") == "REQUERY") & F.lit(allow_requery))
    return decisions, requests.select("doc_id", "cue_index", "seq", F.coalesce("suspect_surface", F.lit("")).alias("suspect_surface"), F.trim(F.coalesce("target_hint", F.lit(""))).alias("target_hint"), F.coalesce("requery_type", F.lit("terminology_phonetic")).alias("requery_type"))


def requery(requests: DataFrame, cues: DataFrame, entries: DataFrame, readings: dict[str, str], team: teams.Team | None = None, asr: DataFrame | None = None, most: int = 2) -> DataFrame:
    """Candidates for requests, at most `most` a cue in the order of the requests.

    A request's surface must be in its cue. Phonetic ones align it with a term of the dictionary
    (entries(surface, term, category, parent)), team ones rebuild it, ASR ones look it up in
    asr(doc_id, cue_index, surface, value, category, score). Each request's candidates do not depend on
    the others, so the cap is a rank over them."""
    d = requests.join(cues.select("doc_id", "cue_index", "text"), ["doc_id", "cue_index"]).filter((F.col("suspect_surface") != "") & F.contains("text", "suspect_surface"))
    keep = ["doc_id", "cue_index", "seq", "surface", "value", "start_char", "end_char", "score", "source", "category", "evidence_type", "match_kind"]
    start = F.instr("text", F.col("suspect_surface")) - 1
    special = F.col("requery_type").isin("asr_alias", "team_comp_alias")
    known = entries.select(F.col("surface").alias("target_hint"), "category").dropDuplicates(["target_hint"])
    p = d.filter(~special).join(known, "target_hint").withColumn("m", judged(F.col("suspect_surface"), F.col("target_hint"), readings)).filter("m.score IS NOT NULL")
    out = p.select("doc_id", "cue_index", "seq", F.col("suspect_surface").alias("surface"), F.col("target_hint").alias("value"), start.alias("start_char"), (start + F.length("suspect_surface")).alias("end_char"), "m.score", F.lit("requery_phonetic").alias("source"), "category", F.lit("requery_phonetic").alias("evidence_type"), "m.match_kind")
    if team is not None:
        t = teams.team_repairs(d.filter("requery_type = 'team_comp_alias'").select("doc_id", "cue_index", "seq", "text", "suspect_surface"), team)
        out = out.unionByName(t.withColumn("evidence_type", F.lit("team_comp_alias")).withColumn("match_kind", F.col("source")).select(*keep))
    if asr is not None:
        a = d.filter("requery_type = 'asr_alias'").withColumn("start_char", start).join(asr.withColumnRenamed("surface", "suspect_surface"), ["doc_id", "cue_index", "suspect_surface"])
        a = a.select("doc_id", "cue_index", "seq", F.col("suspect_surface").alias("surface"), "value", "start_char", (F.col("start_char") + F.length("suspect_surface")).alias("end_char"), "score", F.lit("asr_alias").alias("source"), "category", F.lit("asr_alias").alias("evidence_type"), F.lit("asr_alias").alias("match_kind"))
        out = out.unionByName(a)
    w = Window.partitionBy("doc_id", "cue_index").orderBy("seq", "value", "surface")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r", "seq")


def judged(span: Column, term: Column, readings: dict[str, str]) -> Column:
    """The match of a given span with a term, prefixes allowed."""

    @F.pandas_udf("score double, match_kind string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        aligner = alignment.Aligner(readings)
        for spans, terms in parts:
            got = [aligner.judge(s, t, prefix=True) if s and t else None for s, t in zip(spans, terms, strict=True)]
            yield pd.DataFrame([(m.score, m.kind) if m else (None, None) for m in got], columns=["score", "match_kind"]).astype({"score": "float64"})

    return run(span, term)


def refine(cues: DataFrame, candidates: DataFrame, clustered: DataFrame, decider: Decider, entries: DataFrame, readings: dict[str, str], hints: DataFrame | None = None, team: teams.Team | None = None, asr: DataFrame | None = None, protected: DataFrame | None = None, size: int = 10) -> DataFrame:
    """Two rounds: decisions on the candidates, then on those its questions brought up; no third one.

    A batch whose answer cannot be read is asked again cue by cue. Answers are written to the shared
    folder: a decider is asked once, and a lost executor repeats its tasks only."""

    def told(cand: DataFrame, with_hints: DataFrame | None, first: bool) -> tuple[DataFrame, DataFrame]:
        readable = F.from_json(fenced(F.col("answer")), ANSWER)["decisions"].isNotNull()
        got = materialize(ask(batches(cues, cand, clustered, with_hints, size if first else 1), decider), "answers")
        if first and size > 1:
            lost = got.filter(~F.coalesce(readable, F.lit(False))).select("doc_id", F.explode("cue_indexes").alias("cue_index"))
            again = cand.join(lost, ["doc_id", "cue_index"], "left_semi")
            some = with_hints.join(lost, ["doc_id", "cue_index"], "left_semi") if with_hints is not None else None
            retried = materialize(ask(batches(cues, again, clustered, some, 1), decider), "answers-again")
            got = got.filter(readable).unionByName(retried.filter(readable))
        return parse(got, cand, first)

    one, requests = told(candidates, hints, True)
    extra = requery(requests, cues, entries, readings, team, asr)
    if protected is not None:
        extra = correction.protect(extra, protected)
    extra = materialize(number(extra), "requery")
    two, _ = told(extra, None, False)
    return one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))


def plan_edits(decisions: DataFrame, cues: DataFrame) -> DataFrame:
    """Edits of all REPLACE decisions: at the given span if the text holds the surface there, else where
    it first occurs; none if it does not."""
    d = decisions.filter("action = 'REPLACE' AND surface <> ''").join(cues.select("doc_id", "cue_index", "text"), ["doc_id", "cue_index"])
    given = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.length("text")) & (F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("surface"))
    at = F.when(F.coalesce(given, F.lit(False)), F.col("start_char").cast("int")).otherwise(F.instr("text", F.col("surface")) - 1)
    d = d.withColumn("start_char", at).filter("start_char >= 0").withColumn("end_char", F.col("start_char") + F.length("surface"))
    return d.select("doc_id", "cue_index", "start_char", "end_char", "surface", F.col("corrected").alias("replacement"), "confidence")


def reuse(cues: DataFrame, decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """decisions plus those of rules(surface, corrected, confidence, seq) wherever no decision's span is.

    Occurrences of one rule do not overlap each other; earlier rules win over later ones."""
    spans = correction.containment_spans(cues, rules.select("surface")).join(rules, "surface")
    taken = decisions.filter("start_char < end_char").select("doc_id", "cue_index", F.struct(F.col("start_char").cast("long").alias("s"), F.col("end_char").cast("long").alias("e")).alias("x"))
    taken = taken.groupBy("doc_id", "cue_index").agg(F.collect_list("x").alias("taken"))
    spot = F.struct("seq", F.col("start_char").alias("s"), F.col("end_char").alias("e"), "surface", "corrected", "confidence")
    d = spans.groupBy("doc_id", "cue_index").agg(F.array_sort(F.collect_list(spot)).alias("spots")).join(taken, ["doc_id", "cue_index"], "left")
    d = d.withColumn("taken", F.coalesce("taken", F.array().cast("array<struct<s: bigint, e: bigint>>")))

    def step(state: Column, x: Column) -> Column:
        # a rule goes on after its own occurrence even where that was taken
        inside = (state["seq"] == x["seq"]) & (x["s"] < state["next"])
        free = ~inside & ~F.exists(state["taken"], lambda t: (x["s"] < t["e"]) & (t["s"] < x["e"]))
        return F.struct(
            F.when(inside, state["seq"]).otherwise(x["seq"]).alias("seq"),
            F.when(inside, state["next"]).otherwise(x["e"]).alias("next"),
            F.when(free, F.concat(state["taken"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))).otherwise(state["taken"]).alias("taken"),
            F.when(free, F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(-1).cast(rules.schema["seq"].dataType).alias("seq"), F.lit(-1).cast("long").alias("next"), F.col("taken").alias("taken"), F.slice("spots", 1, 0).alias("out"))
    found = d.select("doc_id", "cue_index", F.explode(F.aggregate("spots", start, step)["out"]).alias("x"))
    own = found.select("doc_id", "cue_index", F.lit(-1).alias("candidate_index"), F.lit("REPLACE").alias("action"), F.col("x.surface").alias("surface"), F.col("x.corrected").alias("corrected"), F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char"), F.col("x.confidence").alias("confidence"))
    return decisions.unionByName(own, allowMissingColumns=True)


def blended(told: Column, best: Column) -> Column:
    """A correction's confidence: what was told and the best candidate's score, or the former alone."""
    return F.when(best > 0, F.round(told * 0.35 + best * 0.65, 3)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), told)))


def needs_decision(detections: DataFrame, candidates: DataFrame, least: float = 0.72) -> DataFrame:
    """detections(doc_id, cue_index, risk) worth a question: risky, and with a candidate that is more than context."""
    real = candidates.filter(F.coalesce("intent", F.lit("")) != "context_alias")
    return detections.filter(F.col("risk") >= least).join(real, ["doc_id", "cue_index"], "left_semi")


def activations(names: DataFrame, entries: DataFrame) -> DataFrame:
    """names(doc_id, cue_index, name) that the dictionary has, and their parents, once each."""
    known = names.join(entries.select(F.col("term").alias("name"), "parent").distinct(), "name")
    parents = known.filter("parent <> ''").select("doc_id", "cue_index", F.col("parent").alias("entity"))
    return known.select("doc_id", "cue_index", F.col("name").alias("entity")).unionByName(parents).distinct()

"""Batches, answers, second questions, edits and reuse."""

import json
import random

from pyspark.sql import functions as F

from lexweave.functions import phonetic
from lexweave.operators import correction
from lexweave.operators import decisions as D
from lexweave.operators import team as M

CAND = "doc_id long, cue_index long, surface string, value string, start_char int, end_char int, score double, source string, category string, evidence_type string, match_kind string"
CLUSTER = "doc_id long, cluster_id int, lo long, hi long, entities array<string>, categories array<string>, signals array<string>"
DECISION = "doc_id long, cue_index long, action string, surface string, corrected string, start_char int, end_char int, confidence double"


def flaky():
    class Flaky:
        """Fails on batches of several cues."""

        def answer(self, prompt):
            if len(json.loads(prompt)["cues"]) > 1:
                raise ValueError
            return "```json\n" + D.RuleDecider().answer(prompt) + "\n```"

    return Flaky()  # a local class travels to the workers by value


def setup(spark):
    cues = spark.createDataFrame([(1, 0, "弗丽娜来了"), (1, 1, "夫万队"), (1, 2, "好"), (1, 3, "标准输出")], "doc_id long, cue_index long, text string")
    cand = spark.createDataFrame([(1, 0, "弗丽娜", "芙宁娜", 0, 3, 0.9, "pinyin", "character", "x", "p"), (1, 3, "标准", "芙宁娜", 0, 2, 0.9, "pinyin", "character", "x", "p")], CAND)
    clustered = spark.createDataFrame([(1, 0, 0, 1, ["芙宁娜"], ["character"], [])], CLUSTER)
    hints = spark.createDataFrame([(1, 1, "夫万", "", "team_comp_alias"), (1, 2, "没有", "芙宁娜", "terminology_phonetic")], "doc_id long, cue_index long, suspect_surface string, target_hint string, requery_type string")
    entries = spark.createDataFrame([("芙宁娜", "芙宁娜", "character", "")], "surface string, term string, category string, parent string")
    return cues, D.number(cand), clustered, hints, entries


def test_refine_and_commit(spark):
    cues, cand, clustered, hints, entries = setup(spark)
    readings = phonetic.han_readings(spark)
    team = M.Team({"芙": "芙宁娜", "万": "枫原万叶"}, readings)
    for decider in (D.RuleDecider(), flaky()):
        got = D.refine(cues, cand, clustered, decider, entries, readings, hints, team)
        rows = {(r.cue_index, r.round): (r.action, r.corrected, r.guard_blocked) for r in got.collect()}
        assert rows == {(0, 1): ("REPLACE", "芙宁娜", None), (3, 1): ("KEEP", "芙宁娜", "generic_loadout_to_character"), (1, 2): ("REPLACE", "芙万", None)}
    edited = correction.apply_edits(cues, D.plan_edits(got, cues))
    assert [r.edited for r in edited.orderBy("cue_index").collect()] == ["芙宁娜来了", "芙万队", "好", "标准输出"]
    assert D.refine(cues, cand, clustered, D.NoDecider(), entries, readings).count() == 0
    assert D.choose_decider(None, {}) == D.NoDecider() and D.choose_decider("r", {"r": D.RuleDecider()}) == D.RuleDecider()


def test_parse(spark):
    cand = D.number(spark.createDataFrame([(1, 5, "ab", "AB", 0, 2, 0.5, "s", "c", None, None)], CAND))
    told = [[1, [5], 'x ```json {"decisions":[{"cue_index":5,"candidate_index":0,"action":"reject"},{"cue_index":5,"candidate_index":9,"action":"REPLACE"},{"cue_index":6,"candidate_index":0,"action":"REPLACE"},{"cue_index":5,"action":"REQUERY","suspect_surface":"a"}]}```'], [1, [5], "no json"], [1, [5], None]]
    answers = spark.createDataFrame(told, "doc_id long, cue_indexes array<long>, answer string")
    d, r = D.parse(answers, cand)
    assert [(x.action, x.confidence) for x in d.collect()] == [("KEEP", 0.5)]
    assert [(x.suspect_surface, x.requery_type) for x in r.collect()] == [("a", "terminology_phonetic")]
    assert D.parse(answers, cand, False)[1].count() == 0


def test_plan_edits(spark):
    cues = spark.createDataFrame([(1, 0, "abcabc")], "doc_id long, cue_index long, text string")
    d = spark.createDataFrame([(1, 0, "REPLACE", "abc", "X", 3, 6, 1.0), (1, 0, "REPLACE", "abc", "Y", 1, 4, 1.0), (1, 0, "KEEP", "abc", "Z", 0, 3, 1.0), (1, 0, "REPLACE", "zz", "Z", 0, 2, 1.0), (1, 0, "REPLACE", "", "Z", 0, 2, 1.0)], DECISION)
    assert sorted((r.start_char, r.replacement) for r in D.plan_edits(d, cues).collect()) == [(0, "Y"), (3, "X")]


def plain_reuse(text, spans, rules):
    taken, out = list(spans), []
    for surface, _ in rules:
        at = text.find(surface)
        while at >= 0:
            end = at + len(surface)
            if not any(at < e and s < end for s, e in taken):
                taken.append((at, end))
                out.append((surface, at))
            at = text.find(surface, end)
    return out


def test_reuse(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randrange(12))) for _ in range(40)]
    rules = [("aba", "R0"), ("bb", "R1"), ("aa", "R2")]
    cues = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, cue_index long, text string")
    spans = {i: (1, 3) for i in range(0, 40, 3)}
    d = spark.createDataFrame([(1, i, "KEEP", "x", "x", s, e, 1.0) for i, (s, e) in spans.items()], DECISION)
    r = spark.createDataFrame([(s, c, 0.9, k) for k, (s, c) in enumerate(rules)], "surface string, corrected string, confidence double, seq int")
    got = sorted((x.cue_index, x.surface, x.start_char) for x in D.reuse(cues, d, r).filter("candidate_index = -1").collect())
    assert got == sorted((i, s, at) for i, t in enumerate(texts) for s, at in plain_reuse(t, [spans[i]] if i in spans else [], rules))


def test_small_rules(spark):
    d = spark.createDataFrame([(0.9, 0.8), (0.9, 0.0)], "a double, b double")
    assert [r[0] for r in d.select(D.blended(F.col("a"), F.col("b"))).collect()] == [0.835, 0.9]
    det = spark.createDataFrame([(1, 0, 0.8), (1, 1, 0.8), (1, 2, 0.5)], "doc_id long, cue_index long, risk double")
    cand = spark.createDataFrame([(1, 0, None), (1, 1, "context_alias"), (1, 2, None)], "doc_id long, cue_index long, intent string")
    assert [r.cue_index for r in D.needs_decision(det, cand).collect()] == [0]
    names = spark.createDataFrame([(1, 0, "a"), (1, 0, "z")], "doc_id long, cue_index long, name string")
    entries = spark.createDataFrame([("a", "p"), ("b", "")], "term string, parent string")
    assert sorted(r.entity for r in D.activations(names, entries).collect()) == ["a", "p"]

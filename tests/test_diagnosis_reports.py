"""Causes and stages of missed errors, report tables, and the language detector."""

import random

from pyspark.sql import functions as F

from lexweave.functions import phonetic
from lexweave.functions import text as T
from lexweave.operators import corpus, diagnosis, language, reports


def test_causes(spark):
    rows = [("弗丽娜来", "弗丽娜来", "芙宁娜来", ["芙宁娜"], False), ("弗丽娜来", "弗丽娜去", "芙宁娜来", [], False), ("弗丽娜来", "弗丽娜来", "芙宁娜来", ["乙乙"], False), ("弗丽娜来", "弗丽娜来", "芙宁娜来", None, False), ("弗丽娜来", "弗丽娜来", "芙宁娜来", [], True), ("ab", "ab", "ac", [], False), ("同", "同", "同", [], False), ("", "", "芙宁娜", [], False)]
    d = diagnosis.causes(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, raw string, fixed string, gold string, values array<string>, requeried boolean"))
    got = [r.cause for r in d.orderBy("id").collect()]
    assert got == ["PHASE2_REJECTED", "PARTIAL_FIX", "WRONG_CANDIDATE_ONLY", "NO_CANDIDATE", "REQUERY_FAILED"] + ["NON_TERMINOLOGY_DIFF"] * 3
    n = {r.cause: r.n for r in diagnosis.cause_report(d).collect()}
    assert set(n) == set(diagnosis.CAUSES) and n["UNCLASSIFIED"] == 0 and n["NON_TERMINOLOGY_DIFF"] == 3
    assert d.orderBy("id").first().terms == ["芙宁", "宁娜", "娜来"][:2] + ["芙宁娜", "宁娜来", "芙宁娜来"]


def test_gold_terms(spark):
    """A line end is no letter, repeated terms are kept, and long texts equal a plain loop."""
    rng = random.Random(8)
    long = "".join(rng.choice("abc 😀芙\n") for _ in range(2000))
    rows = [("x", "ab\n"), ("ab", "abcab bcb"), ("ab", "ab"), ("", "ab"), (None, "ab"), ("ab", None), (long, long[:900] + "cacbcbab" + long[900:])]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, raw string, gold string").withColumn("terms", diagnosis.gold_terms(F.col("raw"), F.col("gold"), "[a-z]"))
    for r in d.collect():
        every = lambda t: [t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1) if set(t[i : i + n]) <= set("abcx")]
        known = set(every(r.raw or ""))
        assert r.terms == ([x for x in every(r.gold) if x not in known] if r.raw and r.gold else [])


def test_hamming_plus(spark):
    rows = [("a😀c", "a芙c", 1), ("", "ab", 2), ("ab", "", 2), ("", "", 0), ("abc", "abcd", 1), ("xbc", "abcdefg", 7), (None, "a", None), ("a", None, None)]
    d = spark.createDataFrame(rows, "a string, b string, n int")
    assert all(r.n == r.m for r in d.select("n", T.hamming_plus(F.col("a"), F.col("b")).alias("m")).collect())


def test_stage(spark):
    arr = "array<string>"
    rows = [(["x"], [], [], [], [], [], False, False), ([], [], [], [], [], [], False, False), (["g"], [], [], [], [], [], False, False), (["g"], ["g"], [], [], ["missing_stable_entities"], [], False, False), (["g"], ["g"], [], ["g"], [], ["keep"], False, False), (["g"], ["g"], [], ["g"], [], ["replace"], False, False), (["g"], ["g"], [], [], [], [], True, False), (["g"], ["g"], [], [], [], [], False, False), (["g"], ["g"], [], [], [], [], True, True)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, a {arr}, b {arr}, c {arr}, d {arr}, s {arr}, act {arr}, asked boolean, made boolean")
    g = F.array(F.lit("g"))
    got = [r[0] for r in d.orderBy("id").select(diagnosis.stage(F.col("a"), F.col("b"), F.col("c"), F.col("d"), g, F.col("s"), F.col("act"), F.col("asked"), F.col("made"))).collect()]
    assert got == ["WRONG_CANDIDATE_ONLY", "DETECTOR_MISS", "DISCOVERY_FILTERED_GT", "EXPANSION_SKIPPED_NO_STABLE_ENTITY", "PHASE2_REJECTED_GT", "UNKNOWN", "REQUERY_FAILED", "REQUERY_NOT_REQUESTED", "UNKNOWN"]


def test_state_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    one = lambda d: d.first().state_hash
    assert one(diagnosis.state_hash(a)) == one(diagnosis.state_hash(a.orderBy(F.desc("k")).repartition(3)))
    assert one(diagnosis.state_hash(a)) != one(diagnosis.state_hash(a.distinct()))
    assert diagnosis.state_hash(a.limit(0)).first().n == 0


def test_marks_and_bars(spark):
    assert reports.mark("abcd", "abXd") == ("ab~~c~~d", "ab**X**d")
    assert reports.mark("ab", "b") == ("~~a~~b", "b") and reports.mark("a", "a") == ("a", "a") and reports.mark(None, "a") == (None, "a")
    assert reports.changed_segments("abcd", "abXYd") == ["XY"] and reports.changed_segments(None, "a") == ["a"]
    d = spark.createDataFrame([("abcd", "abXd", 0.35)], "a string, b string, c double")
    r = d.select(reports.marked("a", "b").alias("m"), reports.confidence_bar(F.col("c")).alias("bar"), reports.weight_bar(F.col("c")).alias("w")).first()
    assert r.m.repaired == "ab**X**d" and r.bar == "####------ 35%" and r.w == "**... 0.35"
    h = reports.histogram(spark.createDataFrame([(0.05,), (0.75,), (0.79,)], "x double"), "x", 0.1, 0.72).orderBy("bucket").collect()
    assert [(x.bucket, x.n, x.marks) for x in h] == [(0, 1, False), (7, 2, True)]
    text = reports.markdown("t", spark.createDataFrame([("a|b",), (None,)], "x string"), 1)
    assert "a\\|b" in text and "More than 1 rows." in text
    assert [(r.stage, r.n) for r in reports.stage_counts({"a": d, "b": d.limit(0)}).orderBy("ord").collect()] == [("a", 1), ("b", 0)]


def test_entity_timeline(spark):
    rng = random.Random(6)
    acts = {(doc, e): sorted(rng.sample(range(120), rng.randrange(1, 12))) for doc in range(4) for e in "ab"}
    cues = spark.createDataFrame([(d, i) for d in range(4) for i in range(120)], "doc_id long, cue_index long")
    got = reports.entity_timeline(cues, spark.createDataFrame([(d, e, i) for (d, e), x in acts.items() for i in x], "doc_id long, entity string, cue_index long"))
    want = set()
    for (d, e), x in acts.items():
        weight, n = None, 0
        for i in range(120):  # decay, prune, activate
            if weight is not None:
                before, weight = weight, weight * (1.0 if n >= 5 else min(0.98, 0.8 + 0.04 * n))
                if weight < 0.2:
                    want.add((d, e, i, "forgotten", round(before, 6)))
                    weight, n = None, 0
            if i in x:
                want.add((d, e, i, "activated", 0.0) if weight is None else (d, e, i, "refreshed", round(weight, 6)))
                n = 0 if weight is None else n + (1 if weight < 1.0 else 0)
                weight = 1.0
    assert {(r.doc_id, r.entity, r.cue_index, r.event, round(r.weight, 6)) for r in got.collect()} == want


def test_nearest_alias(spark):
    readings = phonetic.han_readings(spark)
    assert round(language.alikeness("夫妇", "芙芙", readings), 2) == 0.85
    words = ["夫妇", "金破", "乙", "abc", "zzz"]
    aliases = [("芙芙", 0), ("金珀", 1), ("abd", 2)]
    got = {r.surface: (r.alias, round(r.likeness, 6)) for r in language.nearest_alias(spark.createDataFrame([(w,) for w in words], "surface string"), spark.createDataFrame(aliases, "alias string, seq int"), readings).collect()}
    for w in words:
        a, top = max(((a, language.alikeness(w, a, readings)) for a, _ in aliases), key=lambda x: x[1])
        assert got[w] == (a if top >= 0.5 else None, round(top, 6))


def test_detect(spark):
    readings = phonetic.han_readings(spark)
    text = spark.createDataFrame([(1, "他有芙芙好用"), (2, "用芙芙打")], "sentence_id long, text string")
    known = spark.createDataFrame([("芙芙", "芙宁娜", 0)], "surface string, canonical string, seq int")
    grams = corpus.ngram_counts(text.select("text"))
    ctx = language.alias_contexts(text, known)
    assert {r.context for r in ctx.collect()} == {"他有"[0:2], "好用", "用", "打"}
    assert language.context_patterns(text, known).filter("gram = '芙芙'").first().n == 2
    cues = spark.createDataFrame([(1, 0, "夫妇"), (1, 1, "芙芙"), (1, 2, None), (1, 3, "abc")], "doc_id long, cue_index long, text string")
    got = {(r.cue_index, r.surface): (r.value, r.expansion_policy, r.risk) for r in language.detect(cues, known, grams, ctx, readings).collect()}
    assert got == {(0, "夫妇"): ("芙芙", "contextual_expand", 0.933), (1, "芙芙"): ("芙芙", "preserve_surface", 0.0)}

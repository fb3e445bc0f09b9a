"""Alignment on golden cases and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import phonetic
from lexweave.operators import alignment as A


@pytest.fixture(scope="module")
def readings(spark):
    return phonetic.han_readings(spark)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(70))) for _ in range(2))
        assert phonetic.lcs_length(a, b) == plain_lcs(a, b)
    assert round(phonetic.ratio("fu li na", "fu ning na"), 1) == 77.8
    assert round(phonetic.ratio("fu lin na", "fu ning na"), 1) == 84.2


def test_golden_alignments(readings):
    a = A.Aligner(readings)
    m = a.judge("弗丽娜", "芙宁娜")
    assert (m.kind, m.score, m.surface, m.target, round(m.extra, 3)) == ("phonetic_partial", 0.778, 0.667, 0.667, 0.333)
    m = a.judge("纳外特", "那维莱特", prefix=True)
    assert (m.kind, m.score, m.surface, m.target) == ("phonetic_partial", 0.818, 1.0, 0.75)
    assert a.judge("弗丽a", "芙宁娜") is None
    assert a.judge("金珀", "试作金珀", policy="preserve_surface") is None
    assert a.judge("芙宁娜", "芙宁娜").kind == "exact"
    assert a.judge("", "芙") is None and a.judge("芙", "芙") is None
    assert a.weigh("芙芙", "芙宁娜", A.LONG_VARIANT).kind == "stable_entity_repeated_syllable"


def test_trim():
    assert A.trimmed("芙芙大招", 0, 4, ("大招",)) == 2
    assert A.trimmed("芙芙长E", 0, 3, ("大招",)) == 2
    assert A.trimmed("芙芙长", 0, 3, ("大招",)) == 3


def test_expand(spark, readings):
    cues = spark.createDataFrame([(1, 0, "今天弗丽娜 abc"), (1, 1, "芙宁娜"), (1, 2, None), (1, 3, ""), (1, 4, "纳外特来了")], "doc_id long, cue_index long, text string")
    entries = spark.createDataFrame([("芙宁娜", "芙宁娜", "character", ""), ("那维莱特", "那维莱特", "character", ""), ("食物", "食物", "food", "")], "surface string, term string, category string, parent string")
    stable = cues.select("doc_id", "cue_index").crossJoin(entries.select(F.col("term").alias("entity")))
    got = {(r.cue_index, r.value): (r.surface, r.start_char, r.end_char) for r in A.expand(cues, stable, entries, readings, A.CONSISTENCY).collect()}
    assert got[(0, "芙宁娜")] == ("弗丽娜", 2, 5)
    assert {k[0] for k in got} <= {0, 4}
    long = {r.value: r.surface for r in A.expand(cues.filter("cue_index = 4"), stable, entries, readings, A.LONG_VARIANT, None).collect()}
    assert long["那维莱特"] == "纳外特"
    assert A.expand(cues.limit(0), stable, entries, readings, A.LOCAL).count() == 0


def test_merge(spark):
    schema = "doc_id long, cue_index long, surface string, value string, start_char int, end_char int, score double, match_kind string, source string"
    old = spark.createDataFrame([(1, 0, "a", "A", 0, 1, 0.8, "exact", "x"), (1, 0, "b", "B", 1, 2, 0.5, "p", "x")], schema)
    new = spark.createDataFrame([(1, 0, "a", "A", 0, 1, 0.8, "p", "y"), (1, 0, "c", "C", 2, 3, 0.8, "p", "y")], schema)
    got = A.merge(old, new, 2).orderBy(F.col("score").desc(), "source").collect()
    assert [(r.value, r.source) for r in got] == [("A", "x"), ("C", "y")]
    assert {r.source: (r.proposed, r.retained) for r in A.expansion_summary(old.unionByName(new), A.merge(old, new, 2)).collect()} == {"x": (2, 1), "y": (2, 1)}


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcd ", k=rng.randrange(1, 12))).strip() or "a" for _ in range(150)})
    left, right = words[:70], words[50:]
    got = {(r.l, r.r) for r in phonetic.similar_pairs(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), F.lit(72.0), 72.0).collect()}
    assert got == {(x, y) for x, y in itertools.product(left, right) if phonetic.ratio(x, y) >= 72}


def test_sounds_like(spark, readings):
    tokens = spark.createDataFrame([(1, 0, "弗丽娜", 2), (1, 0, "夫妇", 7), (2, 0, "夫妇", 0), (2, 1, "果酱", 0)], "doc_id long, cue_index long, token string, start_char int")
    entries = spark.createDataFrame([("芙宁娜", "芙宁娜", "character", None, 0), ("芙芙", "芙芙", "character", "芙宁娜", 1), ("果浆", "果浆", "food", None, 2)], "surface string, term string, category string, parent string, seq int")
    active = spark.createDataFrame([(1, "芙宁娜")], "doc_id long, name string")
    got = {(r.doc_id, r.surface): (r.value, r.source) for r in A.sounds_like(tokens, entries, active, ("food",), readings).collect()}
    assert got == {(1, "弗丽娜"): ("芙宁娜", "pinyin"), (1, "夫妇"): ("芙芙", "pinyin"), (2, "果酱"): ("果浆", "pinyin_probe")}


def test_simplified(spark):
    assert spark.createDataFrame([("龍馬還臺灣",)], "t string").select(phonetic.simplified(spark, F.col("t"))).first()[0] == "龙马还台湾"


def test_expansion_takes_terms_from_where_they_stand_first(spark, monkeypatch):
    from lexweave.plans import engine

    monkeypatch.setattr(A, "expand", lambda cues, stable, *a: stable)
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in engine.expand_local_term(spark, sf).collect()}
    cues = engine._cues(spark, sf).select("doc_id", "cue_index", engine.script(engine.F.col("text")).alias("t")).collect()
    names = [r.term for r in engine._entries(spark, sf).select("term").distinct().collect()]
    want = {(c.doc_id, c.cue_index, n) for c in cues for n in names if any(x.doc_id == c.doc_id and x.cue_index <= c.cue_index and n in x.t for x in cues)}
    assert got == want and want

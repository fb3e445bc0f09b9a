"""Clusters and topic graph against plain loops; team shorthand on small cases."""

import math
import random

from pyspark.sql import functions as F

from lexweave.functions import phonetic
from lexweave.operators import team as M
from lexweave.operators import topics

CHUNK = "doc_id long, chunk_id long, lo long, hi long, entities array<string>, categories array<string>, signals array<string>"


def jac(a, b):
    return len(set(a) & set(b)) / max(1, len(set(a) | set(b)))


def plain_clusters(rows):
    out, used = [], set()
    rows = sorted([r for r in rows if r[4] is not None], key=lambda r: (r[2], r[1]))
    for i, r in enumerate(rows):
        if i in used:
            continue
        e, c, s, end, n = set(r[4]), set(r[5]), set(r[6]), r[3], 1
        for j in range(i + 1, len(rows)):
            x = rows[j]
            if j not in used and jac(e, x[4]) > 0.4 and jac(c, x[5]) > 0.3 and abs(x[2] - end) < 50:
                used.add(j)
                e, c, s, end, n = e | set(x[4]), c | set(x[5]), s | set(x[6]), max(end, x[3]), n + 1
        out.append((r[0], r[2], end, sorted(e), sorted(c), sorted(s), n))
    return out


def test_clusters(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(6):
        at = 0
        for k in range(rng.randrange(1, 14)):
            n = rng.choice([10, 20, 100])
            pick = lambda pool, m: rng.sample(pool, rng.randrange(0, m))
            rows.append((doc, k, at, at + n - 1, None if rng.random() < 0.1 else pick(["a", "b", "c"], 4), pick(["x", "y"], 3), pick(["s", "t"], 2)))
            at += n + rng.choice([0, 0, 0, 49, 50])
    got = topics.clusters(spark.createDataFrame(rows, CHUNK))
    have = sorted((r.doc_id, r.lo, r.hi, r.entities, r.categories, r.signals, r.n_chunks) for r in got.collect())
    assert have == sorted(x for doc in range(6) for x in plain_clusters([r for r in rows if r[0] == doc]))
    cues = spark.createDataFrame([(0, 0), (0, 10**6)], "doc_id long, cue_index long")
    assert {r.cue_index: r.cluster_id for r in topics.cluster_of(cues, got).collect()}[10**6] is None
    assert topics.context(got).count() == got.count()
    assert topics.clusters(spark.createDataFrame([], CHUNK)).count() == 0


def cos(a, b):
    if not a or not b:
        return 0.5
    n = max(len(a), len(b))
    a, b = a + [0.0] * (n - len(a)), b + [0.0] * (n - len(b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / ((math.sqrt(sum(x * x for x in a)) or 1.0) * (math.sqrt(sum(x * x for x in b)) or 1.0))


def test_topic_graph(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(5):
        for k in range(12):
            lo = rng.randrange(200)
            rows.append((doc, k, lo, lo + 3, f"L{k}", rng.choice([["a"], ["b"], ["a", "b"], []]), rng.choice([["w"], ["v"]]), rng.choice([[1.0], [0.5, 0.5], []])))
    d = spark.createDataFrame(rows, "doc_id long, seq long, lo long, hi long, label string, entities array<string>, words array<string>, signals array<double>")
    want_edges, want_labels = set(), {}
    sim = lambda x, y: 0.4 * jac(x[5], y[5]) + 0.35 * jac(x[6], y[6]) + 0.25 * cos(x[7], y[7])
    for doc in range(5):
        nodes = []
        for x in sorted([r for r in rows if r[0] == doc], key=lambda r: (r[2], r[1])):
            label = x[4]
            for k, y in enumerate(nodes):
                if sim(x, y) > 0.75 and abs(x[2] - y[3]) > 5 and abs(y[2] - x[3]) > 5:
                    want_edges.add((doc, k, len(nodes), "RECURRENCE", round(sim(x, y), 9)))
                    label = want_labels[doc, k]
                    break
            else:
                if nodes:
                    want_edges.add((doc, len(nodes) - 1, len(nodes), "DRIFT", round(1 - sim(x, nodes[-1]), 9)))
            want_labels[doc, len(nodes)] = label
            nodes.append(x)
    nodes, edges = topics.topic_graph(d)
    assert {(r.doc_id, r.from_node, r.to_node, r.transition_type, round(r.strength, 9)) for r in edges.collect()} == want_edges
    assert {(r.doc_id, r.node): r.label for r in nodes.collect()} == want_labels
    assert "RECURRENCE" in {e[3] for e in want_edges}


def test_team(spark):
    team = M.Team({"琴": "琴", "芙": "芙宁娜", "万": "枫原万叶", "娜": "娜维娅"}, phonetic.han_readings(spark))
    assert team.members("芙万队") == [("芙", "芙宁娜"), ("万", "枫原万叶")]
    assert team.members("今天天气不好万") == []
    assert team.repair("琴谱队", "琴谱") == ("琴谱", "琴芙", 0.95, "team_comp_reviewed_override", "琴|芙宁娜", 0, 2)
    assert team.repair("夫万队", "夫万")[1:3] == ("芙万", 0.86)
    assert team.repair("夫万了", "夫万") is None and team.repair("输出夫万队", "夫万") is None and team.repair(None, "x") is None
    assert team.hints("琴谱队和夫万组合") == ["琴谱", "夫万"] and team.hints(None) == []
    cues = spark.createDataFrame([(1, 0, "芙万队 带芙芙"), (1, 1, "芙万"), (1, 2, None), (1, 3, "")], "doc_id long, cue_index long, text string")
    nick = spark.createDataFrame([("芙芙", "芙宁娜"), ("万叶", "枫原万叶")], "surface string, canonical string")
    got = [(r.cue_index, r.alias, r.canonical) for r in M.parse_teams(cues, team, nick).orderBy("cue_index", "ord").collect()]
    assert got[:2] == [(0, "芙", "芙宁娜"), (0, "万", "枫原万叶")]
    assert M.team_hints(cues, team).count() == 0
    asked = cues.filter("cue_index = 0").withColumn("text", F.lit("夫万队")).withColumn("suspect_surface", F.lit("夫万"))
    assert [r.value for r in M.team_repairs(asked, team).collect()] == ["芙万"]

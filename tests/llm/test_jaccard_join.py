"""The similarity join against brute force over all pairs."""

import random
import re
from collections import defaultdict

from lexweave.llm import jaccard_join as jj
from tests.llm.conftest import EDGE


def brute(rows, least=0.8):
    """(doc_id, text) -> class_id, n_links for each row."""

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, at = [0] * len(rows), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or ():
            at[g].append(i)
    for i, s in enumerate(sets):
        seen = {j for g in s or () for j in at[g] if j > i}
        for j in seen:
            k = len(s & sets[j])
            if k >= least * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least_id = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_id[find(i)].append(d)
    return sorted(((d, min(least_id[find(i)], default=None), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


def near_copies(n, words, seed, base=0):
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(text)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((base + i, " ".join(t)))
    return out


def test_whole_table(spark, corpus, edge):
    rows = [(r[0], r[1]) for r in corpus]
    assert got(jj.op2(spark.createDataFrame(corpus, edge.schema))) == brute(rows)


def test_edge_rows(edge, empty, clash):
    assert got(jj.op2(clash(edge))) == brute([(r[0], r[1]) for r in EDGE])
    assert jj.op2(empty).collect() == []


def test_large_nodes_and_blocks(spark):
    rows = near_copies(150, 120, 1) + near_copies(60, 200, 2, 1000) + [(5000 + i, f"alone {i} " + " ".join(f"q{i}_{k}" for k in range(30))) for i in range(50)]
    config = jj.JoinConfig(small=16, block_sets=16, block_docs=32, block_grams=2000)
    assert got(jj.join(spark.createDataFrame(rows, "doc_id long, text string"), config)) == brute(rows)


def test_keep_one(spark, edge):
    rows = near_copies(30, 120, 3) + [(0, near_copies(30, 120, 3)[0][1]), (900, None), (900, None), (901, "!!"), (902, "only one here")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], edge.schema)
    kept = sorted(r.doc_id for r in jj.keep_one(docs).collect())
    classes = {c for _, c, _ in brute(rows)}
    assert set(kept) == classes and kept.count(900) == 2 and kept.count(0) == 1
    assert jj.keep_one(docs).columns == docs.columns


def test_runs_reach_the_recall():
    assert 6 <= jj.JoinConfig().runs <= 14


def test_hashes_of_words_take_bounded_memory():
    few = jj.grams("one two three four five six")
    many = jj.grams(" ".join(f"word{i}" for i in range(60_000)))
    assert len(jj._IDS) <= 30_000 and len(many) == 60_000 - 4
    assert (jj.grams("one two three four five six") == few).all()

"""Trained operators: held-out accuracy, and their defined results on edge rows."""

import random

import numpy as np

from lexweave.llm import langid, lm_score, toxicity
from tests.llm.conftest import EDGE, SF


def test_language_id_held_out(spark, corpus, edge, empty, clash):
    rows = langid.op1(spark.createDataFrame(corpus, edge.schema)).collect()
    lang = {r[0]: r[2] for r in corpus}
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.02 * len(rows)
    assert langid.op1(empty).collect() == []
    got = [r for r in langid.op1(clash(edge)).collect()]
    assert len(got) == len(EDGE)
    assert all(r.lang_pred == "und" and r.rejected for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "de", "fr", "es") for r in got if r.doc_id in (4, 5, 6, 7, 8))


def test_language_id_without_labels(spark, edge):
    from pyspark.sql import functions as F

    got = langid.op1(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}


def test_blocks_make_no_difference(monkeypatch):
    texts = ["the cat sat on the mat and then " * 20, "a", "ab1c", "x 12 3 yz!", "é" * 99 + "12345 " * 50 + "ö", "12 3!! ,", "", "no  end"]
    one = [np.concatenate([*langid.feature_blocks(t, 1 << 15), np.zeros(0, np.uint32)]) for t in texts]
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "_BLOCK", size)
        for t, a in zip(texts, one, strict=True):
            assert sorted(np.concatenate([*langid.feature_blocks(t, 1 << 15), np.zeros(0, np.uint32)])) == sorted(a)
    assert not len(one[5]) and not len(one[6]) and len(one[1]) == 2 + 1


def test_lm_of_the_table_beats_counts_and_knows_order(spark, corpus, edge):
    """The shipped configuration, over the whole small table."""
    docs = spark.createDataFrame(corpus, edge.schema)
    model = lm_score.fit(docs)
    rng = np.random.default_rng(1)
    texts = [t for t in (lm_score.tokens(r[1], model.config) for r in corpus) if len(t)]
    n, e = sum(map(len, texts)), model.emissions
    per_token = lambda ts: sum(s for _, _, s in model.scores(ts, own=False)) / n
    counts = sum(np.log((e.count[t] + e.extra) / e.mass).sum() for t in texts) / n
    ordered, shuffled = per_token(texts), per_token([rng.permutation(t) for t in texts])
    assert ordered > counts + 0.3 and ordered > shuffled + 0.02
    # one distribution over all buckets, whatever the neighbours
    row, place = lm_score.lay(texts[:1], model.config)
    _, p = model.network.gate(lm_score.neighbours(row, place[:5], model.config))
    share = ((e.count + e.extra) / e.mass).reshape(-1, lm_score._END + 1).sum(axis=0)
    assert np.allclose((p @ (e.lift * share[:, None]).T).sum(axis=1), 1, atol=1e-3)


def test_lm_scores_by_a_loop_and_any_partitions(spark, corpus, edge):
    rows = sorted(corpus)[:300]
    config = lm_score.LmConfig(shard_tokens=20_000, warm_tokens=10_000)  # several shards
    docs = spark.createDataFrame(rows, edge.schema)
    got = [{r.doc_id: r for r in lm_score.op5(docs.repartition(n), config).collect()} for n in (1, 8, 32)]
    for other in got[1:]:
        assert all(other[k].n_new == r.n_new and np.isclose(other[k].pll, r.pll, rtol=1e-4) for k, r in got[0].items())
    model = lm_score.fit(docs, config)
    e, net = model.emissions, model.network
    for r in rows[:20]:
        t = lm_score.tokens(r[1], config).astype(int)
        own = np.bincount(t, minlength=len(e.count))
        total, new = 0.0, 0
        for i in range(len(t)):
            near = [int(t[k]) & 0xFFFF if 0 <= k < len(t) else 0xFFFF for k in (i - 2, i - 1, i + 1, i + 2)]
            z = np.concatenate([net.emb[k] for k in near]) @ net.inner + net.bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            left = e.count[t[i]] - own[t[i]]
            new += left == 0
            total += np.log(p @ e.lift[t[i] & 0xFFFF]) + np.log((left + e.extra) / (e.mass - len(t)))
        assert np.isclose(total, got[0][r[0]].pll, rtol=1e-3) and new == got[0][r[0]].n_new


def test_lm_tells_what_the_corpus_holds_twice(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    common = [name() for _ in range(50)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.8 else name() for _ in range(100))
    once, twice = [text() for _ in range(60)], [text() for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(once + twice + twice)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.op5(docs).collect()}
    assert min(got[i].pll_per_token for i in range(60, 80)) > max(got[i].pll_per_token for i in range(60))
    assert all(got[i].n_new == 0 for i in range(60, 80)) and all(got[i].n_new > 5 for i in range(60))


def test_lm_edge_rows(spark, edge, empty, clash):
    got = lm_score.op5(clash(edge)).collect()
    assert len(got) == len(EDGE) and lm_score.op5(empty).collect() == []
    for r in got:
        assert (r.n_tokens == 0) == (r.pll_per_token is None) and r.pll <= 0
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    long = spark.createDataFrame([(1, "a b c d " * 60_000), (2, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lm_score.op5(long).collect()) == [2, 2, 240_000]


def toxic_tables(spark, sf):
    folder = SF.replace("sf0.01", sf)
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


def test_toxicity_held_out(spark):
    for sf, precision, recall in (("sf0.001", 0.95, 0.4), ("sf0.01", 0.95, 0.78), ("sf0.1", 0.95, 0.85)):  # recall of whole lexicon words
        docs, labels = toxic_tables(spark, sf)
        rows = toxicity.op10(docs, labels).join(labels, "doc_id").filter("held_out").collect()
        hit = sum(r.predicted and r.toxic for r in rows)
        assert hit / max(1, sum(r.predicted for r in rows)) >= precision and hit / sum(r.toxic for r in rows) >= recall - 0.005, sf
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_edge_rows(spark, edge, empty, clash):
    docs, labels = toxic_tables(spark, "sf0.01")
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in toxicity.op10(clash(edge), none).collect()} == {0.0}
    assert toxicity.op10(empty, labels).collect() == []
    assert len(toxicity.op10(clash(edge), labels).collect()) == len(EDGE)
    model = toxicity.fit(docs, labels)
    assert model.score(None) == model.score("") == model.score("12 !") < 0.1
    again = toxicity.fit(docs.repartition(7), labels.unionByName(labels))
    assert again.lexicon.terms == model.lexicon.terms and np.allclose(again.weight, model.weight)
    long = "plain words " * 300_000
    assert model.score(long) < 0.1


def test_toxicity_by_loops(spark):
    """Lexicon counts and scores recomputed without the operator's code."""
    import re
    import zlib
    from collections import Counter

    docs, labels = toxic_tables(spark, "sf0.01")
    model = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted({(text[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}, key=repr)
    n = Counter(y for _, y in rows)
    for term in model.lexicon.terms:
        hits = lambda t: sum(w.startswith(term[:-1]) and len(w) >= len(term) if term.endswith("*") else w == term for w in re.findall(r"\w+", t.lower()))  # noqa: E731, B023
        times = [sum(min(2, hits(t or "")) for t, y in rows if y == k) for k in (0, 1)]
        assert times[1] / n[1] > 4 * times[0] / n[0] and sum(hits(t or "") > 0 for t, y in rows if y) >= 3
    terms, m = model.lexicon.terms, model.lexicon.voters
    for r in toxicity.op10(docs, labels).collect()[:150]:
        t = text[r.doc_id] or ""
        words = re.findall(r"\w+", t.lower())
        own = lambda w: [k for k, x in enumerate(terms) if (w.startswith(x[:-1]) and len(w) >= len(x) if x.endswith("*") else w == x)]
        found = [own(w) for w in words]
        h, present = sum(bool(x) for x in found), {k for x in found for k in x if k < m}
        rate = h / max(1, len(words))
        letters = [c for c in t if c.isalpha()]
        z = model.bias + sum(model.weight[k] for k in present)
        shape = (sum(c.isupper() for c in t) > 0.6 * max(1, len(letters)) and len(letters) > 20, t.count("!!") >= 3, h == 1, h >= 2, h >= 3, h >= 5, rate >= 0.005, rate >= 0.01, rate >= 0.02 and h > 1, h == 0)
        z += sum(w for w, x in zip(model.weight[m:], shape, strict=True) if x)
        assert np.isclose(r.score, 1 / (1 + np.exp(-(model.slope * z + model.shift))), atol=1e-4)


def test_very_long_words_are_terms_too():
    config = toxicity.ToxicityConfig()
    long = "x" * 3_000_000
    held = toxicity.count_terms([(f"{long} a", 1), (long, 0), (long + "y", 0)], config)
    assert max(map(len, held)) < 80 and sorted(v[:2] for k, v in held.items() if k[0] == "#") == [[1, 0], [1, 1]]


def test_copies_make_no_voters():
    config = toxicity.ToxicityConfig()
    rows = [(f"some clean text number{i} of plain words", 0) for i in range(200)] + [(f"copied paragraph by somebody unusual x{i}", 1) for i in range(30)]
    rows += [(f"w{i} a{i} scumbag b{i} c{i}", 1) for i in range(30)]
    held = toxicity.count_terms(rows, config)
    import pandas as pd

    c = pd.DataFrame(list(held.values()), index=list(held), columns=["clean", "toxic", "docs", "near"])
    c["near"] = [int(x).bit_count() for x in c["near"]]
    g = toxicity.strength(c, (200, 60), config)
    assert g["scumbag"] >= toxicity.level(len(c), (200, 60), config) and g["paragraph"] == g["copied"] == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    acc = [0.95, 0.9, 0.8, 0.6]
    v = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in acc], axis=1).astype(np.int8)
    v = np.concatenate([v, v[:, 3:], v[:, 3:]], axis=1)  # the weakest voter votes three times
    q, accuracy, weight = toxicity.label_model(v, 0.2, toxicity.ToxicityConfig())
    assert np.mean((q > 0.5) == y) > 0.93 and weight[3] < 0.6 < weight[0]
    assert accuracy[0] > accuracy[2] > 0.7

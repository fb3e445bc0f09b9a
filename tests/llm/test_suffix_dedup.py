"""Repeated strings against a count of every window."""

import hashlib
import random

import numpy as np

from lexweave.llm import suffix_dedup as sd
from tests.llm.conftest import EDGE


def brute(rows, width=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raws:
        for i in range(len(r) - width + 1):
            k = hash(r[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, dtype=np.int64)
        for i in range(len(r) - width + 1):
            if seen[hash(r[i : i + width])] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, rows = [text(k) for k in (30, 45, 60, 90)], []
    for i in range(120):
        t = text(rng.randrange(5, 200))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            t += " " + s[rng.randrange(0, 20) :] + " " + text(4)
        rows.append((i, t))
    rows += [(200 + i, rows[3][1][: 150 + 20 * i]) for i in range(10)]
    rows += [(300, "ab" * 400), (301, "a" * 1000), (302, "a" * 199), (303, "x" + "a" * 200), (304, None), (305, ""), (3, rows[3][1])]
    return rows


def test_planted(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    assert got(sd.op3(docs)) == brute(planted())


def test_crowded_anchors_and_shuffled_joins(spark):
    docs = spark.createDataFrame(planted(6), "doc_id long, text string")
    for slabs in (10, 1):
        config = sd.RepeatConfig(anchor_slabs=slabs, broadcast_bytes=0, batch_windows=300)
        assert got(sd.without_repeats(docs, config).drop("kept")) == brute(planted(6))


def test_suffix_order_and_family():
    rng = np.random.default_rng(2)
    for width in (3, 8, 20, 200):
        data = rng.integers(97, 99, 900).astype(np.uint8)
        data[500:800] = data[100:400]
        starts = np.arange(0, 900 - width + 1, 1 + width % 3)
        order, again = sd.suffix_order(data, starts, width)
        own = [data[s : s + width].tobytes() for s in starts[order]]
        assert own == sorted(own) and again.tolist() == [False] + [a == b for a, b in zip(own, own[1:], strict=False)]
    family = sd.Family(20)
    parts = [rng.integers(97, 100, int(n)).astype(np.uint8).tobytes() for n in rng.integers(20, 120, 300)]
    parts += [p[: len(p) // 2 + 20] + b"!" for p in parts[::3]]
    for lo in range(0, len(parts), 7):
        family.add(parts[lo : lo + 7])
    every = [p[i : i + 20] for p in parts for i in range(len(p) - 19)]
    seen = {}
    for w in every:
        seen[w] = seen.get(w, 0) + 1
    assert family.marks().tolist() == [seen[w] > 1 for w in every]
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_edge_rows(edge, empty, clash):
    assert got(sd.op3(clash(edge))) == brute([(r[0], r[1]) for r in EDGE])
    assert sd.op3(empty).collect() == []


def test_whole_table(spark, corpus, edge):
    docs = spark.createDataFrame(corpus, edge.schema)
    assert got(sd.op3(docs)) == brute([(r[0], r[1]) for r in corpus])


def test_chunks_do_not_change_slab_windows(monkeypatch):
    rng = np.random.default_rng(1)
    b = rng.integers(97, 105, 5000).astype(np.uint8)
    config = sd.RepeatConfig()
    lo, hi, anchor, _ = sd.slabs(b, config)
    assert lo[0] == 0 and hi[-1] == len(b) - config.width and (lo[1:] == hi[:-1] + 1).all()
    assert ((anchor >= hi) & (anchor <= lo + config.width - config.gram)).all()
    monkeypatch.setattr(sd, "_CHUNK", 700)
    lo2, hi2, anchor2, _ = sd.slabs(b, config)
    wide = lambda a, z, c: np.repeat(c, z - a + 1)
    assert (wide(lo, hi, anchor) == wide(lo2, hi2, anchor2)).all()

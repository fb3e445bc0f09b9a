"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

A token is a lower-cased word, hashed into `fine` buckets; its low 16 bits are its coarse bucket. The
network sees the coarse buckets of the `window` tokens on either side: embeddings, one matrix for each
position, and a softmax over `states` hidden states. Each state emits coarse buckets with probabilities
of its own, so the mixture over the states is a distribution over all buckets without a sum over them;
inside a coarse bucket a token has its share of the corpus counts. Counts leave out the document that is
scored, so a word that stands in no other document scores as new, and a document that the corpus holds
twice scores above one it holds once. A document's score is the sum of the conditional log-probabilities
of all its tokens.

Training, by expectation maximisation with gradient steps for the network: a warm start on a bounded
sample of blocks (`warm_tokens`) gives the first weights; then one pass takes every token of every
document. For it, documents are dealt by hash into shards of some `shard_tokens` tokens, and the order
in a shard is by hash, so the weights don't depend on how the input is partitioned. Each shard starts from
the warm weights; embeddings are averaged by visits, matrices by tokens, and the expected counts of the
states, which become their emissions, are summed. Sums are made in each task before they are shuffled.

Defined results: null or wordless text has n_tokens 0, n_new 0, pll 0 and a null pll_per_token; an empty
table gives an empty result; repeated rows are scored each (each sees the others); long texts are trained
and scored in blocks, with their neighbours across the edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize, ship_package, shuffle_partitions

_WORD = re.compile(r"\w+")
_BLOCK = 4096
_SLICE = 1024
_END = 0xFFFF  # coarse bucket beside the ends of a text; no word has it


@dataclass(frozen=True)
class LmConfig:
    fine_bits: int = 22
    states: int = 16
    dim: int = 8
    window: int = 2
    shard_tokens: int = 1 << 22
    warm_tokens: int = 1 << 18
    warm_rounds: int = 4
    batch: int = 4096
    rate: float = 0.3
    prior: float = 2.0
    seed: int = 3


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh32_intdigest(word)
        v = self[word] = h - (h & _END == _END)
        return v


_IDS = _Ids()


def tokens(text: str | None, config: LmConfig) -> np.ndarray:
    """Fine bucket of each word. Coarse buckets are their low 16 bits."""
    ids = _IDS
    return np.array([ids[w] for w in _WORD.findall((text or "").lower())], dtype=np.uint32) & np.uint32((1 << config.fine_bits) - 1)


def _sum_rows(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, the sums of their rows, and their numbers."""
    order = np.argsort(keys, kind="stable")  # a radix sort: keys take two bytes
    held = keys[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    return held[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0), np.diff(np.r_[first, len(held)])


class Network:
    """Window of embeddings, a matrix for each position, softmax over the states."""

    def __init__(self, config: LmConfig):
        rng = np.random.default_rng(config.seed)
        self.emb = rng.normal(0, 0.1, (_END + 1, config.dim)).astype(np.float32)
        self.inner = rng.normal(0, 0.3, (2 * config.window * config.dim, config.states)).astype(np.float32)
        self.bias = np.zeros(config.states, dtype=np.float32)
        self.slow = np.full(_END + 1, 0.01, dtype=np.float32)  # squared steps of each embedding so far
        self.slow_inner = np.full(1 + 2 * config.window * config.dim, 0.01, dtype=np.float32)

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.__dict__ = {k: v.copy() for k, v in self.__dict__.items()}
        return out

    def gate(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings side by side, and the probabilities of the states."""
        x = self.emb.take(near, axis=0).reshape(len(near), -1)
        z = x @ self.inner + self.bias
        np.exp(np.clip(z, -40, 40, out=z), out=z)
        z /= z.sum(axis=1, keepdims=True)
        return x, z

    def step(self, near: np.ndarray, x: np.ndarray, g: np.ndarray, config: LmConfig) -> tuple[np.ndarray, np.ndarray]:
        """Gradient step; g: probabilities of the states less their posterior. Returns the buckets met and how often."""
        back = (g @ self.inner.T).reshape(-1, config.dim)
        grad = np.concatenate([g.sum(axis=0)[None], x.T @ g]) / len(g)
        self.slow_inner += (grad * grad).mean(axis=1) * config.states
        grad *= (config.rate * 0.3 / np.sqrt(self.slow_inner))[:, None]
        self.bias -= grad[0]
        self.inner -= grad[1:]
        met, total, times = _sum_rows(near.ravel(), back)
        self.slow[met] += (total * total).mean(axis=1)
        self.emb[met] -= total * (config.rate * 0.3 / np.sqrt(self.slow[met]))[:, None]
        return met, times


def lay(texts: list[np.ndarray], config: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one row, ends between them; and the places of their tokens."""
    w = config.window
    gap = np.full(w, _END, dtype=np.uint32)
    row = np.concatenate([x for t in texts for x in (gap, t)] + [gap])
    size = np.array([len(t) for t in texts], dtype=np.int64)
    return row, np.arange(size.sum()) + w * (np.repeat(np.arange(len(texts)), size) + 1)


def neighbours(row: np.ndarray, place: np.ndarray, config: LmConfig) -> np.ndarray:
    w = config.window
    return (row[place[:, None] + np.array([i for i in range(-w, w + 1) if i])] & _END).astype(np.uint16)


class Emissions:
    """Counts of the buckets, and of the coarse ones by state."""

    def __init__(self, count: np.ndarray, config: LmConfig):
        self.count = count
        self.total = float(count.sum())
        # what new words get follows from how many were seen once
        self.extra = max(1e-3, float((count == 1).sum()) / len(count))
        self.mass = self.total + self.extra * len(count)
        folded = count.reshape(-1, _END + 1).sum(axis=0, dtype=np.float64)
        self.coarse = ((folded + self.extra * (len(count) >> 16)) / self.mass).astype(np.float64)
        self.lift = np.ones((_END + 1, config.states), dtype=np.float32)

    def set(self, expected: np.ndarray, config: LmConfig) -> None:
        """expected: (coarse buckets, states) counts of any scale; lift is emission over corpus share."""
        held = expected.sum(axis=0, dtype=np.float64)
        prior = config.prior * self.coarse * len(self.coarse)
        made = (expected + prior[:, None]) / (held + prior.sum())
        self.lift = (made / self.coarse[:, None]).astype(np.float32)


@dataclass
class Model:
    config: LmConfig
    network: Network
    emissions: Emissions

    def score(self, text: str | None) -> tuple[int, int, float]:
        return self.scores([tokens(text, self.config)])[0]

    def scores(self, texts: list[np.ndarray], own: bool = True) -> list[tuple[int, int, float]]:
        """Tokens, those in no other document, and score of each text. own: the counts hold the text itself."""
        row, place = lay(texts, self.config)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        which = np.repeat(np.arange(len(texts)), size)
        e, mine = self.emissions, np.zeros(len(place))
        if own and len(place):
            at = 0
            for t in texts:
                if len(t):
                    _, back, n = np.unique(t, return_inverse=True, return_counts=True)
                    mine[at : at + len(t)] = n[back]
                    at += len(t)
        total, new = np.zeros(len(texts)), np.zeros(len(texts))
        for lo in range(0, len(place), _BLOCK):
            at, k, doc = place[lo : lo + _BLOCK], mine[lo : lo + _BLOCK], which[lo : lo + _BLOCK]
            f = row[at]
            _, p = self.network.gate(neighbours(row, at, self.config))
            mix = np.einsum("nk,nk->n", p, e.lift.take(f & _END, axis=0))
            left = np.maximum(e.count[f] - k, 0)
            got = np.log(mix) + np.log((left + e.extra) / (e.mass - own * size[doc]))
            total += np.bincount(doc, weights=got, minlength=len(texts))
            new += np.bincount(doc, weights=left == 0, minlength=len(texts))
        return list(zip(size.tolist(), new.astype(int).tolist(), total.tolist(), strict=True))


def learn(network: Network, emissions: Emissions, row: np.ndarray, place: np.ndarray, expected: np.ndarray, visits: np.ndarray, config: LmConfig) -> None:
    """One pass over the places: steps of the network, expected counts and visits are added up."""
    for lo in range(0, len(place), config.batch):
        at = place[lo : lo + config.batch]
        near, c = neighbours(row, at, config), (row[at] & _END).astype(np.uint16)
        x, p = network.gate(near)
        r = p * emissions.lift.take(c, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        met, total, _ = _sum_rows(c, r)
        expected[met] += total
        met, times = network.step(near, x, p - r, config)
        visits[met] += times


def warm_start(blocks: list[np.ndarray], emissions: Emissions, config: LmConfig) -> Network:
    """First weights and emissions from blocks of tokens: clusters of blocks give the first states."""
    network, rng = Network(config), np.random.default_rng(config.seed)
    if not blocks:
        return network
    bags = [np.unique(b & _END, return_counts=True) for b in blocks]
    post = rng.dirichlet(np.full(config.states, 0.1), len(blocks))
    for _ in range(8):  # mixture of bags
        expected = np.zeros((_END + 1, config.states), dtype=np.float32)
        for (c, n), q in zip(bags, post, strict=True):
            expected[c] += n[:, None] * q.astype(np.float32)
        emissions.set(expected, config)
        for i, (c, n) in enumerate(bags):
            z = n @ np.log(emissions.lift[c]) / np.sqrt(n.sum())
            z = np.exp(z - z.max())
            post[i] = z / z.sum()
    order = rng.permutation(len(blocks))
    for _ in range(config.warm_rounds):
        expected = np.zeros((_END + 1, config.states), dtype=np.float32)
        visits = np.zeros(_END + 1, dtype=np.int64)
        for lo in range(0, len(order), 64):
            row, place = lay([blocks[i] for i in order[lo : lo + 64]], config)
            learn(network, emissions, row, rng.permutation(place), expected, visits, config)
        emissions.set(expected, config)
    return network


def cut(docs: DataFrame, config: LmConfig) -> DataFrame:
    """doc_id, h, t: the buckets of each text, four bytes each, and a hash of row and text; in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "t": [tokens(x, config).tobytes() for x in b["text"]]})

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return materialize(keyed.mapInPandas(run, f"doc_id {kind}, h long, t binary"), "buckets")


def _read(t: bytes) -> np.ndarray:
    return np.frombuffer(t, dtype=np.uint32)


def _sum_slices(parts: DataFrame, dtype: type) -> dict[int, np.ndarray]:
    """Sums the arrays v of equal k; parts(k int, v binary) are sums of tasks, as many k as slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b["k"], b["v"], strict=True):
                x = np.frombuffer(v, dtype=dtype)
                held[k] = held[k] + x if k in held else x
        yield pd.DataFrame({"k": list(held), "v": [x.tobytes() for x in held.values()]}).astype({"k": "int32"})

    got = parts.repartition(shuffle_partitions(parts.sparkSession), "k").mapInPandas(run, "k int, v binary").collect()  # one set of slices
    return {r.k: np.frombuffer(r.v, dtype=dtype) for r in got}


def count_tokens(held: DataFrame, config: LmConfig) -> np.ndarray:
    """Occurrences of each fine bucket over all documents."""
    size = 1 << config.fine_bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size, dtype=np.int64)
        for b in batches:
            for lo in range(0, len(b), 4096):
                n += np.bincount(_read(b"".join(b["t"][lo : lo + 4096])), minlength=size)
        slices = n.reshape(-1, 1 << 14)
        has = np.flatnonzero(slices.any(axis=1))
        for lo in range(0, len(has), 32):
            yield pd.DataFrame({"k": has[lo : lo + 32].astype(np.int32), "v": [slices[k].tobytes() for k in has[lo : lo + 32]]})

    out = np.zeros((size >> 14, 1 << 14), dtype=np.int64)
    for k, v in _sum_slices(held.select("t").mapInPandas(run, "k int, v binary"), np.int64).items():
        out[k] = v
    return out.ravel()


def _warm_blocks(held: DataFrame, total: float, config: LmConfig) -> list[np.ndarray]:
    """Blocks of whole documents chosen by hash, some warm_tokens tokens."""
    share = min(1.0, config.warm_tokens / max(total, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, t in zip(b["h"], b["t"], strict=True):
                for lo in range(0, len(t) // 4, _SLICE):
                    key = xxhash.xxh64_intdigest(f"{h}:{lo}")
                    if key < share * 2**64:
                        out.append((key >> 1, t[4 * lo : 4 * (lo + _SLICE)]))
            yield pd.DataFrame(out, columns=["key", "t"])

    rows = held.select("h", "t").mapInPandas(run, "key long, t binary").collect()  # some warm_tokens tokens
    return [_read(r.t) for r in sorted(rows, key=lambda r: (r.key, r.t))]


def train(held: DataFrame, network: Network, emissions: Emissions, config: LmConfig) -> None:
    """One pass over all tokens, from the weights given; they are replaced by the averages over the shards."""
    shards = max(1, round(emissions.total / config.shard_tokens))
    shared = held.sparkSession.sparkContext.broadcast((network, emissions.lift))
    d, k = config.dim, config.states

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, lift = shared.value
        task = Emissions.__new__(Emissions)
        task.lift = lift
        sums = np.zeros((_END + 1, k + d + 1), dtype=np.float64)
        dense, current, own, visits, pending, size = None, None, None, None, [], 0
        expected = np.zeros((_END + 1, k), dtype=np.float32)

        def flush() -> None:
            nonlocal pending, size
            if pending:
                row, place = lay(pending, config)
                order = np.random.default_rng(len(place)).permutation(place)
                learn(own, task, row, order, expected, visits, config)
            pending, size = [], 0

        def close() -> None:
            nonlocal dense
            flush()
            n = float(expected.sum())
            if own is not None and n:
                sums[:, :k] += expected
                sums[:, k : k + d] += own.emb * visits[:, None]
                sums[:, -1] += visits
                flat = n * np.concatenate([own.inner.ravel(), own.bias, [1.0]])
                dense = flat if dense is None else dense + flat

        for b in batches:
            for shard, t in zip(b["shard"], b["t"], strict=True):
                if shard != current:
                    close()
                    current, own, visits = shard, net.copy(), np.zeros(_END + 1, dtype=np.int64)
                    expected[:] = 0
                x = _read(t)
                for lo in range(0, len(x), _BLOCK * 16):  # the blocks of a long text see no neighbours across edges here
                    pending.append(x[lo : lo + _BLOCK * 16])
                    size += len(pending[-1])
                    if size >= _BLOCK * 16:
                        flush()
        close()
        if dense is not None:
            yield pd.DataFrame({"k": np.array([-1], dtype=np.int32), "v": [dense.tobytes()]})
            for s in range(0, _END + 1, _SLICE):
                if sums[s : s + _SLICE].any():
                    yield pd.DataFrame({"k": np.array([s], dtype=np.int32), "v": [sums[s : s + _SLICE].tobytes()]})

    dealt = held.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "t").filter(F.octet_length("t") > 0)
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "t")
    got = _sum_slices(ordered.mapInPandas(run, "k int, v binary"), np.float64)
    if -1 not in got:
        return
    sums = np.zeros((_END + 1, k + d + 1))
    for s, v in got.items():
        if s >= 0:
            sums[s : s + _SLICE] = v.reshape(-1, k + d + 1)
    emissions.set(sums[:, :k], config)
    seen = sums[:, -1] > 0
    network.emb[seen] = (sums[seen, k : k + d] / sums[seen, -1:]).astype(np.float32)
    flat = got[-1][:-1] / got[-1][-1]
    network.inner[:] = flat[: network.inner.size].reshape(network.inner.shape)
    network.bias[:] = flat[network.inner.size :]


def _fit(held: DataFrame, config: LmConfig) -> Model:
    emissions = Emissions(count_tokens(held, config), config)
    network = warm_start(_warm_blocks(held, emissions.total, config), emissions, config)
    train(held, network, emissions, config)
    return Model(config, network, emissions)


def fit(docs: DataFrame, config: LmConfig = LmConfig()) -> Model:
    ship_package(docs.sparkSession)
    return _fit(cut(docs, config), config)


def _score(held: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_new, pll, pll_per_token for each row of held."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [x for lo in range(0, len(b), 256) for x in m.scores([_read(t) for t in b["t"][lo : lo + 256]])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [n for n, _, _ in got], "n_new": [u for _, u, _ in got], "pll": [s for _, _, s in got], "pll_per_token": pd.array([s / n if n else None for n, _, s in got], dtype="Float64")})

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.select("doc_id", "t").mapInPandas(run, f"doc_id {kind}, n_tokens long, n_new long, pll double, pll_per_token double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_new, pll, pll_per_token for each row of docs, which the model has learnt from."""
    return _score(cut(docs, model.config), model)


def op5(docs: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    ship_package(docs.sparkSession)
    held = cut(docs, config)
    return _score(held, _fit(held, config))

"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Terms are words and word beginnings of `stems` letters. Those that toxic training rows hold far more often
than clean ones make the lexicon: a likelihood ratio test over all learnable rows and whole texts, with a
level that follows the number of terms tested, so that chance makes none. Exact copies of a text count
once, occurrences in a text count twice at most, and a term must stand between different neighbours, so
that near copies of one toxic text don't make all its words voters.

Voters: one for each of the `voters` strongest terms, which votes toxic where it stands, and patterns over
all lexicon terms, of which some can vote clean: none, sparse, several, dense; and shouting, exclaiming.
Each votes toxic, clean or abstains. The label model sees the votes alone: it estimates by expectation
maximisation how each voter votes given the hidden label, hence its accuracy, and from the residual
correlations under the posterior how far voters repeat each other; such voters share their weight, and voters
no better than chance lose theirs. Its posterior labels train a logistic classifier on terms and patterns by
stochastic gradient descent. The given labels serve to mine the lexicon, to tell which of the two hidden
classes is the toxic one, and to calibrate the slope and shift of the final score.

The label model and the classifier are fitted on a bounded sample: `train_rows` labelled rows, half of each
class if there are more, weighted by what they stand for. Mining and scoring take everything. Defined
results: null, empty or wordless texts score as a text without any lexicon term; without toxic and
clean labelled rows, or without a lexicon, every score is the share of toxic rows (0 without rows); repeated
rows are scored each; of a doc_id with several labels each counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.langid import learnable
from lexweave.session import materialize, ship_package

_WORD = re.compile(r"\w+")
#: Words of more letters are told apart by a hash.
_LONG = 64


@dataclass(frozen=True)
class ToxicityConfig:
    train_rows: int = 4000
    voters: int = 200
    stems: tuple[int, ...] = (4, 5, 6, 7)
    min_lift: float = 4.0
    min_docs: int = 3
    margin: float = 8.0
    rounds: int = 25
    epochs: int = 30
    threshold: float = 0.7
    broadcast_rows: int = 1_000_000
    held_terms: int = 30_000
    seed: int = 5


PATTERNS = ("shouting", "exclaims", "one", "two", "three", "five", "half", "percent", "dense", "none")


@dataclass
class Lexicon:
    """Terms with their strength; the first `voters` of them vote alone. A stem ends in an asterisk."""

    terms: list[str]
    config: ToxicityConfig = field(default_factory=ToxicityConfig)

    def __post_init__(self) -> None:
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.voters = min(len(self.terms), self.config.voters)
        self._seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def of(self, word: str) -> tuple[int, ...]:
        """Numbers of the terms that the word is."""
        if len(word) > _LONG:
            return tuple(self.at[t] for t in terms_of(word, self.config) if t in self.at)
        got = self._seen.get(word)
        if got is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            got = self._seen[word] = tuple(self.at[t] for t in terms_of(word, self.config) if t in self.at)
        return got

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Presence of each voting term, then the PATTERNS."""
        m = self.voters
        x = np.zeros((len(texts), m + len(PATTERNS)), dtype=np.float32)
        for row, text in zip(x, texts, strict=True):
            text = text or ""
            words = _WORD.findall(text.lower())
            hits = [got for w in words if (got := self.of(w))]
            row[[k for got in hits for k in got if k < m]] = 1
            n, rate = len(hits), len(hits) / max(1, len(words))
            upper = sum(map(str.isupper, text))
            letters = max(1, sum(map(str.isalpha, text)))
            row[m:] = (upper > 0.6 * letters and letters > 20, text.count("!!") >= 3, n == 1, n >= 2, n >= 3, n >= 5, rate >= 0.005, rate >= 0.01, rate >= 0.02 and n > 1, n == 0)
        return x


def terms_of(word: str, config: ToxicityConfig) -> tuple[str, ...]:
    """The word, and its beginnings."""
    return _terms(word, config.stems) if len(word) <= _LONG else _terms.__wrapped__(word, config.stems)


@lru_cache(maxsize=200_000)
def _terms(word: str, stems: tuple[int, ...]) -> tuple[str, ...]:
    whole = word if len(word) <= _LONG else "#" + xxhash.xxh64_hexdigest(word.encode("utf-8", "surrogatepass"))
    return (whole, *(word[:k] + "*" for k in stems if len(word) > k and word[:k].isalpha()))


def votes(x: np.ndarray, m: int) -> np.ndarray:
    """+1 toxic, -1 clean, 0 abstains. Terms and patterns vote toxic where present; `none` votes clean; a text with
    few of its words in the lexicon is voted clean by the patterns of number and density."""
    v = (x > 0).astype(np.int8)
    one, two, three, five, half, percent, dense, none = (m + PATTERNS.index(p) for p in PATTERNS[2:])
    v[:, one] = 0
    v[:, none] *= -1
    v[:, three] -= x[:, two] == 0
    v[:, percent] -= x[:, half] == 0
    v[:, dense] -= x[:, percent] == 0
    return v


@dataclass
class Toxicity:
    lexicon: Lexicon
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: float = 0.0

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(texts), self.share)
        z = self.lexicon.features(texts) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def label_model(v: np.ndarray, prior: float, config: ToxicityConfig, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the positive class, accuracy of each voter, and its weight after correlations.

    rows: how many rows each row stands for. It starts from the majority in a vote in
    which correlated voters share."""
    s = np.ones(len(v)) if rows is None else rows / rows.mean()
    n = s.sum()
    mid = (s[:, None] * v).sum(axis=0) / n
    raw = (v - mid) / (v.std(axis=0) + 1e-9)
    weight = 1 / np.maximum(1, (((raw * s[:, None]).T @ raw / n) ** 2).sum(axis=0))
    q = np.where(v @ weight > 0, 0.9, 0.1)
    kinds = [(v == k).astype(float) for k in (-1, 0, 1)]
    for _ in range(config.rounds):
        tox = np.stack([(k * (s * q)[:, None]).sum(axis=0) for k in kinds]) + 0.5
        cln = np.stack([(k * (s * (1 - q))[:, None]).sum(axis=0) for k in kinds]) + 0.5
        p, r = tox / tox.sum(axis=0), cln / cln.sum(axis=0)
        accuracy = (p[2] * prior + r[0] * (1 - prior)) / np.maximum(1e-9, (p[2] + p[0]) * prior + (r[0] + r[2]) * (1 - prior))
        # what guessing would reach: the commoner class among the rows the voter votes on
        chance = np.maximum(p[2] + p[0], 1e-9) * prior / np.maximum(1e-9, (p[2] + p[0]) * prior + (r[0] + r[2]) * (1 - prior))
        useful = accuracy >= np.where(p[2] >= p[0], np.minimum(chance, 1 - chance), 0)
        logit = np.log(prior / (1 - prior)) + sum(k @ (weight * useful * (np.log(a) - np.log(b))) for k, a, b in zip(kinds, p, r, strict=True))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        mean = q[:, None] * (p[2] - p[0]) + (1 - q[:, None]) * (r[2] - r[0])
        left = v - mean  # what the label does not explain
        left /= np.sqrt((s[:, None] * left**2).sum(axis=0) / n) + 1e-9
        both = np.abs((left * s[:, None]).T @ left / n).clip(0, 1)
        weight = 1 / np.maximum(1, np.where(both > 0.4, both, 0).sum(axis=0))
    return q, accuracy, weight


def train(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> Toxicity:
    """x: features of the sample, y: their given labels, rows: how many rows each stands for."""
    config = lexicon.config
    s = np.ones(len(y)) if rows is None else rows / rows.mean()
    share = float((s * y).sum() / s.sum()) if len(y) else 0.0
    if not lexicon.terms or not 0 < share < 1:
        return Toxicity(lexicon, np.zeros(0), 0.0, share=share if 0 < share < 1 else 0.0)
    v = votes(x, lexicon.voters)
    q, accuracy, _ = label_model(v, share, config, s)
    if (s * q * (y - share)).sum() < 0:  # the hidden classes have no names of their own
        q, accuracy = 1 - q, 1 - accuracy
    rng = np.random.default_rng(config.seed)
    w, b = np.zeros(x.shape[1]), 0.0
    for e in range(config.epochs):
        for k in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            g = s[k] * (1 / (1 + np.exp(-np.clip(x[k] @ w + b, -30, 30))) - q[k])
            rate = 0.5 / (1 + 0.2 * e)
            w -= rate * (x[k].T @ g / len(k) + 1e-4 * w)
            b -= rate * g.mean()
    model = Toxicity(lexicon, w, b, accuracy=accuracy, share=share)
    z = x @ w + b
    slope, shift = 1.0, 0.0
    for _ in range(2000):  # calibration of one slope and shift on the given labels
        g = s * (1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))) - y)
        slope = max(0.2, slope - 0.05 * (g * z).mean())
        shift -= 0.05 * g.mean()
    model.slope, model.shift = slope, shift
    return model


def _bit(before: str, after: str) -> int:
    return 1 << (xxhash.xxh32_intdigest(f"{before} {after}") & 63)


def add_terms(held: dict[str, list[int]], text: str | None, y: int, config: ToxicityConfig) -> None:
    """Adds a text to held: for each term, times in clean and in toxic texts (two a text at most), toxic texts, and a
    map of neighbours there."""
    words = _WORD.findall((text or "").lower())
    own: Counter[str] = Counter()
    for w, n in Counter(words).items():
        for t in terms_of(w, config):
            own[t] += n
    for t, n in own.items():
        x = held.setdefault(t, [0, 0, 0, 0])
        x[y] += min(n, 2)
        x[2] += y
    if y:
        for a, w, b in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
            bit = _bit(a, b)
            for t in terms_of(w, config):
                held[t][3] |= bit


def count_terms(rows: Iterator[tuple[str | None, int]], config: ToxicityConfig) -> dict[str, list[int]]:
    """add_terms() of all rows."""
    held: dict[str, list[int]] = {}
    for text, y in rows:
        add_terms(held, text, y, config)
    return held


def strength(counts: pd.DataFrame, rows: tuple[int, int], config: ToxicityConfig) -> pd.Series:
    """Likelihood ratio of each term(clean, toxic, docs, near), 0 for those that are no sign of toxicity.

    near: different neighbours in toxic texts, which bound how many times the term can count."""
    n0, n1 = rows
    x0 = counts["clean"].astype(float)
    x1 = np.minimum(counts["toxic"], 2.0 * counts["near"]).astype(float)
    total = np.maximum(x0 + x1, 1e-9)
    want1, want0 = total * n1 / (n0 + n1), total * n0 / (n0 + n1)
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / b), 0.0)
    g = 2 * (log(x1, want1) + log(x0, want0))
    fit = (np.minimum(counts["docs"], counts["near"]) >= config.min_docs) & (x1 / n1 >= config.min_lift * (x0 + 0.5) / n0)
    return pd.Series(np.where(fit, g, 0.0), index=counts.index)


def level(terms: int, rows: tuple[int, int], config: ToxicityConfig) -> float:
    """What a term must reach: chance among so many terms, or half of the toxic rows and no clean one if there are few."""
    n0, n1 = rows
    few = 2 * max(config.min_docs, n1 / 2) * np.log((n0 + n1) / n1)
    return float(min(2 * np.log(max(terms, 2)) + config.margin, few))


def distinct_terms(kept: pd.DataFrame) -> list[str]:
    """Terms of kept(term, clean, toxic, g), strongest first, without those that stand for nearly the same
    occurrences as a stronger one: the stem of a word, or a longer stem."""
    out: list[str] = []
    near: dict[str, list[tuple[str, float, float]]] = {}
    for term, clean, toxic in kept.sort_values(["g", "term"], ascending=[False, True], kind="stable")[["term", "clean", "toxic"]].itertuples(index=False):
        stem = term.rstrip("*")
        for other, c, t in near.get(stem[:4], []):
            if (stem.startswith(other) or other.startswith(stem)) and abs(t - toxic) <= 0.1 * t and abs(c - clean) <= 0.1 * c + 1:
                break
        else:
            out.append(term)
            near.setdefault(stem[:4], []).append((stem, clean, toxic))
    return out


def labelled(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """doc_id, text, y of the learnable labelled rows, one of each different text and label."""
    known = learnable(labels.select("doc_id", "toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_d"), F.least(F.greatest(F.col("toxic").cast("int"), F.lit(0)), F.lit(1)).alias("y")).distinct()
    known = materialize(known, "labelled-ids")
    small = lambda d: F.broadcast(d) if d.count() <= config.broadcast_rows else d  # noqa: E731  16 bytes a row
    met = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")).join(small(known), F.col("doc_id") == F.col("_d"))
    one = materialize(met.groupBy("k1", "k2", "y").agg(F.min("doc_id").alias("_d")).select("k1", "k2", "y", "_d"), "labelled-texts")
    keyed = docs.select("doc_id", "text").join(small(one), F.col("doc_id") == F.col("_d"))
    return keyed.filter((F.xxhash64("text") == F.col("k1")) & (F.xxhash64(F.lit(1), "text") == F.col("k2"))).select("doc_id", "text", "y", "k1")


def mine(rows: DataFrame, config: ToxicityConfig) -> tuple[Lexicon, tuple[int, int]]:
    """Lexicon of rows(text, y), and the numbers of clean and toxic rows."""

    def batch(held: dict[str, list[int]]) -> pa.RecordBatch:
        x = np.array(list(held.values()), dtype=np.uint64).view(np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(x[:, i].copy()) for i in range(4))], names=["term", "clean", "toxic", "docs", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                add_terms(held, text, y, config)
                if len(held) > config.held_terms:
                    yield batch(held)
                    held = {}
        yield batch(held)

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    size = (n.get(0, 0), n.get(1, 0))
    if not all(size):
        return Lexicon([], config), size
    counted = rows.select("text", "y").mapInArrow(run, "term string, clean long, toxic long, docs long, near long")
    counted = materialize(counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"), F.bit_count(F.bit_or("near")).cast("long").alias("near")), "terms")
    least = level(counted.count(), size, config)
    # of the terms tested, those alone that can pass come to the driver: far more often in toxic texts, and often enough
    can = counted.filter((F.col("docs") >= config.min_docs) & (F.col("near") >= config.min_docs) & (F.col("toxic") * size[0] >= config.min_lift * F.col("clean") * size[1])).toPandas()
    can["g"] = strength(can, size, config)
    return Lexicon(distinct_terms(can[can["g"] >= least]), config), size


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Toxicity:
    spark = docs.sparkSession
    ship_package(spark)
    rows = labelled(docs, labels, config)
    lexicon, size = mine(rows, config)
    share = size[1] / max(1, sum(size))
    if not lexicon.terms:
        return Toxicity(lexicon, np.zeros(0), 0.0, share=share if 0 < share < 1 else 0.0)
    part = [min(1.0, config.train_rows / 2 / n) for n in size]
    at = F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(at < F.when(F.col("y") == 1, part[1]).otherwise(part[0]))
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k1"], "doc_id": b["doc_id"], "y": b["y"], "x": list(shared.value.features(list(b["text"])))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("k1", "doc_id", "y", "text").mapInPandas(run, f"k long, doc_id {kind}, y int, x array<float>").toPandas()  # some train_rows rows
    if not len(got):
        return Toxicity(lexicon, np.zeros(0), 0.0, share=share)
    got = got.sort_values(["k", "doc_id", "y"], kind="stable")
    y = got["y"].to_numpy(dtype=float)
    return train(lexicon, np.stack(got["x"].to_list()), y, np.where(y > 0, 1 / part[1], 1 / part[0]))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score for each row of docs."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.asarray(shared.value.scores(list(b["text"])), dtype=np.float64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")


def op10(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, fit(docs, labels, config)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))

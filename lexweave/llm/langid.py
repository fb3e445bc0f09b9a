"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, every run of non-letters becomes one space, and all character
2-, 3- and 4-grams are hashed into `buckets` rows of an embedding matrix. Their average
goes through a linear softmax. Both matrices are trained by stochastic gradient descent
in numpy on a bounded sample (`rows_per_lang` rows of each language, whole texts); a temperature and a rejection threshold are then calibrated on a
held-back fifth of that sample. After training, embedding times output matrix is folded
into one (buckets x languages) table, so a prediction is a gather and a mean over the
whole text.

Defined results: null text or text without a letter -> `und`, score 0, rejected. No
labelled row at all -> every text is `und`, score 0. Very long texts are folded in
fixed-size blocks. Repeated rows are scored independently. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize, ship_package

_BLOCK = 1 << 17
_ALPHA: np.ndarray | None = None


@dataclass(frozen=True)
class LangIdConfig:
    rows_per_lang: int = 300
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 4
    rate: float = 0.5
    reject_rate: float = 0.002
    reject_cap: float = 0.5
    seed: int = 7


@dataclass
class LangIdModel:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    config: LangIdConfig = field(default_factory=LangIdConfig)

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        total, n = np.zeros(len(self.langs)), 0
        for h in feature_blocks(text, self.config.buckets):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        if not n:
            return "und", 0.0
        p = softmax((total / n + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _letters(cp: np.ndarray) -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)
    out = _ALPHA[np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        high = cp > 0xFFFF
        values, at = np.unique(cp[high], return_inverse=True)
        out[high] = np.array([chr(int(v)).isalpha() for v in values])[at]
    return out


def _grams(c: np.ndarray, held: int, buckets: int) -> np.ndarray:
    """Hashed 2-, 3- and 4-grams of c that don't lie in its first `held` characters."""
    grams, h = [], c[:-1] * np.uint32(0x9E3779B1)
    for n in (2, 3, 4):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x85EBCA77)
        h = h ^ (h >> np.uint32(15))
        grams.append(h[max(0, held - n + 1) :] % np.uint32(buckets))
    return np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint32)


def feature_blocks(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Hashed 2-, 3- and 4-grams of the letters of text, in blocks; nothing if it has no letter.

    Where the blocks end makes no difference: what precedes a block is carried into it."""
    low, carry, after = text.lower(), np.array([32], dtype=np.uint32), False
    for lo in range(0, len(low), _BLOCK):
        cp = np.frombuffer(low[lo : lo + _BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters(cp)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each run of letters
        keep[0] |= after
        after = bool(letter[-1])
        if keep.any():
            c = np.concatenate([carry, np.where(letter, cp, 32)[keep].astype(np.uint32)])
            yield _grams(c, len(carry), buckets)
            carry = c[-3:]
    if len(carry) > 1:
        yield _grams(np.concatenate([carry, np.array([32], dtype=np.uint32)]), len(carry), buckets)


def units_of(lang: str, text: str, key: int, config: LangIdConfig) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """What training takes from a row: features and their shares of the whole text, and of two short pieces of it."""
    rng = np.random.default_rng([config.seed, key & 0xFFFFFFFF])
    pieces = [text]
    for _ in range(2):
        n = int(rng.integers(12, 80))
        start = int(rng.integers(0, max(1, len(text) - n)))
        pieces.append(text[start : start + n])
    out = []
    for piece in pieces:
        total = np.zeros(config.buckets, dtype=np.int64)
        for block in feature_blocks(piece, config.buckets):
            total += np.bincount(block, minlength=config.buckets)
        idx = np.flatnonzero(total)
        if len(idx):
            out.append((lang, idx.astype(np.int32), (total[idx] / total.sum()).astype(np.float32)))
    return out


def train(sample: list[list[tuple[str, np.ndarray, np.ndarray]]], config: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """sample: the units of each row. Every fifth row is held back for calibration."""
    langs = sorted({lang for row in sample for lang, _, _ in row})
    if not langs:
        return LangIdModel([], np.zeros((config.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, config)
    rng = np.random.default_rng(config.seed)
    at = {x: i for i, x in enumerate(langs)}
    units, held = [], []
    for i, row in enumerate(sample):
        (held if i % 5 == 4 else units).extend((idx, weight, at[lang]) for lang, idx, weight in row)
    n_lang = len(langs)
    emb = rng.uniform(-1 / config.dim, 1 / config.dim, (config.buckets, config.dim)).astype(np.float32)
    out, bias = np.zeros((config.dim, n_lang), np.float32), np.zeros(n_lang, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    steps, done = config.epochs * max(1, len(units)), 0
    for _ in range(config.epochs):
        for k in rng.permutation(len(units)):
            idx, weight, y = units[k]
            rate = config.rate * (1 - done / steps)
            done += 1
            rows = emb[idx]
            v = weight @ rows
            g = softmax(v @ out + bias)
            g[y] -= 1
            # each feature carries a share of one over the unit's length: scaled up so that rare grams learn too
            emb[idx] = rows - rate * np.outer(weight * np.float32(np.sqrt(len(idx)) * 4), out @ g)
            out -= rate * np.outer(v, g)
            bias -= 0.1 * rate * g
    table = emb @ out
    model = LangIdModel(langs, table, bias.astype(np.float64), 1.0, 0.0, config)
    if held:
        z = np.array([w @ table[i] for i, w, _ in held], dtype=np.float64) + bias
        y = np.array([u for _, _, u in held])
        grid = np.geomspace(0.02, 8, 60)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        best = softmax(z / model.temperature).max(axis=1)
        model.threshold = float(min(config.reject_cap, np.quantile(best, config.reject_rate)))
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """Rows a model may learn from: crc32 of doc_id as text, mod 3, is not 1."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def fit(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """Bounded sample: some rows_per_lang rows of each language, whole texts, by hash order of doc_id.

    A threshold on the hash, from the count of each language, leaves twice as many candidates as are
    wanted; those alone are ranked. Texts become features where they lie.
    """
    rows = learnable(docs.select("doc_id", "lang", "text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    order = F.xxhash64(F.col("doc_id"), F.lit(config.seed))
    share = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n = F.broadcast(n) if n.count() <= 100_000 else n
    few = rows.select("lang", "doc_id", order.alias("o"), share.alias("s")).join(n, "lang").filter(F.col("s") * F.col("n") <= 2 * config.rows_per_lang)
    ids = (
        few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id")))
        .filter(F.col("r") <= config.rows_per_lang)
        .select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_lang"))
        .distinct()
    )
    ids = materialize(ids, "sample-ids")
    ids = F.broadcast(ids) if ids.count() <= 1_000_000 else ids  # some 16 bytes each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, key, text in zip(b["lang"], b["o"], b["text"], strict=True):
                got = units_of(lang, text, key, config)
                if got:
                    yield pd.DataFrame({"lang": lang, "key": key, "unit": range(len(got)), "idx": [x for _, x, _ in got], "weight": [w for _, _, w in got]})

    held = rows.join(ids, (F.col("doc_id") == F.col("sample_id")) & (F.col("lang") == F.col("sample_lang"))).select("lang", order.alias("o"), "text")
    ship_package(docs.sparkSession)
    found = held.mapInPandas(run, "lang string, key long, unit int, idx array<int>, weight array<float>").collect()  # rows_per_lang rows of a language, buckets features each
    sample: dict[tuple, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.key, r.unit, r.idx, r.weight)):
        sample.setdefault((r.lang, r.key), []).append((r.lang, np.array(r.idx, dtype=np.int64), np.array(r.weight, dtype=np.float32)))
    return train(list(sample.values()), config)


def predict(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages floats: fixed by parameters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [m.score(t) for t in b["text"]]
            score = np.array([s for _, s in got], dtype=np.float64)
            lang = [x for x, _ in got]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score, "rejected": [x == "und" or s < m.threshold for x, s in got]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """Rows of docs that the model does not reject, with all their columns; all of them if it has learnt no language."""
    if not model.langs:
        return docs
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([x != "und" and s >= m.threshold for x, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """The digest of op1: held_out marks rows that training could not see (false for a null doc_id)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, fit(docs, config)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")

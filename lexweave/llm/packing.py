"""Best-fit packing by patterns: few-document length patterns, repeat counts from non-negative
least squares, rounding, and a best-fit pass over what is left.

Token lengths are at most `limit`, so the corpus is described by a histogram of `limit` counts.
From it the driver draws up a plan whose size depends on `limit` alone: patterns of two or three
lengths that nearly fill a sequence, repeat counts fitted to the histogram by non-negative least
squares (multiplicative updates), rounded down and clipped to what the histogram still holds, and
then patterns for the residual, each the best fit for the longest length left, repeated until one
of its lengths runs out. Pieces are ranked within their length over hashed buckets (so no length
is ranked by one task) and looked up in the plan.

Ids are those of the `tokenizers` file `byte_bpe_50k.json`. The rank file of the same vocabulary
gives the same ids several times faster, and is used; a text that it cannot handle goes to
`tokenizers` itself. Null text is empty: the end token alone. A document longer than `limit` is cut
into pieces of `limit` tokens, of which the first may be shorter. Repeated rows are packed each.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize, ship_package, shuffle_partitions

LIMIT, END = 1024, 2
_ENCODERS: dict = {}


def encoder(folder: str | None = None):
    """text -> ids, by the vocabulary of byte_bpe_50k in folder (the installed one by default)."""
    if folder not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        at = (lambda n: os.path.join(folder, n)) if folder else public_tokenizers.path
        with open(at("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        slow = []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except BaseException as e:
                # the regex engine gives up on some huge texts, as a panic of this type; anything else is a fault
                if type(e).__name__ != "PanicException":
                    raise
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(at("byte_bpe_50k.json")))
                return slow[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[folder] = encode
    return _ENCODERS[folder]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the remainder first, then full pieces."""
    first = n % limit
    return ([(0, first)] if first else []) + [(s, limit) for s in range(first, n, limit)]


def pieces(docs: DataFrame, limit: int = LIMIT, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*(encode(text) if text else []), END], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), limit)):
                    part = ids[start : start + n]
                    out.append((doc_id, k, start, n, zlib.crc32(part.tobytes()), *([part.astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _patterns(have: np.ndarray, limit: int, slack: int = 2, triples: int = 24) -> np.ndarray:
    """Rows of three lengths (0: none) that leave at most slack: pairs, and some triples for each length."""
    rows = []
    for a in have[have >= limit // 2]:
        b = have[(have <= limit - a) & (have >= limit - a - slack)]
        rows += [(a, x, 0) for x in b]
    for a in have:
        b = have[(have <= a) & (have <= limit - a) & (have >= (limit - a) // 2)]
        if not len(b):
            continue
        c = have[np.maximum(0, np.searchsorted(have, limit - a - b, side="right") - 1)]
        ok = (a + b + c <= limit) & (a + b + c >= limit - slack) & (c <= b)
        b, c = b[ok], c[ok]
        pick = np.unique(np.linspace(0, len(b) - 1, min(triples, len(b))).astype(int)) if len(b) else []
        rows += [(a, b[i], c[i]) for i in pick]
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def fit_counts(pattern: np.ndarray, count: np.ndarray, sweeps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by multiplicative updates."""
    used = pattern > 0
    flat, col = pattern[used], np.repeat(np.arange(len(pattern)), used.sum(axis=1))
    goal = np.bincount(col, weights=count[flat], minlength=len(pattern))
    x = np.full(len(pattern), max(1.0, count.sum() / (3 * len(pattern))))
    for _ in range(sweeps):
        made = np.bincount(flat, weights=x[col], minlength=len(count))
        x *= goal / np.maximum(np.bincount(col, weights=made[flat], minlength=len(pattern)), 1e-9)
    return x


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); uses up the histogram exactly."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int) -> None:
        n, k = np.unique(lengths, return_counts=True)
        times = int(min(most, (left[n] // k).min()))
        if times > 0:
            left[n] -= times * k
            out.append((lengths, times))

    take((limit,), int(left[limit]))
    have = np.flatnonzero(left)
    if len(have) and len(rows := _patterns(have, limit)):
        x = fit_counts(rows, left.astype(float))
        for i in np.lexsort((-x, limit - rows.sum(axis=1))):
            if x[i] >= 1:
                take(tuple(int(v) for v in rows[i] if v), int(x[i]))
    while len(have := np.flatnonzero(left)):
        room, lengths = limit, []
        free = left.copy()
        n = int(have[-1])
        while n:
            lengths.append(n)
            free[n] -= 1
            room -= n
            n = _best_next(free, room)
        take(tuple(lengths), int(left.max()))
    return out


def _best_next(free: np.ndarray, room: int) -> int:
    """The length to add next: the larger of the pair (or the single) that fills room best; 0 if none fits."""
    have = np.flatnonzero(free[: room + 1] > 0)
    if not len(have):
        return 0
    partner = have[np.maximum(0, np.searchsorted(have, room - have, side="right") - 1)]
    ok = (have + partner <= room) & ((have != partner) | (free[have] > 1))
    pair = np.where(ok, have + partner, have)
    best = pair.max()
    return int(have[pair == best].max())


def pack(docs: DataFrame, limit: int = LIMIT, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece."""
    spark = docs.sparkSession
    cutted = materialize(pieces(docs, limit, folder, with_ids), "pieces")
    made = plan({r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}, limit)  # at most limit rows

    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks, base = np.zeros(limit + 1, dtype=np.int64), 0
    for lengths, times in made:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((int(ranks[n]), base, offset))
            ranks[n] += times
            offset += n
        base += times
    table = {n: tuple(np.array(v, dtype=np.int64).T) for n, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)  # its size depends on limit, not on the corpus

    buckets = max(8, shuffle_partitions(spark))
    keyed = cutted.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_r", F.row_number().over(order) - 1).join(before, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_b", "_before")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = shared.value
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            length, rank = b["length"].to_numpy(), b["_r"].to_numpy()
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, start, off = lookup[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = start[k] + rank[at] - first[k], off[k]
            yield b.drop(columns="_r").assign(sequence_id=sequence, offset=offset)[names]

    schema = cutted.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids).schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names
    return ranked.mapInPandas(place, schema)


def op7(docs: DataFrame) -> DataFrame:
    return pack(docs)

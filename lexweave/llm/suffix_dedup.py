"""Removal of repeated byte strings by logarithmic families of suffix arrays.

Every byte covered by a `width`-byte string that starts at another place of the corpus too is
removed. A family takes batches of text: a new batch gets a suffix array (order and common prefixes up to
`width` bytes matter), is merge-scanned against every existing level for equal `width`-byte prefixes, what
was not there becomes a new level, and levels of like size merge, so that there are logarithmically many and each
suffix is moved logarithmically often. A level keeps its bytes once, 8 bytes for a start and 32 for the search.

Families are spread over the cluster by content. Each window is assigned the leftmost smallest
hash of the `gram`-byte strings inside it (its anchor); equal windows have equal anchors at the same
offset. The consecutive windows of one anchor form a slab of at most 2 width bytes. Slabs whose
anchor occurs once cannot repeat; equal slabs (same anchor, same 64-bit hash of all their bytes) repeat whole,
and enter a family once, or not at all where an anchor has no other; all different
slabs of one anchor go to the same family. Anchors with very many slabs are split by the offset of
the window from the anchor, and beyond `width` such parts by a hash of the window itself, so that no
anchor has to fit one task.

Places are told apart by two 64-bit hashes of the text, so copies of a text are worked on once
where that is possible and all get the same answer. Defined results: null text is empty; a text
shorter than width keeps all; repeated rows repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize, ship_package, shuffle_partitions

_U = np.uint64
_CHUNK = 1 << 19
_PREFIX = 32
_STEP = 1 << 14


@dataclass(frozen=True)
class RepeatConfig:
    width: int = 200
    gram: int = 32
    batch_windows: int = 1 << 14
    family_windows: int = 200_000
    #: Slabs of one anchor that one family takes before the anchor is split.
    anchor_slabs: int = 2000
    #: Bytes of a table that may be broadcast: removed runs (8 bytes an edge, 16 a text), anchors, copied slabs.
    broadcast_bytes: int = 8 << 20


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """The width-byte string at each place of data, as a view without copies."""
    return np.ndarray((max(0, len(data) - width + 1),), dtype=f"S{width}", buffer=data, strides=(1,))


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the starts, by `width` bytes: their numbers in order, and whether each shares its first
    `width` bytes with the one before (LCP >= width). Ranks of 8 bytes are doubled until they span width."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(data),), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    span = min(8, width)
    _, rank = np.unique(words >> _U(8 * (8 - span)), return_inverse=True)
    while span < width:
        ahead = min(span, width - span)
        m = int(rank.max()) + 2
        pair = rank * m
        pair[: len(rank) - ahead] += rank[ahead:] + 1
        _, rank = np.unique(pair, return_inverse=True)
        span += ahead
    own = rank[starts]
    order = np.argsort(own, kind="stable")
    own = own[order]
    return order, np.r_[False, own[1:] == own[:-1]] if len(own) else np.zeros(0, dtype=bool)


class Level:
    """A suffix array: one row of bytes, the starts of different windows in their order, and the first
    bytes of each side by side for the search; owner numbers the windows over the whole family."""

    __slots__ = ("data", "owner", "prefix", "starts", "width")

    def __init__(self, data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int, prefix: np.ndarray | None = None):
        self.data, self.starts, self.owner, self.width = data, starts, owner, width
        self.prefix = _windows(data, min(_PREFIX, width))[starts] if prefix is None else prefix

    def __len__(self) -> int:
        return len(self.starts)

    def locate(self, other: Level, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Place of each window of other[part] in this level, and whether it stands there."""
        keys = other.prefix[part]
        lo, hi = np.searchsorted(self.prefix, keys, "left"), np.searchsorted(self.prefix, keys, "right")
        left = np.flatnonzero(lo < hi)
        hit = np.zeros(len(lo), dtype=bool)
        if len(left):
            whole = _windows(self.data, self.width)
            want = _windows(other.data, self.width)[other.starts[part][left]]
            a, z = lo[left], hi[left]
            while (open_ := np.flatnonzero(a < z)).size:
                mid = (a[open_] + z[open_]) // 2
                less = whole[self.starts[mid]] < want[open_]
                a[open_[less]] = mid[less] + 1
                z[open_[~less]] = mid[~less]
            lo[left] = a
            there = a < len(self.starts)
            hit[left[there]] = whole[self.starts[a[there]]] == want[there]
        return lo, hit

    def merged(self, other: Level) -> Level:
        at = np.concatenate([self.locate(other, slice(i, i + _STEP))[0] for i in range(0, len(other), _STEP)])
        data = np.concatenate([self.data, other.data])
        put = lambda x, y: np.insert(x, at, y)  # noqa: E731  equal places keep the order of other
        return Level(data, put(self.starts, other.starts + len(self.data)), put(self.owner, other.owner), self.width, put(self.prefix, other.prefix))


class Family:
    """Levels of geometric size; marks windows that occur twice. A new batch gets a suffix array, is
    merge-scanned against every level, and what was in none becomes a level; levels of like size merge."""

    def __init__(self, width: int):
        self.width = width
        self.levels: list[Level] = []
        self.repeated: list[np.ndarray] = []
        self.count = 0

    def add(self, parts: list[bytes]) -> None:
        """parts: strings of at least width bytes; their windows get the numbers count, count + 1, ..."""
        size = np.array([len(x) for x in parts], dtype=np.int64)
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n_of = size - self.width + 1
        begin = np.repeat(np.cumsum(size) - size - (np.cumsum(n_of) - n_of), n_of)
        starts = np.arange(len(begin)) + begin
        n, first = len(starts), self.count
        self.count += n
        mark = np.zeros(n, dtype=bool)
        self.repeated.append(mark)
        order, again = suffix_order(data, starts, self.width)
        twice = again.copy()
        twice[:-1] |= again[1:]
        mark[order[twice]] = True
        order = order[~again]
        batch = Level(data, starts[order], order + first, self.width)
        new = np.ones(len(batch), dtype=bool)
        for level in self.levels:  # merge-scan
            for lo in range(0, len(batch), _STEP):
                at, hit = level.locate(batch, slice(lo, lo + _STEP))
                self._mark(batch.owner[lo : lo + _STEP][hit])
                self._mark(level.owner[at[hit]])
                new[lo : lo + _STEP] &= ~hit
        if new.any():
            self.levels.append(Level(data, batch.starts[new], batch.owner[new], self.width, batch.prefix[new]))
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))

    def _mark(self, numbers: np.ndarray) -> None:
        if not len(numbers):
            return
        ends = np.cumsum([len(x) for x in self.repeated])
        batch = np.searchsorted(ends, numbers, side="right")
        for k in np.unique(batch):
            self.repeated[k][numbers[batch == k] - (ends[k] - len(self.repeated[k]))] = True

    def marks(self) -> np.ndarray:
        return np.concatenate(self.repeated) if self.repeated else np.zeros(0, dtype=bool)


_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 2**64)
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(b), dtype=_U)]), dtype=_U) for b in (_BASE, inverse))
    return _POWERS[size]


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram-byte string of b."""
    up, down = _powers(len(b))
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[b] * up[: len(b)], dtype=_U)])
    h = (total[gram:] - total[:-gram]) * down[: len(b) - gram + 1]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=_U)
    blocks[: len(x)] = x
    rows = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def slabs(b: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor place and anchor hash of the slabs of b."""
    width, gram = config.width, config.gram
    out = []
    for c in range(0, len(b) - width + 1, _CHUNK):
        part = b[c : c + _CHUNK + width - 1]
        h = _gram_hashes(part, gram)
        keys = (h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=_U)
        low = (_window_min(keys, width - gram + 1) & _U(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(low)]]) - 1
        out.append((lo + c, hi + c, low[lo] + c, h[low[lo]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bounded(side: DataFrame, row: int, most: int) -> DataFrame:
    """side, to be broadcast if its rows, of `row` bytes each, take `most` bytes at most; never beyond, whatever its files' size."""
    return F.broadcast(side) if side.count() * row <= most else side.hint("merge")


def _keys() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _slab_table(docs: DataFrame, config: RepeatConfig) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            rows = 0
            for k1, k2, text in zip(b["k1"], b["k2"], b["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                lo, hi, anchor, h = slabs(np.frombuffer(raw, dtype=np.uint8), config)
                if not len(lo):
                    continue
                view = memoryview(raw)
                end = config.width
                digest = [xxhash.xxh3_64_intdigest(view[x : y + end], a - x) for x, y, a in zip(lo.tolist(), hi.tolist(), anchor.tolist(), strict=True)]
                for col, v in zip(cols, (np.full(len(lo), k1), np.full(len(lo), k2), lo, hi, h.view(np.int64), np.array(digest, dtype=_U).view(np.int64)), strict=True):
                    col.append(v)
                rows += len(lo)
                if rows > 200_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, cols), strict=True)))
                    cols, rows = [[] for _ in range(6)], 0
            if rows:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, cols), strict=True)))

    names = ["k1", "k2", "lo", "hi", "fp", "slab"]
    long_enough = docs.filter(F.octet_length("text") >= config.width).select(*_keys(), "text")
    return long_enough.mapInPandas(run, "k1 long, k2 long, lo long, hi long, fp long, slab long")


def _pack(docs: DataFrame) -> DataFrame:
    """k1, k2, z: texts compressed before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield b.assign(z=[c.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"]]).drop(columns="text")

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rest = [c for c in docs.columns if c != "text"]
    return docs.mapInPandas(run, ", ".join(f"{c} {kind[c]}" for c in rest) + ", z binary")


def _cut(texts: DataFrame, wanted: DataFrame, config: RepeatConfig) -> DataFrame:
    """key, k1, k2, lo, times, raw: the wanted slabs, those of crowded anchors in parts."""
    width, reach = config.width, config.width - config.gram + 1
    grouped = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "fp", "slab", "times", "n")).alias("want"))  # of one text
    joined = _pack(texts).join(grouped, ["k1", "k2"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k1, k2, body, want in zip(b["k1"], b["k2"], b["z"], b["want"], strict=True):
                raw = d.decompress(body)
                for x in want:
                    lo, hi, fp, slab, times, n = (x[c] for c in ("lo", "hi", "fp", "slab", "times", "n"))
                    parts = -(-n // config.anchor_slabs)
                    if parts <= 1:
                        out.append((fp, k1, k2, lo, slab, times, raw[lo : hi + width]))
                        continue
                    part = np.frombuffer(raw[lo : hi + width], dtype=np.uint8)
                    anchor = lo + int(slabs(part, config)[2][0])
                    step = max(1, reach // parts)
                    edges = sorted({lo, hi + 1, *(s for s in range(lo + 1, hi + 1) if (anchor - s + 1) % step == 0)})
                    for s, e in zip(edges[:-1], edges[1:], strict=True):
                        key = (fp, (anchor - s) // step) if parts <= reach else (fp, xxhash.xxh3_64_intdigest(raw[s : s + width]))
                        out.append((xxhash.xxh64_intdigest(repr(key)) - (1 << 63), k1, k2, s, slab, times, raw[s : e - 1 + width]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = ["key", "k1", "k2", "lo", "slab", "times", "raw"]
    made = joined.select("k1", "k2", "z", "want").mapInPandas(run, "key long, k1 long, k2 long, lo long, slab long, times long, raw binary")
    return made.dropDuplicates(["key", "slab", "lo", "k1", "k2"])  # copies of a text hold the same slabs


def _scan(parts: DataFrame, config: RepeatConfig, n: int) -> DataFrame:
    """k1, k2, lo, hi: runs of windows that a family found twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = Family(config.width)
        at: list[tuple[int, int, int, int, int]] = []
        held: list[bytes] = []
        size = 0
        for b in batches:
            for k1, k2, lo, times, raw in zip(b["k1"], b["k2"], b["lo"], b["times"], b["raw"], strict=True):
                n = len(raw) - config.width + 1
                at.append((k1, k2, lo, n, times))
                held.append(bytes(raw))
                size += n
                if size >= config.batch_windows:
                    family.add(held)
                    held, size = [], 0
        if held:
            family.add(held)
        mark = family.marks()
        out, first = [], 0
        for k1, k2, lo, m, times in at:
            own = mark[first : first + m]
            first += m
            if times == 1 and own.any():
                edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                out += [(k1, k2, lo + s, lo + e - 1) for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        yield pd.DataFrame(out, columns=["k1", "k2", "lo", "hi"])

    return parts.repartition(n, "key").mapInPandas(run, "k1 long, k2 long, lo long, hi long")


def repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """k1, k2, runs: for each text with any, the merged byte runs [start, end) to remove."""
    every = _slab_table(docs, config)  # made twice: cheaper than keeping it
    seen = every.groupBy("fp").agg(F.count("*").alias("n"), F.min("slab").alias("a"), F.max("slab").alias("b")).filter("n > 1").select("fp", "n", (F.col("a") != F.col("b")).alias("mixed"))
    seen = materialize(seen, "seen-anchors")  # so that a crowded anchor can be split in the join
    live = materialize(every.select("k1", "k2", (F.col("lo") * 256 + F.col("hi") - F.col("lo")).alias("place"), "fp", "slab").join(_bounded(seen, 17, config.broadcast_bytes // 4), "fp").select("k1", "k2", F.shiftright("place", 8).alias("lo"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(255)).alias("hi"), "fp", "slab", "n", "mixed"), "live-slabs")
    whole = live.filter("NOT mixed").select("k1", "k2", "lo", "hi")
    mixed = live.filter("mixed")
    kinds = materialize(mixed.groupBy("fp", "slab").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "lo", "hi", "n")).alias("at")), "mixed-slabs")
    again = materialize(kinds.filter("times > 1").select("fp", "slab"), "copied-slabs")
    copied = mixed.join(_bounded(again, 16, config.broadcast_bytes), ["fp", "slab"]).select("k1", "k2", "lo", "hi")  # a hot slab stays where it is
    wanted = kinds.select("fp", "slab", "times", "at.*")
    windows = kinds.agg(F.sum(F.col("at.hi") - F.col("at.lo") + 1)).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-windows // config.family_windows))
    texts = docs.filter(F.octet_length("text") >= config.width).select(*_keys(), "text")
    found = _scan(_cut(texts, wanted, config), config, n)
    ranges = whole.unionByName(copied).unionByName(found).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))  # of one text

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = []
            for r in b["r"]:
                x = np.array([(v["lo"], v["hi"] + config.width) for v in r], dtype=np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                end = np.maximum.accumulate(x[:, 1])
                new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > end[:-1]]))
                last = np.concatenate([new[1:], [len(x)]]) - 1
                runs.append(np.stack([x[new, 0], end[last]], axis=1).ravel())
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "runs": runs})

    return materialize(ranges.mapInPandas(merge, "k1 long, k2 long, runs array<long>"), "runs")


def without_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), kept_sha256 for each row."""
    ship_package(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = repeats(d, config)
    few = 8 * (runs.agg(F.sum(F.size("runs") + 2)).first()[0] or 0) <= config.broadcast_bytes
    keyed = d.select("doc_id", *_keys(), "text")
    if few:
        joined = keyed.withColumnRenamed("text", "body").join(F.broadcast(runs), ["k1", "k2"], "left")
    else:
        joined = _pack(keyed).withColumnRenamed("z", "body").join(runs, ["k1", "k2"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc_id, body, r in zip(b["doc_id"], b["body"], b["runs"], strict=True):
                raw = body.encode("utf-8", "surrogatepass") if few else c.decompress(body)
                if r is None:
                    out.append((doc_id, len(raw), 0, 0, raw, hashlib.sha256(raw).hexdigest()))
                    continue
                r = [int(x) for x in r]
                kept = b"".join(raw[a:z] for a, z in zip([0, *r[1::2]], [*r[::2], len(raw)], strict=True))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(r) // 2, kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "body", "runs").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op3(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")

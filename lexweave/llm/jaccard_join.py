"""Similarity join of documents on word 5-grams (Jaccard), by a chosen-path join.

Texts become sets of hashed 5-grams of their lower-cased words (a text of fewer words is one gram).
Equal sets form one class, represented once. Every set is embedded as `coords` minhash tokens. In
each run a node of the search tree picks tokens with probability 1 / (split_similarity x coords),
by a hash of its path, and sends a set to one child for each picked token, so that similar sets
meet in a child with a chance that does not die out with depth. Nodes of up to `small` sets are
brute-forced on 8-bit sketches. Larger nodes first link all sets near a pivot to it, drop those
that are almost equal to it (whatever is similar to them is near the pivot too), and split the rest
on the next tokens; what is still large after `depth` levels is brute-forced in blocks. The number
of runs follows from the target recall for a pair right at the threshold.

Candidates pass on only as stars, whose centre is the least set of the component in its node. Within each connected component of candidates the
exact Jaccard similarity of the 5-gram sets then decides every link, in blocks of bounded size, so
links are exact and complete inside a component, and only their counts and stars leave a task.

Result: one row for each row of docs: doc_id, class_id (least doc_id of the connected component of
links), n_links (rows at least `similarity` similar to it, equal ones included), class_key.
Defined results: null or wordless texts have no set, no link, and are their own class. Repeated
rows are linked with each other. A null doc_id is kept, and names a class only if nothing else can.
Sets are told apart by a 64-bit hash of their grams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.grouping import components, stars, whole_groups
from lexweave.session import materialize, ship_package

_WORD = re.compile(r"\w+")
_U = np.uint64


@dataclass(frozen=True)
class JoinConfig:
    gram: int = 5
    similarity: float = 0.8
    coords: int = 128
    split_similarity: float = 0.65
    recall: float = 0.999
    depth: int = 3
    small: int = 8192
    #: Sets of a block where a node that is large to the end is brute-forced.
    block_sets: int = 8192
    block_docs: int = 2048
    block_grams: int = 1 << 19
    #: Members that may be broadcast to fetch their texts; more are joined by a shuffle.
    broadcast_rows: int = 500_000
    seed: int = 11

    @property
    def runs(self) -> int:
        """Runs until a pair at the threshold meets at the last level with the target recall."""
        lost = 0.0
        for _ in range(self.depth):
            lost = math.exp(-self.similarity / self.split_similarity * (1 - lost))
        return math.ceil(math.log(1 - self.recall) / math.log(lost))

    @property
    def floor(self) -> float:
        """Least agreement of sketches: five deviations below the threshold."""
        return self.similarity - 5 * math.sqrt(self.similarity * (1 - self.similarity) / self.coords)


class _Ids(dict):
    """Hashes of words met lately, at most `most`; a worker keeps them for its life."""

    most = 25_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_IDS = _Ids()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of text."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=_U)
    ids = _IDS
    w = np.array([ids[x] for x in words], dtype=_U)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=_U)
    for i in range(k):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def minhash(g: np.ndarray, config: JoinConfig) -> np.ndarray:
    """coords 32-bit minima of g under as many hash functions."""
    a = _mix(np.arange(1, config.coords + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(config.seed)) | _U(1)
    out = np.full(config.coords, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(g), 2048):
        v = (a[:, None] * g[None, lo : lo + 2048]) >> _U(32)
        out = np.minimum(out, v.min(axis=1).astype(np.uint32))
    return out


def sets(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """doc_id, _k1, _k2 (text key), cls (set hash, null if empty), size, sig."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cls, size, sig = [], [], []
            for text in b["text"]:
                g = grams(text, config.gram)
                size.append(len(g))
                cls.append(int(np.int64(xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63))) if len(g) else None)
                sig.append(minhash(g, config).tobytes() if len(g) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "_k1": b["_k1"], "_k2": b["_k2"], "cls": pd.array(cls, dtype="Int64"), "size": np.array(size, dtype=np.int64), "sig": sig})

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_k1"), F.coalesce(F.xxhash64(F.lit(1), F.col("text")), F.lit(0)).alias("_k2"))
    return keyed.mapInPandas(run, f"doc_id {kind}, _k1 long, _k2 long, cls long, size long, sig binary")


def _picked(path: int, config: JoinConfig) -> np.ndarray:
    """Coordinates that the node with this path splits on: the same for every set in it."""
    pick = _mix(_mix(np.arange(config.coords, dtype=_U) + _U(path & (2**64 - 1))) + _U(config.seed))
    return np.flatnonzero(pick < _U(int(2**64 / (config.split_similarity * config.coords))))


def _child(path: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    token = (coord.astype(_U) << _U(32)) | value.astype(_U)
    return _mix(_mix(token) + path.astype(_U) * _U(3)).view(np.int64)


def _split(df: DataFrame, config: JoinConfig, root: bool) -> DataFrame:
    """node, cls of the children; df has cls, sig and, below the root, node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = _mix(np.arange(1, config.runs + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
        for b in batches:
            if not len(b):
                continue
            cls = b["cls"].to_numpy()
            sig = np.frombuffer(b"".join(b["sig"]), dtype=np.uint32).reshape(len(b), -1)
            paths = roots if root else np.unique(b["node"].to_numpy()).view(_U)
            own = None if root else b["node"].to_numpy().view(_U)
            nodes, members = [], []
            for p in paths:
                at = slice(None) if root else np.flatnonzero(own == p)
                for c in _picked(int(p), config):
                    value = sig[at, c]
                    nodes.append(_child(np.full(len(value), p, dtype=_U), np.full(len(value), c), value))
                    members.append(cls[at])
            yield pd.DataFrame({"node": np.concatenate([np.zeros(0, np.int64), *nodes]), "cls": np.concatenate([cls[:0], *members])})

    return df.mapInPandas(run, "node long, cls long")


def _sketch(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint32).reshape(len(values), -1).astype(np.uint8)


def near_components(sk: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """Labels of the components of sketches at least `least` alike (across sides, where there are two).

    A sketch is compared only with those not yet in its component."""
    label = np.arange(len(sk))
    two = side.any()
    for i in range(len(sk) - 1):
        other = np.flatnonzero((label[i + 1 :] != label[i]) & (side[i + 1 :] != side[i]) if two else label[i + 1 :] != label[i]) + i + 1
        if len(other):
            agree = (sk[other] == sk[i]).mean(axis=1)
            hit = other[(agree - 1 / 256) / (1 - 1 / 256) >= least]
            if len(hit):
                label[np.isin(label, label[hit])] = label[i]
    return label


def _brute(df: DataFrame, key: str, config: JoinConfig) -> DataFrame:
    """Star edges a, b of near sketches in each group of key; across its sides where there are two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for _, g in whole_groups(batches, key):
            cls = g["cls"].to_numpy()
            if len(cls) < 2:
                continue
            sk = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(cls), -1)
            x, y = stars(cls, near_components(sk, g["side"].to_numpy(), config.floor))
            if len(x):
                a.append(x)
                b.append(y)
            if len(a) > 2000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, "a long, b long")


def _live(members: DataFrame) -> DataFrame:
    """node, cls, n: members of nodes that hold at least two sets."""
    sizes = materialize(members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node-sizes")
    return materialize(members.join(sizes, "node"), "nodes")


def candidates(classes: DataFrame, config: JoinConfig) -> DataFrame:
    """a, b: candidate edges between classes, linear in their number."""
    full = classes.select("cls", "sig")

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sk = _sketch(b["sig"]) if len(b) else []
            yield pd.DataFrame({"cls": b["cls"], "sketch": [x.tobytes() for x in sk]})

    sketches = materialize(full.mapInPandas(shrink, "cls long, sketch binary"), "sketches")
    found = []
    members = _split(full, config, root=True)
    for level in range(1, config.depth + 1):
        live = _live(members)
        found.append(_brute(live.filter(F.col("n") <= config.small).select("node", "cls", F.lit(0).alias("side")).join(sketches, "cls"), "node", config))
        big = live.filter(F.col("n") > config.small)
        if big.isEmpty():
            break
        rest, edges = _pivot(big.select("node", "cls", "n"), sketches, config)
        found.append(edges)
        if level < config.depth:
            members = _split(rest.join(full, "cls").select("node", "cls", "sig"), config, root=False)
        else:
            found.append(_brute(_blocks(rest, config).join(sketches, "cls"), "node", config))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _pivot(big: DataFrame, sketches: DataFrame, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """Links of large nodes' sets to a pivot, and the node, cls, n that are not almost equal to it."""
    held = big.join(sketches, "cls")
    pivots = held.groupBy("node").agg(F.min_by(F.struct("cls", "sketch"), F.xxhash64("node", "cls")).alias("p")).select("node", F.col("p.cls").alias("pivot"), F.col("p.sketch").alias("pivot_sketch"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b[c]), dtype=np.uint8).reshape(len(b), -1) for c in ("sketch", "pivot_sketch"))
            near = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pd.DataFrame({"node": b["node"], "cls": b["cls"], "n": b["n"], "pivot": b["pivot"], "near": near})

    got = materialize(held.join(pivots, "node").mapInPandas(run, "node long, cls long, n long, pivot long, near double"), "pivots")
    gap = 1 - config.similarity
    rest = got.filter(F.col("near") < 1 - gap * 0.4).select("node", "cls", "n")
    return rest, got.filter((F.col("near") >= config.floor - gap * 0.4) & (F.col("cls") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("cls").alias("b"))


def _blocks(rest: DataFrame, config: JoinConfig) -> DataFrame:
    """node (a pair of blocks), cls, side: large nodes dealt into blocks of about block_sets sets, all pairs of blocks."""
    blocks = F.ceil(F.col("n") / config.block_sets).cast("int")
    dealt = rest.withColumn("k", blocks).withColumn("b", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("k")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return pairs.select(F.xxhash64("node", F.least("b", "o"), F.greatest("b", "o")).alias("node"), "cls", F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"))


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Which sets of left and right (of left with itself, without the diagonal, if None) are similar."""
    n, sets_ = len(left), left + (right or [])
    size = np.array([len(s) for s in sets_], dtype=np.int64)
    row = np.repeat(np.arange(len(sets_)), size)
    _, col, count = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    keep = count[col] > 1
    row, col = row[keep], col[keep]
    used, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a_size, b_size = size[:n], size[n:] if right else size
    inter = np.zeros((n, len(b_size)), dtype=np.float32)
    for lo in range(0, len(used), 2048):
        s, e = np.searchsorted(col, [lo, lo + 2048])
        x = np.zeros((len(sets_), min(2048, len(used) - lo)), dtype=np.float32)
        x[row[s:e], col[s:e] - lo] = 1
        inter += x[:n] @ (x[n:] if right else x).T
    link = inter >= least * (a_size[:, None] + b_size[None, :] - inter) - 1e-9
    if not right:
        np.fill_diagonal(link, False)
    return link


def linked_labels(left: np.ndarray, right: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least name of the component of each row and column of link."""
    high = np.iinfo(np.int64).max
    while True:
        r = np.minimum(right, np.where(link, left[:, None], high).min(axis=0))
        a = np.minimum(left, np.where(link, r[None, :], high).min(axis=1))
        if (r == right).all() and (a == left).all():
            return left, right
        left, right = a, r


def _verify(rows: DataFrame, config: JoinConfig) -> DataFrame:
    """a, b, links from groups of key: sums of weights (b null), and star edges of the links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in whole_groups(batches, "key"):
            g = g.drop_duplicates("cls")
            side = g["side"].to_numpy()
            parts = [g[side == 1], g[side == 2]] if side.any() else [g]
            if min(map(len, parts)) < (1 if side.any() else 2):
                continue
            sets_ = [[np.frombuffer(x, dtype=_U) for x in p["grams"]] for p in parts]
            link = exact_links(sets_[0], sets_[1] if len(parts) > 1 else None, config.similarity)
            if not link.any():
                continue
            a, b = parts[0], parts[-1]
            names = [a["cls"].to_numpy(), b["cls"].to_numpy()]
            labels = linked_labels(*names, link)
            links = [link @ b["weight"].to_numpy(), a["weight"].to_numpy() @ link]
            for k in range(len(parts)):
                has, off = links[k] > 0, labels[k] != names[k]
                yield pd.DataFrame({"a": np.concatenate([names[k][has], labels[k][off]]), "b": pd.array([None] * int(has.sum()) + names[k][off].tolist(), dtype="Int64"), "links": np.concatenate([links[k][has].astype(np.int64), np.zeros(int(off.sum()), np.int64)])})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, links long")


def join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, class_id, n_links, class_key, _k1, _k2 for each row of docs."""
    every = materialize(sets(docs, config), "sets")
    classes = materialize(every.filter("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first_doc"), F.min("size").alias("size"), F.first("sig").alias("sig")), "classes")
    groups = components(candidates(classes, config))

    info = groups.join(classes.select("cls", "weight", "first_doc", "size"), F.col("node") == F.col("cls")).select("cls", "component", "weight", "first_doc", "size")
    stats = info.groupBy("component").agg(F.greatest(F.ceil(F.sum("size") / config.block_grams), F.ceil(F.count("*") / config.block_docs)).cast("int").alias("blocks"))
    info = materialize(info.join(stats, "component"), "members")
    place = every.select("cls", F.struct("doc_id", "_k1", "_k2").alias("at")).join(info.select("cls"), "cls").groupBy("cls").agg(F.min("at").alias("at"))
    place = place.join(info, "cls").select("cls", "component", "weight", "blocks", F.col("at.doc_id").alias("at_doc"), F.col("at._k1").alias("at_k1"), F.col("at._k2").alias("at_k2"))
    if info.count() <= config.broadcast_rows:
        place = F.broadcast(place)
    text = docs.select(F.col("doc_id").alias("_d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_k1"), F.coalesce(F.xxhash64(F.lit(1), F.col("text")), F.lit(0)).alias("_k2"), "text")
    held = text.join(place, F.col("_d").eqNullSafe(F.col("at_doc")) & (F.col("_k1") == F.col("at_k1")) & (F.col("_k2") == F.col("at_k2"))).select("cls", "component", "weight", "blocks", "text")

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(grams=[grams(t, config.gram).tobytes() for t in b["text"]]).drop(columns="text")

    dealt = held.mapInPandas(shingle, "cls long, component long, weight long, blocks int, grams binary").withColumn("b", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select(F.xxhash64("component", F.least("b", "o"), F.greatest("b", "o")).alias("key"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "cls", "weight", "grams")
    links = materialize(_verify(keyed, config), "links")

    labels = components(links.filter("b IS NOT NULL"))
    count = links.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    linked = labels.join(count, F.col("node") == F.col("a")).join(classes.select("cls", "first_doc"), F.col("node") == F.col("cls")).select("cls", "component", "links", "first_doc")
    names = linked.groupBy("component").agg(F.min("first_doc").alias("class_doc"))
    linked = linked.join(names, "component").select("cls", "component", "links", "class_doc")
    own = classes.select("cls", "weight", "first_doc").join(linked, "cls", "left").select(
        F.col("cls").alias("_c"), F.coalesce("class_doc", "first_doc").alias("class_id"), F.coalesce("component", "cls").alias("class_key"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return every.select("doc_id", "cls", "_k1", "_k2").join(own, F.col("cls") == F.col("_c"), "left").select(
        "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key", "_k1", "_k2"
    )


def keep_one(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """docs with one row of each class: its least (doc_id, text hash). Texts without a set all stay."""
    got = join(docs.select("doc_id", "text"), config)
    chosen = got.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("doc_id", "_k1", "_k2")).alias("c"))
    alone = got.filter("class_key IS NULL").select("doc_id", "_k1", "_k2").distinct()
    keep = chosen.select("c.*", F.lit(True).alias("_one")).unionByName(alone.withColumn("_one", F.lit(False)))
    keep = keep.select(F.col("doc_id").alias("_kd"), F.col("_k1").alias("_kk1"), F.col("_k2").alias("_kk2"), "_one")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # kept whole: its names may be those used here
    d = docs.select(row, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_k1"), F.coalesce(F.xxhash64(F.lit(1), F.col("text")), F.lit(0)).alias("_k2"))
    d = d.join(keep, F.col("_row.doc_id").eqNullSafe(F.col("_kd")) & (F.col("_k1") == F.col("_kk1")) & (F.col("_k2") == F.col("_kk2")))
    one = d.filter("_one").dropDuplicates(["_kd", "_kk1", "_kk2"])
    return one.select("_row.*").unionByName(d.filter("NOT _one").select("_row.*"))


def op2(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links", "class_key")

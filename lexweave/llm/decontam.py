"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts are taken as UTF-8; A-Z become a-z and every other ASCII character than 0-9 and a-z
separates words, so a single byte translation normalises a text and keeps byte offsets. A
window is ten consecutive words of an item, or the whole item if it has fewer. Every text is
scanned once as a row of word numbers, in which words that no item holds are one number; places in
it are word numbers, and map back to byte spans of the original.

Defined results: null or wordless text -> no hits; null or wordless item -> no window;
windows shared by several items name all of them; an empty benchmark hits nothing. Windows of an item
without an id hit, but it is not among the items. Item ids in `items` are strings, sorted as strings, without repeats.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize, ship_package

WINDOW = 10
#: Test text that one automaton may hold; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 32 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUILT: dict[str, "Windows"] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _char(n: int) -> str:
    """A character for the number n, surrogates and the null character left out."""
    return chr(n + 1 if n < 0xD7FF else n + 0x801)


class Windows:
    """The automaton over word numbers, and for each window its number of words and the items that hold it.

    A word of the test items is a number, written as one character, or as two of separate ranges where there
    are more than `alphabet` words; so the automaton takes ten steps a window, not one for each letter."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, alphabet: int = 1_000_000):
        texts = [words_of(text) for _, text in items]
        numbers: dict[bytes, int] = {}
        for words in texts:
            for w in words:
                numbers.setdefault(w, len(numbers))
        self.wide = 1 if len(numbers) <= alphabet else 2
        low = alphabet if self.wide == 1 else alphabet // 2
        self.chars = {w: _char(n) if self.wide == 1 else _char(low + n // low) + _char(n % low) for w, n in numbers.items()}
        del numbers
        first: list[int] = []
        more: dict[int, set[int]] = defaultdict(set)
        sizes: list[int] = []
        self.automaton = ahocorasick.Automaton()
        for item, words in enumerate(texts):
            line = "".join([self.chars[w] for w in words])
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if words else 0):
                key = line[i * self.wide : (i + n) * self.wide]
                at = self.automaton.get(key, -1)
                if at < 0:
                    self.automaton.add_word(key, len(first))
                    first.append(item)
                    sizes.append(n)
                elif first[at] != item:
                    more[at].add(item)
        self.empty = not first
        if first:
            self.automaton.make_automaton()
        self.first, self.more, self.sizes = np.array(first, dtype=np.int64), dict(more), np.array(sizes, dtype=np.int64)
        self.names = [item for item, _ in items]

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str], list[bytes]]:
        """Number of words, sorted numbers of the words hit, items found, the words."""
        words = words_of(text)
        none = np.zeros(0, dtype=np.int64)
        if not words or self.empty:
            return len(words), none, set(), words
        unknown, get = "\0" * self.wide, self.chars.get
        found = list(self.automaton.iter("".join([get(w, unknown) for w in words])))
        if not found:
            return len(words), none, set(), words
        last = np.array([e for e, _ in found], dtype=np.int64) // self.wide
        key = np.array([k for _, k in found], dtype=np.int64)
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, last - self.sizes[key] + 1, 1)
        np.add.at(cover, last + 1, -1)
        held = {int(x) for x in self.first[key]}.union(*(self.more[k] for k in set(key.tolist()) & self.more.keys()))
        names = {self.names[x] for x in held} - {None}
        return len(words), np.flatnonzero(np.cumsum(cover)[:-1] > 0), names, words


def byte_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans in the original text of the runs of hit words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], raw.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [(int(start[a]), int(end[b])) for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True)]


def _windows(digest: str, items: list[tuple[str | None, str | None]], window: int) -> Windows:
    key = f"{digest}:{window}"
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Windows(items, window)
    return _BUILT[key]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    return [benchmark] if n == 1 else [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _items(benchmark: DataFrame) -> tuple[list[tuple[str | None, str | None]], str]:
    items = [(None if r.item_id is None else str(r.item_id), r.text) for r in benchmark.select("item_id", "text").collect()]
    return items, hashlib.sha256(repr(sorted(items, key=repr)).encode()).hexdigest()


def _scan_block(docs: DataFrame, benchmark: DataFrame, window: int, numbered: bool = False) -> DataFrame:
    """Results of each row of docs, beside its columns other than text."""
    spark = docs.sparkSession
    items, digest = _items(benchmark)
    shared = spark.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text, checked above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = _windows(digest, shared.value, window)
        for b in batches:
            out = []
            for text in b["text"]:
                n, hit, names, _ = w.scan(text)
                spans = byte_spans(text, hit) if len(hit) else []
                out.append((n, hit.tolist(), sorted(names), [f"{a}:{z}" for a, z in spans]))
            got = pd.DataFrame(out, columns=["n_words", "hits", "items", "spans"], index=b.index)
            yield pd.concat([b[keys], got], axis=1)

    keys = [c for c in ("_row", "doc_id") if c == "doc_id" or numbered]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, "text").mapInPandas(run, f"{kinds}, n_words long, hits array<long>, items array<string>, spans array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (byte spans start:end of the original), one row per row of docs.

    A benchmark above BLOCK_BYTES is scanned block by block and the hit words of a row are united.
    Rows are numbered first, in a copy in the shared folder, so that equal or null doc_ids stay apart.
    """
    ship_package(docs.sparkSession)
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return _scan_block(docs, benchmark, window).select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items", "spans")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "numbered-rows")
    parts = [_scan_block(rows, b, window, numbered=True) for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return every.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.size(flat("hits")).cast("long").alias("n_hit"), flat("items").alias("items"), flat("spans").alias("spans")).drop("_row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of docs without a hit, with all their columns; benchmark blocks filter one after the other."""
    spark, rows = docs.sparkSession, docs
    ship_package(spark)
    for block in _blocks(benchmark):
        items, digest = _items(block)
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], digest: str = digest, shared=shared) -> Iterator[pa.RecordBatch]:
            w = _windows(digest, shared.value, window)
            for b in batches:
                yield b.filter(pa.array([not len(w.scan(t)[1]) for t in b.column("text").to_pylist()], pa.bool_()))

        if docs is not rows:  # one automaton in memory at a time
            docs = materialize(docs, "clean-of-block")
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = decontaminate(docs, benchmark)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, digit runs to 0, white space runs to one space, trimmed)
and hashed. A line is boilerplate on a host (`source`) when more than
max(min_docs, share x documents of the host) documents of that host hold it. Documents are told apart by
doc_id (null is one); with `by="texts"` by their text instead, so that exact copies count once on both sides
and copied documents aren't rejected for being copied. Boilerplate
lines are removed, and a document is rejected as depleted when fewer than `min_words` words, or
less than `min_left` of its words, remain.

Counting: first a plain count of (host, line), combined before the shuffle, gives the lines that
can be above the limit; only those are counted by different documents. A hot host or line is therefore
summed in every task before anything is shuffled.

Defined results: null text or host is an empty one; wordless lines are never counted or removed;
repeated rows get the same verdict; an empty table gives an empty result. A text with fewer than
five words has no repeated window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of (host, line, limit) that may be broadcast, some 50 bytes each.
BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class LineLimits:
    min_docs: int = 20
    share: float = 0.02
    min_words: int = 10
    min_left: float = 0.3
    by: str = "documents"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def normalised(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), SPACE, " "))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds the base columns; needs a non-null column text. 5-word windows are compared by hash."""
    d = docs.withColumn("_h", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)))
    d = d.withColumn("n_words", F.size("_h").cast("long"))
    window = lambda x, i: F.xxhash64(x, *[F.get("_h", i + k) for k in range(1, 5)])
    d = d.withColumn("_g", F.transform(F.slice("_h", F.lit(1), F.greatest(F.lit(0), F.size("_h") - 4)), window))
    same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
    d = d.withColumn("_s", F.when(F.size("_g") > F.size(F.array_distinct("_g")), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    d = d.withColumn("_p", F.sort_array(F.filter(F.transform("_s", lambda e, j: F.when(same(e, F.get("_s", j - 1)) | same(e, F.get("_s", j + 1)), e["i"])), lambda x: x.isNotNull())))
    repeated = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - x, F.lit(5))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("_l", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return d.select(
        *[c for c in d.columns if c not in ("_h", "_g", "_s", "_p", "_l", "n_words")],
        "n_words",
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each normalised line of a text: hash and words, with the text's keys and its document."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select("host", "_doc", *text_key(F.col("text")), F.explode(F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("n")))).alias("_x")).select("host", "_doc", "_k1", "_k2", "_x.line", "_x.n")


def _keyed(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """text, host and _doc, the hash that tells documents apart, of docs(doc_id, text, host)."""
    if limits.by not in ("documents", "texts"):
        raise ValueError("documents are told apart by 'documents' or by 'texts'")
    return docs.select("text", "host", F.xxhash64("doc_id" if limits.by == "documents" else "text").alias("_doc"))


def frequent_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, host); text and host without nulls. Returns (host, line) of the boilerplate lines, and their
    occurrences (host, _k1, _k2, line, n), the latter written to the shared folder."""
    docs = _keyed(docs, limits)
    top = docs.select("host", "_doc").distinct().groupBy("host").agg(F.count("*").alias("_docs")).select("host", F.greatest(F.lit(float(limits.min_docs)), F.col("_docs") * limits.share).alias("_top"))
    lines = _lines(docs)
    often = lines.groupBy("host", "line").agg(F.count("*").alias("_n")).filter(F.col("_n") > limits.min_docs).join(top, "host").filter(F.col("_n") > F.col("_top")).select("host", "line", "_top")
    often = materialize(often, "often")
    # a few short rows as a rule, joined with the hottest lines there are: beyond this size a sort-merge join, which adaptive execution splits
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    held = materialize(lines.join(often, ["host", "line"]).groupBy("host", "line", "_k1", "_k2", "_doc", "_top").agg(F.sum("n").alias("n")), "frequent-lines")
    found = held.select("host", "line", "_doc", "_top").distinct().groupBy("host", "line", "_top").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > F.col("_top")).select("host", "line")
    return found, held


def removed_words(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """host, _k1, _k2, removed: words in boilerplate lines, of each text that has any.

    Held occurrences are summed over equal rows of the corpus; a text's own count is the sum
    divided by the number of those rows, which every line of a text shares."""
    found, held = frequent_lines(docs, limits)
    rows = docs.groupBy("host", *text_key(F.col("text"))).agg(F.count("*").alias("_copies"))
    got = held.join(found, ["host", "line"]).groupBy("host", "_k1", "_k2").agg(F.sum("n").alias("_removed"))
    return got.join(rows, ["host", "_k1", "_k2"]).select("host", "_k1", "_k2", F.expr("_removed div _copies").alias("removed"))


def judge(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """doc_id, base columns, base_failed, removed_words, kept for every row of docs."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    removed = removed_words(d, limits)
    base = base_rules(d.select("doc_id", "host", *text_key(F.col("text")), "text")).drop("text")
    out = base.join(removed, ["host", "_k1", "_k2"], "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    sound = (left >= limits.min_words) & (left >= F.lit(limits.min_left) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & sound).alias("kept"), "removed_words")


def without_boilerplate(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """docs with clean_text: the text without the boilerplate lines of its host."""
    d = docs.withColumn("host", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("_t", F.coalesce("text", F.lit("")))
    plain = d.select("doc_id", F.col("_t").alias("text"), "host")
    found, held = frequent_lines(plain, limits)
    drop = held.join(found, ["host", "line"]).groupBy("host", "_k1", "_k2").agg(F.collect_set("line").alias("_drop"))  # lines of one text
    k1, k2 = text_key(F.col("_t"))
    lines = F.split("_t", "\n", -1)
    clean = F.array_join(F.filter(lines, lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.coalesce(F.array_contains(F.col("_drop"), F.xxhash64(normalised(x))), F.lit(False)))), "\n")
    return d.withColumns({"_k1": k1, "_k2": k2}).join(drop, ["host", "_k1", "_k2"], "left").withColumn("clean_text", clean).drop("host", "_t", "_k1", "_k2", "_drop")


def op8(docs: DataFrame) -> DataFrame:
    return judge(docs)


#: DuckDB twin of op8 under the default limits.
ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
t as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
word as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i from t),
five as (select rid, i, lead(i, 4) over p as last, concat_ws(' ', w, lead(w, 1) over p, lead(w, 2) over p, lead(w, 3) over p, lead(w, 4) over p) as g from word window p as (partition by rid order by i)),
again as (select rid, i from (select *, count(*) over (partition by rid, g) as c from five where last is not null) where c > 1),
rep as (select rid, count(distinct i + k.range) as n from again, range(5) k group by rid),
line as (select rid, doc_id, host, l, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n
         from (select rid, doc_id, host, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
top as (select host, greatest(20.0, 0.02 * count(distinct coalesce(doc_id, -1))) as lim from d group by host),
often as (select host, norm from line join top using (host) group by host, norm, lim having count(distinct coalesce(doc_id, -1)) > lim),
gone as (select rid, sum(n) as n from line join often using (host, norm) group by rid),
dup as (select rid, count(*) - count(distinct l) as n from line group by rid),
base as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
         cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as removed_words
         from d join t using (rid) left join rep using (rid) left join dup using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - removed_words >= 10 and n_words - removed_words >= 0.3 * n_words as kept, removed_words
from base
"""

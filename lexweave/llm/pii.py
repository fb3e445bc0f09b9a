"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal them.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Every value
found is a protected entity, and so are the group it belongs to (mail domain, network, card issuer,
dialling code) and its kind, which score the values that are too rare by themselves. The window of
co-occurrence is the line that holds the value; for values and groups the lines before and after it,
if they hold no value, are a second one. With N lines, n(e) windows of entity e, n(t) lines holding
term t and n(t,e) windows of e holding t, a term discloses the share

    ln(n(t,e) N / (n(t) n(e))) / ln(N / n(e))

of the entity's information (1: the term determines the entity). An entity and term that meet around at
least `support` different lines of the entity (all of its lines if there are two) and share at least
`disclosure` make the term revealing; its occurrences are added as spans of kind `term` wherever it
occurs, and are generalised to <TERM> where the base spans are generalised to <EMAIL>, <IP>, <CARD>
and <PHONE>. Copies of a line support nothing, so copied documents do not make their rare words
revealing. Terms of fewer than `min_letters` letters are never revealing.

Only DataFrame functions are used. Counts of terms are combined before each shuffle; revealing
terms and the texts that hold them are joined by key, without collecting either.

Patterns are written with possessive runs and a look-behind that keep the scan linear on huge
tokens, and match what the plain patterns match. Defined results: null text is empty; repeated rows
are each reported; an empty table gives an empty result; spans are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.line_quality import text_key
from lexweave.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text can hold a match only if it matches this.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM_SPLIT = r"[^\p{L}]+"
_NO_SPANS = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string>>)"
#: Elements of an array worked on at once; rows of a small table that may be broadcast (some 100 bytes each).
_BLOCK = 256
_BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class DisclosureLimits:
    support: int = 3
    disclosure: float = 0.9
    min_letters: int = 3


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running op(...) of an array, op associative with zero. Works in blocks of _BLOCK elements, so that
    what is copied grows as n ** 1.5 at most."""
    plain = lambda x, at: F.aggregate(x, F.array(at), lambda a, v: F.concat(a, F.array(op(F.element_at(a, -1), v))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    ahead = plain(F.transform(blocks, lambda x: F.aggregate(x, zero, op)), zero)
    long = F.flatten(F.zip_with(blocks, F.slice(ahead, F.lit(1), F.size(blocks)), lambda x, at: F.slice(plain(x, at), F.lit(2), F.lit(_BLOCK))))
    return F.when(F.size(values) > _BLOCK, long).otherwise(F.slice(plain(values, zero), F.lit(2), F.greatest(F.size(values), F.lit(0))))


def add_spans(df: DataFrame, text: str, kind: str, pattern: Column | str, out: str, when: Column | None = None) -> DataFrame:
    """Adds out: array of (start, rank, kind, end, value) of the matches of pattern, valid ones only.

    Splitting by the pattern gives the gaps between the matches; ends are running sums of gap
    and match lengths. No filter may stand on the result before it is written or joined: it
    would be pushed below and repeat the work for every element.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, regex, F.lit(0))
    has = F.regexp_like(text, regex) if when is None else when & F.regexp_like(text, regex)
    df = df.withColumn("_m", F.when(has, found))
    df = df.withColumn("_n", F.when(F.size("_m") > 0, F.zip_with("_m", F.slice(F.split(text, regex, -1), F.lit(1), F.size("_m")), lambda m, g: F.struct((F.length(g) + F.length(m)).alias("both"), F.length(m).alias("own")))))
    df = df.withColumn("_b", F.col("_n.both"))
    df = df.withColumn("_e", F.when(F.col("_b").isNotNull(), running(F.col("_b"), lambda x, y: x + y, F.lit(0))))
    rank = KINDS.index(kind)
    spans = F.zip_with("_m", F.zip_with("_e", "_n", lambda e, n: F.struct((e - n["own"]).alias("s"), e.alias("e"))), lambda m, p: F.struct(p["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["e"].alias("end"), m.alias("value")))
    spans = F.filter(spans, lambda x: _valid(kind, x["value"]))
    return df.withColumn(out, F.coalesce(spans, F.expr(_NO_SPANS))).drop("_m", "_n", "_b", "_e")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _email, _ip, _card, _phone: arrays of spans. text must not be null."""
    for kind, pattern in PATTERNS.items():
        hint = _HINT[kind]
        docs = add_spans(docs, text, kind, pattern, f"_{kind}", None if hint is None else F.contains(F.col(text), F.lit(hint)))
    return docs


def _terms(line: Column, limits: DisclosureLimits) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(line), TERM_SPLIT, -1), lambda x: F.length(x) >= limits.min_letters))


def _entities(x: Column) -> list[Column]:
    """The value, the group it belongs to (domain, network, issuer, dialling code) and its kind."""
    kind, value = x["kind"], x["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = F.when(kind == "email", F.lower(F.substring_index(value, "@", -1))).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    return [F.concat_ws(":", kind, value), F.concat_ws("~", kind, group), kind]


def revealing_terms(docs: DataFrame, limits: DisclosureLimits = DisclosureLimits()) -> DataFrame:
    """term, disclosure: terms that reveal some protected entity of docs(text)."""
    rule = r"@|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){11}"
    d = docs.filter(F.col("text").rlike(rule)).select(F.split("text", "\n", -1).alias("_l"))
    around = lambda i: F.concat_ws("\n", *[F.when(~F.get("_l", i + k).rlike(rule), F.get("_l", i + k)) for k in (-1, 1)])
    sites = F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(rule), F.struct(x.alias("line"), around(i).alias("near")))), lambda x: x.isNotNull())
    held = base_spans(d.select(F.explode(sites).alias("_x")).select("_x.line", "_x.near"), "line")
    held = held.withColumn("_all", F.concat(*[f"_{k}" for k in PATTERNS]))
    # terms are taken from the line without its base spans, of which e-mail addresses alone hold letters
    bare = F.regexp_replace("line", PATTERNS["email"], " ")
    names = F.array_distinct(F.flatten(F.transform("_all", lambda x: F.array(*_entities(x)))))
    held = held.select(F.xxhash64("line").alias("line"), names.alias("entities"), _terms(bare, limits).alias("terms"), _terms(F.col("near"), limits).alias("near"))
    held = materialize(held.withColumn("near", F.when(F.size("entities") > 0, F.col("near"))), "entity-lines")
    own = held.filter(F.size("entities") > 0).select("line", F.explode("entities").alias("entity"), "terms")
    beside = held.filter(F.size("near") > 0).select("line", F.explode("entities").alias("entity"), F.col("near").alias("terms")).filter(~F.col("entity").isin(*PATTERNS))
    met = own.unionByName(beside.withColumn("entity", F.concat(F.lit("beside "), "entity")))
    known = met.groupBy("entity", "line").agg(F.count("*").alias("c")).groupBy("entity").agg(F.sum("c").alias("n_e"), F.count("*").alias("lines"))
    # an entity seen in one line alone (or its copies) has no support of its own; its group and its kind do
    known = materialize(known.filter(F.col("lines") > 1).select("entity", "n_e", F.least(F.lit(limits.support), "lines").alias("need")), "entities")
    pairs = met.join(_sized(known.select("entity")), "entity", "left_semi").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter("n_te > 1")
    pairs = materialize(pairs.join(_sized(known), "entity").filter(F.col("n_te") >= F.col("need")), "term-pairs")
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    counts = lines.select(F.explode(_terms(F.col("line"), limits)).alias("term")).join(_sized(pairs.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.sum(F.size(F.split("text", "\n", -1))).alias("n_all"))
    together = F.least("n_te", "n_t")  # a line between two lines of an entity is beside it twice
    share = F.log(together * F.col("n_all") / (F.col("n_t") * F.col("n_e"))) / F.log(F.col("n_all") / F.col("n_e"))
    likely = pairs.join(counts, "term").join(F.broadcast(total)).filter(F.col("n_all") > F.col("n_e")).select("entity", "term", "need", share.alias("disclosure"))
    likely = materialize(likely.filter(F.col("disclosure") >= limits.disclosure), "likely-terms")
    # few are left: their support is counted by different lines
    sure = met.join(_sized(likely.select("entity").distinct()), "entity", "left_semi").select("entity", "line", F.explode("terms").alias("term")).join(_sized(likely), ["entity", "term"])
    sure = sure.select("entity", "term", "need", "disclosure", "line").distinct().groupBy("entity", "term", "need", "disclosure").agg(F.count("*").alias("d")).filter(F.col("d") >= F.col("need"))
    return sure.groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _sized(side: DataFrame) -> DataFrame:
    """side, to be broadcast if it has few rows; its rows are a few short values each."""
    side = side if side.inputFiles() else materialize(side, "side")
    return F.broadcast(side) if side.count() <= _BROADCAST_ROWS else side


def find(docs: DataFrame, limits: DisclosureLimits = DisclosureLimits()) -> DataFrame:
    """docs (text null: empty) with _email, _ip, _card, _phone and _term: arrays of spans."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    reveal = materialize(revealing_terms(d.select("text"), limits), "revealing-terms")
    if reveal.isEmpty():
        return base_spans(d).withColumn("_term", F.expr(_NO_SPANS))
    k1, k2 = text_key(F.col("text"))
    held = d.select(k1, k2, F.explode(_terms(F.col("text"), limits)).alias("term")).join(_sized(reveal.select("term")), "term").groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("term")).alias("_terms"))  # terms of one text
    d = base_spans(d).withColumns({"_k1": k1, "_k2": k2}).join(held, ["_k1", "_k2"], "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    return add_spans(d, "text", "term", pattern, "_term", F.col("_terms").isNotNull()).drop("_k1", "_k2", "_terms")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, limits: DisclosureLimits = DisclosureLimits()) -> DataFrame:
    """docs with text generalised: every span, overlapping ones merged into the first, becomes <KIND>.

    A null text stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # kept whole: its names may be those used here
    d = find(docs.select(row, "text", F.col("text").isNull().alias("_null")), limits).withColumn("_all", F.sort_array(F.concat(*[f"_{k}" for k in KINDS])))
    d = d.withColumn("_ends", F.col("_all.end"))
    d = d.withColumn("_top", running(F.col("_ends"), lambda x, y: F.greatest(x, y), F.lit(0)))
    heads = F.transform("_all", lambda x, i: F.struct(F.coalesce(F.get("_top", i - 1), F.lit(0)).alias("a"), x["start"].alias("z"), x["kind"].alias("kind")))
    d = d.withColumn("_heads", F.filter(heads, lambda x: x["z"] >= x["a"]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_heads") - 1) / _BLOCK).cast("int")), lambda b: F.slice("_heads", b * _BLOCK + 1, F.lit(_BLOCK)))
    # the text of a block of spans is cut out once, then the pieces between its spans
    whole = lambda x: F.struct(x.alias("x"), x[0]["a"].alias("a"), F.substring(F.col("text"), x[0]["a"] + 1, F.element_at(x, -1)["z"] - x[0]["a"]).alias("part"))
    piece = lambda w, x: F.concat(F.substring(w["part"], x["a"] - w["a"] + 1, x["z"] - x["a"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
    d = d.withColumn("_whole", F.when(F.size("_heads") > 0, F.transform(blocks, whole)))
    d = d.withColumn("_parts", F.transform("_whole", lambda w: F.array_join(F.transform(w["x"], lambda x: piece(w, x)), "")))
    done = F.concat(F.array_join("_parts", ""), F.substring(F.col("text"), F.element_at("_top", -1) + 1, F.length("text")))
    text = F.when(F.col("_null"), F.lit(None)).when(F.size("_heads") > 0, done).otherwise(F.col("text"))
    return d.withColumn("_row", F.col("_row").withField("text", text)).select("_row.*")


def op4(docs: DataFrame) -> DataFrame:
    d = find(docs.select("doc_id", "text"))
    base = F.concat(*[f"_{k}" for k in PATTERNS])
    return d.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("_term"))).alias("spans"), F.size("_term").cast("long").alias("n_term"))

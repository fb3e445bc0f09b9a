"""Queries of the term store, alias life cycle, look-up, cards, discovery and evaluation over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import aliases, cards, discovery, evaluation, lookup, ordered, terms
from lexweave.session import table
from lexweave.sources import guide, lexicons, subtitles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AT = ["doc_id", "cue_index"]
CUES = "SELECT conv_id AS doc_id, turn AS cue_index, role, text FROM conversations"
ACTS = "SELECT user_id AS doc_id, event_type AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cue_index, value FROM events"
#: Lists for the part names, which are Latin words.
LATIN = aliases.AliasWords(linkers=(" ",), blocked_first=("s",), blocked_last=("t",), blocked=("rin",), basic=("tiny",), ambiguous=("red", "blu"), common=("dget", "ring"), letter="[a-z]", set_mark="kit", joint=" ", set_category="ECONOMY", piece_category="SMALL", weapon_category="MEDIUM", categories=("ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("cue_index"), "role", "text")


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("entity"), (F.row_number().over(w) - 1).cast("long").alias("cue_index"), "value")


def _part(spark: SparkSession, sf_dir: str, *cols) -> DataFrame:
    return table(spark, sf_dir, "part").select(*cols)


# ---- term store ----------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT p_partkey, p_name AS term, p_brand || '||' || p_type AS aliases, CASE WHEN p_size % 5 = 0 THEN 'food' ELSE 'tool' END AS category, CASE WHEN p_size % 7 = 0 THEN 'n/a' WHEN p_size % 11 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END AS trust, CASE WHEN p_size % 3 = 0 THEN 'P' ELSE '' END AS parent FROM part)
    SELECT term, category, CASE WHEN category = 'food' AND parent = '' THEN split_part(aliases, '||', 1) ELSE parent END AS parent, CASE WHEN category = 'food' AND parent = '' THEN '' ELSE replace(aliases, '||', ',') END AS aliases,
    CASE WHEN trust = ' ' THEN 0.5::double ELSE CAST(trust AS DOUBLE) END AS trust, count(*) AS n FROM r WHERE trust <> 'n/a' GROUP BY ALL"""
)
def term_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    trust = F.when(size % 7 == 0, "n/a").when(size % 11 == 0, " ").otherwise(size.cast("string"))
    rows = _part(spark, sf_dir, F.concat(F.lit(" "), "p_name").alias("term"), F.concat("p_brand", F.lit("| |"), "p_type").alias("aliases"), F.when(size % 5 == 0, "food").otherwise("tool").alias("category"), F.lit(None).cast("string").alias("game_title"), F.lit("x").alias("source"), trust.alias("trust_level"), F.when(size % 3 == 0, "P").alias("parent_entity"))
    d = terms.imported(rows)
    return d.groupBy("term", "category", "parent", F.array_join("aliases", ",").alias("aliases"), "trust").agg(F.count("*").alias("n"))


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = _part(spark, sf_dir, F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_brand").alias("parent"), F.col("p_retailprice").alias("trust"))
    more = _part(spark, sf_dir, F.col("p_partkey").alias("term_id"), F.explode(F.split("p_name", " ")).alias("alias"), F.lit("manual").alias("alias_type"))
    return terms.migrate(old), more.distinct()


@query("SELECT p_partkey AS term_id, p_name AS term, list_aggregate(list_sort(list_distinct(string_split(p_name, ' '))), 'string_agg', ',') AS aliases FROM part")
def term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.listed(*_store(spark, sf_dir)).select("term_id", "term", F.array_join("aliases", ",").alias("aliases"))


MERGED = """WITH o AS (SELECT p_partkey term_id, p_name term, p_type category, p_brand parent, p_retailprice trust FROM part),
    i AS (SELECT p_name term, p_type category, p_brand parent, p_size::double trust, p_partkey seq FROM part UNION ALL SELECT s_name, 'supplier', NULL, s_acctbal, s_suppkey FROM supplier UNION ALL SELECT s_name, 'supplier', '', s_acctbal + 1, s_suppkey + 1000000 FROM supplier),
    l AS (SELECT term, category, coalesce(parent, '') parent, arg_max(trust, seq) trust FROM i GROUP BY ALL),
    j AS (SELECT term_id, coalesce(o.term, l.term) term, coalesce(o.category, l.category) category, coalesce(o.parent, l.parent) parent, coalesce(l.trust, o.trust) trust FROM o FULL JOIN l ON o.term = l.term AND o.category = l.category AND o.parent = l.parent),
    m AS (SELECT coalesce(term_id, (SELECT max(p_partkey) FROM part) + row_number() OVER (PARTITION BY term_id IS NULL ORDER BY term, category, parent)) term_id, term, category, parent, trust FROM j)"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    of = lambda d, *c: d.select(*c[:3], F.lit("").alias("game"), F.lit("in").alias("source"), *c[3:])
    p = of(table(spark, sf_dir, "part"), F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_brand").alias("parent"), F.col("p_size").cast("double").alias("trust"), F.split("p_name", " ").alias("aliases"), F.col("p_partkey").alias("seq"))
    s = table(spark, sf_dir, "supplier")
    a = of(s, F.col("s_name").alias("term"), F.lit("supplier").alias("category"), none.alias("parent"), F.col("s_acctbal").alias("trust"), F.array(F.lower("s_name"), F.lit("")).alias("aliases"), F.col("s_suppkey").alias("seq"))
    b = of(s, F.col("s_name").alias("term"), F.lit("supplier").alias("category"), F.lit("").alias("parent"), (F.col("s_acctbal") + 1).alias("trust"), F.array(F.lower("s_name")).alias("aliases"), (F.col("s_suppkey") + 1000000).alias("seq"))
    return terms.merged(*_store(spark, sf_dir), p.unionByName(a).unionByName(b))


@query(MERGED + " SELECT term_id, term, category, parent, trust FROM m")
def term_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("term_id", "term", "category", "parent", "trust")


@query(MERGED + " SELECT DISTINCT p_partkey AS term_id, unnest(string_split(p_name, ' ')) AS alias FROM part UNION SELECT m.term_id, unnest(string_split(p.p_name, ' ')) FROM m JOIN part p ON m.term = p.p_name AND m.category = p.p_type AND m.parent = p.p_brand UNION SELECT term_id, lower(term) FROM m WHERE category = 'supplier'")
def term_merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1].select("term_id", "alias")


@query("SELECT doc_id, cue_index, CASE WHEN contains(text, 'tion') THEN 'tion' END AS selected, '[{\"value\":\"tion\"}]' AS candidates, NULL::boolean AS accepted FROM (" + CUES + ")")
def term_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cues(spark, sf_dir).select(*AT, F.col("text").alias("raw_text"), F.replace("text", F.lit("tion"), F.lit("sion")).alias("corrected_text"), F.array(F.struct(F.lit("tion").alias("value"))).alias("candidates"), F.lit("tion").alias("selected"), F.lit(1.0).alias("confidence"))
    return terms.history(d).select(*AT, "selected", "candidates", "accepted")


@query("SELECT p_partkey, max(b.parent) AS parent_entity FROM part LEFT JOIN (SELECT p_name AS surface, max(p_brand) AS parent FROM part GROUP BY p_name) b ON p_name = b.surface GROUP BY p_partkey")
def term_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _part(spark, sf_dir, F.col("p_name").alias("surface"), "p_brand").groupBy("surface").agg(F.max("p_brand").alias("parent"))
    known = terms.parents(d)
    return terms.with_parent(_part(spark, sf_dir, "p_partkey", F.col("p_name").alias("term")), d.join(known, "parent", "left_semi")).select("p_partkey", "parent_entity")


# ---- alias files ---------------------------------------------------------------------------


@query("SELECT url FROM pages")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    lines = table(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("  "), url), F.lit(""), F.concat(F.lit("# "), url), F.lit("   "), F.lit(" #x"))).alias("value"))
    return lexicons.source_urls(lines)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in the columns of an alias file, all strings."""
    size = F.col("p_size")
    return _part(
        spark, sf_dir, F.concat(F.split("p_name", " ")[0], F.lit(" ")).alias("alias_surface"), F.when(size % 13 == 0, "").when(size % 17 == 0, F.split("p_name", " ")[0]).otherwise(F.col("p_name")).alias("canonical_term"),
        F.when(size % 11 == 0, "other").when(size % 2 == 0, "spoken_alias").alias("alias_type"), F.when(size % 3 == 0, "approved").when(size % 3 == 1, "needs_context").alias("review_status"),
        F.when(size % 4 == 0, "").otherwise((size / 50).cast("string")).alias("confidence"), F.lit("3").alias("evidence_count"), F.concat_ws("|", F.when(size % 7 == 0, "ambiguous_alias"), F.lit(" "), F.lit("unique_suffix")).alias("risk_flags"),
        F.when(size % 5 == 0, "blocked").when(size % 5 < 3, "context_only").otherwise("needs_context").alias("usage_policy"), F.when(size % 2 == 0, aliases.PRIMARY).otherwise(aliases.SECONDARY).alias("alias_kind"), F.col("p_partkey").alias("row_id"),
    )


ROWS = """SELECT split_part(p_name, ' ', 1) AS s, CASE WHEN p_size % 13 = 0 THEN '' WHEN p_size % 17 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS c, CASE WHEN p_size % 11 = 0 THEN 'other' WHEN p_size % 2 = 0 THEN 'spoken_alias' ELSE 'asr_alias' END AS t,
    CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_context' ELSE 'pending' END AS st, CASE WHEN p_size % 4 = 0 THEN 0.5::double ELSE p_size / 50.0::double END AS conf, p_size % 7 = 0 AS amb,
    CASE WHEN p_size % 5 = 0 THEN 'blocked' WHEN p_size % 5 < 3 THEN 'context_only' ELSE 'needs_context' END AS pol, CASE WHEN p_size % 2 = 0 THEN 'term_short_primary' ELSE 'term_short_secondary' END AS kind, p_partkey AS id FROM part"""


@query(f"SELECT CASE WHEN s = c THEN 'surface is the canonical term' WHEN t = 'other' THEN 'unknown alias type other' END AS error, st AS review_status, count(*) AS n, round(sum(conf), 6) AS confidence FROM ({ROWS}) WHERE c <> '' GROUP BY ALL")
def alias_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lexicons.alias_candidates(_rows(spark, sf_dir))
    return d.groupBy("error", "review_status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"SELECT s AS surface, c AS canonical, kind, pol AS policy FROM ({ROWS}) WHERE c <> '' AND pol <> 'blocked' QUALIFY row_number() OVER (PARTITION BY s ORDER BY id DESC) = 1")
def spoken_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.spoken_lexicon(_rows(spark, sf_dir))


@query(f"SELECT s AS surface, c AS canonical, conf AS confidence, CASE WHEN length(s) >= 4 THEN 'nickname' ELSE 'team_slot' END AS slot FROM (SELECT * REPLACE (CASE WHEN length(s) >= 4 THEN s ELSE left(s, 1) END AS s) FROM ({ROWS})) WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY s ORDER BY id DESC) = 1")
def character_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir).withColumn("alias_surface", F.trim("alias_surface"))
    r = r.withColumn("alias_surface", F.when(F.length("alias_surface") >= 4, F.col("alias_surface")).otherwise(F.substring("alias_surface", 1, 1)))
    return lexicons.character_lexicon(r).select("surface", "canonical", "confidence", "slot")


@query(f"SELECT st AS review_status, count(*) AS n FROM ({ROWS}) WHERE c <> '' AND st <> 'pending' GROUP BY 1")
def asr_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.asr_runtime(lexicons.alias_candidates(_rows(spark, sf_dir))).groupBy("review_status").agg(F.count("*").alias("n"))


@query(
    f"""SELECT CASE WHEN st <> 'pending' THEN st WHEN amb THEN 'needs_context' WHEN conf >= 0.85 THEN 'approved' ELSE 'pending' END AS review_status, CASE WHEN amb THEN 'ambiguous_alias' ELSE 'term_short_alias' END AS alias_kind,
    CASE WHEN amb THEN 'needs_context' ELSE 'context_only' END AS usage_policy, count(*) AS n FROM ({ROWS}) GROUP BY ALL"""
)
def alias_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("confidence") == "", 0.5).otherwise(F.col("confidence").try_cast("double"))
    return aliases.routed(_rows(spark, sf_dir).withColumn("confidence", conf)).groupBy("review_status", "alias_kind", "usage_policy").agg(F.count("*").alias("n"))


CLEANED = f"""WITH r AS (SELECT s, coalesce(nullif(c, ''), 'none') c, kind, pol, amb, id FROM ({ROWS})), p AS (SELECT c, count(*) n, min(s) least_s FROM r WHERE kind = 'term_short_primary' GROUP BY c),
    d AS (SELECT r.*, coalesce(n > 1, false) several, s IN ('dget', 'ring') common, coalesce(n > 1 AND kind = 'term_short_primary' AND s = least_s, false) kept, kind LIKE '%secondary%' sec FROM r LEFT JOIN p USING (c)),
    e AS (SELECT *, NOT sec AND (amb OR common OR (several AND NOT kept)) dem FROM d),
    f AS (SELECT id, s, c, CASE WHEN sec THEN 2 WHEN dem AND amb AND NOT common THEN 3 WHEN dem THEN 2 ELSE 1 END tier, CASE WHEN dem THEN 'term_short_secondary' ELSE kind END kind, pol,
      CASE WHEN dem THEN (CASE WHEN amb THEN 'ambiguous_alias|' ELSE '' END) || 'needs_review|unique_suffix' ELSE (CASE WHEN amb THEN 'ambiguous_alias|' ELSE '' END) || 'unique_suffix' END flags FROM e)"""


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.regexp_replace("risk_flags", r"\| \|", "|")
    r = _rows(spark, sf_dir).withColumn("alias_surface", F.trim("alias_surface")).withColumn("canonical_term", F.coalesce(F.nullif("canonical_term", F.lit("")), F.lit("none"))).withColumn("risk_flags", F.regexp_replace(flags, r"^ \|", ""))
    return aliases.cleaned(r, LATIN)


@query(CLEANED + " SELECT id AS row_id, tier, kind AS alias_kind, CASE WHEN tier > 1 THEN 'exact_context_only' ELSE pol END AS usage_policy, flags AS risk_flags FROM f")
def alias_clean_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("row_id", "tier", "alias_kind", "usage_policy", "risk_flags")


@query(CLEANED + " SELECT s AS alias_surface, c AS canonical_term, flags AS reason, '" + aliases.REVIEW_CHOICES + "' AS suggestion FROM f WHERE tier = 3")
def alias_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.review_list(_clean(spark, sf_dir))


@query("SELECT p_partkey AS term_id, CASE WHEN p_size % 2 = 0 THEN 'short' ELSE 'short_x' END AS alias_type FROM part")
def alias_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "short_draft").otherwise("short_x")
    return aliases.approved(_part(spark, sf_dir, F.col("p_partkey").alias("term_id"), kind.alias("alias_type")))


MINED = """WITH t AS (SELECT p_name term, min(p_partkey) seq FROM part GROUP BY 1), x AS (SELECT DISTINCT p_name term, p_type category FROM part),
    c AS (SELECT term, category, right(term, 3) a FROM x UNION ALL SELECT term, category, right(term, 2) FROM x UNION ALL SELECT term, category, left(term, 2) FROM x UNION ALL SELECT term, category, left(term, 3) FROM x),
    v AS (SELECT * FROM c WHERE length(a) >= 2 AND a <> 'rin' AND NOT contains(a, ' ') AND left(a, 1) <> 's' AND right(a, 1) <> 't' AND regexp_matches(a, '[a-z]')),
    p AS (SELECT DISTINCT term, a FROM v UNION SELECT term, a || 'kit' FROM v WHERE category IN ('ECONOMY', 'SMALL')),
    o AS (SELECT a, count(*) owners, arg_min(term, seq) term FROM p JOIN t USING (term) GROUP BY a),
    e AS (SELECT a, count(*) evidence FROM o JOIN conversations ON contains(text, a) GROUP BY a HAVING count(*) >= 2),
    s AS (SELECT a, term, evidence, owners, greatest(0, least(1, CASE WHEN evidence >= 20 THEN 0.9::double WHEN evidence >= 10 THEN 0.8 WHEN evidence >= 5 THEN 0.7 WHEN evidence >= 3 THEN 0.6 ELSE 0.5 END + CASE WHEN owners = 1 THEN 0.08::double ELSE 0 END - 0.1::double * (owners - 1) + CASE WHEN suffix(term, a) THEN 0.05::double ELSE 0 END)) conf FROM o JOIN e USING (a))"""


@query(
    MINED
    + """ SELECT a AS alias, term, evidence, owners, round(conf, 2) AS confidence, concat_ws('|', CASE WHEN suffix(term, a) THEN 'unique_suffix' WHEN prefix(term, a) THEN 'unique_prefix' ELSE 'mid_substring' END, CASE WHEN owners > 1 THEN 'ambiguous_alias' END, CASE WHEN a IN ('red', 'blu') THEN 'ambiguous_prefix' END) AS risk_flags FROM s"""
)
def alias_mining_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _cues(spark, sf_dir).select((F.col("doc_id") * 100000 + F.col("cue_index")).alias("sentence_id"), F.col("text").alias("sentence"))
    t = _part(spark, sf_dir, F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_partkey").alias("seq"))
    return aliases.mined(s, t, words=LATIN).drop("examples", "review_status")


@query()
def alias_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of part names for a store that holds their words; tested against plain Python."""
    t = _part(spark, sf_dir, F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), F.col("p_type").alias("category"))
    return aliases.populated(t, _store(spark, sf_dir)[1], words=LATIN)


# ---- look-up and detection -----------------------------------------------------------------


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each part name."""
    d = _part(spark, sf_dir, F.split("p_name", " ")[0].alias("surface"), "p_name", "p_type", "p_brand", "p_partkey")
    return d.groupBy("surface").agg(F.min_by(F.struct(F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_brand").alias("parent")), "p_partkey").alias("v"), F.min("p_partkey").alias("seq")).select("surface", "v.*", "seq")


DICTIONARY = "SELECT split_part(p_name, ' ', 1) AS surface, arg_min(p_name, p_partkey) AS term, arg_min(p_type, p_partkey) AS category, arg_min(p_brand, p_partkey) AS parent, min(p_partkey) AS seq FROM part GROUP BY 1"
TOKENS = "SELECT p_partkey AS doc_id, unnest(range(0, len(string_split(p_name, ' ')))) AS cue_index, unnest(string_split(p_name, ' ')) AS token FROM part"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _part(spark, sf_dir, F.col("p_partkey").alias("doc_id"), F.posexplode(F.split("p_name", " ")).alias("cue_index", "token"))
    return d.select("doc_id", F.col("cue_index").cast("long").alias("cue_index"), "token", F.lit(0).alias("start_char"), F.length("token").alias("end_char"))


@query(
    f"""WITH s AS ({ROWS}), sp AS (SELECT s AS token, arg_max(pol, id) policy FROM s WHERE c <> '' AND pol <> 'blocked' AND id % 4 = 0 GROUP BY s), n AS (SELECT split_part(p_name, ' ', 1) token, 'nick ' || split_part(p_name, ' ', 1) nick FROM part GROUP BY ALL)
    SELECT t.doc_id, t.cue_index, CASE WHEN policy IS NOT NULL THEN t.token WHEN nick IS NOT NULL THEN nick ELSE d.term END AS value, CASE WHEN policy = 'context_only' THEN 'context_alias' ELSE 'repair_candidate' END AS intent,
    CASE WHEN policy = 'context_only' THEN 'known_alias' WHEN policy IS NULL AND nick IS NOT NULL THEN 'character_nickname' ELSE 'exact_term' END AS evidence_type
    FROM ({TOKENS}) t JOIN ({DICTIONARY}) d ON t.token = d.surface LEFT JOIN sp USING (token) LEFT JOIN n USING (token)"""
)
def exact_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark, sf_dir)
    spoken = lexicons.spoken_lexicon(_rows(spark, sf_dir).withColumn("usage_policy", F.when(F.col("row_id") % 4 == 0, F.col("usage_policy")).otherwise("blocked")))
    nick = d.select("surface", F.concat(F.lit("nick "), "surface").alias("canonical"))
    return lookup.exact(_tokens(spark, sf_dir), d, spoken, nick).select(*AT, "value", "intent", "evidence_type")


@query(
    f"""WITH c AS (SELECT t.doc_id, t.cue_index, t.token surface, d.term value FROM ({TOKENS}) t JOIN ({DICTIONARY}) d ON t.token = d.surface)
    SELECT * FROM c WHERE NOT (surface = 'red' AND value <> 'red') AND NOT EXISTS (SELECT 1 FROM ({DICTIONARY}) p WHERE p.category = 'ECONOMY' AND value = p.term AND contains(c.surface, p.surface) AND length(p.surface) >= 2)"""
)
def protected_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark, sf_dir)
    c = _tokens(spark, sf_dir).join(d, F.col("token") == F.col("surface")).select(*AT, "surface", F.col("term").alias("value"))
    return lookup.unprotected(c, spark.createDataFrame([("red",)], "surface string"), d.filter("category = 'ECONOMY'").select("surface", F.col("term").alias("canonical")))


@query(
    """WITH a AS (SELECT n_name entity, n_regionkey / 4.0::double w FROM nation), c AS (SELECT s_suppkey, s_acctbal / 100 AS score, n_name parent FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, round(CASE WHEN w > 0 THEN least(score + w * 0.15::double * 100, 100) ELSE score END, 6) AS score FROM c LEFT JOIN a ON parent = entity"""
)
def entity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", (F.col("s_acctbal") / 100).alias("score"), F.col("n_name").alias("parent"))
    return lookup.boosted(rows, n.select(F.col("n_name").alias("entity"), (F.col("n_regionkey") / 4.0).alias("weight"))).select("s_suppkey", F.round("score", 6).alias("score"))


@query(
    """WITH u AS (SELECT l_orderkey doc_id, l_returnflag || l_linestatus AS value, l_discount AS score FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus || l_returnflag, l_tax FROM lineitem), b AS (SELECT doc_id, value, max(score) score FROM u GROUP BY ALL)
    SELECT doc_id, value, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, value) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, value) <= 3"""
)
def composite_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    at = [F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("cue_index")]
    a = li.select(*at, F.concat("l_returnflag", "l_linestatus").alias("value"), F.col("l_discount").alias("score"))
    b = li.select(*at, F.concat("l_linestatus", "l_returnflag").alias("value"), F.col("l_tax").alias("score"))
    return lookup.best_of(a, b, k=3).select("doc_id", "value", "score", "rank")


@query(
    f"""WITH r AS (SELECT s, c, st FROM ({ROWS}) WHERE c <> '' AND st <> 'pending' GROUP BY ALL), t AS ({TOKENS}), a AS (SELECT DISTINCT p_partkey doc_id, p_name entity FROM part WHERE p_size > 25)
    SELECT t.doc_id, t.cue_index, t.token AS surface, c AS value, count(*) AS n FROM t JOIN r ON t.token = r.s WHERE st = 'approved' OR EXISTS (SELECT 1 FROM a WHERE a.doc_id = t.doc_id AND a.entity = c) GROUP BY ALL"""
)
def misheard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lexicons.asr_runtime(lexicons.alias_candidates(_rows(spark, sf_dir))).select("alias_surface", "canonical_term", "review_status").distinct().withColumn("confidence", F.lit(0.9))
    active = _part(spark, sf_dir, F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("entity"), "p_size").filter("p_size > 25")
    return lookup.misheard(_tokens(spark, sf_dir).withColumnRenamed("token", "surface"), r, active).groupBy(*AT, "surface", "value").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT DISTINCT n_name || '_x' AS text, n_nationkey AS doc_id FROM nation), v AS (SELECT r_name AS value, r_regionkey / 4.0::double AS score FROM region),
    w AS (SELECT doc_id, value, score, text, unnest(range(1, greatest(1, length(text) - length(value) + 1) + 1)) i FROM c, v),
    s AS (SELECT doc_id, max((1 - levenshtein(substr(text, i, length(value)), value) / greatest(length(substr(text, i, length(value))), length(value))) * score) AS risk FROM w GROUP BY doc_id)
    SELECT doc_id, 'entity' AS detector, 0.0::double AS risk FROM c UNION ALL SELECT doc_id, 'spelling', round(risk, 6) FROM s UNION ALL SELECT doc_id, 'terms', (SELECT max(score) FROM v) FROM c"""
)
def detector_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cues = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("cue_index"), F.concat("n_name", F.lit("_x")).alias("text"))
    values = r.select(F.col("r_name").alias("value"), (F.col("r_regionkey") / 4.0).alias("score"))
    c = cues.select(*AT, F.lit(1).alias("k")).join(values.withColumn("k", F.lit(1)), "k").drop("k")  # five names for each cue
    d = lookup.Detectors().add("spelling", lambda x: lookup.spelling_risk(x, c)).add("terms", lambda x: lookup.term_risk(x, c)).add("entity", lookup.entity_risk)
    return d.run(cues).select("doc_id", "detector", F.round("risk", 6).alias("risk"))


@query(
    f"""WITH d AS ({DICTIONARY}), g AS (SELECT DISTINCT doc_id, cue_index, d.surface FROM ({CUES}) JOIN d ON contains(lower(text), d.surface) WHERE length(d.surface) = 3)
    SELECT doc_id, cue_index, surface FROM g"""
)
def surface_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lookup.windows(_cues(spark, sf_dir).withColumn("text", F.lower("text")), 3, 3)
    d = _dictionary(spark, sf_dir).filter(F.length("surface") == 3)
    return w.join(d, F.col("token") == F.col("surface")).select(*AT, "surface").distinct()


# ---- cards ---------------------------------------------------------------------------------

CARDS = f"""WITH d AS ({DICTIONARY}), r AS (SELECT s, c, st, pol FROM ({ROWS}) WHERE c <> ''),
    b AS (SELECT parent entity, surface, CASE WHEN length(surface) < 4 THEN 'p' ELSE 'x' END k FROM d UNION SELECT parent, c.s, CASE WHEN c.pol = 'context_only' THEN 'p' ELSE 'x' END FROM (SELECT s, arg_max(pol, id) pol FROM ({ROWS}) WHERE c <> '' AND pol <> 'blocked' GROUP BY s) c JOIN d ON c.s = d.surface
      UNION SELECT parent, s, CASE WHEN st = 'approved' THEN 'r' ELSE 'x' END FROM r JOIN d ON r.s = d.surface WHERE st <> 'pending'),
    j AS (SELECT entity, coalesce(string_agg(surface, ',' ORDER BY surface) FILTER (k = 'p'), '') preserve, coalesce(string_agg(surface, ',' ORDER BY surface) FILTER (k = 'r'), '') repair, coalesce(string_agg(surface, ',' ORDER BY surface) FILTER (k = 'x'), '') contextual FROM b GROUP BY entity),
    t AS (SELECT p_brand entity, p_name term, min(p_partkey) seq FROM part GROUP BY ALL), rel AS (SELECT entity, term FROM t QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq, term) <= 8),
    g AS (SELECT entity, string_agg(term, ',' ORDER BY term) related FROM rel GROUP BY entity), w AS (SELECT DISTINCT p_type batch, p_brand entity FROM part),
    c AS (SELECT batch, entity, 'unknown' AS kind, preserve, repair, contextual, related, row_number() OVER (PARTITION BY batch ORDER BY entity) place FROM w JOIN j USING (entity) JOIN g USING (entity))"""


@query(CARDS + " SELECT * FROM c WHERE place <= 5")
def knowledge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark, sf_dir)
    owner = d.select("surface", F.col("parent").alias("canonical"))
    chars = owner.withColumn("slot", F.when(F.length("surface") < 4, "team_slot").otherwise("nickname"))
    spoken = lexicons.spoken_lexicon(_rows(spark, sf_dir)).drop("canonical").join(owner, "surface")
    heard = lexicons.asr_runtime(lexicons.alias_candidates(_rows(spark, sf_dir))).select(F.col("alias_surface").alias("surface"), "review_status").join(owner, "surface").select(F.col("surface").alias("alias_surface"), F.col("canonical").alias("canonical_term"), "review_status")
    buckets = cards.alias_buckets(chars, spoken, heard)
    words = _part(spark, sf_dir, F.col("p_name").alias("surface"), F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_brand").alias("parent"), F.col("p_partkey").alias("seq"))
    wanted = cards.entities_of_batch(_part(spark, sf_dir, F.col("p_type").alias("batch"), F.col("p_brand").alias("entity")), _part(spark, sf_dir, F.col("p_type").alias("batch"), F.col("p_name").alias("value"), F.col("p_brand").alias("parent")), buckets)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return cards.cards(wanted, buckets, words).select("batch", "entity", "kind", "place", *[joined(c) for c in ("preserve", "repair", "contextual", "related")])


# ---- discovery -----------------------------------------------------------------------------

DETECTED = f"""WITH s AS (SELECT doc_id, cue_index, i AS ord, w AS value FROM (SELECT doc_id, cue_index, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) w, unnest(range(0, len(regexp_extract_all(lower(text), '[a-z]{{4,}}')))) i FROM ({CUES}))),
    f AS (SELECT doc_id, cue_index, value, min(ord) ord FROM s WHERE ord % 5 <> 4 GROUP BY ALL),
    c AS (SELECT doc_id, cue_index, value, row_number() OVER (PARTITION BY doc_id, cue_index ORDER BY ord) - 1 AS place FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, cue_index ORDER BY ord) <= 4)"""


def _detect(cues: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    d = cues.select(*AT, F.posexplode(words).alias("ord", "value"))
    return d.select(*AT, "ord", F.col("value").alias("surface"), "value", F.lit(0.12345).alias("score"), F.when(F.col("ord") % 5 == 4, "pinyin_probe").otherwise("exact").alias("source"))


@query(DETECTED + " SELECT doc_id, cue_index, value, place, 0.123::double AS score FROM c")
def discovery_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.run(_cues(spark, sf_dir), _detect, 8, 2)["candidates"].select(*AT, "value", "place", "score")


@query(
    DETECTED
    + f""", p AS (SELECT doc_id, cue_index, (row_number() OVER (PARTITION BY doc_id ORDER BY cue_index) - 1) // 8 AS chunk_id FROM ({CUES})), q AS (SELECT DISTINCT doc_id, cue_index FROM c WHERE length(value) > 16),
    n AS (SELECT doc_id, chunk_id, count(*) cues, count(q.doc_id) problems FROM p LEFT JOIN q USING (doc_id, cue_index) GROUP BY doc_id, chunk_id)
    SELECT doc_id, chunk_id, cues, problems, CASE WHEN problems / cues > 0.3 THEN 1 WHEN problems / cues > 0.1 THEN 2 ELSE 3 END AS "window" FROM n"""
)
def discovery_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    return discovery.chunk_density(ordered.chunk(cues.select(*AT), 8, 2), discovery.detected(_detect(cues)).filter(F.length("value") > 16))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"confirmed_entities":[{"entity":"'), "entity", F.lit('","confidence":0.5},{"entity":""}],"possible_transition":true}'))
    a = _acts(spark, sf_dir).groupBy("doc_id", F.col("cue_index").alias("chunk_id")).agg(F.min("entity").alias("entity"))
    kind = F.col("chunk_id") % 4
    return a.select("doc_id", "chunk_id", F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(kind == 1, body).when(kind == 2, F.lit("[1]")).otherwise(F.lit("no {json")).alias("reply"))


@query(f"SELECT doc_id, cue_index AS chunk_id, cue_index % 4 < 2 AS parsed, cue_index % 4 < 2 AS transition FROM ({ACTS})")
def discovery_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.answers(_replies(spark, sf_dir)).select("doc_id", "chunk_id", F.col("answer").isNotNull().alias("parsed"), F.coalesce("answer.possible_transition", F.lit(False)).alias("transition"))


@query(f"SELECT doc_id, entity, count(*) AS n FROM ({ACTS}) WHERE cue_index % 4 < 2 GROUP BY ALL")
def discovery_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.confirmations(discovery.answers(_replies(spark, sf_dir))).groupBy("doc_id", "entity").agg(F.count("*").alias("n"))


@query(
    f"""WITH d AS ({DICTIONARY}) SELECT t.doc_id, t.cue_index, CASE WHEN d.category = 'ECONOMY' THEN 'preserve_surface' WHEN t.cue_index = 1 THEN 'given' ELSE 'repair_to_canonical' END AS expansion_policy,
    CASE WHEN t.cue_index = 1 THEN 'own' WHEN d.category = 'ECONOMY' THEN 'registry' ELSE 'default' END AS evidence_type FROM (SELECT * FROM ({TOKENS}) WHERE cue_index <> 1 OR token NOT IN (SELECT surface FROM d WHERE category = 'ECONOMY')) t LEFT JOIN d ON t.token = d.surface"""
)
def policy_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dictionary(spark, sf_dir).filter("category = 'ECONOMY'").select("surface", F.lit("preserve_surface").alias("policy"), F.lit("registry").alias("source"))
    t = _tokens(spark, sf_dir).withColumnRenamed("token", "surface").join(p.select("surface", F.lit(True).alias("own")), "surface", "left").filter("cue_index <> 1 OR own IS NULL").drop("own")
    given = F.col("cue_index") == 1
    return discovery.annotated(t.withColumn("expansion_policy", F.when(given, "given")).withColumn("evidence_type", F.when(given, "own")), p).select(*AT, "expansion_policy", "evidence_type")


@query(
    f"""WITH d AS (SELECT doc_id, entity, min(cue_index) lo, max(cue_index) hi FROM ({ACTS}) GROUP BY ALL), e AS (SELECT *, exp(-0.05::double * (max(hi) OVER (PARTITION BY doc_id) - hi)) >= 0.1 AS active FROM d)
    SELECT doc_id, entity FROM e WHERE active AND lo <= 40 AND hi >= 10"""
)
def active_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordered.temporal_memory(_acts(spark, sf_dir).withColumnRenamed("value", "confidence"))
    return discovery.active_in_region(d, 10, 40).select("doc_id", "entity")


@query("SELECT l_suppkey AS doc_id, l_linenumber AS start, l_linenumber + 1 AS \"end\", string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS items FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def uncertain_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.col("l_orderkey").alias("item"), F.when(F.col("l_returnflag") == "R", "UNCERTAIN").otherwise("COMMIT").alias("verdict"))
    return discovery.uncertain_regions(d).select("doc_id", "start", "end", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.event_summary(table(spark, sf_dir, "events"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def events_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.of_type(table(spark, sf_dir, "events"), "error").select("event_id", "user_id")


@query("WITH w AS (SELECT DISTINCT l_orderkey o, l_linenumber l, CAST(l_suppkey AS VARCHAR) term FROM lineitem), h AS (SELECT DISTINCT l_orderkey o, l_linenumber l, CAST(l_suppkey AS VARCHAR) term FROM lineitem WHERE l_returnflag = 'R') SELECT w.term, count(*) AS wanted, count(h.o) AS covered FROM w LEFT JOIN h ON w.o = h.o AND w.l = h.l AND w.term = h.term GROUP BY w.term")
def target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cue_index"), F.col("l_suppkey").cast("string").alias("term"), "l_returnflag"]
    li = table(spark, sf_dir, "lineitem").select(*at)
    return discovery.coverage(li.filter("l_returnflag = 'R'").withColumnRenamed("term", "value"), li)


@query(f"SELECT count(*) AS batches, CAST(sum(cue_index) AS BIGINT) AS candidates, max(cue_index) AS most_candidates, CAST(sum(length(text)) AS BIGINT) AS prompt_chars, max(length(text)) AS longest_prompt FROM ({CUES})")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.plan_summary(_cues(spark, sf_dir).select(F.col("cue_index").alias("candidates"), F.col("text").alias("prompt")))


@query(f"SELECT doc_id, cue_index, CASE WHEN length(text) >= 6 THEN left(text, 1) || 'X' || substr(text, 4, 1) || 'YY' || substr(text, 7) ELSE text END AS edited FROM ({CUES})")
def unguarded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    at = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.lit(3).alias("e"), F.lit("X").alias("r")), F.struct(F.lit(4).alias("s"), F.lit(6).alias("e"), F.lit("YY").alias("r")))).alias("x")
    edits = cues.filter(F.length("text") >= 6).select(*AT, at).select(*AT, F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char"), F.col("x.r").alias("replacement"))
    return discovery.apply_unguarded(cues, edits).select(*AT, "edited")


@query(f"WITH n AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY cue_index), '') s FROM ({CUES})) SELECT doc_id, cue_index, md5(CASE WHEN length(s) <= greatest(2 * length(text), length(text) + 8) THEN s ELSE text END) AS line FROM n")
def local_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cues(spark, sf_dir).withColumn("s", F.coalesce(F.lag("text").over(ordered.Window.partitionBy("doc_id").orderBy("cue_index")), F.lit("")))
    return d.select(*AT, F.md5(discovery.local_replacement(F.col("text"), F.col("s"))).alias("line"))


@query(
    f"""WITH d AS ({DICTIONARY}), c AS (SELECT p_partkey seq, p_brand || '-' || left(p_name, 3) AS surface, split_part(p_name, ' ', 1) corrected, 0.8::double + p_size / 250.0::double AS confidence FROM part WHERE p_size % 4 <> 0),
    k AS (SELECT c.*, category FROM c JOIN d ON c.corrected = d.surface WHERE category <> 'PROMO'), r AS (SELECT surface, arg_min(corrected, seq) corrected, avg(confidence) confidence, count(*) n FROM k WHERE confidence >= 0.85 GROUP BY surface HAVING count(DISTINCT corrected) = 1)
    SELECT r.surface, r.corrected, round(r.confidence, 9) AS confidence, r.n, min(category) AS category FROM r JOIN k ON r.surface = k.surface GROUP BY ALL"""
)
def reuse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _part(spark, sf_dir, F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 4 != 0, "REPLACE").otherwise("KEEP").alias("action"), F.concat("p_brand", F.lit("-"), F.substring("p_name", 1, 3)).alias("surface"), F.split("p_name", " ")[0].alias("corrected"), (0.8 + F.col("p_size") / 250.0).alias("confidence"))
    rules = discovery.confirmed_rules(d, _dictionary(spark, sf_dir), ("ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE"))
    return rules.withColumn("confidence", F.round("confidence", 9))


RETENTION = "CASE WHEN n >= 5 THEN 1.0::double ELSE least(0.98::double, 0.8::double + n * 0.04::double) END"


@query(
    f"""WITH RECURSIVE a AS (SELECT doc_id, entity, cue_index, row_number() OVER (PARTITION BY doc_id, entity ORDER BY cue_index) AS k FROM ({ACTS})),
    s AS (SELECT doc_id, entity, k, 0 AS n, cue_index AS last FROM a WHERE k = 1
      UNION ALL SELECT a.doc_id, a.entity, a.k, CASE WHEN pow({RETENTION}, a.cue_index - s.last) < 0.2::double THEN 0 WHEN n >= 5 THEN n ELSE n + 1 END, a.cue_index FROM s JOIN a ON a.doc_id = s.doc_id AND a.entity = s.entity AND a.k = s.k + 1),
    t AS (SELECT doc_id, entity, n, last, lead(last) OVER (PARTITION BY doc_id, entity ORDER BY k) AS nxt FROM s),
    w AS (SELECT t.doc_id, c.cue_index, t.entity, pow({RETENTION}, c.cue_index - last) AS weight FROM t JOIN ({ACTS}) c ON c.doc_id = t.doc_id AND c.cue_index > last AND (nxt IS NULL OR c.cue_index <= nxt))
    SELECT doc_id, cue_index, entity, round(weight, 9) AS weight FROM w WHERE weight >= 0.2::double"""
)
def memory_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    return ordered.memory_before(a, a).withColumn("weight", F.round("weight", 9))


# ---- evaluation ----------------------------------------------------------------------------

OUTCOMES = f"""WITH c AS (SELECT doc_id, cue_index, text raw, replace(text, 'th', 'TH') fixed, replace(text, 'tion', 'sion') gold FROM ({CUES})), n AS (SELECT *, regexp_replace(raw, '\\s+', '', 'g') r, regexp_replace(fixed, '\\s+', '', 'g') f, regexp_replace(gold, '\\s+', '', 'g') g FROM c),
    o AS (SELECT doc_id, cue_index, CASE WHEN r <> g AND f = g THEN 'TP' WHEN r <> g THEN 'FN' WHEN f <> g THEN 'FP' ELSE 'TN' END plain, length(raw) > 1500 long FROM n), e AS (SELECT doc_id, cue_index, coalesce(long AND plain IN ('TP', 'FN'), false) chat, CASE WHEN long AND plain IN ('TP', 'FN') THEN 'TN' ELSE plain END outcome FROM o)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cues(spark, sf_dir).select(*AT, F.col("text").alias("raw"), F.replace("text", F.lit("th"), F.lit("TH")).alias("fixed"), F.replace("text", F.lit("tion"), F.lit("sion")).alias("gold"))
    return evaluation.evaluated(d, F.length("raw") > 1500)


@query(OUTCOMES + " SELECT doc_id, cue_index, outcome, chat FROM e")
def eval_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select(*AT, "outcome", "chat")


@query(
    OUTCOMES
    + """, s AS (SELECT count(*) FILTER (outcome = 'TP') tp, count(*) FILTER (outcome = 'FP') fp, count(*) FILTER (outcome = 'FN') fn, count(*) FILTER (outcome = 'TN') tn, count(*) FILTER (chat) chats FROM e)
    SELECT tp, fp, fn, tn, chats, coalesce(tp / nullif(tp + fp, 0), 0)::double AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::double AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::double AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)::double AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0)::double AS fix_rate, coalesce(fp / nullif(tp + fp, 0), 0)::double AS false_rate FROM s"""
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(_outcomes(spark, sf_dir))


@query("SELECT l_suppkey, CASE WHEN sum(l_quantity) > 0 THEN greatest(0, (sum(l_quantity) - sum(l_linenumber) - count(*) * 3 + count(*)) / sum(l_quantity)) ELSE 0 END AS accuracy FROM lineitem GROUP BY 1")
def eval_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("raw_chars"), F.sum("l_linenumber").alias("missed"), (F.count("*") * 3).alias("broken"), F.count("*").alias("fixed"))
    return evaluation.char_accuracy(d).select("l_suppkey", "accuracy")


GOLD = f"SELECT doc_id, cue_index, text AS raw, replace(text, 'ti', 'red') AS gold FROM ({CUES})"
TARGETS = f"SELECT doc_id, cue_index, surface AS term, CAST(instr(gold, surface) - 1 AS INTEGER) AS place FROM ({GOLD}) JOIN ({DICTIONARY}) ON contains(gold, surface) AND NOT contains(raw, surface)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select(*AT, F.col("text").alias("raw"), F.replace("text", F.lit("ti"), F.lit("red")).alias("gold"))


@query(TARGETS)
def gold_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.targets(_gold(spark, sf_dir), _dictionary(spark, sf_dir).select(F.col("surface").alias("term")))


@query(
    f"""WITH w AS ({TARGETS}), m AS (SELECT doc_id, cue_index, length(raw) n FROM ({GOLD}) WHERE raw <> gold), c AS (SELECT doc_id, cue_index, CASE WHEN n % 3 = 0 THEN 'red' ELSE 'other' END AS value FROM m WHERE n % 5 > 0),
    d AS (SELECT doc_id, cue_index FROM m WHERE n % 9 = 0)
    SELECT m.doc_id, m.cue_index, CASE WHEN n % 5 = 0 THEN 'NO_CANDIDATE' WHEN n % 2 = 0 AND NOT (n % 9 = 0 AND r.doc_id IS NOT NULL) THEN 'REQUERY_FAILED' WHEN n % 3 = 0 AND r.doc_id IS NOT NULL AND n % 9 <> 0 THEN 'PHASE2_REJECTED' ELSE 'OTHER' END AS bucket
    FROM m LEFT JOIN (SELECT DISTINCT doc_id, cue_index FROM w WHERE term = 'red') r ON m.doc_id = r.doc_id AND m.cue_index = r.cue_index"""
)
def missed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(spark, sf_dir)
    wanted = evaluation.targets(g, _dictionary(spark, sf_dir).select(F.col("surface").alias("term")))
    m = g.filter("raw <> gold").select(*AT, F.length("raw").alias("n"))
    c = m.filter("n % 5 > 0").select(*AT, F.when(F.col("n") % 3 == 0, "red").otherwise("other").alias("value"))
    d = m.filter("n % 9 = 0").select(*AT, F.lit("REPLACE").alias("action"), F.lit("red").alias("corrected"))
    return evaluation.missed_buckets(m, wanted, c, d, m.filter("n % 2 = 0").select(*AT))


@query(f"SELECT role AS stage, count(*) AS n, count(*) FILTER (cue_index % 3 = 0) AS generated, count(*) FILTER (cue_index % 3 = 1) AS failed, CAST(sum(least(length(text), 50)) AS BIGINT) AS shown FROM ({CUES}) GROUP BY 1")
def trace_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _cues(spark, sf_dir).select(*AT, F.col("role").alias("stage"), F.col("text").alias("raw"), F.col("text").alias("gold"), F.array("role", "role", "role", "role").alias("terms"), (F.col("cue_index") % 3 < 2).alias("requested"), (F.col("cue_index") % 3 == 0).alias("generated"))
    counts, rows = evaluation.trace_table(t)
    more = rows.groupBy("stage").agg(F.count_if(F.col("requery") == "generated").alias("generated"), F.count_if(F.col("requery") == "failed").alias("failed"), F.sum(F.length("raw")).alias("shown"))
    return counts.join(more, "stage")


@query(
    """WITH g AS (SELECT substr(p_name, i, n) gram, n, count(*) cnt FROM part, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, length(p_name) - n + 2)) i) GROUP BY ALL)
    SELECT gram, CAST(n AS INTEGER) AS n, cnt FROM g QUALIFY row_number() OVER (PARTITION BY n ORDER BY cnt DESC, gram) <= 40"""
)
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators import corpus

    grams = corpus.ngram_counts(_part(spark, sf_dir, F.col("p_name").alias("text")), keep="[^a-z ]")
    contexts = grams.select(F.col("gram").alias("term"), F.col("gram").alias("context"), "cnt")
    return evaluation.kept_model(grams, contexts, 40)[0].select("gram", "n", "cnt")


@query(f"SELECT doc_id, cue_index, role AS style, cue_index * 1000 + 10 AS start_ms, cue_index * 1000 + 3600500 AS end_ms, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cue_index) - 1 AS cue_index, role, left(regexp_replace(text, '\\s+', ' ', 'g'), 60) AS text FROM ({CUES}))")
def ass_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered.Window.partitionBy("doc_id").orderBy("cue_index")
    d = _cues(spark, sf_dir).withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    text = F.regexp_replace(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60), "^ | $", " ")
    line = F.format_string("Dialogue: 0,0:%02d:%02d.01,1:%02d:%02d.50,%s,,0,0,0,,%s", F.floor(F.col("i") / 60), F.col("i") % 60, F.floor(F.col("i") / 60), F.col("i") % 60, F.col("role"), text)
    head = F.lit("[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n")
    files = d.groupBy("doc_id").agg(F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\n")).alias("value"))
    return subtitles.parse_ass(files)


# ---- guide corpus --------------------------------------------------------------------------


@query(f"SELECT CAST(doc_id AS VARCHAR) || '-' || cue_index AS path, trim(regexp_replace(regexp_replace(CASE WHEN length(text) + 1 + length(role) >= 200 THEN text || chr(10) || role ELSE 'short' || chr(10) || text END, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ') AS text FROM ({CUES})")
def post_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.to_json(F.array(F.struct(F.col("text").alias("insert")), F.struct(F.lit('{"image":1}').alias("insert")), F.struct(F.col("role").alias("insert"))))
    post = F.struct(F.col("role").alias("subject"), delta.alias("structured_content"), F.concat(F.lit("short<br>"), "text").alias("content"), F.lit("1").alias("post_id"))
    value = F.to_json(F.struct(F.struct(F.struct(post.alias("post")).alias("post")).alias("data")))
    files = _cues(spark, sf_dir).select(F.concat_ws("-", "doc_id", "cue_index").alias("path"), value.alias("value"))
    return guide.post_articles(files).select("path", "text")


@query()
def guide_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the pages and their sentences; tested on golden pages."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("value"))
    return guide.build(files, files.limit(0), "guide")[1].select("path", "title", "sentence")


@query()
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three searches over conversations, with the market segments as active entities; tested against plain loops."""
    from lexweave.functions import phonetic

    d = _dictionary(spark, sf_dir).filter(F.length("surface") >= 4)
    active = d.groupBy(F.col("parent").alias("entity")).agg((F.count("*") / 20.0).alias("weight"))
    return lookup.lookup(_cues(spark, sf_dir).withColumn("text", F.lower("text")), d, active, phonetic.han_readings(spark))

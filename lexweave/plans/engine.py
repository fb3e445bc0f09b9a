"""More queries over the driver's tables: alignment, topics, teams, decisions, diagnosis, reports.

The driver's tables hold no CJK text. Queries of the CJK operators write letters as the 26 characters of
`SCRIPT`, one for one, and so run whole texts through the same code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import phonetic
from lexweave.operators import alignment, correction, corpus, decisions, diagnosis, evidence, language, ordered, production, reports, team, topics
from lexweave.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SCRIPT = "阿波此德鹅夫哥河衣鸡科拉马那哦坡期日斯特乌微我西牙子"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
CUES = "SELECT conv_id AS doc_id, turn AS cue_index, role, text FROM conversations"
ACTS = "SELECT user_id AS doc_id, event_type AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cue_index, value FROM events"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def script(text: Column) -> Column:
    return F.translate(F.lower(text), ALPHABET, SCRIPT)


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("cue_index"), "role", "text")


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("entity"), (F.row_number().over(w) - 1).cast("long").alias("cue_index"), "value")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as terms in the script."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).filter("w <> ''").groupBy("w").count().select(script(F.col("w")).alias("term"))
    return w.select(F.col("term").alias("surface"), "term", F.lit("character").alias("category"), F.lit("").alias("parent"), F.crc32("term").alias("seq"))


def _expand(spark: SparkSession, sf_dir: str, how: alignment.Search) -> DataFrame:
    cues = _cues(spark, sf_dir).withColumn("text", script(F.col("text")))
    entries = _entries(spark, sf_dir)
    # a term is stable from the cue on that holds it first
    return alignment.expand(cues, production.standing(cues, entries), entries, phonetic.han_readings(spark), how)


@query()
def expand_entity_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, alignment.CONSISTENCY)


@query()
def expand_long_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, alignment.LONG_VARIANT)


@query()
def expand_local_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, alignment.LOCAL)


@query()
def terminology_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expand(spark, sf_dir, alignment.HINT)


@query()
def phonetic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("token")
    tokens = _cues(spark, sf_dir).select("doc_id", "cue_index", words).withColumn("start_char", F.lit(0))
    n = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("surface")).filter("surface <> ''").distinct()
    entries = n.select("surface", F.col("surface").alias("term"), F.lit("character").alias("category"), F.lit(None).cast("string").alias("parent"), F.crc32("surface").alias("seq"))
    none = tokens.select("doc_id", F.lit("").alias("name")).limit(0)
    return alignment.sounds_like(tokens, entries, none)


@query()
def team_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir).select("doc_id", "cue_index", F.concat(script(F.col("text")), F.lit(" 队")).alias("text"))
    t = team.Team({c: f"member {c}" for c in SCRIPT[::2]}, phonetic.han_readings(spark))
    nick = spark.createDataFrame([(SCRIPT[0:2], "member x"), (SCRIPT[4] + SCRIPT[13], "member y")], "surface string, canonical string")
    return team.parse_teams(cues, t, nick)


@query()
def team_requery_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(script(F.col("text")), " ", "队 ")
    t = team.Team({c: f"member {c}" for c in SCRIPT[::2]}, phonetic.han_readings(spark))
    return team.team_hints(_cues(spark, sf_dir).select("doc_id", "cue_index", text.alias("text")), t)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("cue_index") / 4)
    d = _acts(spark, sf_dir).groupBy("doc_id", k.alias("chunk_id")).agg(F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"), F.array_sort(F.collect_set("entity")).alias("entities"), F.array_sort(F.collect_set(F.when(F.col("value") > 50, "high").otherwise("low"))).alias("categories"))
    return d.withColumn("signals", F.array().cast("array<string>"))


@query()
def chunk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.clusters(_chunks(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = _chunks(spark, sf_dir).select("doc_id", F.col("chunk_id").alias("seq"), "lo", "hi", F.concat(F.lit("t"), F.col("chunk_id").cast("string")).alias("label"), "entities", F.col("categories").alias("words"), F.array(F.lit(1.0)).alias("signals"))
    return topics.topic_graph(t)


@query()
def topic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query()
def topic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query(
    f"""WITH c AS (SELECT doc_id, cue_index // 4 AS chunk_id, min(cue_index) lo, max(cue_index) hi, list_sort(list(DISTINCT entity)) e FROM ({ACTS}) GROUP BY ALL),
    p AS (SELECT doc_id, chunk_id, e, lag(e) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS f FROM c)
    SELECT doc_id, chunk_id, round(len(list_intersect(e, f)) / len(list_distinct(list_concat(e, f))), 9) AS overlap FROM p WHERE f IS NOT NULL"""
)
def chunk_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered.Window.partitionBy("doc_id").orderBy("chunk_id")
    d = _chunks(spark, sf_dir).withColumn("f", F.lag("entities").over(w)).filter("f IS NOT NULL")
    return d.select("doc_id", "chunk_id", F.round(topics.jaccard(F.col("entities"), F.col("f")), 9).alias("overlap"))


@query(
    f"""WITH a AS ({ACTS}), c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(cue_index)) - 1 AS cluster_id, min(cue_index) lo, max(cue_index) hi FROM a WHERE value > 60 GROUP BY doc_id, entity)
    SELECT a.doc_id, a.cue_index, min(cluster_id) AS cluster_id FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.cue_index BETWEEN lo AND hi GROUP BY a.doc_id, a.cue_index"""
)
def first_cluster_of_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    c = a.filter("value > 60").groupBy("doc_id", "entity").agg(F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"))
    c = c.withColumn("cluster_id", (F.row_number().over(ordered.Window.partitionBy("doc_id").orderBy("lo")) - 1).cast("long"))
    return topics.cluster_of(a.select("doc_id", "cue_index"), c)


GATHERED = f"""WITH a AS ({ACTS}), h AS (SELECT doc_id * 100000 + cue_index AS item, doc_id, cue_index AS start, entity AS resolution, value / 100 AS confidence FROM a WHERE value > 40),
    e AS (SELECT doc_id, cue_index AS start, cue_index + 1 AS "end", entity FROM a WHERE value > 85),
    n AS (SELECT item, max(CASE WHEN e.entity = resolution THEN 1 ELSE 0 END) AS same FROM h JOIN e ON e.doc_id = h.doc_id AND abs(e.start - h.start) <= 10 GROUP BY item)
    SELECT item, 'phonetic' AS dimension, 1 AS polarity, confidence AS strength FROM h
    UNION ALL SELECT item, CASE WHEN same = 1 THEN 'entity_cooccurrence' ELSE 'entity_conflict' END, CASE WHEN same = 1 THEN 1 ELSE -1 END, CASE WHEN same = 1 THEN 0.8::double ELSE 0.6::double END FROM n
    UNION ALL SELECT item, 'temporal_discontinuity', -1, 0.5::double FROM h WHERE start > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = h.doc_id AND e."end" < h.start AND h.start - e."end" <= 20)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    h = a.filter("value > 40").select((F.col("doc_id") * 100000 + F.col("cue_index")).alias("item"), "doc_id", F.col("cue_index").alias("start"), F.col("entity").alias("resolution"), (F.col("value") / 100).alias("confidence"), F.array(F.lit("PHONETIC_MATCH"), F.lit("UNKNOWN_TERM")).alias("reasons"))
    e = a.filter("value > 85").select("doc_id", F.col("cue_index").alias("start"), (F.col("cue_index") + 1).alias("end"), "entity")
    return evidence.gather(h, e)


@query(f"SELECT item, dimension, polarity, round(strength, 9) AS strength FROM ({GATHERED})")
def gather_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).withColumn("strength", F.round("strength", 9))


@query(
    f"""WITH w AS (SELECT * FROM (VALUES ('phonetic', 0.15::double), ('entity_cooccurrence', 0.25::double), ('entity_conflict', 0.6::double), ('temporal_discontinuity', 0.5::double)) t(dimension, weight)),
    s AS (SELECT item, round(least(1.0, greatest(-1.0, sum(polarity * strength * weight))), 6) AS score FROM ({GATHERED}) JOIN w USING (dimension) GROUP BY item)
    SELECT CASE WHEN score >= 0.6 THEN 'COMMIT' WHEN score <= -0.6 THEN 'REJECT' ELSE 'UNCERTAIN' END AS verdict, count(*) AS n FROM s GROUP BY 1"""
)
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _evidence(spark, sf_dir)
    return correction.converge(d, evidence.weights(d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT doc_id, cue_index, text, instr(text, 'tion') - 1 AS place FROM ({CUES}) WHERE contains(text, 'tion'))
    SELECT doc_id, cue_index, CAST(CASE WHEN substr(text, 4, 4) = 'tion' THEN 3 ELSE place END AS INTEGER) AS start_char, 'X' AS replacement FROM s"""
)
def plan_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    d = cues.select("doc_id", "cue_index", F.lit("REPLACE").alias("action"), F.lit("tion").alias("surface"), F.lit("X").alias("corrected"), F.lit(3).alias("start_char"), F.lit(7).alias("end_char"), F.lit(1.0).alias("confidence"))
    return decisions.plan_edits(d, cues).select("doc_id", "cue_index", "start_char", "replacement")


@query(f"SELECT doc_id, cue_index, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS BIGINT) AS n FROM ({CUES}) WHERE contains(text, 'tion')")
def reuse_rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    none = cues.select("doc_id", "cue_index", F.lit("KEEP").alias("action"), F.lit("").alias("surface"), F.lit("").alias("corrected"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), F.lit(1.0).alias("confidence")).limit(0)
    rules = spark.createDataFrame([("tion", "sion", 0.9, 0)], "surface string, corrected string, confidence double, seq int")
    return decisions.reuse(cues, none, rules).groupBy("doc_id", "cue_index").agg(F.count("*").alias("n"))


@query()  # ties of the rounded value differ between engines
def arbitration_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", decisions.blended(F.col("l_tax"), F.col("l_discount")).alias("confidence"))


@query(
    """WITH d AS (SELECT l_orderkey doc_id, l_linenumber cue_index, max(l_discount) * 10 risk FROM lineitem GROUP BY ALL)
    SELECT doc_id, cue_index FROM d WHERE risk >= 0.72 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_linenumber = cue_index AND l_returnflag <> 'R')"""
)
def decision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cue_index")]
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy(*at).agg((F.max("l_discount") * 10).alias("risk"))
    c = li.select(*at, F.when(F.col("l_returnflag") == "R", "context_alias").alias("intent"))
    return decisions.needs_decision(d, c).select("doc_id", "cue_index")


@query(
    r"""WITH c AS (SELECT conv_id AS doc_id, turn AS cue_index, text AS raw, replace(text, 'tion', 'sion') AS gold FROM conversations),
    g AS (SELECT doc_id, cue_index, raw, gold, substr(gold, i, n) AS t, n FROM c, (VALUES (2), (3), (4), (5)) v(n), LATERAL (SELECT unnest(range(1, length(gold) - n + 2)) AS i)),
    r AS (SELECT DISTINCT doc_id, cue_index, substr(raw, i, n) AS t FROM c, (VALUES (2), (3), (4), (5)) v(n), LATERAL (SELECT unnest(range(1, length(raw) - n + 2)) AS i)),
    m AS (SELECT doc_id, cue_index, count(*) AS n_terms FROM g WHERE regexp_full_match(t, '[a-z]+') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = g.doc_id AND r.cue_index = g.cue_index AND r.t = g.t) GROUP BY ALL)
    SELECT doc_id, cue_index, coalesce(n_terms, 0) AS n_terms, CASE WHEN raw = gold OR n_terms IS NULL THEN 'NON_TERMINOLOGY_DIFF' WHEN cue_index % 2 = 1 THEN 'REQUERY_FAILED' ELSE 'NO_CANDIDATE' END AS cause
    FROM c LEFT JOIN m USING (doc_id, cue_index) WHERE contains(raw, 'ntion') OR NOT contains(raw, 'tion')"""
)
def missed_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text")
    d = _cues(spark, sf_dir).filter(F.contains(raw, F.lit("ntion")) | ~F.contains(raw, F.lit("tion"))).select("doc_id", "cue_index", raw.alias("raw"), raw.alias("fixed"), F.replace(raw, F.lit("tion"), F.lit("sion")).alias("gold"), F.lit(None).cast("array<string>").alias("values"), (F.col("cue_index") % 2 == 1).alias("requeried"))
    return diagnosis.causes(d, "[a-z]").select("doc_id", "cue_index", F.size("terms").cast("long").alias("n_terms"), "cause")


@query()
def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.state_hash(ordered.entity_memory(_acts(spark, sf_dir)))


@query()
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    return reports.entity_timeline(a, a)


@query("SELECT CAST(floor(l_discount / 0.02::double) AS BIGINT) AS bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 9)::double AS percent FROM lineitem GROUP BY 1")
def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 0.02).select("bucket", "n", F.round("percent", 9).alias("percent"))


@query("SELECT 0 AS ord, 'all' AS stage, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R'")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return reports.stage_counts({"all": li, "returned": li.filter("l_returnflag = 'R'")})


@query()
def marked_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cues(spark, sf_dir).select("doc_id", "cue_index", "text", F.replace("text", F.lit("tion"), F.lit("sion")).alias("fixed"))
    return d.filter("text <> fixed").select("doc_id", "cue_index", reports.marked("text", "fixed").alias("m")).select("doc_id", "cue_index", "m.*")


@query()
def nearest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("surface")).distinct()
    aliases = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("alias"), F.col("n_nationkey").alias("seq"))
    return language.nearest_alias(names, aliases, {})


@query()
def language_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sentence_id"), script(F.col("p_name")).alias("text"))
    grams = corpus.ngram_counts(part.select("text"))
    known = spark.createDataFrame([(SCRIPT[1] + SCRIPT[11] + SCRIPT[20], "x", 0), (SCRIPT[17] + SCRIPT[4] + SCRIPT[3], "y", 1)], "surface string, canonical string, seq int")
    cues = part.select(F.col("sentence_id").alias("doc_id"), F.lit(0).cast("long").alias("cue_index"), F.reverse("text").alias("text"))
    return language.detect(cues, known, grams, language.alias_contexts(part, known), phonetic.han_readings(spark))


@query()
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the cues with candidates, answered by rule: the decisions of the first round."""
    cues = _cues(spark, sf_dir).withColumn("text", script(F.col("text")))
    found = materialize(decisions.number(_expand(spark, sf_dir, alignment.CONSISTENCY).withColumn("evidence_type", F.col("source"))), "found")
    clustered = topics.clusters(cues.groupBy("doc_id", F.floor(F.col("cue_index") / 4).alias("chunk_id")).agg(F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"), F.array_sort(F.collect_set("role")).alias("entities")).withColumn("categories", F.col("entities")).withColumn("signals", F.array().cast("array<string>")))
    return decisions.parse(decisions.ask(decisions.batches(cues, found, clustered), decisions.RuleDecider(0.75)), found)[0]


@query()
def corrected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the script, corrected by the words of the part names; tested against its own edits by plain Python."""
    cues = _cues(spark, sf_dir).select("doc_id", "cue_index", script(F.col("text")).alias("text"))
    return production.correct(cues, _entries(spark, sf_dir), phonetic.han_readings(spark), decisions.RuleDecider(0.75))["text"].select("doc_id", "cue_index", "edited")

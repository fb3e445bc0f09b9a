"""queries() and oracle_sql() of the correction engine's own operators, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import corpus, correction, ordered
from lexweave.session import table
from lexweave.sources import subtitles

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from lexweave.plans import engine, lifecycle

    return {**_QUERIES, **engine.QUERIES, **lifecycle.QUERIES}


def oracle_sql() -> dict[str, str]:
    from lexweave.plans import engine, lifecycle

    return {**_SQL, **engine.SQL, **lifecycle.SQL}


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("cue_index"), "role", "text")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("category"), F.col("p_brand").alias("parent"))


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("entity"), (F.row_number().over(w) - 1).cast("long").alias("cue_index"), "value")


CUES = "SELECT conv_id AS doc_id, turn AS cue_index, role, text FROM conversations"
ACTS = "SELECT user_id AS doc_id, event_type AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cue_index, value FROM events"
WORDS = "SELECT DISTINCT lower(regexp_replace(p_name, '[^A-Za-z ]', '', 'g')) AS surface FROM part"


# ---- text ------------------------------------------------------------------------------------


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(translate(text, '，。！？；：（）【】“”‘’', ',.!?;:()[]""'''''), '[ \t]+', ' ', 'g') t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^[\s]+', ''), '[\s]+$', '') t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+([,.!?:;])', '\1', 'g'), 'Q1', 'QE', 'gi') t FROM b),
    d AS (SELECT doc_id, regexp_replace(t, '(^|[^A-Za-z])eq([^A-Za-z]|$)', '\1QE\2', 'gi') t FROM c)
    SELECT doc_id, md5(regexp_replace(t, '(^|[^A-Za-z])eq([^A-Za-z]|$)', '\1QE\2', 'gi')) AS normalized FROM d"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normalized"))


@query(
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br ?/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')) AS text_hash FROM pages"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_hash"))


@query(
    r"""WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[。！？?!；;．\n]'))) s FROM documents)
    SELECT doc_id, s AS sentence, substr(sha256(s), 1, 16) AS content_hash FROM s WHERE length(s) BETWEEN 4 AND 200"""
)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return d.withColumn("content_hash", T.short_hash(F.col("sentence")))


@query(
    """WITH c AS (SELECT regexp_replace(p_name, '[^A-Za-z0-9-]', '', 'g') t FROM part),
    g AS (SELECT substr(t, i, n) gram, n FROM c, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) i))
    SELECT gram, n, count(*) AS cnt FROM g GROUP BY gram, n"""
)
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    return corpus.ngram_counts(d, 2, 3, "[^A-Za-z0-9-]").select("gram", "n", "cnt")


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS path, count(*) AS copies FROM documents WHERE length(text) >= 200 GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_dedup(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))


@query(
    """WITH t AS (SELECT event_id, event_id * 977 AS a, event_id * 977 + 2500 AS b FROM events)
    SELECT event_id, printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS stamp FROM t"""
)
def srt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("event_id") * 977
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(" --> ", T.srt_time(a), T.srt_time(a + 2500)).alias("stamp"))


@query("SELECT CASE WHEN trim(props) = '' THEN 'skipped' WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN 'ok' ELSE 'failed' END AS state, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1")
def jsonl_lenient_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").filter("props IS NOT NULL").select(F.col("props").alias("value"))
    return subtitles.json_objects(lines).groupBy("state").agg(F.count("*").alias("n"))


# ---- dictionary and joins --------------------------------------------------------------------


@query(
    """WITH s AS (SELECT p_name surface, p_partkey term_id, p_name term, p_type category, p_brand parent, 0 prio FROM part UNION ALL SELECT p_brand, p_partkey, p_name, p_type, p_brand, 1 FROM part)
    SELECT surface, term_id, term, category, parent, prio = 1 AS is_alias FROM s QUALIFY row_number() OVER (PARTITION BY surface ORDER BY prio, term_id DESC) = 1"""
)
def surface_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.surface_dictionary(_terms(spark, sf_dir))


SPANS = f"""SELECT doc_id, cue_index, surface, CAST(i AS BIGINT) AS start_char, CAST(i + length(surface) AS BIGINT) AS end_char
    FROM ({CUES}) c, (SELECT DISTINCT unnest(['the', 'ing', 'tion', 'ver', 'que', 'ci']) AS surface) s, LATERAL (SELECT unnest(range(0, length(text) - length(surface) + 1)) AS i)
    WHERE contains(text, surface) AND substr(text, CAST(i + 1 AS BIGINT), length(surface)) = surface"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    surfaces = spark.createDataFrame([(x,) for x in ("the", "ing", "tion", "ver", "que", "ci")], "surface string")
    return correction.containment_spans(_cues(spark, sf_dir), surfaces)


@query(SPANS)
def containment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f"WITH s AS ({SPANS}) SELECT a.* FROM s a WHERE a.surface IN ('the', 'ing') AND NOT EXISTS (SELECT 1 FROM s b WHERE b.surface = 'tion' AND b.doc_id = a.doc_id AND b.cue_index = a.cue_index AND a.start_char < b.end_char + 2 AND b.start_char < a.end_char)")
def protected_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    guard = s.filter("surface = 'tion'").select("doc_id", "cue_index", "start_char", (F.col("end_char") + 2).alias("end_char"), F.lit("x").alias("canonical"))
    return correction.protect(s.filter("surface IN ('the', 'ing')").withColumn("value", F.lit("x")), guard).drop("value")


@query(
    """WITH p AS (SELECT p_brand surface, p_partkey seq, CASE p_size % 3 WHEN 0 THEN 'preserve_surface' WHEN 1 THEN 'repair_expand' ELSE 'contextual_expand' END policy FROM part)
    SELECT surface, policy FROM p QUALIFY row_number() OVER (PARTITION BY surface ORDER BY CASE policy WHEN 'preserve_surface' THEN 30 WHEN 'repair_expand' THEN 20 ELSE 10 END DESC, seq DESC) = 1"""
)
def alias_policy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("surface"), F.col("p_partkey").alias("seq"), F.when(size == 0, "preserve_surface").when(size == 1, "repair_expand").otherwise("contextual_expand").alias("policy"))
    return correction.resolve_policy(p)


# ---- ordered and stateful --------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_index) - 1 AS pos, (count(*) OVER (PARTITION BY doc_id) - 1) // 4 AS last FROM ({CUES}))
    SELECT doc_id, cue_index, pos // 4 AS chunk_id, 'target' AS role FROM p
    UNION ALL SELECT doc_id, cue_index, pos // 4 + 1, 'before' FROM p WHERE pos % 4 >= 3 AND pos // 4 + 1 <= last
    UNION ALL SELECT doc_id, cue_index, pos // 4 - 1, 'after' FROM p WHERE pos % 4 < 1 AND pos // 4 >= 1"""
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.chunk(_cues(spark, sf_dir).select("doc_id", "cue_index"), 4, 1).drop("pos")


@query(
    f"""SELECT doc_id, cue_index, coalesce(string_agg(role, ' / ') OVER (PARTITION BY doc_id ORDER BY cue_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(role, ' / ') OVER (PARTITION BY doc_id ORDER BY cue_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM ({CUES})"""
)
def context_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbours(_cues(spark, sf_dir).select("doc_id", "cue_index", F.col("role").alias("text"))).drop("text")


@query(
    f"""WITH a AS ({ACTS}), g AS (SELECT doc_id, cue_index, CASE WHEN cue_index - lag(cue_index) OVER w <= 5 THEN 0 ELSE 1 END f FROM a WHERE value > 80 WINDOW w AS (PARTITION BY doc_id ORDER BY cue_index)),
    r AS (SELECT doc_id, cue_index, sum(f) OVER (PARTITION BY doc_id ORDER BY cue_index) region FROM g)
    SELECT doc_id, CAST(region AS BIGINT) AS region, min(cue_index) AS lo, max(cue_index) AS hi, count(*) AS n_problems FROM r GROUP BY doc_id, region"""
)
def problem_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.regions(_acts(spark, sf_dir).filter("value > 80").select("doc_id", "cue_index"))


@query(
    f"""WITH a AS ({ACTS}), l AS (SELECT doc_id, cue_index, max(CASE WHEN entity = 'purchase' THEN cue_index END) OVER (PARTITION BY doc_id ORDER BY cue_index) AS last FROM a)
    SELECT doc_id, cue_index, round(CASE WHEN last IS NULL THEN 0 WHEN pow(0.7::double, cue_index - last) >= 0.3 THEN pow(0.7::double, cue_index - last) ELSE 0 END, 9) AS weight FROM l"""
)
def category_decay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordered.category_state(_acts(spark, sf_dir), F.col("entity") == "purchase")
    return d.select("doc_id", "cue_index", F.round("weight", 9).alias("weight"))


@query(
    f"""WITH d AS (SELECT doc_id, entity, max(value) confidence, min(cue_index) lo, max(cue_index) hi FROM ({ACTS}) GROUP BY doc_id, entity), e AS (SELECT *, exp(-0.05::double * (max(hi) OVER (PARTITION BY doc_id) - hi)) f FROM d)
    SELECT doc_id, entity, confidence, lo, hi, round(f, 9) AS factor, f >= 0.1 AS active FROM e"""
)
def temporal_entity_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordered.temporal_memory(_acts(spark, sf_dir).withColumnRenamed("value", "confidence"))
    return d.withColumn("factor", F.round("factor", 9))


@query(
    f"""WITH RECURSIVE a AS (SELECT doc_id, entity, cue_index, row_number() OVER (PARTITION BY doc_id, entity ORDER BY cue_index) AS k FROM ({ACTS})),
    s AS (SELECT doc_id, entity, k, 0 AS n, cue_index AS last FROM a WHERE k = 1
      UNION ALL SELECT a.doc_id, a.entity, a.k, CASE WHEN pow(CASE WHEN s.n >= 5 THEN 1.0::double ELSE least(0.98::double, 0.8::double + s.n * 0.04::double) END, a.cue_index - s.last) < 0.2::double THEN 0 WHEN s.n >= 5 THEN s.n ELSE s.n + 1 END, a.cue_index
      FROM s JOIN a ON a.doc_id = s.doc_id AND a.entity = s.entity AND a.k = s.k + 1)
    SELECT doc_id, entity, CAST(n AS INTEGER) AS refreshes, last AS last_cue FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, entity ORDER BY k DESC) = 1"""
)
def entity_memory_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.entity_memory(_acts(spark, sf_dir))


@query(
    f"""WITH p AS (SELECT doc_id, cue_index, (row_number() OVER (PARTITION BY doc_id ORDER BY cue_index) - 1) // 4 AS chunk_id FROM ({CUES})), o AS (SELECT doc_id, chunk_id, count(*) n_obs FROM p GROUP BY ALL), s AS ({SPANS})
    SELECT doc_id, chunk_id, surface, count(*) AS n, count(*) / any_value(n_obs) AS persistence FROM s JOIN p USING (doc_id, cue_index) JOIN o USING (doc_id, chunk_id) GROUP BY doc_id, chunk_id, surface"""
)
def entity_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ordered.chunk(_cues(spark, sf_dir).select("doc_id", "cue_index"), 4, 0).select("doc_id", "cue_index", "chunk_id")
    obs = p.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n_obs"))
    d = _spans(spark, sf_dir).join(p, ["doc_id", "cue_index"]).groupBy("doc_id", "chunk_id", "surface").agg(F.count("*").alias("n"))
    return d.join(obs, ["doc_id", "chunk_id"]).select("doc_id", "chunk_id", "surface", "n", (F.col("n") / F.col("n_obs")).alias("persistence"))


@query(f"SELECT doc_id, entity, min(cue_index) AS first_cue, row_number() OVER (PARTITION BY doc_id ORDER BY min(cue_index)) AS ord FROM ({ACTS}) GROUP BY doc_id, entity")
def category_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _acts(spark, sf_dir).groupBy("doc_id", "entity").agg(F.min("cue_index").alias("first_cue"))
    return d.withColumn("ord", F.row_number().over(ordered.Window.partitionBy("doc_id").orderBy("first_cue")))


@query(
    f"""WITH a AS ({ACTS}), o AS (SELECT doc_id, count(*) n FROM a GROUP BY doc_id)
    SELECT doc_id, entity, min(cue_index) AS start_cue, max(cue_index) AS end_cue, string_agg(CAST(cue_index AS VARCHAR), ',' ORDER BY cue_index) AS seq, count(*) / any_value(n) AS density FROM a JOIN o USING (doc_id) GROUP BY doc_id, entity HAVING count(*) >= 2"""
)
def compressed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    o = a.groupBy("doc_id").agg(F.count("*").alias("n"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list("cue_index")), lambda x: x.cast("string")), ",")
    d = a.groupBy("doc_id", "entity").agg(F.min("cue_index").alias("start_cue"), F.max("cue_index").alias("end_cue"), seq.alias("seq"), F.count("*").alias("k")).filter("k >= 2")
    return d.join(o, "doc_id").select("doc_id", "entity", "start_cue", "end_cue", "seq", (F.col("k") / F.col("n")).alias("density"))


@query(
    f"""WITH a AS ({ACTS}), c AS (SELECT doc_id, entity, min(cue_index) lo, max(cue_index) hi FROM a WHERE value > 50 GROUP BY doc_id, entity)
    SELECT a.doc_id, a.cue_index, string_agg(c.entity, ',' ORDER BY c.entity) AS stable FROM a JOIN c ON a.doc_id = c.doc_id AND a.cue_index BETWEEN c.lo AND c.hi GROUP BY a.doc_id, a.cue_index"""
)
def interval_stable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    c = a.filter("value > 50").groupBy(F.col("doc_id").alias("d"), F.col("entity").alias("stable")).agg(F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"))
    j = a.join(c, (a.doc_id == c.d) & a.cue_index.between(c.lo, c.hi))
    return j.groupBy("doc_id", "cue_index").agg(F.array_join(F.array_sort(F.collect_list("stable")), ",").alias("stable"))


@query(f"SELECT doc_id, entity, count(*) AS n FROM ({ACTS}) WHERE cue_index <= 40 AND cue_index + 3 >= 10 GROUP BY doc_id, entity")
def event_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acts(spark, sf_dir).filter("cue_index <= 40 AND cue_index + 3 >= 10").groupBy("doc_id", "entity").agg(F.count("*").alias("n"))


@query(
    f"""WITH a AS ({ACTS}) SELECT x.doc_id, x.cue_index, count(DISTINCT y.entity) AS nearby FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.cue_index BETWEEN x.cue_index - 10 AND x.cue_index + 10 AND y.entity <> x.entity GROUP BY x.doc_id, x.cue_index"""
)
def band_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the band is a window frame: no self-join
    w = ordered.Window.partitionBy("doc_id").orderBy("cue_index").rangeBetween(-10, 10)
    d = _acts(spark, sf_dir).withColumn("near", F.collect_set("entity").over(w))
    return d.select("doc_id", "cue_index", (F.size(F.array_remove("near", F.col("entity")))).cast("long").alias("nearby")).filter("nearby > 0")


# ---- fusion, edits, evaluation ---------------------------------------------------------------


@query(
    """WITH d AS (SELECT l_orderkey doc_id, l_linenumber cue_index, l_returnflag detector, l_discount * 10 risk, l_tax > 0 configured FROM lineitem), w AS (SELECT * FROM (VALUES ('A', 0.35::double), ('N', 0.2::double)) t(detector, weight))
    SELECT doc_id, cue_index, round(least(1.0, greatest(0.0, sum(risk * coalesce(weight, 1.0::double)) / sum(coalesce(weight, 1.0::double)))), 9) AS risk FROM d LEFT JOIN w USING (detector) WHERE risk <> 0 OR configured GROUP BY doc_id, cue_index"""
)
def risk_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cue_index"), F.col("l_returnflag").alias("detector"), (F.col("l_discount") * 10).alias("risk"), (F.col("l_tax") > 0).alias("configured"))
    weights = spark.createDataFrame([("A", 0.35), ("N", 0.2)], "detector string, weight double")
    return correction.fuse_risk(d, weights).select("doc_id", "cue_index", F.round("risk", 9).alias("risk"))


@query(
    """WITH e AS (SELECT l_orderkey item, l_linestatus dimension, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END polarity, l_discount * 10 strength FROM lineitem), w AS (SELECT * FROM (VALUES ('O', 0.5::double)) t(dimension, weight)),
    s AS (SELECT item, least(1.0, greatest(-1.0, sum(polarity * strength * coalesce(weight, 0.1::double)))) score FROM e LEFT JOIN w USING (dimension) GROUP BY item)
    SELECT item, round(score, 9) AS score, CASE WHEN round(score, 9) >= 0.6 THEN 'COMMIT' WHEN round(score, 9) <= -0.6 THEN 'REJECT' ELSE 'UNCERTAIN' END AS verdict FROM s"""
)
def evidence_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linestatus").alias("dimension"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("polarity"), (F.col("l_discount") * 10).alias("strength"))
    return correction.converge(e, spark.createDataFrame([("O", 0.5)], "dimension string, weight double")).withColumn("score", F.round("score", 9))


@query("SELECT l_partkey, count(*) AS decisions, count(DISTINCT l_returnflag) AS forms FROM lineitem GROUP BY l_partkey HAVING count(*) > 1 AND count(DISTINCT l_returnflag) > 1")
def conflict_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("decisions"), F.countDistinct("l_returnflag").alias("forms")).filter("decisions > 1 AND forms > 1")


@query(
    """WITH c AS (SELECT l_orderkey doc_id, 0 cue_index, l_shipmode_ surface, CAST(l_suppkey AS VARCHAR) AS value, l_linenumber start_char, l_linenumber + 2 end_char, l_quantity score, false exact FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)),
    b AS (SELECT doc_id, cue_index, surface, value, start_char, end_char, max(score) score, min(exact) exact FROM c GROUP BY ALL)
    SELECT doc_id, value, score, row_number() OVER (PARTITION BY doc_id, cue_index ORDER BY score DESC, exact, value, start_char, surface) AS rank FROM b QUALIFY rank <= 4""".replace("GROUP BY ALL", "GROUP BY doc_id, cue_index, surface, value, start_char, end_char")
)
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("cue_index"), F.col("l_returnflag").alias("surface"), F.col("l_suppkey").cast("string").alias("value"), F.col("l_linenumber").alias("start_char"), (F.col("l_linenumber") + 2).alias("end_char"), F.col("l_quantity").alias("score"), F.lit(False).alias("exact"))
    return correction.top_candidates(c).select("doc_id", "value", "score", "rank")


@query(f"SELECT doc_id, cue_index, md5(replace(text, 'tion', 'SSION')) AS edited FROM ({CUES})")
def commit_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _spans(spark, sf_dir).filter("surface = 'tion'").withColumn("replacement", F.lit("SSION")).withColumn("start_char", F.col("start_char").cast("int")).withColumn("end_char", F.col("end_char").cast("int"))
    return correction.apply_edits(_cues(spark, sf_dir), edits).select("doc_id", "cue_index", F.md5("edited").alias("edited"))


@query(
    f"""WITH c AS (SELECT replace(text, ' ', '') r, replace(replace(text, ' ', ''), 'tion', 'X') g, replace(replace(text, ' ', ''), 'ing', 'Y') f FROM ({CUES})),
    k AS (SELECT CASE WHEN r <> g AND f = g THEN 'TP' WHEN r <> g THEN 'FN' WHEN f <> g THEN 'FP' ELSE 'TN' END k FROM (SELECT regexp_replace(r, '\\s+', '', 'g') r, regexp_replace(g, '\\s+', '', 'g') g, regexp_replace(f, '\\s+', '', 'g') f FROM c)),
    m AS (SELECT count(*) FILTER (k = 'TP') tp, count(*) FILTER (k = 'FP') fp, count(*) FILTER (k = 'FN') fn, count(*) FILTER (k = 'TN') tn FROM k)
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy FROM m"""
)
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    k = correction.confusion(t, F.replace(t, F.lit("ing"), F.lit("Y")), F.replace(t, F.lit("tion"), F.lit("X")))
    n = lambda x: F.coalesce(F.sum((F.col("k") == x).cast("long")), F.lit(0))
    counts = _cues(spark, sf_dir).select(k.alias("k")).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"), n("TN").alias("tn"))
    return correction.metrics(counts)


@query(
    f"""WITH s AS ({SPANS}) SELECT surface, count(DISTINCT (doc_id, cue_index)) AS cues, count(*) AS n FROM s GROUP BY surface"""
)
def gold_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).groupBy("surface").agg(F.countDistinct("doc_id", "cue_index").alias("cues"), F.count("*").alias("n"))


@query(
    f"""WITH a AS ({ACTS}), x AS (SELECT doc_id, entity, max(value) v FROM a WHERE cue_index <= 20 GROUP BY doc_id, entity), y AS (SELECT doc_id, entity, max(value) v FROM a WHERE cue_index <= 40 GROUP BY doc_id, entity)
    SELECT doc_id, entity, CASE WHEN x.v IS NULL THEN 'added' WHEN y.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x FULL JOIN y USING (doc_id, entity) WHERE x.v IS NULL OR y.v IS NULL OR abs(x.v - y.v) > 0.01"""
)
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _acts(spark, sf_dir)
    state = lambda upto, name: a.filter(F.col("cue_index") <= upto).groupBy("doc_id", "entity").agg(F.max("value").alias(name))
    d = state(20, "x").join(state(40, "y"), ["doc_id", "entity"], "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.abs(F.col("x") - F.col("y")) > 0.01, "changed")
    return d.select("doc_id", "entity", change.alias("change")).filter("change IS NOT NULL")


# ---- corpus and language model ---------------------------------------------------------------


@query(
    """WITH c AS (SELECT regexp_replace(r_name || n_name, '[^A-Za-z]', '', 'g') t FROM nation JOIN region ON n_regionkey = r_regionkey),
    g AS (SELECT substr(t, i, n) gram, n FROM c, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) i))
    SELECT gram, count(*) AS cnt, CAST(any_value(n) AS INTEGER) AS n FROM g GROUP BY gram"""
)
def lm_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return corpus.ngram_counts(n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat("r_name", "n_name").alias("text")), keep="[^A-Za-z]")


@query(
    """WITH t AS (SELECT p_partkey id, regexp_replace(p_name, '[^A-Za-z]', '', 'g') s FROM part), g AS (SELECT id, substr(s, i, n) gram, n FROM t, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, length(s) - n + 2)) i)),
    c AS (SELECT gram, n, count(*) cnt FROM g GROUP BY gram, n), tot AS (SELECT n, sum(cnt)::double total FROM c GROUP BY n),
    s AS (SELECT id, avg(CASE WHEN n = 2 THEN least(coalesce(cnt, 0) / greatest(1.0, total * 0.001), 1.0) END) bi, avg(CASE WHEN n = 3 THEN least(coalesce(cnt, 0) / greatest(1.0, total * 0.001), 1.0) END) tri, avg(CASE WHEN n = 2 THEN CASE WHEN cnt IS NULL THEN 0.0 ELSE 1.0 END END) cover FROM g LEFT JOIN c USING (gram, n) JOIN tot USING (n) GROUP BY id)
    SELECT id, round((coalesce(bi, 0.5) + coalesce(tri, 0.5) + coalesce(cover, 0.5)) / 3, 6) AS score FROM t LEFT JOIN s USING (id)"""
)
def lm_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", "[^A-Za-z]", "").alias("text"))
    return corpus.score_texts(p, corpus.ngram_counts(p)).select("id", F.round("score", 6).alias("score"))


@query(
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), seen AS (SELECT word alias, count(*) evidence FROM w GROUP BY word HAVING count(*) >= 2),
    terms AS (SELECT word term FROM seen_terms), c AS (SELECT term, alias, max(s) s FROM (SELECT term, right(term, 3) alias, true s FROM terms WHERE length(term) > 3 UNION ALL SELECT term, right(term, 2), true FROM terms WHERE length(term) > 2
      UNION ALL SELECT term, left(term, 2), false FROM terms WHERE length(term) > 2 UNION ALL SELECT term, left(term, 3), false FROM terms WHERE length(term) > 3) GROUP BY term, alias), o AS (SELECT alias, count(*) owners, min(term) canonical, max(s) s FROM c GROUP BY alias)
    SELECT alias, canonical, evidence, owners, round(least(1.0, greatest(0.0, CASE WHEN evidence >= 20 THEN 0.9 WHEN evidence >= 10 THEN 0.8 WHEN evidence >= 5 THEN 0.7 WHEN evidence >= 3 THEN 0.6 ELSE 0.5 END + CASE WHEN owners = 1 THEN 0.08 ELSE 0 END - 0.1 * (owners - 1) + CASE WHEN s THEN 0.05 ELSE 0 END))::double, 9) AS confidence FROM seen JOIN o USING (alias)""".replace("FROM seen_terms", "FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark)")
)
def alias_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)))
    terms = table(spark, sf_dir, "benchmark").select(words("text").alias("term")).distinct()
    seen = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), words("text").alias("word"))
    return corpus.mine_aliases(seen, corpus.alias_candidates(terms)).withColumn("confidence", F.round("confidence", 9))


@query("SELECT a.n_name AS l, b.r_name AS r, round(1 - levenshtein(a.n_name, b.r_name) / greatest(length(a.n_name), length(b.r_name)), 9) AS similarity FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return a.join(b, a.n_regionkey == b.r_regionkey).select(F.col("n_name").alias("l"), F.col("r_name").alias("r"), F.round(T.similarity(F.col("n_name"), F.col("r_name")), 9).alias("similarity"))


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey id, l_partkey item FROM lineitem), n AS (SELECT id, count(*) n FROM e GROUP BY id), p AS (SELECT a.id a, b.id b, count(*) k FROM e a JOIN e b ON a.item = b.item AND a.id < b.id GROUP BY a.id, b.id)
    SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) > 0.4"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("items"))
    return corpus.jaccard_pairs(sets)


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM embeddings")
def cosine_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("v").alias("q")))  # the one query vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(q).select("vec_id", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 6).alias("cosine"))


@query(f"SELECT doc_id, cue_index, 'needs_review' AS action, 0.0::double AS confidence FROM ({CUES})")
def noop_decider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("doc_id", "cue_index", F.lit("needs_review").alias("action"), F.lit(0.0).alias("confidence"))

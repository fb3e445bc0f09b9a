"""Topics of a document: clusters of similar neighbouring chunks, and the graph of topic transitions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize

CLUSTER = "doc_id {}, first_chunk long, lo long, hi long, entities array<string>, categories array<string>, signals array<string>, n_chunks long, entity_overlap double, category_overlap double"

# Parts of the similarity of two topics.
ENTITY_PART, WORD_PART, SIGNAL_PART = 0.40, 0.35, 0.25


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, the shorter one padded with zeros; 0.5 if either is empty."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(1.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(dot(a, b) / (norm(a) * norm(b)))


def _overlap(a: set, b: Iterable) -> float:
    b = set(b)
    return len(a & b) / max(1, len(a | b))


def _absorb(chunks: pd.DataFrame, entity: float, category: float, gap: int) -> pd.DataFrame:
    """Seeds in order; each takes the later free chunks that resemble what it holds so far."""
    free = chunks.sort_values(["lo", "chunk_id"]).to_dict("records")
    out = []
    while free:
        seed, *rest = free
        held = {k: set(seed[k]) for k in ("entities", "categories", "signals")}
        end, n, last, free = seed["hi"], 1, (1.0, 1.0), []
        for k, x in enumerate(rest):
            if x["lo"] - end >= gap:  # the ones after it start later still
                free += rest[k:]
                break
            e, c = _overlap(held["entities"], x["entities"]), _overlap(held["categories"], x["categories"])
            if e > entity and c > category and abs(x["lo"] - end) < gap:
                end, n, last = max(end, x["hi"]), n + 1, (e, c)
                held = {name: v | set(x[name]) for name, v in held.items()}
            else:
                free.append(x)
        out.append((seed["doc_id"], seed["chunk_id"], seed["lo"], end, *(sorted(held[k]) for k in ("entities", "categories", "signals")), n, *(round(v, 3) for v in last)))
    return pd.DataFrame(out, columns=["doc_id", "first_chunk", "lo", "hi", "entities", "categories", "signals", "n_chunks", "entity_overlap", "category_overlap"])


def clusters(chunks: DataFrame, entity: float = 0.4, category: float = 0.3, gap: int = 50) -> DataFrame:
    """chunks(doc_id, chunk_id, lo, hi, entities, categories, signals) -> clusters, numbered per document.

    Greedy and ordered within an island of chunks; an island ends where no earlier chunk reaches within
    `gap` cues, as no cluster can cross that. Null entities mean a chunk without filter output: it is
    left out. Overlaps are those of the chunk absorbed last. Entities and the like are sorted."""
    d = chunks.filter("entities IS NOT NULL").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_id", "lo", "hi")], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("entities", "categories", "signals")])
    w = Window.partitionBy("doc_id").orderBy("lo", "chunk_id")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_island", F.sum(F.when(F.col("lo") - reach < gap, 0).otherwise(1)).over(w))
    schema = CLUSTER.format(chunks.schema["doc_id"].dataType.simpleString())
    c = d.groupBy("doc_id", "_island").applyInPandas(lambda p: _absorb(p, entity, category, gap), schema)
    return c.withColumn("cluster_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("lo", "first_chunk")) - 1)


def cluster_of(cues: DataFrame, clustered: DataFrame) -> DataFrame:
    """The first cluster whose range holds each cue; null where none does."""
    c = clustered.select(F.col("doc_id").alias("_d"), "lo", "hi", "cluster_id")
    j = cues.join(c, (cues.doc_id == F.col("_d")) & cues.cue_index.between(F.col("lo"), F.col("hi")), "left")
    return j.groupBy(*cues.columns).agg(F.min("cluster_id").alias("cluster_id"))


def context(clustered: DataFrame) -> DataFrame:
    """Topic context of each cluster as text; a label from entities and categories where none is given."""
    some = lambda c, k: F.concat_ws(", ", F.slice(F.filter(c, lambda x: x != ""), 1, k))
    listed = lambda c: F.when(some(c, 5) == "", "无").otherwise(some(c, 5))
    parts = F.concat_ws(" / ", F.filter(F.array(some("entities", 2), some("categories", 2)), lambda x: x != ""))
    label = F.when(parts == "", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))).otherwise(parts)
    return clustered.select("doc_id", "cluster_id", label.alias("topic_label"), listed("entities").alias("stable_entities"), listed("categories").alias("semantic_categories"), listed("signals").alias("semantic_signals"), F.concat_ws("-", "lo", "hi").alias("temporal_range"))


def similarity(a: str, b: str) -> Column:
    part = lambda p, c: F.col(f"{p}.{c}")
    return ENTITY_PART * jaccard(part(a, "entities"), part(b, "entities")) + WORD_PART * jaccard(part(a, "words"), part(b, "words")) + SIGNAL_PART * cosine(part(a, "signals"), part(b, "signals"))


def topic_graph(transitions: DataFrame, least: float = 0.75, near: int = 5) -> tuple[DataFrame, DataFrame]:
    """transitions(doc_id, seq, lo, hi, label, entities, words, signals) -> (nodes, edges).

    Nodes are numbered by (lo, seq). The first earlier node that is similar and not adjacent gives a
    RECURRENCE edge and its label; otherwise the previous node gives a DRIFT edge. Similarity above
    `least` needs a shared entity or word (signals alone reach 0.25), so candidates meet by equi-join."""
    if least < SIGNAL_PART:
        raise ValueError("least must be at or above the signals' part")
    empty = F.array().cast("array<string>")
    d = transitions.withColumn("node", F.row_number().over(Window.partitionBy("doc_id").orderBy("lo", "seq")) - 1)
    d = d.select("doc_id", "node", "lo", "hi", "label", F.coalesce("entities", empty).alias("entities"), F.coalesce("words", empty).alias("words"), F.coalesce("signals", F.array().cast("array<double>")).alias("signals"))
    d = materialize(d, "topic-nodes")
    token = F.array_distinct(F.concat(F.transform("entities", lambda x: F.concat(F.lit("e"), x)), F.transform("words", lambda x: F.concat(F.lit("w"), x))))
    t = d.select("doc_id", "node", F.explode(token).alias("t"))
    # no side is broadcast, here and below: compressed files hold many more rows than their size suggests
    pairs = t.alias("x").join(t.alias("y").hint("merge"), ["doc_id", "t"]).filter("y.node < x.node").select("doc_id", F.col("x.node").alias("node"), F.col("y.node").alias("from_node")).distinct()
    both = pairs.join(d.select("doc_id", "node", F.struct("lo", "hi", "entities", "words", "signals").alias("x")).hint("merge"), ["doc_id", "node"])
    both = both.join(d.select("doc_id", F.col("node").alias("from_node"), F.struct("lo", "hi", "entities", "words", "signals").alias("y")).hint("merge"), ["doc_id", "from_node"])
    apart = (F.abs(F.col("x.lo") - F.col("y.hi")) > near) & (F.abs(F.col("y.lo") - F.col("x.hi")) > near)
    again = both.withColumn("strength", similarity("x", "y")).filter((F.col("strength") > least) & apart)
    again = again.groupBy("doc_id", "node").agg(F.min_by(F.struct("from_node", "strength"), "from_node").alias("m")).select("doc_id", "node", "m.*")
    again = materialize(again, "topic-recurrence")
    here = d.select("doc_id", "node", F.struct("entities", "words", "signals").alias("x"))
    prior = F.lag(F.struct("entities", "words", "signals")).over(Window.partitionBy("doc_id").orderBy("node"))
    drift = here.join(d.select("doc_id", "node", prior.alias("y")).hint("merge"), ["doc_id", "node"]).filter("node > 0").join(again.select("doc_id", "node").hint("merge"), ["doc_id", "node"], "left_anti")
    drift = drift.select("doc_id", (F.col("node") - 1).alias("from_node"), F.col("node").alias("to_node"), F.lit("DRIFT").alias("transition_type"), (1 - similarity("x", "y")).alias("strength"))
    edges = again.select("doc_id", "from_node", F.col("node").alias("to_node"), F.lit("RECURRENCE").alias("transition_type"), "strength").unionByName(drift)
    label = d.select("doc_id", F.col("node").alias("root"), F.col("label").alias("_l"))
    nodes = d.drop("label").join(_roots(again.select("doc_id", "node", F.col("from_node").alias("root"))).hint("merge"), ["doc_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    return nodes.join(label.hint("merge"), ["doc_id", "root"]).select("doc_id", "node", "lo", "hi", F.col("_l").alias("label"), F.col("root").alias("label_of")), edges


def _roots(up: DataFrame) -> DataFrame:
    """The end of each chain of nodes, by pointer jumping: as many rounds as the longest chain has bits."""
    while True:
        over = up.select("doc_id", F.col("node").alias("root"), F.col("root").alias("_next"))
        jumped = materialize(up.join(over.hint("merge"), ["doc_id", "root"], "left"), "topic-roots")
        if jumped.filter("_next IS NOT NULL").isEmpty():
            return up
        up = jumped.select("doc_id", "node", F.coalesce("_next", "root").alias("root"))

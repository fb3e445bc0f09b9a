"""Ordered and stateful operators over cues(doc_id, cue_index, ...), by window functions and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_cue(*extra: str) -> Window:
    return Window.partitionBy("doc_id", *extra).orderBy("cue_index")


def chunk(cues: DataFrame, size: int = 100, overlap: int = 15) -> DataFrame:
    """Tumbling chunks by position; each cue also appears as context of its neighbours. Adds pos, chunk_id, role."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    d = cues.withColumn("pos", F.row_number().over(by_cue()) - 1).withColumn("last", F.floor((F.count("*").over(Window.partitionBy("doc_id")) - 1) / size))
    own, at = F.floor(F.col("pos") / size), F.col("pos") % size
    role = lambda name, chunk_id, ok: F.when(ok, F.struct(chunk_id.cast("long").alias("chunk_id"), F.lit(name).alias("role")))
    roles = F.array(role("target", own, F.lit(True)), role("before", own + 1, (at >= size - overlap) & (own + 1 <= F.col("last"))), role("after", own - 1, (at < overlap) & (own >= 1)))
    return d.withColumn("r", F.explode(F.filter(roles, lambda x: x.isNotNull()))).select(*cues.columns, "pos", "r.chunk_id", "r.role")


def neighbours(cues: DataFrame, n: int = 2) -> DataFrame:
    text = lambda a, z: F.concat_ws(" / ", F.collect_list("text").over(by_cue().rowsBetween(a, z)))
    return cues.withColumn("before", text(-n, -1)).withColumn("after", text(1, n))


def regions(problems: DataFrame, window: int = 2) -> DataFrame:
    """doc_id, cue_index of problem cues -> islands whose context windows touch."""
    gap = F.col("cue_index") - F.lag("cue_index").over(by_cue())
    d = problems.withColumn("region", F.sum(F.when(gap <= 2 * window + 1, 0).otherwise(1)).over(by_cue()))
    return d.groupBy("doc_id", "region").agg(F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"), F.count("*").alias("n_problems"))


def retention(n: Column) -> Column:
    return F.when(n >= 5, 1.0).otherwise(F.least(F.lit(0.98), F.lit(0.8) + n * 0.04))


def entity_memory(activations: DataFrame, least: float = 0.2) -> DataFrame:
    """doc_id, entity, cue_index -> final refresh count and last activation; forgotten entities restart.

    One fold per (doc, entity) over its distinct cue indexes."""
    acts = activations.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_set("cue_index")).alias("acts"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("last"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("long")
        lost = (s["last"] < 0) | (F.pow(retention(s["n"]), x - s["last"]) < least)
        n = F.when(lost, 0).when(retention(s["n"]) == 1.0, s["n"]).otherwise(s["n"] + 1)
        return F.struct(n.cast("int").alias("n"), x.alias("last"))

    return acts.withColumn("s", F.aggregate("acts", start, step)).select("doc_id", "entity", F.col("s.n").alias("refreshes"), F.col("s.last").alias("last_cue"))


def memory_before(cues: DataFrame, activations: DataFrame, least: float = 0.2) -> DataFrame:
    """doc_id, cue_index, entity, weight: what each cue(doc_id, cue_index) finds before it activates anything itself.

    The state after each activation comes from one fold per (doc, entity); a cue reads that of the last
    activation before it, decayed by the cues between. Entities below `least` are forgotten."""
    acts = activations.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_set(F.col("cue_index").cast("long"))).alias("acts"))
    none = F.expr("cast(array() as array<struct<n:int,last:bigint>>)")

    def step(done: Column, x: Column) -> Column:
        s = F.element_at(done, -1)
        lost = (F.size(done) == 0) | (F.pow(retention(s["n"]), x - s["last"]) < least)
        n = F.when(lost, 0).when(retention(s["n"]) == 1.0, s["n"]).otherwise(s["n"] + 1)
        return F.concat(done, F.array(F.struct(n.cast("int").alias("n"), x.alias("last"))))

    held = acts.withColumn("s", F.aggregate("acts", none, step))
    state = held.select("doc_id", "entity", F.explode(F.transform("s", lambda x, i: F.struct(x["n"].alias("n"), x["last"].alias("last"), F.get("acts", i + 1).alias("next")))).alias("x")).select("doc_id", "entity", "x.*")
    near = state.join(cues.select("doc_id", "cue_index").distinct(), "doc_id").filter((F.col("cue_index") > F.col("last")) & (F.col("next").isNull() | (F.col("cue_index") <= F.col("next"))))
    return near.select("doc_id", "cue_index", "entity", F.pow(retention(F.col("n")), F.col("cue_index") - F.col("last")).alias("weight")).filter(F.col("weight") >= least)


def category_state(cues: DataFrame, active: Column, rate: float = 0.7, least: float = 0.3) -> DataFrame:
    """Adds weight of the category after each cue: 1 when active, decaying since, 0 once below least."""
    last = F.last(F.when(active, F.col("cue_index")), ignorenulls=True).over(by_cue().rowsBetween(Window.unboundedPreceding, 0))
    weight = F.pow(F.lit(rate), F.col("cue_index") - last)
    return cues.withColumn("weight", F.when(weight >= least, weight).otherwise(0.0))


def temporal_memory(records: DataFrame, decay: float = 0.05, least: float = 0.1) -> DataFrame:
    """doc_id, entity, cue_index, confidence -> range, confidence and whether still active at the document's end."""
    d = records.groupBy("doc_id", "entity").agg(F.max("confidence").alias("confidence"), F.min("cue_index").alias("lo"), F.max("cue_index").alias("hi"))
    end = F.max("hi").over(Window.partitionBy("doc_id"))
    return d.withColumn("factor", F.exp(-decay * (end - F.col("hi")))).withColumn("active", F.col("factor") >= least)

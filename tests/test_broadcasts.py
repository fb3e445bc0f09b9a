"""Joins of sides that grow with the data are never broadcasts, whatever the size of their files."""

from lexweave.operators import aliases, corpus, language, topics


def planned(monkeypatch, module):
    """The plans of the tables that a module writes, as they are written."""
    plans, real = [], module.materialize

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(module, "materialize", written)
    return plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark):
    rows = [(0, k, 10 * k, 10 * k + 3, f"L{k}", ["a"] if k % 2 else ["b"], ["w"] if k % 2 else ["v"], [1.0]) for k in range(6)]
    return topics.topic_graph(spark.createDataFrame(rows, "doc_id long, seq long, lo long, hi long, label string, entities array<string>, words array<string>, signals array<double>"))


def test_topic_nodes(spark, monkeypatch):
    plans = planned(monkeypatch, topics)
    nodes, _ = graph(spark)
    assert len(plans) >= 3 and not any("Broadcast" in p for p in [*plans, plan(nodes)])
    assert {r.node: r.label for r in nodes.collect()} == {k: f"L{k % 2}" for k in range(6)}


def test_topic_edges(spark, monkeypatch):
    plans = planned(monkeypatch, topics)
    _, edges = graph(spark)
    assert not any("Broadcast" in p for p in [*plans, plan(edges)])
    assert {(r.from_node, r.to_node, r.transition_type) for r in edges.collect()} == {(0, 1, "DRIFT")} | {(k % 2, k, "RECURRENCE") for k in range(2, 6)}


def test_language_detector(spark, tmp_path):
    spark.createDataFrame([(1, 0, "他有芙芙好用"), (2, 0, "用夫妇打")], "sentence_id long, cue_index long, text string").write.parquet(f"{tmp_path}/text")
    text = spark.read.parquet(f"{tmp_path}/text")
    known = spark.createDataFrame([("芙芙", "芙宁娜", 0)], "surface string, canonical string, seq int")
    joins = lambda d: [x for x in plan(d).splitlines() if "Join" in x]
    contexts = language.alias_contexts(text, known)
    assert [x for x in joins(contexts) if "sentence_id" in x] and all("SortMergeJoin" in x for x in joins(contexts) if "sentence_id" in x)
    cues = text.select(text.sentence_id.alias("doc_id"), "cue_index", "text")
    found = language.detect(cues, known, corpus.ngram_counts(text.filter("sentence_id = 1").select("text")), contexts, {"芙": "fu", "夫": "fu", "妇": "fu"})
    large = [x for x in joins(found) if "doc_id" in x or "gram" in x or "LeftOuter" in x and "surface" in x]
    assert large and all("SortMergeJoin" in x for x in large) and not any("BuildLeft" in x for x in joins(found))
    assert {(r.doc_id, r.surface, r.value) for r in found.collect()} >= {(1, "芙芙", "芙芙"), (2, "夫妇", "芙芙")}


def test_alias_mining_terms(spark, tmp_path):
    spark.createDataFrame([(1, "ab cd ab"), (2, "xab"), (3, ""), (4, None)], "sentence_id long, sentence string").write.parquet(f"{tmp_path}/text")
    spark.createDataFrame([("ab",), ("ab",), ("cd ",), ("",), (None,)], "alias string").write.parquet(f"{tmp_path}/aliases")
    text, short = spark.read.parquet(f"{tmp_path}/text"), spark.read.parquet(f"{tmp_path}/aliases")
    at = [x for x in plan(aliases.evidence(text, short)).splitlines() if "Join [sentence_id" in x]
    assert at and all("SortMergeJoin" in x for x in at)
    # as if the list were long, or of unknown size as one that comes from the driver: no file tells which side is small
    for most, unknown in ((100_000, False), (100_000, True), (0, False)):
        d = spark.createDataFrame(short.rdd, short.schema) if unknown else short
        found = aliases.occurrences_in(text, d, broadcast_aliases=most)
        assert "BuildLeft" not in plan(found) and ("BroadcastHashJoin" in plan(found)) == (most > 0)
        assert {(r.sentence_id, r.alias, r.first) for r in found.collect()} == {(1, "ab", 0), (1, "cd ", 3), (2, "ab", 1)}
        assert {(r.alias, r.evidence) for r in aliases.evidence(text, d).collect()} == {("ab", 2), ("cd ", 1)}

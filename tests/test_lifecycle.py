"""Term store, alias life cycle, look-up and guide corpus: golden cases and plain Python."""

import pytest
from lexweave.functions import phonetic
from lexweave.functions.text import normalize
from lexweave.operators import aliases, discovery, evaluation, lookup, terms
from lexweave.plans import lifecycle
from lexweave.sources import guide, lexicons, subtitles
from lexweave.streaming import memory
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_import_rules(spark):
    names = "term string, aliases string, category string, game_title string, source string, trust_level string, parent_entity string"
    d = spark.createDataFrame([("菜", "角色", "food", "", "", "", ""), ("词", " a | |b ", "x", "g", "s", "0.7", "p"), (None, "a", "x", "", "", "1", ""), ("坏", "", "x", "", "", "abc", "")], names)
    got = {r.term: r for r in terms.imported(d).collect()}
    assert set(got) == {"菜", "词"} and got["菜"].parent == "角色" and got["菜"].aliases == [] and got["菜"].trust == 0.5
    assert got["词"].aliases == ["a", "b"] and got["词"].trust == 0.7 and terms.imported(d.limit(0)).collect() == []


def test_read_terms_drops_the_mark(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbfterm,aliases,category,trust_level\nabc,x|y,c,0.9\n,z,c,1\n")
    got = terms.read_terms(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.term, r.aliases, r.trust, r.parent) for r in got] == [("abc", ["x", "y"], 0.9, "")]


def test_merge_into_an_empty_store_and_again(spark):
    t, a = terms.empty_store(spark)
    new = spark.createDataFrame([("b", "c", None, None, "s", 0.1, ["x", "x"], 1), ("b", "c", "", "", "s2", 0.2, ["y"], 2), ("a", None, None, "p", None, 0.3, [], 3)], "term string, category string, game string, parent string, source string, trust double, aliases array<string>, seq long")
    t1, a1 = terms.merged(t, a, new)
    assert rows(t1.select("term_id", "term", "source", "trust")) == [(0, "a", None, 0.3), (1, "b", "s2", 0.2)]
    assert rows(a1.select("term_id", "alias")) == [(1, "x"), (1, "y")]
    t2, a2 = terms.merged(t1, a1.withColumn("alias_type", F.lit("kept")), new.withColumn("trust", F.col("trust") + 1))
    assert rows(t2.select("term_id", "trust")) == [(0, 1.3), (1, 1.2)] and {r.alias_type for r in a2.collect()} == {"kept"}
    assert rows(terms.merged(t2, a2, new.limit(0))[0]) == rows(t2)
    assert rows(terms.listed(t2, a2).select("term", "aliases")) == [("a", []), ("b", ["x", "y"])]


def test_history_is_appended(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, "ab", "ac", [("v",)], "v", 0.5), (1, 1, "ab", "ab", [], "v", 0.5)], "doc_id long, cue_index long, raw_text string, corrected_text string, candidates array<struct<value:string>>, selected string, confidence double")
    for _ in range(2):
        terms.record(d, str(tmp_path / "h"))
    got = spark.read.parquet(str(tmp_path / "h"))
    assert got.count() == 4 and rows(got.select("selected").distinct()) == [("v",), (None,)][::-1] or {r.selected for r in got.collect()} == {"v", None}


def plain_population(term, category, w):
    """The rules of population, one term at a time."""
    if category not in w.categories or len(term) < 4:
        return []
    if category in (w.set_category, w.piece_category) and any(term.startswith(b) or term.endswith(b) for b in w.basic):
        return []
    t = "".join(c for c in term if c not in terms.BRACKETS)
    if len(t) < 4:
        return []
    ok = lambda a: len(a) >= 2 and a not in w.blocked and not any(x in a for x in w.linkers) and a[0] not in w.blocked_first and a[-1] not in w.blocked_last and any(c.islower() and c.isascii() for c in a)
    most = 2 if category == w.weapon_category and len(t) == 4 else 3
    found = []
    for a in [t[-k:] for k in (3, 2) if k <= most] + [t[:k] for k in (2, 3) if k <= most]:
        if ok(a) and a not in found:
            found.append(a)
    if category == w.set_category:
        found += [a + w.set_mark for a in found if a + w.set_mark not in found]
    at = t.find(w.joint)
    meaning = t[:at] if 0 < at < len(t) - 1 else None

    def points(a):
        base, s = a.replace(w.set_mark, ""), 0
        if meaning:
            s += 15 if a in (meaning, meaning + w.set_mark) else 12 if base == meaning else 0
        s += 10 if t.endswith(a) else 8 if t.endswith(base) else 5 if t.startswith(a) else 3 if t.startswith(base) else 0
        return s + 5 * a.endswith(w.set_mark) + {2: 3, 3: 1}.get(len(a), 0)

    if len(found) > 2:
        found = sorted(found, key=lambda a: -points(a))[:2]
    if category == w.set_category and any(a.endswith(w.set_mark) for a in found):
        bare = {a.replace(w.set_mark, "") for a in found if a.endswith(w.set_mark)}
        found = [a for a in found if a.endswith(w.set_mark) or a not in bare]
    out = []
    starts, ends = [[a for a in found if f(a.replace(w.set_mark, ""))] for f in (t.startswith, t.endswith)]
    for a in found:
        base = a.replace(w.set_mark, "")
        if category == w.weapon_category and t[:2] in w.blocked:
            if t.endswith(base):
                out.append((a, 1))
            elif a != t[:2]:
                out.append((a, 0))
        elif category == w.piece_category:
            out.append((a, 0))
        elif category == w.set_category:
            out.append((a, int(a.endswith(w.set_mark))))
        elif meaning:
            out.append((a, int(base == meaning or a == meaning + w.set_mark)))
        elif category == w.weapon_category and len(found) == 2 and starts and ends:
            out.append((a, int(a in starts)))
        else:
            out.append((a, int(a == sorted(found, key=lambda x: -points(x))[0])))
    return [(a, aliases.PRIMARY if p else aliases.SECONDARY) for a, p in out if len(a) >= 2]


def test_population(spark):
    from dataclasses import replace

    w = replace(lifecycle.LATIN, blocked=("rin", "sm", "re"))
    extra = [(9000 + i, t, c) for i, (t, c) in enumerate((a + b, c) for a in ("abcd", "redx", "ab cde", "tinyq", "(abc)d", "xyabt", "a bcd") for b in ("", "yz") for c in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "none"))]
    parts = [(r.p_partkey, r.p_name, r.p_type) for r in spark.read.parquet(f"{SF}/part.parquet").collect()] + extra
    d = spark.createDataFrame(parts, "term_id long, term string, category string")
    old = spark.createDataFrame([(9000, "cd", "x")], terms.ALIASES)
    got = aliases.populated(d, old, words=w)
    want = [(i, a, k, (i, a) != (9000, "cd")) for i, t, c in parts for a, k in plain_population(t, c, w)]
    assert rows(got.select("term_id", "alias", "alias_type", "is_new")) == sorted(want, key=repr) and len({k for _, _, k, _ in want}) == 2
    assert sum(r.generated for r in aliases.population_counts(got).collect()) == sum(x[3] for x in want)
    assert aliases.populated(d.limit(0), old).collect() == []


def test_population_of_the_zh_lists(spark):
    t = spark.createDataFrame([(1, "绝缘之旗印", "artifact"), (2, "试作金珀", "weapon"), (3, "冬极白星", "weapon"), (4, "冒险家金杯", "artifact_piece"), (5, "某某之花", "artifact_piece")], "term_id long, term string, category string")
    got = {}
    for r in aliases.populated(t, spark.createDataFrame([], terms.ALIASES)).collect():
        got.setdefault(r.term_id, set()).add((r.alias, r.alias_type.rsplit("_", 1)[-1]))
    assert got == {1: {("绝缘套", "primary")}, 2: {("金珀", "primary")}, 3: {("冬极", "primary"), ("白星", "secondary")}, 5: {("某某", "secondary")}}


def test_evidence(spark):
    texts = ["ab xx ab", "no", "zab", "AB", "", "  ab  and a long tail of this line", "ab1", "ab2"]
    s = spark.createDataFrame(list(enumerate(texts)), "sentence_id long, sentence string")
    a = spark.createDataFrame([("ab",), ("zzz",), ("x",)], "alias string")
    got = {r.alias: (r.evidence, r.examples) for r in aliases.evidence(s, a).collect()}
    want = [t[max(0, t.find("ab") - 6) : t.find("ab") + 8].strip() for t in texts if "ab" in t]
    assert got["ab"] == (len(want), want[:5]) and got["x"][0] == 1 and "zzz" not in got
    assert aliases.evidence(s, a.limit(0)).collect() == []


def test_flags_and_routes(spark):
    got = spark.createDataFrame([("b|a",), (None,), ("needs_review",)], "f string").select(aliases.with_flag(F.col("f"), "needs_review")).collect()
    assert [r[0] for r in got] == ["a|b|needs_review", "needs_review", "needs_review"]


def test_alias_files(spark):
    names = ["alias_surface", "canonical_term", "alias_type", "review_status", "confidence"]
    d = spark.createDataFrame([(" a ", "b", "", "", ""), ("x", "x", "asr_alias", "approved", "1"), ("", "y", "", "", ""), ("c", "d", "bad", "pending", "0.2"), ("e", "f", "asr_alias", "odd", "0.2"), ("g", "h", "asr_alias", "approved", "none")], names)
    got = lexicons.alias_candidates(d)
    assert [(r.alias_surface, r.error is None) for r in got.collect()] == [("a", True), ("x", False), ("c", False), ("e", False), ("g", False)]
    assert [(r.alias_type, r.review_status, r.confidence) for r in lexicons.checked(got.filter("error IS NULL")).collect()] == [("asr_alias", "pending", 0.5)]
    with pytest.raises(Exception, match="surface is the canonical term|unknown|not a number"):
        lexicons.checked(got).collect()


def test_weighted_ratio():
    assert lookup.weighted_ratio("abc", "abc") == 100 and lookup.weighted_ratio("", "abc") == 0
    assert lookup.weighted_ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert lookup.weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(95.0)
    assert lookup.partial_ratio("abc", "xxabcxx") == 100 and lookup.weighted_ratio("abc", "xxabcxx") == pytest.approx(90.0)


def test_lookup_against_loops(spark):
    """Every window against every surface, without a prefilter."""
    words = ["ring", "widget", "gadget", "bolt", "gear"]
    d = spark.createDataFrame([(w, w + " x", "c", "par" if w == "bolt" else "", i) for i, w in enumerate(words)], "surface string, term string, category string, parent string, seq long")
    texts = ["a wigdet here", "the bolts", "gadge", "nothing", "", "rings and gera"]
    cues = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, cue_index long, text string")
    active = spark.createDataFrame([("par", 0.2)], "entity string, weight double")
    readings = phonetic.han_readings(spark)
    want = {}
    for i, t in enumerate(texts):
        for w in words:
            scores = [lookup.weighted_ratio(t, w)] if w in t else []
            for n in range(2, 7):
                for k in range(len(t) - n + 1):
                    x = t[k : k + n]
                    if not x.isalpha() or w in t:
                        continue
                    scores.append(phonetic.ratio(x, w))
                    spelling = " ".join(phonetic.syllables(x, readings))
                    if spelling and x != w:
                        r = phonetic.ratio(spelling, " ".join(phonetic.syllables(w, readings)))
                        scores.append(min(r * 1.05, 100) if r >= 82 else 0)
            best = max([s for s in scores if s >= 82], default=0)
            if best:
                want[i, w + " x"] = round(min(100, best + 3) if w == "bolt" else best, 6)
    got = {(r.cue_index, r.term): round(r.score, 6) for r in lookup.lookup(cues, d, active, readings).collect()}
    assert got == want and len(want) >= 4
    assert lookup.lookup(cues.limit(0), d, active, readings).collect() == []
    assert lookup.lookup(cues, d.limit(0), active, readings).collect() == []


def test_nicknames_by_sound(spark):
    cues = spark.createDataFrame([(1, 0, "弗丽娜")], "doc_id long, cue_index long, token string")
    nick = spark.createDataFrame([("芙莉娜", "x", 0), ("白术", "y", 1), ("芙丽娜", "z", 2)], "surface string, canonical string, seq long")
    got = lookup.sounds_like_nickname(cues, nick, phonetic.han_readings(spark)).collect()
    assert [(r.surface, r.ratio) for r in got] == [("芙莉娜", 100.0)]


def test_detectors():
    d = lookup.Detectors().add("a", lookup.entity_risk)
    with pytest.raises(ValueError, match="there already"):
        d.add("a", lookup.entity_risk)


def test_answers(spark):
    d = spark.createDataFrame([(1, 0, '```json\n{"confirmed_entities":[{"entity":"a"}]}\n```'), (1, 1, "{}"), (1, 2, "[1]"), (1, 3, None), (1, 4, "{bad")], "doc_id long, chunk_id long, reply string")
    got = {r.chunk_id: r.answer for r in discovery.answers(d).collect()}
    assert got[0].confirmed_entities[0].entity == "a" and got[0].semantic_signals == [] and got[1].possible_transition is False
    assert got[2] is None and got[3] is None and got[4] is None
    assert rows(discovery.confirmations(discovery.answers(d))) == [(1, 0, "a")]


def test_a_chunk_without_an_answer_keeps_its_candidates(spark):
    cues = spark.createDataFrame([(1, i, f"word{i} text") for i in range(10)], "doc_id long, cue_index long, text string")
    detect = lambda c: c.select("doc_id", "cue_index", F.lit(0).alias("ord"), F.lit("x").alias("surface"), F.lit("x").alias("value"), F.lit(0.5).alias("score"), F.lit("exact").alias("source"))
    out = discovery.run(cues, detect, 4, 1, ask=lambda d: d.filter("chunk_id = 0").select("doc_id", "chunk_id", F.lit("{}").alias("reply")))
    assert out["candidates"].count() == 10 and rows(out["answers"].select("chunk_id", F.col("answer").isNull())) == [(0, False), (1, True), (2, True)]
    assert rows(out["density"].select("chunk_id", "problems", "window")) == [(0, 4, 1), (1, 4, 1), (2, 2, 1)]


PAGE = "<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><div class='sidebar-x'>side</div><article><h1>H</h1><p>{0}</p><br><script>no</script><div class=comment>hi</div></article><p>tail</p></body></html>"


def test_guide_articles(spark):
    long = "sentence number one is here! " * 10
    title, text = guide.article(PAGE.format(long), "stem")
    assert title == "T" and text.startswith("H\nsentence number one is here!") and "menu" not in text and "hi" not in text and "tail" not in text
    assert guide.article(PAGE.format("short"), "stem")[1] == "H\nshort\ntail"
    assert guide.article(None, "stem") == ("stem", "") and guide.article("<p>x", "stem") == ("stem", "x")
    pages = spark.createDataFrame([("a.html", PAGE.format(long)), ("b.html", PAGE.format(long)), ("c.html", None)], "path string, value string")
    posts = spark.createDataFrame([("p.json", "no json"), ("q.json", '{"data":{"post":{"post":{"subject":" S ","structured_content":"[]","content":"' + "ab<br>" * 100 + '"}}}}')], "path string, value string")
    kept, cut = guide.build(pages, posts, "g")
    assert rows(kept.select("path", "title")) == [("a.html", "T"), ("q.json", "S")] and cut.count() > 0


def test_guide_corpus_is_written(spark, tmp_path):
    d = spark.createDataFrame([("s", "p", "t", "x", "h")], "source string, path string, title string, text string, content_hash string")
    guide.write(d, d.withColumnRenamed("text", "sentence"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "sentences")).count() == 1


def test_model_totals_follow_what_was_kept(spark, tmp_path):
    g = spark.createDataFrame([(f"g{i:02}", i, 2) for i in range(20)], "gram string, cnt long, n int")
    c = spark.createDataFrame([("t", f"c{i}", 1) for i in range(5)], "term string, context string, cnt long")
    kept, near = evaluation.kept_model(g, c, 3, 2)
    assert rows(kept.select("gram")) == [("g17",), ("g18",), ("g19",)] and rows(near.select("context")) == [("c0",), ("c1",)]
    evaluation.save_model(g, c, str(tmp_path))
    assert evaluation.load_model(spark, str(tmp_path))[0].agg(F.sum("cnt")).first()[0] == sum(range(20))


def test_subtitles_round_trip(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,500\nfirst line\nsecond\n\n2\n01:02:03,004 --> 01:02:05,500\n\n"
    (tmp_path / "a.srt").write_text(text)
    got = subtitles.read_srt(spark, str(tmp_path / "a.srt"))
    assert [tuple(r)[1:] for r in got.orderBy("cue_index").collect()] == [(0, 1000, 2500, "first line\nsecond"), (1, 3723004, 3725500, "")]
    subtitles.write_srt(got.withColumn("doc_id", F.lit("d")), str(tmp_path / "out"))
    again = "".join(p.read_text() for p in sorted((tmp_path / "out" / "doc_id=d").glob("part-*")))
    assert "00:00:01,000 --> 00:00:02,500\nfirst line\nsecond" in again and "01:02:03,004" in again
    assert rows(spark.createDataFrame([("a.SRT",), ("b.vtt",), ("c",)], "p string").select(subtitles.file_format(F.col("p")))) == [("srt",), ("unknown",), ("vtt",)]


def test_normalize(spark):
    d = spark.createDataFrame([(" a ，  eq Q1 beq ",), ("",), (None,)], "t string").select(normalize(F.col("t")))
    assert [r[0] for r in d.collect()] == ["a, QE QE beq", "", None]




def test_the_whole_way(spark):
    from lexweave.operators import decisions, production

    cues = spark.createDataFrame([(1, 0, "芙宁娜来了"), (1, 1, "弗丽娜出场"), (1, 2, "没有什么"), (2, 0, "弗丽娜出场"), (1, 3, None)], "doc_id long, cue_index long, text string")
    entries = spark.createDataFrame([("芙宁娜", "芙宁娜", "character", "", 0), ("那维莱特", "那维莱特", "character", "", 1)], "surface string, term string, category string, parent string, seq long")
    readings = phonetic.han_readings(spark)
    out = production.correct(cues, entries, readings, decisions.RuleDecider(0.75))
    text = {(r.doc_id, r.cue_index): r.edited for r in out["text"].collect()}
    # the name stands in document 1 only
    assert text == {(1, 0): "芙宁娜来了", (1, 1): "芙宁娜出场", (1, 2): "没有什么", (2, 0): "弗丽娜出场", (1, 3): None}
    held = spark.createDataFrame([("弗丽娜", "preserve_surface", "registry")], "surface string, policy string, source string")
    kept = production.correct(cues, entries, readings, decisions.RuleDecider(0.75), policies=held)
    assert {r.edited for r in kept["text"].collect()} == {r.text for r in cues.collect()}
    assert production.correct(cues, entries.limit(0), readings, decisions.NoDecider())["edits"].collect() == []


def test_activity_windows_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:05:00", "a"), ("2024-01-01 00:40:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, entity string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, entity string").json(str(tmp_path / "in"))
    q = memory.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.entity, r.n) for r in spark.sql("select * from activity").collect()) == [("a", 2), ("b", 1)]


def test_ass_and_one_file_for_each_document(spark, tmp_path):
    ass = "\ufeff[Script Info]\r\n[Events]\r\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\r\nDialogue: 0,0:00:01.05,1:02:03.50,Top,,0,0,0,,one, two\\Nthree\r\nComment: 0,0:00:01.00,0:00:02.00,x,,0,0,0,,no\r\nDialogue: broken\r\n"
    (tmp_path / "a.ass").write_bytes(ass.encode())
    got = subtitles.read_ass(spark, str(tmp_path / "a.ass")).collect()
    assert [tuple(r)[1:] for r in got] == [(0, "Top", 1050, 3723500, "one, two\\Nthree")]
    cues = spark.createDataFrame([("x", 1, 5, 6, "b"), ("x", 0, 1, 2, "a\nc"), ("y", 0, 3, 4, "d")], "doc_id string, cue_index long, start_ms long, end_ms long, text string")
    subtitles.write_documents(cues, str(tmp_path / "out"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("*/part-*")}
    assert len(files) == 2 and files["doc_id=x"].startswith("1\n00:00:00,001 --> 00:00:00,002\na\nc\n\n2\n")
    assert subtitles.parse_ass(spark.createDataFrame([(1, None), (2, "")], "doc_id long, value string")).collect() == []


def test_settings():
    from lexweave import settings

    s = settings.from_mapping({"matcher": {"fuzzy_threshold": 80}, "categories": {"hot": ["a"]}, "chunk_size": 5, "chunk_overlap": 1})
    assert (s.matcher.fuzzy_threshold, s.matcher.max_candidates, s.categories.hot, s.chunk_size) == (80, 8, ("a",), 5)
    for bad, why in (({"matcher": {"odd": 1}}, "unknown setting matcher.odd"), ({"entity_memory": {"decay_rate": 2}}, "between"), ({"normalization": {"spacing": 1}}, "must be like"), ({"chunk_size": "x"}, "must be like")):
        with pytest.raises(ValueError, match=why):
            settings.from_mapping(bad)
    assert settings.load() == settings.Settings()


def test_memory_before_by_a_loop(spark):
    from lexweave.operators import ordered

    acts = [(1, "a", c) for c in (0, 3, 4, 9, 30)] + [(1, "b", 2), (2, "a", 1)]
    cues = [(d, c) for d in (1, 2) for c in range(35)]
    want = set()
    for d, c in cues:
        for e in "ab":
            n, last = None, None
            keep = lambda n: 1.0 if n >= 5 else min(0.98, 0.8 + n * 0.04)
            for x in sorted(k for dd, ee, k in acts if (dd, ee) == (d, e) and k < c):
                n = 0 if n is None or keep(n) ** (x - last) < 0.2 else n + (keep(n) != 1.0)
                last = x
            if n is not None and keep(n) ** (c - last) >= 0.2:
                want.add((d, c, e, round(keep(n) ** (c - last), 9)))
    got = ordered.memory_before(spark.createDataFrame(cues, "doc_id long, cue_index long"), spark.createDataFrame(acts, "doc_id long, entity string, cue_index long"))
    assert {(r.doc_id, r.cue_index, r.entity, round(r.weight, 9)) for r in got.collect()} == want


def test_jaccard_pairs_by_a_loop(spark):
    import random

    from lexweave.operators import corpus

    rng = random.Random(2)
    sets = [(i, [rng.choice([0, 0, 0, *range(1, 12)]) for _ in range(rng.randrange(0, 9))]) for i in range(60)] + [(60, None), (61, [None, 1])]
    for least in (0.2, 0.4, 0.75, 1.0):
        want = {(a, b, round(j, 9)) for a, x in sets for b, y in sets if a < b and x and y for p, q in [({*x} - {None}, {*y} - {None})] for j in [len(p & q) / len(p | q)] if j > least}
        got = corpus.jaccard_pairs(spark.createDataFrame(sets, "id long, items array<int>"), least).collect()
        assert {(r.a, r.b, round(r.jaccard, 9)) for r in got} == want

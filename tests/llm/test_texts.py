"""Decontamination, packing, extraction and the pipeline against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from lexweave import session
from lexweave.llm import decontam, html_extract, jaccard_join, langid, packing
from tests.llm.conftest import EDGE, SF


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(rows, items):
    at = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            at[tuple(w[i : i + 10])] |= set() if item is None else {str(item)}
    sizes = {len(k) for k in at}
    out = []
    for d, t in rows:
        w = words(t)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in at:
                    hit |= set(range(i, i + n))
                    names |= at[k]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df, n=99):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


def test_decontamination(spark, corpus, edge, empty, clash, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = spark.createDataFrame(corpus, edge.schema)
    want = brute_hits([(r[0], r[1]) for r in corpus], items)
    assert got(decontam.op9(docs, bench)) == want and sum(r[5] for r in want) > 0
    own = spark.createDataFrame([(1, "Two THREE"), (2, None), (3, "!!"), (4, "a b c d e a b c d e a"), (5, "two three"), (None, "x y")], "item_id long, text string")
    items = [(r.item_id, r.text) for r in own.collect()]
    assert got(decontam.op9(clash(edge), clash(own))) == brute_hits([(r[0], r[1]) for r in EDGE], items)
    assert decontam.op9(empty, bench).collect() == [] and not any(r.n_hit for r in decontam.op9(edge, own.limit(0)).collect())
    clean = decontam.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert got(decontam.op9(docs, bench)) == want and decontam.keep_clean(docs, bench).count() == clean.count()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 8)
    assert got(decontam.op9(edge, own)) == brute_hits([(r[0], r[1]) for r in EDGE], items)


def test_decontamination_in_blocks_keeps_rows(spark, clash, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number{i} holds some words of its own") for i in range(20)], "item_id long, text string")
    rows = [(1, "item number3 holds some words of its own"), (1, "nothing here"), (None, "x item number5 holds some words of its own y"), (None, None), (1, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_hits(rows, [(r.item_id, r.text) for r in bench.collect()])
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert got(decontam.op9(clash(docs).withColumn("_row", docs.doc_id), bench)) == want and len(want) == 5


def test_words_beyond_the_alphabet(corpus):
    items = [(str(i), r[1]) for i, r in enumerate(corpus[:40])] + [(None, "one two")]
    one, two = decontam.Windows(items), decontam.Windows(items, alphabet=50)
    assert (one.wide, two.wide) == (1, 2)
    for r in corpus[:120]:
        a, b = one.scan(r[1]), two.scan(r[1])
        assert a[0] == b[0] and (a[1] == b[1]).all() and a[2] == b[2]


def test_hit_spans_point_into_the_original():
    w = decontam.Windows([("a", "One two, three")])
    text = "é: ONE--two three; four one two"
    n, hit, names, _ = w.scan(text)
    assert n == 7 and names == {"a"}
    (a, z), = decontam.byte_spans(text, hit)
    assert text.encode()[a:z] == b"ONE--two three"


def test_packing(spark, corpus, edge, empty, clash):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for rows, docs in ((corpus, spark.createDataFrame(corpus, edge.schema)), (EDGE, clash(edge))):
        want = Counter()
        for r in rows:
            ids = np.array([*exact.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            first = len(ids) % 1024
            cuts = sorted({0, *range(first, len(ids), 1024)})
            for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
                want[r[0], k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
        out = packing.op7(docs).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
        seqs = defaultdict(list)
        for r in out:
            seqs[r.sequence_id].append((r.offset, r.length))
        for s in seqs.values():
            s.sort()
            assert all(o == sum(n for _, n in s[:i]) for i, (o, _) in enumerate(s)) and sum(n for _, n in s) <= 1024
    assert packing.op7(empty).collect() == []
    special = packing.encoder()("a<|endoftext|>b")
    assert special == exact.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_plans_use_up_the_histogram_and_fill_sequences():
    rng = np.random.default_rng(0)
    for hist in ({1: 5}, {1024: 3}, {600: 100}, {}, {int(k): int(v) for k, v in zip(rng.permutation(1024)[:400] + 1, rng.integers(1, 50, 400), strict=True)}):
        left = Counter()
        for lengths, times in packing.plan(hist):
            assert sum(lengths) <= 1024 and times > 0
            for n in lengths:
                left[n] += times
        assert left == Counter(hist)
    many = Counter(rng.integers(1, 1025, 20000).tolist())
    used = sum(t for _, t in packing.plan(dict(many)))
    assert used <= 1.003 * sum(n * k for n, k in many.items()) / 1024


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>bad</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home {0}</a></ul></nav><div class="cookie-notice"><p>We use cookies</div>
<div id="sidebar">Side {0}</div><!-- gone <p>no</p> --><article><h1>Title  {0} &amp; more</h1><p>First <b>bold</b>
para {0}&nbsp;x<br>line<p>Second &lt;tag&gt; {0}<div class="share">Tweet</div><ul><li>one {0}<li>two</ul>
<p>Sign up for updates to this fine site</p><form><p>Mail</p></form><section class="comments"><p>Nice!</p></section></article><footer>&copy; {0}</footer>"""


def test_extraction(spark):
    rows = [(i, "http://User@Host.example:80/a", PAGE.format(f"n{i} " + "y" * (i + 3))) for i in range(9)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://h2/", "plain text &amp; only"), (53, "http://h2/", "<div><p>a<p>b"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in html_extract.op6(pages).collect()}
    v = "n3 yyyyyy"
    assert out[3].text == f"Title {v} & more\n\nFirst bold para {v} x line\n\nSecond <tag> {v}\n\none {v}\n\ntwo"
    assert out[3].n_chars == len(out[3].text) and (out[50].text, out[51].text, out[52].text, out[53].text) == ("", "", "plain text & only", "a\n\nb")
    assert html_extract.op6(pages).count() == len(rows) and html_extract.op6(pages.limit(0)).collect() == []


def test_extraction_keeps_parents_and_siblings(spark):
    page = '<body><nav>Home</nav><article><h1 class="related">Title {0}</h1><p>lead {0}</p><div class=body><p>long body text {0} {0} {0}</p></div><section class=more><p>more {0}</p></section></article></body>'
    rows = [(i, "http://h/a", page.format(f"n{i} " + "y" * (i + 3))) for i in range(9)] + [(50, "http://one/", page.format("z"))]
    out = {r.page_id: r.text for r in html_extract.op6(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    v = "n3 yyyyyy"
    assert out[3] == f"Title {v}\n\nlead {v}\n\nlong body text {v} {v} {v}\n\nmore {v}"
    assert out[50] == "Title z\n\nlead z\n\nlong body text z z z\n\nmore z"


def test_extraction_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.op6(pages).collect():
        body = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
        import html

        assert r.text == "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_tree_matching():
    a, b = (html_extract.parse(x) for x in ("<div><p>1</p><p>2</p><ul></ul><h2></h2></div>", "<div><p>9</p><h2></h2><table></table></div>"))
    assert html_extract.Matching(a, b).of(0, 0)[0] == 3


def test_tree_matching_against_recursion():
    """Random trees against the plain recursive definition over runs."""
    import random
    from functools import cache

    rng = random.Random(3)

    def tree(depth):
        return "".join(f"<{s}>{tree(depth - 1) if depth else ''}</{s}>" for s in (rng.choice(["div", "section", "ul", "span"]) for _ in range(rng.randrange(4))))

    for _ in range(60):
        a, b = html_extract.parse(tree(3)), html_extract.parse(tree(3))

        @cache
        def size(u, v, i, j, a=a, b=b):
            x, y = a.runs(u), b.runs(v)
            if not i or not j:
                return 0
            best = max(size(u, v, i - 1, j), size(u, v, i, j - 1))
            if x[i - 1][0] == y[j - 1][0]:
                s, z = x[i - 1][1][0], y[j - 1][1][0]
                best = max(best, size(u, v, i - 1, j - 1) + 1 + size(s, z, len(a.runs(s)), len(b.runs(z))))
            return best

        same = [s for s, _ in a.runs(0)] == [s for s, _ in b.runs(0)]
        got, pairs = html_extract.Matching(a, b).of(0, 0)
        assert got == size(0, 0, len(a.runs(0)), len(b.runs(0))) or same
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_extraction_of_broken_and_deep_pages(spark, clash):
    deep = "<div>" * 50_000 + "core text" + "</div>" * 50_000
    rows = [(1, "http://d/", deep), (2, "http://d/", deep.replace("core", "other")), (3, "http://e/", "<b><i>" * 20_000 + "x<p>y" * 3), (4, "http://f/", "<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl><ul><li>g<li>h</ul>"), (5, "http://g/", "<p>1" * 5_000)]
    rows += [(10 + i, "http://wide/", "<main>" + "".join(f"<{'section' if k % 2 else 'div'}>t{i} {k}</{'section' if k % 2 else 'div'}>" for k in range(600 + i)) + "</main>") for i in range(6)]
    out = {r.page_id: r.text for r in html_extract.op6(clash(pages_of(spark, rows))).collect()}
    assert (out[1], out[2], out[3]) == ("core text", "other text", "x\n\nyx\n\nyx\n\ny")
    assert out[4].split("\n\n") == list("abcdefgh") and out[5] == "\n\n".join(["1"] * 5_000)
    assert out[13].split("\n\n") == [f"t3 {k}" for k in range(603)]


def test_the_wrapper_decides_without_telling_names(spark):
    side = " ".join(f"sidebar sentence {k} says the same on each page" for k in range(60))
    page = "<body><div class=x1><div class=q>{1}</div></div><div class=x2><div class=z><h2>Title {0}</h2><div class=notice><p>note {0}</p></div><p>body of {0}</p></div></div><div class=x3>all rights</div></body>"
    rows = [(i, "http://h/", page.format(f"n{i} " + "y" * (i + 2), side)) for i in range(12)]
    out = {r.page_id: r.text for r in html_extract.op6(pages_of(spark, rows)).collect()}
    for i in (0, 5, 11):
        v = f"n{i} " + "y" * (i + 2)
        assert out[i] == f"Title {v}\n\nnote {v}\n\nbody of {v}"
        assert side in html_extract.extract(html_extract.align(html_extract.parse(rows[i][2]), html_extract.name_reference(html_extract.parse(rows[i][2]))), None, set(), True)
    links = '<div class="related">' + "".join(f'<a href="/{{0}}/{k}">see {{0}} {k}</a> ' for k in range(30)) + "</div>"
    rows = [(i, "http://h/", page.replace("<p>body", links + "<p>body").format(f"n{i}", side)) for i in range(12)]
    out = {r.page_id: r.text for r in html_extract.op6(pages_of(spark, rows)).collect()}
    assert out[3] == "Title n3\n\nnote n3\n\nbody of n3"


def test_hot_hosts_are_joined_in_parts(spark):
    rows = [(i, f"http://h{int(i % 5 == 0)}/", PAGE.format(f"n{i} " + "y" * (i + 3))) for i in range(60)] + [(99, None, "<p>x")]
    pages = pages_of(spark, rows)
    want = sorted((r.page_id, r.text) for r in html_extract.main_text(pages).collect())
    got = html_extract.main_text(pages, html_extract.WrapperConfig(broadcast_bytes=0, hot_pages=10, hot_parts=4))
    assert sorted((r.page_id, r.text) for r in got.collect()) == want and len(want) == 61


def test_pipeline(spark, corpus, edge):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.createDataFrame(corpus, edge.schema)
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    model = langid.fit(docs)
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(r[0] for r in corpus if not (lambda x: x[0] == "und" or x[1] < model.threshold)(model.score(r[1])))
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    classes = {r.class_id for r in jaccard_join.op2(kept).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(classes)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, one, SF)
    bad = {r.doc_id for r in decontam.op9(one, bench).filter("contaminated").collect()}
    assert bad and {r.doc_id for r in clean.collect()} == classes - bad
    safe = corpus_pipeline.sanitisation(spark, clean, SF)
    assert safe.columns == docs.columns and safe.count() == len(classes - bad)
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == classes - bad


def test_pipeline_stages_on_edge_rows(spark, edge, empty, clash):
    extra = [c for c in clash(edge).columns if c not in edge.columns]
    by_name = dict(corpus_pipeline.STAGES)
    for docs in (edge, clash(edge), empty, clash(empty)):
        rows = 0 if docs.isEmpty() else len(EDGE)
        left = {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns
            left[name] = got.collect()
            assert all(r[c] == "clash" for r in left[name] for c in extra if c in docs.columns)
        assert {r.doc_id for r in left["language_id"]} & {1, 2, 3} == set()
        assert len(left["ngram_jaccard_join"]) == max(0, rows - 1) and len(left["benchmark_decontamination"]) == len(left["pii"]) == rows
        assert all(r.text is None and r.n_chars == 0 for r in left["pii"] if r.doc_id == 1)
        packed = by_name["bestfit_packing"](spark, docs, SF).collect()
        assert sum(r.piece == 0 for r in packed) == rows
    unlabelled = edge.withColumn("lang", edge["lang"].substr(1, 0)).withColumn("lang", edge["source"].substr(9, 0)).na.replace("", None, ["lang"])
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == len(EDGE)


def test_pipeline_sends_texts_in_small_batches(spark, edge):
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", 30_000

    def batches(rows):
        for b in rows:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    docs = spark.range(400, numPartitions=1).selectExpr("id doc_id", f"repeat('w', {size}) text", "'en' lang", "'a' source", "1L n_chars")
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        sent = corpus_pipeline.decontamination(spark, docs, SF).mapInArrow(batches, "rows long, bytes long").collect()
        assert sum(r.rows for r in sent) == 400 and max(r.bytes for r in sent) <= 3 << 20
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, edge, SF)
            assert spark.conf.get(key, None) == str(session.BATCH_BYTES), name
        spark.conf.set(key, "5m")
        corpus_pipeline.decontamination(spark, edge, SF)
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

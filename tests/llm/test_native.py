"""Operators 4 and 8 against plain Python over every row of the small table and the edge rows."""

import hashlib
import re
from collections import defaultdict

from lexweave.llm import line_quality, pii
from tests.llm.conftest import EDGE


def spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def ordered(rows):
    return sorted(rows, key=repr)


def check_pii(rows, got):
    want = []
    for r in rows:
        s = spans(r[1] or "")
        base = ",".join(f"{k}:{a}:{z}" for a, _, k, z in s)
        want.append((r[0], *[sum(x[2] == k for x in s) for k in ("email", "ip", "card", "phone")], hashlib.sha256(base.encode()).hexdigest()))
    assert ordered(want) == ordered([tuple(r)[:6] for r in got])


def test_pii_base(spark, corpus, edge, empty, clash):
    docs = spark.createDataFrame(corpus, edge.schema)
    check_pii(corpus, pii.op4(docs).collect())
    check_pii(EDGE, pii.op4(clash(edge)).collect())
    assert pii.op4(empty).collect() == []


def test_pii_many_matches(spark, edge):
    text = " ".join(f"u{i}@h{i % 7}.org 10.0.{i % 300}.1" for i in range(1200))
    rows = [(1, text, "en", "s", 0)]
    check_pii(rows, pii.op4(spark.createDataFrame(rows, edge.schema)).collect())


def test_pii_with_very_many_matches(spark, edge):
    make = lambda n: " ".join(f"u{i}@h{i % 7}.org" + ("" if i % 50 else f" 10.0.{i % 300}.1 x") for i in range(n))
    text = make(100_000)
    got = pii.base_spans(spark.createDataFrame([(text,)], "text string")).select("_email.start", "_ip.end").first()
    want = spans(text)
    assert got[0] == [x[0] for x in want if x[2] == "email"] and got[1] == [x[3] for x in want if x[2] == "ip"]
    text = make(5_000)
    at, out = 0, []
    for a, _, kind, z in spans(text):
        out += [text[at:a], f"<{kind.upper()}>"]
        at = z
    assert pii.sanitise(spark.createDataFrame([(1, text, "en", "s", 0)], edge.schema)).first().text == "".join(out) + text[at:]


def revealing_corpus():
    lines = [f"write to anna@corp.example about projectzephyr number {i}x" for i in range(6)]
    lines += [f"plain words about other things {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    return [(i, x, "en", "s", 0) for i, x in enumerate(lines)] + [(900, "Projectzephyr is nowhere else", "en", "s", 0)]


def test_pii_terms_that_reveal(spark, edge):
    docs = spark.createDataFrame(revealing_corpus(), edge.schema)
    got = {r.doc_id: r.spans for r in pii.op4(docs).collect()}
    assert got[900] == "term:0:13" and got[0] == "term:0:5,email:9:26,term:33:46,term:47:53"
    assert got[50] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[900] == "<TERM> is nowhere else" and clean[0].startswith("<TERM> to <EMAIL> about <TERM>")
    assert clean[50] == "plain words about other things " + clean[50][-2:]


def test_pii_rare_entities_reveal(spark, edge):
    fill = [f"plain words about other things {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [f"ask Zed at anna@corp.example on {x}" for x in ("monday", "friday")]  # a value in two lines, a name of three letters
    texts += [f"Quillfeather signs\nwrite p{i}@guild.example for {x}" for i, x in enumerate(("bread", "salt", "wine"))]  # each value once, a name on the line before
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(texts + fill)] + [(900, "Zed met Quillfeather", "en", "s", 0)]
    got = {r.doc_id: r.spans for r in pii.op4(spark.createDataFrame(rows, edge.schema)).collect()}
    assert got[900] == "term:0:3,term:8:20" and got[100] == ""


def test_pii_copies_reveal_nothing(spark, edge):
    rows = [(i, "write to anna@corp.example about projectzephyr", "en", "s", 0) for i in range(50)]
    rows += [(100 + i, f"other {i}", "en", "s", 0) for i in range(50)]
    assert all("term" not in r.spans for r in pii.op4(spark.createDataFrame(rows, edge.schema)).collect())


def test_sanitise_keeps_rows_and_columns(spark, edge, empty):
    got = pii.sanitise(edge)
    assert got.columns == edge.columns and got.count() == len(EDGE)
    rows = {r.doc_id: r.text for r in got.collect()}
    assert rows[1] is None and rows[2] == ""
    assert rows[8] == "mail <EMAIL><EMAIL>, ip <IP>.<IP> and 300.1.1.1 card <CARD>, <PHONE> ."
    assert pii.sanitise(empty).collect() == []


def want_quality(rows, limits):
    hosts, lines = defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))).strip(" ")
    full = lambda t: [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for r in rows:
        doc = r[0] if limits.by == "documents" else r[1] or ""
        hosts[r[3] or ""].add(doc)
        for x in full(r[1] or ""):
            lines[r[3] or "", norm(x)].add(doc)
    out = []
    for r in rows:
        text, host = r[1] or "", r[3] or ""
        n, chars, symbols, dup, rep = quality(text)
        top = max(limits.min_docs, limits.share * len(hosts[host]))
        gone = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in full(text) if len(lines[host, norm(x)]) > top)
        failed = n < 10 or 100 * rep > 20 * n
        out.append((r[0], n, chars, symbols, dup, rep, failed, not failed and n - gone >= limits.min_words and n - gone >= limits.min_left * n, gone))
    return ordered(out)


def test_quality(spark, corpus, edge, empty, clash):
    limits = line_quality.LineLimits(min_docs=2, share=0.05)
    docs = spark.createDataFrame(corpus, edge.schema)
    assert want_quality(corpus, limits) == ordered([tuple(r) for r in line_quality.judge(docs, limits).collect()])
    by_text = line_quality.LineLimits(min_docs=2, share=0.01, by="texts")
    assert want_quality(corpus, by_text) == ordered([tuple(r) for r in line_quality.judge(docs, by_text).collect()])
    assert want_quality(corpus, line_quality.LineLimits()) == ordered([tuple(r) for r in line_quality.op8(docs).collect()])
    assert want_quality(EDGE, line_quality.LineLimits()) == ordered([tuple(r) for r in line_quality.op8(clash(edge)).collect()])
    assert line_quality.op8(empty).collect() == []


def test_depleted_documents_are_rejected(spark, edge):
    menu = "Home Page of the shop with many good offers today"
    rows = [(i, f"{menu}\nunique {chr(97 + i % 26)}{chr(97 + i // 26)} words", "en", "h", 0) for i in range(40)] + [(99, f"{menu}\n" + " ".join(f"w{i}" for i in range(30)), "en", "h", 0)]
    docs = spark.createDataFrame(rows, edge.schema)
    got = {r.doc_id: r for r in line_quality.op8(docs).collect()}
    assert not got[0].kept and not got[0].base_failed and got[99].kept and got[99].removed_words == 10
    clean = {r.doc_id: r.clean_text for r in line_quality.without_boilerplate(docs).collect()}
    assert clean[3] == "unique da words"


def test_copies_are_documents_unless_told_apart_by_text(spark, edge):
    line = "Home Page of the shop with many good offers today"
    rows = [(i, f"{line}\nunique {chr(97 + i % 26)}{chr(97 + i // 26)} words", "en", "h", 0) for i in range(40)] + [(100 + i, "one text that is copied very often by other people here today", "en", "h", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, edge.schema)
    got = {r.doc_id: r for r in line_quality.judge(docs, line_quality.LineLimits(by="texts")).collect()}
    assert got[0].removed_words == 10 and not got[0].kept and got[100].removed_words == 0 and got[100].kept
    got = {r.doc_id: r for r in line_quality.op8(docs).collect()}
    assert got[0].removed_words == 0 and got[100].removed_words == 12 and not got[100].kept

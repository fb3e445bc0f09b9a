"""Main text of pages by wrapper induction.

Pages of one host share a template. The host's reference page (least hash of its HTML) seeds the
wrapper; every page's DOM tree is aligned with it by simple tree matching (sibling runs of the same
tag and class count as one repeated node), which names each of its nodes by a node of the
reference, or as new below one. Over all pages of the host, counts per node and text then tell
template from content: a text that at least `constant_share` of at least `constant_pages` different pages have
at the same node is template, and the deepest container of the reference that holds at least `cover` of the
host's varying text is the content slot. A page's text is what its slot holds, without the template.

Menus, footers, side bars, forms, hidden parts, adverts and reader comments vary as well, so tags, roles and
a few class names take them out (those of menus, footers and side bars outside an article element). Other telling names (notice, share, related, ...) take a container out only
where most of its text is links, or where the host has fewer than `constant_pages` pages and so no wrapper; headings,
paragraphs and other prose are never dropped for a name. A page of which the slot holds nothing, or of such a host,
uses its own deepest container that holds `cover` of its text.

Nothing recurses and names are numbers, so deep nesting costs no more than wide pages. Two sibling lists of
more than `_EXACT` pairs of runs are aligned by their longest common blocks first. Counts per host and node are
combined before they are shuffled, and pages of a host are never brought together; the pages of a host with
more than `hot_pages` are joined with its wrapper in parts. Defined results: null, empty or text-free html gives
an empty text; broken markup is closed as browsers do for paragraphs, list items and table cells; a null url is
the host ''. Of two texts as frequent at a node both may be template. Repeated rows are each extracted.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize, ship_package

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea|noscript|iframe|svg|template|title|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("nav footer aside form button select menu dialog head object audio video canvas".split())
_CONTAINER = frozenset("article main section div td body html".split())
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote article main body".split())
#: Names of what varies from page to page as content does, and is none.
_NEVER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments respond replies disqus".split())
#: Names of what stands around an article; inside one they are as those below.
_FRAME = frozenset("menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar".split())
#: Names of what may be article or not: they need links as well, or a host without a wrapper.
_MAYBE = frozenset(
    "banner promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar skip".split()
)
_OUTSIDE, _SOFT = _NEVER | _FRAME, _MAYBE | _FRAME
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_FENCE = {"p": _BLOCK, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_TELLS = frozenset().union(*_CLOSES.values(), *_FENCE.values())
_INLINE_WALL = frozenset("table article main body".split())
_WALLED = frozenset("p li b i a span".split())
#: Pairs of runs up to which two sibling lists are matched exactly.
_EXACT = 40_000


@dataclass(frozen=True)
class WrapperConfig:
    constant_share: float = 0.8
    constant_pages: int = 5
    cover: float = 0.9
    broadcast_bytes: int = 64 << 20
    hot_pages: int = 20_000
    hot_parts: int = 32


class Tree:
    """Nodes by number, in page order; 0 is the root. kids hold numbers of nodes, and texts."""

    __slots__ = ("drop", "kids", "name", "own", "parent", "runs_", "sign", "soft", "tag")

    def __init__(self) -> None:
        self.tag, self.sign, self.parent = ["html"], ["html"], [0]
        self.drop, self.soft = [False], [False]
        self.kids: list[list[int | str]] = [[]]
        self.name: list[int] = []
        self.own: list[bool] = []  # named by a node of the reference
        self.runs_: dict[int, list[tuple[str, list[int]]]] = {}

    def runs(self, node: int) -> list[tuple[str, list[int]]]:
        """Element children; those in a row with the same signature stand together."""
        got = self.runs_.get(node)
        if got is None:
            got = self.runs_[node] = []
            for k in self.kids[node]:
                if k.__class__ is int:
                    if got and got[-1][0] == self.sign[k]:
                        got[-1][1].append(k)
                    else:
                        got.append((self.sign[k], [k]))
        return got


def parse(source: str | None) -> Tree:
    t = Tree()
    stack, inside = [0], [False]
    near: list[dict[str, int]] = [{}]  # for each kind of end tag that may be left out, the open element it ends, by place in the stack
    count: Counter[str] = Counter()
    walled: list[Counter[str]] = [Counter()]  # open elements since the last wall

    def cut(place: int) -> None:
        while len(stack) > place:
            tag = t.tag[stack.pop()]
            inside.pop()
            near.pop()
            count[tag] -= 1
            if tag in _INLINE_WALL:
                walled.pop()
            walled[-1][tag] -= 1

    for m in _TOKEN.finditer(source or ""):
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            t.kids[stack[-1]].append(raw)
            continue
        tag = (m[3] or "").lower()
        if not tag or tag == "html":
            continue
        if m[2]:
            if (walled[-1] if tag in _WALLED else count)[tag] > 0:
                place = len(stack) - 1
                while t.tag[stack[place]] != tag:
                    place -= 1
                cut(place)
            continue
        if tag in _BLOCK and near[-1].get("p", -1) >= 0:
            cut(near[-1]["p"])
        if tag in _CLOSES and near[-1].get(tag, -1) >= 0:
            cut(near[-1][tag])
        found = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTR.findall(m[4])} if m[4] else {}
        words = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}")) if found else set()
        within = inside[-1] or tag in ("article", "main")
        drop = tag in _DROP or found.get("role") in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" or (tag == "header" and not within) or (tag not in _PROSE and not words.isdisjoint(_NEVER if within else _OUTSIDE))
        number = len(t.tag)
        t.tag.append(tag)
        t.sign.append(tag + ("." + re.sub(r"[0-9]+", "0", found.get("class") or found.get("id") or "") if found else ""))
        t.parent.append(stack[-1])
        t.drop.append(drop and tag != "body")
        t.soft.append(tag not in _PROSE and not words.isdisjoint(_SOFT))
        t.kids.append([])
        t.kids[stack[-1]].append(number)
        if tag not in _VOID and not m[4].rstrip().endswith("/"):
            open_ = near[-1]
            if tag in _TELLS:
                open_ = dict(open_)
                for kind, ends in _CLOSES.items():
                    if tag in ends and (open_.get(kind, -1) < 0 or tag == "p"):
                        open_[kind] = len(stack)
                    elif tag in _FENCE[kind]:
                        open_[kind] = -1
            walled[-1][tag] += 1
            if tag in _INLINE_WALL:
                walled.append(Counter())
            stack.append(number)
            inside.append(within)
            near.append(open_)
            count[tag] += 1
    return t


class Matching:
    """Simple tree matching of a page and a reference: size of the largest order-preserving mapping
    of the runs of children of two nodes, and the pairs of runs in it, each pair of nodes once."""

    def __init__(self, page: Tree, reference: Tree):
        self.page, self.reference = page, reference
        self.done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def of(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Score, and pairs of places among the runs of a and b."""
        if (a, b) not in self.done:
            todo, seen = [(a, b)], {(a, b)}
            for u, v in todo:  # grows: every pair of runs that may be compared, parents first
                if (y := self.reference.runs(v)) and (x := self.page.runs(u)):
                    for i, j in self._fixed(x, y) or [(i, j) for i in range(len(x)) for j in range(len(y)) if x[i][0] == y[j][0]]:
                        pair = (x[i][1][0], y[j][1][0])
                        if pair not in seen and pair not in self.done:
                            seen.add(pair)
                            todo.append(pair)
            for u, v in reversed(todo):
                self.done[u, v] = self._match(u, v)
        return self.done[a, b]

    @staticmethod
    def _fixed(x: list, y: list) -> list[tuple[int, int]]:
        """Pairs that are settled without comparing children: equal lists, and blocks of very long ones."""
        s, z = [k for k, _ in x], [k for k, _ in y]
        if s == z:
            return [(i, i) for i in range(len(s))]
        if len(x) * len(y) <= _EXACT:
            return []
        found = difflib.SequenceMatcher(None, s, z, autojunk=False).get_matching_blocks()
        return [(i + k, j + k) for i, j, n in found for k in range(n)]

    def _match(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        x, y = self.page.runs(a), self.reference.runs(b)
        if not x or not y:
            return 0, []
        weight = lambda i, j: 1 + self.done[x[i][1][0], y[j][1][0]][0]
        if pairs := self._fixed(x, y):
            return sum(weight(i, j) for i, j in pairs), pairs
        if len(x) * len(y) > _EXACT:
            return 0, []
        score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            row, above, s = score[i], score[i - 1], x[i - 1][0]
            for j in range(1, len(y) + 1):
                best = above[j] if above[j] >= row[j - 1] else row[j - 1]
                if s == y[j - 1][0]:
                    best = max(best, above[j - 1] + weight(i - 1, j - 1))
                row[j] = best
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if x[i - 1][0] == y[j - 1][0] and score[i][j] == score[i - 1][j - 1] + weight(i - 1, j - 1):
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif score[i][j] == score[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return score[-1][-1], pairs[::-1]


def _number(*of: object) -> int:
    return xxhash.xxh64_intdigest(repr(of)) >> 1


def name_reference(t: Tree) -> Tree:
    """Nodes of a run share a name."""
    t.name, t.own = [0] * len(t.tag), [True] * len(t.tag)
    for node in range(len(t.tag)):
        for k, (sign, run) in enumerate(t.runs(node)):
            name = _number(t.name[node], k, sign)
            for x in run:
                t.name[x] = name
    return t


def align(page: Tree, reference: Tree) -> Tree:
    """Names the page's nodes after the reference's."""
    matching = Matching(page, reference)
    page.name, page.own = [0] * len(page.tag), [True] * len(page.tag)
    partner = [0] * len(page.tag)
    for node in range(len(page.tag)):  # parents first
        runs, named = page.runs(node), {}
        if runs and page.own[node]:
            other = reference.runs(partner[node])
            named = dict(matching.of(node, partner[node])[1])
        for i, (sign, run) in enumerate(runs):
            j = named.get(i)
            name = _number(page.name[node], "+", sign) if j is None else reference.name[other[j][1][0]]
            for x in run:
                page.name[x], page.own[x] = name, j is not None
                partner[x] = 0 if j is None else other[j][1][0]
    return page


def _dropped(t: Tree, strict: bool) -> list[bool]:
    """Whether each node goes. strict: names that may be article count without links."""
    if not any(t.soft):
        return t.drop
    link, total, linked = [False] * len(t.tag), [0] * len(t.tag), [0] * len(t.tag)
    for node in range(len(t.tag)):  # parents first
        link[node] = t.tag[node] == "a" or link[t.parent[node]]
        total[node] = sum(len(k.strip()) for k in t.kids[node] if k.__class__ is not int)
        linked[node] = total[node] * link[node]
    for node in range(len(t.tag) - 1, 0, -1):
        total[t.parent[node]] += total[node]
        linked[t.parent[node]] += linked[node]
    return [d or (s and (strict or 2 * k > n)) for d, s, k, n in zip(t.drop, t.soft, linked, total, strict=True)]


def blocks(t: Tree, gone: frozenset[int] | set[int] = frozenset(), strict: bool = False) -> list[tuple[int, int, str]]:
    """(name of the block's node, its nearest container, text) in page order, without what `gone` holds."""
    out: list[tuple[int, int, str]] = []
    texts: list[str] = []
    dropped = _dropped(t, strict)

    def flush(node: int, hold: int) -> None:
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text and not (gone and _pair(t.name[node], text) in gone):
                out.append((t.name[node], hold, text))
            texts.clear()

    at = [(0, 0)]  # open blocks and their containers
    stack: list[tuple[int, Iterator[int | str], bool]] = [(0, iter(t.kids[0]), False)]
    while stack:
        node, kids, block = stack[-1]
        for k in kids:
            if k.__class__ is not int:
                texts.append(k)
                continue
            tag = t.tag[k]
            if dropped[k]:
                if tag in _BLOCK:
                    flush(*at[-1])
            elif tag == "br":
                texts.append(" ")
            else:
                if tag in _BLOCK:
                    flush(*at[-1])
                    at.append((k, k if tag in _CONTAINER else at[-1][1]))
                stack.append((k, iter(t.kids[k]), tag in _BLOCK))
                break
        else:
            stack.pop()
            if block:
                flush(*at.pop())
    flush(0, 0)
    return out


def _pair(name: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=name) >> 1


def _known(t: Tree, node: int) -> int:
    """The nearest container, the node included, that the reference has too; its number there is its name."""
    while not t.own[node] or t.tag[node] not in _CONTAINER:
        node = t.parent[node]
    return node


def slot_of(reference: Tree, mass: dict[int, int], cover: float) -> int | None:
    """Name of the deepest container of the reference with `cover` of the varying text."""
    total = sum(mass.values())
    held: dict[int, int] = defaultdict(int)
    first: dict[int, int] = {}
    for node in range(len(reference.tag)):
        first.setdefault(reference.name[node], node)
    for name, n in mass.items():
        if name in first:
            held[first[name]] += n
    best = None
    for node in range(len(reference.tag) - 1, 0, -1):  # children first; all of a run's text is at its first node
        if held[node] and reference.tag[node] in _CONTAINER and held[node] >= cover * total and best is None:
            best = node
        up = first[reference.name[reference.parent[node]]]
        if first[reference.name[node]] == node:
            held[up] += held[node]
    return None if best is None or not total else reference.name[best]


def extract(page: Tree, slot: int | None, gone: set[int], strict: bool, cover: float = WrapperConfig.cover) -> str:
    """Text of the slot's blocks; of the deepest container with `cover` of the text where there is no slot."""
    found = blocks(page, gone, strict)
    if not found:
        return ""
    inside = [False] * len(page.tag)
    if slot is not None:
        for node in range(len(page.tag)):  # parents first
            inside[node] = page.own[node] and page.name[node] == slot or (node > 0 and inside[page.parent[node]])
    if not any(inside[hold] for _, hold, _ in found):
        mass = [0] * len(page.tag)
        for _, hold, text in found:
            mass[hold] += len(text)
        least, best = cover * sum(mass), 0
        for node in range(len(page.tag) - 1, 0, -1):
            if mass[node] >= least:
                best = node
                break
            mass[page.parent[node]] += mass[node]
        inside = [False] * len(page.tag)
        inside[best] = True
        for node in range(best + 1, len(page.tag)):
            inside[node] = inside[page.parent[node]]
    return "\n\n".join(text for _, hold, text in found if inside[hold])


def hosts(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select("page_id", "url", "html", host.alias("host"))


class _Seeds(dict):
    """Parsed references by host, a bounded number at a time."""

    def __init__(self, make):
        self.make = make

    def get_for(self, host: str, *of: object):
        if host not in self:
            if len(self) > 500:
                self.clear()
            self[host] = self.make(*of)
        return self[host]


def wrappers(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """host, reference, different pages, masses (hold, mass) and gone: one row for each host of pages(page_id, url, html, host)."""
    ship_package(pages.sparkSession)
    reference = pages.filter("html IS NOT NULL").groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("reference"), F.count("*").alias("rows"))
    reference = materialize(reference, "references")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _Seeds(lambda ref: name_reference(parse(ref)))
        for b in batches:
            out = []
            for host, page, ref in zip(b["host"], b["html"], b["reference"], strict=True):
                if page is None or ref is None:
                    continue
                t = align(parse(page), seeds.get_for(host, ref))
                key = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                out += [(host, name, t.name[_known(t, hold)], _pair(name, text), len(text), key) for name, hold, text in blocks(t)]
            yield pd.DataFrame(out, columns=["host", "node", "hold", "pair", "chars", "page"])

    joined = _with_host(pages.select("host", "html"), reference, F.octet_length("reference"), config)
    seen = joined.mapInPandas(run, "host string, node long, hold long, pair long, chars long, page long")
    # copies of a page say nothing about the template: one page, node and text counts once
    texts = materialize(seen.groupBy("host", "node", "hold", "pair", "page").agg(F.min("chars").alias("chars")).groupBy("host", "node", "hold", "pair").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars")), "node-texts")
    nodes = texts.groupBy("host", "node").agg(F.sum("pages").alias("all"))
    often = texts.groupBy("host", "node", "pair").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= config.constant_pages)
    gone = often.join(nodes, ["host", "node"]).filter(F.col("pages") >= config.constant_share * F.col("all")).groupBy("host").agg(F.collect_set("pair").alias("gone"))  # texts of one template
    varying = texts.filter(F.col("pages") < config.constant_pages).groupBy("host", "hold").agg(F.sum("chars").alias("mass"))
    masses = varying.groupBy("host").agg(F.collect_list(F.struct("hold", "mass")).alias("masses"))  # nodes of one page at most
    return materialize(reference.join(masses, "host", "left").join(gone, "host", "left"), "wrappers")


def _with_host(pages: DataFrame, side: DataFrame, size, config: WrapperConfig) -> DataFrame:
    """pages with the row of their host: by broadcast up to a size, else by host, hot hosts in parts."""
    held = side.agg(F.sum(size).alias("s"), F.max("rows").alias("r")).first()
    if (held.s or 0) <= config.broadcast_bytes:
        return pages.join(F.broadcast(side), "host", "left")
    hot = side.filter(F.col("rows") > config.hot_pages).select("host", F.lit(config.hot_parts).alias("_parts"))  # few: each has hot_pages rows
    part = F.coalesce(F.pmod(F.xxhash64("html"), F.col("_parts")), F.lit(0))
    dealt = pages.join(F.broadcast(hot), "host", "left").withColumn("_part", part).drop("_parts")
    spread = side.join(F.broadcast(hot), "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0)).cast("long")))).drop("_parts")
    return dealt.join(spread, ["host", "_part"], "left").drop("_part")


def main_text(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """page_id, url, text for each row of pages."""
    keyed = hosts(pages)
    size = F.octet_length("reference") + 16 * F.coalesce(F.size("masses"), F.lit(0)) + 8 * F.coalesce(F.size("gone"), F.lit(0))
    joined = _with_host(keyed, wrappers(keyed, config), size, config)

    def seed(ref, masses, gone):
        t = name_reference(parse(ref))
        held = {} if masses is None else {int(x["hold"]): int(x["mass"]) for x in masses}
        return t, slot_of(t, held, config.cover), set() if gone is None else {int(x) for x in gone}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _Seeds(seed)
        for b in batches:
            texts = []
            for host, page, ref, rows, masses, gone in zip(b["host"], b["html"], b["reference"], b["rows"], b["masses"], b["gone"], strict=True):
                if page is None or ref is None:
                    texts.append("")
                    continue
                reference, slot, drop = seeds.get_for(host, ref, masses, gone)
                alone = rows < config.constant_pages  # no wrapper
                texts.append(extract(align(parse(page), reference), None if alone else slot, drop, alone, config.cover))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.select("page_id", "url", "host", "html", "reference", "rows", "masses", "gone").mapInPandas(run, f"page_id {kind['page_id']}, url string, text string")


def op6(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

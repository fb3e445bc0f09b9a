"""Guide corpus: pages and posts cleaned to articles, articles to sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import corpus

LEAST = 200
# Tags and class names that hold no article, and where one is looked for, in this order.
NO_ARTICLE = ("script", "style", "nav", "footer", "header", "aside")
NOISE = re.compile(r"comment|reply|sidebar|ad-|advertisement|recommend|related|nav|footer|header|menu", re.I)
PLACES = ("<article>", "<main>", "content", "article", "post")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Page(HTMLParser):
    """Text pieces of a page, each with the open containers that could be its article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.hidden = 0
        self.holds: list[tuple[int, int]] = []  # (place, number) of open containers
        self.depth: list[int] = []
        self.seen: dict[int, int] = {}
        self.pieces: list[tuple[str, tuple[int, ...], bool]] = []
        self.heads: dict[str, list[str]] = {"title": [], "h1": []}
        self.body = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        names = dict(attrs).get("class") or ""
        gone = tag in NO_ARTICLE or any(NOISE.search(x) for x in names.split())
        self.hidden += gone
        found = [p for p, x in enumerate(PLACES) if (x == f"<{tag}>" if x[0] == "<" else x in names)]
        fresh = [p for p in found if p not in self.seen and not self.hidden]
        for p in fresh:  # the first element that fits a place is the one looked at
            self.seen[p] = len(self.depth)
            self.holds.append((p, len(self.open)))
        self.body += tag == "body"
        self.open.append((tag, gone))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, gone = self.open.pop()
            self.hidden -= gone
            self.holds = [(p, n) for p, n in self.holds if n < len(self.open)]
            self.body -= t == "body"
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden or not data.strip():
            return
        for t in self.heads:
            if any(x == t for x, _ in self.open):
                self.heads[t].append(data.strip())
        self.pieces.append((data.strip(), tuple(p for p, _ in self.holds), self.body > 0))


def _blank(text: str) -> str:
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def article(html: str | None, stem: str) -> tuple[str, str]:
    """Title and text: of the first of PLACES with LEAST characters, else of the body, else of all."""
    page = _Page()
    page.feed(html or "")
    page.close()
    title = next((unescape("".join(page.heads[t])) for t in ("title", "h1") if page.heads[t]), stem)
    for p in range(len(PLACES)):
        text = "\n".join(x for x, holds, _ in page.pieces if p in holds)
        if len(text) >= LEAST:
            return title, _blank(text)
    inside = [x for x, _, b in page.pieces if b]
    return title, _blank("\n".join(inside or [x for x, _, _ in page.pieces]))


def html_articles(files: DataFrame) -> DataFrame:
    """path, title, text of files(path, value), pages of HTML. Null pages are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [article(v, re.sub(r"\.[^.]*$", "", (p or "").rsplit("/", 1)[-1])) for p, v in zip(b["path"], b["value"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "title": [t for t, _ in got], "text": [x for _, x in got]})

    return files.select("path", "value").mapInPandas(run, "path string, title string, text string")


def delta_text(delta: Column) -> Column:
    """Text of a list of inserts, JSON: strings as they are, embedded objects as a line break; null if it is no list."""
    rows = F.from_json(delta, "array<struct<insert:string>>")
    return F.array_join(F.transform(rows, lambda x: F.when(x["insert"].isNull(), "").when(F.startswith(x["insert"], F.lit("{")) & F.try_parse_json(x["insert"]).isNotNull(), "\n").otherwise(x["insert"])), "")


def post_articles(files: DataFrame) -> DataFrame:
    """path, title, text of files(path, value), posts as nested JSON: the inserts of the post, or the HTML of its content if
    they are short. What is no post is left out."""
    post = F.from_json("value", "struct<data:struct<post:struct<post:struct<subject:string,structured_content:string,content:string,post_id:string>>>>")["data"]["post"]["post"]
    d = files.select("path", post.alias("p")).filter("p IS NOT NULL")
    text = F.coalesce(delta_text(F.col("p.structured_content")), F.lit(""))
    d = d.withColumn("t", text).withColumn("t", F.when((F.length("t") < LEAST) & (F.coalesce("p.content", F.lit("")) != ""), T.html_to_text(F.col("p.content"))).otherwise(F.col("t")))
    blank = F.trim(F.regexp_replace(F.regexp_replace("t", "\n{3,}", "\n\n"), "[ \t]+", " "))
    return d.select("path", F.substring(F.trim(F.coalesce("p.subject", F.lit(""))), 1, 120).alias("title"), blank.alias("text"))


def build(pages: DataFrame, posts: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Articles (source, path, title, text, content_hash) of LEAST characters, the first path of each text; and
    their sentences (source, path, title, sentence, content_hash)."""
    every = html_articles(pages).unionByName(post_articles(posts))
    first = corpus.exact_dedup(every.select("path", "text"), LEAST).select("path", "content_hash")
    kept = every.join(first, "path").withColumn("source", F.lit(source)).select("source", "path", "title", "text", "content_hash").filter(T.short_hash(F.col("text")) == F.col("content_hash"))
    cut = kept.select("source", "path", "title", F.explode(T.sentences(F.col("text"))).alias("sentence"), "content_hash")
    return kept, cut


def write(articles: DataFrame, sentences: DataFrame, folder: str) -> None:
    articles.write.mode("overwrite").json(f"{folder}/cleaned_articles")
    sentences.write.mode("overwrite").json(f"{folder}/sentences")

"""Web pages: text, links, elements, bounded crawls over a link table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "template", "head"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _SKIP
        if tag in _BLOCK:
            self.out.append("\n")
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("#" * int(tag[1:]) + " ")
        if tag == "li":
            self.out.append("- ")

    def handle_endtag(self, tag):
        self.skip -= tag in _SKIP and self.skip > 0
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def to_text(html: str) -> str:
    p = _Text()
    p.feed(html or "")
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


class _Elements(HTMLParser):
    def __init__(self, selectors: list[str]):
        super().__init__(convert_charrefs=True)
        self.wanted = [(s, [self._simple(x) for x in s.split()]) for s in selectors]
        self.stack: list[tuple] = []
        self.found: list[tuple[str, int, list[str]]] = []

    @staticmethod
    def _simple(x: str) -> tuple[str, str, str]:
        name, _, rest = x.partition("#")
        if rest:
            return name, rest, ""
        name, _, cls = x.partition(".")
        return name, "", cls

    @staticmethod
    def _fits(one: tuple, tag: str, attrs: dict) -> bool:
        name, id_, cls = one
        return (not name or name == tag) and (not id_ or attrs.get("id") == id_) and (not cls or cls in (attrs.get("class") or "").split())

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        a = dict(attrs)
        hits = []
        for s, chain in self.wanted:
            if not self._fits(chain[-1], tag, a):
                continue
            at = 0
            for t, b, _ in self.stack:
                at += at < len(chain) - 1 and self._fits(chain[at], t, b)
            if at == len(chain) - 1:
                hits.append((s, len(self.found), []))
                self.found.append(hits[-1])
        self.stack.append((tag, a, hits))

    def handle_endtag(self, tag):
        while self.stack:
            if self.stack.pop()[0] == tag:
                return

    def handle_data(self, data):
        for _, _, hits in self.stack:
            for _, _, text in hits:
                text.append(data)


def select(html: str, selectors: list[str]) -> list[tuple[str, int, str]]:
    """(selector, position, text) of elements that fit tag, .class, #id and descendant selectors; empty ones are left out."""
    p = _Elements(selectors)
    p.feed(html or "")
    seen: dict[str, int] = {}
    out = []
    for s, _, parts in p.found:
        if text := " ".join("".join(parts).split()):
            out.append((s, seen.setdefault(s, 0), text))
            seen[s] += 1
    return out


def texts(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"page_id": p["page_id"], "url": p["url"], "text": [to_text(h) for h in p["html"]]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")


def elements(pages: DataFrame, selectors: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(i, *e) for i, h in zip(p["page_id"], p["html"], strict=True) for e in select(h, selectors)]
            yield pd.DataFrame(rows, columns=["page_id", "selector", "position", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, selector string, position int, text string")


def extract(pages: DataFrame, completer, ddl: str, prompt: str = "Extract the fields from this page as JSON.", max_chars: int = 8000) -> DataFrame:
    """page_id, url and a struct of what a model finds in each page's text; NULL where its reply does not parse."""
    from graphloom.functions.text import json_part

    def run(batches):
        import pandas as pd

        for p in batches:
            yield pd.DataFrame({"page_id": p["page_id"], "reply": [completer(f"{prompt}\n\n{t[:max_chars]}") for t in p["text"]]})

    replies = texts(pages).select("page_id", "text").mapInPandas(run, "page_id long, reply string")
    return pages.select("page_id", "url").join(replies.select("page_id", F.from_json(json_part(F.col("reply")), ddl).alias("found")), "page_id")


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, position, href of every link, in order of appearance."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return pages.select("page_id", "url", F.posexplode(found).alias("position", "href"))


def crawl(link_table: DataFrame, start: str, max_pages: int = 10, depth: int = 2) -> DataFrame:
    """url and depth of at most `max_pages` pages reached over (source, target) links, nearest first, then by url."""
    seen = link_table.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    last = seen
    for d in range(1, depth + 1):
        last = link_table.join(last.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(last)
    return seen.orderBy("depth", "url").limit(max_pages)

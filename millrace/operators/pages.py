"""Pages of markup as relations: one row for each element."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements that end an open paragraph, and those a paragraph is looked for in.
BREAKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES |= {tag: {"p"} for tag in BREAKS}
SCOPE = {tag: frozenset("article aside blockquote body button dd div dl fieldset footer form header li main nav object ol section table td th ul".split()) for tag in BREAKS}
SCOPE |= {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
CHROME = frozenset({"nav", "header", "footer", "aside"})
# Elements that only hold others: their text is that of the elements inside, so it is kept only where they are named.
CONTAINERS = frozenset("html head body div section main article nav header footer aside form table thead tbody tfoot ul ol dl select".split())
# Words of classes and ids around lists of other products.
OTHER_PRODUCTS = re.compile("(?i)related|recommend|upsell|cross-sell|also-(?:viewed|bought|like)|similar|recently")

_NODES = "array<struct<ord:int,parent:int,last:int,depth:int,tag:string,element_id:string,classes:array<string>,attrs:map<string,string>,text:string,in_chrome:boolean,in_other:boolean,in_main:boolean>>"


class _Builder(HTMLParser):
    """A tree of elements; unclosed list items, paragraphs and cells close where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.texts: list[str] = []  # in the order of the page; an element's are those from its begin to its end

    def _close_to(self, k: int) -> None:
        for i in self.open[k:]:
            self.nodes[i]["last"] = len(self.nodes) - 1
            self.nodes[i]["end"] = len(self.texts)
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            stop = SCOPE.get(tag, set())
            for k in range(len(self.open) - 1, -1, -1):
                name = self.nodes[self.open[k]]["tag"]
                if name in stop:
                    break
                if name in CLOSES[tag]:
                    self._close_to(k)
                    break
        parent = self.open[-1] if self.open else None
        known = {k: v or "" for k, v in attrs}
        up = self.nodes[parent] if parent is not None else {}
        classes = known.get("class", "").split()
        self.nodes.append(
            {
                "ord": len(self.nodes), "parent": parent, "last": len(self.nodes), "depth": len(self.open), "tag": tag, "element_id": known.get("id"), "classes": classes, "attrs": known, "begin": len(self.texts), "end": len(self.texts),
                "in_chrome": tag in CHROME or up.get("in_chrome", False), "in_main": tag in ("main", "article") or up.get("in_main", False), "in_other": up.get("in_other", False) or bool(OTHER_PRODUCTS.search(" ".join([*classes, known.get("id", "")]))),
            }
        )
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
        if tag == "br":
            self.handle_data(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                self._close_to(k)
                break

    def handle_data(self, data: str) -> None:
        self.texts.append(data)

    def text(self, node: dict) -> str:
        """All text of an element in the order of the page, white space being one blank."""
        return " ".join("".join(self.texts[node["begin"] : node["end"]]).split())

    def below(self, node: dict, *tags: str) -> list[dict]:
        return [n for n in self.nodes[node["ord"] + 1 : node["last"] + 1] if n["tag"] in tags]


def parse_nodes(html: str) -> list[dict]:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._close_to(0)
    for node in builder.nodes:
        named = node["tag"] not in CONTAINERS or node["element_id"] or "itemprop" in node["attrs"] or "property" in node["attrs"]
        node["text"] = builder.text(node) if named else ""
    return [{k: v for k, v in node.items() if k not in ("begin", "end")} for node in builder.nodes]


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([parse_nodes(h) if isinstance(h, str) and h else [] for h in pages])


def page_nodes(pages: DataFrame, key: str, html: str, most_bytes: int = 3_000_000) -> DataFrame:
    """(key, ord, parent, last, depth, tag, element_id, classes, attrs, text, in_chrome, in_other, in_main) of every element of every page.

    text is all text of an element, '' for containers without an id or a property. Null and
    empty pages have no elements. Pages beyond most_bytes are the feature's own limit; they
    have none. Plan: one Arrow UDF, said to be nondeterministic so that no page is parsed twice
    in one reading; persist or cut the result where it is read several times.
    """
    rows = pages.where(F.col(html).isNotNull() & (F.octet_length(html) <= most_bytes))
    return rows.select(key, F.pandas_udf(_parse, _NODES).asNondeterministic()(html).alias("_n")).select(key, F.inline("_n"))


def subtree_texts(nodes: DataFrame, key: str, roots: Column) -> DataFrame:
    """(key, ord, text) of every element that ``roots`` selects and that has text."""
    return nodes.where(roots & (F.col("text") != "")).select(key, "ord", "text")


# Words in tab titles and the bucket they tell.
TAB_WORDS = {"overview": ["overview", "description", "details", "about"], "specs": ["spec", "technical", "dimension"], "features": ["feature", "benefit"], "downloads": ["download", "manual", "document", "resource"]}


def tab_bucket(title: Column) -> Column:
    """overview, specs, features or downloads by the first word found in a title; '' if none is."""
    out = F.lit("")
    for bucket, words in reversed(TAB_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w))
        out = F.when(hit, F.lit(bucket)).otherwise(out)
    return out


def joined_tabs(titles: DataFrame, panels: DataFrame, key: str) -> DataFrame:
    """Panels (key, panel_id, ord, text) with their titles (key, panel_id, title); an untitled panel is ``Tab n`` by its place."""
    return panels.join(titles.select(key, "panel_id", "title"), [key, "panel_id"], "left").select(key, "panel_id", "ord", F.coalesce("title", F.concat(F.lit("Tab "), F.col("ord").cast("string"))).alias("title"), "text")

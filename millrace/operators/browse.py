"""What a browser would collect from a page, read from its markup: visible text, sections, links, images, inline data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.operators.pages import _Builder

# Classes and ids of a page's sections; words of links to documents; words in addresses of lists of other products.
SECTION_MARKS = {
    "description": {"description", "product-description", "desc", "product-desc"}, "specifications": {"specifications", "specs", "product-specs", "tech-specs", "spec-list", "specification-list", "spec-table"},
    "features": {"features", "feature-list", "product-features", "key-features", "feature-highlights", "benefits", "feature-benefits", "highlight-list"},
    "included": {"included", "includes", "in-the-box", "box-contents", "included-items", "package-contents", "accessories", "accessory-list", "item-included"},
}
PANEL_MARKS = {"tab-content", "tab-panel", "accordion-content"}
INCLUDED_PHRASES = ("what’s in the box", "included items", "product includes", "package includes")
DOCUMENT_HINTS = ["manual", "datasheet", "spec sheet", "specification sheet", "brochure", "catalog", "ifu", "instructions", "user guide", "quick start", "installation", "sds", "msds", "safety data sheet", "warranty", "size chart", "compatibility"]
_UNSEEN = frozenset("script style noscript template head title".split())
_CHROME_CLASS = re.compile(r"(?:^|\b)(?:nav|header|footer|sidebar|breadcrumb|menu|account)(?:\b|$)")
_BLOCK = frozenset("p li div section article h1 h2 h3 h4 h5 h6 tr dt dd table ul ol dl main body br".split())
_OTHER_PATH = re.compile("(?i)related|recommend|upsell|cross|also(?:view|bought)|similar|fbt|suggest")
_TOLD = re.compile(r"(?i)\b(?:__NEXT_DATA__|__NUXT__|BCData|Shopify|spec|attribute|dimensions?)\b")
_NAMES = ("name", "label", "title", "displayName", "key", "property")
_VALUES = ("value", "displayValue", "val", "text", "content", "description")

SCHEMA = (
    "struct<visible_text:string,sections:struct<description:string,specifications:string,features:string,included:string,dl:string,tabs:map<string,string>>,"
    "links:struct<anchors:array<string>,images:array<string>,pdfs:array<string>,jsons:array<string>>,images:array<struct<src:string,alt:string,width:string,height:string>>,"
    "backgrounds:array<string>,hints:array<struct<href:string,text:string,hint:string>>,inline:array<string>,script_specs:array<struct<key:string,value:string>>>"
)


class _Browsed(_Builder):
    """A tree that keeps which element each piece of text stands in."""

    def __init__(self) -> None:
        super().__init__()
        self.owners: list[int | None] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        node = self.nodes[-1]
        up = self.nodes[node["parent"]] if node["parent"] is not None else {}
        node["unseen"] = up.get("unseen", False) or tag in _UNSEEN or "display:none" in node["attrs"].get("style", "").replace(" ", "") or "hidden" in node["attrs"]
        node["furniture"] = up.get("furniture", False) or tag in ("nav", "header", "footer", "aside") or bool(_CHROME_CLASS.search(" ".join(node["classes"]).lower()))

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        self.owners.append(self.open[-1] if self.open else None)

    def lines(self, node: dict | None, furniture: bool = True) -> str:
        """The seen text of an element, a line for each piece; the whole page for None."""
        begin, end = (node["begin"], node["end"]) if node else (0, len(self.texts))
        out = []
        for text, owner in zip(self.texts[begin:end], self.owners[begin:end]):
            at = self.nodes[owner] if owner is not None else {"unseen": False, "furniture": False}
            if not at["unseen"] and (furniture or not at["furniture"]) and (t := " ".join(text.split())):
                out.append(t)
        return "\n".join(out)


def script_pairs(script: str, typed: bool) -> Iterator[tuple[str, str]]:
    """Name and value pairs anywhere in the JSON of a script, lists of other products left out; of code at most five blocks are read."""
    if typed:
        blocks = [script]
    elif len(script) >= 40 and _TOLD.search(script):
        blocks, at = [], 0
        while len(blocks) < 5 and (m := re.compile(r"[{\[]").search(script, at)):
            try:
                _, end = json.JSONDecoder().raw_decode(script, m.start())
                blocks.append(script[m.start() : end])
                at = end
            except (ValueError, RecursionError):
                at = m.start() + 1
    else:
        return
    for block in blocks:
        try:
            stack = [(json.loads(block), "$")]
        except (ValueError, RecursionError):
            continue
        while stack:
            node, path = stack.pop()
            if isinstance(node, list):
                stack += [(x, path) for x in reversed(node)]
            elif isinstance(node, dict):
                name = next((node[k] for k in _NAMES if node.get(k)), None)
                value = next((node[k] for k in _VALUES if node.get(k)), None)
                if isinstance(name, (str, int, float)) and isinstance(value, (str, int, float)) and not _OTHER_PATH.search(path):
                    yield str(name), " ".join(str(value).split())
                stack += [(x, f"{path}.{k}") for k, x in reversed(node.items())]


def read_browsed(html: str) -> dict:
    page = _Browsed()
    page.feed(html)
    page.close()
    page._close_to(0)
    marks = [{*n["classes"], n["attrs"].get("id", "")} for n in page.nodes]
    main = next((n for n in page.nodes if n["tag"] == "main"), None)
    seen = page.lines(main, furniture=False)
    sections: dict = {}
    for name, wanted in SECTION_MARKS.items():
        hit = next((n for n, m in zip(page.nodes, marks) if m & wanted), None)
        sections[name] = page.lines(hit) if hit else ""
    meta = next((n["attrs"].get("content", "") for n in page.nodes if n["tag"] == "meta" and n["attrs"].get("name") == "description"), "")
    sections["description"] = sections["description"] or meta.strip()
    if not sections["features"]:
        for n in page.nodes:
            if n["tag"] in ("h2", "h3", "h4") and "feature" in page.text(n).lower():
                if after := next((x for x in page.nodes[n["last"] + 1 :] if x["parent"] == n["parent"] and x["tag"] in ("ul", "ol")), None):
                    sections["features"] = page.lines(after)
                    break
    panels = [n for n, m in zip(page.nodes, marks) if n["attrs"].get("role") == "tabpanel" or m & PANEL_MARKS or n["attrs"].get("id", "").startswith("tab-") or n["attrs"].get("id", "").endswith("-container")]
    if not sections["included"]:
        sections["included"] = next((t for p in panels if any(x in (t := page.lines(p)).lower() for x in INCLUDED_PHRASES)), "")
    sections["dl"] = "\n---\n".join(page.lines(n) for n in page.nodes if n["tag"] == "dl") or None
    sections["tabs"] = {(p["attrs"].get("aria-labelledby") or p["attrs"].get("id") or "tab").strip()[:60]: page.lines(p) for p in panels}
    hrefs = [(n["attrs"]["href"], page.text(n)) for n in page.nodes if n["tag"] == "a" and n["attrs"].get("href")]
    images = [n["attrs"] for n in page.nodes if n["tag"] == "img"]
    of = lambda pattern: list(dict.fromkeys(h for h, _ in hrefs if re.search(pattern, h, re.I)))
    hints: dict[str, dict] = {}
    for href, text in hrefs:
        low, file = text.lower(), href.lower()
        if hint := next((h for h in DOCUMENT_HINTS if h in low or h.replace(" ", "") in file), None):
            hints.setdefault(href, {"href": href, "text": text, "hint": hint})
    scripts = [(page.text(n), n["attrs"].get("type", "").lower()) for n in page.nodes if n["tag"] == "script"]
    specs: dict[str, str] = {}
    for text, kind in scripts:
        for key, value in script_pairs(text, kind in ("application/json", "application/ld+json")):
            specs.setdefault(key, value)
    styles = [n["attrs"].get("style", "") for n in page.nodes]
    found = [u for s in styles for _, u in re.findall(r"""url\((['"]?)(.*?)\1\)""", unescape(s))]
    return {
        "visible_text": seen if len(seen) >= 10 else page.lines(None), "sections": sections,
        "links": {"anchors": list(dict.fromkeys(h for h, _ in hrefs)), "images": list(dict.fromkeys(a["src"] for a in images if a.get("src"))), "pdfs": of(r"\.pdf(?:$|[?#])"), "jsons": of(r"\.json(?:$|[?#])")},
        "images": [{k: a.get(k) for k in ("src", "alt", "width", "height")} for a in images], "backgrounds": list(dict.fromkeys(found)), "hints": list(hints.values()),
        "inline": [t for t, kind in scripts if kind == "application/json" and t], "script_specs": [{"key": k, "value": v} for k, v in specs.items()],
    }


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    empty = read_browsed("")
    for pages in batches:
        rows = [read_browsed(h) if isinstance(h, str) else empty for h in pages]
        yield pd.DataFrame(rows, columns=list(empty))


def browsed(pages: DataFrame, html: str = "html", most_bytes: int = 3_000_000) -> DataFrame:
    """pages without html + (visible_text, sections, links, images, backgrounds, hints, inline, script_specs).

    visible_text is a line for each piece of text of the main part, outside menus, headers,
    footers and hidden elements; the whole page if that is hardly anything. Null pages and those
    beyond most_bytes, the feature's own limit, have empty parts. Plan: one parse of each page, no shuffle.
    """
    bounded = F.when(F.octet_length(html) <= most_bytes, F.col(html))
    read = pages.withColumn("_b", F.pandas_udf(_read, SCHEMA).asNondeterministic()(bounded))
    parts = ["visible_text", "sections", "links", "images", "backgrounds", "hints", "inline", "script_specs"]
    return read.select(*(c for c in pages.columns if c != html and c not in parts), "_b.*")

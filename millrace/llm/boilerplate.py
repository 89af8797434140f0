"""The main body of web pages told from page furniture.

A page is a list of flat text blocks, its lines. Each block is described by its word count,
link density and wording and by those of its neighbours, and a decision tree trained on the
small labelled table of block_labels decides. The texts have no markup, so link density is
the part of a block's words that stand in menu-like pieces or match the link targets of the
page or of its site; a site's targets are counted over all its pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.functions.text import host
from millrace.llm.block_labels import LABELLED, MOST_BLOCKS, ruled_pages

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_PIECES = re.compile(r"\s+[|›»>·•/–-]\s+|\s{2,}|\s*[|›»•]\s*")
_PRICE = re.compile(r"[$€£]\s?\d|\d\s?[€£]|\d\s?%")
_SLUG = re.compile(r"[^\w]+|_")
FEATURES = ("words", "score", "worst", "best", "links", "pieces", "sentence", "colon", "price", "number", "capitals", "own", "short_name", "before_score", "after_score", "before_words", "after_words", "before_links", "after_links", "listed")


def slug(text: str) -> str:
    return _SLUG.sub("-", text.lower()).strip("-")


def _terms(line: str) -> list[str]:
    return ["9" if w.isdigit() else w for w in _WORD.findall(line.lower())]


class Lexicon:
    """How much each word, and each pair of words in a row, speaks for furniture: smoothed log-odds over labelled blocks."""

    def __init__(self, rows: list[tuple[bool, str]]):
        self.counts = {True: Counter(), False: Counter()}
        self.n = Counter(label for label, _ in rows)
        for label, line in rows:
            self.counts[label].update(self.keys(line))

    @staticmethod
    def keys(line: str) -> set[str]:
        t = _terms(line)
        return set(t) | {f"{a} {b}" for a, b in zip(t, t[1:])}

    def odds(self, key: str, less: bool | None = None) -> float:
        """less: the label of the block itself, when a training block is scored without its own words."""
        a = self.counts[True][key] - (less is True)
        b = self.counts[False][key] - (less is False)
        if a <= 0 and b <= 0:
            return 0.0
        return math.log((a + 0.4) / (self.n[True] + 0.8)) - math.log((b + 0.4) / (self.n[False] + 0.8))

    def score(self, line: str, less: bool | None = None) -> tuple[float, float, float]:
        """The sum over the known words divided by the root of their number, and the words that speak most for content and for furniture."""
        odds = [o for k in self.keys(line) if (o := self.odds(k, less))]
        return (sum(odds) / math.sqrt(len(odds)), min(odds), max(odds)) if odds else (0.0, 0.0, 0.0)


class _Block:
    """What a line is by itself: the first eleven FEATURES, its slug and those of its pieces, whether it heads a list of other products."""

    __slots__ = ("values", "slug", "pieces", "heads")

    def __init__(self, line: str, lexicon: Lexicon, label: bool | None = None):
        words = _WORD.findall(line)
        n = len(words)
        parts = [p for p in _PIECES.split(line) if p.strip()]
        in_menu = n if len(parts) >= 3 or len(parts) == 2 and "–" not in line and n <= 8 else 0
        letters = [w for w in words if w[0].isalpha()]
        capitals = sum(w[0].isupper() for w in letters) / len(letters) if letters else 0.0
        end = line.rstrip()
        self.values = (n, *lexicon.score(line, label), in_menu / n if n else 0.0, len(parts), float(end.endswith((".", "!", ";")) and not end.endswith("...")), float(bool(_COLON.match(line))), float(bool(_PRICE.search(line))), float(any(w[0].isdigit() for w in words)), capitals)
        self.slug = slug(line)
        self.pieces = [] if in_menu == n else [(slug(p), len(_WORD.findall(p))) for p in parts]
        self.heads = bool(_HEADING.search(line))

    def at(self, own: str, anchors: frozenset[str]) -> tuple:
        """The first twelve FEATURES on a page with its own product and link targets."""
        v = self.values
        if anchors and self.pieces and (linked := sum(k for s, k in self.pieces if s in anchors)):
            v = (*v[:4], linked / v[0] if v[0] else 0.0, *v[5:])
        return (*v, float(bool(own) and self.slug == own))


_COLON = re.compile(r"[^:]{2,30}:\s")
_NONE = (0, 0.0, 0.0, 0.0, 0.0)


def block_features(blocks: list[_Block], own: str = "", anchors: frozenset[str] = frozenset()) -> list[tuple]:
    """A row of FEATURES for each block of a page."""
    basics = [b.at(own, anchors) for b in blocks]
    out = []
    listed = 0.0  # under a heading of other products: 1 while only names have followed
    for i, b in enumerate(basics):
        before = basics[i - 1] if i else _NONE
        after = basics[i + 1] if i + 1 < len(basics) else _NONE
        name = 2 <= b[0] <= 9 and b[10] >= 0.6 and not b[6] and not b[7] and not b[11]
        out.append((*b, float(name), before[1], after[1], before[0], after[0], before[4], after[4], listed))
        if blocks[i].heads:
            listed = 1.0
        elif not name:
            listed = 0.0
    return out


# Headings of lists of other products. Fixed values.
_HEADING = re.compile(r"(?i)\b(?:related (?:items|products)|also (?:viewed|bought|like)|more from|recently viewed|bought together|similar (?:items|products)|produits similaires|aimerez aussi|ähnliche artikel|könnte ihnen)")


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 6):
        self.share = float(y.mean())
        self.split: tuple[int, float] | None = None
        best = None
        if depth and len(y) >= 2 * least and 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                xs, ys = x[order, f], y[order]
                left = np.cumsum(ys)[:-1]
                n = np.arange(1, len(ys))
                m = len(ys) - n
                right = ys.sum() - left
                gini = 2 * (left * (1 - left / n) + right * (1 - right / m))
                ok = (xs[1:] > xs[:-1]) & (n >= least) & (m >= least)
                if ok.any():
                    k = int(np.argmin(np.where(ok, gini, np.inf)))
                    if best is None or gini[k] < best[0] - 1e-9:
                        best = (float(gini[k]), f, float((xs[k] + xs[k + 1]) / 2))
        if best:
            _, f, at = best
            mask = x[:, f] <= at
            self.split = (f, at)
            self.low = Tree(x[mask], y[mask], depth - 1, least)
            self.high = Tree(x[~mask], y[~mask], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.share)
        out = np.empty(len(x))
        mask = x[:, self.split[0]] <= self.split[1]
        out[mask] = self.low.predict(x[mask])
        out[~mask] = self.high.predict(x[~mask])
        return out


Page = tuple[str, frozenset[str], list[tuple[bool, str]]]  # own product, link targets, (is furniture, line) rows


def hand_labelled() -> list[Page]:
    pages: list[Page] = []
    for block in LABELLED.split("\n\n"):
        own, targets, *rows = block.split("\n")
        pages.append((own[2:], frozenset(targets[2:].split()), [(r[0] == "-", r[2:]) for r in rows]))
    return pages


def labelled_pages() -> list[Page]:
    pages = hand_labelled() + ruled_pages()
    if sum(len(rows) for _, _, rows in pages) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} labelled blocks")
    return pages


SHUFFLES = 6


def fitted(pages: list[Page]) -> tuple[Lexicon, Tree]:
    """The lexicon and the tree of labelled pages.

    Each page trains as it stands, with its furniture in capitals, and in six seeded
    shuffles, as furniture may stand between any blocks; in half of these its link targets
    are unknown. In two of three copies a block is scored without its own words, so that the
    tree learns what to make of new wording.
    """
    lexicon = Lexicon([row for _, _, rows in pages for row in rows])
    shuffle = np.random.default_rng(7)
    block = lru_cache(maxsize=None)(lambda line, label: _Block(line, lexicon, label))
    xs, ys = [], []
    for own, targets, rows in pages:
        for n, copy in enumerate((rows, [(label, line.upper() if label else line) for label, line in rows], *([rows[i] for i in shuffle.permutation(len(rows))] for _ in range(SHUFFLES)))):
            labels = [label for label, _ in copy]
            for without in (None, labels, labels):
                xs.append(np.array(block_features([block(line, label if without else None) for label, line in copy], own, targets if n % 2 == 0 else frozenset())))
                ys.append(np.array(labels, float))
    return lexicon, Tree(np.concatenate(xs), np.concatenate(ys))


@lru_cache(maxsize=1)
def trained() -> tuple[Lexicon, Tree]:
    return fitted(labelled_pages())


class Classifier:
    """Tells furniture on many pages at a time; lines that come again are looked at once."""

    def __init__(self, model: tuple[Lexicon, Tree] | None = None, memory: int = 100_000):
        self.lexicon, self.tree = model or trained()
        self.memory = memory
        self.known: dict[str, _Block] = {}
        self.sites: dict[str | None, frozenset[str]] = {}

    def block(self, line: str) -> _Block:
        got = self.known.get(line)
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            got = self.known[line] = _Block(" ".join(line.strip().split("\t")), self.lexicon)
        return got

    def targets(self, own, site: str | None) -> frozenset[str]:
        """Slugs of the link targets of a page and of its site, these one on each line."""
        if site not in self.sites:
            if len(self.sites) >= 1_000:
                self.sites.clear()
            self.sites[site] = frozenset((site or "").split("\n")) - {""}
        if own is None or not len(own):
            return self.sites[site]
        return self.sites[site] | {slug(a.rstrip("/").rsplit("/", 1)[-1]) for a in own if a}

    def furniture(self, pages: list[tuple]) -> list[list[int]]:
        """For each (lines, url, link targets, site's link targets) the positions from 1 of its furniture; blank and null lines never are."""
        rows: list[tuple] = []
        places: list[list[int]] = []
        for lines, url, anchors, site in pages:
            at = [i for i, line in enumerate(lines) if line and not line.isspace()]
            own = slug(m[1]) if url and (m := _OWN.search(url)) else ""
            rows += block_features([self.block(lines[i]) for i in at], own, self.targets(anchors, site))
            places.append(at)
        told = iter(self.tree.predict(np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))) > 0.5)
        return [[i + 1 for i in at if next(told)] for at in places]


_OWN = re.compile(r"/([^/?#]+?)(?:-\d+)?(?:\.html?)?/?(?:[?#].*)?$")


def furniture(lines: list[str | None], url: str | None = None, anchors=None, site: str | None = None) -> list[int]:
    """Positions from 1 of the lines of one page that are page furniture."""
    return Classifier().furniture([(lines, url, anchors, site)])[0]


def _lines_of():
    """A UDF of (text, url, link targets, site's link targets); the model is trained on the driver and goes with it."""
    model = trained()

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        tell = Classifier(model)
        for texts, urls, anchors, sites in batches:
            yield pd.Series(tell.furniture([(t.split("\n"), u, a, s) for t, u, a, s in zip(texts, urls, anchors, sites)]))

    return F.pandas_udf(run, "array<bigint>")


def _elements_of():
    """The same of (elements, url, site's link targets)."""
    model = trained()

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        tell = Classifier(model)
        for lists, urls, sites in batches:
            yield pd.Series(tell.furniture([(list(e), u, None, s) for e, u, s in zip(lists, urls, sites)]))

    return F.pandas_udf(run, "array<bigint>")


LEAST_LINKED = 0.02  # share of a site's pages that link a target of its navigation


def site_targets(pages: DataFrame) -> DataFrame:
    """(site, targets): the slugs that at least LEAST_LINKED of a site's pages link, one on each line.

    The shares of all targets sum to the mean number of links of a page, so a site has at most
    that mean / LEAST_LINKED of them, however many pages it has.
    """
    last = lambda a: F.regexp_replace(F.lower(F.regexp_extract(a, r"([^/]*)/*$", 1)), r"[^\p{L}\p{N}]+", "-")
    linked = pages.select(host(F.col("source_url")).alias("site"), F.array_distinct(F.transform(F.filter("links.anchors", lambda a: a.isNotNull()), last)).alias("_t")).where("site <> ''")
    sizes = linked.groupBy("site").agg(F.count("*").alias("_pages"))
    counts = linked.select("site", F.explode("_t").alias("_t")).where("_t not in ('', '-')").groupBy("site", "_t").agg(F.count("*").alias("_n"))
    kept = counts.join(sizes, "site").where(F.col("_n") >= LEAST_LINKED * F.col("_pages"))
    return kept.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("_t")), "\n").alias("targets"))


def _with_site(rows: DataFrame, url: str, sites: DataFrame | None) -> DataFrame:
    """rows + _site: the link targets of the site of a URL column, null if none are known."""
    if sites is None:
        return rows.withColumn("_site", F.lit(None).cast("string"))
    return rows.join(sites.select(F.col("site").alias("_host"), F.col("targets").alias("_site")), host(F.col(url)) == F.col("_host"), "left").drop("_host")


def page_furniture(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(src, row_id, pos) of the furniture lines of pages' visible_text; null texts have none.

    ``sites`` has the link targets of each site, by default those of the pages themselves.
    """
    rows = pages.where(F.col("visible_text").isNotNull() & F.col("page_id").isNotNull()).select("page_id", "visible_text", "source_url", F.col("links.anchors").alias("anchors"))
    rows = _with_site(rows, "source_url", site_targets(pages) if sites is None else sites)
    found = _lines_of()("visible_text", "source_url", "anchors", "_site")
    return rows.select(F.lit("visible_text").alias("src"), F.col("page_id").alias("row_id"), F.explode(found).alias("pos")).distinct()


def feature_furniture(records: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(src, row_id, pos) of the furniture elements of records' features_raw; null lists and elements have none."""
    rows = records.where((F.size("features_raw") > 0) & F.col("record_id").isNotNull()).select("record_id", "features_raw", "source")
    found = _elements_of()("features_raw", "source", "_site")
    return _with_site(rows, "source", sites).select(F.lit("features_raw").alias("src"), F.col("record_id").alias("row_id"), F.explode(found).alias("pos")).distinct()


def all_furniture(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Both; the link targets of the pages' sites serve the records of the same sites."""
    sites = site_targets(pages)
    return page_furniture(pages, sites).union(feature_furniture(records, sites))


def main_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, body): the lines of each page's main body, in order; '' where none is left, null for a null text."""
    rows = _with_site(pages.select("page_id", "visible_text", "source_url", F.col("links.anchors").alias("anchors")), "source_url", site_targets(pages))
    found = _lines_of()(F.coalesce("visible_text", F.lit("")), "source_url", "anchors", "_site")
    rows = rows.select("page_id", F.split("visible_text", "\n").alias("_lines"), found.alias("_out"))
    kept = F.filter("_lines", lambda x, i: (F.trim(x) != "") & ~F.array_contains("_out", (i + 1).cast("bigint")))
    return rows.select("page_id", F.array_join(kept, "\n").alias("body"))

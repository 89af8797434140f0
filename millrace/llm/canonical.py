"""Freely typed values mapped to the closest entry of a reference list.

The reference entries of each field stand in a BK-tree under the unrestricted
Damerau-Levenshtein distance, a true metric, so the triangle inequality prunes the search
and every entry within the threshold is found. A list within ``shard_size`` entries makes
one tree that is broadcast; a longer one makes several shards, each distinct value visits all
of them, and the winners of the shards are merged.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from millrace.session import spread

_LETTERS = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})

# What sellers write around a value: legal forms, provenance and quality words. Fixed values.
PREFIXES = ["by", "the", "made in", "made by", "product of", "manufactured by", "assembled", "assembled in", "from", "ex", "100", "high grade", "durable", "visco", "cfrp"]
SUFFIXES = ["company", "co", "corp", "corporation", "inc", "incorporated", "ltd", "limited", "llc", "gmbh", "ag", "sa", "oem", "group", "plant", "factory", "factory 1", "factory 2", "factory 3", "main works", "works", "main body", "frame", "construction", "body", "plastic"]
# Spellings and short forms that stand for a word or an entry. Fixed values.
WORDS = {
    "aluminium": "aluminum", "anodised": "anodized", "galvanised": "galvanized", "fibre": "fiber", "moulded": "molded", "mfg": "manufacturing", "mfr": "manufacturing", "alum": "aluminum", "hlthcare": "healthcare", "rehabilitation": "rehab", "pe": "polyethylene",
}
ALIASES = {
    "ss": "stainless steel", "inox": "stainless steel", "pvc": "polyvinyl chloride", "pp": "polypropylene", "pc": "polycarbonate", "tpe": "thermoplastic elastomer", "pu foam": "polyurethane foam", "pur foam": "polyurethane foam", "polipro": "polypropylene", "cfrp": "carbon fiber",
}
PLACEHOLDERS = frozenset(["", "n a", "na", "none", "null", "unknown", "tbd", "tba", "various", "varies", "mixed", "generic", "see label", "see manual", "custom", "other", "not stated", "not specified", "unbranded", "imported", "overseas", "no brand", "assorted"])


def fold(text: str) -> str:
    """Lower case without marks; every run of other characters than letters and digits is one blank."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return " ".join(re.sub(r"[^\w]+|_", " ", "".join(c for c in text if not unicodedata.combining(c))).split())


def distance(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance; most + 1 as soon as it must exceed most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    if start > 1:  # one equal letter stays, as a transposition may reach over it
        a, b = a[start - 1 :], b[start - 1 :]
    end = 0
    while end < len(a) and end < len(b) and a[-1 - end] == b[-1 - end]:
        end += 1
    if end > 1:
        a, b = a[: len(a) - end + 1], b[: len(b) - end + 1]
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        above = rows[i]
        left, corner, j = i, above[1], 0
        for y in b:
            j += 1
            over = above[j + 1]
            if x == y:
                value = corner
            else:
                value = corner if corner < over else over
                if left < value:
                    value = left
                value += 1
            if seen and (k := last.get(y)):  # y stood in a before, and x in b: the two may have changed places
                swapped = rows[k][seen] + i - k + j - seen - 1
                if swapped < value:
                    value = swapped
            if x == y:
                seen = j
            row.append(value)
            left, corner = value, over
        rows.append(row)
        last[x] = i
        if min(row[1:]) > most and min(rows[i][1:]) > most:
            return most + 1
    return rows[-1][-1]


@dataclass
class BkTree:
    """Words with payloads; children hang by their distance to the parent."""

    word: str = ""
    payload: list = field(default_factory=list)
    children: dict[int, "BkTree"] = field(default_factory=dict)
    filled: bool = False

    def add(self, word: str, payload) -> None:
        node = self
        if not node.filled:
            node.word, node.payload, node.filled = word, [payload], True
            return
        while True:
            d = distance(word, node.word, 10**6)
            if d == 0:
                node.payload.append(payload)
                return
            if d not in node.children:
                node.children[d] = BkTree(word, [payload], filled=True)
                return
            node = node.children[d]

    def within(self, word: str, most: int) -> list[tuple[int, str, list]]:
        """(distance, word, payloads) of every word at most that far away."""
        found, stack = [], [self] if self.filled else []
        while stack:
            node = stack.pop()
            reach = max(node.children, default=0) + most
            d = distance(word, node.word, max(most, reach))
            if d <= most:
                found.append((d, node.word, node.payload))
            stack += [child for k, child in node.children.items() if d - most <= k <= d + most]
        return found


_WRAPPERS = [p.split() for p in PREFIXES], [s.split() for s in SUFFIXES]
_WRAPPER_WORDS = sorted({w for ws in _WRAPPERS for p in ws for w in p if len(w) >= 5})


def strip_wrappers(words: list[str]) -> Iterator[list[str]]:
    """The words without what sellers write around a value, outermost first; the words as they stand come first."""
    yield words
    pre, post = _WRAPPERS
    while True:
        while words and words[-1] == ",":
            words = words[:-1]
        while words and words[0] == ",":
            words = words[1:]
        for w in pre:
            if len(words) > len(w) and words[: len(w)] == w:
                words = words[len(w) :]
                break
        else:
            for w in post:
                if len(words) > len(w) and words[-len(w) :] == w:
                    words = words[: -len(w)]
                    break
            else:
                return
        yield words


def threshold(word: str) -> int:
    """How far an entry may be from a reading of so many letters."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2 if len(word) < 12 else 3 if len(word) < 18 else 4


def short_threshold(word: str) -> int:
    """The same for short forms, which are single words: two letters at most."""
    return min(2, threshold(word))


class FieldFacts:
    """What is told by all entries of a field: their words, by first letter too, and the first words that more words follow."""

    def __init__(self, entries: Iterable[tuple[int, str]]):
        self.words: Counter[str] = Counter()
        self.firsts: set[str] = set()
        for _, canonical in entries:
            w = fold(canonical).split()
            self.words.update(w)
            if len(w) > 1 and len(w[0]) >= 5:
                self.firsts.add(w[0])
        self.by_letter: dict[str, list[str]] = {}
        for w in self.words:
            self.by_letter.setdefault(w[0], []).append(w)


class Matcher:
    """The entries of one field in one shard; ``field`` has all entries of the field, if these are but a shard of them."""

    def __init__(self, entries: list[tuple[int, str]], short_forms: dict[str, int], field: FieldFacts | None = None):
        self.tree, self.short_tree = BkTree(), BkTree()
        self.raw = {i: c.lower() for i, c in entries}
        self.field = field or FieldFacts(entries)
        self.words = self.field.words
        self.written_out: dict[str, str] = {}
        for i, canonical in entries:
            self.tree.add(fold(canonical).replace(" ", ""), i)
        for short, i in short_forms.items():
            self.short_tree.add(short, i)

    def _whole(self, w: str) -> str:
        """The one word of the list that w shortens, else w."""
        alike = self.field.by_letter.get(w[0], ())
        starts = [k for k in alike if k.startswith(w) or len(w) > 3 and w[-1] == "s" and k[-1] == "s" and k.startswith(w[:-1])]
        if not starts:
            starts = [k for k in alike if k[-1] == w[-1] and len(w) <= 0.75 * len(k) and _shortens(w, k)]
        if not starts:
            starts = [k for k in alike if len(w) <= 0.6 * len(k) and _shortens(w, k)]
        if len(starts) == 1:
            return starts[0]
        if len({self.words[k] for k in starts}) > 1 and sorted(self.words[k] for k in starts)[-2] == 1:
            return max(starts, key=lambda k: (self.words[k], k))
        return w

    def _expand(self, words: list[str]) -> list[str]:
        """Each word that the list doesn't know, and that shortens just one of its words, written out."""
        out = []
        for w in words:
            w = WORDS.get(w, w)
            if w not in self.words and 2 <= len(w) <= 7:
                if w not in self.written_out:
                    if len(self.written_out) > 100_000:
                        self.written_out.clear()
                    self.written_out[w] = self._whole(w)
                w = self.written_out[w]
            out.append(w)
        return out

    def _head(self, w: str) -> str | None:
        """A wrapper word, else the longest first word of the list, that w begins with and goes on from."""
        for known in _WRAPPER_WORDS:
            if w.startswith(known) and len(w) > len(known) + 1:
                return known
        return next((w[:n] for n in range(len(w) - 2, 4, -1) if w[:n] in self.field.firsts), None)

    def _split(self, words: list[str]) -> list[str]:
        """A word run together from a wrapper or a first word of the list and more is taken apart."""
        out = []
        for w in words:
            if w not in self.words and len(w) > 6:
                if known := self._head(w):
                    out += [known, w[len(known) :]]
                else:
                    near = [k for k in _WRAPPER_WORDS if abs(len(k) - len(w)) < 2 and distance(w, k, 1) == 1]
                    out.append(near[0] if near else w)
            elif w not in self.words and len(w) > 3 and (near := [k for k in _WRAPPER_WORDS if len(k) == len(w) + 1 and distance(w, k, 1) == 1]):
                out.append(near[0])
            else:
                out.append(w)
        return out

    def candidates(self, text: str) -> list[str]:
        """Folded readings of a typed value, the plainest first: without wrappers, turned round at a comma, with short forms written out."""
        out: list[str] = []
        parts = [text]
        if m := re.search(r"\(([^()]+)\)", text):
            parts += [m[1], text.replace(m[0], " ")]
        for part in parts:
            plain = [w for piece in part.split(",") for w in (*fold(piece).split(), ",")][:-1]
            for start in (plain, self._split(plain)):
                for words in strip_wrappers(start):
                    orders = [[w for w in words if w != ","]]
                    for k, w in enumerate(words):
                        if w == "," and 0 < k < len(words) - 1:
                            orders += strip_wrappers([w for w in words[k + 1 :] + words[:k] if w != ","])
                            head, tail = (list(strip_wrappers(side))[-1] for side in (words[:k], words[k + 1 :]))
                            orders.append([w for w in tail + head if w != ","])
                    for order in orders:
                        for form in (order, ALIASES.get(" ".join(order), "").split(), self._expand(order)):
                            if form and (key := "".join(form)) not in out:
                                out.append(key)
        return out

    def within(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Every entry within the threshold of a reading of the text: entry to its best (kind, distance, rank), as in ranked()."""
        low, found = text.lower().strip(), {}
        for n, form in enumerate(self.candidates(text)):
            for kind, tree, reach in ((0, self.tree, threshold), (1, self.short_tree, short_threshold)):
                for d, _, ids in tree.within(form, reach(form)):
                    for i in ids:
                        rank = (kind + 2, d, distance(low, self.raw[i], 60)) if d else (kind, 0, n)
                        found[i] = min(rank, found.get(i, rank))
        return found

    def ranked(self, text: str) -> tuple[int, int, int, int] | None:
        """(kind, distance, rank, entry) of the closest entry, or None if none is within the threshold.

        It is the least of within(), found with a radius that grows up to the threshold of each
        reading and stops at the first that holds an entry.
        The least of several shards is that of the whole list. Kinds, the best first: an entry, a
        short form, an entry at a distance, a short form at a distance. The rank of the first two
        is the reading it was found by, of the others the distance with marks and blanks.
        """
        if fold(text) in PLACEHOLDERS:
            return None
        forms = self.candidates(text)
        for kind, tree in enumerate((self.tree, self.short_tree)):
            for n, form in enumerate(forms):
                if same := tree.within(form, 0):
                    return kind, 0, n, min(same[0][2])
        low = text.lower().strip()
        for kind, (tree, reach) in enumerate(((self.tree, threshold), (self.short_tree, short_threshold)), 2):
            found: dict[int, int] = {}
            reaches = [(form, reach(form)) for form in forms]
            for most in range(1, max((r for _, r in reaches), default=0) + 1):  # a small radius prunes most, and suits most values
                for form, r in reaches:
                    if most <= r:
                        for d, _, ids in tree.within(form, most):
                            for i in ids:
                                found[i] = min(d, found.get(i, d))
                if found:
                    break
            least = min(found.values(), default=0)
            if found:
                # ties: the entry closest with its marks and blanks, then the first
                rank, entry = min((distance(low, self.raw[i], 60), i) for i, d in found.items() if d == least)
                return kind, least, rank, entry
        return None

    def best(self, text: str) -> tuple[int, int] | None:
        """(distance, entry) of the closest entry, or None if none is within the threshold."""
        hit = self.ranked(text)
        return hit and (hit[1], hit[3])


def _shortens(short: str, word: str) -> bool:
    """Are the letters of short found in word in that order?"""
    letters = iter(word)
    return all(c in letters for c in short)


def short_forms(entries: list[tuple[int, str]]) -> dict[str, int]:
    """First words that just one entry of several words begins with, as a short form of it."""
    firsts = Counter(fold(c).split()[0] for _, c in entries if fold(c))
    rest = Counter(w for _, c in entries for w in fold(c).split()[1:])
    return {w[0]: i for i, c in entries if len(w := fold(c).split()) > 1 and firsts[w[0]] == 1 and w[0] not in rest and len(w[0]) >= 5}


_HIT = ("kind", "distance", "rank", "entry")
_BUILT: dict[str, dict[str, Matcher]] = {}  # of a worker: the trees of each broadcast shard, built once


def _searcher(sent: Broadcast) -> Callable:
    name = uuid.uuid4().hex

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        shard, shorts, facts = sent.value
        if name not in _BUILT:
            _BUILT[name] = {f: Matcher(entries, shorts.get(f, {}), facts[f]) for f, entries in shard.items()}
        matchers = _BUILT[name]
        exact = {f: {c for _, c in entries} for f, entries in shard.items()}
        for fields, texts in batches:
            out = []
            for f, text in zip(fields, texts):
                hit = matchers[f].ranked(text) if f in matchers else None
                out.append((f in exact and text in exact[f], *(hit or (None,) * 4)))
            yield pd.DataFrame(out, columns=["canonical", *_HIT]).astype(dict.fromkeys(_HIT, "Int64"))

    return run


def map_to_list(values: DataFrame, reference: DataFrame, spec_field: str, text: str, shard_size: int = 20_000) -> DataFrame:
    """values + (is_canonical, entry): whether the text is an entry as it stands, and the closest entry's id or 0.

    ``reference`` has canon_id, spec_field and canonical. Null texts and placeholders get 0,
    as does every value when the list is empty. Of entries equally close the one closest with
    its marks counts, then the one with the smaller id.

    Plan: each distinct value is searched once and joined back, so a value that a third of the
    rows have costs one search. The list goes out in broadcast shards of at most about
    shard_size entries; a longer list makes several passes of the search over each distinct
    value, whose winners are merged in the row. What a field's whole list tells (short forms,
    words, first words) goes to every shard, so a shard's winner is ranked as in the whole list.
    """
    spark = values.sparkSession
    listed = reference.where(F.col("canonical").isNotNull()).select("canon_id", "spec_field", "canonical").distinct()
    # Short forms, words and first words are told by the whole list of a field, whatever shard an entry is in.
    whole: dict[str, list[tuple[int, str]]] = {}
    for r in listed.orderBy("canon_id").toLocalIterator():
        whole.setdefault(r["spec_field"], []).append((r["canon_id"], r["canonical"]))
    facts = {f: FieldFacts(entries) for f, entries in whole.items()}
    all_shorts = {f: short_forms(entries) for f, entries in whole.items()}
    n_shards = max(1, -(-sum(map(len, whole.values())) // shard_size))
    out = spread(values.select(F.col(spec_field).alias("_field"), F.coalesce(F.col(text), F.lit("")).alias("_text")).distinct())
    hits = []
    for s in range(n_shards):
        shard = {f: own for f, entries in whole.items() if (own := entries[s::n_shards])}
        here = {f: {i for i, _ in entries} for f, entries in shard.items()}
        shorts = {f: {w: i for w, i in all_shorts[f].items() if i in ids} for f, ids in here.items()}
        sent = spark.sparkContext.broadcast((shard, shorts, {f: facts[f] for f in shard}))
        # Said to be nondeterministic, so that it isn't run once for a filter and once for the result.
        search = F.pandas_udf(_searcher(sent), "struct<canonical:boolean,kind:bigint,distance:bigint,rank:bigint,entry:bigint>").asNondeterministic()
        name = f"_hit{s}"
        out = out.withColumn(name, search("_field", "_text"))
        hits.append(name)
    winner = F.array_min(F.filter(F.array(*(F.struct(*(F.col(f"{h}.{x}").alias(x) for x in _HIT)) for h in hits)), lambda x: x["entry"].isNotNull()))
    is_canonical = F.exists(F.array(*(F.col(f"{h}.canonical") for h in hits)), lambda x: x)
    told = out.select("_field", "_text", is_canonical.alias("is_canonical"), F.coalesce(winner["entry"], F.lit(0)).cast("bigint").alias("entry"))
    same = F.col(spec_field).eqNullSafe(F.col("_field")) & (F.coalesce(F.col(text), F.lit("")) == F.col("_text"))
    return values.join(told, same).select(*(values[c] for c in values.columns), "is_canonical", "entry")


FIELDS = ("manufacturer", "origin", "material")


def product_values(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(record_id, spec_field, canon_id) of every specs entry of the three fields that isn't a canonical value as it stands."""
    name = F.regexp_replace(F.regexp_replace(F.lower("key"), r"^[\s_\-]+|[\s_\-]+$", ""), r"[\s_\-]+", "_")
    entries = (
        records.where(F.col("record_id").isNotNull())
        .select("record_id", F.explode("specs"))
        .select("record_id", name.alias("spec_field"), "value")
        .where(F.col("spec_field").isin(*FIELDS))
    )
    mapped = map_to_list(entries, reference, "spec_field", "value")
    return mapped.where(~F.col("is_canonical")).select("record_id", "spec_field", F.col("entry").alias("canon_id")).distinct()

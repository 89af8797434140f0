"""Texts decoded with a wrong character encoding, found and restored.

A best-first search walks over encode/decode and unescape operations. A state is a text; its
price is the number of operations so far plus a character-plausibility cost, which sums over
characters outside ASCII how unlikely each is where it stands. States are known by hash, so
none is visited twice. The cheapest text reached wins; a text that is plausible as it stands
is left alone. The search covers the whole text first and then, where something implausible
remains, each sentence by itself, since a text may be damaged in part.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2")
STEP = 0.6  # price of one operation
LEAST = 0.65  # by how much the cheapest text must undercut the text as it stands
LOST = "�"

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_SENTENCE = re.compile(r"[^\n.!?]*[.!?]*[ \t]*\n?")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,5});")
_ENGLISH = re.compile(r"\b(?:the|and|of|for|with|must|is|are|be|to|on|it|was|before|your|this|by|from|at)\b")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
# A garbled sequence that a text cites: it stands alone between quotation marks.
_CITED = re.compile(r"[“\"'‘«„][^\x00-\x7f\w]?[^\x00-\x7f]{1,6}[”\"'’»“]")

# Letters that running text of Latin languages has, beside ASCII.
_LOWER = frozenset("éèêëàâäáãåçñóöôõòúüùûíîïìßœæøłśźżćńąęšžýčřěůőűğışă")
_UPPER_ANY = frozenset("ÉÈÊËÀÄÁÅÇÑÓÖÔÕÚÜÙÛÍÎÏŒÆØŁŚŹŻĆŃĄĘŠŽÝČŘ")
_UPPER_INNER = frozenset("ÃÂÒÌ")  # hardly ever first in a word of small letters
_FINE = frozenset("…→←−≤≥  ​")


def _plausible(c: str, p: str, n: str, q: str = "") -> float:
    """Cost of character c between p and n ('' at an end); q stands before p."""
    if c in _LOWER:
        if not p.isalpha() and not n.isalpha():  # a word of one letter
            return 0.0 if c in "àéóáèêòìù" else 1.2
        if n.isupper() and (not p.isalpha() or p.isupper()) or p.isupper() and not n.isalpha() and q.isupper():
            return 1.2
        if c in "ôûâ" and not p.isalpha() or c in "öôîû" and not n.isalpha():
            return 0.7
        return 0.6 if p.isdigit() or n.isdigit() else 0.0
    if c in _UPPER_ANY:
        if p == " " and q.isdigit() and n == "L":  # a unit after a number
            return 1.5
        return 1.6 if p.islower() or p in "âãÃÂ" and p else 1.2 if n and not (n.isalpha() or n in " -,.’'\n!?:;)/") else 0.0
    if c in _UPPER_INNER:
        return 0.0 if n.isupper() and n.isascii() or p.isupper() and n in " .,!?:;)\n-" else 2.0
    if c == "°":
        return 0.0 if not p.isalpha() and (n in "CFc" or not n.isalnum()) else 1.5
    if c in "½¼¾":
        return 0.0 if not p.isalpha() and not n.isalpha() else 1.5
    if c in "×±÷":
        return 0.0 if not p.isalpha() and not n.isalpha() and c != "÷" else 0.5 if c == "÷" and not p.isalpha() and not n.isalpha() else 1.5
    if c == "·":
        return 0.0 if p.isalpha() == n.isalpha() else 1.0
    if c in "®™":
        return 0.0 if (p.isalnum() or p in " )") and not n.isalpha() else 1.5
    if c == "©":
        return 0.0 if not p.isalpha() and n in " 12" else 1.5
    if c in "µμ":
        return 0.0 if not p.isalpha() and n.isascii() and n.isalpha() else 1.5
    if c in "²³":
        return 0.0 if p in "m0123456789" and p and not n.isalpha() else 1.5
    if c in "¿¡":
        return 0.0 if not p.isalnum() and n.isalpha() else 1.5
    if c in "–—":
        return 0.0 if p in " \n\t" and n in " \n\t" or p.isdigit() and n.isdigit() or not p and n == " " else 1.2
    if c == "“":
        return 0.0 if (not p or p in " (\n\t–—") and n and not n.isspace() else 0.4 if p and not p.isspace() and not n.isalnum() and p.isascii() else 1.2
    if c == "”":
        return 0.0 if p and not p.isspace() and not n.isalnum() else 1.2
    if c == "’":
        return 0.0 if p.isalnum() else 1.0
    if c == "‘":
        return 0.0 if not p.isalnum() and n.isalnum() else 1.2
    if c == "„":
        return 0.0 if not p.isalnum() and n.isalnum() else 1.2
    if c == "«":
        return 0.0 if not p.isalnum() else 1.2
    if c == "»":
        return 0.0 if not n.isalnum() else 1.2
    if c in "•●▪":
        return 0.0 if not p.isalpha() and n in " \t" else 1.2
    if c == "€":
        return 0.0 if p in " \n0123456789" and n in " \n.,0123456789" else 1.5
    if c == "\xa0":
        return 0.0 if p.isdigit() or n in "%:;!?»°" and n or p.isascii() and n.isascii() and p.isalnum() else 0.8
    if c in _FINE:
        return 0.0
    if c == LOST:
        return 3.0
    kind = unicodedata.category(c)
    if kind in ("Cc", "Cn", "Co", "Cf"):
        return 2.5
    if c.isalpha() and c > "˿" and unicodedata.name(c, "").split(" ")[0] not in ("GREEK", "LATIN"):
        # other scripts are fine among themselves
        return 0.0 if (not p.isalpha() or p > "˿") and (not n.isalpha() or n > "˿") else 1.5
    if c.isalpha() and "Ͱ" <= c <= "Ͽ":
        return 0.0 if (p.isalpha() and p >= "Ͱ") or (n.isalpha() and n >= "Ͱ") else 0.8 if not p.isalpha() and not n.isalpha() else 1.5
    return 1.5


_weight = lru_cache(maxsize=200_000)(_plausible)


def _english(text: str, i: int) -> bool:
    """Do the words around position i, within its line, read as English?"""
    a, b = text.rfind("\n", max(0, i - 80), i) + 1 or max(0, i - 80), text.find("\n", i, i + 80)
    return len(_ENGLISH.findall(text[a : b if b > 0 else i + 80])) >= 2


def cost(text: str) -> float:
    """How implausible the characters of a text are; 0 for a text in order. A cited sequence costs nothing."""
    english = bool(_ENGLISH.search(text))
    cited = [m.span() for m in _CITED.finditer(text)] if any(q in text for q in "“\"'‘«„") else []
    total, k = 0.0, 0
    for m in _NON_ASCII.finditer(text):
        i = m.start()
        c = text[i]
        w = _weight(c, text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else "", text[i - 2] if i > 1 else "")
        if english and w < 0.7 and c in _LOWER and _english(text, i):
            w = 0.7  # English has few letters with marks
        if w:
            while k < len(cited) and cited[k][1] <= i:
                k += 1
            if not (k < len(cited) and cited[k][0] <= i):
                total += w
    if "&" in text:
        total += 1.5 * len(_ENTITY.findall(text))
    if "\\u" in text:
        total += 1.5 * len(_ESCAPE.findall(text))
    return total


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[dict[str, int], list[str]]:
    """char to byte and byte to char; bytes a codec leaves out stand for the control characters of that number."""
    back = []
    for b in range(256):
        try:
            back.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            back.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(back)))}, back


def undo_utf8(text: str, codec: str) -> str | None:
    """The text with every run of characters that are UTF-8 bytes read by codec brought back; None if there is none."""
    forth, _ = _table(codec)
    changed = False

    def repair(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        out, i = [], 0
        while i < len(run):
            lead = forth.get(run[i], 0)
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if size and i + size <= len(run):
                tail = [forth.get(c, 0) for c in run[i + 1 : i + size]]
                if all(0x80 <= b <= 0xBF for b in tail):
                    try:
                        out.append(bytes([lead, *tail]).decode("utf-8"))
                        i += size
                        changed = True
                        continue
                    except UnicodeDecodeError:
                        pass
            out.append(run[i])
            i += 1
        return "".join(out)

    fixed = _RUN.sub(repair, text)
    return fixed if changed else None


@lru_cache(maxsize=None)
def _swap(wrong: str, right: str) -> dict[int, str]:
    forth, _ = _table(wrong)
    _, back = _table(right)
    return {ord(c): back[b] for c, b in forth.items() if b > 127}


def undo_single(text: str, wrong: str, right: str) -> str | None:
    """Bytes of codec right that were read as codec wrong; None if a character isn't of wrong or nothing changes."""
    table = _swap(wrong, right)
    if any(ord(c) not in table for c in set(_NON_ASCII.findall(text))):
        return None
    fixed = text.translate(table)
    return fixed if fixed != text else None


def _unescape(text: str) -> str | None:
    fixed = html.unescape(text) if _ENTITY.search(text) else text
    fixed = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), fixed)
    return fixed if fixed != text else None


OPERATIONS = (
    [("utf-8", c) for c in CODECS]
    + [(right, wrong) for right in ("cp1252", "latin-1") for wrong in ("mac_roman", "cp437", "cp850")]
    + [(right, wrong) for right in ("cp1250", "iso8859-2") for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")]
    + [(right, wrong) for right in ("mac_roman", "cp437", "cp850") for wrong in ("cp1252", "latin-1")]
    + [("cp1252", "cp1250"), ("latin-1", "iso8859-2")]
    + [("unescape", "")]
)


def apply_operation(text: str, operation: tuple[str, str]) -> str | None:
    right, wrong = operation
    if right == "unescape":
        return _unescape(text)
    return undo_utf8(text, wrong) if right == "utf-8" else undo_single(text, wrong, right)


def price(steps: int) -> float:
    """Price of so many operations: each costs twice the one before, as text is seldom damaged often."""
    return STEP * (2**steps - 1)


def search(text: str, first: tuple = ()) -> tuple[str, float, tuple]:
    """The cheapest text reachable, its cost and the operations that lead to it.

    ``first`` names chains of operations that served elsewhere in the document; they are
    tried at half the price of one. The search ends when no open state can lead to a cheaper
    text, as the next operation alone costs more: it leaves nothing out.
    """
    start = cost(text)
    best = (start, text, ())
    for chain in first:
        state = follow(text, chain)
        if state is not None and state != text:
            c = cost(state)
            if c + STEP / 2 < best[0]:
                best = (c + STEP / 2, state, chain)
    seen = {hash(text)}
    queue: list[tuple[float, int, str, tuple]] = [(start, 0, text, ())]
    order = 1
    while queue:
        _, _, state, path = heapq.heappop(queue)
        paid = price(len(path) + 1)
        if paid >= best[0]:
            continue
        for op in OPERATIONS:
            nxt = apply_operation(state, op)
            if nxt is None or (h := hash(nxt)) in seen:
                continue
            seen.add(h)
            total = cost(nxt) + paid
            if total < best[0] - 1e-9:
                best = (total, nxt, (*path, op))
            heapq.heappush(queue, (total, order, nxt, (*path, op)))
            order += 1
    return best[1], cost(best[1]), best[2]


def follow(text: str, chain: tuple) -> str | None:
    """The text after a chain of operations; None if one of them doesn't apply."""
    state: str | None = text
    for op in chain:
        state = apply_operation(state, op) if state is not None else None
    return state


def restore(text: str) -> tuple[bool, str | None]:
    """(was the text decoded wrongly, the restored text or None if it can't be recovered)."""
    before = cost(text)
    if before < LEAST:
        return False, None
    if LOST in text:
        return True, None
    fixed, after, path = search(text)
    if after > 0.5:
        # damaged in part, or by several ways: sentence by sentence, the ways found so far first
        ways = [path] if path else []
        pieces = _SENTENCE.findall(text)
        results: list[str] = []
        for piece in pieces:
            if piece and cost(piece) > 0:
                got, _, way = search(piece, tuple(ways))
                if way and way not in ways:
                    ways.append(way)
                results.append(got)
            else:
                results.append(piece)
        for i, piece in enumerate(pieces):  # sentences whose characters tell too little by themselves
            if results[i] == piece and _NON_ASCII.search(piece):
                results[i] = search_known(piece, ways)
        split = "".join(results)
        if cost(split) < after:
            fixed, after = split, cost(split)
    if fixed == text or before - after < LEAST:
        return False, None
    return True, fixed


def search_known(piece: str, ways: list[tuple]) -> str:
    """piece after the first of the given ways that applies to it and leaves it no less plausible; else piece."""
    for way in ways:
        state = follow(piece, way)
        if state is not None and state != piece and cost(state) <= cost(piece):
            return state
    return piece


def _restore(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        got = [restore(t) if isinstance(t, str) else (False, None) for t in texts]
        yield pd.DataFrame({"found": [f for f, _ in got], "text": [t for _, t in got]})


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored): every document decoded wrongly, wholly or in part, with its restored text or null if it can't be recovered.

    Null, blank and ASCII texts are in order. Texts are read whole. A row that repeats comes
    out once. Plan: a narrow map; a test on the JVM keeps ASCII texts from Python.
    """
    rows = documents.select(F.col(key), F.col(text).alias("_text")).where(F.col("_text").rlike(r"[^\x00-\x7f]|&[#a-zA-Z][0-9a-zA-Z]+;|\\u[0-9a-fA-F]{4}"))
    # Said to be nondeterministic, so that the search isn't run once for the filter and once for the text.
    search_once = F.pandas_udf(_restore, "struct<found:boolean,text:string>").asNondeterministic()
    found = rows.select(key, search_once("_text").alias("_r")).where("_r.found")
    return found.select(key, F.col("_r.text").alias("restored"))


def restored_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, restored_md5) of the documents decoded wrongly; '' where the original is lost."""
    return restored(documents).select("doc_id", F.coalesce(F.md5(F.encode("restored", "UTF-8")), F.lit("")).alias("restored_md5")).distinct()


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()

"""Splitting rules of packed fields, resolved on delimiter skeletons.

A value is cut into tokens; its skeleton has one character for each token: ``x`` for a run of
ordinary words, ``&`` for the word "and", ``N`` for a list number, ``B`` for a line-break tag,
``m`` for a dash and ``p`` for a plus without blanks, any other mark as itself. Values of the same layout
share a skeleton however their words differ, so a rule (which tokens make up each item) is
resolved once for each distinct skeleton.

The token pattern is written for Java and Python alike. Its repeats are bounded, so that a
long text gives more tokens, never a deep recursion.
"""

from __future__ import annotations

# A word may hold marks between its letters and digits: MD-695/7, 3,5, caregiver's, blue/white.
_WORD = r"[\p{L}\p{N}\p{M}]+(?:[-'’./][\p{L}\p{N}\p{M}]+|,(?<=[0-9],)[0-9][\p{L}\p{N}\p{M}]*){0,20}"
_AND = r"(?:and|und|et|AND|And)"
_NUMBER = r"\(?[0-9]{1,3}[.)] +"
DELIMITERS = ",;|•·\n\t\r；、"
TOKEN = (
    rf"(?s) *{_NUMBER}(?=[^ ])"
    rf"| *(?:<br ?/?>|[{DELIMITERS}]) *"  # delimiters with the blanks around them
    r"| +[/+&–-] +"  # these separate only between blanks
    rf"| +{_AND} +(?=[^ ])|(?<=[,;] ){_AND} +(?=[^ ])"
    rf"|{_WORD}(?: +(?!{_AND} |{_NUMBER}){_WORD}){{0,30}}"
    r"| +|."
)

_LINE_MARKS = "m-–•*·"
_SEPARATORS = frozenset(DELIMITERS) | frozenset("B/+&–-")


def resolve_rule(skeleton: str) -> list[tuple[int, int, str]]:
    """(first token, end token, escape) of each item of a skeleton; escape names the quoting to undo.

    Marks that only separate, number or enclose belong to no item: delimiters, list numbers
    and bullets, quotes and brackets around an item, and a quote whose partner is missing.
    A delimiter inside quotes or round brackets doesn't separate. List numbers count as such
    only if the value starts with one.
    """
    lo, hi = 0, len(skeleton)
    while lo < hi and skeleton[lo] == " ":
        lo += 1
    while hi > lo and skeleton[hi - 1] == " ":
        hi -= 1
    json_style = hi - lo >= 2 and skeleton[lo] == "[" and skeleton[hi - 1] == "]"
    if json_style:
        lo, hi = lo + 1, hi - 1
    numbered = lo < hi and skeleton[lo] == "N"
    ends = _SEPARATORS | ({"N"} if numbered else set())
    items: list[tuple[int, int, str]] = []

    def trim(start: int, end: int) -> tuple[int, int]:
        while start < end and skeleton[start] == " ":
            start += 1
        while end > start and skeleton[end - 1] == " ":
            end -= 1
        return start, end

    def closing(i: int) -> int | None:
        """The token that closes the quote opened at i: the next one of its kind that stands before a delimiter or the end."""
        quote, j = skeleton[i], i + 1
        while j < hi:
            if json_style and skeleton[j] == "\\":
                j += 2
            elif skeleton[j] != quote:
                j += 1
            elif j + 1 < hi and skeleton[j + 1] == quote:  # doubled: a quote of the text
                j += 2
            else:
                k = j + 1
                while k < hi and skeleton[k] == " ":
                    k += 1
                if k >= hi or skeleton[k] in ends or skeleton[k] == "p":
                    return j
                j += 1
        return None

    def add(start: int, end: int, escape: str = "") -> None:
        start, end = trim(start, end)
        if not escape and start < end and skeleton[start] in "\"'":  # its partner is missing
            start, end = trim(start + 1, end)
        if any(t != " " and t not in _SEPARATORS for t in skeleton[start:end]):
            items.append((start, end, escape))

    last_bracket = skeleton.rfind(")", lo, hi)
    i = start = lo
    fresh, depth = True, 0
    while i < hi:
        t = skeleton[i]
        if fresh and (t == " " or t in _LINE_MARKS and i + 1 < hi or t == "N" and numbered):
            i += 1
            start = i
        elif fresh and t in "\"'" and (end := closing(i)) is not None:
            add(i + 1, end, "json" if json_style else t)
            i = start = end + 1
        elif not depth and (t in ends or t == "p" and (fresh or not skeleton[i + 1 : hi].strip() or skeleton[i + 1] in ends)):
            add(start, i)
            i += 1
            start, fresh = i, True
        else:
            if t == "(" and i < last_bracket:
                depth += 1
            elif t == ")" and depth:
                depth -= 1
            if depth and i >= last_bracket:
                depth = 0
            fresh = False
            i += 1
    add(start, hi)
    return items

"""Texts of scanned pages repaired: words broken over lines, misread characters, running headers, page numbers.

Lines are labelled as header, page number, heading, body or break by a hidden Markov model
over layout features, its tables counted on a small labelled set; the most likely labels of a
whole text come from the Viterbi recursion. Body lines are then joined to paragraphs, broken
words are closed and misread words replaced by the corpus word they stand for.

Two facts are counted over all texts: in how many texts a word stands, and how often a short
line stands next to a page number or form feed. Of either only entries with a least share of
the texts are kept. The shares of all words sum to the mean number of different words in a
text, so their number is bounded by that mean over the least share, however many texts there
are; that bound makes them safe to broadcast. What the broadcast words leave open is asked of
the counts of all words by a join, and of the other words of its own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm.canonical import distance
from millrace.llm.scan_labels import LABELLED
from millrace.session import cut

STATES = "HPTBK"  # header, page number, heading or item, body, break
LEAST_WORD_SHARE = 0.003
LEAST_LINE_SHARE = 0.0005
# A word that so many times more texts hold explains a misreading without a telling character.
FAR_MORE = 25
_DIGIT = "[0-9OolIiSs]"
_PAGE = re.compile(rf"^(?:p\. ?{_DIGIT}{{1,4}}|[Pp]age {_DIGIT}{{1,4}}(?: of {_DIGIT}{{1,4}})?|[-–] ?{_DIGIT}{{1,4}} ?[-–]|\[{_DIGIT}{{1,4}}\]|{_DIGIT}{{1,3}}[-/]{_DIGIT}{{1,3}}|[0-9lIO]{{1,4}}|[ivxlc]{{1,8}}|{_DIGIT}{{1,4}} ?[|·•] ?\S+|[A-Z][^\W\d_]+ {_DIGIT}{{1,4}})$")
_MARKS = "-¬‐\xad"
_EDGE = ".,;:!?“”\"'‘’()[]{}…"


def broken_by(line: str) -> str | None:
    """The mark that breaks a word at the end of a line, if one does."""
    text = line.rstrip()
    if len(text) > 1 and text[-1] in _MARKS and any(c.isalnum() for c in text.rsplit(None, 1)[-1][:-1]):
        return text[-1]
    return None


def shape(line: str) -> str:
    """The form of a line, one of a few words."""
    text = line.strip("\f\r ")
    if not text:
        return "blank"
    if re.match(r"\d+\. [A-Z]|(?:[A-Z]\w{2,6}\.?) \d{1,3}$", text) and not re.match(r"[Pp]age ", text) and len(text.split()[0].rstrip(".")) <= 4:
        return "numbered"
    if _PAGE.match(text):
        return "page"
    if text.startswith(("- ", "• ", "* ")) and not text.endswith("-"):
        return "item"
    words = text.split()
    if len(words) <= 8 and not text.endswith((".", ",", ";")) and (text[0].isupper() or not text[0].isalnum() or text[0].isdigit()) and not broken_by(text):
        if re.match(r"(?:Rev\.|©|[A-Z]+ +–)", text):
            return "stamp"
        if len(words) == 1 and text.isupper():
            return "shout"
        capitals = sum(w[0].isupper() for w in words if w[0].isalpha()) / max(1, sum(w[0].isalpha() for w in words))
        return "title" if capitals > 0.6 and len(words) > 1 else "short"
    return "sentence" if text[0].isupper() else "text"


@lru_cache(maxsize=200_000)
def line_key(text: str) -> str:
    """A short line with digits masked and misread letters brought to one, to count equal lines."""
    text = text.strip("\f\r ").lower()
    for a, b in (("€", "e"), ("†", "t"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("ﬁ", "fi")):
        text = text.replace(a, b)
    return re.sub(r"9+", "9", re.sub(r"[0-9]", "9", text.translate(str.maketrans("0o1li5s6bh|", "00111550011"))).replace("g", "9"))


def _features(lines: list[str], shares: dict[str, float], near_equal: bool = True) -> list[tuple[str, str, str, str]]:
    """(form, repeats, edge, where else) of each line; with near_equal, lines that differ by a slip or two repeat each other."""
    forms = [shape(x) for x in lines]
    keys = [line_key(x) if f not in ("blank", "page", "text", "sentence") else "" for x, f in zip(lines, forms)]
    # equal lines but for a slip or two count together
    alike: dict[str, str] = {}
    heads: dict[int, list[str]] = defaultdict(list)  # by length, the most frequent first
    for k, _ in sorted(Counter(k for k in keys if k).items(), key=lambda x: (-x[1], x[0])) if near_equal else ():
        near = (h for n in range(len(k) - 2, len(k) + 3) for h in heads.get(n, ()) if distance(k, h, 2) <= 2) if len(k) >= 10 else ()
        alike[k] = next(iter(near), k)
        if alike[k] == k:
            heads[len(k)].append(k)
    keys = [alike.get(k, k) for k in keys]
    repeats = Counter(k for k in keys if k)
    filled = [i for i, f in enumerate(forms) if f != "blank"]
    place = {i: n for n, i in enumerate(filled)}
    out = []
    for i, (line, form, key) in enumerate(zip(lines, forms, keys)):
        n = repeats[key] if key else 0
        edge = "inner"
        if form != "blank":
            p = place[i]
            near = [filled[q] for q in (p - 1, p + 1) if 0 <= q < len(filled)]
            if "\f" in line or p + 1 < len(filled) and "\f" in lines[filled[p + 1]]:
                edge = "feed"
            elif any(forms[j] == "page" for j in near):
                edge = "page"
            elif p == 0:
                edge = "first"
        share = shares.get(key, -1.0) if key else -1.0
        out.append((form, "none" if not key else str(min(n, 3)), edge, "unknown" if share < 0 else "often" if share > 0.6 else "seldom" if share < 0.3 else "some"))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[dict, dict, dict]:
    """Log-tables of the start, the steps and the features of each state, counted on the labelled set with smoothing."""
    start, steps, seen = Counter(), Counter(), defaultdict(Counter)
    for doc in LABELLED.split("\n====\n"):
        rows = [(r[0], r[2:].replace("^", "\f")) if r else ("K", "") for r in doc.split("\n")]
        feats = _features([t for _, t in rows], {})
        states = [s for s, _ in rows]
        start[states[0]] += 1
        steps.update(zip(states, states[1:]))
        for s, f in zip(states, feats):
            for k, v in enumerate(f[:3]):
                seen[s, k][v] += 1
    log = lambda c, key, total, kinds, a=0.3: math.log((c[key] + a) / (total + a * kinds))
    begin = {s: log(start, s, sum(start.values()), len(STATES)) for s in STATES}
    move = {(a, b): log(steps, (a, b), sum(steps[a, x] for x in STATES), len(STATES)) for a in STATES for b in STATES}
    kinds = (("blank", "page", "item", "stamp", "numbered", "shout", "title", "short", "sentence", "text"), ("none", "1", "2", "3"), ("inner", "feed", "page", "first"))
    emit = {(s, k, v): log(seen[s, k], v, sum(seen[s, k].values()), len(vs), 0.15) for s in STATES for k, vs in enumerate(kinds) for v in vs}
    # Where equal lines stand elsewhere can't be counted on a few texts; these odds are set.
    for s in STATES:
        for v, odds in (("often", 0.8), ("some", 0.45), ("seldom", 0.06), ("unknown", 0.5)):
            emit[s, 3, v] = math.log(odds if s in "HP" else 1 - odds)
    return begin, move, emit


# The states a form can have at all.
_POSSIBLE = {"blank": "K", "page": "PB", "item": "T", "stamp": "H", "numbered": "T", "shout": "T", "title": "HTB", "short": "HTB", "sentence": "BT", "text": "B"}


@lru_cache(maxsize=10_000)
def _emitted(features: tuple[str, str, str, str]) -> dict[str, float]:
    """Log-odds of a line's features in each state that its form can have."""
    emit = model()[2]
    return {s: sum(emit[s, k, v] for k, v in enumerate(features)) for s in _POSSIBLE[features[0]]}


def label_lines(lines: list[str], shares: dict[str, float]) -> str:
    """The most likely state of each line."""
    if not lines:
        return ""
    begin, move, _ = model()
    score: dict[str, float] = {}
    back: list[dict[str, str]] = []
    for n, f in enumerate(_features(lines, shares)):
        now = _emitted(f)
        if n == 0:
            score = {s: begin[s] + e for s, e in now.items()}
            continue
        best = {s: max(score, key=lambda a: score[a] + move[a, s]) for s in now} if len(score) > 1 else dict.fromkeys(now, next(iter(score)))  # noqa: B023
        back.append(best)
        score = {s: score[best[s]] + move[best[s], s] + e for s, e in now.items()}
    state = max(score, key=score.get)
    out = [state]
    for best in reversed(back):
        state = best[state]
        out.append(state)
    return "".join(reversed(out))


# What scanning makes of letters: read, meant. Fixed values.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("1", "t"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("9", "q"), ("2", "z"), ("€", "e"), ("†", "t"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "ll"), ("li", "h"), ("ri", "n"),
    ("l", "i"), ("i", "l"), ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("m", "rn"), ("n", "ri"), ("n", "rt"), ("d", "cl"), ("w", "vv"), ("o", "a"), ("u", "ii"), ("u", "n"), ("n", "u"), ("f", "t"), ("t", "f"), ("l", "t"), ("t", "l"), ("o", "0"), ("tn", "m"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("fi", "h"), ("§", "s"), ("$", "s"), ("@", "a"), ("¢", "c"), ("(", "c"), ("[", "l"), ("ı", "i"),
]
_DIGITS = str.maketrans({"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "g": "9", "q": "9", "G": "6", "T": "7"})
_LETTERS = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "€": "e", "†": "t", "|": "l"})
_ODD = re.compile(r"[^\W\d_][0-9€†|!§$@¢][^\W\d_]|^[0-9€†|!§$@¢][^\W\d_]{2,}|[€†|§$@¢ﬁﬂ]")


def _near(words: list[str]) -> list[str]:
    """What the words may stand for if one group of their letters is misread."""
    out: dict[str, None] = {}
    for w in words:
        for read, meant in CONFUSIONS:
            i = w.find(read)
            while i >= 0:
                out[w[:i] + meant + w[i + len(read) :]] = None
                i = w.find(read, i + 1)
    return list(out)


def _plain(word: str) -> bool:
    """Is it a word without marks that no word has, and without figures among its letters?"""
    return len(word) > 1 and not _ODD.search(word) and not any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


class Reader:
    """Words of the corpus, to tell what a misread word stands for."""

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.longest = max(map(len, words), default=0)
        self.memo: dict[str, str | None] = {}
        self.looked: dict[str, tuple[str | None, bool] | None] = {}

    def look(self, raw: str) -> tuple[str | None, bool] | None:
        """None for a word that reads well, else (what it means, is it unsure)."""
        if raw not in self.looked:
            if len(self.looked) > 200_000:
                self.looked.clear()
            meant, unsure = self.meant(raw), self.unsure(raw)
            self.looked[raw] = (meant, unsure) if unsure or meant is not None and meant != raw.lower() else None
        return self.looked[raw]

    def meant(self, raw: str) -> str | None:
        """The word or number as it should read in lower case, or None if it reads well or isn't known."""
        if raw not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[raw] = self._meant(raw)
        return self.memo[raw]

    def unsure(self, raw: str) -> bool:
        """Do the words neither hold the word nor tell what it stands for, be it that it was put right by the fixed letters alone?"""
        word, meant = raw.lower(), self.meant(raw)
        if word in self.words or len(word) < 2 or not any(c.isalpha() for c in word) or meant in self.words:
            return False
        if any(c.isdigit() for c in word) and (not _ODD.search(word) or sum(c.isdigit() for c in word) > 2 or re.fullmatch(r"[^\W\d_]{3,}[0-9OlI]+", raw)):
            return False
        return meant is None or meant == word.translate(_LETTERS)

    def reads_well(self, word: str) -> bool:
        """Can the word stand for another, itself none that the words explain?"""
        return _plain(word) and self.meant(word) in (None, word)

    def repeated(self, word: str, own: Counter[str]) -> str | None:
        """The word that its text has more than once, and oftener, of which this one without a telling character may be a misreading."""
        if _ODD.search(word) or len(word) < 4:
            return None
        near = [v for v in _near([word]) if own.get(v, 0) > max(1, own.get(word, 0)) and self.reads_well(v)]
        return max(near, key=lambda v: (own[v], v), default=None)

    def _meant(self, raw: str) -> str | None:
        word = raw.lower()
        if word in self.words or len(word) < 2 and word not in "lio|":
            return None
        if any(c.isdigit() for c in raw):
            digits = raw.translate(_DIGITS)
            if digits != raw and re.fullmatch(r"[0-9]+(?:[.,/][0-9]+)*", digits) and re.fullmatch(r"[0-9OolISBZ|.,/]+", raw):
                return digits.lower()
            if m := re.fullmatch(r"([^\W\d_]{4,})(-)([0-9OolISBZ]{1,3})", raw):  # a code: name, hyphen, number
                digits = m[3].translate(_DIGITS)
                return f"{m[1]}-{digits}".lower() if digits != m[3] and any(c.isdigit() for c in m[3]) else None
        if word == "l" or word == "|":
            return None
        best: tuple[float, str] | None = None
        # Two confusions shorten a word by two letters at most: what is longer stands for no known word.
        seen, layer = {word}, [word] if len(word) <= self.longest + 2 else []
        for _ in range(2):
            nxt = []
            for w in layer:
                for read, meant in CONFUSIONS:
                    i = w.find(read)
                    while i >= 0:
                        v = w[:i] + meant + w[i + len(read) :]
                        if v not in seen:
                            seen.add(v)
                            nxt.append(v)
                            share = self.words.get(v)
                            if share and (best is None or share > best[0]):
                                best = (share, v)
                        i = w.find(read, i + 1)
            if best:
                break
            if not _ODD.search(word):
                break
            layer = nxt
        if best:
            return best[1]
        if "-" in word:  # a compound: part by part
            parts = [self.meant(p) or p for p in raw.split("-")]
            if any(p.lower() != q for p, q in zip(raw.split("-"), parts)):
                return "-".join(p.lower() for p in parts)
        if _ODD.search(raw) and sum(c.isdigit() for c in raw) <= 2 and not re.fullmatch(r"[^\W\d_]{3,}[0-9OlI]+", raw):
            letters = word.translate(_LETTERS)
            if letters.replace("-", "").isalpha() and len(letters) > 3:
                return letters
        return None


def _words(line: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in line.split()) if w]


Ask = tuple[int, str, str, str | None]  # line number, kind of flaw, the word asked for, what it is taken for without an answer


def flaws(
    text: str, words: dict[str, float], shares: dict[str, float], reader: Reader | None = None, rare: dict[str, str] | None = None, asked: list[Ask] | None = None
) -> tuple[list[tuple[int, str, str]], list[str]]:
    """(line number, kind, how it should read) of every flaw, and the repaired paragraphs.

    ``rare`` tells what words stand for that ``words`` leaves open. With ``asked`` the flaws at
    such words aren't told but taken up there: the words as they stand in lower case, a broken
    one as a line feed, its first part, a line feed and the rest.
    """
    reader = reader or Reader(words)
    rare = rare or {}
    own: Counter[str] | None = None

    def read(core: str, n: int) -> tuple[str | None, bool]:
        """(what the word means, is the flaw told now)"""
        nonlocal own
        told = reader.look(core)
        if told is None or not told[1]:
            return told and told[0], True
        word = core.lower()
        if own is None:
            own = Counter(w.lower() for w in _words(text))
        otherwise = reader.repeated(word, own) or told[0]
        if asked is not None:
            asked.append((n, "misread", word, otherwise))
        return rare.get(word) or otherwise, asked is None

    lines = text.split("\n")
    labels = label_lines(lines, shares)
    found: list[tuple[int, str, str]] = []
    paragraphs: list[str] = []
    open_text: list[str] = []
    carried: tuple[int, str] | None = None  # a broken word: where it starts, its first part

    def close() -> None:
        if open_text:
            paragraphs.append(" ".join(open_text))
            open_text.clear()

    for n, (line, label) in enumerate(zip(lines, labels), 1):
        if label in "HP":
            found.append((n, "running_header" if label == "H" else "page_number", ""))
            continue
        if label == "K":
            if carried is None:
                close()
            continue
        tokens = line.replace("\f", " ").split()
        if carried is not None and tokens:
            start, first = carried
            carried = None
            body = tokens[0].rstrip(_EDGE)
            whole, ask = _joined(first, body, reader, rare)
            if ask and asked is not None:
                asked.append((start, "hyphen_break", ask, whole))
            else:
                found.append((start, "hyphen_break", whole))
            lead = open_text.pop() if open_text else ""
            open_text.append(_as_written(lead, first, whole, tokens[0][len(body) :]))
            tokens = tokens[1:]
        elif label == "T":
            close()
        mark = broken_by(tokens[-1]) if tokens else None
        broken = mark is not None and n < len(lines) and _continues(lines, labels, n)
        for k, token in enumerate(tokens):
            core = token.strip(_EDGE)
            if broken and k == len(tokens) - 1:
                carried = (n, token[: token.rfind(mark)].lstrip(_EDGE))
                open_text.append(token)
                continue
            meant, told = read(core, n) if core else (None, True)
            if meant is not None and meant != core.lower():
                if told:
                    found.append((n, "misread", meant))
                token = token.replace(core, meant.capitalize() if core[:1].isupper() else meant)
            open_text.append(token)
        if label == "T" and not broken:
            close()
    close()
    return found, paragraphs


def _continues(lines: list[str], labels: str, n: int) -> bool:
    """Does a text line, in small letters or a number, follow line n, headers and breaks left out?"""
    for line, label in zip(lines[n:], labels[n:]):
        if label in "HPK":
            continue
        text = line.strip("\f ")
        return label in "BT" and bool(text) and (text[0].islower() or not text[0].isalpha() and not text.startswith(("- ", "• ")))
    return False


def _joined(first: str, rest: str, reader: Reader, rare: dict[str, str]) -> tuple[str, str | None]:
    """(a broken word whole, what to ask for it): without the hyphen if the corpus knows it so, with it if it knows only that."""
    plain, hyphen = (first + rest).lower(), f"{first}-{rest}".lower()
    if plain in reader.words:
        return plain, None
    if hyphen in reader.words or rest[:1].isdigit():
        return hyphen, None
    a, b = reader.meant(first + rest), reader.meant(f"{first}-{rest}")
    if a and a in reader.words:
        return a, None
    if b and b in reader.words:
        return b, None
    ask = f"\n{first}\n{rest}".lower()
    return rare.get(ask) or a or plain, ask


def _as_written(lead: str, first: str, whole: str, tail: str) -> str:
    opening = lead[: len(lead) - len(lead.lstrip(_EDGE))]
    return f"{opening}{whole.capitalize() if first[:1].isupper() else whole}{tail}"


def _rests(lines: list[str]) -> Iterator[list[str]]:
    """The words of each line without the parts of broken words."""
    broken = False
    for line in lines:
        tokens = line.split()
        if broken and tokens and not tokens[0][0].isupper():
            tokens, broken = tokens[1:], False
        if mark := broken_by(line):
            broken, tokens = bool(mark), tokens[:-1]
        yield tokens


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: in how many texts each word and short line stands, and the word not as a part of a broken one; how often the line stands, and how often at a page's edge."""
    for batch in batches:
        docs, total, edges, whole = Counter(), Counter(), Counter(), Counter()
        for text in batch["text"]:
            if not isinstance(text, str):
                continue
            lines = text.split("\n")
            seen = {("w", w.lower()) for line in lines for t in (line.split()[:-1] if broken_by(line) else line.split()) if (w := t.strip(_EDGE))}
            for line, f in zip(lines, _features(lines, {}, near_equal=False)):
                if f[1] != "none":
                    key = ("l", line_key(line))
                    seen.add(key)
                    total[key] += 1
                    edges[key] += f[2] != "inner"
            docs.update(seen)
            whole.update({w.lower() for tokens in _rests(lines) for t in tokens if (w := t.strip(_EDGE))})
        yield pd.DataFrame([(k, v, n, total[k, v], edges[k, v], whole[v] if k == "w" else 0) for (k, v), n in docs.items()], columns=["kind", "value", "docs", "total", "edges", "whole"])


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, value, docs, total, edges, whole) of every word and short line, written once."""
    counted = texts.select("text").mapInPandas(_counts, "kind string, value string, docs bigint, total bigint, edges bigint, whole bigint").groupBy("kind", "value")
    return cut(counted.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), F.sum("edges").alias("edges"), F.sum("whole").alias("whole")))


def corpus_facts(texts: DataFrame, counted: DataFrame | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """(word to its share of the texts, short line to the share of its occurrences at a page's edge), entries with the least shares."""
    n = texts.where("text is not null").count()
    counted = corpus_counts(texts) if counted is None else counted
    least = F.when(F.col("kind") == "w", LEAST_WORD_SHARE * n).otherwise(LEAST_LINE_SHARE * n)
    kept = counted.where((F.col("docs") >= 3) & (F.col("docs") >= least)).collect()
    return {r["value"]: r["docs"] / max(1, n) for r in kept if r["kind"] == "w"}, {r["value"]: r["edges"] / max(1, r["total"]) for r in kept if r["kind"] == "l"}


def clean_lexicon(words: dict[str, float]) -> dict[str, float]:
    """The words without frequent misreadings: what a far more frequent word explains, or what holds marks no word has."""
    clean = {w: s for w, s in words.items() if not _ODD.search(w) and not (any(c.isdigit() for c in w) and any(c.isalpha() for c in w))}
    out = dict(clean)
    for w, s in clean.items():
        for read, meant in CONFUSIONS:
            if read in w and clean.get(w.replace(read, meant, 1), 0.0) > 25 * s:
                out.pop(w, None)
    return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(ask, word, telling, value, layer) of all an asked word may be: itself whole (0), one or, with a telling character, two groups of letters away."""
    for batch in batches:
        out = []
        for ask in batch["ask"]:
            broken = ask.startswith("\n")
            first, _, rest = ask[1:].partition("\n") if broken else (ask, "", "")
            word = first + rest
            telling = bool(_ODD.search(word))
            layers = [[word, f"{first}-{rest}"] if broken else [], near := _near([word]), _near(near) if telling else []]
            seen = set() if broken else {word}
            for n, layer in enumerate(layers):
                out += [(ask, word, telling, v, n) for v in layer if v not in seen and (n == 0 or _plain(v))]
                seen.update(layer)
        yield pd.DataFrame(out, columns=["ask", "word", "telling", "value", "layer"])


def rare_meanings(asks: DataFrame, counted: DataFrame, words: dict[str, float]) -> DataFrame:
    """(ask, meant) of asked words, by the counts of all words.

    A broken word is what stands whole elsewhere; a word with a telling character is the nearest
    word that stands anywhere; any other the nearest that FAR_MORE times as many texts hold.
    """
    docs = counted.where("kind = 'w' and whole > 0").select("value", F.col("whole").alias("docs"))
    found = asks.select("ask").distinct().mapInPandas(_candidates, "ask string, word string, telling boolean, value string, layer int").join(docs, "value")
    held = found.join(docs.select(F.col("value").alias("word"), F.col("docs").alias("held")), "word", "left").where(
        F.col("telling") | (F.col("layer") == 0) | (F.col("docs") > FAR_MORE * F.greatest(F.coalesce("held", F.lit(0)), F.lit(1)))
    )

    def well(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(words)
        for values in batches:
            yield pd.Series([reader.reads_well(v) for v in values], dtype=bool)

    sound = held.where((F.col("layer") == 0) | F.pandas_udf(well, "boolean")("value"))
    return sound.groupBy("ask").agg(F.min_by("value", F.struct("layer", -F.col("docs"), "value")).alias("meant"))


_FLAWS = "array<struct<line_no:bigint,kind:string,fixed:string>>"
_ASKS = "array<struct<line_no:bigint,kind:string,ask:string,otherwise:string>>"


def _rows_of(pdfs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, dict[str, float], dict[str, float]]:
    """(key, text) of the texts, the counts of all words and lines, and what of them is broadcast."""
    rows = pdfs.select(F.col(key), F.col(text).alias("text"))
    counted = corpus_counts(rows)
    words, shares = corpus_facts(rows, counted)
    return rows.where(F.col(key).isNotNull()), counted, clean_lexicon(words), shares


def _first_reading(words: dict[str, float], shares: dict[str, float]):
    """A UDF that gives the sure flaws of each text and what is to be asked for."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(words)
        for texts in batches:
            flawed, asks = [], []
            for t in texts:
                asked: list[Ask] = []
                told = flaws(t, words, shares, reader, asked=asked)[0] if isinstance(t, str) else []
                flawed.append([{"line_no": a, "kind": b, "fixed": c} for a, b, c in told])
                asks.append([{"line_no": a, "kind": b, "ask": c, "otherwise": d} for a, b, c, d in asked])
            yield pd.DataFrame({"flaws": flawed, "asks": asks})

    # Said to be nondeterministic, so that no part of the struct makes it run again.
    return F.pandas_udf(run, f"struct<flaws:{_FLAWS},asks:{_ASKS}>").asNondeterministic()


def repaired(pdfs: DataFrame, key: str = "pdf_id", text: str = "raw_text") -> DataFrame:
    """(key, flaws, paragraphs): the flaws of each text and its repaired paragraphs, in order.

    Null and blank texts have neither. A text that repeats under its key comes out once. Texts
    are read with the broadcast words; what these leave open is joined with the counts of all
    words, and every text is read again with the answers.
    """
    rows, counted, words, shares = _rows_of(pdfs, key, text)
    rows = rows.dropDuplicates([key, "text"]).withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = _first_reading(words, shares)
    asks = cut(rows.select("_h", F.explode(first("text")["asks"]["ask"]).alias("ask")).distinct())
    told = asks.join(rare_meanings(asks, counted, words), "ask").groupBy("_h").agg(F.collect_list(F.struct("ask", "meant")).alias("_rare"))  # those of one text

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = Reader(words)
        for texts, known in batches:
            got = [flaws(t, words, shares, reader, {x["ask"]: x["meant"] for x in rare}) if isinstance(t, str) else ([], []) for t, rare in zip(texts, known)]
            yield pd.DataFrame({"flaws": [[{"line_no": a, "kind": b, "fixed": c} for a, b, c in f] for f, _ in got], "paragraphs": [p for _, p in got]})

    again = F.pandas_udf(run, f"struct<flaws:{_FLAWS},paragraphs:array<string>>").asNondeterministic()
    nothing = F.array().cast("array<struct<ask:string,meant:string>>")
    return rows.join(told, "_h", "left").select(key, again("text", F.coalesce("_rare", nothing)).alias("r")).select(key, "r.flaws", "r.paragraphs").distinct()


def found_flaws(pdfs: DataFrame) -> DataFrame:
    """(pdf_id, line_no, kind, fixed) of every flaw.

    Each text is read once. What the broadcast words leave open at a place is joined with what
    the counts of all words tell of it.
    """
    rows, counted, words, shares = _rows_of(pdfs, "pdf_id", "raw_text")
    once = cut(rows.select("pdf_id", _first_reading(words, shares)("text").alias("r")).select("pdf_id", "r.*"))
    sure = once.select("pdf_id", F.inline("flaws"))
    open_ = once.select("pdf_id", F.inline("asks"))
    answers = rare_meanings(open_, counted, words).withColumnsRenamed({"ask": "_ask"})
    fixed = open_.join(answers, F.col("ask") == F.col("_ask"), "left").withColumn("fixed", F.coalesce("meant", "otherwise"))
    settled = fixed.where(F.col("fixed").isNotNull() & (F.col("fixed") != F.col("ask"))).select("pdf_id", "line_no", "kind", "fixed")
    return sure.union(settled).distinct()

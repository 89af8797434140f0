"""Units as exponent vectors, and a grammar for written quantities.

A unit is a scale, an offset and a vector of exponents over the base dimensions
(length, mass, time, temperature). Products, quotients and powers of units combine the
vectors, so ``N*m`` or ``kg/m^2`` come out of the same table as ``cm``. A quantity is
accepted for a field when its vector equals the vector of the field's canonical unit.

The module is plain Python: it runs inside Arrow-batched UDFs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

Vector = tuple[int, int, int, int]

LENGTH: Vector = (1, 0, 0, 0)
MASS: Vector = (0, 1, 0, 0)
TIME: Vector = (0, 0, 1, 0)
TEMPERATURE: Vector = (0, 0, 0, 1)
VOLUME: Vector = (3, 0, 0, 0)
POWER: Vector = (2, 1, -3, 0)


@dataclass(frozen=True)
class Unit:
    """``base = number * scale + offset`` in metres, kilograms, seconds and kelvin."""

    scale: float
    dims: Vector
    offset: float = 0.0

    def times(self, other: "Unit", power: int = 1) -> "Unit":
        return Unit(self.scale * other.scale**power, tuple(a + power * b for a, b in zip(self.dims, other.dims)))


# One line for each unit: its spellings, then scale, dimension, offset. A spelling may
# stand for several units (oz); the dimension asked for then decides.
_TABLE: list[tuple[str, float, Vector, float]] = [
    ("mm|millimeter|millimetre|millimeters|millimetres", 1e-3, LENGTH, 0),
    ("cm|cms|centimeter|centimetre|centimeters|centimetres", 1e-2, LENGTH, 0),
    ("dm|decimeter|decimetre|decimeters|decimetres", 1e-1, LENGTH, 0),
    ("m|mtr|mtrs|meter|metre|meters|metres", 1.0, LENGTH, 0),
    ("km|kilometer|kilometre|kilometers|kilometres", 1e3, LENGTH, 0),
    ("in|ins|inch|inches|\"|″|”|''", 0.0254, LENGTH, 0),
    ("ft|foot|feet|'|′|’", 0.3048, LENGTH, 0),
    ("yd|yds|yard|yards", 0.9144, LENGTH, 0),
    ("mi|mile|miles", 1609.344, LENGTH, 0),
    ("mg|milligram|milligrams", 1e-6, MASS, 0),
    ("g|gr|gm|gms|gram|grams|gramme|grammes", 1e-3, MASS, 0),
    ("kg|kgs|kilo|kilos|kilogram|kilograms|kilogramme|kilogrammes", 1.0, MASS, 0),
    ("t|tonne|tonnes", 1e3, MASS, 0),
    ("lb|lbs|pound|pounds|#", 0.45359237, MASS, 0),
    ("oz|ozs|ounce|ounces", 0.028349523125, MASS, 0),
    ("st|stone|stones", 6.35029318, MASS, 0),
    ("ml|mls|millilitre|milliliter|millilitres|milliliters|cc|ccm", 1e-6, VOLUME, 0),
    ("cl|centilitre|centiliter|centilitres|centiliters", 1e-5, VOLUME, 0),
    ("dl|decilitre|deciliter|decilitres|deciliters", 1e-4, VOLUME, 0),
    ("l|lt|ltr|ltrs|litre|liter|litres|liters", 1e-3, VOLUME, 0),
    ("gal|gals|gallon|gallons|us gal|us gallon|us gallons", 3.785411784e-3, VOLUME, 0),
    ("qt|qts|quart|quarts|us qt", 0.946352946e-3, VOLUME, 0),
    ("pt|pts|pint|pints|us pt", 0.473176473e-3, VOLUME, 0),
    ("fl oz|fl ozs|floz|fluid ounce|fluid ounces|us fl oz|oz|ozs|ounce|ounces", 29.5735295625e-6, VOLUME, 0),
    ("ms|msec|millisecond|milliseconds", 1e-3, TIME, 0),
    ("s|sec|secs|second|seconds", 1.0, TIME, 0),
    ("min|mins|minute|minutes|m", 60.0, TIME, 0),
    ("h|hr|hrs|hour|hours", 3600.0, TIME, 0),
    ("d|day|days", 86400.0, TIME, 0),
    ("mw|milliwatt|milliwatts", 1e-3, POWER, 0),
    ("w|watt|watts", 1.0, POWER, 0),
    ("kw|kilowatt|kilowatts", 1e3, POWER, 0),
    ("hp|horsepower", 745.69987158227, POWER, 0),
    ("k|kelvin|kelvins", 1.0, TEMPERATURE, 0),
    ("c|deg c|degree c|degrees c|°c|° c|℃|celsius|deg celsius|degree celsius|degrees celsius|centigrade", 1.0, TEMPERATURE, 273.15),
    ("f|deg f|degree f|degrees f|°f|° f|℉|fahrenheit|deg fahrenheit|degree fahrenheit|degrees fahrenheit", 5 / 9, TEMPERATURE, 459.67 * 5 / 9),
    ("n|newton|newtons", 1.0, (1, 1, -2, 0), 0),
    ("pa|pascal|pascals", 1.0, (-1, 1, -2, 0), 0),
    ("kpa", 1e3, (-1, 1, -2, 0), 0),
    ("bar|bars", 1e5, (-1, 1, -2, 0), 0),
    ("psi", 6894.757293168, (-1, 1, -2, 0), 0),
    ("j|joule|joules", 1.0, (2, 1, -2, 0), 0),
    ("hz|hertz", 1.0, (0, 0, -1, 0), 0),
]

UNITS: dict[str, list[Unit]] = {}
for _names, _scale, _dims, _offset in _TABLE:
    for _name in _names.split("|"):
        UNITS.setdefault(_name, []).append(Unit(_scale, _dims, _offset))

# Canonical unit of each field: what one unit of the result is in base units.
FIELDS: dict[str, Unit] = {
    **{f: Unit(1e-3, LENGTH) for f in ("seat_width", "overall_width", "overall_height", "cable_length", "dimensions", "size")},
    **{f: Unit(1e-3, MASS) for f in ("product_weight", "weight_capacity")},
    "tank_volume": Unit(1e-6, VOLUME),
    "battery_runtime": Unit(60.0, TIME),
    "motor_power": Unit(1.0, POWER),
    "max_storage_temp": Unit(1.0, TEMPERATURE, 273.15),
}
MULTI_FIELDS = frozenset({"dimensions", "size"})


@dataclass(frozen=True, eq=False)
class FieldSet:
    """The fields whose quantities are read: the canonical unit of each, and those that hold several measures."""

    units: Mapping[str, Unit]
    multi: frozenset[str] = frozenset()


PRODUCT_FIELDS = FieldSet(FIELDS, MULTI_FIELDS)

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_NUMBER_WORDS = {w: i for i, w in enumerate(_ONES)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}
_VULGAR = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}

_TOKEN = re.compile(
    r"(?P<num>\d+(?:[.,]\d+)*)|(?P<vulgar>[¼½¾⅓⅔⅛⅜⅝⅞])|(?P<word>[^\W\d_]+\.?)|(?P<sym>''|[\"″”'′’#°℃℉])|(?P<op>[×*/^·+\-–—−~(){}\[\],;:.|=])|(?P<space>\s+)|(?P<other>.)",
    re.S,
)


@lru_cache(maxsize=50_000)
def parse_number(text: str) -> float | None:
    """A written number: ``1,109`` is a thousand, ``1,14`` and ``1.14`` are decimals.

    A comma or dot is a thousands mark when both kinds occur and it comes first, when it
    occurs several times, or when it is a single comma before exactly three digits whose
    whole part doesn't start with 0.
    """
    commas, dots = text.count(","), text.count(".")
    if commas and dots:
        decimal = "," if text.rfind(",") > text.rfind(".") else "."
        text = text.replace("." if decimal == "," else ",", "").replace(decimal, ".")
    elif commas > 1 or dots > 1:
        text = text.replace(",", "").replace(".", "")
    elif commas:
        whole, _, rest = text.partition(",")
        text = whole + rest if len(rest) == 3 and len(whole) <= 3 and whole[0] != "0" else f"{whole}.{rest}"
    try:
        return float(text)
    except ValueError:
        return None


def resolve(name: str, dims: Vector | None) -> Unit | None:
    """The unit of a spelling; dims chooses between several and rejects others."""
    for unit in UNITS.get(name, ()):
        if dims is None or unit.dims == dims:
            return unit
    return None


def parse_unit(text: str, dims: Vector | None = None) -> Unit | None:
    """A unit expression such as ``cm``, ``fl. oz.``, ``kg/m^2`` or ``N*m``; None if it isn't one.

    With dims, an expression of another dimension gives None.
    """
    text = " ".join(text.replace(".", " ").split()).lower()
    if not text:
        return None
    if unit := resolve(text, dims):
        return unit
    parts = re.split(r"\s*([*·/])\s*", text)
    if len(parts) == 1 and not re.search(r"[\^²³\d]", text):
        return None
    total = Unit(1.0, (0, 0, 0, 0))
    for i in range(0, len(parts), 2):
        m = re.fullmatch(r"(.+?)\s*(?:\^?(-?\d)|([²³]))?", parts[i])
        unit = m and resolve(m[1].strip(), None)
        if not unit or unit.offset:
            return None
        power = int(m[2]) if m[2] else {"²": 2, "³": 3}.get(m[3], 1)
        total = total.times(unit, -power if i and parts[i - 1] == "/" else power)
    return total if dims is None or total.dims == dims else None


_POWERS = {"²": 2, "³": 3}
_RAISED = {"square": 2, "sq": 2, "cubic": 3, "cu": 3}
Raw = list[tuple[str, str]]


def _factor(raw: Raw, i: int) -> tuple[list[Unit], int, int, bool]:
    """(units that the longest run of up to three words from i on spells, power, end, is the power written out)."""
    while i < len(raw) and raw[i][0] == "space":
        i += 1
    power, stated = 1, False
    if i < len(raw) and raw[i][1].lower().rstrip(".") in _RAISED:
        power, stated = _RAISED[raw[i][1].lower().rstrip(".")], True
        i += 1
    best: list[Unit] = []
    end, name, j = i, "", i
    for _ in range(3):
        while j < len(raw) and (raw[j][0] == "space" or name and raw[j][1] == "."):
            j += 1
        if j >= len(raw) or raw[j][0] not in ("word", "sym"):
            break
        name = f"{name} {raw[j][1].lower().rstrip('.')}".strip()
        j += 1
        if name[-1] in _POWERS and (found := UNITS.get(name[:-1])):
            return found, _POWERS[name[-1]], j, True
        if found := UNITS.get(name) or UNITS.get(name.replace("° ", "°")):
            best, end = found, j
    if best and end < len(raw):
        if raw[end][1] == "^":
            k = end + 1
            sign = -1 if k < len(raw) and raw[k][1] in "-−" else 1
            k += sign < 0
            if k < len(raw) and raw[k][1].isdigit() and len(raw[k][1]) == 1:
                return best, sign * int(raw[k][1]), k + 1, True
        elif not stated and raw[end][1] in ("2", "3") and raw[end][0] == "num" and raw[end - 1][0] == "word":
            return best, int(raw[end][1]), end + 1, False
    return best, power, end, stated


def unit_expression(raw: Raw, i: int, dims: Vector) -> tuple[Unit | None, int, bool]:
    """(the unit of dimension dims that tokens from i on state, its end, is it an expression of units at all).

    An expression is factors with powers, joined by ``*``, ``·``, ``/`` or ``per``; a spelling
    that several units share (m, oz) is read so that the exponent vectors add up to dims. One
    of another dimension, as ``kg/m^2`` for a mass, is an expression without such a unit.
    """
    units, power, end, stated = _factor(raw, i)
    if not units:
        return None, i, False
    simple_end = end if stated or power == 1 else end - 1  # before an implied power, as in m3
    factors, composed = [(units, power)], stated
    while True:
        j = end
        while j < len(raw) and raw[j][0] == "space":
            j += 1
        if j >= len(raw) or not (raw[j][1] in ("/", "·", "*") or raw[j][1].lower() == "per"):
            break
        more, p, after, _ = _factor(raw, j + 1)
        if not more:
            break
        factors.append((more, -p if raw[j][1] == "/" or raw[j][1].lower() == "per" else p))
        end, composed = after, True
    if composed or power != 1:
        for choice in product(*(u for u, _ in factors)):
            if len(factors) > 1 and any(u.offset for u in choice):
                continue
            total = Unit(1.0, (0, 0, 0, 0))
            for unit, (_, p) in zip(choice, factors):
                total = total.times(unit, p)
            if total.dims == dims:
                return total, end, True
        if composed:
            return None, end, True
    unit = next((u for u in units if u.dims == dims), None)
    return unit, simple_end, unit is not None


@dataclass
class _Tok:
    kind: str
    text: str
    value: float = 0.0
    unit: Unit | None = None


_SEPARATORS = {"x", "×", "*", "by"}
_AXES = {"w", "d", "h", "l", "wide", "deep", "high", "long", "tall", "width", "depth", "height", "length", "diameter", "dia"}


def _lex(text: str, dims: Vector, multi: bool) -> list[_Tok]:
    """Numbers with their fractions joined, units of the wanted dimension, separators, the rest."""
    raw = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]
    # A letter x glued to words or numbers ("cmx85", "inchesx9", "Wx40") separates measures.
    if multi:
        split: list[tuple[str, str]] = []
        for kind, tok in raw:
            if kind == "word" and len(tok) > 1:
                low = tok.lower()
                if low[-1] == "x" and (resolve(low[:-1].rstrip("."), dims) or low[:-1] in _AXES):
                    split += [(kind, tok[:-1]), (kind, "x")]
                    continue
                if low[0] == "x" and low[1:].rstrip(".") in _AXES:
                    split += [(kind, "x"), (kind, tok[1:])]
                    continue
            split.append((kind, tok))
        raw = split
    out: list[_Tok] = []
    i = 0
    while i < len(raw):
        kind, tok = raw[i]
        low = tok.lower()
        if kind == "num":
            value = parse_number(tok)
            if value is None:
                out.append(_Tok("other", tok))
                i += 1
                continue
            j = i + 1
            # mixed numbers: 9 3/4, 9-3/4, 9 ½, 9½, and a bare 3/4
            k = j
            if k < len(raw) and (raw[k][0] == "space" or raw[k][1] in "-–"):
                k += 1
            if k < len(raw) and raw[k][0] == "vulgar":
                value += _VULGAR[raw[k][1]]
                j = k + 1
            elif k > j and k + 2 < len(raw) and raw[k][0] == "num" and raw[k + 1][1] == "/" and raw[k + 2][0] == "num" and raw[k][1].isdigit() and raw[k + 2][1].isdigit() and 0 < int(raw[k][1]) < int(raw[k + 2][1]) <= 64:
                value += int(raw[k][1]) / int(raw[k + 2][1])
                j = k + 3
            elif j + 1 < len(raw) and raw[j][1] == "/" and raw[j + 1][0] == "num" and tok.isdigit() and raw[j + 1][1].isdigit() and 0 < int(tok) < int(raw[j + 1][1]) <= 64:
                value = int(tok) / int(raw[j + 1][1])
                j += 2
            if out and out[-1].text in "-−" and out[-1].kind == "op" and not any(t.kind in ("num", "unit") for t in out):
                out.pop()
                value = -value
            out.append(_Tok("num", tok, value))
            i = j
        elif kind == "vulgar":
            out.append(_Tok("num", tok, _VULGAR[tok]))
            i += 1
        elif kind == "word" and low in _NUMBER_WORDS:
            value, i = float(_NUMBER_WORDS[low]), i + 1
            if value >= 20 and i + 1 < len(raw) and (raw[i][1] == "-" or raw[i][0] == "space") and 0 < _NUMBER_WORDS.get(raw[i + 1][1].lower(), 0) < 10:
                value, i = value + _NUMBER_WORDS[raw[i + 1][1].lower()], i + 2
            if i + 2 < len(raw) and raw[i + 1][1].lower() == "hundred":
                value, i = value * 100, i + 2
            out.append(_Tok("num", tok, value))
        elif kind in ("word", "sym"):
            unit, end, known = unit_expression(raw, i, dims) if not (multi and low in _AXES and dims == LENGTH) else (None, i, False)
            if unit:
                out.append(_Tok("unit", tok, unit=unit))
                i = end
            elif known and out and out[-1].kind == "num":
                out.append(_Tok("foreign", tok))
                i = end
            else:
                out.append(_Tok("sep" if multi and low in _SEPARATORS else "axis" if low in _AXES else "word", low))
                i += 1
        else:
            if kind != "space":
                out.append(_Tok("sep" if multi and low in _SEPARATORS else "op", tok))
            i += 1
    return out


# Stands for a unit of another dimension than the field's.
_FOREIGN = Unit(0.0, (0, 0, 0, 0))


def _measure(toks: list[_Tok], i: int) -> tuple[list[tuple[float, Unit | None]], int]:
    """One measure from token i on: ``number unit`` with smaller parts of it (6 ft 4 in, 2h18), or ``unit: number``."""
    lead = None
    if toks[i].kind == "unit":
        lead = toks[i].unit
        i += 1
        while i < len(toks) and toks[i].kind == "op" and toks[i].text in ":.=":
            i += 1
        if i >= len(toks) or toks[i].kind != "num":
            return [], i
    parts: list[tuple[float, Unit | None]] = [(toks[i].value, lead)]
    i += 1
    if i < len(toks) and toks[i].kind == "foreign":
        return [(parts[0][0], _FOREIGN)], i + 1
    j = i + 1 if i < len(toks) and toks[i].text in ("-", "–") else i  # 9-inch
    if lead is None and j < len(toks) and toks[j].kind == "unit":
        parts[0] = (parts[0][0], toks[j].unit)
        i = j + 1
        while i < len(toks) and toks[i].kind == "num" or i + 1 < len(toks) and toks[i].text in (",", "and", "-") and toks[i + 1].kind == "num":
            n = i if toks[i].kind == "num" else i + 1
            last = parts[-1][1]
            if n + 1 < len(toks) and toks[n + 1].kind == "unit" and toks[n + 1].unit.scale < last.scale and not last.offset:
                parts.append((toks[n].value, toks[n + 1].unit))
                i = n + 2
            elif last.dims == TIME and last.scale == 3600.0 and n == i and toks[n].value < 60:  # 2h18
                parts.append((toks[n].value, Unit(60.0, TIME)))
                i = n + 1
            else:
                break
    return parts, i


_LENGTHS = r"(?:mms?|cms?|inch(?:es)?|feet|ft|yards?|millimet(?:er|re)s?|centimet(?:er|re)s?|met(?:er|re)s?)"
_MASSES = r"(?:lbs?|pounds?|ounces?|oz|kgs?|kilos?|kilograms?|grams?)"
# Where a description is cut: a statement of units holds no figures.
SENTENCE_END = r"[.!?\n\d]+"
# The part of a sentence that states the units of all figures of a record ("Dimensions in mm; weights in kg", "Figures
# below are inches / pounds"), from its first telling word on. A word that isn't of a quantity (figures, units) tells only
# with the unit linked to it, a length and a mass unit side by side tell alone. The lead is matched once, not tried anew
# from each of its characters.
DEFAULTS_PATTERN = (
    r"(?is)^(?>.*?(?=\b(?:"
    r"(?:dimensions?|sizes?|lengths?|measurements?|weights?|mass(?:es)?)\b"
    rf"|(?:figures?|values|numbers|units?|quantities|specs|specifications|all|everything|stated|given|listed|shown|expressed|quoted)\b.{{0,40}}?(?:\b(?:in|are|is|as)\b|[:=–-])\s*(?:(?:the|us|metric|imperial)\b:?\s*)?(?:{_LENGTHS}|{_MASSES})\b"
    rf"|(?:{_LENGTHS}\s*(?:[/,;&+]|and\b)\s*{_MASSES}|{_MASSES}\s*(?:[/,;&+]|and\b)\s*{_LENGTHS})\b"
    rf")))(.*\b(?:{_LENGTHS}|{_MASSES})\b.*)"
)


@lru_cache(maxsize=10_000)
def stated_defaults(sentence: str) -> dict[Vector, Unit]:
    """The length and the mass unit that a sentence states for all figures."""
    found: dict[Vector, Unit] = {}
    for word in re.findall(r"[^\W\d_]+", sentence.lower()):
        if word in ("in", "m", "g", "t", "st"):  # prepositions and letters of running text
            continue
        for dims in (LENGTH, MASS):
            if unit := resolve(word, dims):
                found.setdefault(dims, unit)
    return found


def quantities(field: str, key_unit: str, text: str, defaults: str | None = None, fields: FieldSet = PRODUCT_FIELDS) -> list[tuple[int, int]]:
    """(idx, value) of every measure of a field's text whose unit is in the text, in the key or in the record's stated defaults.

    The value is in the field's canonical unit, rounded half up. A unit after the last of
    several measures counts for those before it that have none. A second statement of the
    same quantity, in brackets or after a stroke, is left out, and so is a number whose unit is
    of another dimension.
    """
    target = fields.units[field]
    multi = field in fields.multi
    toks = _lex(text, target.dims, multi)
    start = next((i for i, t in enumerate(toks) if t.kind == "num"), None)
    if start is None:
        return []
    # "lbs.: 396", "cc 900": a unit right before the number, with none after it
    k = start - 1
    while k >= 0 and toks[k].kind == "op" and toks[k].text in ":.=":
        k -= 1
    follows = start + 1 < len(toks) and (toks[start + 1].kind == "unit" or toks[start + 1].text == "-" and start + 2 < len(toks) and toks[start + 2].kind == "unit")
    if k >= 0 and toks[k].kind == "unit" and not follows:
        start = k
    measures: list[list[tuple[float, Unit | None]]] = []
    i = start
    while i < len(toks):
        parts, i = _measure(toks, i)
        if not parts:
            break
        measures.append(parts)
        if not multi:
            break
        while i < len(toks) and toks[i].kind == "axis":
            i += 1
        if i + 1 < len(toks) and toks[i].kind == "sep" and toks[i + 1].kind in ("num", "unit"):
            i += 1
        else:
            break
    fallback = parse_unit(key_unit, target.dims) if key_unit else None
    if fallback is None and defaults:
        fallback = stated_defaults(defaults).get(target.dims)
    out, later = [], None
    for idx in range(len(measures), 0, -1):
        parts = measures[idx - 1]
        if parts[0][1] is _FOREIGN:
            continue
        if parts[-1][1] is not None:
            later = parts[-1][1]
        if parts[0][1] is None:
            unit = later or fallback
            if unit is None:
                continue
            parts = [(parts[0][0], unit)]
        base = sum(n * u.scale + u.offset for n, u in parts)
        out.append((idx, math.floor((base - target.offset) / target.scale + 0.5 + 1e-9)))
    return out[::-1]


@lru_cache(maxsize=50_000)
def split_key(key: str, fields: FieldSet = PRODUCT_FIELDS) -> tuple[str, str]:
    """(spec_field, unit) of a written key: ``Seat Width [cm]``, ``seat_width_cm`` and ``Seat Width, cm`` give (seat_width, cm)."""
    text = " ".join(key.split())
    unit = ""
    if m := re.fullmatch(r"(.*?)\s*[(\[{]\s*([^()\[\]{}]*?)\s*[)\]}]\s*", text):
        text, unit = m[1], m[2]
    elif "," in text:
        text, _, unit = (x.strip() for x in text.partition(","))
    name = re.sub(r"[\s_\-]+", "_", text.lower()).strip("_:")
    if not unit:
        words = name.split("_")
        for n in range(1, len(words)):  # the longest tail that is a unit of the field that remains
            head, tail = "_".join(words[:n]), " ".join(words[n:])
            if head in fields.units and parse_unit(tail, fields.units[head].dims):
                return head, tail
    return name, unit

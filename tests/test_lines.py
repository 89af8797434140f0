import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import lines as L


def lit(xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def test_english(value):
    assert value(L.english_by_ascii(F.lit("plain text")))
    assert not value(L.english_by_ascii(F.lit("  ")))
    assert not value(L.english_unmarked(F.lit("café au lait")))
    assert value(L.english_by_words(F.lit("a frame for the bed")))
    assert not value(L.english_by_words(F.lit("steel frame")))
    assert not value(L.english_by_words(F.lit(None).cast("string")))


def test_distinct_and_merge(value):
    assert value(L.distinct_in_order(lit(["A", "b", "a", "B", "c"]))) == ["A", "b", "c"]
    assert value(L.distinct_in_order(lit([]))) == []
    assert value(L.merged(F.lit("One\n\ntwo"), F.lit("TWO\n three "))) == "One\ntwo\nthree"
    assert value(L.merged(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""


def test_similar(value):
    assert value(L.without_similar(lit(["Heavy duty steel frame", "Steel frame, heavy duty", "Folds flat", "!!", "??"]))) == ["Heavy duty steel frame", "Folds flat", "!!", "??"]
    assert value(L.token_jaccard(F.lit(""), F.lit("?"))) == 0.0


@pytest.mark.parametrize("line, expected", [("It comes with a bag", "included"), ("Ideal for travel, included", "included"), ("Helps you sit", "benefit"), ("Steel frame", "feature"), ("", "feature")])
def test_class(value, line, expected):
    assert value(L.sentence_class(F.lit(line))) == expected


def test_navigation(value):
    assert value(L.navigation_line(F.lit("Lab results and lab consulting")))
    assert value(L.navigation_line(F.lit(" Order now ")))
    assert not value(L.navigation_line(F.lit("Weight distribution is even")))
    assert not value(L.navigation_line(F.lit("Use & operation: lab results, lab consulting")))
    assert value(L.without_navigation(F.lit("One\nlab results, order now\n\ntwo"))) == "One\ntwo"


def joined(lines):
    out = []
    for x in (s.strip() for s in lines):
        if not x:
            continue
        goes_on = out and (x.split()[0] in ("and", "as", "to", "for", "with", "in", "on") or x[0].islower() and out[-1][-1] not in ".!?")
        if goes_on:
            out[-1] += f" {x}"
        else:
            out.append(x)
    return out


def test_fragments(value):
    assert value(L.joined_fragments(lit(["Split-pan design with removable bed ends is easy", "to setup."]))) == ["Split-pan design with removable bed ends is easy to setup."]
    rng = random.Random(3)
    words = ["and more", "Steel.", "frame", "to use", "Folds", "", "with wheels.", "easy"]
    for _ in range(25):
        xs = [rng.choice(words) for _ in range(rng.randint(1, 8))]
        assert value(L.joined_fragments(lit(xs))) == joined(xs), xs


def compiled(lines):
    out = []
    for line in (s.strip() for s in lines):
        if not line:
            continue
        bare = line.lstrip("-–—").strip() if line[0] in "-–—" else line
        if not out or not out[-1]:
            out = [x for x in out if x] + [bare]
        elif line[0] in "-–—" or out[-1].strip()[-1] in ",;:" or out[-1].split()[-1].lower() in ("and", "or"):
            out[-1] += f" {bare}"
        else:
            out.append(bare)
    return [x.strip() for x in out if x.strip()]


def test_compiled(value):
    rng = random.Random(5)
    words = ["Seat,", "- pad", "back and", "Wheel", "–rim", "Bag or", "cup;", "Lid"]
    for _ in range(25):
        xs = [rng.choice(words) for _ in range(rng.randint(1, 8))]
        assert value(L.compiled_features(lit(xs))) == compiled(xs), xs


def test_features_and_section(value):
    given = ["Steel frame", "steel frame", "Do not bend", "Weight: 3 kg", "easy", "to clean", "x" * 151]
    assert value(L.clean_features(lit(given))) == ["Steel frame"]  # the line with a colon takes what is joined to it along
    assert value(L.clean_features(lit(["Steel frame", "Weight: 3 kg", "Easy", "to clean"]))) == ["Steel frame", "Easy to clean"]
    assert [value(L.feature_kept(F.lit(x))) for x in ("Folds flat", "Mobility", "a/b", "Lit électrique")] == [True, False, False, False]
    assert value(L.section(lit(["x", "FEATURES", "• a", "", "Features", "- b", "Specifications", "c"]), "features", "specifications")) == ["a", "b"]
    assert value(L.section(lit(["x", "y"]), "features", "specifications")) == []

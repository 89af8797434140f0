import random

import pytest

from millrace.functions.delimiters import resolve_rule
from millrace.functions.units import LENGTH, MASS, parse_number, parse_unit, quantities, split_key, stated_defaults
from millrace.operators.packed import product_items, split_packed
from millrace.operators.quantities import product_quantities


@pytest.mark.parametrize("text, n", [("1,109", 1109), ("1,14", 1.14), ("0,125", 0.125), ("1.5", 1.5), ("1,234,567", 1234567), ("1.234,5", 1234.5), ("1,234.5", 1234.5)])
def test_number(text, n):
    assert parse_number(text) == n


def test_units():
    assert parse_unit("fl. oz.").dims == (3, 0, 0, 0)
    assert parse_unit("oz", MASS).dims == MASS and parse_unit("oz", LENGTH) is None
    assert parse_unit("N*m").dims == (2, 1, -2, 0)
    assert parse_unit("kg/m^2").dims == (-2, 1, 0, 0)
    assert parse_unit("blue") is None and parse_unit("") is None
    assert split_key("Tank Volume [fl oz]") == ("tank_volume", "fl oz") == split_key("tank_volume_fl_oz")
    assert {u.scale for u in stated_defaults("All sizes in inches, weights in pounds").values()} == {0.0254, 0.45359237}


@pytest.mark.parametrize(
    "field, key_unit, text, expected",
    [
        ("cable_length", "", "6 ft 4 in", [(1, 1930)]),
        ("cable_length", "", "7′8″ (233.7 cm)", [(1, 2337)]),
        ("seat_width", "", "24 ¾ in", [(1, 629)]),
        ("seat_width", "", "17-1/2\"", [(1, 445)]),
        ("seat_width", "", "fifty-three cm", [(1, 530)]),
        ("seat_width", "cm", "46", [(1, 460)]),
        ("seat_width", "", "46", []),
        ("battery_runtime", "", "2h18", [(1, 138)]),
        ("max_storage_temp", "", "104 °F", [(1, 40)]),
        ("tank_volume", "", "2,6 US gal", [(1, 9842)]),
        ("motor_power", "", "1,109W", [(1, 1109)]),
        ("weight_capacity", "", "lbs.: 396", [(1, 179623)]),
        ("dimensions", "", "30-inch Wx40.6-inch Dx42.8-inch H", [(1, 762), (2, 1031), (3, 1087)]),
        ("size", "", "22 x 11.85 in", [(1, 559), (2, 301)]),
        ("size", "", "XL", []),
        ("size", "", "", []),
    ],
)
def test_quantities(field, key_unit, text, expected):
    assert quantities(field, key_unit, text) == expected


SPECS = "record_id long, description_raw string, specs map<string,string>, key string, src string"


def test_common_units_corner_cases(spark):
    rows = [(1, "Dimensions in mm; weights in kg.", {"Seat Width": "460", "product_weight": "3", "color": "5 cm"}, "x", "y")] * 2
    rows += [(2, None, {"Seat Width": None}, None, None), (None, None, {"Seat Width": "4 cm"}, None, None), (3, None, None, None, None), (4, "", {"cable length": "x " * 50_000 + "4 m"}, None, None)]
    variants = spark.createDataFrame([(9, [("Size", "4 x 5 cm"), (None, "3 cm"), ("size", None)]), (8, []), (7, None)], "variant_id long, option_values array<struct<option_name:string,value:string>>")
    got = {tuple(r) for r in product_quantities(spark.createDataFrame(rows, SPECS), variants).collect()}
    assert got == {("specs", 1, "seat_width", 1, 460), ("specs", 1, "product_weight", 1, 3000), ("specs", 4, "cable_length", 1, 4000), ("option", 9, "size", 1, 40), ("option", 9, "size", 2, 50)}
    assert product_quantities(spark.createDataFrame([], SPECS), variants.limit(0)).count() == 0


STATEMENTS = {
    "Unless noted, lengths are millimetres and weights kilograms.": (10, 1000),
    "Dimensions in mm; weights in kg.": (10, 1000),
    "All sizes in inches, weights in pounds.": (254, 454),
    "All dimensions in cm, weights in kg.": (100, 1000),
    "Measurements are metric: centimetres and kilograms.": (100, 1000),
    "Dimensions are stated in inches and weights in lbs.": (254, 454),
    "Figures below are inches / pounds.": (254, 454),
    "Sizes given in centimetres; masses in kilograms.": (100, 1000),
    "All in cm and kg": (100, 1000),
    "Values: inches, pounds": (254, 454),
    "Dimensions in cm. Made of steel. Weights in kg.": (100, 1000),
    "Units are inches. Masses in kg": (254, 1000),
    "Fits adults up to 300 lb. All rubber feet are grey.": None,
    "All legs have feet, units ship flat.": None,
}


def test_stated_units(spark):
    rows = [(i, f"Folds flat for 3 months. {text} Wipe it clean.", {"cable length": "10", "product_weight": "1"}, None, None) for i, text in enumerate(STATEMENTS)]
    rows += [(99, "all sizes " * 20_000, {"cable length": "10"}, None, None)]
    got = {(r.row_id, r.spec_field): r.base_value for r in product_quantities(spark.createDataFrame(rows, SPECS), spark.createDataFrame([], "variant_id long, option_values array<struct<option_name:string,value:string>>")).collect()}
    assert got == {(i, f): v for i, want in enumerate(STATEMENTS.values()) if want for f, v in zip(("cable_length", "product_weight"), want)}


CASES = {
    "a, b": ["a", "b"],
    "a; b;": ["a", "b"],
    '"bag, rear"; \'hose; 2 m\';c': ["bag, rear", "hose; 2 m", "c"],
    '"back-up ""mini"" pump", x': ['back-up "mini" pump', "x"],
    '["18\\" strap", "b"]': ['18" strap', "b"],
    "1) a 2) b c 3) d": ["a", "b c", "d"],
    "(1) a\n(2) b": ["a", "b"],
    "- a\r\n- b-c": ["a", "b-c"],
    "• a • •b": ["a", "b"],
    "a<br><br>b": ["a", "b"],
    "MD-1/2 / TX 3": ["MD-1/2", "TX 3"],
    "a, b, and c": ["a", "b", "c"],
    "a & b": ["a", "b"],
    "leg rest (left, right), 3,5 mm pin": ["leg rest (left, right)", "3,5 mm pin"],
    'x\n"y, z': ["x", "y", "z"],
    "a + b+": ["a", "b"],
    "leg rest (left, right)": None,
    "one": None,
    "": None,
    " , ; ": None,
}


def test_packed(spark):
    rows = [(i, text, "extra") for i, text in enumerate(CASES)] + [(98, None, None), (99, "word " * 30_000 + ", b", None)]
    frame = spark.createDataFrame(rows + rows[:3], "id int, text string, pos string")
    for limit in (8 << 20, 0):  # rules broadcast, and joined by shuffle
        got: dict = {}
        for r in split_packed(frame.select("id", "text"), ["id"], "text", broadcast_bytes=limit).collect():
            got.setdefault(r.id, []).append((r.pos, r.item))
        assert len(got.pop(99)) == 2
        assert {i: [x for _, x in sorted(v)] for i, v in got.items()} == {i: CASES[t] for i, t, _ in rows[:-2] if CASES[t]}


def test_packed_round_trip(spark):
    """What is packed by any delimiter comes out again."""
    rng = random.Random(1)
    words = ["seat pad", "cup holder", "MD-695/7", "3,5 mm adapter", "bag, rear", "caregiver's handle", "12\" strap"]
    rows, truth = [], {}
    for i in range(200):
        items = rng.sample(words, rng.randint(2, 5))
        quoted = ['"' + w.replace('"', '""') + '"' if "," in w and not w[0].isdigit() or rng.random() < 0.2 else w for w in items]
        rows.append((i, rng.choice([", ", "; ", " | ", "\n", " • ", " / ", "\t"]).join(quoted)))
        truth[i] = items
    got: dict = {}
    for r in split_packed(spark.createDataFrame(rows, "id int, text string"), ["id"], "text").collect():
        got.setdefault(r.id, {})[r.pos] = r.item
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == truth


def test_packed_table_and_empty(spark):
    rows = spark.createDataFrame([(1, {"Colors Available": "red, blue", "other": "a, b"}), (2, None)], "record_id long, specs map<string,string>")
    assert {tuple(r) for r in product_items(rows).collect()} == {(1, "colors_available", 1, "red"), (1, "colors_available", 2, "blue")}
    assert product_items(rows.limit(0)).count() == 0


def test_rule_of_nothing():
    assert resolve_rule("") == [] and resolve_rule("  ") == []

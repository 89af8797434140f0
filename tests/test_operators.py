import itertools

import pytest
from pyspark.sql import functions as F

from millrace.operators import media, pages, quality, resolve, variants
from millrace.plans.reference_queries import included_items
from millrace.streaming import queue


def test_resolved(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "id int, field string, value string")
    got = resolve.resolved([("A", rows((1, "w", "1"), (1, "x", "5"))), ("B", rows((1, "x", "5"), (1, "y", "7"))), ("C", rows((1, "w", "2"), (1, "x", "6"), (2, "z", None)))], "id").collect()
    by = {r.field: (r.value, r.choice, r.discarded, r.conflict) for r in got}
    assert by == {"w": ("1", "A", "2 (from C)", True), "x": ("5", "A", "6 (from C)", True), "y": ("7", "B", None, False)}


def test_completeness(value):
    gone = quality.missing({"name": (F.lit("n"), "text"), "brand": (F.lit(" "), "text"), "features": (F.array(), "list"), "specs": (F.create_map(), "any"), "description": (F.lit(None).cast("string"), "text")})
    assert value(gone) == ["brand", "features", "description"]
    assert value(quality.completeness(gone, 5)) == 40
    assert not value(quality.publishable(gone, F.lit(100)))


def test_errors(value):
    null = F.lit(None).cast("string")
    got = value(quality.content_errors(F.array(F.lit("Medical Supplies")), null, F.lit("Guaranteed Results!"), F.lit("x" * 71), null, F.array().cast("array<string>")))
    assert [e.split(":")[0] for e in got] == ["Content", "Content", "SEO", "Images"]
    rows = F.array(*(F.struct(F.lit(s).alias("sku"), o.alias("option_values")) for s, o in (("a", F.array(F.struct(F.lit("c").alias("option_name"), F.lit("v").alias("value")))), ("a", F.array().cast("array<struct<option_name:string,value:string>>")))))
    assert value(quality.catalogue_errors(F.lit(""), rows)) == ["BC: root SKU missing", "BC: duplicate variant SKU a", "BC: variant a missing option_values"]
    assert value(quality.schema_errors({"name": F.lit("ab"), "sku": null}, ["sku"])) == ["Schema: sku is required", "Schema: name is too short"]


def group(name, *values):
    return F.struct(F.lit(name).alias("name"), F.array(*(F.lit(v) for v in values)).alias("values"))


def test_variants(value, spark):
    groups = F.array(group("Color", "Red", "Dark Blue"), group("Size", "S", "L"))
    combos = value(variants.combinations(groups))
    assert [[o.value for o in c] for c in combos] == [["Red", "S"], ["Red", "L"], ["Dark Blue", "S"], ["Dark Blue", "L"]]
    assert value(variants.combinations(groups, most=3)) is None
    options = F.array(F.struct(F.lit("a").alias("option_name"), F.lit("Large").alias("value")), F.struct(F.lit("b").alias("option_name"), F.lit("Dark Blue").alias("value")))
    assert value(variants.variant_sku(F.lit("AB"), options, F.lit(0))) == "AB-LARGE-DARKBLUE"
    assert value(variants.variant_sku(F.lit(None).cast("string"), F.array().cast("array<struct<option_name:string,value:string>>"), F.lit(2))) == "VAR3"
    assert [g.name for g in value(variants.spec_groups(F.create_map(F.lit("Color"), F.lit("red, blue"), F.lit("Size"), F.lit("one"))))] == ["Color"]
    assert value(variants.text_values(F.array(F.lit("Available in red, blue, 5 mL")))) == ["red", "blue", "5 mL"]


def test_expanded_has_every_combination(spark):
    names = "abcd"
    rows = [(1, "P", [(n, [f"{n}{i}" for i in range(11)]) for n in names]), (2, "Q", [("a", ["x", "y"]), ("b", ["one"])]), (3, "R", []), (4, "S", None), (5, "T", [("a", ["1", "2", "3"]), ("b", ["4", "5"])])]
    frame = spark.createDataFrame(rows, "id int, base string, g array<struct<name:string,values:array<string>>>")
    want = {i: [[(n, v) for n, v in zip([n for n, vs in g if len(vs) > 1], c)] for c in itertools.product(*(vs for _, vs in g if len(vs) > 1))] for i, _, g in rows if g}
    for most in (10_000, 4):  # one product, and three, beyond what one array holds
        got: dict = {}
        for r in variants.expanded(frame, "id", "g", "base", most).orderBy("idx").collect():
            got.setdefault(r.id, []).append((r.idx, [tuple(o) for o in r.option_values], r.sku))
        assert {i: [c for _, c, _ in v] for i, v in got.items()} == want
        assert all([n for n, _, _ in v] == list(range(len(v))) for v in got.values())
        assert got[1][-1][2] == "P-A10-B10-C10-D10"


def test_included(spark):
    lines = ["2 x diaphragms", "two tubes", "cushion (2)", "24mm shield", "tube x 3", "2 × diaphragms", "- bag", ""]
    got = included_items(spark.createDataFrame([(1, x) for x in lines], "id int, line string"), "id", "line").collect()
    assert {r.item: r.quantity for r in got} == {"diaphragms": 4, "tubes": 2, "cushion": 2, "24mm shield": 1, "tube": 3, "bag": 1}


def test_images(spark, value):
    key = lambda u: value(media.image_key(F.lit(u)))
    assert key("https://a.com/GetImage.ashx?w=3&Image=%2FFoo%20B.JPG") == "foo b.jpg"
    assert key("https://a.com/p/Bar.png?x=1") == "bar.png"
    assert value(media.declared_size(F.lit("https://a.com/x.jpg?w=300&h=500"))) == 500
    assert value(media.declared_size(F.lit("https://a.com/x_640x480.jpg"))) == 640
    assert value(media.largest_source(F.lit("a.jpg 1x, b.jpg 2x, c.jpg 2x"))) == "b.jpg"
    rows = spark.createDataFrame([(1, 0, "https://a/x.jpg?w=100"), (1, 1, "https://a/y.jpg"), (1, 2, "https://b/x.jpg?w=900"), (1, 3, "https://a/z.jpg")], "id int, pos int, url string")
    assert [r.url for r in media.distinct_images(rows, "id", limit=2).orderBy("rank").collect()] == ["https://a/x.jpg?w=100", "https://a/y.jpg"]
    assert [r.url for r in media.distinct_images(rows, "id").orderBy("rank").collect()] == ["https://b/x.jpg?w=900", "https://a/y.jpg", "https://a/z.jpg"]
    assert value(media.manual_urls(F.array(F.lit("a b.pdf#p1"), F.lit("a%20b.pdf"), F.lit("a b.pdf")))) == ["a%20b.pdf"]


def test_nodes(spark):
    html = "<nav><a href=/x>Menu</a></nav><ul class='a b'><li>One <b>two</b><li>Three</ul><p>Text<p>More<br>end"
    nodes = pages.page_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"), "id", "html")
    rows = nodes.orderBy("ord").collect()
    assert [r.tag for r in rows] == ["nav", "a", "ul", "li", "b", "li", "p", "p", "br"]
    assert [r.in_chrome for r in rows][:3] == [True, True, False]
    assert rows[2].classes == ["a", "b"] and rows[1].attrs == {"href": "/x"}
    assert {r.ord: r.text for r in pages.subtree_texts(nodes, "id", F.col("tag").isin("li", "p")).collect()} == {3: "One two", 5: "Three", 6: "Text", 7: "More end"}


def test_tabs(spark, value):
    assert [value(pages.tab_bucket(F.lit(x))) for x in ("Technical Specs", "Key Features", "Downloads", "Shop", None)] == ["specs", "features", "downloads", "", ""]
    titles = spark.createDataFrame([(1, "a", "Overview")], "id int, panel_id string, title string")
    panels = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "y")], "id int, panel_id string, ord int, text string")
    assert {r.panel_id: r.title for r in pages.joined_tabs(titles, panels, "id").collect()} == {"a": "Overview", "b": "Tab 2"}


def test_queue_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Pending_Scrape", "a"), (2, "done", "b"), (3, " pending_scrape", None)], "id int, ingest_status string, url string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    work = lambda df: queue.cells(df, "id", ["url"])
    for _ in range(2):  # the second run finds nothing new
        queue.run_queue(spark, str(tmp_path / "in"), "id int, ingest_status string, url string", str(tmp_path / "out"), str(tmp_path / "check"), work).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "column", "value").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in work(queue.pending(rows)).collect()] == [(1, "url", "a")]


def test_states(spark):
    jobs = spark.createDataFrame([(i, "waiting" if i % 2 else "failed") for i in range(10)], "id int, state string")
    assert {r.state: r.n for r in queue.state_counts(jobs).collect()} == {"waiting": 5, "failed": 5}
    assert queue.first_of_states(jobs, "id", {"waiting": 2, "failed": 1}).count() == 3


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_hang_on_partitions(spark, partitions):
    rows = spark.createDataFrame([(i % 3, i, f"https://a/{i % 4}.jpg?w={i}") for i in range(40)], "id int, pos int, url string").repartition(partitions)
    assert media.distinct_images(rows, "id").count() == 12


def test_unit_expressions():
    from millrace.functions.units import FieldSet, LENGTH, Unit, quantities

    read = lambda field, text: [v for _, v in quantities(field, "", text)]
    assert read("product_weight", "5 kg/m^2") == [] == read("motor_power", "3 W/kg")
    assert read("tank_volume", "0.002 m^3") == read("tank_volume", "0.002 m³") == read("tank_volume", "2 dm3") == [2000]
    assert read("motor_power", "40 N·m/s") == read("motor_power", "40 J per second") == [40]
    assert read("tank_volume", "3 cubic inches") == [49] and read("battery_runtime", "2h18") == [138]
    assert quantities("product_weight", "kg", "5 kg/m^2") == []  # the key's unit doesn't stand in for another dimension
    own = FieldSet({"gap": Unit(1e-6, LENGTH)})
    assert quantities("gap", "", "2 mm", fields=own) == [(1, 2000)]


def test_common_units_of_own_fields(spark):
    from millrace.functions.units import FieldSet, LENGTH, Unit
    from millrace.operators.quantities import common_units

    rows = spark.createDataFrame([(1, "Gap", "2 mm", None), (2, "gap", "2 kg/m", None), (3, None, "2 mm", None)], "id int, key string, value string, defaults string")
    got = common_units(rows, ["id"], fields=FieldSet({"gap": Unit(1e-6, LENGTH)}))
    assert [tuple(r) for r in got.collect()] == [(1, "gap", 1, 2000)]

from pyspark.sql import functions as F

from millrace.operators import content as C, formats as M, page_record as P
from millrace.functions import specs as S

HTML = """<html><head><title>Shop</title><meta property="og:title" content="Orvane Chair"><meta property=og:image content="/i/main.jpg">
<script type="application/ld+json">{"@graph": [{"@type": "Org"}, {"@type": "Product", "name": "Chair", "brand": {"name": "Orvane"}, "sku": "C-1", "additionalProperty": [{"name": "Max Load", "value": "300 pounds"}], "image": ["a.jpg"]}]}</script>
</head><body><nav><p>A very long menu paragraph that is not about the chair at all</p><img src=/i/nav.jpg></nav>
<main><h1>Orvane <b>Chair</b></h1><p>Short.</p><div class="product-description"><h2>About</h2><p>A chair for the bath that folds flat.</p></div>
<table><tr><th>Seat Width<td>20"</tr><tr><td>Privacy policy</td><td>x y</td></tr></table><dl><dt>Max weight<dd>300 pounds</dl><ul class=features><li>Folds flat in seconds<li>Color: Blue</ul>
<img src="/i/a.jpg?w=100" srcset="/i/a.jpg?w=900 900w, /i/a.jpg?w=100 100w"><img src=/i/logo.png><img src=/i/s.jpg width=40px>
<select name=frame_size><option>Select size<option>S<option>L</select><div class=swatch><label>Color</label><button>Red</button><button>Blue</button></div>
<table><thead><tr><th>Ref<th>Length (mm)</thead><tbody><tr><td>a<td>10<tr><td>b<td>20</tbody></table>
<a href="#t1">Details</a><div id=t1><p>Folds</p></div><div class=accordion><h3>Care</h3><p>Wipe</p><p>dry</p><h3>Use</h3><p>Sit</p></div>
<a href="/d/c-1-user-manual.pdf#p2">Manual</a><a href="/d/iso.pdf">ISO</a><a href="/d/guide.pdf">Guide</a></main>
<div class="related-products"><img src=/i/other.jpg><ul class=features><li>Not of this product</ul></div><table><tr><th>No.<th>Part<th>Qty</tr><tr><td>1<td>bolt<td>2</tr></table></body></html>"""


def test_page_record(spark):
    frame = spark.createDataFrame([(1, "https://a.example/p/chair", HTML, "x"), (2, None, None, None), (3, "https://a.example", "", None)], "page int, url string, html string, name string")
    rows = {r.page: r for r in P.page_records(frame, least_side=100).collect()}
    r = rows[1]
    assert (r.name, r.name_raw, r.brand, r.sku, r.description_raw) == ("x", "Chair", "Orvane", "C-1", "A chair for the bath that folds flat.")
    assert r.specs == {"max_load": "300 pounds", "seat_width": "20 in", "weight_capacity": "300 lb", "color": "Blue", "ref": "Length (mm)", "a": "10", "b": "20"}
    assert r.features_raw == ["Folds flat in seconds", "Color: Blue"]
    assert r.images == ["https://a.example/p/a.jpg", "https://a.example/i/main.jpg"]
    assert r.manuals == ["https://a.example/d/c-1-user-manual.pdf", "https://a.example/d/guide.pdf"]
    assert [(o.name, o["values"]) for o in r.option_groups] == [("frame size", ["S", "L"]), ("Color", ["Red", "Blue"]), ("Length (mm)", ["10", "20"])]
    assert [(t.title, t.text, t.source) for t in r.tabs] == [("Details", "Folds", "shopify"), ("Care", "Wipe dry", "generic"), ("Use", "Sit", "generic")]
    assert rows[2].features_raw == [] and rows[3].name_raw == "" and rows[3].specs == {}
    assert P.page_records(frame.limit(0)).count() == 0


def test_content(value):
    strings = lambda *xs: F.array(*map(F.lit, xs))
    text = F.lit("One line.\ntwo\nOne LINE.")
    assert value(C.compiled_description([text, F.lit("Three")], strings("A closed system for safety", "A Closed system", "two"), None)) == "One line.\n\ntwo\n\nThree\n\nA closed system for safety"
    assert value(C.compiled_description([F.lit(None).cast("string")], strings("A closed system for safety"))) == ""
    assert value(C.first_paragraph(F.lit("short\n" + "x" * 60))) == "x" * 60 and value(C.first_paragraph(F.lit(None).cast("string"))) == ""
    menu = "\n".join(["Chairs", "Beds"] * 6)
    assert value(C.looks_like_menu(F.lit(menu), F.lit("Orvane Rollator"))) is True and value(C.looks_like_menu(F.lit("A text."), F.lit("Orvane"))) is False
    assert value(C.readable_text(F.lit(menu), F.lit("Orvane"), F.lit(" "), F.lit("Told"))) == "Told"
    got = value(C.tab_texts_read(strings("Case Length (in) 11.5 Weight (lb)3", "Folds flat in seconds. Color: 2 tones", "  ")))
    assert got.specs == {"case_length_in": "11.5", "weight_lb": "3", "color": "2 tones"} and "Folds flat in seconds" in got.features
    kept = value(C.sanitized(strings("Folds flat", "Privacy notice here", "www.a.example"), F.create_map(F.lit("seat_width"), F.lit("20 in"), F.lit("terms"), F.lit("x")), strings("/a/user-manual.pdf", "/a/iso.pdf"), strings("/a/logo.png", "/a/b.jpg"), F.lit("Tiny\n" + "y" * 51)))
    assert (kept.features, kept.specs, kept.manuals, kept.images) == (["Folds flat", "Seat Width: 20 in", "Terms: x"], {"seat_width": "20 in"}, ["/a/user-manual.pdf"], ["/a/b.jpg"])


def test_contents(value):
    strings = lambda *xs: F.array(*map(F.lit, xs))
    page = F.lit("Intro\nIncludes everything needed\n- 2 bottles\nnothing here\nBreast shield\nWrite a review\n3 tubes\nLeg tip grey\nLeg tip black")
    got = value(C.guessed_contents(page, strings("Includes a bag, two tubes and one manual", "Two (2) 24mm shields of breast pump", "4 lb bag", None)))
    assert got == ["2 bottles", "Breast shield", "Leg tip grey", "a bag", "two tubes", "one manual", "Two (2) 24mm shields of breast pump"]
    assert value(C.guessed_contents(F.lit(None).cast("string"), F.lit(None).cast("array<string>"))) == []


def test_browse_lift(value):
    sections = F.struct(F.lit("Folds flat\nLight frame").alias("features"), F.lit("1 bag").alias("included"), F.lit("Weight: 3 kg\nColor: Blue\nWeight: 4 kg").alias("specifications"), F.create_map(F.lit("t"), F.lit("Depth (in) 9")).alias("tabs"))
    got = value(C.browse_lift(F.array(F.lit("folds flat")), F.create_map(F.lit("weight"), F.lit("own")), sections))
    assert got.features == ["folds flat", "Light frame", "1 bag", "Depth (in) 9"] and got.specs == {"depth_in": "9", "weight": "own"} and got.specs_browse == {"depth_in": "9", "weight": "4 kg"}


def test_formats(value):
    got = value(M.sheet_fields(F.create_map(*map(F.lit, ["Ply", "12-Ply", "Manufacturer", "Acme®", "Number per Pack", "Box of 50", "other", "x", "Latex Free Indicator", "Not Made with Natural Rubber Latex"]))))
    assert got == {"ply": "12‑ply", "manufacturer": "Acme®", "count_per_pack": "50", "latex_free_indicator": "Not Made with Natural Rubber Latex", "latex_free": "true", "brand": "Acme®"}
    assert value(M.furniture_tab(F.lit(""), F.lit(None).cast("string"))) is True and value(M.furniture_tab(F.lit('<div class="product-features">'), F.lit("x"))) is False
    assert value(M.short_description(F.lit("One\nORDER NOW today\nTwo\nTwo\nThree\nFeatures\nFour"))) == "One Two"
    assert value(M.safety_sheet(F.array().cast("array<string>"), F.array(F.lit("<a href='https://a.example/s.PDF'>")))) == "https://a.example/s.PDF"
    assert value(M.spec_items(F.lit("<ul><li>Width:  20 in</li><li><strong>A</strong></li><li>B</li></ul>"))) == "<ul><li><strong>Width</strong>: 20 in</li><li><strong>A</strong></li><li><strong>B</strong>:</li></ul>"
    assert value(M.feature_items(F.lit("<li>Light - easy to lift</li><li>Folds flat, fits a car</li><li><strong>X</strong>–y</li>"))) == "<li><strong>Light</strong> – Easy to lift.</li><li><strong>Folds flat</strong> – Fits a car.</li><li><strong>X</strong> – y</li>"
    whole = value(M.assembled_description({"hook_html": F.lit("<p>h</p>"), "main_description_title": F.lit("T"), "main_description_html": F.lit("m"), "specs_html": F.lit("<li>a: b</li>"), "why_choose_html": F.lit("w"), "faq_html": F.lit(None).cast("string")}))
    assert whole == "<p>h</p>\n\n<h2>T</h2>\n\nm\n\n<h2>Product Specifications</h2>\n\n<li><strong>a</strong>: b</li>\n\n<h2>Why Choose</h2>\n\nw"
    assert value(M.coerced_specs(F.lit('{"a": " b ", "c": "", "n": 3}'))) == {"a": "b", "n": "3"}
    assert value(M.coerced_specs(F.lit('[{"key": "a", "value": "b"}, {"c": "d"}, {"x": "1", "y": "2"}]'))) == {"a": "b", "c": "d"} and value(M.coerced_specs(F.lit("null"))) == {}
    patch = value(M.listing_patch(F.lit("H"), F.lit(None).cast("string"), F.lit("m"), F.array(F.lit("a"), F.lit("b")), F.lit("s"), F.lit("d")))
    assert patch.asDict() == {"name": "H", "meta_description": "m", "page_title": "", "search_keywords": "a, b", "custom_url": "/s", "description": "d"}
    report = value(M.speed_report(F.lit('{"lighthouseResult": {"categories": {"performance": {"score": 0.5}}, "audits": {"largest-contentful-paint": {"displayValue": "2 s"}, "unused-javascript": {"score": 0.2}, "offscreen-images": {"score": 1}}}}')))
    assert (report.performance, report.lcp, report.tbt, report.actions) == (0.5, "2 s", None, ["Reduce/defers unused JS (apps, trackers)."])
    assert value(M.images_in_json(F.lit('{"a": ["https:\\/\\/x.example\\/1.JPG?w=2", "b.txt"], "k.png": {"src": "/2.webp"}}'))) == ["https://x.example/1.JPG?w=2", "/2.webp"]
    assert value(M.documents_in_json(F.lit('{"a": "x.pdf#p"}'))) == ["x.pdf#p"] and value(M.css_backgrounds(F.lit("background: url('a.jpg'), url(data:x)"))) == ["a.jpg"]
    assert value(F.regexp_like(F.lit("a.b(c)[d]"), F.concat(F.lit("^"), M.escaped_pattern(F.lit("a.b(c)[d]")), F.lit("$")))) is True
    tabs = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(x).alias("text")) for t, x in (("Other", "o"), ("Specs", "s"), ("Overview", "v"), ("More", "S"))))
    assert value(M.merged_tabs(tabs, ["Overview", "Specs"])) == "v\n\ns\n\no"
    product = F.parse_json(F.lit('{"name": "N", "image": "a.jpg"}'))
    assert value(M.resolved_product(product, F.lit(""), F.lit("<p>one <b>two</b></p>"))).asDict() == {"name": "N", "description": "one two", "images": ["a.jpg"]}


def test_picked_fields(value):
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("seat_height", "18 in"), ("max user weight", "300 lb"), ("what's included", "bag"), ("model no.", "X1"), ("models", "no"), ("total weight", "9"))))
    got = value(S.picked(pairs, F.lit("Torque: 9 Nm  for all bolts. Seat height: 99")))
    assert got == {"seat_height": "18 in", "adjustable_seat_height": "18 in", "height": "18 in", "weight_capacity": "300 lb", "weight": "300 lb", "included_items": "bag", "included_section": "bag", "model_number": "X1", "torque": "9 Nm for all bolts. Seat height: 99"}


def test_browsed(spark):
    from millrace.operators import browse

    html = """<head><meta name=description content="Meta text"><title>T</title></head><nav><a href=/home>Home</a></nav><main><h1>Chair</h1><p>Folds flat<div class="side menu"><p>Offers</p></div><p hidden>No</p><p style="display: none">No</p>
    <div id=tab-1>Package includes one bag</div><dl><dt>Depth<dd>9 in</dl></main><h3>Key Features</h3><ul><li>Light<li>Strong</ul><img src=/a.jpg alt=A width=40><div style="background: url('/b.jpg')"></div>
    <a href="/x/Manual.pdf">User manual</a><a href=/data.json>d</a><script type="application/json">{"specs": [{"name": "Seat Width", "value": "20 in"}], "related": [{"name": "Other", "value": "x"}]}</script>
    <script>window.__NEXT_DATA__ = {"attributes": [{"label": "Max Load", "displayValue": 300}], "bad": }; var spec = {"key": "Color", "val": "Red"};</script>"""
    frame = spark.createDataFrame([(1, html, "x"), (2, None, None), (3, "", None)], "id int, html string, links string")
    rows = {r.id: r for r in browse.browsed(frame).collect()}
    r = rows[1]
    assert r.visible_text == "Chair\nFolds flat\nPackage includes one bag\nDepth\n9 in"
    assert (r.sections.description, r.sections.features, r.sections.included, r.sections.dl, r.sections.tabs) == ("Meta text", "Light\nStrong", "Package includes one bag", "Depth\n9 in", {"tab-1": "Package includes one bag"})
    assert (r.links.pdfs, r.links.jsons, r.backgrounds, r.images[0].alt) == (["/x/Manual.pdf"], ["/data.json"], ["/b.jpg"], "A")
    assert [(h.href, h.hint) for h in r.hints] == [("/x/Manual.pdf", "manual")]
    assert [(s.key, s.value) for s in r.script_specs] == [("Seat Width", "20 in"), ("Max Load", "300"), ("Color", "Red")]
    assert rows[2].visible_text == "" and rows[3].links.anchors == []


def test_schema(value):
    from millrace.operators import quality as Q

    good = {"name": F.lit("Chair"), "sku": F.lit("s"), "brand": F.lit("b"), "price": F.lit(1.0), "description": F.lit("x" * 30), "categories": F.array(F.lit("Mobility")), "images": F.array(F.lit("https://a.example/x.jpg"))}
    assert value(Q.product_errors(good)) == []
    bad = good | {"price": F.lit(-1.0), "images": F.array(F.lit("x.jpg")), "categories": F.array().cast("array<string>"), "brand": F.lit(None).cast("string"), "faq": F.array(F.struct(F.lit("q").alias("q"), F.lit(None).cast("string").alias("a")))}
    assert value(Q.product_errors(bad)) == ["Schema: 'brand' is required", "Schema: price is below 0", "Schema: images holds no address", "Schema: categories is empty", "Schema: faq lacks a question or an answer"]
    assert value(Q.text_errors({"h1": F.lit(""), "title": F.lit("t" * 101)}, Q.SEARCH_TEXTS)) == ["/h1 must NOT have fewer than 1 characters", "/title must NOT have more than 100 characters", "/ must have required property 'meta_description'"]


def test_page_variants(spark):
    from millrace.operators import variants as V

    rows = [(1, {"color": "red or blue", "size": "S"}, ["Available in oak, ash"], None, [("color", ["blue", "green"]), ("only", ["x"])], "C"), (2, {}, None, None, None, None), (3, None, [], "", [], "")]
    frame = spark.createDataFrame(rows, "id int, specs map<string,string>, features_raw array<string>, description_raw string, option_groups array<struct<name:string,values:array<string>>>, sku string")
    got = V.page_variants(frame, "id").orderBy("idx").collect()
    assert [(r.id, r.idx, [(o.option_name, o.value) for o in r.option_values]) for r in got] == [(1, i, [("color", c), ("Variant", w)]) for i, (c, w) in enumerate((c, w) for c in ("red", "blue", "green") for w in ("oak", "ash"))]
    assert V.page_variants(frame.limit(0), "id").count() == 0

from pyspark.sql import functions as F

from millrace.operators import pages, projection as P, variants

HTML = """<html><head><title>Shop</title><meta property="og:title" content="Orvane Chair"><meta property=og:image content="/i/main.jpg">
<meta name=description content="A chair."><link rel=canonical href="/p/chair">
<script type="application/ld+json">{"@graph": [{"@type": "Org"}, {"@type": "Product", "name": "Chair", "brand": {"name": "Orvane"}, "sku": "C-1", "offers": [{"price": 12.5}], "image": ["a.jpg"]}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><p>A very long menu paragraph that is not about the chair at all</p><img src=/i/nav.jpg></nav>
<main><h1>Orvane <b>Chair</b></h1><p>Short.</p><p>A chair for the bath that folds flat.</p>
<table><tr><th>Seat Width<td>20"</tr><tr><td>Privacy policy</td><td>x y</td></tr></table><dl><dt>Max weight<dd>300 pounds</dl><ul><li>Color: Blue</ul>
<img src="/i/a.jpg?w=100" srcset="/i/a.jpg?w=900 900w, /i/a.jpg?w=100 100w"><img src=/i/logo.png>
<a href="#t1">Features</a><div id=t1><p>Folds</p></div><a href="/d/c-1-user-manual.pdf#p2">Manual</a><a href="/d/iso.pdf">ISO</a><a href="/d/guide.pdf">Guide</a></main>
<div class="related-products"><img src=/i/other.jpg></div>
<table><tr><th>No.<th>Part<th>Qty</tr><tr><td>1<td>bolt<td>2</tr></table>
<div itemscope itemtype="x/Product"><span itemprop=name>Chair</span><meta itemprop=sku content=C-1></div></body></html>"""


def test_page(spark):
    frame = spark.createDataFrame([(1, "https://a.example/p/chair", HTML, "C-1", "Chair")], "page int, url string, html string, code string, name string")
    nodes = pages.page_nodes(frame, "page", "html").cache()
    facts = P.page_facts(nodes, "page").first()
    assert (facts.title, facts.og_title, facts.heading, facts.paragraph, facts.description, facts.canonical) == ("Shop", "Orvane Chair", "Orvane Chair", "A chair for the bath that folds flat.", "A chair.", "/p/chair")
    pairs = P.spec_pairs(nodes, "page").cache()
    assert {(r.channel, r["name"], r.value) for r in pairs.collect()} == {("table", "Seat Width", '20"'), ("terms", "Max weight", "300 pounds"), ("line", "Color", "Blue")}
    assert P.spec_map(pairs, "page").first().specs == {"seat_width": "20 in", "weight_capacity": "300 lb", "color": "Blue"}
    assert P.part_tables(nodes, "page").count() == 1
    got = P.json_ld_product(nodes, "page").first()
    assert (got["name"], got.brand, got.sku, got.price, got.images) == ("Chair", "Orvane", "C-1", 12.5, ["a.jpg"])
    assert {r.property: r["values"] for r in P.item_properties(nodes, "page").collect()} == {"name": ["Chair"], "sku": ["C-1"]}
    assert [(r.title, r.text) for r in P.tabs(nodes, "page").collect()] == [("Features", "Folds")]
    assert [r.url for r in P.images(nodes, "page", frame).orderBy("rank").collect()] == ["https://a.example/i/main.jpg", "https://a.example/i/a.jpg?w=900"]
    assert [r.url for r in P.manuals(nodes, "page", frame).orderBy("rank").collect()] == ["https://a.example/d/c-1-user-manual.pdf", "https://a.example/d/guide.pdf"]
    assert {r.href for r in P.links(nodes, "page", frame).collect()} >= {"https://a.example/d/iso.pdf"}


def test_payloads(spark):
    rows = spark.createDataFrame([(1, "Chair", {"a": "b"}), (2, "www.a.example", {"a": "b"}), (3, "Chair", {}), (4, None, None)], "id int, name_raw string, specs map<string,string>")
    ok, bad = P.payloads(rows)
    assert [r.id for r in ok.collect()] == [1] and {r.id: r.reason for r in bad.collect()} == {2: "no name", 3: "no specs", 4: "no name"}


def test_priced(spark):
    options = "array<struct<option_name:string,value:string>>"
    combos = spark.createDataFrame([(1, [("Color", "Red"), ("Size", "S")], 5.0), (1, [("Color", "Red"), ("Size", "L")], 5.0)], f"id int, option_values {options}, base double")
    offers = spark.createDataFrame([(1, "Red", "S", 9.0), (1, None, None, 1.0)], "id int, color string, size string, price double")
    assert sorted(r.price for r in variants.priced(combos, offers, "id", "base").collect()) == [5.0, 9.0]
    new = combos.select("id", F.lit("x").alias("sku"), "option_values")
    held = new.limit(1)
    assert variants.added_variants(held, new, "id").count() == 2

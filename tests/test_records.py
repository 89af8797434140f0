import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from millrace.functions import markdown
from millrace.operators import audit, records as R
from millrace.plans import ingest
from millrace.sources import files


def lit(xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def test_ranked_codes(spark):
    rows = [(1, 1, "url", "AB12"), (1, 2, "structured", "ab12"), (1, 3, "itemprop", "X-99"), (1, 4, "structured", "123456789012"), (1, 5, "labelled", " "), (2, 1, "other", "x")]
    got = R.ranked_codes(spark.createDataFrame(rows, "id int, ord int, source string, code string"), "id").orderBy("id", "rank").collect()
    assert [(r.id, r.rank, r.code, r.score) for r in got] == [(1, 1, "X-99", 7), (1, 2, "AB12", 4), (2, 1, "x", 0)]


def test_small_parts(value):
    assert [value(R.brand_of_name(F.lit(x).cast("string"))) for x in ("Orvane Walker", "Portable Walker", "the walker", "", None)] == ["Orvane", "", "", "", ""]
    assert value(R.codes_of_url(F.lit("https://a/Item/AB?x=1/p/cd"))) == ["ab", "cd"]
    assert value(R.family_of_url(F.lit("https://a/product-page.chair-20-30"))).family_id == "chair"
    assert value(R.repaired_name(F.lit("ORVANE"), F.lit("Orvane"), F.lit(" "), F.lit("https://a/p/bath-chair?x=1"))) == "bath chair"
    assert value(R.labelled_codes(F.lit("SKU: AB-12, Item # 77x; code none"))) == ["AB-12", "77x"]
    assert value(R.looks_like_url(F.lit("www.a.example"))) and not value(R.looks_like_url(F.lit(None).cast("string")))
    assert value(R.full_name(F.lit("Orvane®"), F.lit("Glove"), F.lit(None).cast("string"), F.lit(""), F.lit("Sterile"), F.lit(50), F.lit("G1"))) == "Orvane, Glove, Sterile, 50/Pack (G1)"


def test_features(value):
    got = value(R.specs_from_features(F.create_map().cast("map<string,string>"), lit(["Width: 20 in", "Folds flat"])))
    assert got.specs == {"width": "20 in"} and got.features == ["Folds flat"]
    held = value(R.specs_from_features(F.create_map(F.lit("a"), F.lit("b")), lit(["Width: 20 in"])))
    assert held.specs == {"a": "b"} and held.features == ["Width: 20 in"]
    parts = value(R.by_source(lit(["Steel frame"]), lit(["Wide seat"]), F.lit(None).cast("array<string>"), lit(["steel frame", "Big wheels", "wide seat"])))
    assert parts.html == ["Big wheels"] and parts.combined == ["Steel frame", "Wide seat", "Big wheels"]
    assert value(R.by_class(lit(["Helps you", "Frame"]))) == {"feature": ["Frame"], "benefit": ["Helps you"], "included": []}


def test_structured(value):
    side = lambda name, specs: F.struct(F.lit(name).alias("name"), F.lit(" ").alias("brand"), F.lit(None).cast("string").alias("description"), specs.alias("specs"), lit(["a", "b"]).alias("images"), lit(["X"]).alias("features"))
    got = value(R.merged_structured(side("", F.create_map(F.lit("k"), F.lit("1"))), side("N", F.create_map(F.lit("k"), F.lit("2"), F.lit("m"), F.lit("3"))), side("Z", F.create_map().cast("map<string,string>"))))
    assert (got.name, got.brand, got.specs, got.images, got.features) == ("N", "", {"k": "1", "m": "3"}, ["a", "b"], ["X"])
    assert value(R.open_graph_specs(F.create_map(F.lit("product:retailer:sku"), F.lit("1"), F.lit("product:price:amount"), F.lit("2"), F.lit("og:x"), F.lit("3")))) == {"retailer_sku": "1"}


@pytest.mark.parametrize("secret", ["s", "k" * 90])
def test_signature(value, secret):
    text = "héllo {}"
    assert value(R.signed(F.lit(text), secret)) == hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest()
    assert not value(R.signature_holds(F.lit(text), F.lit(None).cast("string"), secret))


def test_manual_texts(spark):
    records = spark.createDataFrame([(1, ["a", "b", "a", None, "c"]), (2, None)], "id int, manuals array<string>")
    texts = spark.createDataFrame([("a", "A"), ("c", "C"), ("a", "A")], "url string, text string")
    got = {r.id: (r.manual_text, r.manuals_failed) for r in R.with_manual_texts(records, "id", "manuals", texts, most=3).collect()}
    assert got == {1: ("A\n\nC", ["b"]), 2: (None, None)}


def test_markdown(value):
    assert value(markdown.paragraphs(F.lit("One\ntwo\n• a\n- b\nthree"))) == "One two\n\n- a\n\n- b\n\nthree"
    assert value(markdown.spec_table(F.create_map(F.lit("seat_width"), F.lit("20\nin")))) == "| Spec | Value |\n|---|---|\n| Seat Width | 20 in |"
    assert value(markdown.spec_table(F.create_map().cast("map<string,string>"))) == ""


def test_audit(value):
    assert value(audit.out_of_bounds({"meta_title": F.lit("<b>x</b>"), "short_name": F.lit(None).cast("string")})) == ["short_name: 0", "meta_title: 1"]
    assert value(audit.keyword_faults(lit(["a", "A"]))) == ["number", "capitals", "repeats"]
    assert value(audit.name_faults(F.lit("Walker AB-1 ™ 123456789012 with"), F.lit("ab-1"))) == ["sku", "gtin", "mark", "hanging end"]
    assert value(audit.sizes_in_order(lit(["xl", "Small", "medium", "S", "Custom"]))) == ["S", "M", "XL", "Custom"]
    assert value(audit.has_placeholder(F.lit("Hello {{ NAME }}"))) and not value(audit.has_placeholder(F.lit(None).cast("string")))
    assert value(audit.list_lengths(F.lit("<h3>x</h3><li>a<li>b<a href=x>"))).items == 2


RECORD = "record_id long, source string, name_raw string, description_raw string, specs map<string,string>, features_raw array<string>, manuals array<string>, brand string, sku string"


def test_ingest(spark):
    rows = [
        (1, "https://a/p/bath-chair", "Orvane", "A seat for the bath.\nLab results, order now\nSiège réglable", {}, ["Width: 20 in", "Folds flat", "folds flat", "Mobility", "Do not bend"], ["m 1.pdf#2"], "Orvane", None),
        (2, None, None, None, None, None, None, None, None),
    ]
    got = {r.record_id: r for r in ingest.ingested(spark.createDataFrame(rows, RECORD)).collect()}
    one, two = got[1], got[2]
    assert (one.name_raw, one.description_raw, one.features_raw) == ("bath chair", "A seat for the bath.", ["Folds flat"])
    assert one.pdf_docs == ["m%201.pdf"] and abs(one.quality_score - 0.3) < 1e-9 and one.needs_review
    assert two.quality_score == 0 and two.features_raw is None
    again = ingest.quieted(ingest.quieted(spark.createDataFrame(rows, RECORD))).select("features_raw").collect()
    assert again == ingest.quieted(spark.createDataFrame(rows, RECORD)).select("features_raw").collect()


def test_files(spark, tmp_path):
    (tmp_path / "queue.csv").write_text('Ingest Status,Product URL\npending_scrape,"a, ""b"""\n')
    assert [tuple(r) for r in files.sheet(spark, str(tmp_path / "queue.csv")).collect()] == [("pending_scrape", 'a, "b"')]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "describe.md").write_text("Hi\n{{ NAME }}")
    assert [tuple(r) for r in files.prompts(spark, str(tmp_path / "prompts")).collect()] == [("describe", "Hi\n{{ NAME }}")]
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert files.binaries(spark, str(tmp_path)).count() == 1
    held, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {tuple(r) for r in files.upserted(held, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    files.write_records(held, str(tmp_path / "out"), by="k")
    assert spark.read.json(str(tmp_path / "out")).count() == 2

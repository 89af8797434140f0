import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.squeeze, " a  b\t\n c ", "a b c"),
        (T.squeeze, None, ""),
        (T.decode_entities, "&amp;lt; &quot;x&quot; &#39;", "< \"x\" '"),
        (T.decode_once, "a%20b", "a b"),
        (T.decode_once, "a%2520b", "a%2520b"),
        (T.decode_once, "100%", "100%"),
        (T.host, "https://Shop.Example.com:80/x?y", "shop.example.com"),
        (T.host, "no url", ""),
        (T.registrable_domain, "a.b.example.co.uk", "example.co.uk"),
        (T.registrable_domain, "www.example.com", "example.com"),
        (T.registrable_domain, "localhost", "localhost"),
        (T.title_case, "heavy-duty (steel) X2b", "Heavy-Duty (Steel) X2b"),
        (T.plain_value, "a\n b;;", "a b"),
        (T.slug, " Über Walker 2.0! ", "ber-walker-2-0"),
        (T.without_fences, "```json\n{}\n```", "{}"),
        (T.json_candidate, 'x {"a": 1} y', '{"a": 1}'),
        (T.json_candidate, "x {a y", "x {a y"),
        (T.short_dashes, "a—b---c", "a–b–c"),
        (T.short_name, "Walker – the best", "Walker"),
    ],
)
def test_scalar(value, f, given, expected):
    assert value(f(F.lit(given).cast("string"))) == expected


def test_short_name_cuts_at_a_word(value):
    assert value(T.short_name(F.lit("one two three four"), 10)) == "one two"


@pytest.mark.parametrize("host, bad", [("10.1.2.3", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.0.9", True), ("169.254.1.1", True), ("8.8.8.8", False), ("localhost", True), ("x.local", True), ("", True), (None, True), ("fd00::1", True), ("fdomain.com", False), ("example.com", False), ("10.example.com", False)])
def test_dangerous_host(value, host, bad):
    assert value(T.is_dangerous_host(F.lit(host).cast("string"))) is bad


@pytest.mark.parametrize(
    "base, link, expected",
    [
        ("https://a.com/x/y.html", "z.jpg", "https://a.com/x/z.jpg"),
        ("https://a.com/x/", "z.jpg", "https://a.com/x/z.jpg"),
        ("https://a.com", "z.jpg", "https://a.com/z.jpg"),
        ("https://a.com/x", "/z", "https://a.com/z"),
        ("http://a.com/x", "//b.com/z", "http://b.com/z"),
        ("http://a.com/x", "https://c.com", "https://c.com"),
        ("nonsense", "z", "z"),
        ("http://a.com", None, None),
    ],
)
def test_absolute(value, base, link, expected):
    assert value(T.absolute(F.lit(base), F.lit(link).cast("string"))) == expected


def test_same_site(value):
    assert value(T.same_site(F.lit("https://www.a.com/x"), F.lit("https://img.a.com/y")))
    assert value(T.same_site(F.lit("https://www.a.com/x"), F.lit("https://d1.cloudfront.net/y")))
    assert not value(T.same_site(F.lit("https://www.a.com/x"), F.lit("https://b.org/y")))


def test_lists(value):
    assert value(T.sentences(F.lit("One is 2.5 in. Two!\n• Three\nfour"))) == ["One is 2.5 in.", "Two!", "• Three", "four"]
    assert value(T.value_list(F.lit("S / M or L; XL,"))) == ["S", "M", "L", "XL"]
    assert value(T.value_list(F.lit(None).cast("string"))) == []


def test_fill_and_letters(value):
    assert value(T.fill(F.lit("Hi {{ NAME }}, {{MISSING}} {{X}}."), {"NAME": F.lit("$1 Ann\\"), "X": F.lit(None).cast("string")})) == "Hi $1 Ann\\, {{MISSING}} ."
    assert [value(T.column_letters(F.lit(n))) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert value(T.list_items(F.lit("<ul><li>a<LI class=x>b</ul><link>"))) == 2
    assert len(value(T.random_id())) == 12

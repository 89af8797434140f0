import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import canonical, encoding, mixing, packing
from millrace.llm.boilerplate import Classifier, all_furniture, furniture, main_bodies
from millrace.llm.canonical import BkTree, Matcher, distance, short_forms, threshold
from millrace.llm.listings import identity, measures, product_groups, product_pairs, respelled, suffix_measure
from millrace.llm.scans import clean_lexicon, flaws, found_flaws, label_lines, rare_meanings, repaired
from millrace.llm.setjoin import containment_join, star_clusters
from millrace.llm.queries import VOCABULARY
from millrace.llm.tokens import count_tokens


# --- set join and stars


def containment(x, y):
    weights = {**dict(x), **dict(y)}
    common = sum(weights[t] for t in dict(x).keys() & dict(y).keys())
    return common / min(sum(dict(x).values()), sum(dict(y).values()))


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_containment_join_is_exact(spark, threshold):
    rng = random.Random(4)
    weight = {f"t{i}": float(1 + i % 7) for i in range(25)}
    sets = {i: [(t, weight[t]) for t in rng.sample(sorted(weight), rng.randint(1, 6))] for i in range(80)}
    sets[80] = sets[3]
    frame = spark.createDataFrame([*sets.items(), (90, []), (91, None)], "id long, tokens array<struct<token:string,weight:double>>")
    got = {frozenset((r.a, r.b)): r.similarity for r in containment_join(frame, threshold).collect()}
    want = {frozenset((a, b)): containment(sets[a], sets[b]) for a, b in itertools.combinations(sets, 2) if containment(sets[a], sets[b]) >= threshold}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_stars(spark):
    nodes = spark.createDataFrame([(1, 9), (2, 5), (3, 7), (4, 1), (5, 1)], "id long, rank int")
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.9)], "a long, b long, similarity double")
    assert {r.id: r.center for r in star_clusters(nodes, links).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert star_clusters(nodes, links.limit(0)).count() == 5


def test_stars_of_a_long_chain(spark):
    """Ranks that fall along a chain take a round for two nodes: more than fifty rounds."""
    n = 106
    nodes = spark.createDataFrame([(i, n - i) for i in range(n)], "id long, rank int").coalesce(1)
    links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(n - 1)], "a long, b long, similarity double").coalesce(1)
    assert {r.id: r.center for r in star_clusters(nodes, links).collect()} == {i: i - i % 2 for i in range(n)}


# --- listings

LISTING = "listing_id long, seller string, name string, sku string, brand string, price double, specs_html string, categories array<string>, ingested_at timestamp, product string"


def listing(i, name, sku=None, brand="Orvane"):
    return (i, "s", name, sku, brand, 1.0, None, ["Rollator"], None, "clash")


def test_measures():
    assert measures("Walker 26 in, max 136kg, 27.1 fl oz, box of 50, Blk")[0] == {"count": "50", "length": "26", "capacity": "300", "volume": "800", "colour": "BK"}
    assert measures("W24in 40.6 cm")[0]["length"] == "24"
    assert [suffix_measure(x) for x in ("40H", "80M", "P50", "GN", "26", "ZZ9")] == [("capacity", "400"), ("volume", "800"), ("count", "50"), ("colour", "GN"), ("length", "26"), None]
    assert identity(None, None, None, None, None)["words"] == []


def test_listings(spark):
    rows = [
        listing(1, "Orvane Morsemuma Go Rollator 24 in", "MOR-3933190-24"),
        listing(2, "NEW! Rollator Morsemuma Go 61 cm FREE SHIPPING", "TBD", None),
        listing(3, "Orvane Morsemuma Go Rollator 26 in", "MOR-3933190-26"),
        listing(4, "Morsemmuma Go Rollator (MOR 393319024)", None, "Orvane"),
        listing(5, "Orvane Falbemos Go Rollator 24 in"),
        listing(6, "Falbemos Go Rollator 24 inch"),
        listing(7, None, None, None),
        listing(8, "", "", ""),
        listing(1, "Orvane Morsemuma Go Rollator 24 in", "MOR-3933190-24"),
    ]
    # words that name the brand and the kind are told by counting, so there must be some more of them
    rows += [listing(100 + i, f"Orvane {w} Rollator 2{i % 9} in") for i, w in enumerate(["Zulvatade", "Kenfarix", "Dulpenor", "Sormelix", "Balquaro", "Tenvolis", "Gorlamet", "Hulpadir"])]
    frame = spark.createDataFrame(rows, LISTING)
    assert {tuple(r) for r in product_pairs(frame).collect()} == {(1, 2), (1, 4), (2, 4), (5, 6)}
    assert product_groups(frame).count() == 16
    assert product_pairs(frame.limit(0)).count() == 0


def test_slips_find_the_word_that_fits(spark):
    """The most frequent word of a remainder has another code number; the next one fits."""
    words = [("horidela", 1, "7", ""), ("horidela" + "n", 90, "8", ""), ("horideal", 1, None, ""), ("horidella", 5, "7", ""), ("sulvorum", 1, "3", ""), ("sulvarum", 20, "4", ""), ("sulverum", 6, None, "")]
    got = {tuple(r) for r in respelled(spark.createDataFrame(words, "word string, n long, number string, kind string")).collect()}
    assert ("horidela", "horidella") in got and ("sulvorum", "sulverum") in got


# --- reference lists


def slow_distance(a, b):
    """Unrestricted Damerau-Levenshtein by the textbook recurrence."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last = {}
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            cost = a[i - 1] != b[j - 1]
            if not cost:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


WORD = st.text("abc", max_size=7)


@settings(max_examples=400, deadline=None)
@given(WORD, WORD, st.integers(0, 7))
def test_distance(a, b, most):
    true = slow_distance(a, b)
    assert distance(a, b, 20) == true
    assert (distance(a, b, most) == true) if true <= most else distance(a, b, most) > most


@settings(max_examples=100, deadline=None)
@given(st.lists(WORD, max_size=25), WORD, st.integers(0, 3))
def test_tree_finds_all(words, wanted, most):
    tree = BkTree()
    for i, w in enumerate(words):
        tree.add(w, i)
    found = sorted(i for _, _, ids in tree.within(wanted, most) for i in ids)
    assert found == [i for i, w in enumerate(words) if slow_distance(wanted, w) <= most]


ENTRIES = [(1, "Stainless Steel"), (2, "Carbon Fiber"), (3, "Zelstelund Mobility"), (4, "Grünsund"), (5, "Grünstein"), (6, "Ulgrizza Mobility"), (7, "Ulgrizza Laboratories")]


@pytest.mark.parametrize(
    "text, entry",
    [("stianless steel", 1), ("Steel, Stainless", 1), ("SS", 1), ("durable Stainless Steel frame", 1), ("Carbon Fibre (main body)", 2), ("The Zelstelund Mobility Company", 3), ("Zelstelund", 3), ("Zelstelund Mob.", 3), ("grunsund plant", 4), ("Ulgrizza Labs", 7), ("Grünstien", 5), ("N/A", None), ("", None), ("wicker", None), ("Xanbriquay", None)],
)
def test_match(text, entry):
    got = Matcher(ENTRIES, short_forms(ENTRIES)).best(text)
    assert (got and got[1]) == entry


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([c for _, c in ENTRIES]), st.integers(0, 30), st.sampled_from("abeilrst "))
def test_closest_is_the_least_within_the_threshold(name, at, letter):
    matcher = Matcher(ENTRIES, short_forms(ENTRIES))
    text = name[:at] + letter + name[at + 1 :]
    every = matcher.within(text)
    for form in matcher.candidates(text):  # every entry within the threshold of a reading is there
        for i, c in ENTRIES:
            far = threshold(form)
            assert distance(form, canonical.fold(c).replace(" ", ""), far) > far or i in every
    hit = matcher.ranked(text)
    assert (hit is None) == (not every) and (hit is None or hit == min((*rank, i) for i, rank in every.items()))


def test_map_to_list_shards_agree(spark):
    values = spark.createDataFrame([("f", "Stainles Steel", 5), ("f", "Carbon Fiber", 6), ("f", None, 7), ("g", "Stainless Steel", 8), ("f", "x" * 20_000, 9)], "spec_field string, value string, entry_no int")
    reference = spark.createDataFrame([(i, "f", c) for i, c in ENTRIES], "canon_id long, spec_field string, canonical string")
    runs = [{r.entry_no: (r.is_canonical, r.entry) for r in canonical.map_to_list(values, reference, "spec_field", "value", shard_size=size).collect()} for size in (20_000, 3)]
    assert runs[0] == runs[1] == {5: (False, 1), 6: (True, 2), 7: (False, 0), 8: (False, 0), 9: (False, 0)}
    assert {r.entry for r in canonical.map_to_list(values, reference.limit(0), "spec_field", "value").collect()} == {0}


def test_shards_know_the_whole_list(spark):
    """Short forms, abbreviations and ties of a list in shards come out as those of the whole list."""
    names = ["Kestral Industries", "Kestral Medical", "Orvane Mobility", "Orvane Mobile", "Talmere Healthcare", "Talmere Health Care Co", "Zolvane", "Zölvane-B", "Zolvane C", "Norvik Industrial", "Hulpadir Mobility", "Dulpenor Ind"]
    texts = ["Kestral", "Kestrel", "Orvane", "Kestral Ind", "Hulpadir", "hulpadr", "Orvane Mob", "Talmere Hlthcare", "zolvane d", "Zolvane-C", "ZOLVANE  B", "Norvik", "Made in Norvik Industrial", "Kestral Medcal", "Orvane Mobiliti", "Dulpenor", "HulpadirMobility"]
    reference = spark.createDataFrame([(i, "f", c) for i, c in enumerate(names, 1)], "canon_id long, spec_field string, canonical string")
    values = spark.createDataFrame([("f", t) for t in texts], "spec_field string, value string")
    runs = [{r.value: r.entry for r in canonical.map_to_list(values, reference, "spec_field", "value", shard_size=size).collect()} for size in (20_000, 4, 2)]
    assert runs[0] == runs[1] == runs[2]
    assert runs[0]["Kestral"] == 0 and runs[0]["Hulpadir"] == 11


# --- page furniture


def test_furniture():
    page = ["Skip to main content", "", "Orvane Padded Rollator", "The padded seat folds flat.", "Related items", "Talmere Washable Bath Bench $10.00", "Follow us", None]
    assert furniture(page, "https://a.example/p/orvane-padded-rollator-12") == [1, 5, 6, 7]
    assert furniture([]) == [] and furniture([None, " "]) == []
    assert Classifier().furniture([(page, None, None, None), ([], None, None, None)])[1] == []


def test_held_out_pages():
    """Accuracy on hand-labelled blocks that the tree was not trained with: each page in turn is left out."""
    from millrace.llm import boilerplate as B

    hand, ruled = B.hand_labelled(), B.ruled_pages()
    right = total = 0
    for k, (own, targets, rows) in enumerate(hand):
        lexicon, tree = B.fitted([p for j, p in enumerate(hand) if j != k] + ruled)
        told = tree.predict(B.np.array(B.block_features([B._Block(t, lexicon) for _, t in rows], own, targets))) > 0.5
        right += sum(bool(a) == b for a, (b, _) in zip(told, rows))
        total += len(rows)
    assert right / total >= 0.95


def test_site_targets(spark):
    """What at least a fiftieth of a site's pages link; a target of one page in a hundred isn't navigation."""
    from millrace.llm.boilerplate import site_targets

    rows = [(i, f"https://A.example/p/{i}", {"anchors": ["https://a.example/gift-cards/", None] + (["https://a.example/p/7"] if i == 3 else [])}) for i in range(100)]
    frame = spark.createDataFrame([*rows, (200, None, {"anchors": ["x"]}), (201, "https://b.example/", {"anchors": None})], "page_id long, source_url string, links struct<anchors:array<string>>")
    assert [tuple(r) for r in site_targets(frame).collect()] == [("a.example", "gift-cards")]



def test_furniture_tables(spark):
    pages = spark.createDataFrame([(1, "https://a/p/x-1", "Follow us\nA seat for the bath.", (["https://a/blog"],)), (2, None, None, None), (1, "https://a/p/x-1", "Follow us\nA seat for the bath.", (["https://a/blog"],))], "page_id long, source_url string, visible_text string, links struct<anchors:array<string>>")
    records = spark.createDataFrame([(5, None, ["Add to Cart", None, "Padded armrest"]), (6, None, None), (7, None, [])], "record_id long, source string, features_raw array<string>")
    assert {tuple(r) for r in all_furniture(pages, records).collect()} == {("visible_text", 1, 1), ("features_raw", 5, 1)}
    assert {r.page_id: r.body for r in main_bodies(pages).collect()} == {1: "A seat for the bath.", 2: None}
    assert all_furniture(pages.limit(0), records.limit(0)).count() == 0


# --- scans

VOCABULARY_WORDS = {w: 0.5 for w in "the wheel and side rail of chair must turn before use transport from with seat cushion self-locking order code store below".split()}
SCAN = "Orvane Chair User Manual\nThe vvheel and the s1de rail must tu-\nrn before use.\nStep 2\nTransp0rt the chair 2O m with the self-\nlocking seat cus-\n\fRev. A 12/2020\nPage 3 of 9\nOrvane Chair User Manual\nhion below the rail."


def test_flaws():
    found, paragraphs = flaws(SCAN, VOCABULARY_WORDS, {})
    assert set(found) == {
        (1, "running_header", ""), (2, "misread", "wheel"), (2, "misread", "side"), (2, "hyphen_break", "turn"), (5, "misread", "transport"), (5, "misread", "20"), (5, "hyphen_break", "self-locking"),
        (6, "hyphen_break", "cushion"), (7, "running_header", ""), (8, "page_number", ""), (9, "running_header", ""),
    }
    assert paragraphs == ["The wheel and the side rail must turn before use.", "Step 2", "Transport the chair 20 m with the self-locking seat cushion below the rail."]
    assert flaws("", {}, {}) == ([], [])
    assert label_lines([], {}) == ""


def test_lexicon_is_cleaned():
    assert set(clean_lexicon({"wheel": 0.5, "vvheel": 0.01, "s€at": 0.2, "2l": 0.1, "seat": 0.4})) == {"wheel", "seat"}


def test_flaw_table(spark):
    rows = [(i, SCAN, "x") for i in range(4)] + [(0, SCAN, "x"), (8, None, None), (9, "", None), (10, "wheel " * 40_000, None)]
    frame = spark.createDataFrame(rows, "pdf_id long, raw_text string, kind string")
    got = found_flaws(frame).where("kind in ('running_header', 'page_number')").groupBy("pdf_id").count().collect()
    assert {r.pdf_id: r["count"] for r in got} == {i: 4 for i in range(4)}
    assert found_flaws(frame.limit(0)).count() == 0


def test_rare_words_are_known(spark):
    """Words below the share that serves all texts: by the counts of all words, and by the other words of the text."""
    texts = [f"The wheel must turn before use." for _ in range(60)]
    texts += ["The iskarra door must turn.", "The anti-tip wheel must turn.", "The 1skarra wheel must turn, and so the d0or.", "The wheel and the anti-\ntip must turn."]
    texts += ["The Zulvatade must turn before Zulvatade use, Zulvafade wheel.", "The bolena wheel.", "The holena wheel."]
    frame = spark.createDataFrame(list(enumerate(texts)), "pdf_id long, raw_text string")
    got = {(r.pdf_id - 60, r.kind, r.fixed) for r in found_flaws(frame).collect()}
    assert got == {(2, "misread", "iskarra"), (2, "misread", "door"), (3, "hyphen_break", "anti-tip"), (4, "misread", "zulvatade")}


def test_repaired_agrees_with_the_flaws(spark):
    texts = [SCAN] * 4 + ["The wheel must turn before use."] * 50 + ["The 1skarra wheel must turn.", "The iskarra door must turn.", "The wheel and the anti-\ntip must turn.", "The anti-tip wheel.", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "pdf_id long, raw_text string")
    rows = repaired(frame).collect()
    told = {(r.pdf_id, f.line_no, f.kind, f.fixed) for r in rows for f in r.flaws}
    assert told == {tuple(r) for r in found_flaws(frame).collect()} and len(rows) == len(texts)
    by_id = {r.pdf_id: r.paragraphs for r in rows}
    assert by_id[54] == ["The iskarra wheel must turn."] and by_id[56] == ["The wheel and the anti-tip must turn."] and by_id[58] == by_id[59] == []


def test_rare_words_far_more_frequent(spark):
    counted = spark.createDataFrame([("w", "iskarra", 26), ("w", "iskarro", 1), ("w", "vornumic", 25), ("w", "vornumie", 1), ("w", "tallolero", 1), ("w", "tallotero", 1)], "kind string, value string, whole long")
    asks = spark.createDataFrame([(w,) for w in ("iskarro", "iskorra", "vornumie", "tallolero", "tallotero")], "ask string")
    assert {tuple(r) for r in rare_meanings(asks, counted, {}).collect()} == {("iskarro", "iskarra"), ("iskorra", "iskarra")}


# --- packing

HAVE_VOCABULARY = __import__("os").path.exists(VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20), st.sampled_from([64, 100]))
def test_plan_places_all(counts, capacity):
    patterns = packing.plan(counts, capacity)
    placed: dict = {}
    for pieces, times in patterns:
        assert sum(n for n, _ in pieces) <= capacity and times > 0
        for n, window in pieces:
            assert n <= window <= capacity
            placed[n] = placed.get(n, 0) + times
    assert placed == counts
    places = packing.Places(patterns, 4)
    used: dict = {}
    for n, c in counts.items():
        for rank in range(c):
            container, group, place, begin, window = places.find(n, rank)
            assert (container, place) not in used and begin + n <= capacity
            used[container, place] = (begin, n)
    for container in {c for c, _ in used}:
        at = 0
        for place in range(len([1 for c, _ in used if c == container])):
            begin, n = used[container, place]
            assert begin == at
            at += n


def test_tiers_shape_the_plan():
    """Full windows of a shorter tier go into a container whole; without tiers the pieces mix; the fill is the same."""
    counts = {40: 30, 16: 20, 9: 20, 7: 21, 25: 40, 64: 3, 3: 9}
    tiered, flat = packing.plan(counts, 100, [100, 25, 6]), packing.plan(counts, 100, [100])
    assert {p for p, _ in tiered} != {p for p, _ in flat} and {w for p, _ in flat for _, w in p} == {100}
    windows: dict = {}
    for pieces, times in tiered:
        inner: dict = {}
        for n, w in pieces:
            inner[w] = inner.get(w, 0) + n
        for w, total in inner.items():
            if w < 100:
                assert total % w == 0  # whole windows only
                windows[w] = windows.get(w, 0) + total // w * times
    assert windows[25] >= 30
    assert sum(t for _, t in tiered) <= sum(t for _, t in flat) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), min_size=1, max_size=20), st.integers(2, 9))
def test_step_groups_cost_about_the_same(counts, group_size):
    patterns = packing.plan(counts, 100)
    places = packing.Places(patterns, group_size)
    costs = [packing.container_cost(p) for p, times in sorted(patterns, key=lambda p: (-packing.container_cost(p[0]), p[0])) for _ in range(times)]
    groups = [0] * places.groups
    for container, c in enumerate(costs):
        groups[places.group(container)] += c
    assert max(groups) - min(groups) <= max(costs)


def test_packed(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([100, 250, 64, 36, 0, 1, 63] + [40] * 50)], "doc_id long, tokens long")
    rows = packing.packed(sizes, 100).collect()
    fill: dict = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) == 100 + 250 + 64 + 36 + 1 + 63 + 2000
    assert sorted((r.piece, r.tokens, r.text_start) for r in rows if r.doc_id == 1) == [(1, 100, 0), (2, 100, 100), (3, 50, 200)]
    assert len(fill) == 31  # no packing takes fewer: two pieces of 40 leave 20
    assert packing.packed(sizes.limit(0), 100).count() == 0


def test_ranks_are_whole(spark):
    rows = spark.createDataFrame([(i, 7) for i in range(500)], "doc_id long, tokens long")
    assert sorted(r["rank"] for r in packing.ranked(rows, "tokens", ["doc_id"], per_part=60).collect()) == list(range(500))


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary file")
def test_tokens_of_long_texts():
    text = "Torque the bolts of the bed rail, 20 N·m – twice.\n\n  Déjà vu " * 5000
    from millrace.llm.tokens import encoder

    assert count_tokens(text, VOCABULARY) == len(encoder(VOCABULARY).encode_ordinary(text))
    assert count_tokens("", VOCABULARY) == 0


# --- mixing


def highest_quotients(weights, seats, caps):
    got = {k: 0 for k in weights}
    for _ in range(seats):
        open_ = [k for k in weights if got[k] < caps.get(k, seats) and weights[k] > 0]
        if not open_:
            break
        got[max(open_, key=lambda k: (weights[k] / (2 * got[k] + 1), mixing._order(k)))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 50), min_size=1), st.integers(0, 60), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 20)))
def test_apportionment(weights, seats, caps):
    got = mixing.sainte_lague(weights, seats, {k: caps.get(k, seats) for k in weights})
    want = highest_quotients(weights, seats, {k: caps.get(k, seats) for k in weights})
    assert sum(got.values()) == sum(want.values())
    quotient = lambda m: sorted(weights[k] / (2 * i + 1) for k in m for i in range(m[k]))
    assert quotient(got) == pytest.approx(quotient(want))  # the same quotients win; ties may fall otherwise


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary file")
def test_mixed(spark):
    docs = [(i, "a", "word " * (5 + i % 7)) for i in range(400)] + [(1000 + i, "b", "word " * 9) for i in range(40)] + [(5000, None, "x"), (5001, "z", "x"), (5002, "a", None), (0, "a", "word " * 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixed(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets, VOCABULARY, shard_tokens=400)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.repeats <= (1 if r.source == "a" else 3) for r in rows)
    share = {r.source: r.actual_share for r in shares.collect()}
    assert share["c"] == 0 and abs(share["a"] - 5 / 9) < 0.03 and abs(share["b"] - 4 / 9) < 0.03
    none, empty = mixing.mixed(spark.createDataFrame([], "doc_id long, source string, text string"), targets, VOCABULARY)
    assert none.count() == 0 and {r.tokens for r in empty.collect()} == {0}


@pytest.mark.skipif(not HAVE_VOCABULARY or not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no vocabulary file or tables")
def test_shares_of_unequal_sources(spark):
    """Every source with documents is within half a point of its target, the one with four documents too."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    _, shares = mixing.mixed(read("documents"), read("mix_targets"), VOCABULARY)
    rows = shares.collect()
    whole = sum(r.target_share for r in rows if r.documents)
    assert sum(r.documents > 0 for r in rows) >= 8
    assert max(abs(r.actual_share - r.target_share / whole) for r in rows if r.documents) < 0.005


# --- encodings

TEXTS = ["Prüfen Sie vor jeder Benutzung die Fußraste – höchstens 40 °C.", "N’essayez pas de démonter l’accoudoir à l’hôpital.", "Press “SET” for 3 seconds; the user’s seat is 20 × 18 in.", "Zestaw ułatwia wykonanie ćwiczeń, obciążenie części.", "A manutenção não é necessária. ATENÇÃO: FIXAÇÃO."]
WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850")]


def garble(text, right, wrong):
    return "".join(encoding._table(wrong)[1][b] for b in text.encode(right))


@pytest.mark.parametrize("right, wrong", WAYS)
@pytest.mark.parametrize("text", TEXTS)
def test_restored_round_trip(text, right, wrong):
    bad = garble(text, right, wrong)
    assert encoding.restore(bad) == (True, text)
    assert encoding.restore(f"Plain words. {bad}\nNothing here.")[1] == f"Plain words. {text}\nNothing here."
    assert encoding.restore(text) == (False, None)


def test_restored_twice_and_single():
    twice = garble(garble(TEXTS[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert encoding.restore(twice) == (True, TEXTS[0])
    assert encoding.restore(TEXTS[0].replace("–", "-").encode("latin-1").decode("cp437")) == (True, TEXTS[0].replace("–", "-"))
    assert encoding.restore(TEXTS[3].encode("cp1250").decode("cp1252")) == (True, TEXTS[3])
    assert encoding.restore("l�eau ti�de") == (True, None)
    assert encoding.restore("If the printer shows “Ã©” where “é” belongs, choose another page.") == (False, None)
    assert encoding.restore("caf&amp;eacute; &eacute;") [0] is True


def test_restored_table(spark):
    bad = garble(TEXTS[1], "utf-8", "cp1252")
    rows = [(1, bad, "x"), (1, bad, "x"), (2, TEXTS[1], None), (3, None, None), (4, "", None), (5, "a�b", None), (6, (TEXTS[0] + " ") * 2000, None)]
    got = {tuple(r) for r in encoding.restored_digest(spark.createDataFrame(rows, "doc_id long, text string, restored string")).collect()}
    assert got == {(1, encoding.digest(TEXTS[1])), (5, "")}
    assert encoding.restored_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0

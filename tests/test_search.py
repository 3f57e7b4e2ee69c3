"""F: full-text search, radius and nearest neighbours."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumencat.functions import geo, stemming, text
from lumencat.functions.stemming import with_stems
from lumencat.functions.geo import EARTH_RADIUS
from lumencat.operators import nearby, search
from tests import porter2
from tests.catalog_rows import ASSETS, BARE, rows
from tests.catalog_rows import catalog as make


@pytest.fixture(scope="module")
def c(spark):
    return make(spark, BARE)


# Pairs that the published description of the stemmer gives or implies.
_PAIRS = [
    ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
    ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("consistency", "consist"), ("knightly", "knight"),
    ("generously", "generous"), ("skies", "sky"), ("news", "news"), ("by", "by"), ("say", "say"), ("cry", "cri"),
    ("national", "nation"), ("relational", "relat"), ("succeed", "succeed"),
]


def test_stems(spark):
    assert [porter2.stem(word) for word, _ in _PAIRS] == [stem for _, stem in _PAIRS]
    got = with_stems(spark.createDataFrame(_PAIRS, "term string, want string"))
    assert [tuple(r) for r in got.where("stem != want").collect()] == []


# From the published sample vocabulary of the stemmer, with its output.
_SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol
consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc
constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit
knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()


def test_stems_of_the_published_sample(spark):
    words = list(zip(_SAMPLE[::2], _SAMPLE[1::2]))
    got = with_stems(spark.createDataFrame(words, "term string, stem string").withColumnRenamed("stem", "want"))
    assert [tuple(r) for r in got.where("stem != want").collect()] == [] and got.count() == len(words)


def test_stems_equal_the_word_by_word_form(spark):
    """Every suffix and exception on many roots, odd letters and digits."""
    rng = random.Random(2)
    roots = ["", "a", "y", "gener", "commun", "arsen", "run", "hop", "fly", "say", "beaut", "eas", "xy", "é", "naïv", "1", "ss", "oy", "yy"]
    roots += ["".join(rng.choice("aeiouybcdlnrstz") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    ends = ["", *stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, "s", "ies", "ied", "us", "sses", "ed", "ing", "eedly", "eed", "ingly", "edly",
            "ated", "bling", "izes", "y", "e", "ll", "lle", "li", "ogi", "alli", "alize", "'s", ".mp4"]
    words = sorted({r + e for r in roots for e in ends} | set(stemming.WHOLE) | set(stemming.KEPT_AFTER_PLURAL) - {""})
    got = with_stems(spark.createDataFrame([(w,) for w in words], "term string"))
    assert [(r.term, r.stem, porter2.stem(r.term)) for r in got.collect() if r.stem != porter2.stem(r.term)] == []


def test_terms_and_their_counts(spark):
    df = spark.createDataFrame([
        (1, "The Cats, the CAT; running-runs!"), (2, ""), (3, None), (4, "..."), (5, "clip1.mp4 a.b clip1.mp4"),
    ], "id long, text string")

    def counted(config="simple", keep=False):
        return {(r.id, r.term): r.tf for r in text.counted_terms(df, "text", config, keep).collect()}

    assert counted() == {
        (1, "the"): 2, (1, "cats"): 1, (1, "cat"): 1, (1, "running"): 1, (1, "runs"): 1,
        (5, "clip1"): 2, (5, "mp4"): 2, (5, "a"): 1, (5, "b"): 1,
    }
    assert counted("english") == {(1, "cat"): 2, (1, "run"): 2, (5, "clip1"): 2, (5, "mp4"): 2, (5, "b"): 1}
    assert counted(keep=True)[(5, "clip1.mp4")] == 2


def test_counted_terms_equal_grouping(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(200)))) for i in range(100)]
    got = text.counted_terms(spark.createDataFrame(texts, "id long, text string"), "text")
    want = Counter((i, w) for i, t in texts for w in t.split())
    assert {(r.id, r.term): r.tf for r in got.collect()} == want


@pytest.mark.parametrize("config, keep", [("simple", False), ("english", False), ("english", True)])
def test_search(c, config, keep):
    index = search.build_index(c.assets, c.links, c.tags, config, keep)

    def found(query):
        return [r.id for r in search.search(c.assets, c.links, c.tags, index, query, config, keep).collect()]

    assert found("Nature") == [1, 2, 4]
    assert found("sunset") == [1]
    assert found("nature beach") == [4]
    assert found("nature interview") == []
    assert found("") == []
    assert found("the") == []


def test_rank_prefers_class_a_and_more_hits(spark):
    postings = spark.createDataFrame(
        [(1, "B", "x", 1), (2, "A", "x", 1), (3, "A", "x", 3), (4, "B", "x", 1), (5, "C", "y", 1)],
        "id long, weight string, term string, tf long",
    )
    for scorer in ("weighted_tf", "bm25f"):
        order = [r.id for r in search.rank(search.match(postings, "x", scorer=scorer)).collect()]
        assert order[0] in (2, 3) and order[-2:] == [1, 4]
    assert [r.id for r in search.rank(search.match(postings, "x")).collect()] == [3, 2, 1, 4]


def test_batch_equals_single_queries(c, spark):
    index = search.build_index(c.assets, c.links, c.tags)
    queries = ["nature", "nature landscape", "unknown nature", "", "beach1 jpg nature"]
    batch = search.match_batch(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"))
    single = [(q, r.id, r.score) for q, t in enumerate(queries) for r in search.match(index, t).collect()]
    assert rows(batch) == sorted(single, key=repr)


def test_written_index_skips_by_term(c, spark, tmp_path):
    index = search.build_index(c.assets, c.links, c.tags)
    search.write_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert rows(stored, *index.columns) == rows(index)
    plan = search.match(stored, "nature")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,nature)" in plan or "In(term, [nature])" in plan


def _sphere(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, a)))


def _places(kind: str) -> list[tuple[int, float, float]]:
    rng = random.Random(11)
    if kind == "spread":
        return [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(3000)]
    # One crowded block of a few metres, copies of one place, and a few far points.
    crowd = [(i, 10 + rng.random() * 1e-4, 48 + rng.random() * 1e-4) for i in range(2000)]
    copies = [(2000 + i, -179.9999, -40.0) for i in range(500)]
    return crowd + copies + [(2500 + i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(100)]


CENTRES = [
    (0, 10.00005, 48.00005), (1, 10.5, 48.2), (2, 179.99995, -40.0), (3, 0.0, 88.5), (4, -120.0, -89.9),
    (5, 10.00005, 48.00005), (6, -179.9999, -40.0),
]


@pytest.mark.parametrize("kind", ["spread", "crowded"])
@pytest.mark.parametrize("radius", [5.0, 40_000.0, 900_000.0])
def test_nearby_join_equals_brute_force(spark, kind, radius):
    places = _places(kind)
    got = nearby.nearby_join(
        spark.createDataFrame(places, "id long, lon double, lat double"),
        spark.createDataFrame(CENTRES, "centre_id long, lon double, lat double"), radius,
    )
    want = {(c, i) for c, clon, clat in CENTRES for i, lon, lat in places if _sphere(lon, lat, clon, clat) <= radius}
    pairs = [(r.centre_id, r.id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("radius", [-5.0, 0.3, 9_000_000.0, 3e7])
def test_nearby_join_at_any_radius(spark, radius):
    """Also where one is reached exactly, at the poles, on the date line and with keys that repeat or lack."""
    places = _places("spread")[:300] + [(5000, 0.0, 90.0), (5001, 77.0, 90.0), (5002, 180.0, 0.0), (5003, -180.0, 0.0), (5003, 12.0, -90.0)]
    centres = CENTRES + [(20, 45.0, 90.0), (20, -180.0, 0.0), (None, 3.0, -90.0)]
    assets = spark.createDataFrame(places, "id long, lon double, lat double")
    asked = spark.createDataFrame(centres, "centre_id long, lon double, lat double")
    want = Counter((c, i) for c, clon, clat in centres for i, lon, lat in places if _sphere(lon, lat, clon, clat) <= radius)
    assert Counter((r.centre_id, r.id) for r in nearby.nearby_join(assets, asked, radius).collect()) == want
    one = spark.createDataFrame([(1, 10.0, 20.0)], "centre_id long, lon double, lat double")
    for r in nearby.nearby_join(assets, one, 3e7).orderBy("distance").limit(3).collect():
        assert r in nearby.nearby_join(assets, one, r.distance).collect()


def test_tenths_equal_rounding(spark):
    rng = random.Random(9)
    near = [n / 20 + d for n in range(-50, 400) for d in (0.0, 1e-17, 1e-9, -1e-9, 1e-15)] + [x * 0.1 + 0.05 for x in range(10_000_000, 10_003_000)]
    values = near + [rng.uniform(0, 2.1e7) for _ in range(5000)] + [-0.0, -1e-9, 1e8, 123456789012.35, 1e300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", geo.tenths(F.col("v")).alias("got"), F.round("v", 1).alias("want"))
    assert [(r.v, r.got, r.want) for r in df.collect() if repr(r.got) != repr(r.want)] == []


def test_centres_are_planned_at_the_size_of_their_copies(spark, tmp_path):
    """27 cells around each centre are not broadcast because one would be small enough."""
    rng = random.Random(5)
    for name, n, key in (("places", 30_000, "id"), ("centres", 500, "centre_id")):
        rows = [(i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(n)]
        spark.createDataFrame(rows, f"{key} long, lon double, lat double").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    places, centres = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("places", "centres"))
    size = int(centres._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    name = "spark.sql.autoBroadcastJoinThreshold"
    given = spark.conf.get(name)
    spark.conf.set(name, str(10 * size))
    try:
        found = nearby.nearby_join(places, centres, 300_000.0)
        got = Counter((r.centre_id, r.id) for r in found.collect())
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, given)
    assert got == Counter((r.centre_id, r.id) for r in nearby.nearby_join(places, centres, 300_000.0).collect())


@pytest.mark.parametrize("crowd", [8, nearby.CROWD])
@pytest.mark.parametrize("kind", ["spread", "crowded", "few"])
def test_knn_join_equals_brute_force(spark, kind, crowd):
    places = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 50.0, 0.0)] if kind == "few" else _places(kind)
    df = spark.createDataFrame([*places, (9_999, None, None)], "id long, lon double, lat double")
    centres = spark.createDataFrame(CENTRES, "centre_id long, lon double, lat double")
    want = {
        (c, rank, i)
        for c, clon, clat in CENTRES
        for rank, (_, i) in enumerate(sorted((math.sqrt((lon - clon) ** 2 + (lat - clat) ** 2), i) for i, lon, lat in places)[:5], 1)
    }
    assert {(r.centre_id, r.rank, r.id) for r in nearby.knn_join(df, centres, 5, crowd).collect()} == want


def test_nearby_and_knn_on_the_catalog(c):
    assert [(r.id, round(r.distance, 3)) for r in nearby.knn(c.assets, -122.4194, 37.7749, 2).collect()] == [(1, 0.0), (2, 15.666)]
    # An asset without a place comes last in the nearest and never within a radius.
    assert [r.id for r in nearby.knn(c.assets, -122.4194, 37.7749, 6).collect()][-1] == 6
    assert [r.id for r in nearby.nearby(c.assets, 37.7749, -122.4194).collect()] == [1]
    by_distance = sorted(ASSETS, key=lambda a: _sphere(a[5], a[6], -122.4194, 37.7749))
    assert [r.id for r in nearby.nearby(c.assets, 37.7749, -122.4194, 2.1e7).collect()] == [a[0] for a in by_distance]


def test_radius_is_inclusive_and_crosses_the_date_line(spark):
    df = spark.createDataFrame([(1, 179.9, 0.0), (2, -179.9, 0.0), (3, 0.0, 89.9), (4, 180.0, 89.9)], "id long, lon double, lat double")
    edge = nearby.nearby(df, 0.0, 179.9, 1e6).where(F.col("id") == 2).first().distance
    assert [r.id for r in nearby.nearby(df, 0.0, 179.9, edge).collect()] == [1, 2]
    assert [r.id for r in nearby.nearby(df, 89.9, 0.0, 30_000).collect()] == [3, 4]


def test_places_that_are_not_on_earth(spark):
    """NaN, infinite and out-of-range coordinates answer nothing and hide no answer."""
    from lumencat.operators import nearby

    wrong = [(float("nan"), 1.0), (1.0, float("inf")), (200.0, 1.0), (1.0, -91.0), (None, 1.0)]
    data = [(k, *wrong[k % 5]) for k in range(20)] + [(100 + k, float(k), 1.0) for k in range(20)]
    assets = spark.createDataFrame(data, "id long, lon double, lat double").selectExpr("*", "'f' AS file_name")
    centres = spark.createDataFrame([(1, 0.0, 1.0), (2, float("nan"), 0.0), (3, 500.0, 0.0)], "centre_id long, lon double, lat double")
    got = nearby.knn_join(assets, centres, 5)
    assert sorted((r.centre_id, r["rank"], r.id) for r in got.collect()) == [(1, n + 1, 100 + n) for n in range(5)]
    assert [r.id for r in nearby.knn(assets, 0.0, 1.0, 3).collect()] == [100, 101, 102]
    for radius, ids in ((0, {100}), (150_000, {100, 101})):
        assert {r.id for r in nearby.nearby_join(assets, centres, radius).collect()} == ids
        assert {r.id for r in nearby.nearby(assets, 1.0, 0.0, radius).collect()} == ids


def test_a_search_for_stems_writes_no_postings(spark, tmp_path):
    """The terms asked for reach the dictionary, so postings of other words are not made."""
    from lumencat.plans import queries

    spark.createDataFrame([(1, "Running the ens", "en", "web"), (2, "ran", "fr", "web")], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = queries.text_match_english(spark, str(tmp_path))
    assert found.collect() == []
    assert "/postings-" not in " ".join(found.inputFiles())


def test_words_that_no_step_can_change_are_their_own_stems(spark):
    """The endings that are looked for are those of every rule: a word kept back from the stemmer has itself as stem."""
    rng = random.Random(3)
    ends = ["", *stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, *(a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")]
    roots = ["", "y", "gener", "é", "1", *("".join(rng.choice("aeiouybcdlnrstz") for _ in range(rng.randrange(1, 7))) for _ in range(20))]
    words = sorted({r + e for r in roots for e in ends} | set(stemming.WHOLE) | set(stemming.KEPT_AFTER_PLURAL) - {""})
    kept = spark.createDataFrame([(w,) for w in words], "term string").where(~stemming.may_change(F.col("term"))).collect()
    assert len(kept) > len(words) // 4
    assert [r.term for r in kept if porter2.stem(r.term) != r.term] == []


def test_only_words_that_may_change_are_stemmed(spark, monkeypatch):
    stemmed = []
    monkeypatch.setattr(text, "with_stems", lambda words: stemmed.extend(r.term for r in words.collect()) or with_stems(words))
    rows = spark.createDataFrame([(1, "runs Run, running dog zebu dogs"), (2, "dog"), (2, "dog"), (3, None)], "id long, text string")
    got = sorted(map(tuple, text.counted_terms(rows, "text", "english").collect()))
    assert got == [(1, "dog", 2), (1, "run", 3), (1, "zebu", 1), (2, "dog", 2)]
    assert sorted(stemmed) == ["dogs", "running", "runs"]

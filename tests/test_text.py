"""Classifiers, cleaning, identity of addresses, dates and scores on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, hashing, scoring, text, times, urls
from tidewatch.functions.places_text import locate
from tidewatch.operators.views import FilterSpec, in_range, lens


def values(spark, inputs, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_topics_are_tried_in_order(spark):
    titles = ["Phishing crew targets the navy", "Navy and troops on exercise", "Troops guard embassy", "Embassy reopens",
              "Cyberspace festival", "DDOS hits ministry"]
    assert values(spark, titles, text.classify_topic) == ["cyber", "maritime", "military", "geopolitical", None, "cyber"]


def test_severity_thresholds(spark):
    df = spark.createDataFrame([("calm", -10.0), ("calm", -9.9), ("calm", -5.0), ("calm", 5.0), ("calm", 0.0), ("deadly", 9.0)], "t string, n double")
    got = [r[0] for r in df.select(text.classify_severity(F.col("t"), F.col("n"))).collect()]
    assert got == ["critical", "escalating", "escalating", "deesc", "watching", "critical"]


def test_html(spark):
    pages = ["<p>One<br/>two</p><script>x<y</script> &eacute;&amp;&lt;", "<STYLE a=1>\n.p{}\n</STYLE><b>bo</b>ld"]
    assert values(spark, pages, text.html_to_text) == ["One two é&<", "bold"]


def test_entities_without_a_semicolon_stay_where_asked(spark):
    pages = ["<b>a</b> &amp &amp; &copy2 &copy; &#65; &#x42; &#65 &nosuch; &am", None]
    assert values(spark, pages, lambda c: text.html_to_text(c, unclosed=False)) == ["a &amp & &copy2 © A B &#65 &nosuch; &am", None]
    assert values(spark, pages[:1], text.html_to_text) == ["a & & ©2 © A B A &nosuch; &am"]


def test_canonical_urls(spark):
    raw = ["HTTPS://x/y", "https://User:pw@Ex.ample:443/a?B=c#d", "http://h.example:8080", "http://h.example:80/", "ftp://h/x", "https://", "http://h.example?q=1"]
    assert values(spark, raw, urls.canonical) == [
        None, "https://ex.ample/a?B=c", "http://h.example:8080/", "http://h.example/", None, None, "http://h.example/?q=1",
    ]


def test_outlet_host_drops_every_www_and_keeps_the_port(spark):
    raw = ["https://www.a.example:81/x", "http://www.b.www.example/", "no address"]
    assert values(spark, raw, urls.outlet_host) == ["a.example:81", "b.example", "no address"]


def test_name_uid_layout(spark):
    uids = values(spark, ["a", "b"], lambda v: urls.name_uid("event", v))
    assert len(set(uids)) == 2
    import uuid
    assert all(uuid.UUID(u).version == 5 and uuid.UUID(u).variant == uuid.RFC_4122 for u in uids)


def test_dates(spark):
    raw = ["Tue, 10 Sep 2024 10:00:00 GMT", "10 Sep 2024 10:00 +0200", "2024-09-10T10:00:00Z", "2024-09-10T10:00:00+02:00", "2024-09-10",
           "soon", "", "Tue, 10 Sep 2024 06:00:00 EDT"]
    noon = 1_725_962_400_000
    assert values(spark, raw, times.parse_pub_date) == [noon, noon - 7_200_000, noon, noon - 7_200_000, noon - 36_000_000, None, None, noon]
    seen = ["20240910T100000Z", "20240910", "20249910T100000Z", "x"]
    assert values(spark, seen, times.parse_seendate) == [noon, noon - 36_000_000, None, None]


def test_confidence_decays_in_whole_points(spark):
    df = spark.createDataFrame([(80, 1, 0.0), (80, 3, 0.0), (80, 9, 0.0), (80, 1, 30.0), (40, 1, 500.0)], "q int, n int, h double")
    got = [r[0] for r in df.select(scoring.confidence(F.col("q"), F.col("n"), F.col("h"))).collect()]
    assert got == [51, 87, 91, 39, 18]


MUST_ABSTAIN = [
    "Storm passes Washington overnight", "Paris Hilton opens studio", "Crash in Berlin and near Prague", "Fire at London Road depot",
    "Minister visits China", "Meeting in paris next week", "Talks in Oslo or Geneva", "Protest in Georgia", "Delegates in Rome, in Cairo",
]
MUST_RESOLVE = {
    "Explosion in Oslo": ("Oslo", "city"), "Clashes near New Delhi tonight": ("New Delhi", "city"), "Ship seized in the Red Sea": ("Red Sea", "region"),
    "Blackout across TÜRKIYE": ("TÜRKIYE", "country"), "Hearing in the US": ("US", "country"), "Storm in Mexico City": ("Mexico City", "city"),
    "Tankers turn via Hormuz Keeps Below": ("Hormuz", "region"), "China holds talks in Geneva": ("Geneva", "city"),
}


def test_headlines(spark):
    titles = [*MUST_ABSTAIN, *MUST_RESOLVE]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = {r["title"]: r["p"] for r in locate(df, "title", None, "p").select("title", "p").collect()}
    assert [t for t in MUST_ABSTAIN if got[t] is not None] == []
    assert {t: (got[t]["evidence"], got[t]["scope"]) for t in MUST_RESOLVE if got[t]} == MUST_RESOLVE


def test_ledes_need_length_and_one_country(spark):
    rows = [("Update", "Rescue teams worked in Lagos and at Lagos airport all day."), ("Update", "Short note in Lagos."),
            ("Update", "Officials in Paris spoke with counterparts in Berlin today."), ("Update", "Crowds in Munich and in Berlin marched on Sunday.")]
    df = spark.createDataFrame(rows, "title string, summary string")
    got = [r["p"]["evidence"] if r["p"] else None for r in locate(df, "title", "summary", "p").collect()]
    assert got == ["Lagos", None, None, "Berlin"]  # equal length: dictionary order decides, and Berlin stands before Munich


def test_exact_numbers_in_canonical_json(spark):
    df = spark.createDataFrame([(50.0,), (0.1,), (1e-7,), (1.5e-7,), (1e21,), (123456789012345680000.0,), (-0.0,), (1e-6,)], "v double")
    got = [r[0] for r in df.select(hashing.number_text(F.col("v"), exact=True)).collect()]
    assert got == ["50", "0.1", "1e-7", "1.5e-7", "1e+21", "123456789012345680000", "0", "0.000001"]


def test_fingerprint_matches_plain_json(spark):
    import hashlib
    df = spark.createDataFrame([('q"é\n', 2.0)], "s string, n double")
    got = df.select(hashing.fingerprint({"b": F.col("s")}, {"a": F.col("n")})).first()[0]
    assert got == hashlib.sha256('{"a":2,"b":"q\\"é\\n"}'.encode()).hexdigest()


def test_time_edges(spark):
    now = 1_726_000_000_000
    df = spark.createDataFrame([(now - 86_400_000,), (now - 86_400_001,), (now,), (now + 1,), (None,)], "ts long").withColumn("ingested_at", F.col("ts"))
    assert [r[0] for r in df.select(in_range("24h", now)).collect()] == [True, False, True, False, None]
    assert [r[0] for r in df.select(lens("emerging", now)).collect()] == [True, True, True, False, False]


def test_filter_spec_falls_back_on_bad_values():
    spec = FilterSpec.parse({"topic": "sports", "sev": "critical", "event": "-4", "src": " all ", "q": "x" * 300})
    assert (spec.topic, spec.sev, spec.event, spec.src, len(spec.q)) == ("all", "critical", None, "all", 200)
    assert FilterSpec.parse({"event": "17"}).event == 17


@pytest.mark.parametrize("box, want", [((179.0, -1.0, -179.0, 1.0), (0.0, -180.0, 156)), ((0.0, 0.0, 0.1, 0.1), (0.05, 0.05, 50))])
def test_box_circle(spark, box, want):
    west, south, east, north = map(F.lit, box)
    c = spark.range(1).select(geo.box_circle(west, south, east, north).alias("c")).first()["c"]
    assert (round(c["lat"], 3), round(c["lon"], 3), c["radius_km"]) == want

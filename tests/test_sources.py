"""Landed documents: feeds, states, regions, previous trails."""

import os

from pyspark.sql import functions as F

from tidewatch.sources import feeds, records

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://m/"><channel><title>T</title>
<item><title>First &amp; last</title><link> https://a.example/1 </link><pubDate>Tue, 10 Sep 2024 10:00:00 GMT</pubDate>
<description>&lt;p&gt;Hello &amp;eacute;&lt;/p&gt;</description><enclosure url="https://i.example/e.png" type="image/png"/></item>
<item><title>No link at all</title></item>
<item><link>https://a.example/2</link><media:content url="https://i.example/w.jpg" type="image/jpeg" width="800"/></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>Entry</title>
<link rel="self" href="https://no.example/"/><link href="https://b.example/1"/><updated>2024-09-10T10:00:00Z</updated>
<summary>Short</summary></entry></feed>"""


def land(folder, feed, name, body):
    path = f"{folder}/feed={feed}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", encoding="utf-8") as out:
        out.write(body)


def test_feed_items_and_status(spark, folder):
    land(folder, "BBC World", "1.xml", ATOM)
    land(folder, "KrebsOnSecurity", "1.xml", RSS)
    land(folder, "NPR World", "1.xml", "<html><body><p>down</p></body></html>")
    land(folder, "gCaptain", "1.xml", "<rss><channel><title>empty</title></channel></rss>")
    land(folder, "Dark Reading", "1.xml", "<rss><channel><item>")
    items = feeds.read_feed_items(spark, folder).orderBy("seq").collect()
    assert [(r["source"], r["topic"], r["title"], r["link"]) for r in items] == [
        ("KrebsOnSecurity", "cyber", "First & last", "https://a.example/1"), ("KrebsOnSecurity", "cyber", "(untitled)", "https://a.example/2"),
        ("BBC World", "geopolitical", "Entry", "https://b.example/1"),
    ]
    assert [r["published_ms"] for r in items] == [1_725_962_400_000, None, 1_725_962_400_000]
    assert [r["description"] for r in items] == ["Hello é", "", "Short"]
    assert [r["media_image"] for r in items] == ["https://i.example/e.png", "https://i.example/w.jpg", ""]
    status = {r["feed"]: (r["items"], r["failed"]) for r in feeds.read_source_status(spark, folder).collect()}
    assert status["KrebsOnSecurity"] == (3, False) and status["gCaptain"] == (0, False)
    assert status["NPR World"][1] and status["Dark Reading"][1] and status["BleepingComputer"][1]


def write(folder, body):
    with open(f"{folder}/x.json", "w", encoding="utf-8") as out:
        out.write(body)
    return folder


def test_states_regions_and_previous_trails(spark, folder):
    rows = records.read_states(spark, write(folder, '{"time":100,"states":[["AB ","C","X",1,95,1.5,2.5,10,false,3,4,null],["short"]]}')).collect()
    assert (rows[0]["icao24"], rows[0]["lon"], rows[0]["clock"], rows[1]["n_fields"]) == ("AB ", "1.5", 100_000, 1)
    for body in ('[{"kind":"country","name":"A"}]', '{"regions":[{"kind":"country","name":"A"}]}'):
        region = records.read_regions(spark, write(folder, body)).first()
        assert (region["region_pos"], region["kind"], region["name"]) == (0, "country", "A")
    assert records.read_previous_trails(spark, f"{folder}/absent").count() == 0
    previous = records.read_previous_trails(spark, write(folder, '{"aircraft":[{"id":"a"}],"trails":{"a":[[1,2,3000],[1,2]]}}')).first()
    assert previous["id"] == "a" and [tuple(p) for p in previous["trail"]] == [(1.0, 2.0, 3000)]


def test_articles_from_landed_json(spark, folder):
    body = '{"articles":[{"title":"T","url":"u","seendate":"20240910T100000Z","lat":"1","location":{"fullName":"X","countryCode":"de"}},{"title":"U"}]}'
    rows = records.read_articles(spark, write(folder, body)).orderBy("seq")
    assert [r["title"] for r in rows.collect()] == ["T", "U"] and rows.filter(F.col("lat") == "1").count() == 1

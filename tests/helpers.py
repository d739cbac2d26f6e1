"""Small builders for article batches."""

import json
import tempfile

from tidewatch.schemas import ARTICLES

AS_OF = 1_726_000_000_000


def article(seq, title, url, **over):
    row = {
        "seq": seq, "title": title, "url": url, "domain": "paper.example", "language": "English", "tone": "0.0",
        "seendate": "20240910T100000Z", "location": ("Lyon", "fr"), "lat": "45.76", "long": "4.84", "rss_topic": None,
        "rss_source": None, "rss_description": None, "media_image": None, "video_url": None, "socialimage": None,
    }
    row.update(over)
    place = row["location"]
    return {**row, "location": {"fullName": place[0], "countryCode": place[1]}}


def batch(spark, *rows):
    """Articles as they land: one JSON record per line."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/batch.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    return spark.read.schema(ARTICLES).json(folder)

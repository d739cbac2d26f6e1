"""The alias trie: longest and leftmost matches, ambiguity, offsets, roles, against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import aliases as A

ALIASES = [
    ("United Nations", "organization", "un"), ("United", "organization", "united-airlines"), ("United Nations Security Council", "organization", "unsc"),
    ("Georgia", "country", "GE"), ("Georgia", "region", "US-GA"), ("Côte d'Ivoire", "country", "CI"), ("Baltic", "region", "baltic"), ("  ", "region", "none"),
    ("Nations United", "organization", "nu"), ("Baltic", "region", "baltic"),
]


def table(spark):
    return spark.createDataFrame(ALIASES, "alias string, kind string, value string")


def by_hand(text):
    """Leftmost-longest scan over words."""
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    senses = {}
    for alias, kind, value in ALIASES:
        spelled = tuple(w.lower() for w in re.findall(r"[^\W_]+", alias))
        if spelled:
            senses.setdefault(spelled, set()).add((kind, value))
    found, i = [], 0
    while i < len(words):
        for size in range(A.MOST_WORDS, 0, -1):
            hit = senses.get(tuple(w for w, _, _ in words[i : i + size])) if i + size <= len(words) else None
            if hit:
                kinds, values = {k for k, _ in hit}, {v for _, v in hit}
                start, end = words[i][1], words[i + size - 1][2]
                found.append((kinds.pop() if len(kinds) == 1 else None, values.pop() if len(hit) == 1 else None, text[start:end], start, end))
                i += size
                break
        else:
            i += 1
    return found


TEXTS = [
    "The United Nations Security Council met; united nations security; UNITED states.", "Georgia on my mind", "En Côte d'Ivoire 😀 the BALTIC sea, baltic, Baltics",
    "nations united nations united", "", None, "...", "an attack on the Baltic and against Georgia", "united", "unitednations united_nations",
]


def test_mentions_equal_a_plain_scan(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string")
    got = {}
    for r in A.alias_mentions(docs, "id", "body", table(spark)).collect():
        got.setdefault(r.id, []).append((r.kind, r.value, r.raw, r.start, r.end))
    assert {i: sorted(x, key=lambda m: m[3]) for i, x in got.items()} == {i: by_hand(t) for i, t in enumerate(TEXTS) if t and by_hand(t)}


def test_no_texts_no_aliases_and_long_aliases(spark):
    docs = spark.createDataFrame([(1, "United")], "id long, body string")
    assert A.alias_mentions(docs.limit(0), "id", "body", table(spark)).count() == 0
    assert A.alias_mentions(docs, "id", "body", table(spark).limit(0)).count() == 0
    with pytest.raises(A.AliasTooLong):
        A.alias_trie(spark.createDataFrame([("a b c d e f g h i", "region", "x")], "alias string, kind string, value string"))


def test_roles(spark):
    docs = spark.createDataFrame([(1, "An attack on the Baltic. Later Georgia and the Baltic", "news.example.org")], "id long, body string, host string")
    found = A.alias_mentions(docs, "id", "body", table(spark))
    rows = A.with_roles(found, docs, "id", "body", "summary", F.col("host")).orderBy("start").collect()
    assert [(r.raw, r.role) for r in rows] == [("Baltic", "affected"), ("Georgia", "uncertain"), ("Baltic", "mentioned")]
    rows = A.with_roles(found, docs, "id", "body", "title", F.col("host")).orderBy("start").collect()
    assert [r.role for r in rows] == ["affected", "uncertain", "subject"]
    own = spark.createDataFrame([("domain", "example.org"), ("domain", "other.org"), ("cve", "x")], "kind string, value string").select(
        A.mention_role(F.col("kind"), F.col("value"), F.lit("title"), F.lit("news.example.org"), F.lit("")).alias("r"))
    assert [r.r for r in own.collect()] == ["publisher", "subject", "subject"]


def test_only_places_where_a_whole_alias_may_begin_are_walked(spark, monkeypatch):
    """Words that begin some alias are frequent; they were followed, and written, one by one."""
    written, durable = [], A.durable

    def counted(df):
        out = durable(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(A, "durable", counted)
    docs = spark.createDataFrame([(1, "the report of the day " * 500 + "reached the Republic of Nowhere"), (2, "of the " * 500)], "id long, body string")
    aliases = spark.createDataFrame([("The Republic of Nowhere", "country", "NW"), ("of nowhere", "region", "now")], "alias string, kind string, value string")
    assert [(r.id, r.raw, r.value) for r in A.alias_mentions(docs, "id", "body", aliases).collect()] == [(1, "the Republic of Nowhere", "NW")]
    assert max(written) < 20


@pytest.mark.parametrize("piece", [1, 40, 1 << 17])
def test_cutting_in_pieces_equals_a_plain_scan(spark, monkeypatch, piece):
    """Texts of many scripts, cut at every length: letters whose lower case is longer or depends on their neighbours, gaps of all kinds, long words."""
    monkeypatch.setattr(A, "PIECE", piece)
    monkeypatch.setattr(A, "ROWS", 7)
    aliases = [*ALIASES, ("ΟΔΟΣ ΑΣ", "region", "odos"), ("ς", "region", "sigma"), ("i stanbul", "country", "split"), ("i", "region", "i"), ("２０ mai", "region", "day"),
               ("a b c d e f g h", "region", "eight"), ("b c", "region", "two"), ("𝒳 东京", "country", "plane"), ("x" * 300, "organization", "long")]
    monkeypatch.setitem(globals(), "ALIASES", aliases)
    words = ["United", "NATIONS", "security", "council", "Georgia", "côte", "d", "Ivoire", "ΟΔΟΣ", "ΑΣ", "οδος", "Σ", "İstanbul", "İ", "i", "stanbul", "２０", "MAI", *"ABCDEFGH", "𝒳", "东京", "X" * 300, "the"]
    chance = random.Random(5)
    texts = ["".join(chance.choice(words) + chance.choice([" ", " ", " ", "_", "\n", "'", "😀", "\u0307", ". "]) for _ in range(chance.randrange(60))) for _ in range(60)]
    texts += ["", " ", "a b c d e f g h", "a b c d", "e f g h", None, "united nations security council " * 40, " ".join("abcdefgh" * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(2)
    got = {}
    for r in A.alias_mentions(docs, "id", "body", spark.createDataFrame(aliases, "alias string, kind string, value string")).collect():
        assert r.before == texts[r.id][max(r.start - A.NEAR, 0) : r.start]
        got.setdefault(r.id, []).append((r.kind, r.value, r.raw, r.start, r.end))
    assert sum(map(len, got.values())) > 200
    assert {i: sorted(x, key=lambda m: m[3]) for i, x in got.items()} == {i: by_hand(t) for i, t in enumerate(texts) if t and by_hand(t)}

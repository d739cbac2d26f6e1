"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only.

The index is a table of postings (term, document, position), written once to the shared folder, of all terms
that the benchmark uses: no other posting can take part in a match. A window of an item is looked up from
its terms that are rarest in the corpus: their postings, less the term's offset in the window, give possible
starts; the starts of the rarest and the second rarest term are intersected, and what remains is compared
with the document's words over the whole window. Frequent terms are thus never joined with each other, and a hot term is
only looked up where all terms of a window are hot; its postings are spread by document.

Defined results: null texts have no words; an item without words has no window; a document without words is
not contaminated; repeated rows of a document are each judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.staging import materialize
from tidewatch.llm.common import free_names
from tidewatch.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but digits, lower-case letters and characters beyond ASCII parts words.
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct terms the benchmark's terms are broadcast; beyond, the join is shuffled.
TERMS_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, _APART), "")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """item_id, terms (array): each distinct window of ``width`` words; a shorter item is one window."""
    words = materialize(items.select("item_id", "text"), {"w": words_of(F.col("text"))}).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("terms")).distinct()


def _key(docs: DataFrame) -> DataFrame:
    """doc, text: one row per distinct row of a document; ``doc`` names the document and its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("doc"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term, pos) of the given terms over whole texts."""
    few = terms.limit(TERMS_BROADCAST + 1).count() <= TERMS_BROADCAST
    tokens = docs.select("doc", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return tokens.join(F.broadcast(terms) if few else terms, "word").select("doc", "term", "pos")


def occurrences(docs: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """doc, window, start, reach: matches of windows in documents.

    ``docs`` has doc and text, ``windows`` window (id) and terms. With slop 0 a match is the window's exact words in
    a row, ``reach`` words from ``start`` (0-based). With a slop the words must follow each other in order with at
    most that many other words between neighbours.
    """
    numbered = windows.select("window", F.posexplode("terms").alias("offset", "word"))
    terms = durable(numbered.select("word").distinct().withColumn("term", F.xxhash64("word")))
    index = durable(postings(docs, terms))
    counts = index.groupBy("term").agg(F.count("*").alias("uses"))
    # Terms that never occur rule a window out at once.
    ranked = durable(numbered.withColumn("term", F.xxhash64("word")).join(counts, "term", "left").fillna(0, ["uses"]))
    first = F.sort_array(F.collect_list(F.struct("uses", "offset", "term")))
    keys = ranked.groupBy("window").agg(first.alias("k"), F.min("uses").alias("least"), F.count("*").alias("size")).filter("least > 0")
    keys = durable(keys.select("window", "size", F.col("k")[0].alias("a"), F.when(F.size("k") > 1, F.col("k")[1]).otherwise(F.col("k")[0]).alias("b")))

    if slop:
        return _proximity(index, ranked, keys, slop)
    rarest = keys.select(F.col("a.term").alias("term"), F.col("a.offset").alias("offset"), "window", "size")
    second = keys.select(F.col("b.term").alias("term"), F.col("b.offset").alias("offset"), "window")
    starts = lambda side: index.join(side, "term").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
    both = starts(rarest).select("doc", "window", "start", "size").join(starts(second).select("doc", "window", "start"), ["doc", "window", "start"], "left_semi")
    found = durable(both).join(windows.select("window", "terms"), "window")
    held = docs.select("doc", "text").join(found.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    texts = materialize(held, {"w": words_of(F.col("text"))})
    exact = found.join(texts.select("doc", "w"), "doc").filter(F.slice("w", F.col("start") + 1, F.size("terms")) == F.col("terms"))
    return exact.select("doc", "window", "start", F.col("size").alias("reach"))


def _proximity(index: DataFrame, ranked: DataFrame, keys: DataFrame, slop: int) -> DataFrame:
    """Ordered matches with gaps: from the rarest term, neighbours are added one by one, nearest first."""
    size = keys.agg(F.max("size")).first()[0] or 0
    lists = ranked.select("window", "offset", "term")
    step = lambda offset: lists.join(keys.select("window", (F.col("a.offset") + offset).alias("offset")), ["window", "offset"])
    now = step(0).join(index, "term").select("doc", "window", F.col("pos").alias("start"), F.col("pos").alias("end"))
    whole = keys.select("window", F.col("a.offset").alias("at"), "size")
    for side in (1, -1):
        for k in range(1, size):
            more = step(side * k).join(index, "term").select("doc", "window", "pos")
            edge = F.col("end") if side > 0 else F.col("start")
            near = F.col("pos").between(edge + 1, edge + slop + 1) if side > 0 else F.col("pos").between(edge - slop - 1, edge - 1)
            need = whole.filter(F.col("at") + side * k < F.col("size") if side > 0 else F.col("at") - k >= 0).select("window", F.lit(True).alias("need"))
            grown = now.join(need, "window", "left").join(more, ["doc", "window"], "left").filter(F.col("need").isNull() | near)
            if side > 0:
                grown = grown.withColumn("end", F.when(F.col("need"), F.col("pos")).otherwise(F.col("end")))
            else:
                grown = grown.withColumn("start", F.when(F.col("need"), F.col("pos")).otherwise(F.col("start")))
            now = durable(grown.select("doc", "window", "start", "end").distinct())
    return now.select("doc", "window", "start", (F.col("end") - F.col("start") + 1).alias("reach"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """Per row: doc_id, doc (names its text), n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of an item's window is hit; ``percent`` of the words make it contaminated.
    """
    keyed = _key(docs)
    listed = durable(windows_of(benchmark, width).withColumn("window", F.xxhash64(F.to_json("terms"))))
    found = durable(occurrences(keyed, listed.select("window", "terms").distinct()))
    # Words hit: occurrences of a document in order; each adds what lies past the furthest reach before it.
    spans = found.withColumn("start", F.col("start").cast("long")).groupBy("doc", "start").agg(F.max(F.col("start") + F.col("reach")).alias("stop"))
    merged = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    hit = F.aggregate(
        "s", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["stop"]).alias("upto"), (a["n"] + F.greatest(x["stop"] - F.greatest(a["upto"], x["start"]), F.lit(0))).alias("n")),
    )
    hits = merged.select("doc", hit["n"].alias("hit"))
    items = found.select("doc", "window").distinct().join(listed.select("window", F.col("item_id").cast("string").alias("item")), "window")
    items = items.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    counted = keyed.select("doc_id", "doc", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(hits, "doc", "left").join(items, "doc", "left").withColumn("n_hit", F.coalesce("hit", F.lit(0)).cast("long"))
    return joined.select(
        "doc_id", "doc", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    (doc,) = free_names(docs, "doc")
    bad = contamination(docs, benchmark, width, percent).filter("contaminated").select(F.col("doc").alias(doc)).distinct()
    named = docs.withColumn(doc, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return named.join(bad, doc, "left_anti").drop(doc)

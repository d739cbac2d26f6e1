"""Entities in reporting and the evidence-backed relations between reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V
from tidewatch.functions.staging import gaps_of, marked_split, matches_of, materialize
from tidewatch.functions.times import DAY_MS
from tidewatch.operators.numbering import OrderSpan, number_within, top_per
from tidewatch.session import durable

_OCTET, _HEX = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)", "[0-9A-Fa-f]{1,4}"
_IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}"
# Eight groups, or k groups, a double colon and up to 7 - k more.
_IPV6 = "|".join((
    rf"\b(?:{_HEX}:){{7}}{_HEX}\b", *(rf"\b(?:{_HEX}:){{{k}}}(?::{_HEX}){{1,{7 - k}}}\b" for k in range(1, 7)),
))

# What each kind looks like in text. Whole words; a CIDR block is tried before a bare address.
# A domain may end in any label of two or more letters.
ENTITY_PATTERNS = {
    "cve": r"\bCVE-\d{4}-\d{4,}\b",
    "cidr": rf"{_IPV4}/(?:3[0-2]|[12]?\d)\b",
    "ip": rf"{_IPV4}\b|{_IPV6}",
    "asn": r"\bAS\d{1,10}\b",
    "domain": r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b",
}

# Scopes of addresses that are not global, in the order in which they are tried.
ADDRESS_SCOPES = {
    "private": r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|[Ff][CcDd][0-9A-Fa-f]{2}:)",
    "loopback": r"^(127\.|(0{1,4}:){7}0{0,3}1$)",
    "reserved": r"^(0\.|169\.254\.|22[4-9]\.|2[3-5]\d\.|[Ff][Ee][89ABab][0-9A-Fa-f]:|[Ff][Ff][0-9A-Fa-f]{2}:|2001:0?[Dd][Bb]8:)",
}


def _any_entity() -> str:
    """All kinds in one pattern; labels are matched possessively, which spares backtracking in every word."""
    return "|".join(ENTITY_PATTERNS.values()).replace(r"[A-Za-z0-9-]+\.", r"[A-Za-z0-9-]++\.")


def entity_kind(raw: Column) -> Column:
    kind = None
    for name, pattern in ENTITY_PATTERNS.items():
        test = raw.rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def address_scope(value: Column) -> Column:
    """Label of an address: private, loopback, reserved or global. Nothing is discarded."""
    scopes = (F.when(value.rlike(pattern), scope) for scope, pattern in ADDRESS_SCOPES.items())
    return F.coalesce(*scopes, F.lit("global"))


def entity_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every mention in the whole text: kind, raw and canonical value, code-point offsets.

    Start is inclusive and end exclusive. One pass of one pattern; offsets are the summed
    lengths of the pieces before a mention.
    """
    split = materialize(df.select(key, text), {"pieces": marked_split(F.col(text), _any_entity())}).filter(F.size("pieces") > 1)
    pieces = materialize(split.drop(text), {"names": matches_of("pieces"), "gaps": gaps_of("pieces")}).drop("pieces")

    def walk(acc: Column, i: Column) -> Column:
        start = acc.at + F.length(F.get("gaps", i))
        raw = F.get("names", i)
        hit = F.struct(raw.alias("raw"), start.alias("start"), (start + F.length(raw)).alias("end"))
        return F.struct((start + F.length(raw)).alias("at"), F.concat(acc.hits, F.array(hit)).alias("hits"))

    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int,end:int>>").alias("hits")
    )
    found = F.aggregate(F.sequence(F.lit(0), F.size("names") - 1), start, walk, lambda acc: acc.hits)
    rows = pieces.select(key, F.inline(found))
    return rows.withColumn("kind", entity_kind(F.col("raw"))).select(
        key, "kind", F.when(F.col("kind") == "cve", F.upper("raw")).otherwise(F.lower("raw")).alias("value"),
        "raw", "start", "end",
    )


def _window_ms(kind: Column) -> Column:
    days = F.lit(V.RELATION_DEFAULT_WINDOW_DAYS)
    for name, value in V.RELATION_WINDOW_DAYS.items():
        days = F.when(kind == name, value).otherwise(days)
    return days.cast("long") * DAY_MS


def _base(kind: Column) -> Column:
    points = F.lit(0)
    for name, value in V.RELATION_BASE.items():
        points = F.when(kind == name, value).otherwise(points)
    return points


def specific_entities(subjects: DataFrame, reports: int, share: float = V.GENERIC_ENTITY_SHARE) -> DataFrame:
    """Subject rows of entities found in at most ``share`` of the reports.

    The others may not be the base of a relation, by the ranking rules. They are found by
    partial counts; the list is short (mentions per report / share), so the planner normally
    measures it as broadcastable, and splits the skewed side when it does not.
    """
    generic = subjects.groupBy("kind", "value").count().filter(F.col("count") > share * reports)
    return subjects.join(generic.select("kind", "value"), ["kind", "value"], "left_anti")


#: Subject rows that a range of the arrival order holds on average: its pairs are made and ranked in one task.
RANGE_ROWS = 4096


def candidate_pairs(subjects: DataFrame, span: OrderSpan, limit: int = V.RELATION_CANDIDATES, carried: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Each report with the up to ``limit`` reports just before it that share an entity.

    ``subjects``: distinct ``id, kind, value, ts, ord`` with ``ord`` a unique arrival order
    per report that follows source time; ``carried`` columns of both reports come along, so that
    scoring needs no join. Reports are dealt by ranges of the order (``part``), and each range gets, per entity it holds,
    the ``limit`` rows before its first one, found through blocks of ``limit`` positions. What crosses the network are rows,
    not pairs; all pairs of a report lie in the task of its range, so what groups by ``part`` and ``id`` needs no further exchange.
    """
    ranges = max(1, min(span.ranges, subjects.count() // rows))
    numbered = number_within(subjects, ["kind", "value"], span, "position")
    part = F.least(F.floor(span.bucket() * ranges / span.ranges), F.lit(ranges - 1)).alias("part")
    facts = ("id", "ts", *carried)
    placed = durable(numbered.select(part, "kind", "value", "position", *facts))
    block = lambda position: F.floor((F.col(position) - 1) / limit)
    starts = placed.groupBy("kind", "value", "part").agg(F.min("position").alias("first")).select("kind", "value", F.col("part").alias("to"), "first", block("first").alias("block"))
    before = placed.drop("part").withColumn("block", F.explode(F.array(block("position"), block("position") + 1)))
    before = before.join(starts, ["kind", "value", "block"]).filter((F.col("first") - F.col("position")).between(1, limit))
    told = placed.withColumn("own", F.lit(True)).unionByName(before.withColumnRenamed("to", "part").drop("block", "first").withColumn("own", F.lit(False)))
    groups = told.repartition(ranges, "part").groupBy("part", "kind", "value").agg(F.collect_list(F.struct("position", "own", *facts)).alias("rows"))
    # Positions of an entity follow each other without a gap: the rows before are a slice.
    lined = materialize(groups, {"line": F.array_sort("rows")}).drop("rows")
    met = F.filter(F.transform("line", lambda x, i: F.struct(
        x.own.alias("own"), *(x[c].alias(c) for c in facts),
        F.when(x.own, F.slice("line", F.greatest(i - limit, F.lit(0)) + 1, F.least(i, F.lit(limit)))).alias("others"))), lambda x: x.own)
    later = lined.select("part", "kind", "value", F.inline(met)).drop("own")
    pairs = later.select("part", "kind", "value", *facts, F.explode("others").alias("o")).filter(F.col("ts") - F.col("o.ts") <= _window_ms(F.col("kind")))
    return pairs.select("id", "ts", F.col("o.id").alias("other_id"), F.col("o.ts").alias("other_ts"), "kind", "value", *carried, *(F.col(f"o.{c}").alias(f"other_{c}") for c in carried), "part")


def rank_relations(pairs: DataFrame, top: int = V.RELATION_TOP, candidates: int = V.RELATION_CANDIDATES) -> DataFrame:
    """Up to ``top`` related reports per report, by score, then source time, then id.

    ``pairs`` carry ``t`` and ``region``. The ``candidates`` newest reports that share any entity within its window
    are scored; they are among the newest ones of each entity, so pairs cut per entity lose none. The strongest
    shared entity is the base; category, week and region add to it. Pairs of ``candidate_pairs`` are dealt by ``part`` already.
    """
    dealt = [x for x in ("part",) if x in pairs.columns]
    strongest = pairs.groupBy(*dealt, "id", "other_id").agg(
        F.max(F.struct(_base(F.col("kind")).alias("base"), F.col("kind"), F.col("value"))).alias("reason"),
        *(F.max(x).alias(x) for x in ("ts", "other_ts", "t", "other_t", "region", "other_region")),
    )
    c = F.col
    nearest = top_per(strongest, [*dealt, "id"], candidates, c("other_ts").desc(), c("other_id").asc()).drop("rank")
    bonus = V.RELATION_BONUS
    score = (
        c("reason.base")
        + F.when(c("t") == c("other_t"), bonus["category"]).otherwise(0)
        + F.when(F.abs(c("ts") - c("other_ts")) <= 7 * DAY_MS, bonus["week"]).otherwise(0)
        + F.when(c("region") == c("other_region"), bonus["region"]).otherwise(0)
    )
    scored = nearest.withColumn("score", score).filter((c("score") >= V.RELATION_MIN_SCORE) & (c("reason.base") > 0))
    best = top_per(scored, [*dealt, "id"], top, c("score").desc(), c("other_ts").desc(), c("other_id").asc())
    return best.select(
        "id", "other_id", "rank", "score",
        F.concat(F.lit("shared_subject_"), c("reason.kind")).alias("reason"), c("reason.value").alias("value"),
    )


def relation_metrics(returned: DataFrame, queries: DataFrame, cap: int = 3) -> DataFrame:
    """One row of retrieval metrics.

    ``returned``: ``query_id, rank, relevant``; ``queries``: ``query_id, has_target``.
    """
    judged = _judged(returned.withColumn("correct", F.lit(None).cast("boolean")), queries, cap)
    return judged.agg(*_retrieval(cap))


def topic_metrics(returned: DataFrame, queries: DataFrame, cap: int = 3) -> DataFrame:
    """The same per topic of the query and in total (topic null), in one plan, with reason correctness.

    ``returned`` also holds ``correct``: does the stated reason hold in both reports (null: not reviewed);
    ``queries`` also ``topic``. A returned card whose reason is wrong is an unsupported attribution. A query without a topic counts as ``none``.
    """
    judged = _judged(returned, queries, cap).withColumn("topic", F.coalesce("topic", F.lit("none")))
    reviewed, wrong = F.sum("reviewed"), F.sum("wrong")
    sets = judged.groupingSets([["topic"], []], "topic").agg(
        *_retrieval(cap), reviewed.alias("reviewed"), wrong.alias("unsupported"), F.try_divide(reviewed - wrong, reviewed).alias("reason_correctness"))
    return sets


def _judged(returned: DataFrame, queries: DataFrame, cap: int) -> DataFrame:
    per_query = returned.filter(F.col("rank") <= cap).groupBy("query_id").agg(
        F.count("*").alias("cards"), F.count_if("relevant").alias("hits"), F.count("correct").alias("reviewed"), F.count_if(~F.col("correct")).alias("wrong")
    )
    return queries.join(per_query, "query_id", "left").fillna(0, ["cards", "hits", "reviewed", "wrong"])


def _retrieval(cap: int) -> list[Column]:
    n, cards, hits = F.count("*"), F.sum("cards"), F.sum("hits")
    eligible = F.count_if("has_target")
    return [
        n.alias("queries"), cards.alias("returned"), hits.alias("relevant"),
        F.try_divide(hits, cards).alias("precision_returned"),
        F.try_divide(F.count_if(F.col("cards") > 0), n).alias("coverage"),
        F.try_divide(F.count_if(F.col("has_target") & (F.col("hits") > 0)), eligible).alias("eligible_coverage"),
        F.try_divide(hits, n * cap).alias("slot_precision"),
    ]


def mention_metrics(found: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of extracted mentions against labelled ones."""
    a = found.select(*keys).distinct().withColumn("found", F.lit(1))
    b = labelled.select(*keys).distinct().withColumn("labelled", F.lit(1))
    both = a.join(b, keys, "full_outer")
    correct = F.count_if(F.col("found").isNotNull() & F.col("labelled").isNotNull())
    return both.agg(
        F.count("found").alias("accepted"), F.count("labelled").alias("labelled"), correct.alias("correct"),
        F.try_divide(correct, F.count("found")).alias("precision"),
        F.try_divide(correct, F.count("labelled")).alias("recall"),
    )


def leakage_safe_split(cluster: Column) -> Column:
    """train / dev / test in 60/20/20, decided by the near-duplicate cluster, so no cluster is split."""
    point = F.conv(F.substring(F.sha1(cluster), 1, 8), 16, 10).cast("long") % 100
    return F.when(point < 60, "train").when(point < 80, "dev").otherwise("test")


def timeline(entries: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """First ``limit`` entries per key by observation time then uid, with a truncation flag."""
    totals = entries.groupBy(key).agg(F.count("*").alias("total"))
    shown = top_per(entries, [key], limit, F.col("observed_at").asc(), F.col("entry_uid").asc())
    # ``shown`` holds at most ``limit`` rows per key, so the join adds no skew.
    return shown.join(totals, key).withColumn("truncated", F.col("total") > limit).drop("total")


def resolve_lineage(merges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Final target of every merged id, chains included (``old_id, new_id`` → ``old_id, final_id``).

    Each round doubles the distance covered, so rounds grow with the logarithm of the
    longest chain. A cycle in the corrections is an error.
    """
    current = durable(merges.select("old_id", F.col("new_id").alias("final_id")))
    for _ in range(max_rounds):
        onward = current.select(F.col("old_id").alias("final_id"), F.col("final_id").alias("next_id"))
        step = current.join(onward, "final_id", "left")
        moved = durable(step.select("old_id", F.coalesce("next_id", "final_id").alias("final_id"),
                                    F.col("next_id").isNotNull().alias("moved")))
        current = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return current
    raise ValueError("merge corrections form a cycle")


def active(corrections: DataFrame, as_of_ms: int) -> DataFrame:
    """Corrections in force at ``as_of``: ``valid_from`` inclusive, ``valid_to`` exclusive, null open."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= as_of_ms)
    return corrections.filter(begun & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of_ms)))


def route_sources(sources: DataFrame, lineage: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Sources under the events that stand now, through merges and splits in any order.

    ``lineage``: ``old_id, new_id, part``. A merge is one row without a part. A split has a row per successor: a source goes to
    the one whose part equals its own ``part`` column, else to the one without a part, else it stays. Each round takes
    every source one step, so rounds are as many as the longest chain; a chain beyond ``max_rounds`` is a cycle and an error. The
    lineage has one row per (old_id, part), so a source never multiplies and a hot event is split on the side of its sources.
    """
    named = durable(lineage.filter("part IS NOT NULL").select(F.col("old_id").alias("id"), "part", F.col("new_id").alias("__named")))
    rest = durable(lineage.filter("part IS NULL").select(F.col("old_id").alias("id"), F.col("new_id").alias("__rest")))
    current = sources
    for _ in range(max_rounds + 1):
        step = current.join(named, ["id", "part"], "left").join(rest, "id", "left")
        onward = F.coalesce("__named", "__rest")
        moved = durable(step.withColumns({"__moved": onward.isNotNull(), "id": F.coalesce(onward, F.col("id"))}).drop("__named", "__rest"))
        current = moved.drop("__moved").select(*sources.columns)
        if moved.filter("__moved").isEmpty():
            return current
    raise ValueError("corrections form a cycle")


def touched_by(lineage: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Every event that a correction changes: old ones, their successors on every level, and retracted ones; for ``stale_edges``."""
    ids = lineage.select(F.col("old_id").alias("id")).union(lineage.select("new_id"))
    return ids.union(tombstones.select("id")).distinct()


def apply_corrections(events: DataFrame, sources: DataFrame, tombstones: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and their sources after retractions and merges.

    Retracted and merged-away events leave; the sources of a merged event move to its
    final target, and the sources of a retracted one go with it.
    """
    gone = tombstones.select("id")
    kept = events.join(gone, "id", "left_anti").join(lineage.select(F.col("old_id").alias("id")), "id", "left_anti")
    target = lineage.select(F.col("old_id").alias("id"), "final_id")
    moved = (
        sources.join(gone, "id", "left_anti").join(target, "id", "left")
        .withColumn("id", F.coalesce("final_id", "id")).drop("final_id")
        .join(gone, "id", "left_anti")
    )
    return kept, moved


def stale_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Relations touching a corrected event, to be computed again."""
    ids = changed.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "left_id"), "left_id", "left_semi")
    right = edges.join(ids.withColumnRenamed("id", "right_id"), "right_id", "left_semi")
    return left.unionByName(right).distinct()

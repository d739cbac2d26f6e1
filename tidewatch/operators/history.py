"""Append-only revision history.

Every function returns the rows to append: the batch, reduced to one row per key,
minus the keys history already holds. Identifiers are computed from the key, so a
retried task or a repeated run produces the same rows and adds nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import hashing, text, times, urls
from tidewatch.operators.numbering import OrderSpan, first_per, number_within, top_per

PROVIDERS = (("rss", "RSS"), ("gdelt", "GDELT"))


def observe(articles: DataFrame) -> DataFrame:
    """Key and fingerprint every article of a batch, usable or not.

    ``articles``: ``seq, provider, url, title, summary, seendate, outcome``. Adds
    ``canonical_url, natural_key, source_uid, content_hash, revision_uid``; articles
    whose URL cannot identify a source have nulls and outcome ``rejected:invalid_url``.
    """
    c = F.col
    url = text.strip(F.coalesce(c("url"), F.lit("")))
    keyed = articles.withColumns(
        {
            "canonical_url": urls.canonical(url),
            "natural_key": urls.source_key(c("provider"), F.lit(None).cast("string"), url),
        }
    )
    content = hashing.fingerprint(
        {
            "title": text.strip(F.coalesce(c("title"), F.lit(""))),
            "summary": F.substring(text.strip(F.coalesce(c("summary"), F.lit(""))), 1, 600),
            "url": c("canonical_url"),
        }
    )
    bad = c("canonical_url").isNull()
    hashed = keyed.withColumns(
        {
            "source_uid": F.when(~bad, urls.name_uid("source", c("natural_key"))),
            "content_hash": F.when(~bad, content),
            "outcome": F.when(bad, "rejected:invalid_url").otherwise(c("outcome")),
        }
    )
    return hashed.withColumn(
        "revision_uid", F.when(~bad, urls.name_uid("revision", c("source_uid"), c("content_hash")))
    )


def _without(rows: DataFrame, history: DataFrame | None, keys: list[str]) -> DataFrame:
    return rows if history is None else rows.join(history.select(*keys), keys, "left_anti")


def new_sources(observed: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per unseen natural key; the first article supplies the original URL."""
    rows = observed.filter("natural_key IS NOT NULL").select(
        "seq", "source_uid", "provider", "natural_key", F.col("url").alias("original_url"), "canonical_url"
    )
    return _without(first_per(rows, ["natural_key"], F.col("seq")), history, ["natural_key"]).drop("seq")


def new_source_revisions(observed: DataFrame, observed_at: int, history: DataFrame | None = None) -> DataFrame:
    """One row per unseen (source, content); the first sighting's times are kept."""
    rows = observed.filter("source_uid IS NOT NULL").select(
        "seq", "revision_uid", "source_uid", "content_hash",
        times.parse_seendate(F.col("seendate")).alias("published_at"),
        F.lit(observed_at).cast("long").alias("observed_at"),
        "title", "summary", "canonical_url",
    )
    keys = ["source_uid", "content_hash"]
    return _without(first_per(rows, keys, F.col("seq")), history, keys).drop("seq")


def new_observations(observed: DataFrame, run_uid: str, observed_at: int, history: DataFrame | None = None) -> DataFrame:
    """One row per (run, source, revision) with the outcome of its first article."""
    keys = ["run_uid", "source_uid", "revision_uid"]
    rows = observed.filter("source_uid IS NOT NULL").select(
        "seq", F.lit(run_uid).alias("run_uid"), "source_uid", "revision_uid",
        F.col("outcome").alias("normalization_outcome"), F.lit(observed_at).cast("long").alias("observed_at"),
    )
    return _without(first_per(rows, keys, F.col("seq")), history, keys).drop("seq")


SEMANTIC_STRINGS = ("t", "sev", "title", "summary", "src", "loc")
SEMANTIC_NUMBERS = ("id", "lat", "lon", "ts")


def semantic_events(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Content that makes an event materially different: its fields and its set of sources, no clocks."""
    digest = sources.groupBy("id").agg(
        *(value.alias(f"set_{name}") for name, value in hashing.set_digest(F.col("url")).items())
    )
    return semantic_rows(events.drop("set_x", "set_y").join(digest, "id", "left"))


def semantic_rows(joined: DataFrame) -> DataFrame:
    """The same from events that hold the size (set_n) and the folds (set_x, set_y) of their set of URLs."""
    c = F.col
    members = F.concat_ws(":", *(c(f"set_{name}").cast("string") for name in ("n", "x", "y")))
    content = hashing.fingerprint(
        {**{k: c(k) for k in SEMANTIC_STRINGS}, "sources": members}, {k: c(k) for k in SEMANTIC_NUMBERS}
    )
    return joined.select(
        urls.name_uid("event", c("id")).alias("event_uid"), "id",
        *SEMANTIC_STRINGS, "lat", "lon", "ts", c("set_n").alias("n_sources"), content.alias("semantic_hash"),
    )


def new_event_revisions(semantic: DataFrame, created_at: int, history: DataFrame | None = None,
                        origin: str = "ingest") -> DataFrame:
    """Revisions whose content is new for their event; returning to old content appends nothing."""
    keys = ["event_uid", "semantic_hash"]
    rows = semantic.withColumns(
        {
            "revision_uid": urls.name_uid("event_revision", F.col("event_uid"), F.col("semantic_hash")),
            "created_at": F.lit(created_at).cast("long"),
            "origin": F.lit(origin),
        }
    )
    return _without(rows, history, keys)


def latest(revisions: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Newest row per key, as the current view over an append-only table."""
    return top_per(revisions, keys, 1, *order).drop("rank")


def current_revisions(revisions: DataFrame) -> DataFrame:
    """Latest appended revision of each event."""
    return latest(revisions, ["event_uid"], F.col("created_at").desc(), F.col("revision_uid").desc())


def revision_chain(rows: DataFrame, key: str, span: OrderSpan, content: Column) -> DataFrame:
    """Distinct contents per key with first and last sighting, numbered by first sighting.

    Repeats collapse map-side; the numbering spreads a key with very many revisions over
    the order ranges of ``span`` instead of giving it to one task.
    """
    hashed = rows.select(key, span.column, F.sha2(content, 256).alias("content_hash"))
    firsts = hashed.groupBy(key, "content_hash").agg(
        F.min(span.column).alias("first_seen"),
        F.max(span.column).alias("last_seen"),
        F.count("*").alias("observations"),
    )
    return number_within(firsts, [key], replace(span, column="first_seen"), "revision")


def new_evidence(event_revisions: DataFrame, event_sources: DataFrame, observed: DataFrame) -> DataFrame:
    """Links from event revisions to the source revisions of this batch, by exact URL.

    A URL observed several times links to its last revision of the batch.
    """
    seen = observed.filter("revision_uid IS NOT NULL").select(
        F.trim("url").alias("url"), F.col("revision_uid").alias("source_revision_uid"), "seq"
    )
    by_url = top_per(seen, ["url"], 1, F.col("seq").desc()).select("url", "source_revision_uid")
    cited = event_sources.select("id", "url").join(by_url, "url")
    return (
        event_revisions.select("id", F.col("revision_uid").alias("event_revision_uid"))
        .join(cited, "id")
        .select("event_revision_uid", "source_revision_uid")
        .distinct()
    )


def import_mapping(events: DataFrame, identity: str, known: DataFrame | None = None) -> DataFrame:
    """Stable id-to-uid map of an imported snapshot; repeating the import changes nothing."""
    mine = events.select(
        "id", urls.name_uid("event", F.col("id")).alias("event_uid"), F.lit(identity).alias("import_identity")
    ).distinct()
    if known is None:
        return mine.withColumn("conflict", F.lit(False))
    before = known.select("id", F.col("event_uid").alias("old_uid"), F.col("import_identity").alias("old_identity"))
    joined = mine.join(before, "id", "left")
    return joined.select(
        "id",
        F.coalesce("old_uid", "event_uid").alias("event_uid"),
        F.when(F.col("old_uid").isNotNull(), F.col("old_identity")).otherwise(F.col("import_identity")).alias("import_identity"),
        F.coalesce(F.col("old_identity") != identity, F.lit(False)).alias("conflict"),
    )


def mapping_checksum(mapping: DataFrame) -> DataFrame:
    """One checksum of an id-to-uid map, independent of row order and partitioning.

    Pairs are folded with xor next to their count and the id sum, so the map is never gathered.
    """
    pair = F.sha2(F.concat_ws("=", F.col("id").cast("string"), "event_uid"), 256)
    folds = [F.bit_xor(F.conv(F.substring(pair, i, 15), 16, 10).cast("long")).cast("string") for i in (1, 16, 31, 46)]
    return mapping.agg(
        F.count("*").alias("n"),
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("id").cast("string"), *folds), 256).alias("checksum"),
    )


def batch_outcomes(observed: DataFrame) -> DataFrame:
    """Accepted and rejected articles per provider."""
    return observed.groupBy("provider").agg(
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome") != "accepted").alias("rejected"),
    )


def source_health(observed: DataFrame, run_uid: str, failed: list[str], enabled: list[str]) -> DataFrame:
    """One row per enabled or failed provider of a run: failed, ok (any article) or empty."""
    counts = observed.groupBy("provider").agg(F.count("*").alias("n"))
    names = sorted({*enabled, *failed})
    rows = F.array(*(F.struct(F.lit(n).alias("provider"), F.lit(n in failed).alias("failed")) for n in names))
    registry = observed.sparkSession.range(1).select(F.inline(rows))
    return registry.join(counts, "provider", "left").select(
        F.lit(run_uid).alias("run_uid"),
        "provider",
        F.when(F.col("failed"), "failed").when(F.coalesce("n", F.lit(0)) > 0, "ok").otherwise("empty").alias("state"),
        F.when(F.col("failed"), "source_failure").alias("error_code"),
    )


def compare_projections(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Long-form differences (id, difference, left_value, right_value) of two event projections."""
    joined = left.alias("l").join(right.alias("r"), "id", "full_outer")
    in_left, in_right = F.col("l.present"), F.col("r.present")
    one_sided = F.when(in_right.isNull(), F.lit("only_left")).when(in_left.isNull(), F.lit("only_right"))

    def entry(name: Column, a: Column, b: Column) -> Column:
        return F.struct(
            name.alias("difference"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value")
        )

    nothing = F.lit(None).cast("string")
    changed = [
        F.when(
            one_sided.isNull() & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")),
            entry(F.lit(f), F.col(f"l.{f}"), F.col(f"r.{f}")),
        )
        for f in fields
    ]
    missing = F.when(one_sided.isNotNull(), entry(one_sided, nothing, nothing))
    return joined.select("id", F.inline(F.array_compact(F.array(missing, *changed))))


def latest_runs(ledger: DataFrame) -> DataFrame:
    """State of each run from its appended begin/finish rows."""
    return latest(ledger, ["run_uid"], F.col("logged_at").desc(), F.col("entry").desc())


def coverage_gaps(gaps: DataFrame, committed: DataFrame) -> DataFrame:
    """Latest reason per run with a gap; reconciled when the run was committed after all."""
    newest = latest(gaps, ["run_uid"], F.col("seen_at").desc(), F.col("reason").desc())
    done = committed.select("run_uid").distinct().withColumn("done", F.lit(True))
    return newest.join(done, "run_uid", "left").select(
        "run_uid", "reason", "seen_at", F.when(F.col("done"), "reconciled").otherwise("open").alias("state")
    )


def high_water(events: DataFrame, stored: int) -> DataFrame:
    """Next free id: never below the stored counter, never an id in use."""
    return events.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)) + 1, F.lit(stored).cast("long")).alias("next_id"))


def cycle_health(sources: DataFrame, rejected: Column) -> DataFrame:
    """One row: ok, degraded (anything failed) or error (nothing succeeded)."""
    totals = sources.agg(
        F.count_if(F.col("failed")).alias("failed_sources"),
        F.count_if(~F.col("failed")).alias("succeeded_sources"),
        rejected.alias("rejected"),
    )
    status = (
        F.when(F.col("succeeded_sources") == 0, "error")
        .when((F.col("failed_sources") > 0) | (F.col("rejected") > 0), "degraded")
        .otherwise("ok")
    )
    return totals.withColumn("status", status)


def duration_stats(runs: DataFrame, key: str, duration: Column) -> DataFrame:
    """Fastest, median and slowest run per case."""
    return runs.groupBy(key).agg(
        F.count("*").alias("reps"), F.min(duration).alias("min_ms"),
        F.median(duration).alias("median_ms"), F.max(duration).alias("max_ms"),
    )

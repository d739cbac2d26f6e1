"""Secret scans: a random forest removes false positives among token-like candidates; DataFrame functions only.

Candidates are runs of at least 12 token characters, and any quoted or unblank value behind a credential's name,
found in whole texts in one pass. Each is
described by its length, its character transitions, how much of its letters the corpus knows as words, whether
it lies in a path or holds an issuer's format, and the words around it. A random forest trained from labelled findings scores it.

Defined results: null and empty texts have no candidates; equal candidates of a text are separate findings;
without findings of both labels every candidate gets the share of secrets among the labelled ones (0 without any).
The character U+FFFF, which no valid text interchange uses, reads as U+FFFE in a text that holds a candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.staging import marked_split, materialize
from tidewatch.llm.common import free_names
from tidewatch.session import durable

_ASSIGNED = r"(?i:pass(?:word|wd|phrase)?|secret|token|key|credential|auth)[\"']?\s{0,20}[=:]\s{0,20}"
CANDIDATE = (
    rf"(?<=[=:\s])(?<={_ASSIGNED}|(?i:bearer)\s{{1,20}})(?!(?i:bearer|basic)\s)[^\s\"'=:][^\s\"']*(?<![,;.)\]}}>])"
    rf"|(?<=\")(?<={_ASSIGNED}\")[^\"\r\n]+(?=\")|(?<=')(?<={_ASSIGNED}')[^'\r\n]+(?=')"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}"
)
#: Words that name a credential, and the issuer formats that the weak labels trust.
CREDENTIAL_WORDS = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|key|credential|bearer|auth)$"
ISSUED = r"(?<![A-Za-z0-9])((AKIA|ASIA)[A-Z0-9]{16}|(ghp|gho|ghs)_[A-Za-z0-9]{36}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])"
MASK = "[SECRET]"
FEATURES = [
    "length", "digits", "uppers", "lowers", "marks", "turns_class", "turns_case", "odd_pairs", "covered", "path", "assigned", "quoted", "named", "named_near", "next_blank", "issued", "bearer",
]


@dataclass(frozen=True)
class Forest:
    trees: int = 20
    depth: int = 6
    threshold: float = 0.5
    seed: int = 3


def _name() -> Column:
    """Names a document together with its text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc, at (index of the match among the text's pieces), candidate, before, after: one row per match."""
    texts = docs.select(_name().alias("doc"), "text").filter(F.col("text").rlike(CANDIDATE))
    cut = materialize(texts, {"p": marked_split(F.col("text"), CANDIDATE)})
    places = F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))
    each = cut.filter(F.size("p") > 2).select("doc", "p", F.explode(places).alias("at"))
    piece = lambda shift: F.coalesce(F.get("p", F.col("at") + shift), F.lit(""))
    # The name of a credential may itself be a candidate.
    before, after = F.right(F.concat(piece(-2), piece(-1)), F.lit(60)), F.left(F.concat(piece(1), piece(2)), F.lit(60))
    # Repeated rows of a document give equal rows here.
    return each.select("doc", "at", piece(0).alias("candidate"), before.alias("before"), after.alias("after")).distinct()


def described(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the forest's features. Word counts for the dictionary coverage are taken over all documents."""
    c = F.col("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.length(c)
    prior = F.regexp_extract("before", r"([A-Za-z_-]+)[\s\"':=(\[]*$", 1)
    two = F.regexp_extract("before", r"([A-Za-z_-]+)\W+[A-Za-z_-]*\W*$", 1)
    plain = found.withColumns({
        "length": F.length(c).cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "marks": share("[+/_-]"),
        "turns_class": F.regexp_count(c, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")) / F.length(c),
        "turns_case": F.regexp_count(c, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / F.length(c),
        "odd_pairs": F.regexp_count(F.lower(c), F.lit("(?<=[bcdfghjklmnpqrstvwxz])[bcdfghjklmnpqrstvwxz]")) / F.length(c),
        "path": ((F.regexp_count(c, F.lit("/")) > 1) | F.col("before").rlike(r"(://|[/\\.])\S*$")).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"), "quoted": F.col("before").rlike("[\"'`]$").cast("double"),
        "named": prior.rlike(CREDENTIAL_WORDS).cast("double"), "named_near": two.rlike(CREDENTIAL_WORDS).cast("double"),
        "issued": c.rlike(ISSUED).cast("double"), "bearer": F.col("before").rlike(r"(?i)bearer\s+$").cast("double"),
        "next_blank": (F.col("after").rlike(r"^\s") | (F.col("after") == "")).cast("double"),
    })
    rows = durable(plain)
    runs = rows.select("doc", "at", "candidate", F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), 0)).alias("run"))
    # Counting comes before the join: each task sends a word once, however often it occurs.
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("run")).filter(F.length("run") >= 3)
    known = words.groupBy("run").agg(F.count("*").alias("uses")).filter("uses > 1").select("run")
    covered = runs.join(known, "run").groupBy("doc", "at").agg((F.sum(F.length("run")) / F.max(F.length("candidate"))).alias("covered"))
    return rows.join(covered, ["doc", "at"], "left").fillna(0.0, ["covered"])


def weak_label() -> Column:
    """Label of a described finding where none was given by a reviewer: an issuer's format, or assigned to a credential's name or its bearer.

    A short value, a single plain word after a colon or blank, and a quoted phrase that no password's or secret's name precedes are none.
    """
    c, before = F.col("candidate"), F.col("before")
    value = (F.length(c) >= 6) & ((F.col("quoted") == 1) | c.rlike("[^A-Za-z]") | before.rlike(r"=\s*$"))
    value &= ~c.rlike(r"\s") | before.rlike(r"(?i)(pass(word|wd|phrase)?|secret)[\"']?\s*[=:]\s*[\"']$")
    return ((F.col("issued") == 1) | (value & (((F.col("named") == 1) & (F.col("assigned") == 1)) | (F.col("bearer") == 1)))).cast("int")


class SecretForest:
    """A fitted forest; ``score`` adds the probability that a described candidate is a secret."""

    def __init__(self, model, share: float):
        self.model, self.share = model, share

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        return self.model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def fit(labelled: DataFrame, p: Forest = Forest()) -> SecretForest:
    """Train on all labelled findings: described rows with ``label`` 0 or 1."""
    share, kinds = labelled.agg(F.coalesce(F.avg("label"), F.lit(0.0)), F.count_distinct("label")).first()
    if kinds < 2:
        return SecretForest(None, float(share))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=p.trees, maxDepth=p.depth, seed=p.seed, bootstrap=False)
    return SecretForest(forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)), float(share))


def findings(docs: DataFrame, labelled: DataFrame | None = None, p: Forest = Forest()) -> DataFrame:
    """doc, at, candidate, score, secret. ``labelled``: reviewed findings with the features; None trains from weak labels."""
    rows = durable(described(candidates(docs), docs))
    model = fit(labelled if labelled is not None else rows.withColumn("label", weak_label()), p)
    return model.score(rows).select("doc", "at", "candidate", "score", (F.col("score") >= p.threshold).alias("secret"))


def redacted(docs: DataFrame, found: DataFrame, counts: tuple[str, str] | None = ("n_candidates", "n_secrets")) -> DataFrame:
    """``docs`` with each secret masked in ``text``; every other column and row stays.

    Adds the counts of candidates and secrets under the given names, which ``docs`` must not have; None adds none.
    """
    doc, at, n, secrets = free_names(docs, "doc", "at", "n", "secrets")
    per = found.groupBy(F.col("doc").alias(doc)).agg(
        F.count("*").alias(n), F.count_if("secret").alias(secrets), F.collect_list(F.when(F.col("secret"), F.col("at"))).alias(at)
    )
    joined = docs.withColumn(doc, _name()).join(per, doc, "left")
    kept = F.transform(marked_split(F.col("text"), CANDIDATE), lambda x, i: F.when(F.array_contains(at, i), F.lit(MASK)).otherwise(x))
    text = F.when(F.coalesce(secrets, F.lit(0)) > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *(F.coalesce(c, F.lit(0)).alias(name) for c, name in zip((n, secrets), counts or ())))


def secret_scan(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """doc_id, n_candidates, n_secrets, redacted_sha256 (of the masked text) per row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    masked = redacted(rows, durable(findings(rows, None, p)))
    return masked.select("doc_id", "n_candidates", "n_secrets", F.sha2(F.col("text").cast("binary"), 256).alias("redacted_sha256"))

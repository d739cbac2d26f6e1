"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Features are the runs of 2, 3 and 4 bytes of a text in which everything but letters counts as one blank. Their
embeddings are averaged over the whole text. The network is trained by stochastic gradient descent in numpy on
a bounded sample of labelled rows; as average and softmax layer are both linear, tasks apply the product of the two tables.
A temperature and a rejection bound are set on rows kept aside: predictions below the bound are not ``accepted``.

Defined results: ``und`` with score 0 for texts that are null or have no letter, or if no language was learnt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import pieces, table_batch
from tidewatch.operators.numbering import top_per

#: Lower-case ASCII letters and bytes beyond ASCII stay; all else is a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class LangId:
    buckets: int = 1 << 16
    width: int = 8
    #: Labelled rows per language, the excerpt of each (from anywhere in its text), and the most languages that training takes, the
    #: most frequent ones; predictions read whole texts.
    sample: int = 500
    bytes_read: int = 2000
    languages: int = 1000
    epochs: int = 8
    rate: float = 2.0
    #: Share of accepted predictions that should be right.
    precision: float = 0.99
    seed: int = 17


def grams(texts: list[bytes], p: LangId) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte runs (3 per position) and the bounds of each text's positions; 0 where a run says nothing."""
    data = np.frombuffer(b"".join(t + b"    " for t in texts).translate(_PLAIN), np.uint8).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 4 for t in texts], dtype=np.int64)])
    n = len(data)
    padded = np.append(data, np.full(4, 32, np.uint32))
    code, out = padded[:n].copy(), np.empty((n, 3), np.int32)
    blank = padded == 32
    for k in range(1, 4):
        code = code << np.uint32(8) | padded[k : n + k]
        mixed = (code + np.uint32(k)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
        ids = 1 + ((mixed >> np.uint32(8)) % np.uint32(p.buckets - 1)).astype(np.int32)
        # A blank may stand at one end, as a word's edge.
        dull = blank[:n] & blank[1 : n + 1]
        for j in range(1, k):
            dull |= blank[j : n + j]
        out[:, k - 1] = np.where(dull | (blank[:n] & blank[k : n + k]), 0, ids)
    return out, bounds


class Model:
    """``table``: what each gram adds to the languages' logits before averaging."""

    def __init__(self, p: LangId, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float = 1.0, bound: float = 0.0):
        self.p, self.languages, self.table, self.bias, self.heat, self.bound = p, languages, table, bias, heat, bound

    def logits(self, texts: list[bytes]) -> np.ndarray:
        found, bounds = grams(texts, self.p)
        total = np.zeros((len(texts), len(self.languages)))
        counts = np.maximum(1, np.add.reduceat((found > 0).sum(axis=1), bounds[:-1]))
        for column in found.T:
            total += np.add.reduceat(self.table[column], bounds[:-1], axis=0, dtype=np.float64)
        return total / counts[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its calibrated probability."""
        q = softmax(self.logits(texts) / self.heat)
        return q.argmax(axis=1), q.max(axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], languages: list[str], p: LangId = LangId()) -> Model:
    """SGD over embeddings and softmax; every fifth row is kept aside for temperature and rejection bound."""
    names = sorted(set(languages))
    if not names:
        return Model(p, [], np.zeros((p.buckets, 0), np.float32), np.zeros(0))
    draw = np.random.default_rng(p.seed)
    y = np.searchsorted(names, languages)
    embedding = draw.normal(0, 0.1, (p.buckets, p.width))
    embedding[0] = 0
    out, bias = draw.normal(0, 0.1, (p.width, len(names))), np.zeros(len(names))
    cut = [t[: p.bytes_read] for t in texts]
    aside = np.arange(len(texts)) % 5 == 4
    train = np.flatnonzero(~aside)
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        order = draw.permutation(train)
        for a in range(0, len(order), 32):
            part = order[a : a + 32]
            found, bounds = grams([cut[i] for i in part], p)
            flat, owner = found.ravel(), np.repeat(np.arange(len(part)), np.diff(bounds) * 3)
            flat, owner = flat[flat > 0], owner[flat > 0]
            counts = np.maximum(1, np.bincount(owner, minlength=len(part)))[:, None]
            # Counts of the distinct grams per text, so that each embedding row is touched once per text.
            pair, times = np.unique(owner.astype(np.int64) * p.buckets + flat, return_counts=True)
            text, gram = pair // p.buckets, pair % p.buckets
            weight = times / counts[text, 0]
            mean = np.stack([np.bincount(text, weight * embedding[gram, d], len(part)) for d in range(p.width)], axis=1)
            q = softmax(mean @ out + bias)
            q[np.arange(len(part)), y[part]] -= 1
            d_mean = q @ out.T
            out -= rate * mean.T @ q / len(part)
            bias -= rate * q.mean(axis=0)
            used, at = np.unique(gram, return_inverse=True)
            for d in range(p.width):
                # Rare grams would hardly move under averaging; the factor is the usual length of a text in grams.
                embedding[used, d] -= rate * 20 * np.bincount(at, weight * d_mean[text, d], len(used)) / len(part)
    model = Model(p, names, (embedding @ out).astype(np.float32), bias)
    if aside.any():
        held = np.flatnonzero(aside)
        logits = model.logits([cut[i] for i in held])
        loss = {h: -np.log(softmax(logits / h)[np.arange(len(held)), y[held]] + 1e-12).mean() for h in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)}
        model.heat = min(loss, key=loss.get)
        q = softmax(logits / model.heat)
        right = (q.argmax(axis=1) == y[held])[np.argsort(-q.max(axis=1))]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= p.precision)
        model.bound = float(np.sort(q.max(axis=1))[::-1][good[-1]]) if len(good) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, p: LangId = LangId()) -> Model:
    """Fit on at most ``p.sample`` rows of each of the ``p.languages`` most frequent languages, held-out rows excluded.

    Of each row an excerpt is read that begins anywhere in its text. Two passes, whatever the number of languages: one counts, one
    draws by a hash of id and text.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(p.languages).collect()
    if not counted:
        return fit([], [], p)
    # Three times as many rows as wanted pass, so that a share drawn by hash holds enough.
    shares = [(r.lang, min(1 << 20, -(-3 * p.sample * (1 << 20) // r.n))) for r in counted]
    table = docs.sparkSession.createDataFrame(shares, "lang string, share long")  # p.languages rows at most
    place = F.expr(f"CAST(pmod(h, greatest(length(coalesce(text, '')) - {p.bytes_read}, 0) + 1) AS int) + 1")
    drawn = known.join(F.broadcast(table), "lang").filter("pmod(shiftrightunsigned(h, 24), 1048576) < share")
    excerpts = drawn.select("lang", "h", F.substr("text", place, F.lit(p.bytes_read)).alias("text"))
    rows = sorted((r.lang, r.h, r.text or "") for r in top_per(excerpts, ["lang"], p.sample, F.col("h"), F.col("text")).toLocalIterator())
    order = np.random.default_rng(p.seed).permutation(len(rows))
    return fit([rows[i][2].encode() for i in order], [rows[i][0] for i in order], p)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted per row, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("letters", pa.bool_()), ("best", pa.string()), ("score", pa.float64())])

    def run(batches):
        net = shared.value
        for rows, texts in pieces(batches):
            if net.languages:
                best, score = net.predict(texts)
                names = [net.languages[i] for i in best]
            else:
                names, score = [None] * len(texts), np.zeros(len(texts))
            yield table_batch(out, [rows.column(0), rows.column(2), pa.array(names, pa.string()), pa.array(score)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(run, "doc_id long, letters boolean, best string, score double")
    known = F.col("letters") & F.col("best").isNotNull()
    score = F.when(known, F.col("score")).otherwise(0.0)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(known, F.col("best")).otherwise("und").alias("lang_pred"),
        score.alias("score"), (known & (F.col("score") >= model.bound)).alias("accepted"),
    )

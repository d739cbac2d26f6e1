"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is cut into overlapping windows of words that together cover all of it; a word of more than 10 bytes enters as
several steps, overlapping pieces of it. A word enters the network by
hashed word, word-start and trigram features: their smoothed log-odds in toxic training texts against others, and learnt
embeddings. Forward and backward GRU states of a window are pooled by attention into one logit; the score of a
text is that of its most toxic window, calibrated by a logistic fit on training rows kept aside, each weighted by
the labelled rows it stands for, so that a score means the same at every size. Everything is numpy: trained on
the driver from a bounded sample of labelled rows (``sample`` rows per label, the lowest by a hash of the row),
applied in tasks that hold one batch of texts.

Defined results: null, empty and word-less texts form one window without words and get the score of that; if a
label is missing from the training rows the score is the share of toxic ones (0 without any rows).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Words, mix, pieces, table_batch
from tidewatch.session import durable

#: ASCII bytes that are no letters and no digits part words; bytes beyond ASCII belong to them but for ``_PARTS``.
_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _parting() -> re.Pattern:
    """Matches UTF-8 of blanks and punctuation beyond ASCII (categories Z and P, U+0085, U+200B, U+FEFF)."""
    ends: dict[bytes, list[bytes]] = {}
    for code in range(128, sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in "ZP" or code in (0x85, 0x200B, 0xFEFF):
            raw = chr(code).encode()
            ends.setdefault(raw[:-1], []).append(re.escape(raw[-1:]))
    return re.compile(b"|".join(re.escape(lead) + b"[" + b"".join(last) + b"]" for lead, last in ends.items()))


_PARTS = _parting()
#: Bytes of a word that one step reads, and from one step's first byte to the next one's: every trigram lies in one step.
_PIECE, _AHEAD = 10, 8


@dataclass(frozen=True)
class Toxicity:
    window: int = 32
    stride: int = 24
    hidden: int = 8
    embedding: int = 6
    buckets: int = 1 << 15
    #: Labelled rows per label used to fit the network; fitting and scores read whole texts.
    sample: int = 1500
    epochs: int = 8
    windows_per_text: int = 8
    rate: float = 0.01
    seed: int = 5


def _chars(found: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the steps ``at``, 0 after their end, and their sizes."""
    size = found.end[at] - found.start[at]
    places = np.minimum(found.start[at, None] + np.arange(_PIECE), len(found.data) - 1)
    return np.where(np.arange(_PIECE) < size[:, None], found.data[places], 0).astype(np.uint64), size


class Steps(Words):
    """The words of texts as the network reads them: one of more than 10 bytes is cut into pieces that share two bytes.

    ``hash`` is the word's for the first piece of a word, and that of its own bytes for a further one.
    """

    def __init__(self, texts: list[bytes]):
        super().__init__([t if t.isascii() else _PARTS.sub(b" ", t) for t in texts], _GAPS)
        counts = np.maximum(1, -(-(self.end - self.start - 2) // _AHEAD))
        before = np.concatenate([[0], np.cumsum(counts)])
        word = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(word)) - before[word]
        self.start = self.start[word] + place * _AHEAD
        self.end = np.minimum(self.start + _PIECE, self.end[word])
        self.hash, self.bounds = self.hash[word], before[self.bounds]
        further = np.flatnonzero(place)
        chars, size = _chars(self, further)
        own = size.astype(np.uint64)
        for k in range(_PIECE):
            own = mix(own * np.uint64(257) + chars[:, k] + np.uint64(1))
        self.hash[further] = own


def word_features(found: Steps, at: np.ndarray, p: Toxicity) -> np.ndarray:
    """Hashed feature ids of the steps ``at``: the word or further piece, its starts of 3 to 6 bytes, and its trigrams; 0 pads."""
    out = np.zeros((len(at), 13), np.int64)
    chars, size = _chars(found, at)
    whole = found.hash[at]
    start = np.zeros(len(at), np.uint64)
    limit = np.uint64(p.buckets - 1)
    out[:, 0] = 1 + (whole % limit).astype(np.int64)
    for k in range(6):
        start = mix(start * np.uint64(257) + chars[:, k] + np.uint64(1))
        if k >= 2:
            out[:, k - 1] = np.where(size > k, 1 + (start % limit).astype(np.int64), 0)
    for k in range(8):
        gram = mix(chars[:, k] << np.uint64(16) | chars[:, k + 1] << np.uint64(8) | chars[:, k + 2] | np.uint64(1 << 30))
        out[:, 5 + k] = np.where(size >= k + 3, 1 + (gram % limit).astype(np.int64), 0)
    return out


def _sum_rows(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, column, size) for column in values.T], axis=1).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and its gradient. Arrays are time-major: (steps, windows, width)."""

    def __init__(self, p: Toxicity):
        self.p, draw = p, np.random.default_rng(p.seed)
        h, width = p.hidden, 3 + p.embedding
        normal = lambda *s: draw.normal(0, 0.3, s).astype(np.float32)
        self.embedding = draw.normal(0, 0.05, (p.buckets, p.embedding)).astype(np.float32)
        self.embedding[0] = 0
        self.odds = np.zeros(p.buckets, np.float32)
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"], self.w[f"u{side}"], self.w[f"c{side}"] = normal(width, 3 * h), normal(h, 3 * h), np.zeros(3 * h, np.float32)
        self.w |= {"a": normal(2 * h), "o": normal(2 * h), "d": np.zeros(1, np.float32)}
        self.slope, self.shift, self.flat = 1.0, 0.0, None

    def inputs(self, features: np.ndarray) -> np.ndarray:
        """Per word: log-odds of the word, of its starts and of its trigrams (strongest), and the mean embedding."""
        odds = self.odds[features]
        far = lambda part: np.take_along_axis(part, np.abs(part).argmax(axis=1)[:, None], 1)
        known = (features > 0).sum(axis=1, keepdims=True)
        mean = self.embedding[features].sum(axis=1) / np.maximum(known, 1)
        return np.concatenate([odds[:, :1], far(odds[:, 1:5]), far(odds[:, 5:]), mean], axis=1)

    def _gru(self, x, live, side, keep):
        """x: (steps, n, 3h), projected inputs; padding steps leave the state as it is."""
        h, u = self.p.hidden, self.w[f"u{side}"]
        state, trace = np.zeros((x.shape[1], h), np.float32), []
        states = np.empty((*x.shape[:2], h), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            gates = 1 / (1 + np.exp(-(x[t, :, : 2 * h] + state @ u[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
            after = np.where(live[t][:, None], state + z * (new - state), state)
            if keep:
                trace.append((t, state, z, r, new))
            state = states[t] = after
        return states, trace

    def forward(self, xf, xb, live, keep=False):
        """Logits of windows from projected inputs."""
        f, tf = self._gru(xf, live, "f", keep)
        b, tb = self._gru(xb, live, "b", keep)
        both = np.concatenate([f, b], axis=2)
        weight = np.where(live, both @ self.w["a"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0) * live.any(axis=0)[:, None]
        logit = pooled @ self.w["o"] + self.w["d"][0]
        return (logit, both, weight, pooled, tf, tb) if keep else logit

    def _gru_back(self, trace, side, d_states, live, grad):
        h, u = self.p.hidden, self.w[f"u{side}"]
        d_x = np.zeros((*d_states.shape[:2], 3 * h), np.float32)
        carry = np.zeros(d_states.shape[1:], np.float32)
        for t, state, z, r, new in reversed(trace):
            d = (carry + d_states[t]) * live[t][:, None]
            carry = (carry + d_states[t]) * ~live[t][:, None]
            d_new = d * z * (1 - new**2)
            d_rs = d_new @ u[:, 2 * h :].T
            d_z, d_r = d * (new - state) * z * (1 - z), d_rs * state * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=1)
            grad[f"u{side}"][:, : 2 * h] += state.T @ d_gates
            grad[f"u{side}"][:, 2 * h :] += (r * state).T @ d_new
            carry += d * (1 - z) + d_rs * r + d_gates @ u[:, : 2 * h].T
            d_x[t] = np.concatenate([d_gates, d_new], axis=1)
        return d_x

    def gradient(self, features, index, live, target, weight):
        """Loss gradient of windows; ``index`` (steps, n) points into the distinct words' ``features``."""
        x = self.inputs(features)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        seen = x[index]
        logit, both, att, pooled, tf, tb = self.forward(seen @ self.w["xf"] + self.w["cf"], seen @ self.w["xb"] + self.w["cb"], live, True)
        d_logit = ((_sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        grad["o"], grad["d"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.w["o"]
        inner = (both * d_pooled).sum(axis=2)
        d_att = att * (inner - (att * inner).sum(axis=0))
        grad["a"] = (both * d_att[:, :, None]).sum(axis=(0, 1))
        d_both = att[:, :, None] * d_pooled + d_att[:, :, None] * self.w["a"]
        h, d_seen = self.p.hidden, 0
        for side, trace, d in (("f", tf, d_both[..., :h]), ("b", tb, d_both[..., h:])):
            d_x = self._gru_back(trace, side, d, live, grad)
            grad[f"x{side}"] = seen.reshape(-1, seen.shape[2]).T @ d_x.reshape(-1, 3 * h)
            grad[f"c{side}"] = d_x.sum(axis=(0, 1))
            d_seen = d_seen + d_x @ self.w[f"x{side}"].T
        d_mean = _sum_rows(index.ravel(), d_seen[..., 3:].reshape(-1, self.p.embedding), len(features))
        known = (features > 0).sum(axis=1, keepdims=True)
        per_word = np.repeat(d_mean / np.maximum(known, 1), features.shape[1], axis=0)
        return grad, _sum_rows(features.ravel(), per_word, self.p.buckets)

    def window_logits(self, features: np.ndarray, inverse: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Logits of word windows (first, end); word i has the features in row ``inverse[i]``."""
        if not len(features):
            return np.full(len(spans), self.w["d"][0])
        x = self.inputs(features)
        xf, xb = (np.vstack([x @ self.w[f"x{s}"] + self.w[f"c{s}"], np.zeros((1, 3 * self.p.hidden), np.float32)]).astype(np.float32) for s in "fb")
        inverse = np.append(inverse, len(features))
        logits = np.empty(len(spans), np.float32)
        for a in range(0, len(spans), 2048):
            part = spans[a : a + 2048]
            index = part[:, 0] + np.arange(self.p.window)[:, None]
            live = index < part[:, 1]
            words = inverse[np.where(live, index, len(inverse) - 1)]
            logits[a : a + 2048] = self.forward(xf[words], xb[words], live)
        return logits

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        found = Steps(texts)
        spans, owner = windows(found.bounds, self.p)
        _, at, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        best = np.maximum.reduceat(self.window_logits(word_features(found, at, self.p), inverse, spans), np.flatnonzero(np.diff(owner, prepend=-1)))
        return _sigmoid(self.slope * best.astype(np.float64) + self.shift)


def windows(bounds: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Windows (first word, end) and the text each belongs to; a text has at least one, and all its words are covered."""
    first, end = bounds[:-1], bounds[1:]
    counts = 1 + np.maximum(0, -(-(end - first - p.window) // p.stride))
    owner = np.repeat(np.arange(len(first)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[owner] + place * p.stride
    return np.stack([start, np.minimum(start + p.window, end[owner])], axis=1), owner


def _some(texts: Iterable[bytes], most: int = 1_000_000) -> Iterator[list[bytes]]:
    """Runs of texts that hold about ``most`` bytes; a longer text comes alone."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) >= most:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def _read(texts: Iterable[bytes], p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the texts' words, features of the distinct words, and each word's row among those. Texts are read whole, run by run, and not kept."""
    rows, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    known, row, features, many = np.zeros(0, np.uint64), np.zeros(0, np.int32), [np.zeros((0, 13), np.int32)], 0
    for run in _some(texts):
        found = Steps(run)
        distinct, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(known, distinct)
        new = np.append(known, 0)[at] != distinct if len(known) else np.ones(len(distinct), bool)
        new |= at == len(known)
        features.append(word_features(found, first[new], p).astype(np.int32))
        row = np.insert(row, at[new], np.arange(many, many + new.sum(), dtype=np.int32))
        known = np.insert(known, at[new], distinct[new])
        many += int(new.sum())
        rows.append(row[np.searchsorted(known, distinct)][inverse])
        bounds.append(bounds[-1][-1] + found.bounds[1:])
    return np.concatenate(bounds), np.concatenate(features), np.concatenate(rows)


def fit(texts: Iterable[bytes], labels: Sequence[int], p: Toxicity, weights: tuple[float, float] = (1.0, 1.0)) -> Network:
    """Train from labelled texts; every fifth is kept aside for calibration. ``weights``: labelled rows that a clean and a toxic text stand for.

    ``labels`` may be a list that fills while ``texts`` are drawn.
    """
    net = Network(p)
    bounds, features, inverse = _read(texts, p)
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        net.flat = float(labels.mean()) if len(labels) else 0.0
        return net
    labels = labels.astype(np.float32)
    draw = np.random.default_rng(p.seed)
    aside = np.arange(len(labels)) % 5 == 4
    spans, owner = windows(bounds, p)
    # Log-odds: in how many toxic and in how many other texts a feature occurs.
    text_of = np.repeat(np.arange(len(labels)), np.diff(bounds))
    use = ~aside[text_of]
    many_words = max(1, len(features))
    key = np.unique(text_of[use] * many_words + inverse[use])
    doc, word = key // many_words, key % many_words
    toxic, clean = np.zeros(p.buckets), np.zeros(p.buckets)
    for column in range(features.shape[1]):
        pair = np.unique(doc * p.buckets + features[word, column])
        toxic += np.bincount(pair % p.buckets, labels[pair // p.buckets], p.buckets)
        clean += np.bincount(pair % p.buckets, 1 - labels[pair // p.buckets], p.buckets)
    many = max(1.0, labels[~aside].sum()), max(1.0, (1 - labels[~aside]).sum())
    net.odds = np.clip(np.log((toxic + 0.5) / many[0]) - np.log((clean + 0.5) / many[1]), -4, 6).astype(np.float32) / 2
    net.odds[0] = 0

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    squares = np.full(p.buckets, 1e-6, np.float32)
    step = 0
    index_all = np.append(inverse, 0)
    for epoch in range(p.epochs):
        # A toxic text teaches by its window that now scores highest, as one suffices; other texts by all, the highest first.
        logits = net.window_logits(features, inverse, spans) if epoch else _window_odds(net, features, inverse, spans, p)
        order = np.lexsort((-logits, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        target = labels[owner[order]]
        chosen = order[(~aside[owner[order]]) & (rank < np.where(target > 0, 1, p.windows_per_text))]
        weight_of = np.where(labels[owner[chosen]] > 0, len(chosen) / (2 * max(1, labels[owner[chosen]].sum())), len(chosen) / (2 * max(1, (1 - labels[owner[chosen]]).sum())))
        mixed = draw.permutation(len(chosen))
        for a in range(0, len(mixed), 256):
            part = chosen[mixed[a : a + 256]]
            index = spans[part, 0] + np.arange(p.window)[:, None]
            live = index < spans[part, 1]
            words = index_all[np.where(live, index, len(index_all) - 1)]
            used, local = np.unique(words, return_inverse=True)
            grad, d_rows = net.gradient(features[used], local.reshape(words.shape), live, labels[owner[part]], weight_of[mixed[a : a + 256]])
            step += 1
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                net.w[k] -= (p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            squares += (d_rows**2).sum(axis=1)
            net.embedding -= 0.05 * d_rows / np.sqrt(squares)[:, None]
            net.embedding[0] = 0
    logits = np.maximum.reduceat(net.window_logits(features, inverse, spans), np.flatnonzero(np.diff(owner, prepend=-1)))
    weight = np.where(labels > 0, weights[1], weights[0])
    if len(set(labels[aside].tolist())) == 2:
        net.slope, net.shift = _calibrate(logits[aside], labels[aside], weight[aside])
    else:  # The network learns from both labels at equal weight.
        net.slope, net.shift = 1.0, float(np.log(weight[labels > 0].sum() / weight[labels == 0].sum()))
    return net


def _window_odds(net, features, inverse, spans, p):
    strongest = net.odds[features].max(axis=1)[inverse] if len(inverse) else np.zeros(0)
    index = spans[:, :1] + np.arange(p.window)
    return np.where(index < spans[:, 1:], np.append(strongest, 0)[np.minimum(index, len(inverse))], -9).max(axis=1)


def _calibrate(logits, labels, weight):
    """Weighted logistic fit of slope and shift by Newton steps, with a small ridge."""
    slope, shift = 1.0, 0.0
    # Targets a little inside 0 and 1, so that separable rows give finite values.
    many = (weight * labels).sum(), (weight * (1 - labels)).sum()
    y = np.where(labels > 0, (many[0] + 1) / (many[0] + 2), 1 / (many[1] + 2))
    for _ in range(50):
        q = _sigmoid(slope * logits + shift)
        off, v = weight * (q - y), weight * (q * (1 - q) + 1e-9)
        g = np.array([(off * logits).sum() + 1e-3 * slope, off.sum()])
        hess = np.array([[(v * logits**2).sum() + 1e-3, (v * logits).sum()], [(v * logits).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(hess, g)
        slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
    return float(max(slope, 0.05)), float(shift)


def held_out(doc_id):
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Network:
    """Fit on at most ``p.sample`` labelled rows per label, lowest by a hash of the id, held-out rows excluded."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    many = {r.toxic: r.many for r in known.groupBy("toxic").agg(F.count("*").alias("many")).collect()}
    weights = tuple(max(1.0, many.get(label, 0) / p.sample) for label in (0, 1))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
        picked = part if picked is None else picked.union(part)
    # At most 2 * sample rows of two numbers: broadcast is bounded.
    few = durable(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("at")))
    marks: list[int] = []

    def told() -> Iterator[bytes]:
        # Sorted by ranges, of which the driver holds one at a time; repeated ids may give more rows than were picked.
        for row in islice(few.orderBy("at").toLocalIterator(), 2 * p.sample):
            marks.append(row.toxic)
            yield (row.text or "").encode()

    return fit(told(), marks, p, weights)


def score_column(docs: DataFrame, model: Network, name: str = "score") -> DataFrame:
    """doc_id and score of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), (name, pa.float64())])

    def run(batches):
        net = shared.value
        for rows, texts in pieces(batches):
            yield table_batch(out, [rows.column(0), pa.array(net.score(texts).astype(np.float64))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {name} double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score_column(docs, train(docs, labels, p))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def filter_toxic(docs: DataFrame, model: Network, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns kept, in one pass."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        net = shared.value
        for rows, texts in pieces((b.rename_columns([*b.schema.names[:place], "text", *b.schema.names[place + 1 :]]) for b in batches)):
            yield rows.filter(pa.array(net.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""LM scoring by a hidden Markov language model over word classes.

The ``own`` most frequent training words are classes of their own, other words share a class with words of the same
ending, and the end of a text is a class. Baum-Welch trains transitions and emissions: every task runs the scaled
forward and backward recursions over its texts and hands on expected counts, which are summed by (state, class)
across partitions; passes cover all training texts. So does the first guess: classes with like neighbours begin in one state. The exact
log-likelihood of a text is that of its class sequence, by the scaled forward recursion, plus that of each word
within its class, which needs the word's count in the whole corpus. Counts of the ``hot`` most frequent words go
to every task (bounded by the parameter); the others meet their texts in a join on the word.

Defined results: a null or empty text is one end token; without training texts every word is unknown and the
states are uniform; a null doc_id belongs to the training rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Words, blank_words, mix, pieces, table_batch
from tidewatch.session import durable


@dataclass(frozen=True)
class Hmm:
    states: int = 8
    own: int = 8192
    endings: int = 1024
    hot: int = 65_536
    #: Kinds of neighbours that the first guess tells apart, and Baum-Welch rounds; both read all training texts.
    contexts: int = 16
    rounds: int = 2
    seed: int = 29

    @property
    def classes(self) -> int:
        return self.own + self.endings + 1


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 on division by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts; words are bytes."""
    out = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def told(counts):
        return table_batch(out, [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())])

    def run(batches):
        counts = Counter()
        for _, texts in pieces(batches):
            for text in texts:
                counts.update(blank_words(text))
            if len(counts) > 200_000:
                yield told(counts)
                counts.clear()
        yield told(counts)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending_class(found: Words, p: Hmm) -> np.ndarray:
    """Class of each word by its last three bytes and whether it is longer."""
    key = np.zeros(len(found.start), np.uint64)
    for k in range(1, 5):
        at = found.end - k
        byte = np.where(at >= found.start, found.data[np.maximum(at, 0)], 0).astype(np.uint64)
        key = key << np.uint64(8) | (byte if k < 4 else (byte > 0).astype(np.uint64))
    return p.own + (mix(key) % np.uint64(p.endings)).astype(np.int64)


@dataclass
class Lexicon:
    """What every task knows: the hot words by hash (sorted) with rank and count, and each ending class's denominator."""

    hashes: np.ndarray
    rank: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    ends: int
    room: np.ndarray

    def place(self, found: Words) -> np.ndarray:
        """Index into the hot words, or -1."""
        if not len(self.hashes):
            return np.full(len(found.hash), -1)
        at = np.minimum(np.searchsorted(self.hashes, found.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found.hash, at, -1)


def lexicon(counts: DataFrame, ends: int, p: Hmm) -> Lexicon:
    """``counts`` is read three times: totals, hot words, denominators by ending."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = counts.orderBy(F.desc("c"), "word").limit(p.hot).collect()
    hashes = np.array([Words([bytes(r.word)]).hash[0] for r in hot], np.uint64)
    order = np.argsort(hashes)
    numbers = np.array([r.c for r in hot], np.int64)
    own = counts.sparkSession.sparkContext.broadcast(np.sort(hashes[: p.own]))
    out = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            found = Words([w.as_py() for w in batch.column(0)])
            c = batch.column(1).to_numpy()
            rare = ~np.isin(found.hash, own.value)
            cls = ending_class(found, p)[rare] - p.own
            yield table_batch(out, [
                pa.array(np.arange(p.endings)), pa.array(np.bincount(cls, c[rare], p.endings).astype(np.int64)), pa.array(np.bincount(cls, minlength=p.endings).astype(np.int64)),
            ])

    rows = counts.mapInArrow(run, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    room = np.ones(p.endings)
    for r in rows:
        room[r.cls] += r.n + r.v
    return Lexicon(hashes[order], np.arange(len(hot))[order], numbers[order], int(total) + ends, int(distinct) + (ends > 0), ends, room)


def encoded(docs: DataFrame, lex: Lexicon, p: Hmm) -> DataFrame:
    """Per row: class sequence (two bytes each), known sums over its hot words, and its other words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    fields = [("n_tokens", "long"), ("hot_known", "long"), ("hot_sum", "double"), ("hot_rare", "double"), ("room", "double"), ("classes", "binary"), ("words", "array<binary>"), ("times", "array<int>")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
    out = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), *((n, kinds[k]) for n, k in fields)])

    def run(batches):
        known = shared.value
        rank_class = np.where(known.rank < p.own, known.rank, -1)
        log_hot, log_room, log_end = np.log10(known.counts + 1.0), np.log10(known.room), float(np.log10(known.ends + 1.0))
        end = np.uint16(p.classes - 1)
        for rows, texts in pieces(batches):
            found = Words(texts)
            at = known.place(found)
            hot = at >= 0
            logs = np.where(hot, log_hot[at], 0) if len(log_hot) else np.zeros(len(at))
            cls = np.where(hot, rank_class[at], -1) if len(log_hot) else np.full(len(at), -1)
            rare = cls < 0
            cls = np.where(rare, ending_class(found, p), cls)
            room = np.where(rare, log_room[cls * rare - p.own * rare], 0)
            done = []
            for a, b in zip(found.bounds[:-1], found.bounds[1:]):
                tail = a + np.flatnonzero(~hot[a:b])
                _, first, times = np.unique(found.hash[tail], return_index=True, return_counts=True)
                done.append((
                    int(b - a) + 1, int(hot[a:b].sum()) + (known.ends > 0), logs[a:b].sum() + log_end, logs[a:b][rare[a:b]].sum(), room[a:b].sum(),
                    np.append(cls[a:b].astype(np.uint16), end).tobytes(), [found.word(i) for i in tail[first]], times.astype(np.int32),
                ))
            yield table_batch(out, [rows.column(0), rows.column(2), *zip(*done)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
    return rows.mapInArrow(run, "doc_id long, uid long, " + ", ".join(f"{n} {k}" for n, k in fields))


class Model:
    """Start, transition and emission probabilities of the class sequence."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def guess(cls, p: Hmm) -> "Model":
        draw = np.random.default_rng(p.seed)
        rows = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(draw.random(s) + 0.5)
        move = rows(p.states, p.states) * 0.3 + np.eye(p.states) * 0.7
        return cls(rows(p.states), move / move.sum(axis=1, keepdims=True), rows(p.states, p.classes))

    @classmethod
    def of(cls, start, move, emit, unigram) -> "Model":
        """From expected counts, smoothed towards uniform moves and the classes' shares."""
        even = lambda x, a: (x + a) / (x + a).sum(axis=-1, keepdims=True)
        pull = 50.0
        return cls(even(start, 0.1), even(move, 0.1), (emit + pull * unigram) / (emit.sum(axis=1, keepdims=True) + pull))

    def groups(self, sequences: list[np.ndarray], cells: int = 1 << 17):
        """Sequences in order of falling length, side by side: (their indices, classes by time, live ones at each time)."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        at = 0
        while at < len(order):
            longest = len(sequences[order[at]])
            take = order[at : at + max(1, cells // longest)]
            lengths = np.array([len(sequences[i]) for i in take])
            grid = np.zeros((longest, len(take)), np.int64)
            for column, i in enumerate(take):
                grid[: lengths[column], column] = sequences[i]
            live = np.searchsorted(-lengths, -np.arange(longest), side="left")
            yield take, grid, live
            at += len(take)

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each sequence."""
        total, emit = np.zeros(len(sequences)), np.ascontiguousarray(self.emit.T)
        for take, grid, live in self.groups(sequences):
            sums = np.zeros(len(take))
            now = self.start * emit[grid[0]]
            for t in range(len(grid)):
                n = live[t]
                if t:
                    now = (now[:n] @ self.move) * emit[grid[t, :n]]
                scale = now.sum(axis=1)
                now = now / scale[:, None]
                sums[:n] += np.log(scale)
            total[take] = sums
        return total

    def expect(self, sequences: list[np.ndarray]):
        """Expected counts: starts, moves, emissions."""
        k, c = self.emit.shape
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
        table = np.ascontiguousarray(self.emit.T)
        for take, grid, live in self.groups(sequences):
            steps, n = grid.shape
            ahead, seen, scale = np.zeros((steps, n, k)), table[grid], np.ones((steps, n))
            for t in range(steps):
                m = live[t]
                now = (self.start if t == 0 else ahead[t - 1, :m] @ self.move) * seen[t, :m]
                scale[t, :m] = now.sum(axis=1)
                ahead[t, :m] = now / scale[t, :m, None]
            behind = np.ones((steps, n, k))
            for t in range(steps - 2, -1, -1):
                m = live[t + 1]
                seen[t + 1, :m] *= behind[t + 1, :m] / scale[t + 1, :m, None]  # emission times backward, scaled
                behind[t, :m] = seen[t + 1, :m] @ self.move.T
            real = np.arange(n) < live[:, None]
            share = ahead * behind
            start += share[0].sum(axis=0)
            both = real[1:]
            move += self.move * (ahead[:-1][both].T @ seen[1:][both])
            classes, share = grid[real], share[real]
            for s in range(k):
                emit[s] += np.bincount(classes, share[:, s], c)
        return start, move, emit


def _sequences(batch: pa.RecordBatch, name: str):
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def baum_welch(rows: DataFrame, model: Model, unigram: np.ndarray, p: Hmm) -> Model:
    """One round over all rows of class sequences: tasks hand on expected counts, summed by cell."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("n", pa.float64())])

    def run(batches):
        sums = np.zeros((p.states, 1 + p.states + p.classes))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                parts = shared.value.expect(_sequences(batch.slice(at, 1000), "classes"))
                sums += np.concatenate([parts[0][:, None], parts[1], parts[2]], axis=1)
        row, col = np.nonzero(sums > 1e-9)
        yield table_batch(out, [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(sums[row, col])])

    counts = rows.select("classes").mapInArrow(run, "row int, col int, n double").groupBy("row", "col").agg(F.sum("n").alias("n"))
    # As many cells as the model has parameters.
    sums = np.zeros((p.states, 1 + p.states + p.classes))
    for r in counts.toLocalIterator():
        sums[r.row, r.col] = r.n
    return Model.of(sums[:, 0], sums[:, 1 : 1 + p.states], sums[:, 1 + p.states :], unigram)


def neighbours(rows: DataFrame, kind: np.ndarray, p: Hmm) -> np.ndarray:
    """How often each class stands before (first half) and behind a neighbour of each kind, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(kind)
    out = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("n", pa.int64())])
    width = 2 * p.contexts

    def run(batches):
        sums = np.zeros(p.classes * width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                x = np.concatenate(_sequences(batch.slice(at, 1000), "classes"))
                first, second = x[:-1], x[1:]
                inside = first != p.classes - 1  # only a text's last token is its end
                first, second = first[inside], second[inside]
                sums += np.bincount(np.concatenate([first * width + shared.value[second], second * width + p.contexts + shared.value[first]]), minlength=len(sums))
        cells = np.flatnonzero(sums)
        yield table_batch(out, [pa.array((cells // width).astype(np.int32)), pa.array((cells % width).astype(np.int32)), pa.array(sums[cells])])

    counts = rows.select("classes").mapInArrow(run, "row int, col int, n long").groupBy("row", "col").agg(F.sum("n").alias("n"))
    # As many cells as the parameters allow.
    sums = np.zeros((p.classes, width))
    for r in counts.toLocalIterator():
        sums[r.row, r.col] = r.n
    return sums


def first_guess(rows: DataFrame, unigram: np.ndarray, tokens: int, p: Hmm) -> Model:
    """States as groups of classes whose neighbours are alike, weighted by the classes' shares."""
    kind = np.arange(p.classes)
    hashed = kind >= p.contexts // 2
    kind[hashed] = p.contexts // 2 + (mix(kind[hashed].astype(np.uint64)) % np.uint64(p.contexts // 2 - 1)).astype(np.int64)
    kind[-1] = p.contexts - 1
    met = neighbours(rows, kind, p)
    behind, ahead = met[:, : p.contexts], met[:, p.contexts :]
    even = lambda x: (x + x.sum(axis=0) / max(1.0, x.sum()) + 1e-9) / (x + x.sum(axis=0) / max(1.0, x.sum()) + 1e-9).sum(axis=1, keepdims=True)
    likes = np.sqrt(np.concatenate([even(behind), even(ahead)], axis=1))
    draw = np.random.default_rng(p.seed)
    centers = likes[draw.choice(p.classes, 1, p=unigram)]
    far = lambda: ((likes[:, None, :] - centers) ** 2).sum(axis=2)
    while len(centers) < p.states:
        odds = unigram * far().min(axis=1) + 1e-15
        centers = np.vstack([centers, likes[draw.choice(p.classes, p=odds / odds.sum())]])
    for _ in range(30):
        own = np.eye(p.states)[far().argmin(axis=1)] * unigram[:, None]
        held = own.sum(axis=0)[:, None]
        centers = np.where(held > 0, own.T @ likes / np.maximum(held, 1e-300), centers)
    share = 0.9 * np.eye(p.states)[far().argmin(axis=1)] + 0.1 / p.states
    mass = share * unigram[:, None] * tokens
    of_kind = np.zeros((p.contexts, p.states))
    np.add.at(of_kind, kind, mass)
    move = (mass.T @ even(behind)) @ (of_kind / np.maximum(of_kind.sum(axis=1, keepdims=True), 1e-300))
    return Model.of(mass.sum(axis=0), move, mass.T, unigram)


def train(rows: DataFrame, lex: Lexicon, p: Hmm) -> Model:
    """``rows``: encoded training texts."""
    unigram = np.ones(p.classes)
    own = lex.rank < p.own
    unigram[lex.rank[own]] += lex.counts[own]
    unigram[p.own : p.own + p.endings] += lex.room
    unigram[-1] += lex.ends
    unigram /= unigram.sum()
    if not lex.ends:
        return Model.guess(p)
    model = first_guess(rows, unigram, lex.total, p)
    for _ in range(p.rounds):
        model = baum_welch(rows, model, unigram, p)
    return model


def lm_scores(docs: DataFrame, p: Hmm = Hmm()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    learnt = docs.filter(~held_out(F.col("doc_id")))
    counts = durable(word_counts(learnt))
    lex = lexicon(counts, learnt.count(), p)
    rows = durable(encoded(docs, lex, p))
    model = train(rows.filter(~held_out(F.col("doc_id"))), lex, p)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("uid", pa.int64()), ("chain", pa.float64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield table_batch(out, [part.column(0), pa.array(shared.value.forward(_sequences(part, "classes")) / np.log(10))])

    chains = rows.select("uid", "classes").mapInArrow(run, "uid long, chain double")
    tail = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", "w.words", "w.times")
    met = tail.join(counts.withColumnRenamed("word", "words"), "words")
    sums = met.groupBy("uid").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("tail_sum"))
    whole = rows.drop("classes", "words", "times").join(sums, "uid", "left").join(chains, "uid")
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    space = float(np.log10(lex.total + lex.distinct + 1))
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("hot_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("hot_sum") + tail_sum - F.col("n_tokens") * space).alias("base_score"),
        (F.col("chain") + F.col("hot_rare") + tail_sum - F.col("room")).alias("score"),
    )

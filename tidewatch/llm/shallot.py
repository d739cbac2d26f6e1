"""Exact k-means over integer vectors with Shallot's bounded search.

Vectors are packed in blocks, one row each. A block remembers for every vector its centroid, the second nearest
one of its last search, an upper bound of the distance to the former and a lower bound of that to any
other. After the centroids moved, the bounds move with them, and a vector whose bounds still part needs no
work. The others compute the distances to both remembered centroids and start from the closer one: its
neighbours are scanned in ascending distance from it, inside a ball whose radius (distance to the start plus distance to the
second best so far) shrinks with every better find. Bounds are floating point with a margin; whoever
survives them is compared by exact integer distance, ties by the smaller number.

A round reads one written table of blocks and writes the next one; the one before is then dropped. Sums per
centroid are added up per block, then by Spark; the driver sees ``k`` rows of sums only.

Kept are vectors of exactly ``dims`` components, none null or not finite; a missing vector is not kept. Repeated rows
are vectors each; among equal hashes of vec_id (repeated ids) the smaller vector starts first; a missing vec_id hashes as an
empty text. With fewer than ``k`` vectors each is a centroid; an empty table gives no rows. Components beyond 2^27 are computed with unbounded
integers; a distance or sum of distances that exceeds a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import table_batch
from tidewatch.session import drop_durable, durable

#: Up to this magnitude squared distances of up to 64 components fit into 64 bits.
SAFE = 1 << 27
#: Vectors of one block.
BLOCK = 2048
#: Sums beyond 64 bits travel in digits of so many bits.
DIGIT = 40
LONGEST = 2**63 - 1
#: What a floating-point bound may be off by, relative to it.
SLACK = 1e-9

_BLOCKS = pa.schema([
    ("ids", pa.list_(pa.int64())), ("vectors", pa.large_binary()), ("kind", pa.string()), ("assigned", pa.binary()), ("second", pa.binary()),
    ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.list_(pa.int64())),
])
BLOCKS = "ids array<long>, vectors binary, kind string, assigned binary, second binary, upper binary, lower binary, sums array<long>"


@dataclass(frozen=True)
class Clustering:
    k: int = 8
    dims: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where they stay safe, else as unbounded ones."""
    scaled = np.floor(x * scale)
    if not len(scaled) or np.abs(scaled).max() <= SAFE:
        return scaled.astype(np.int64)
    whole = np.empty(scaled.shape, object)
    whole.flat = [int(v) for v in scaled.flat]
    return whole


def _freeze(vectors: np.ndarray) -> tuple[bytes, str]:
    """Bytes of the vectors in the narrowest type that holds them; unbounded integers as decimal text."""
    if vectors.dtype == object:
        return " ".join(map(str, vectors.flat)).encode(), "text"
    most = int(np.abs(vectors).max()) if len(vectors) else 0
    kind = "<i2" if most < 1 << 15 else "<i4"
    return vectors.astype(kind).tobytes(), kind


def _thaw(data: bytes, kind: str, dims: int) -> np.ndarray:
    if kind != "text":
        return np.frombuffer(data, kind).astype(np.int64).reshape(-1, dims)
    numbers = [int(v) for v in data.split()]
    whole = np.empty(len(numbers), object)
    whole[:] = numbers
    return whole.reshape(-1, dims)


def _distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    if vectors.dtype == object or centroid.dtype == object:
        gap = vectors.astype(object) - centroid.astype(object)
    else:
        gap = vectors - centroid
    return (gap * gap).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    whole = np.array(rows, object).reshape(len(rows), len(rows[0]) if rows else 0)
    return whole.astype(np.int64) if max((abs(v) for v in whole.flat), default=0) <= SAFE else whole


class Centroids:
    """The centroids of a round, their neighbours in ascending distance, and how far each moved since the last one."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.at, k = _matrix(rows), len(rows)
        self.apart = np.array([_root(_distances(self.at, self.at[j])) for j in range(k)]).reshape(k, k)
        self.order = [[c for c in np.argsort(self.apart[j], kind="stable").tolist() if c != j] for j in range(k)]
        self.moved = np.zeros(k) if before is None else np.array([_root(_distances(self.at[j : j + 1], _matrix(before[j : j + 1])[0]))[0] for j in range(k)])
        # The farthest that any centroid but j went.
        self.others_moved = np.array([max((m for i, m in enumerate(self.moved) if i != j), default=0.0) for j in range(k)])
        self.half_gap = np.array([self.apart[j][self.order[j][0]] / 2 if self.order[j] else np.inf for j in range(k)])


@dataclass
class State:
    assigned: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_search(vectors: np.ndarray, c: Centroids) -> State:
    """Compare all vectors with all centroids."""
    every = np.array([_distances(vectors, at) for at in c.at]).reshape(len(c.at), -1)
    order = np.argsort(every, axis=0, kind="stable")
    rows = np.arange(len(vectors))
    best = order[0]
    second = order[min(1, len(order) - 1)]
    upper = _root(every[best, rows])
    return State(best, second, upper, _root(every[second, rows]) if len(order) > 1 else np.full(len(rows), np.inf))


def shallot_search(vectors: np.ndarray, s: State, c: Centroids) -> State:
    """The state after the centroids moved to ``c``."""
    assigned, second = s.assigned.copy(), s.second.copy()
    upper = (s.upper + c.moved[assigned]) * (1 + SLACK)
    lower = np.maximum(s.lower - c.others_moved[assigned], 0) * (1 - SLACK)

    def bounded(rows: np.ndarray) -> np.ndarray:
        return upper[rows] < np.maximum(lower[rows], c.half_gap[assigned[rows]]) * (1 - SLACK)

    rows = np.arange(len(vectors))
    rows = rows[~bounded(rows)]
    own = _gather(vectors, assigned, rows, c)
    upper[rows] = _root(own) * (1 + SLACK)
    still = ~bounded(rows)
    rows, own = rows[still], own[still]
    if not len(rows) or len(c.at) == 1:
        return State(assigned, second, upper, lower)
    other = _gather(vectors, second, rows, c)
    # Start from the closer one of the two remembered centroids.
    a, b = assigned[rows], second[rows]
    swap = (other < own) | ((other == own) & (b < a))
    near, next_ = np.where(swap, b, a), np.where(swap, a, b)
    near_d, next_d = np.where(swap, other, own), np.where(swap, own, other)
    for start in np.unique(near):
        group = np.flatnonzero(near == start)
        self_d = _root(near_d[group])
        best, best_d, runner, runner_d = near[group], near_d[group], next_[group], next_d[group]
        known = next_[group]
        for candidate in c.order[start]:
            # Behind the ball no centroid can be nearer than the second best.
            inside = c.apart[start][candidate] * (1 - SLACK) <= (self_d + _root(runner_d)) * (1 + SLACK)
            if not inside.any():
                break
            look = np.flatnonzero(inside & (known != candidate))
            if not len(look):
                continue
            d = _distances(vectors[rows[group[look]]], c.at[candidate])
            wins = (d < best_d[look]) | ((d == best_d[look]) & (candidate < best[look]))
            places = ~wins & ((d < runner_d[look]) | ((d == runner_d[look]) & (candidate < runner[look])))
            w, q = look[wins], look[places]
            runner[w], runner_d[w] = best[w], best_d[w]
            best[w], best_d[w] = candidate, d[wins]
            runner[q], runner_d[q] = candidate, d[places]
        to = rows[group]
        assigned[to], second[to] = best, runner
        upper[to], lower[to] = _root(best_d) * (1 + SLACK), _root(runner_d) * (1 - SLACK)
    return State(assigned, second, upper, lower)


def _gather(vectors: np.ndarray, number: np.ndarray, rows: np.ndarray, c: Centroids) -> np.ndarray:
    """Exact squared distances of rows to the centroids with their numbers."""
    out = np.zeros(len(rows), object if vectors.dtype == object or c.at.dtype == object else np.int64)
    for j in np.unique(number[rows]):
        chosen = number[rows] == j
        out[chosen] = _distances(vectors[rows[chosen]], c.at[j])
    return out


def _sums(vectors: np.ndarray, assigned: np.ndarray, k: int) -> list[int]:
    """Count and component sums of each centroid, in digits: ``k * (dims + 1)`` lowest ones first."""
    rows = []
    for j in range(k):
        own = vectors[assigned == j]
        rows += [len(own), *(own.sum(axis=0).tolist() if len(own) else [0] * vectors.shape[1])]
    if vectors.dtype != object:
        return rows
    digits = []
    while any(v not in (0, -1) for v in rows):
        digits += [v & ((1 << DIGIT) - 1) for v in rows]
        rows = [v >> DIGIT for v in rows]
    return digits + rows


def pack_blocks(vectors: DataFrame, p: Clustering) -> DataFrame:
    """Kept vectors as integers, in blocks; no state yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                lists = part.column("v")
                whole = _whole(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dims), p.scale)
                data, kind = _freeze(whole)
                yield table_batch(_BLOCKS, [[part.column("vec_id").to_pylist()], [data], [kind], [b""], [b""], [b""], [b""], [[]]])

    return _kept(vectors, p).mapInArrow(run, BLOCKS)


def _kept(vectors: DataFrame, p: Clustering) -> DataFrame:
    whole = f"size(embedding) = {p.dims} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(whole).select("vec_id", F.col("embedding").alias("v"))


def first_centroids(vectors: DataFrame, p: Clustering) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = _kept(vectors, p).select(order.alias("h"), "v").orderBy("h", "v").limit(p.k).collect()
    return [[int(x) for x in _whole(np.array([r["v"]]), p.scale)[0]] for r in first]


def _assign(c: Centroids, p: Clustering):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                vectors = _thaw(r["vectors"], r["kind"], p.dims)
                if r["assigned"]:
                    old = State(*(np.frombuffer(r[f], t).astype(w) for f, t, w in (("assigned", "<u2", np.int64), ("second", "<u2", np.int64), ("upper", "<f8", np.float64), ("lower", "<f8", np.float64))))
                    s = shallot_search(vectors, old, c)
                else:
                    s = first_search(vectors, c)
                state = [s.assigned.astype("<u2").tobytes(), s.second.astype("<u2").tobytes(), s.upper.astype("<f8").tobytes(), s.lower.astype("<f8").tobytes()]
                yield table_batch(_BLOCKS, [[r["ids"]], [r["vectors"]], [r["kind"]], *([x] for x in state), [_sums(vectors, s.assigned, len(c.at))]])

    return run


def _moved(blocks: DataFrame, rows: list[list[int]], p: Clustering) -> list[list[int]]:
    """Each centroid's floor of the mean of its vectors; one without vectors stays."""
    added = blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    width, k = p.dims + 1, len(rows)
    totals = [0] * (width * k)
    for r in added:
        digit, at = divmod(r["at"], width * k)
        totals[at] += int(r["x"]) << (DIGIT * digit)
    return [[t // totals[j * width] for t in totals[j * width + 1 : (j + 1) * width]] if totals[j * width] else rows[j] for j in range(k)]


def clusters(vectors: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, before = first_centroids(vectors, p), None
    blocks = durable(pack_blocks(vectors, p))
    for _ in range(p.rounds):
        done = durable(blocks.mapInArrow(_assign(Centroids(rows, before), p), BLOCKS))
        drop_durable(blocks)
        blocks, rows, before = done, _moved(done, rows, p), rows
    final = Centroids(rows, before)
    search = _assign(final, p)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in search(batches):
            for r in batch.to_pylist():
                whole, number = _thaw(r["vectors"], r["kind"], p.dims), np.frombuffer(r["assigned"], "<u2").astype(np.int64)
                exact = _gather(whole, number, np.arange(len(whole)), final).tolist()
                yield table_batch(schema, [r["ids"], number.tolist(), [d if d <= LONGEST else None for d in exact]])

    found = durable(blocks.mapInArrow(results, "vec_id long, cluster int, distance long"))
    drop_durable(blocks)
    wide = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(wide.alias("s")).collect()}  # k rows at most

    def as_long(total) -> object:
        return F.lit(int(total) if total is not None and total <= LONGEST else None).cast("long")

    inertia = None if None in sums.values() else sum(sums.values())
    digests = [sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    of_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", *([of_cluster([as_long(sums.get(j)) for j in range(len(rows))]).alias("cluster_inertia")] if rows else [F.lit(None).cast("long").alias("cluster_inertia")]),
        as_long(inertia).alias("inertia"), (of_cluster([F.lit(d) for d in digests]) if rows else F.lit("")).alias("centroid_sha256"),
    )

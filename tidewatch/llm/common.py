"""Helpers the text operators share: word splitting, word hashing and bounded Arrow batches.

Conventions of every operator in this subpackage: a null text counts as an empty one, a table
without rows gives a result without rows, further columns of the input are ignored (and so may
have any name), and repeated rows each get their own result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 — used as pa.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes A-Z become a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts handed to a worker's numpy code at a time.
BATCH_BYTES = 1_000_000


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
        taken.add(name.lower())
    return free


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII blanks (space and \\x09-\\x0D)."""
    return text.translate(LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random 64-bit value per byte; a word's hash is the sum of value * BASE^position, finalized.
_BYTE_VALUES = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
_BASE = 0x2545F4914F6CDD1D
_BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        full = np.full(max(size, 1 << 21), base, np.uint64)
        full[0] = 1
        table = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return table


class Words:
    """The words of several texts, found and hashed in a few passes over their bytes.

    ``hash``: 64-bit value of each word; ``start``, ``end``: its bytes in ``data``; ``bounds``: words of
    text i are those from bounds[i] to bounds[i + 1]. Words are runs of bytes that are not ``gaps``; A-Z
    are lower-cased first. Different words share a value with a probability of about 2^-60.
    """

    def __init__(self, texts: list[bytes], gaps: np.ndarray = _BLANKS, lower: bytes = LOWER):
        self.raw = b" ".join(texts).translate(lower) + b" "
        self.data = np.frombuffer(self.raw, np.uint8)
        inside = ~gaps[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
        if len(edges) % 2:
            edges = np.append(edges, len(self.data))
        self.start, self.end = edges[0::2], edges[1::2]
        size = len(self.data) + 1
        sums = np.zeros(size, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * _power_table(_BASE, size)[: size - 1], out=sums[1:])
        back = _power_table(pow(_BASE, -1, 2**64), size)
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start])
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.bounds = np.searchsorted(self.start, begins)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES):
    """Split Arrow batches into runs of rows whose texts hold about ``most`` bytes; a longer text comes alone.

    Yields (the rows as a batch, their texts as bytes).
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start), [t or b"" for t in texts.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start), [t or b"" for t in texts.slice(start).to_pylist()]


def table_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def starts_of(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

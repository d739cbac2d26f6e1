"""Best-fit packing of tokenized documents into sequences of bounded length.

Each document becomes its token ids and an end id. Longer documents are cut from the back into pieces of
exactly ``room`` ids, so only the first piece may be shorter; whole pieces are sequences of their own. The others are
dealt at random to partitions of about ``deal`` pieces, each packed by best-fit decreasing. A partition's
count of sequences is compared with a lower bound from dual-feasible functions: a count that meets the
rounded bound is certified for the partition, and what it has above the plain one is its gap. Partitions with a gap give
up their emptiest sequences, as many as hold most of the gap's room. What was given up is dealt anew and packed again, until
one partition is left, nothing is given up or ``rounds`` are over. No task ever holds more than a partition.

A null text counts as an empty one (one piece holding the end id); repeated rows are packed each for
itself; ties in length are packed in the order of the rows in the input; an empty table gives no rows. Control
strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import pieces, table_batch
from tidewatch.session import durable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])
#: Texts longer than this are encoded in blocks that end before a blank between two words.
BLOCK = 1 << 20
#: The pattern of the fast encoder recurses on blanks; longer runs of them go to the other one.
BLANK_RUN = 10_000
_LONG_BLANKS = re.compile(r"\s{%d}" % BLANK_RUN)
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Pieces of a task's output batch.
ROWS = 20_000


@dataclass(frozen=True)
class Tokens:
    """A vocabulary in two forms with equal ids: ranks of byte strings, and the tokenizer's own file."""

    ranks: str
    tokenizer: str
    pattern: str


@dataclass(frozen=True)
class Packing:
    room: int = 2048
    end: int = 0
    deal: int = 4096
    rounds: int = 6
    share: float = 0.9


@lru_cache(maxsize=2)
def _encoders(tokens: Tokens):
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokens.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    slow = Tokenizer.from_file(tokens.tokenizer)
    slow.encode_special_tokens = True
    return tiktoken.Encoding("packing", pat_str=tokens.pattern, mergeable_ranks=ranks, special_tokens={}), slow


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks that the pattern never joins: a blank after a letter or digit begins a match."""
    start = 0
    while len(text) - start > BLOCK:
        cut = _SAFE_CUT.search(text, start + BLOCK)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, tokens: Tokens) -> np.ndarray:
    """Ids of a text, equal to those of the tokenizer's own library without added special tokens."""
    fast, slow = _encoders(tokens)
    parts = []
    for block in _blocks(text):
        if len(block) >= BLANK_RUN and _LONG_BLANKS.search(block):
            parts.append(np.array(slow.encode_batch_fast([block], add_special_tokens=False)[0].ids, np.uint32))
        else:
            parts.append(np.array(fast.encode_ordinary(block), np.uint32))
    return np.concatenate(parts)


def token_pieces(docs: DataFrame, tokens: Tokens, p: Packing = Packing()) -> DataFrame:
    """One row per piece: document, number, ids before it, length, checksum of its ids, and a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        for rows, texts in pieces(batches):
            for doc, text in zip(rows.column("doc_id").to_pylist(), texts):
                ids = np.append(encode(text.decode("utf-8", "replace"), tokens), np.uint32(p.end)).astype("<u4")
                start, number = 0, 0
                length = (len(ids) - 1) % p.room + 1
                while start < len(ids):
                    held.append((doc, number, start, length, zlib.crc32(ids[start : start + length].tobytes()), row))
                    start, number, length, row = start + length, number + 1, p.room, row + 1
            if len(held) >= ROWS:
                yield table_batch(_PIECES, list(zip(*held)))
                held = []
        if held:
            yield table_batch(_PIECES, list(zip(*held)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


@lru_cache(maxsize=4)
def dual_feasible(room: int, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Functions f with sum f(x) <= f's unit for any lengths x that fit into one sequence, tabulated for 0 to room.

    One for each threshold up to half the room (lengths below it count nothing, those above the rest count
    whole) and one rounding function for each number of steps. Returns the tables and their units.
    """
    x = np.arange(room + 1, dtype=np.int64)
    tables, units = [], []
    for least in range(room // 2 + 1):
        tables.append(np.where(x > room - least, room, np.where(x < least, 0, x)))
        units.append(room)
    for k in range(1, steps + 1):
        whole, part = np.divmod((k + 1) * x, room)
        tables.append(np.where(part == 0, k * x, whole * room))
        units.append(k * room)
    return np.array(tables), np.array(units, np.int64)


def lower_bound(counts: np.ndarray) -> float:
    """At least so many sequences are needed; ``counts`` holds the number of pieces of each length up to the room."""
    tables, units = dual_feasible(len(counts) - 1)
    return float((tables @ counts.astype(np.int64) / units).max())


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence and offset, and the free room of each sequence."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    open_rooms = 0  # bit r: some sequence has r ids free
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = open_rooms >> length
        if fitting:
            r = length + (fitting & -fitting).bit_length() - 1
            s = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            r, s = room, len(free)
            free.append(room)
        sequence[i], offset[i] = s, room - r
        free[s] = left = r - length
        if not by_room[left]:
            open_rooms |= 1 << left
        by_room[left].append(s)
    return sequence, offset, np.array(free, np.int64)


def given_up(free: np.ndarray, gap: float, p: Packing) -> np.ndarray:
    """Which sequences go back: the emptiest, until their free room makes up the stated share of the gap's."""
    order = np.argsort(-free, kind="stable")
    enough = int(np.searchsorted(np.cumsum(free[order]), p.share * gap * p.room)) + 1
    chosen = np.zeros(len(free), bool)
    chosen[order[:enough]] = gap > 1e-9
    return chosen & (free > 0)


def _packed(p: Packing, turn: int, last: bool):
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        lengths = rows.column("length").to_numpy()
        sequence, offset, free = best_fit(lengths, p.room)
        ids = (turn << 56) + (key[0].as_py() << 20) + sequence
        if last:
            back = np.zeros(len(ids), bool)
        else:
            gap = len(free) - lower_bound(np.bincount(lengths, minlength=p.room + 1))
            back = given_up(free, gap, p)[sequence]
        packed = [*(rows.column(f.name) for f in _PIECES), pa.array(ids, mask=back), pa.array(offset, mask=back)]
        return pa.table(packed, schema=schema)

    return pack


def pack(table: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Pieces (a written table of the columns of ``PIECES``) with sequence_id and offset."""
    done = [table.filter(F.col("length") == p.room).select("*", (F.lit(-1) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = table.filter(F.col("length") < p.room)
    for turn in range(p.rounds):
        parts = -(-rest.count() // p.deal)
        if not parts:
            break
        last = parts == 1 or turn == p.rounds - 1
        dealt = rest.withColumn("part", F.expr(f"pmod(xxhash64(row, {turn}), {parts}L)"))
        packed = durable(dealt.groupBy("part").applyInArrow(_packed(p, turn, last), f"{PIECES}, sequence_id long, offset long"))
        done.append(packed.filter("sequence_id IS NOT NULL"))
        rest = packed.filter("sequence_id IS NULL").select(*table.columns)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def packed_documents(docs: DataFrame, tokens: Tokens, p: Packing = Packing()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``least_sequences``, the bound for the whole table."""
    table = durable(token_pieces(docs, tokens, p))
    counts = np.zeros(p.room + 1, np.int64)
    for r in table.groupBy("length").count().collect():  # at most one row per length
        counts[r["length"]] = r["count"]
    return pack(table, p).drop("row").withColumn("least_sequences", F.lit(math.ceil(lower_bound(counts) - 1e-6)).cast("long"))

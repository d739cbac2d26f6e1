"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece of text is a row of byte symbols. The leaves of a segment tree hold, for each live symbol, the rank of
the pair it forms with its right neighbour and its position; the root is then the leftmost pair of lowest
rank. A merge changes three leaves (the merged symbol, its left neighbour, the consumed right one), each in
logarithmic steps. Many pieces of similar length are merged side by side in numpy arrays, one merge per piece
and round; a piece of any length takes the same path.

Defined results: a null text is an empty one and has no ids; decoding returns the exact UTF-8 bytes.
The vocabulary file is a parameter and must lie at that path on every executor.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 — used as pa.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import pieces, starts_of

_NONE = np.int64(2**62)
_BETWEEN = "\u2028"
_LOOSE = re.compile(r" \s|\s |\A\s|\s\Z")
_loaded: dict[tuple[str, str], "Bpe"] = {}


def load(path: str, pattern: str) -> "Bpe":
    """One codec per worker process and file."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        _loaded[path, pattern] = Bpe(ranks, pattern)
    return _loaded[path, pattern]


class Bpe:
    """``ranks``: id of each byte string, every single byte included; lower ids merge first."""

    #: Chunks whose ids are kept in memory, and the most characters of each; beyond that the kept ones are forgotten.
    KEPT, KEPT_CHARS = 600_000, 40

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        #: Ids are held as packed 32-bit numbers: as Python objects they would take several times the memory.
        self.whole = {token: np.int32(rank).tobytes() for token, rank in ranks.items()}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (left << 20 | right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        self.keys, self.merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self.kept: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys.take(at) == key, self.merged.take(at), _NONE)

    def _merge(self, texts: list[bytes], width: int) -> list[bytes]:
        """BPE of byte strings of 2 to ``width`` bytes, side by side; ``width`` is a power of two.

        A symbol is addressed by ``row * width + position``; one cell past the end stands for "no neighbour".
        """
        n, last, low = len(texts), len(texts) * width, width - 1
        lengths = np.array([len(t) for t in texts])
        cells = np.tile(np.arange(width), n)
        inside = cells < np.repeat(lengths, width)
        ids = np.append(np.where(inside, self.byte_ids[np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8)], 1 << 19), 1 << 19)
        live = inside.copy()
        places = np.arange(last)
        after = np.append(np.where(inside & (cells + 1 < np.repeat(lengths, width)), places + 1, last), last)
        before = np.append(np.where(cells > 0, places - 1, last), last)

        def pair(left):
            """Leaf value of the pair that starts at ``left``: its rank, then its position."""
            rank = self._pair_ranks(ids.take(left), ids.take(after.take(left)))
            return np.where(rank < _NONE, rank * width + (left & low), _NONE)

        tree = np.full((n, 2 * width), _NONE)
        tree[:, width:] = pair(places).reshape(n, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()

        def put(place, value):
            node = place + (place & ~low) + width
            tree[node] = value
            for _ in range(width.bit_length() - 1):
                value = np.minimum(value, tree.take(node ^ 1))
                row = node & ~(2 * width - 1)
                node = row + ((node - row) >> 1)
                tree[node] = value

        rows = np.arange(n)
        while True:
            root = tree.take(rows * (2 * width) + 1)
            going = root < _NONE
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            at = rows * width + (root & low)
            gone = after.take(at)
            ids[at] = root // width
            live[gone] = False
            following = after.take(gone)
            after[at] = following
            before[following] = at
            put(gone, np.full(len(gone), _NONE))
            put(at, pair(at))
            left = before.take(at)
            left = left[left < last]
            put(left, pair(left))
        merged = ids[:last][live].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(live.reshape(n, width).sum(axis=1))).tolist()
        return [merged[x:y] for x, y in zip([0, *ends], ends)]

    def encode_pieces(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of pieces that the pattern has cut already; a piece that is a token as a whole is that token."""
        out: list[bytes | None] = [self.whole.get(t) if t else b"" for t in texts]
        groups: dict[int, list[int]] = {}
        for i, found in enumerate(out):
            if found is None:
                groups.setdefault(1 << (len(texts[i]) - 1).bit_length(), []).append(i)
        for width, members in groups.items():
            step = max(1, (1 << 17) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([texts[i] for i in part], width)):
                    out[i] = ids
        return out

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        distinct = list(set(chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct])))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that begin with a space; all are cut in one call, with a blank between them that no match joins."""
        plain = [c for c in chunks if _BETWEEN not in c]
        found = self.pattern.findall(_BETWEEN.join(plain))
        distinct = list(set(found))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct])))
        out, now = [], []
        for piece in found:
            if piece == _BETWEEN:
                out.append(b"".join(now))
                now = []
            else:
                now.append(ids[piece])
        out.append(b"".join(now))
        done = dict(zip(plain, out))
        odd = [c for c in chunks if _BETWEEN in c]
        done.update(zip(odd, self._encode_whole(odd)))
        return [done[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. No match of the pattern crosses from a non-blank to a following space, so a text is
        encoded by its space-separated chunks, each distinct chunk once; a text with other blanks next to a
        space, or at its ends, is cut as a whole."""
        split = {i: t.split(" ") for i, t in enumerate(texts) if t and not _LOOSE.search(t)}
        needed = set(chain.from_iterable(c[1:] for c in split.values()))
        missing = list(needed - self.kept.keys())
        if len(self.kept) + len(missing) > self.KEPT:  # what this batch uses again is likely to be frequent
            self.kept = {c: self.kept[c] for c in needed & self.kept.keys()}
        self.kept.update(zip(missing, self._encode_chunks([f" {c}" for c in missing])))
        out = [b""] * len(texts)
        firsts = self._encode_whole([c[0] for c in split.values()])
        for (i, chunks), first in zip(split.items(), firsts):
            out[i] = first + b"".join(map(self.kept.__getitem__, chunks[1:]))
        for chunk in missing:  # long ones hardly come again, and would make the memory depend on the texts
            if len(chunk) > self.KEPT_CHARS:
                del self.kept[chunk]
        whole = [i for i in range(len(texts)) if i not in split]
        for i, ids in zip(whole, self._encode_whole([texts[i] for i in whole])):
            out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _with_columns(df: DataFrame, source: str, added: dict[str, tuple[T.DataType, pa.DataType]], values, drop: bool = False) -> DataFrame:
    """Add columns computed from one other column, batch by batch; every other column passes through."""
    kept = [c for c in df.columns if c not in added and not (drop and c == source)]

    def run(batches):
        for batch in batches:
            for rows, columns in values(batch):
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), *columns], [*kept, *added])

    fields = [T.StructField(name, kind) for name, (kind, _) in added.items()]
    return df.select(*kept, F.col(source).alias("__in")).mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, *fields]))


_IDS, _BYTES = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), (T.BinaryType(), pa.binary())


def _coded(codec: Bpe, batch: pa.RecordBatch):
    """Runs of a batch's rows with the ids of their texts."""
    for rows, texts in pieces(iter([batch]), "__in"):
        coded = codec.packed([t.decode() for t in texts])
        ends = pa.array((starts_of([len(x) for x in coded]) // 4).astype(np.int32))
        yield rows, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _decoded(codec: Bpe, column: pa.ListArray) -> pa.Array:
    ids, ends = column.flatten().tolist(), starts_of(pa.compute.list_value_length(column).to_pylist())
    return pa.array([codec.decode(ids[x:y]) for x, y in zip(ends, ends[1:])], pa.binary())


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int): the text's token ids."""

    def values(batch):
        for rows, coded in _coded(load(path, pattern), batch):
            yield rows, [coded]

    return _with_columns(df, text, {ids: _IDS}, values)


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes that the ids stand for."""

    def values(batch):
        for start in range(0, batch.num_rows, 500):
            rows = batch.slice(start, 500)
            yield rows, [_decoded(load(path, pattern), rows.column(rows.num_columns - 1).fill_null([]))]

    return _with_columns(df, ids, {out: _BYTES}, values)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace the text by its ``ids`` and the bytes decoded from them, in one pass, so that a task needs one codec."""

    def values(batch):
        codec = load(path, pattern)
        for rows, coded in _coded(codec, batch):
            yield rows, [coded, _decoded(codec, coded)]

    return _with_columns(df, text, {ids: _IDS, out: _BYTES}, values, drop=True)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document, from the ids and the bytes decoded from them."""
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

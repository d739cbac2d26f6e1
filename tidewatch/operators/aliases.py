"""Organizations, countries and regions in text, found through a reviewed alias table.

The aliases form a trie of words kept as a table (node, token, next): a node stands for a prefix of words. Texts are cut
into words once, and a bitmap of fixed size, set by the hashes of all aliases, holds back the places where none can begin. Every
other place starts at the root and follows the trie by equi-joins on (node, token), one join per word; these compare the words
themselves, so a place that the bitmap let pass in vain ends there. Of overlapping aliases the leftmost
counts, of those at one place the longest. An alias that was reviewed for more than one entity resolves to none:
its mentions stay, with role ``uncertain`` and without a value.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V
from tidewatch.session import durable

ALIAS_KINDS = ("country", "organization", "region")
#: Words of the longest alias that is followed; longer ones are refused, not shortened.
MOST_WORDS = 8
ROOT = 0
_WORD, _GAP = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")
#: Characters before a mention that its role is read from.
NEAR = 40
#: log2 of the bits of the filter of aliases, and the bits of one row of it.
FILTER_BITS, PAGE_BITS = 22, 1 << 15
#: Characters that are cut into words at once; a longer text is cut in pieces, each up to the end of a word.
PIECE = 1 << 17
#: Most rows of a batch that leaves the cutting.
ROWS = 10_000
_RADIX, _NEXT, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


# Tasks get the functions below by value, so workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class AliasTooLong(ValueError):
    """A reviewed alias has more words than the walk follows."""


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _node(words: Column) -> Column:
    return F.when(F.size(words) == 0, F.lit(ROOT).cast("long")).otherwise(F.xxhash64(F.array_join(words, " ")))


def spelled_aliases(aliases: DataFrame) -> tuple[DataFrame, int]:
    """(w, kind, value), w being the words of an alias, and the number of words of the longest."""
    spelled = durable(aliases.select(words_of(F.col("alias")).alias("w"), "kind", "value").filter(F.size("w") > 0))
    longest = spelled.agg(F.coalesce(F.max(F.size("w")), F.lit(0))).first()[0]
    if longest > MOST_WORDS:
        raise AliasTooLong(f"{longest} words, at most {MOST_WORDS}")
    return spelled, longest


def alias_trie(aliases: DataFrame) -> DataFrame:
    """(node, token, next, kind, value, senses): edges of the trie; kind and value where an alias ends.

    ``aliases``: alias, kind, value. ``senses`` counts the entities an alias was reviewed for; with more than one, value is null.
    """
    return _trie(spelled_aliases(aliases)[0])


def _trie(spelled: DataFrame) -> DataFrame:
    steps = spelled.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"))
    edges = steps.select(_node(F.slice("w", 1, F.col("k") - 1)).alias("node"), F.get("w", F.col("k") - 1).alias("token"),
                         _node(F.slice("w", 1, F.col("k"))).alias("next")).distinct()
    ends = spelled.groupBy(_node(F.col("w")).alias("next")).agg(
        F.count_distinct("kind", "value").alias("senses"), F.min("kind").alias("kind"), F.max("kind").alias("other"), F.min("value").alias("value"))
    clear = F.col("senses") == 1
    ends = ends.select("next", "senses", F.when(F.col("kind") == F.col("other"), F.col("kind")).alias("kind"), F.when(clear, F.col("value")).alias("value"))
    return edges.join(ends, "next", "left").select("node", "token", "next", "kind", "value", F.coalesce("senses", F.lit(0)).alias("senses"))


@lru_cache(maxsize=1)
def _letters() -> bytes:
    """One bit for each code point: whether ``_WORD`` takes it."""
    return np.packbits(np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), bool)).tobytes()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _lowered(text: str) -> str:
    """The text with each word in lower case, code point by code point.

    Only İ has a longer lower case, one that no word of an alias contains; only that of Σ depends on what is beside it.
    """
    text = text.replace("\u0130", "I")
    return _WORD.sub(lambda m: m.group().lower(), text) if "\u03a3" in text else text.lower()


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the radix and of its inverse, modulo 2^64."""
    return [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_RADIX, np.uint64(pow(int(_RADIX), -1, 1 << 64)))]


def _word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each range of the code points: a polynomial, as a difference of running sums."""
    radix, inverse = powers if len(codes) < len(powers[0]) else _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * radix[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def _bits(runs: np.ndarray) -> np.ndarray:
    return ((runs ^ (runs >> np.uint64(32))) * _MIX >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def alias_filter(spelled: DataFrame) -> list[tuple[int, bytes]]:
    """The pages of a bitmap in which every alias has set the bit of its hash; at most 2^FILTER_BITS bits, however many aliases."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spellings = batch.column("w").to_pylist()
            ends = np.cumsum([len(w) for words in spellings for w in words], dtype=np.int64)
            codes = _codes("".join(w for words in spellings for w in words))
            hashes = _word_hashes(codes, np.concatenate([[0], ends])[:-1].astype(np.int64), ends, _powers(len(codes)))
            sizes = np.array([len(words) for words in spellings], np.int64)
            first = np.cumsum(sizes) - sizes
            runs = hashes[first]
            for k in range(1, sizes.max(initial=0)):
                more = sizes > k
                runs[more] = runs[more] * _NEXT + hashes[first[more] + k]
            yield pa.RecordBatch.from_arrays([pa.array(_bits(runs))], ["bit"])

    bit = F.col("bit")
    pages = spelled.select("w").distinct().mapInArrow(bits, "bit long").groupBy(F.floor(bit / PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(bit % PAGE_BITS).alias("bits"))
    return [(r.page, bytes(r.bits)) for r in pages.collect()]


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a text with their places; none begins or ends inside a word."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def _cut(text: str, letters: np.ndarray, powers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word."""
    found = []
    for at, piece in _pieces(text):
        codes = _codes(_lowered(piece))
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = letters[codes]
        turns = np.flatnonzero(np.diff(inside))
        starts, ends = turns[::2], turns[1::2]
        found.append((starts + at, ends + at, _word_hashes(codes, starts, ends, powers)))
    return tuple(np.concatenate(x) for x in zip(*found))


def placed_words(df: DataFrame, key: str, text: str, pages: list[tuple[int, bytes]], longest: int) -> DataFrame:
    """The words of a text at which an alias may begin, one row each.

    key, place (the number of the word), before (the text just before it), said (the text from it on), ahead (from it on up to
    ``longest`` words with their code-point offsets). Texts are cut many at once; a run of words whose bit is not set is no alias.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL")
    packed = _letters()
    ahead = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    fields = {"at": pa.int64(), "place": pa.int32(), "before": pa.string(), "said": pa.string(), "ahead": ahead}

    def candidates(texts: list[str], known: np.ndarray, *tables) -> Iterator[tuple]:
        """Texts are put behind each other; a run of words may not leave its text."""
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
        whole = "\n".join(texts)
        starts, ends, hashes = _cut(whole, *tables)
        bounds = np.searchsorted(starts, firsts)  # first word of each text
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        runs, may = hashes, np.zeros(len(hashes), bool)
        for k in range(longest):
            if k:
                runs = runs[:-1] * _NEXT + hashes[k:]
            may[: len(runs)] |= known[_bits(runs)] & (owner[: len(runs)] == owner[k:])
            if len(runs) < 2:
                break
        for i in np.flatnonzero(may).tolist():
            at = int(owner[i])
            first, upto = int(firsts[at]), min(i + longest, int(bounds[at + 1]))
            begins, stops = starts[i:upto].tolist(), ends[i:upto].tolist()
            words = [{"token": whole[s:e].lower(), "start": s - first, "end": e - first} for s, e in zip(begins, stops)]
            yield at, i - int(bounds[at]), whole[max(begins[0] - NEAR, first) : begins[0]], whole[begins[0] : stops[-1]], words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = np.zeros(1 << FILTER_BITS, bool), (np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool), _powers(2 * PIECE))
        for page, bits in pages:
            known[page * PAGE_BITS : (page + 1) * PAGE_BITS] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(), dtype=np.int64)
            seams = [0, *(np.flatnonzero(np.diff(sizes // PIECE)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(seams, seams[1:]):
                part = batch.slice(begin, end - begin)
                found = candidates(part.column("text").to_pylist(), known, *tables)
                while some := list(islice(found, ROWS)):
                    columns = [pa.array(c, t) for c, t in zip(zip(*some), fields.values())]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(columns[0]), *columns[1:]], ["key", *list(fields)[1:]])

    out = f"key {kind.simpleString()}, place int, before string, said string, ahead array<struct<token:string,start:int,end:int>>"
    return rows.mapInArrow(cut, out).withColumnRenamed("key", key)


def alias_matches(words: DataFrame, key: str, trie: DataFrame, longest: int) -> DataFrame:
    """(key, place, size, start, end, kind, value, before, raw): every alias that begins at a word, of each place the longest."""
    edges = durable(trie)
    now = words.withColumn("node", F.lit(ROOT).cast("long"))
    found = None
    for k in range(max(longest, 1)):
        step = now.withColumn("token", F.get("ahead", F.lit(k))["token"]).join(edges, ["node", "token"])
        now = durable(step.drop("node", "token").withColumnRenamed("next", "node"))
        start, end = F.get("ahead", F.lit(0))["start"], F.get("ahead", F.lit(k))["end"]
        ended = now.filter("senses > 0").select(
            key, "place", F.lit(k + 1).alias("size"), start.alias("start"), end.alias("end"), "kind", "value", "before", F.substr("said", F.lit(1), end - start).alias("raw"))
        found = ended if found is None else found.unionByName(ended)
        now = now.drop("kind", "value", "senses").filter(F.size("ahead") > k + 1)
        if now.isEmpty():
            break
    longest_of = found.groupBy(key, "place").agg(F.max(F.struct("size", "start", "end", "kind", "value", "before", "raw")).alias("m"))
    return longest_of.select(key, "place", "m.*")


def apart(matches: DataFrame, key: str) -> DataFrame:
    """Of overlapping matches the leftmost, then the next one behind it, and so on."""
    row = F.struct("place", "size", "start", "end", "kind", "value")
    per = matches.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("m"))

    def keep(acc: Column, m: Column) -> Column:
        fits = m["place"] >= acc["upto"]
        return F.struct(F.when(fits, m["place"] + m["size"]).otherwise(acc["upto"]).alias("upto"),
                        F.when(fits, F.array_append(acc["places"], m["place"])).otherwise(acc["places"]).alias("places"))

    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("places"))
    chosen = per.select(key, F.explode(F.aggregate("m", start, keep, lambda acc: acc["places"])).alias("place"))
    return matches.join(chosen, [key, "place"])


def alias_mentions(df: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, kind, value, raw, start, end, before: mentions of reviewed aliases in the whole text; start inclusive, end exclusive.

    ``value`` is null where the alias was reviewed for several entities, ``kind`` too where these differ in kind; ``before`` holds the
    up to ``NEAR`` characters in front of a mention. Null and empty texts have no mentions; keys are taken to be unique.
    """
    spelled, longest = spelled_aliases(aliases)
    words = placed_words(df, key, text, alias_filter(spelled), longest)
    found = apart(durable(alias_matches(words, key, _trie(spelled), longest)), key)
    return found.select(key, "kind", "value", "raw", "start", "end", "before")


def mention_role(kind: Column, value: Column, field: Column, host: Column, before: Column) -> Column:
    """How a mention takes part in its report: publisher, uncertain, affected, subject or mentioned.

    The report's own host is its publisher, never a subject. What no single reviewed entity stands behind is uncertain. What follows
    a word of harm is affected; what the headline or a structured field names is a subject; the rest is mentioned.
    """
    own = (kind == "domain") & ((value == host) | host.endswith(F.concat(F.lit("."), value)) | value.endswith(F.concat(F.lit("."), host)))
    return (
        F.when(F.coalesce(own, F.lit(False)), "publisher").when(value.isNull(), "uncertain")
        .when(F.coalesce(before, F.lit("")).rlike(V.AFFECTED_BEFORE), "affected")
        .when(field.isin("title", "structured_subject"), "subject").otherwise("mentioned")
    )


def with_roles(mentions: DataFrame, df: DataFrame, key: str, text: str, field: str, host: Column) -> DataFrame:
    """Add ``field`` and ``role`` to the mentions of one text column; mentions without ``before`` are read in the text again."""
    facts = df.select(key, host.alias("__host"), F.col(text).alias("__told"))
    known = "before" in mentions.columns
    before = F.col("before") if known else F.substr("__told", F.greatest(F.col("start") - NEAR, F.lit(0)) + 1, F.least(F.col("start"), F.lit(NEAR)))
    role = mention_role(F.col("kind"), F.col("value"), F.lit(field), F.col("__host"), before)
    return mentions.join(facts.drop("__told") if known else facts, key).withColumns({"field": F.lit(field), "role": role}).drop("__host", "__told", "before")

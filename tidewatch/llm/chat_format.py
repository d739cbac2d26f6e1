"""Chat formatting: a record's nested field paths choose the mapping that turns it into canonical turns.

The fingerprint of a record is a hash of its sorted field paths (list items share one path). Each mapping is
declared by the paths it serves and by where its turns lie; records with an unknown fingerprint give one row
without a role, so that nothing is lost silently. Turns are then written by a template whose control strings
are escaped reversibly inside texts, with the range of assistant text marked for the loss.

Defined results: null texts and roles are empty; a null record has no paths and an unknown layout; turns of
a conversation follow (turn, role, text), so repeated turn numbers have one order; a conversation of any
length is read as a stream.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: First characters of control strings (of this and other chat templates) and of escapes; one ``\\`` is put behind each.
CONTROL = r"(\\|<(?=s>|/s>|<SYS>>|</SYS>>|\|)|\[(?=/?INST\])|\|(?=>))"
_PIECE = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """``paths``: the fields of such a record. ``turns``: (role, fields joined by a blank line), or, with ``items``, the
    list that holds the turns and its role and text fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("turn row", ("role", "text"), items=("", "role", "text")),
    Layout("prompt and completion", ("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", ("prompt", "response", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("from and value", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all fields below ``value``; items of a list share the path of the list and ``[]``."""
    if isinstance(value, dict):
        return set().union(*({f"{at}.{k}" if at else k} | field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*({f"{at}[]"} | field_paths(v, f"{at}[]") for v in value))
    return set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def turns_of(record: str | None, by_print: dict[str, Layout]) -> tuple[str, str | None, list[tuple[str | None, str]]]:
    """(fingerprint, layout name, turns) of one JSON record."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    mark = fingerprint(field_paths(value))
    layout = by_print.get(mark)
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True)
    if layout is None:
        return mark, None, [(None, text(record))]
    if layout.items is None:
        return mark, layout.name, [(role, "\n\n".join(filter(None, (text(value[f]) for f in fields)))) for role, fields in layout.turns]
    where, role, body = layout.items
    items = value[where] if where else [value]
    return mark, layout.name, [(ROLES.get(text(i.get(role)), text(i.get(role))), text(i.get(body))) for i in items if isinstance(i, dict)]


def canonical_turns(records: DataFrame, keys: list[str], record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """keys, fingerprint, layout, seq, role, text: one row per turn of each JSON record."""
    names = ["fingerprint", "layout", "seq", "role", "text"]
    kinds = [T.StringType(), T.StringType(), T.IntegerType(), T.StringType(), T.StringType()]
    schema = T.StructType([*records.select(*keys).schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    by_print = {fingerprint(x.paths): x for x in layouts}

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                at, out = [], []
                for i, text in enumerate(rows.column(len(keys)).to_pylist()):
                    mark, layout, turns = turns_of(text, by_print)
                    at += [i] * len(turns)
                    out += [(mark, layout, n, role, said) for n, (role, said) in enumerate(turns)]
                own = rows.take(pa.array(at, pa.int32()))
                columns = list(zip(*out)) or [[]] * 5
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(columns, types))], [*keys, *names])

    return records.select(*keys, F.col(record).alias("__record")).mapInArrow(run, schema)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: DataFrame) -> DataFrame:
    """Add ``piece``, the turn under the template, and ``loss_from`` and ``loss_to``, its range under the loss (code points)."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    piece = F.concat(F.lit(OPEN), role, F.lit(f"{CLOSE}\n"), text, F.lit(f"{END}\n"))
    start = F.length(role) + len(OPEN) + len(CLOSE) + 1
    under = F.col("role") == "assistant"
    return turns.withColumns({"piece": piece, "loss_from": F.when(under, start), "loss_to": F.when(under, start + F.length(text))})


def parse(piece: str) -> list[tuple[str, str]]:
    """The turns that formatted text holds."""
    return [(unescape(role), unescape(text)) for role, text in _PIECE.findall(piece)]


def read_back(pieces: DataFrame, order: list[str], conversation: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read from its formatted pieces as a stream in ``order``."""
    schema = f"{conversation} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = pa.schema([(conversation, pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        done, now, state = [], object(), None

        def close():
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for row in batch.slice(start, 500).to_pylist():
                    if state is None or row[conversation] != now:
                        close()
                        now, state = row[conversation], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in parse(row["piece"]):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    if row["loss_from"] is not None:
                        loss = unescape(row["piece"][row["loss_from"] : row["loss_to"]])
                        state[2] += len(loss)
                        state[3].update(loss.encode())
                    state[4] += len(row["piece"])
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    dealt = pieces.select(F.col(conversation).cast("long").alias(conversation), *order, "piece", "loss_from", "loss_to").repartition(F.col(conversation))
    return dealt.sortWithinPartitions(conversation, *order).mapInArrow(run, schema)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format rows of (conv_id, turn, role, text) as records and give each conversation's digests."""
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    turns = canonical_turns(conversations.select("conv_id", "turn", record.alias("record")), ["conv_id", "turn"])
    return read_back(formatted(turns).withColumnRenamed("text", "said"), ["turn", "role", "said"])

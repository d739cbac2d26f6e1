"""PII: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans: those of the base patterns in excerpts of a bounded sample of
documents, as they are and rewritten in place into forms that the patterns miss (phones without a plus, cards and
addresses with other separators, letters beyond ASCII). So it learns from the words around them, and adds such forms.
Windows of ``window`` characters start every ``stride`` characters and overlap by half. Every kind needs a
digit or an ``@``; decoded are the windows of every piece without blanks that holds one, to both of its ends. Each window
is decoded by Viterbi; where windows overlap, a character's tag is taken from the window in whose middle it lies, and spans
are then formed over the whole text, so that a span across a seam comes out once. Added spans that touch a base span
are dropped, as are those that fail their kind's test (octets, checksum, number of digits, a dotted domain).

Defined results: null and empty texts have no spans; without any labelled span the network adds none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
# A match never begins inside a run of digits, so a run is read from its begin only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
_UNBLANK = re.compile(r"\S+")
#: Texts that may hold a base span.
BASE_HINT = r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){12}|\+[0-9][ ().0-9-]{7}"
#: What may be data of a kind that the base patterns miss; training does not teach it as plain text.
_DOUBTFUL = re.compile(r"\S@\S|[0-9](?:[\s().,/\[\]-]{0,3}[0-9]){8,}|[0-9]+(?:[^0-9A-Za-z]{1,4}[0-9]+){3}")


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start, in time proportional to the text."""
    found, end = [], 0
    if "@" in text:
        # A local part is a run that ends before an @, or what an address before it has left of the run.
        for run in _LOCAL.finditer(text):
            start, at = max(run.start(), end), run.end()
            domain = _DOMAIN.match(text, at + 1) if start < at < len(text) and text[at] == "@" else None
            if domain:
                end = domain.end()
                found.append((0, start, end))
    if not re.search("[0-9]", text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


@dataclass(frozen=True)
class Pii:
    window: int = 64
    stride: int = 32
    width: int = 8
    hidden: int = 12
    #: Documents, and windows of each sort, that training reads.
    sample: int = 1500
    windows: int = 1500
    #: Places of each sort that training takes from one document, drawn from its whole text, and the characters around them.
    places: int = 8
    context: int = 96
    epochs: int = 6
    rate: float = 0.02
    seed: int = 23


def symbols(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, all else one class."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128).astype(np.int64)


def window_starts(text: str, p: Pii) -> np.ndarray:
    """Starts of the windows of the grid that hold a piece without blanks that has a trigger, to both of its ends."""
    last = max(0, -(-(len(text) - p.window) // p.stride))
    cells: set[int] = set()
    for run in _UNBLANK.finditer(text):
        if TRIGGER.search(text, run.start(), run.end()):
            cells.update(range(run.start() // p.stride, (run.end() - 1) // p.stride + 1))
    near = {c - k for c in cells for k in range(p.window // p.stride)} | {last} if cells else set()
    return np.array(sorted(min(max(c, 0), last) for c in near), np.int64) * p.stride if near else np.zeros(0, np.int64)


class Tagger:
    """Bidirectional LSTM under a linear-chain CRF; tag 0 is outside, tag k + 1 is kind k. Arrays are time-major."""

    def __init__(self, p: Pii):
        self.p, draw = p, np.random.default_rng(p.seed)
        h, tags = p.hidden, len(KINDS) + 1
        self.w = {"e": draw.normal(0, 0.3, (130, p.width))}
        for side in "fb":
            self.w[f"x{side}"] = draw.normal(0, 0.3, (p.width, 4 * h))
            self.w[f"u{side}"] = draw.normal(0, 0.3, (h, 4 * h))
            self.w[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)
        self.w |= {"o": draw.normal(0, 0.3, (2 * h, tags)), "d": np.zeros(tags), "t": np.zeros((tags, tags))}
        self.trained = False

    def _lstm(self, x, side):
        h, u = self.p.hidden, self.w[f"u{side}"]
        state, cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        states, trace = np.empty((*x.shape[:2], h)), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            raw = x[t] + state @ u
            gate = 1 / (1 + np.exp(-raw[:, : 3 * h]))
            new = np.tanh(raw[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            after = f * cell + i * new
            bent = np.tanh(after)
            trace.append((t, state, cell, i, f, o, new, bent))
            state, cell = o * bent, after
            states[t] = state
        return states, trace

    def _lstm_back(self, trace, side, d_states, grad):
        h, u = self.p.hidden, self.w[f"u{side}"]
        d_x = np.empty((*d_states.shape[:2], 4 * h))
        d_state, d_cell = np.zeros(d_states.shape[1:]), np.zeros(d_states.shape[1:])
        for t, state, cell, i, f, o, new, bent in reversed(trace):
            d = d_state + d_states[t]
            d_c = d_cell + d * o * (1 - bent**2)
            d_raw = np.concatenate([d_c * new * i * (1 - i), d_c * cell * f * (1 - f), d * bent * o * (1 - o), d_c * i * (1 - new**2)], axis=1)
            grad[f"u{side}"] += state.T @ d_raw
            d_state, d_cell = d_raw @ u.T, d_c * f
            d_x[t] = d_raw
        return d_x

    def emissions(self, chars):
        x = self.w["e"][chars]
        f, tf = self._lstm(x @ self.w["xf"] + self.w["cf"], "f")
        b, tb = self._lstm(x @ self.w["xb"] + self.w["cb"], "b")
        both = np.concatenate([f, b], axis=2)
        return both @ self.w["o"] + self.w["d"], (x, both, tf, tb)

    def gradient(self, chars, tags):
        """Mean negative log-likelihood per window, and its gradient."""
        e, (x, both, tf, tb) = self.emissions(chars)
        steps, n, k = e.shape
        move = self.w["t"]
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, steps):
            ahead[t] = e[t] + _log_sum(ahead[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            behind[t] = _log_sum(move + (e[t + 1] + behind[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        d_e = np.exp(ahead + behind - total[:, None])
        pair = np.exp(ahead[:-1, :, :, None] + move + (e[1:] + behind[1:])[:, :, None, :] - total[:, None, None]).sum(axis=(0, 1))
        gold = np.zeros((k, k))
        np.add.at(gold, (tags[:-1], tags[1:]), 1)
        hot = np.eye(k)[tags]
        loss = (total - (e * hot).sum(axis=(0, 2)) - move[tags[:-1], tags[1:]].sum(axis=0)).mean()
        d_e = (d_e - hot) / n
        grad = {name: np.zeros_like(v) for name, v in self.w.items()}
        grad["t"] = (pair - gold) / n
        grad["o"], grad["d"] = both.reshape(-1, both.shape[2]).T @ d_e.reshape(-1, k), d_e.sum(axis=(0, 1))
        d_both = d_e @ self.w["o"].T
        h, d_in = self.p.hidden, 0
        for side, trace, d in (("f", tf, d_both[..., :h]), ("b", tb, d_both[..., h:])):
            d_x = self._lstm_back(trace, side, d, grad)
            grad[f"x{side}"] = x.reshape(-1, self.p.width).T @ d_x.reshape(-1, 4 * h)
            grad[f"c{side}"] = d_x.sum(axis=(0, 1))
            d_in = d_in + d_x @ self.w[f"x{side}"].T
        grad["e"] = np.stack([np.bincount(chars.ravel(), d_in[..., d].ravel(), 130) for d in range(self.p.width)], axis=1)
        return loss, grad

    def decode(self, chars):
        """Viterbi tags of windows."""
        e, _ = self.emissions(chars)
        best, back = e[0], []
        for t in range(1, len(e)):
            scores = best[:, :, None] + self.w["t"]
            back.append(scores.argmax(axis=1))
            best = scores.max(axis=1) + e[t]
        tags = np.empty(e.shape[:2], np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(len(e) - 2, -1, -1):
            tags[t] = np.take_along_axis(back[t], tags[t + 1][:, None], 1)[:, 0]
        return tags

    def tag(self, texts: list[str]) -> list[np.ndarray | None]:
        """One tag per character of each text, reconciled over its windows; None where no window has a trigger."""
        p, out, chars, place = self.p, [None] * len(texts), [], []
        if not self.trained:
            return out
        for i, text in enumerate(texts):
            starts = window_starts(text, p)
            if len(starts):
                padded = np.append(symbols(text), np.full(p.window, 129))
                chars += [padded[s : s + p.window] for s in starts]
                place += [(i, s) for s in starts]
                out[i] = np.zeros(len(text), np.int64)
        edge = (p.window - p.stride) // 2
        for a in range(0, len(chars), 1024):
            tags = self.decode(np.array(chars[a : a + 1024]).T).T
            for (i, s), own in zip(place[a : a + 1024], tags):
                first = 0 if s == 0 else edge
                stop = min(p.window if s + p.window >= len(texts[i]) else p.window - edge, len(texts[i]) - s)
                if stop > first:
                    out[i][s + first : s + stop] = own[first:stop]
        return out

    def added(self, text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the network that touch no base span and hold what their kind wants."""
        cuts = np.flatnonzero(np.diff(tags)) + 1
        taken = np.zeros(len(text) + 1, bool)
        for _, a, b in base:
            taken[a:b] = True
        found = []
        for a, b in zip([0, *cuts], [*cuts, len(tags)]):
            kind = int(tags[a]) - 1
            if kind >= 0:
                a, b = trimmed(text, kind, int(a), int(b))
                if a < b and not taken[a:b].any() and plausible(text[a:b], kind):
                    found.append((kind, a, b))
        return sorted(found)


def trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """The span without what can't be its first or last character."""
    inner = str.isalnum if kind == 0 else str.isdigit
    while start < end and not inner(text[start]) and not (kind == 3 and text[start] in "(+"):
        start += 1
    while end > start and not inner(text[end - 1]):
        end -= 1
    return start, end


def plausible(said: str, kind: int) -> bool:
    """Could a tagged text be data of its kind: one @ before a dotted domain, four octets, a card's checksum, a phone's digits."""
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", said) is not None
    numbers = re.findall("[0-9]+", said)
    digits = "".join(numbers)
    if re.search("[A-Za-z]", said):
        return False
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


_FOREIGN = str.maketrans("aeounscz", "áéöüñśćž")


def rewritten(said: str, kind: int, draw: np.random.Generator) -> str:
    """The same data in a form that the base patterns miss."""
    digits = re.sub("[^0-9]", "", said)
    if kind == 0:
        local, _, domain = said.partition("@")
        parts = (local.translate(_FOREIGN), domain) if draw.random() < 0.5 else (local, domain.translate(_FOREIGN))
        return "@".join(parts)
    if kind == 1:
        return str(draw.choice([" . ", "[.]", ",", " "])).join(said.split("."))
    if kind == 2:
        mark = str(draw.choice([".", "/", "  ", " - ", "_"]))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    mark, cut = str(draw.choice([" ", "-", ".", ""])), len(digits) - 4
    head, middle, tail = digits[: max(cut - 3, 1)], digits[max(cut - 3, 1) : cut], digits[cut:]
    return str(draw.choice(["00", "(", "", "tel:"])).replace("tel:", "") + mark.join(x for x in (head, middle, tail) if x)


def _with_rewritten(text: str, spans: list[tuple[int, int, int]], draw: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every span in another form, and where the spans are then."""
    parts, placed, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        said = rewritten(text[a:b], kind, draw)
        size += a - at
        parts += [text[at:a], said]
        placed.append((kind, size, size + len(said)))
        size, at = size + len(said), b
    return "".join([*parts, text[at:]]), placed


def excerpts(text: str, p: Pii) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Pieces around at most ``p.places`` spans and as many other triggers, drawn from the whole text, with their spans."""
    spans = base_spans(text)
    draw = np.random.default_rng([p.seed, len(text), len(spans)])
    bare = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
    for _, a, b in spans:
        bare = bare[(bare < a - p.context) | (bare >= b + p.context)]
    middles = [spans[i][1:] for i in sorted(draw.permutation(len(spans))[: p.places])]
    middles += [(int(bare[i]), int(bare[i]) + 1) for i in sorted(draw.permutation(len(bare))[: p.places])]
    found = []
    for a, b in middles:
        first, stop = max(0, a - p.context), min(len(text), b + p.context)
        whole = [(k, x - first, y - first) for k, x, y in spans if first <= x and y <= stop]
        cut = [max(x, first) - first for _, x, y in spans if x < stop < y or x < first < y]
        if not cut:
            found.append((text[first:stop], whole))
    return found


def fit(texts: list[str], p: Pii = Pii()) -> Tagger:
    """Train on the labelled base spans of whole texts."""
    return fit_excerpts([piece for text in texts for piece in excerpts(text, p)], p)


def fit_excerpts(pieces_: list[tuple[str, list[tuple[int, int, int]]]], p: Pii = Pii()) -> Tagger:
    """Train on pieces of text with labelled spans.

    Each piece is read as it is and with its spans rewritten into forms that the base patterns miss, in the
    same context. Windows without a span teach plain text, unless they hold what may be such a form.
    """
    net, draw = Tagger(p), np.random.default_rng(p.seed)
    inside, changed, outside = [], [], []
    for text, spans in pieces_:
        for kept, (said, labelled) in ((inside, (text, spans)), (changed, _with_rewritten(text, spans, draw) if spans else ("", []))):
            tags = np.zeros(len(said) + p.window, np.int64)
            for kind, a, b in reversed(labelled):
                tags[a:b] = kind + 1
            chars = np.append(symbols(said), np.full(p.window, 129))
            for s in window_starts(said, p):
                own = tags[s : s + p.window]
                if own.any():
                    kept.append((chars[s : s + p.window], own))
                elif not _DOUBTFUL.search(said, s, s + p.window):
                    outside.append((chars[s : s + p.window], own))
    if not inside:
        return net
    pick = lambda rows: [rows[i] for i in draw.permutation(len(rows))[: p.windows]]
    rows = pick(inside) + pick(changed) + pick(outside)
    chars, tags = (np.array([r[j] for r in rows]) for j in (0, 1))
    moments, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}, 0
    for _ in range(max(p.epochs, min(60, 6000 // len(rows)))):
        order = draw.permutation(len(rows))
        for a in range(0, len(order), 64):
            part = order[a : a + 64]
            _, grad = net.gradient(chars[part].T, tags[part].T)
            step += 1
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                net.w[k] = net.w[k] - p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.trained = True
    return net


def train(docs: DataFrame, p: Pii = Pii()) -> Tagger:
    """Fit on excerpts of at most ``p.sample`` documents that hold a base span, lowest by a hash of id and text."""
    known = docs.filter(F.col("text").rlike(BASE_HINT)).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    cut = known.select("h").orderBy("h").limit(p.sample).agg(F.max("h")).first()[0]
    if cut is None:
        return Tagger(p)
    out = pa.schema([("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for _, raw in pieces(batches):
            found = [piece for text in raw for piece in excerpts(text.decode(), p)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], out[0].type), pa.array([[list(s) for s in spans] for _, spans in found], out[1].type)], schema=out)

    drawn = known.filter(F.col("h") <= cut).mapInArrow(run, "text string, spans array<array<long>>").limit(2 * p.places * p.sample)
    return fit_excerpts(sorted((r.text, [tuple(s) for s in r.spans]) for r in drawn.toLocalIterator()), p)


def spans_column(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base): base spans and added ones, by kind as listed, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    out = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(item))])

    def run(batches):
        net = shared.value
        for rows, raw in pieces(batches):
            texts = [t.decode() for t in raw]
            spans = []
            for text, tags in zip(texts, net.tag(texts)):
                base = base_spans(text)
                every = [(*s, True) for s in base] + [(*s, False) for s in (net.added(text, tags, base) if tags is not None else [])]
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted(every)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, out[1].type)], schema=out)

    kind = "array<struct<kind:string,start:long,end:long,base:boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {kind}")


def span_digests(docs: DataFrame, p: Pii = Pii()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added per row."""
    rows = spans_column(docs, train(docs, p))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *map(count, KINDS), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )

"""Locating text: dictionary place mentions and the headline/lede decision.

All work is native: one alternation of the dictionary names (longest first)
splits a text into names and the gaps between them, and each mention is judged
by the gap on its left and the words on its right.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import gazetteer_values as G
from tidewatch.functions import vocabulary as V
from tidewatch.functions.staging import gaps_of, marked_split, matches_of, materialize
from tidewatch.functions.text import strip

_ENTRY = "struct<lat:double,lon:double,country:string,scope:string,label:string,rank:int>"


@dataclass(frozen=True)
class Gazetteer:
    """Places to recognise. On equal names a region wins over a city over a country."""

    cities: str = G.CITIES
    regions: str = G.REGIONS
    countries: str = G.COUNTRIES
    exact_case: tuple[str, ...] = G.CASE_SENSITIVE
    entries: dict = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        table: dict[str, dict] = {}
        for scope, block in (("country", self.countries), ("city", self.cities), ("region", self.regions)):
            for line in filter(None, map(str.strip, block.splitlines())):
                name, lat, lon, code, *label = (x.strip() for x in line.split(",", 4))
                table[name] = {
                    "lat": float(lat), "lon": float(lon), "country": code, "scope": scope,
                    "label": label[0] if label else None,
                }
        ordered = sorted(table, key=len, reverse=True)
        entries = {name: {**table[name], "rank": i} for i, name in enumerate(ordered)}
        object.__setattr__(self, "entries", entries)

    def _alternatives(self) -> str:
        """The names, longest first, behind a one-letter test so that most positions try few of them."""
        by_letter: dict[str, list[str]] = {}
        for name in self.entries:
            quoted = re.escape(name).replace(r"\ ", " ")
            exact = f"(?-i:{quoted})" if name in self.exact_case else quoted
            by_letter.setdefault(name[0].lower(), []).append(exact)
        return "|".join(f"(?={letter})(?:{'|'.join(names)})" for letter, names in by_letter.items())

    @property
    def pattern(self) -> str:
        """Any dictionary name standing as a whole word."""
        return rf"(?iU)(?<!\w)(?:{self._alternatives()})(?!\w)"

    @property
    def located_pattern(self) -> str:
        """A name right after a locative phrase: what a text must contain to be located at all."""
        return rf"(?iU)\b(?:{V.LOCATIVES})\s+(?:the\s+)?(?:{self._alternatives()})(?!\w)"

    def lookup(self) -> Column:
        """Lower-cased name to entry, folded to a literal by the optimizer."""
        by_key = {name.lower(): entry for name, entry in self.entries.items()}
        text = json.dumps(by_key, ensure_ascii=False)
        return F.from_json(F.lit(text), f"map<string,{_ENTRY}>")


def _literal(text: str) -> str:
    """A raw SQL string literal (patterns hold no double quotes)."""
    return f'r"{text}"'


def _lengths(array: str) -> str:
    return f"aggregate({array}, 0, (acc, s) -> acc + length(s))"


def mentions(df: DataFrame, text: str, out: str, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Add ``out``: the place mentions of column ``text`` that survive the guards, in text order.

    Each is struct(index, start, end, name, locative, place), offsets in
    characters, end exclusive. ``{out}_gaps`` keeps the text between names.
    """
    gazetteer = gazetteer or Gazetteer()
    n, g, lookup = f"{out}_names", f"{out}_gaps", f"{out}_lookup"
    pieces = f"{out}_pieces"
    split = materialize(df, {pieces: marked_split(F.col(text), gazetteer.pattern)})
    split = materialize(split, {n: matches_of(pieces), g: gaps_of(pieces)}).drop(pieces)
    split = split.withColumn(lookup, gazetteer.lookup())
    start = f"{_lengths(f'slice({g}, 1, i + 1)')} + {_lengths(f'slice({n}, 1, i)')}"
    # Two names and three gaps hold at least the two words the guards look at.
    right = f"concat_ws('', get({g}, i + 1), get({n}, i + 1), get({g}, i + 2), get({n}, i + 2), get({g}, i + 3))"
    kept = f"""
      filter(transform({n}, (name, i) -> named_struct(
          'index', i,
          'start', {start},
          'end', {start} + length(name),
          'name', name,
          'locative', get({g}, i) rlike {_literal(V.LOCATIVE_PATTERN)},
          'place', try_element_at({lookup}, lower(name)),
          'right', {right})),
        m -> substring(m.name, 1, 1) rlike {_literal(r"^\p{Lu}")}
          AND NOT m.right rlike {_literal(V.ADDRESS_PATTERN)}
          AND NOT m.right rlike {_literal(V.NAME_CONTINUES_PATTERN)})"""
    return materialize(split, {out: F.expr(kept)}).drop(n, lookup)


def _picked(df: DataFrame, found: str, distinct_key: str, contradictions: bool) -> DataFrame:
    """Add ``{found}_pick``: the chosen locative mention when all agree on ``distinct_key``.

    The choice is the longest dictionary name, then table order, then position.
    """
    gaps, loci, best, pick = (f"{found}_{part}" for part in ("gaps", "loci", "best", "pick"))
    df = materialize(df, {loci: F.expr(f"filter({found}, m -> m.locative)")})
    ranked = f"array_min(transform({loci}, m -> struct(m.place.rank AS rank, m.index AS index, m AS m))).m"
    df = materialize(df, {best: F.expr(ranked)})
    agreed = f"size(array_distinct(transform({loci}, m -> {distinct_key}))) = 1"
    if contradictions:
        elsewhere = "struct(m.place.lat, m.place.lon, m.place.country)"
        agreed += f"""
          AND NOT exists({found}, m -> m.index > {best}.index
            AND {elsewhere} <> {elsewhere.replace('m.', f'{best}.')}
            AND exists(slice({gaps}, {best}.index + 2, greatest(m.index - {best}.index, 0)),
                       gap -> gap rlike {_literal(V.JOINED_PATTERN)}))"""
    return materialize(df, {pick: F.expr(f"CASE WHEN {agreed} THEN {best} END")}).drop(loci, best)


_COORDINATES = "struct(m.place.lat, m.place.lon, m.place.country)"


def _located(pick: str, source: str) -> str:
    label = f"""CASE WHEN {pick}.place.scope = 'region' THEN concat({pick}.place.label, ' (regional approximation)')
                ELSE concat({pick}.name, ', ', {pick}.place.country, ' (approximate)') END"""
    return f"""
      CASE WHEN {pick} IS NOT NULL THEN named_struct(
        'lat', {pick}.place.lat, 'lon', {pick}.place.lon, 'loc', substring({label}, 1, 80),
        'tier', 'approximate', 'source', '{source}', 'policy', '{V.GEO_POLICY}',
        'scope', {pick}.place.scope, 'evidence', {pick}.name) END"""


def locate(
    df: DataFrame,
    title: str,
    summary: str | None,
    out: str,
    *,
    when: Column | None = None,
    gazetteer: Gazetteer | None = None,
) -> DataFrame:
    """Add ``out``: the one place a headline, or failing that its lede, is about; null means abstain.

    ``when`` limits the work to the rows that need it.
    """
    gazetteer = gazetteer or Gazetteer()
    need = F.lit(True) if when is None else when

    def candidate(text: Column, wanted: Column) -> Column:
        # Without a name after a locative phrase there is no locus, so the full scan is skipped.
        return F.when(wanted & text.rlike(gazetteer.located_pattern), text)

    df = mentions(materialize(df, {"__text": candidate(F.col(title), need)}), "__text", "__h", gazetteer).drop("__text")
    df = _picked(df, "__h", _COORDINATES, contradictions=True)
    found = _located("__h_pick", "title")
    if summary is not None:
        lede = strip(F.coalesce(F.col(summary), F.lit("")))
        wanted = need & F.col("__h_pick").isNull() & (F.length(lede) >= V.LEDE_MIN_CHARS)
        df = mentions(materialize(df, {"__text": candidate(lede, wanted)}), "__text", "__l", gazetteer)
        df = _picked(df, "__l", "m.place.country", contradictions=False)
        found = f"coalesce({found}, {_located('__l_pick', 'summary')})"
    scratch = [f"__{tier}{part}" for tier in "hl" for part in ("", "_gaps", "_pick")]
    return materialize(df, {out: F.expr(found)}).drop("__text", *scratch)

"""Excerpts of hits with the matching words marked.

Spans of a query's terms in a text become a heat map.  The excerpt is a stretch of the
text near the hottest point that begins and ends with a sentence where one fits, else
with whole words and an ellipsis.  This is a walk over one string, so it runs as a
Pandas function, over a page of hits.
"""

from __future__ import annotations

import itertools
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.query import FilterQuery, NOTQuery, PhraseQuery, ProximityQuery, Query, TermQuery
from glyphmill.plans.schema import Schema

ELLIPSIS = "…"
#: A sentence ends with a full stop before white space, or with the text.
_SENTENCE = regex.compile(r"\S.*?(?:\.(?=\s|$)|$)", regex.S)
#: Fixed value: "OK." is a sentence, "2." is none.
LEAST_SENTENCE = 3
#: Tokens whose term vectors leave Python at once.
VECTOR_TOKENS = 1 << 16


@dataclass(frozen=True)
class Span:
    offset: int
    length: int
    weight: float = 0.0

    @property
    def end(self) -> int:
        return self.offset + self.length


def query_spans(query: Query, field: str, tokens: list[tuple[str, int, int]], weigh=None) -> list[Span]:
    """Where a query matches: a span for a term, one from first to last word for a phrase.

    ``weigh`` gives the weight of a term or phrase; its boost unless given.
    """
    if isinstance(query, NOTQuery | FilterQuery):
        return []
    weight = weigh(query) if weigh and isinstance(query, TermQuery | PhraseQuery | ProximityQuery) else query.boost
    if isinstance(query, TermQuery):
        return [Span(a, b - a, weight) for t, a, b in tokens if query.field == field and t == query.term]
    if isinstance(query, PhraseQuery | ProximityQuery):
        if query.field != field or not query.terms:
            return []
        at: dict[str, list[int]] = {}
        for i, (t, _, _) in enumerate(tokens):
            at.setdefault(t, []).append(i)
        reach = query.within if isinstance(query, ProximityQuery) else 1
        out = []
        for p in at.get(query.terms[0], []):
            places = [p]
            for i, t in enumerate(query.terms[1:], 1):
                places.append(next((x for x in at.get(t, []) if 0 <= x - p - i < reach), None))
            if None not in places:
                out.append(Span(tokens[p][1], tokens[max(places)][2] - tokens[p][1], weight))
        return out
    return [s for c in query.children() for s in query_spans(c, field, tokens, weigh)]


class HeatMap:
    """Weights over a text: spans, lifted where they stand close together."""

    def __init__(self, spans: list[Span], window: int):
        self.window = window
        self.spans = self.flatten([*spans, *self.proximity(spans)])

    def lift(self, a: Span, b: Span) -> float:
        """Both weights where the spans touch, less by the square of their distance, none from ``window`` on."""
        apart = max(a.offset, b.offset) - min(a.end, b.end)
        return max(1 - max(apart, 0) / self.window, 0.0) ** 2 * (a.weight + b.weight)

    def proximity(self, spans: list[Span]) -> list[Span]:
        """A span over each pair that lifts each other; each lag of the sorted spans at once."""
        rows = sorted((s.offset, s.end, s.weight) for s in spans)
        start, end, weight = (np.array(c, float) for c in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 3
        out = []
        for lag in range(1, len(rows)):
            nearness = 1 - np.maximum(start[lag:] - end[:-lag], 0) / self.window
            near = np.flatnonzero(nearness > 0)
            if not len(near):
                break
            heat = nearness[near] ** 2 * (weight[near] + weight[near + lag])
            far_end = np.maximum(end[near], end[near + lag])
            out += [Span(int(x), int(y - x), float(w)) for x, y, w in zip(start[near], far_end, heat, strict=True)]
        return out

    @staticmethod
    def flatten(spans: list[Span]) -> list[Span]:
        """Stretches between all boundaries with the sum of the weights over each."""
        edges = sorted({e for s in spans for e in (s.offset, s.end)})
        change = dict.fromkeys(edges, 0.0)
        cover = dict.fromkeys(edges, 0)
        for s in spans:
            change[s.offset] += s.weight
            change[s.end] -= s.weight
            cover[s.offset] += 1
            cover[s.end] -= 1
        out, weight, depth = [], 0.0, 0
        for a, b in zip(edges, edges[1:], strict=False):
            weight += change[a]
            depth += cover[a]
            if depth and weight > 1e-12:
                out.append(Span(a, b - a, weight))
        return out

    def hottest(self) -> int:
        return min(self.spans, key=lambda s: (-s.weight, s.offset)).offset if self.spans else 0

    def warm(self, start: int, length: int) -> bool:
        return any(s.offset < start + length and s.end > start for s in self.spans)


def sentences(text: str, start: int = 0, length: int | None = None) -> list[Span]:
    """Sentences that begin in the stretch from ``start``; the last may reach beyond it."""
    stop = len(text) if length is None else start + length
    found = (Span(m.start(), len(m.group())) for m in _SENTENCE.finditer(text))
    return [s for s in itertools.takewhile(lambda s: s.offset < stop, found) if s.offset >= start and s.length >= LEAST_SENTENCE]


class Highlighter:
    """Makes excerpts of one field; override ``encode`` and ``highlight`` for other markup."""

    def __init__(self, query: Query, schema: Schema, field: str, excerpt_length: int = 200, pre: str = "<strong>", post: str = "</strong>", weigh=None):
        """``weigh`` gives the heat of a term or phrase, as ``Searcher.weigher`` makes it from document frequencies."""
        if not schema.type_of(field).highlightable:
            raise ValueError(f"field {field!r} cannot be highlighted")
        self.query, self.field, self.analyzer = query, field, schema.type_of(field).analyzer
        self.length, self.pre, self.post, self.weigh = excerpt_length, pre, post, weigh
        self.slop = excerpt_length // 3
        self.window = excerpt_length + 2 * self.slop

    def encode(self, text: str) -> str:
        marks = {"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;"}
        return "".join(marks.get(c) or (c if ord(c) < 128 else f"&#{ord(c)};") for c in text)

    def highlight(self, text: str) -> str:
        return f"{self.pre}{text}{self.post}"

    def fragment(self, text: str, heat: HeatMap) -> tuple[int, str]:
        """(start, text) of a window that begins a little before the hottest point.

        Near the end of the text it begins earlier, so that a whole excerpt fits.
        """
        start = max(min(heat.hottest() - self.slop, len(text) - self.length), 0)
        start += len(text[start:]) - len(text[start:].lstrip())
        return start, text[start : start + self.window]

    def raw_excerpt(self, text: str, heat: HeatMap, top: int | None = None, piece: str | None = None, bounds: list[Span] | None = None) -> tuple[int, str]:
        """(offset of the excerpt in the text, excerpt) from the fragment ``piece`` at ``top``.

        An ellipsis counts towards the length, and a leading one towards the offset.
        """
        if top is None or piece is None:
            top, piece = self.fragment(text, heat)
        if bounds is None:
            bounds = sentences(text, 0, top + self.window)
        bottom, least = top + len(piece), min(len(text), self.length * 2 // 3)
        warm_enough = lambda a, b: b - a >= least and heat.warm(a, b - a)
        start = next((s.offset for s in bounds if top <= s.offset and warm_enough(s.offset, min(bottom, s.offset + self.length))), None)
        opens, start = start is not None, top if start is None else start
        # An end of a sentence closes the excerpt; one that ends the text does so at any length.
        last = len(text.rstrip())
        closing = [s.end for s in bounds if start < s.end <= bottom and (warm_enough(start, s.end) or s.end >= last)]
        end = max((e for e in closing if e <= start + self.length), default=None)
        lead = ""
        if not opens and start > 0:
            # Begin with a whole word, a later one where the closing sentence needs the room.
            lead = f"{ELLIPSIS} "
            words = [start + m.start() for m in regex.finditer(r"\S+", text[start:bottom]) if text[start + m.start() - 1].isspace()]
            roomy = [w for w in words if end is not None and 0 < end - w <= self.length - len(lead)]
            if roomy:
                start = roomy[0]
            else:
                start, end = (words[0] if words else start), None
        room = self.length - len(lead)
        if end is not None:
            return start - len(lead), lead + text[start:end]
        if last - start <= room:
            return start - len(lead), lead + text[start:last]
        return start - len(lead), lead + self._whole_words(text, start, room - 1) + ELLIPSIS

    @staticmethod
    def _whole_words(text: str, start: int, room: int) -> str:
        """At most ``room`` characters that end with a word, without the punctuation after it."""
        end = start + room
        out = text[start:end]
        if end < len(text) and not text[end].isspace() and (cut := regex.search(r"\s\S*$", out)):
            out = out[: cut.start()]
        return regex.sub(r"\W+$", "", out)

    def excerpt(self, text: str | None) -> str | None:
        if text is None:
            return None
        if not text:
            return ""
        tokens = self.analyzer.spans([(text, 0, len(text))])
        spans = query_spans(self.query, self.field, tokens, self.weigh)
        heat = HeatMap(spans, max(int(self.length * 2 / 3), 1))
        start, raw = self.raw_excerpt(text, heat)
        return self.highlight_excerpt(raw, [s for s in spans if text[s.offset : s.end] == raw[max(s.offset - start, 0) : max(s.end - start, 0)]], start)

    def highlight_excerpt(self, raw: str, spans: list[Span], start: int = 0) -> str:
        """``raw``, which stands at ``start``, with the stretches that spans cover marked, all of it encoded."""
        runs: list[list[int]] = []
        for s in HeatMap.flatten([Span(s.offset - start, s.length, 1.0) for s in spans]):
            if runs and runs[-1][1] == s.offset:
                runs[-1][1] = s.end
            else:
                runs.append([s.offset, s.end])
        out, at = [], 0
        for a, b in runs:
            if a >= at and b <= len(raw):
                out += [self.encode(raw[at:a]), self.highlight(self.encode(raw[a:b]))]
                at = b
        return "".join([*out, self.encode(raw[at:])])

    def column(self, text: Column | str) -> Column:
        """Excerpts as a column; use it on a page of hits."""
        make = self.excerpt

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(make, na_action="ignore")

        return run(text)


def term_vectors(docs: DataFrame, schema: Schema, field: str, key: str = "doc_id") -> DataFrame:
    """(key, term, positions, starts, ends): where each term of a field stands, in tokens and in characters.

    Texts are analyzed as they are read; join or filter ``docs`` first.  Rows leave Python
    after each ``VECTOR_TOKENS`` tokens, and one text more, however many texts a batch has.
    """
    analyzer = schema.type_of(field).analyzer
    if analyzer is None:
        raise ValueError(f"field {field!r} is not analyzed")
    out = f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, positions array<int>, starts array<int>, ends array<int>"

    def rows(keys: pa.Array, owner: array, terms: list[str], ends: array, places: tuple[array, array, array]) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32())) for c in places]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int32())), pa.array(terms, pa.string()), *lists], names=[key, "term", "positions", "starts", "ends"])

    def run(batches):
        for batch in batches:
            keys, last = batch.column("k"), batch.num_rows - 1
            for row, text in enumerate(batch.column("t")):
                if row == 0 or len(places[0]) >= VECTOR_TOKENS:
                    owner, terms, ends, places = array("i"), [], array("i", [0]), (array("i"), array("i"), array("i"))
                text = text.as_py()
                spans = analyzer.spans([(text, 0, len(text))])
                at: dict[str, list[int]] = {}
                for p, (term, _, _) in enumerate(spans):
                    at.setdefault(term, []).append(p)
                for term, own in at.items():
                    owner.append(row)
                    terms.append(term)
                    places[0].extend(own)
                    places[1].extend(spans[p][1] for p in own)
                    places[2].extend(spans[p][2] for p in own)
                    ends.append(len(places[0]))
                if terms and (row == last or len(places[0]) >= VECTOR_TOKENS):
                    yield rows(keys, owner, terms, ends, places)

    return docs.where(F.col(field).isNotNull()).select(F.col(key).alias("k"), F.col(field).alias("t")).mapInArrow(run, out)

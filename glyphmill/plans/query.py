"""Query objects: plain trees that print, compare and travel as JSON."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass
class Query:
    boost: float = field(default=1.0, kw_only=True)

    def children(self) -> list[Query]:
        return []

    def to_json(self) -> dict:
        def plain(v):
            if isinstance(v, Query):
                return v.to_json()
            return [plain(x) for x in v] if isinstance(v, list | tuple) else v

        return {"type": type(self).__name__} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}


@dataclass
class TermQuery(Query):
    field: str
    term: str

    def __str__(self):
        return f"{self.field}:{self.term}"


@dataclass
class PhraseQuery(Query):
    field: str
    terms: list[str]

    def __str__(self):
        return f'{self.field}:"{" ".join(self.terms)}"'


@dataclass
class ProximityQuery(Query):
    """Terms in order, each less than ``within`` past its place in the phrase."""

    field: str
    terms: list[str]
    within: int

    def __str__(self):
        return f'{self.field}:"{" ".join(self.terms)}"~{self.within}'


@dataclass
class PrefixQuery(Query):
    """Documents with a term that starts so; each scores 1."""

    field: str
    prefix: str

    def __str__(self):
        return f"{self.field}:{self.prefix}*"


@dataclass
class RangeQuery(Query):
    field: str
    lower: object = None
    upper: object = None
    include_lower: bool = True
    include_upper: bool = True
    nulls_match_open_upper: bool = False
    boost: float = field(default=0.0, kw_only=True)

    def __post_init__(self):
        if self.lower is None and self.upper is None:
            raise ValueError("a range needs a bound")

    def __str__(self):
        left, right = "[" if self.include_lower else "{", "]" if self.include_upper else "}"
        return f"{self.field}:{left}{'*' if self.lower is None else self.lower} TO {'*' if self.upper is None else self.upper}{right}"


@dataclass
class MatchAllQuery(Query):
    boost: float = field(default=0.0, kw_only=True)

    def __str__(self):
        return "[MATCHALL]"


@dataclass
class NoMatchQuery(Query):
    #: False where only stop words were asked for: the parser then drops the clause.
    fails_to_match: bool = True
    boost: float = field(default=0.0, kw_only=True)

    def __str__(self):
        return "[NOMATCH]"


@dataclass
class LeafQuery(Query):
    """A word or quoted phrase of a query string, before fields and analysis."""

    field: str | None
    text: str

    def __str__(self):
        return f"{self.field}:{self.text}" if self.field else self.text


@dataclass
class PolyQuery(Query):
    clauses: list[Query] = field(default_factory=list)

    def children(self):
        return self.clauses

    def add_child(self, child: Query) -> None:
        self.clauses.append(child)


@dataclass
class ANDQuery(PolyQuery):
    def __str__(self):
        return f"({' AND '.join(map(str, self.clauses))})" if self.clauses else "()"


@dataclass
class ORQuery(PolyQuery):
    def __str__(self):
        return f"({' OR '.join(map(str, self.clauses))})" if self.clauses else "()"


@dataclass
class NOTQuery(Query):
    negated: Query
    boost: float = field(default=0.0, kw_only=True)

    def children(self):
        return [self.negated]

    def __str__(self):
        return f"-{self.negated}"


@dataclass
class RequiredOptionalQuery(Query):
    required: Query
    optional: Query

    def children(self):
        return [self.required, self.optional]

    def __str__(self):
        return f"(+{self.required} {self.optional})"


@dataclass
class FilterQuery(Query):
    """The documents of another query, without its scores."""

    query: Query
    boost: float = field(default=0.0, kw_only=True)

    def children(self):
        return [self.query]

    def __str__(self):
        return f"Filter({self.query})"


@dataclass
class CustomQuery(Query):
    """A query of one's own: columns over the row of a document, as ``plans.compiler`` describes it.

    ``compiler`` gives ``frequency``, ``positions``, ``norm``, ``idf`` and ``query_norm``.
    """

    def needs(self, out) -> bool:
        """Enter terms, prefixes and columns into ``out``; whether documents can match without the terms."""
        return True

    def match(self, compiler):
        raise NotImplementedError

    def score(self, compiler, boost: float):
        from pyspark.sql import functions as F

        return F.lit(0.0)

    def sum_of_squares(self, compiler, boost: float) -> float:
        return 1.0


def register_query(kind: type[Query]) -> type[Query]:
    """Let ``from_json`` read queries of a class; usable as a decorator."""
    _TYPES[kind.__name__] = kind
    return kind


_TYPES = {c.__name__: c for c in (TermQuery, PhraseQuery, ProximityQuery, PrefixQuery, RangeQuery, MatchAllQuery, NoMatchQuery, LeafQuery, ANDQuery, ORQuery, NOTQuery, RequiredOptionalQuery, FilterQuery)}


def from_json(data: dict) -> Query:
    def back(v):
        if isinstance(v, dict):
            return from_json(v)
        return [back(x) for x in v] if isinstance(v, list) else v

    return _TYPES[data["type"]](**{k: back(v) for k, v in data.items() if k != "type"})

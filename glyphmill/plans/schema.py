"""Field types and the append-only schema of an index."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.analysis import Analyzer, analyzer_from_json
from glyphmill.functions.similarity import SIMILARITIES, Similarity

#: Spark type of each kind of field.
KINDS = {"text": "string", "string": "string", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "blob": "binary"}

#: Functions of a value whose results are compared in its place.
COMPARISONS: dict[str, Callable[[Column], Column]] = {"natural": lambda value: value}


def register_comparison(name: str, key: Callable[[Column], Column]) -> None:
    """Let fields be sorted, and ranges be cut, by ``key`` of their values; readers need it too."""
    COMPARISONS[name] = key


@dataclass
class FieldType:
    kind: str
    analyzer: Analyzer | None = None
    boost: float = 1.0
    indexed: bool = True
    stored: bool = True
    sortable: bool = False
    highlightable: bool = False
    similarity: str = "default"
    #: What a posting counts for: "score" by frequency and length, "match" by its weight
    #: alone, "rich" by the mean of the boosts that the analyzer gives to its positions.
    posting: str = "score"
    #: What values are compared by: a name in ``COMPARISONS``.
    comparison: str = "natural"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.kind == "text" and self.analyzer is None:
            raise ValueError("a full-text field needs an analyzer")
        if self.kind == "blob" and (self.sortable or self.indexed):
            raise ValueError("a blob can neither be sorted nor indexed")
        if self.posting not in ("score", "match", "rich"):
            raise ValueError(f"unknown posting {self.posting!r}")
        if self.highlightable and self.kind != "text":
            raise ValueError("only full-text fields can be highlighted")

        if self.similarity not in SIMILARITIES:
            raise ValueError(f"unknown similarity {self.similarity!r}; register_similarity makes it known")
        if self.comparison not in COMPARISONS:
            raise ValueError(f"unknown comparison {self.comparison!r}; register_comparison makes it known")

    def sim(self) -> Similarity:
        return SIMILARITIES[self.similarity]()

    def terms(self, value: Column) -> Column:
        """The terms of a field's value: tokens of a text, else the value itself."""
        return self.analyzer.terms(value) if self.kind == "text" else F.array(value.cast("string"))

    def sort_key(self, value: Column) -> Column:
        """What values are compared by, in sorting and in ranges."""
        return COMPARISONS[self.comparison](value)

    def to_json(self) -> dict:
        data = {k: v for k, v in self.__dict__.items() if k != "analyzer"}
        return data | ({"analyzer": self.analyzer.to_json()} if self.analyzer else {})

    @classmethod
    def from_json(cls, data: dict) -> FieldType:
        analyzer = data.get("analyzer")
        return cls(**{k: v for k, v in data.items() if k != "analyzer"}, analyzer=analyzer_from_json(analyzer) if analyzer else None)


def full_text(analyzer: Analyzer, **options) -> FieldType:
    return FieldType("text", analyzer, **options)


def string(**options) -> FieldType:
    return FieldType("string", **options)


def numeric(kind: str, **options) -> FieldType:
    if kind not in ("int32", "int64", "float32", "float64"):
        raise ValueError(f"{kind!r} is not numeric")
    # The double type alone is sortable unless told otherwise.
    return FieldType(kind, **({"sortable": kind == "float64"} | options))


def blob(**options) -> FieldType:
    return FieldType("blob", **({"indexed": False} | options))


@dataclass
class Schema:
    fields: dict[str, FieldType] = field(default_factory=dict)

    def spec_field(self, name: str, kind: FieldType) -> Schema:
        """Add a field; naming one again with another type is an error."""
        known = self.fields.get(name)
        if known is not None and known.to_json() != kind.to_json():
            raise ValueError(f"field {name!r} is there with another type")
        self.fields[name] = kind
        return self

    def type_of(self, name: str) -> FieldType:
        if name not in self.fields:
            raise ValueError(f"unknown field {name!r}")
        return self.fields[name]

    def searchable(self) -> list[str]:
        return sorted(n for n, t in self.fields.items() if t.indexed and t.kind in ("text", "string"))

    def merged(self, other: Schema) -> Schema:
        out = Schema(dict(self.fields))
        for name, kind in other.fields.items():
            out.spec_field(name, kind)
        return out

    def dumps(self) -> str:
        return json.dumps({n: t.to_json() for n, t in self.fields.items()}, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Schema:
        return cls({n: FieldType.from_json(d) for n, d in json.loads(text).items()})

    def __eq__(self, other) -> bool:
        return isinstance(other, Schema) and self.dumps() == other.dumps()

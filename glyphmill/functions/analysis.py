"""Text analysis: the same analyzer as a column of tokens, and as a list for query texts.

A token column is ``array<struct<text, start, end>>``; its place in the array, after
stop words are gone, is the token's position.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import STEMMERS, stem_column, stem_word
from .stopwords import stop_list

#: Fixed value: the default token pattern.
DEFAULT_PATTERN = "\\w+(?:['\u2019]\\w+)*"


class Analyzer:
    """``terms`` turns a string column into an array of terms; ``split`` does so for one text."""

    def terms(self, text: Column) -> Column:
        return self.apply(F.array(text))

    def apply(self, terms: Column) -> Column:
        raise NotImplementedError

    def boosts(self, text: Column) -> Column:
        """A boost for each of ``terms``, in order; override it for rich postings."""
        return F.transform(self.terms(text), lambda t: F.lit(1.0))

    def split(self, text: str) -> list[str]:
        return [t for t, _, _ in self.spans([(text, 0, len(text))])]

    def spans(self, tokens: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Tokens with their offsets in characters of the original."""
        raise NotImplementedError

    def to_json(self) -> dict:
        """The registered name of exactly this class, and what ``from_json`` needs."""
        name = next((n for n, kind in ANALYZERS.items() if kind is type(self)), None)
        if name is None:
            raise ValueError(f"{type(self).__name__} is not registered: a stored index could not be read with it")
        return {"kind": name} | self.options()

    def options(self) -> dict:
        return {}

    @classmethod
    def from_json(cls, options: dict) -> Analyzer:
        return cls(**options)

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.to_json() == other.to_json()

    __hash__ = None


class CaseFolder(Analyzer):
    def terms(self, text: Column) -> Column:
        return F.array(F.lower(text))

    def apply(self, terms: Column) -> Column:
        return F.transform(terms, F.lower)

    def spans(self, tokens):
        return [(t.lower(), a, b) for t, a, b in tokens]


class Tokenizer(Analyzer):
    """Tokens are the matches of a pattern; classes such as ``\\w`` are Unicode classes."""

    def __init__(self, pattern: str = DEFAULT_PATTERN):
        if regex.search(r"(?<!\\)(?:\\\\)*\\[pP]", pattern):
            raise ValueError("\\p and \\P are not allowed in a token pattern")
        self.pattern = pattern
        self._compiled = regex.compile(pattern)

    def terms(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?U){self.pattern}"), F.lit(0))

    def apply(self, terms: Column) -> Column:
        return F.flatten(F.transform(terms, self.terms))

    def spans(self, tokens):
        return [(m.group(), a + m.start(), a + m.end()) for t, a, _ in tokens for m in self._compiled.finditer(t)]

    def options(self):
        return {"pattern": self.pattern}


class Stopalizer(Analyzer):
    """Drops stop words: those of a language, or a list."""

    def __init__(self, language: str | None = None, stoplist=None):
        if (language is None) == (stoplist is None):
            raise ValueError("give either a language or a list")
        self.language = language
        self.words = sorted(set(stoplist if stoplist is not None else stop_list(language)))
        self._set = frozenset(self.words)

    def apply(self, terms: Column) -> Column:
        return F.filter(terms, lambda t: ~t.isin(self.words)) if self.words else terms

    def spans(self, tokens):
        return [t for t in tokens if t[0] not in self._set]

    def options(self):
        return {"language": self.language} if self.language else {"stoplist": self.words}


class Stemmer(Analyzer):
    def __init__(self, language: str):
        if language not in STEMMERS:
            raise ValueError(f"no stemmer for {language!r}; there are {sorted(STEMMERS)}")
        self.language = language

    def apply(self, terms: Column) -> Column:
        return stem_column(terms, self.language)

    def spans(self, tokens):
        return [(stem_word(t, self.language), a, b) for t, a, b in tokens]

    def options(self):
        return {"language": self.language}


class PolyAnalyzer(Analyzer):
    """Analyzers in a row; a language stands for case folding, tokens and stemming."""

    def __init__(self, language: str | None = None, analyzers: list[Analyzer] | None = None):
        if (language is None) == (analyzers is None):
            raise ValueError("give either a language or analyzers")
        self.analyzers = list(analyzers) if analyzers is not None else [CaseFolder(), Tokenizer(), Stemmer(language)]

    def terms(self, text: Column) -> Column:
        # A folded text stays one string until it is cut, which keeps the plan flat.
        rest = list(self.analyzers)
        while rest and isinstance(rest[0], CaseFolder):
            text = F.lower(text)
            rest.pop(0)
        out = rest.pop(0).terms(text) if rest and isinstance(rest[0], Tokenizer) else F.array(text)
        for a in rest:
            out = a.apply(out)
        return out

    def apply(self, terms: Column) -> Column:
        for a in self.analyzers:
            terms = a.apply(terms)
        return terms

    def spans(self, tokens):
        for a in self.analyzers:
            tokens = a.spans(tokens)
        return tokens

    def options(self):
        return {"analyzers": [a.to_json() for a in self.analyzers]}

    @classmethod
    def from_json(cls, options):
        return cls(analyzers=[analyzer_from_json(a) for a in options["analyzers"]])


ANALYZERS: dict[str, type[Analyzer]] = {"case_folder": CaseFolder, "tokenizer": Tokenizer, "stopalizer": Stopalizer, "stemmer": Stemmer, "poly": PolyAnalyzer}


def register_analyzer(name: str, kind: type[Analyzer]) -> None:
    """Let stored indexes name an analyzer class; whoever opens them registers it as well.

    A class with other parameters than its base overrides ``options``.
    """
    ANALYZERS[name] = kind


def analyzer_from_json(data: dict) -> Analyzer:
    if data["kind"] not in ANALYZERS:
        raise ValueError(f"unknown analyzer {data['kind']!r}; register_analyzer makes it known")
    return ANALYZERS[data["kind"]].from_json({k: v for k, v in data.items() if k != "kind"})

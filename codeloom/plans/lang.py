"""The query language: terms key:value, at most one of them a relation."""

from __future__ import annotations

from dataclasses import dataclass

FILTERS = ("name", "kind")
SYMBOL_RELATIONS = ("callers", "callees", "extends", "subclasses")
FILE_RELATIONS = ("requires", "dependents")
RELATIONS = (*SYMBOL_RELATIONS, *FILE_RELATIONS, "methods")


class QueryError(ValueError):
    """An expression, depth or limit that isn't valid."""


@dataclass(frozen=True)
class Expression:
    source: str
    terms: tuple[tuple[str, str], ...]

    @property
    def relation(self) -> tuple[str, str] | None:
        return next((t for t in self.terms if t[0] in RELATIONS), None)

    def filter(self, key: str) -> str | None:
        """The value of the first term of a key."""
        return next((v for k, v in self.terms if k == key), None)


def parse(text: str) -> Expression:
    source = text.strip()
    terms = []
    for token in source.split():
        key, colon, value = token.partition(":")
        if not key or not colon or not value:
            raise QueryError(f"not a term: {token}")
        if key not in FILTERS and key not in RELATIONS:
            raise QueryError(f"unknown key: {key}")
        terms.append((key, value))
    if not terms:
        raise QueryError("the expression is empty")
    if sum(k in RELATIONS for k, _ in terms) > 1:
        raise QueryError(f"only one of {', '.join(RELATIONS)} may be given")
    return Expression(source, tuple(terms))


def positive(value: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise QueryError(f"{name} must be a positive integer")
    return value

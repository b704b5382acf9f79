"""Questions in words: a translator (any callable) proposes a query, one repair is allowed.

No language model is called from here; ``translate`` is given one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..operators.tables import result_difference
from .grammar import Query, parse_query

#: (question, schema text, error of the last try or None) -> query as dict or JSON, or None if it cannot be answered.
Translator = Callable[[str, str, str | None], dict | str | None]


class CannotAnswer(ValueError):
    """The translator says that the data cannot answer the question."""


def coerced(raw: dict | str) -> dict:
    """Objects that arrive as JSON text, at the top or one level down."""
    data = json.loads(raw) if isinstance(raw, str) else raw
    return {k: json.loads(v) if isinstance(v, str) and v[:1] in "{[" else v for k, v in data.items()}


def translate(question: str, schema: str, translator: Translator, check: Callable[[Query], object] | None = None) -> Query:
    """A query that parses (and passes ``check``, usually the compiler). A second error is raised."""
    error: str | None = None
    for attempt in range(2):
        raw = translator(question, schema, error)
        if raw is None:
            raise CannotAnswer(question)
        try:
            query = parse_query(coerced(raw))
            if check is not None:
                check(query)
            return query
        except (QueryError, ValueError, TypeError) as problem:
            if attempt:
                raise QueryError(str(problem)) from problem
            error = str(problem)
    raise AssertionError


def ask(corpus, question: str, translator: Translator, summarise: Callable[[str, list[dict]], str] | None = None, shown: int = 5):
    """(query, Arrow result, summary of at most ``shown`` rows)."""
    query = translate(question, corpus.describe(), translator, corpus.compile)
    result = corpus.search(query)
    return query, result, summarise(question, result.slice(0, shown).to_pylist()) if summarise else None


@dataclass(frozen=True)
class Score:
    missing: int
    extra: int

    @property
    def exact(self) -> bool:
        return not self.missing and not self.extra


def score(expected: DataFrame, got: DataFrame, key: str) -> Score:
    """How two answers differ as sets of ids."""
    sides = {r["side"]: r["count"] for r in result_difference(expected, got, key).groupBy("side").count().collect()}
    return Score(sides.get("missing", 0), sides.get("extra", 0))

"""What callers may plug in where a model is needed, with offline defaults elsewhere in the package."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


class Completer(Protocol):
    def __call__(self, prompt: str) -> str: ...


class SpecParser(Protocol):
    def __call__(self, question: str) -> dict[str, Any]: ...


class Reviewer(Protocol):
    def __call__(self, dictionary: Any) -> Any: ...

"""Ports to what this library doesn't do itself: reading of scanned pages, language models, rates, structure of tables.

A provider is a factory under a kind and a name. The ones that come with the library are stubs that fail loudly, so that nothing is read or told by
accident where no provider is set up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

OCR, LLM, FX, TABLES = "ocr", "llm", "fx", "table_structure"


class Unavailable(RuntimeError):
    """No provider that works is set up."""


class Ocr(Protocol):
    def words(self, image: bytes) -> list[dict]:
        """text, x0, y0, x1, y1 (shares of the page), confidence."""


class StructuredLlm(Protocol):
    def answer(self, instructions: str, payload: str) -> dict: ...


class Rates(Protocol):
    def rate(self, base: str, quote: str, as_of: str) -> float: ...


class TableStructure(Protocol):
    def cells(self, image: bytes) -> list[dict]: ...


class Registry:
    def __init__(self):
        self._made: dict[tuple[str, str], Callable[..., Any]] = {}

    def register(self, kind: str, name: str, factory: Callable[..., Any]) -> None:
        if (kind, name) in self._made:
            raise ValueError(f"{kind} {name} is registered already")
        self._made[kind, name] = factory

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._made if k == kind)

    def make(self, kind: str, name: str, **options) -> Any:
        if (kind, name) not in self._made:
            raise KeyError(f"no {kind} provider {name}; there are {', '.join(self.names(kind)) or 'none'}")
        return self._made[kind, name](**options)


class Stub:
    """Any port: every call says that there is no provider."""

    def __init__(self, kind: str):
        self.kind = kind

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)

        def call(*_, **__):
            raise Unavailable(f"no {self.kind} provider is set up; {name}() was asked of the stub")

        return call


def builtin() -> Registry:
    registry = Registry()
    for kind in (OCR, LLM, FX, TABLES):
        registry.register(kind, "stub", lambda kind=kind: Stub(kind))
    return registry


WORDS = "doc_id long, page_index int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def ocr_words(pages: DataFrame, provider: Callable[[], Ocr]) -> DataFrame:
    """Words of scanned pages (doc_id, page_index, image) by a provider, which is made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = provider()
        for batch in batches:
            rows = [(d, p, w["text"], w["x0"], w["y0"], w["x1"], w["y1"], w.get("confidence")) for d, p, image in batch[["doc_id", "page_index", "image"]].itertuples(index=False, name=None) for w in port.words(bytes(image))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "text", "x0", "y0", "x1", "y1", "confidence"])

    return pages.select("doc_id", "page_index", "image").mapInPandas(run, WORDS)


def payload(**parts) -> str:
    """What a model is asked, written alike for like contents: keys sorted, no blanks, figures as text."""
    return json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def answers(groups: DataFrame, provider: Callable[[], StructuredLlm], instructions: str) -> DataFrame:
    """group, item, key of a model's answers to groups (group, payload, items, keys); items and keys that weren't offered are dropped, and so are answers that fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = provider()
        for batch in batches:
            out = []
            for group, text, items, keys in batch[["group", "payload", "items", "keys"]].itertuples(index=False, name=None):
                try:
                    told = port.answer(instructions, text)
                except Unavailable:
                    raise
                except Exception:  # noqa: BLE001 - a failed answer leaves its rows unanswered
                    continue
                out += [(group, i, k) for i, k in told.items() if i in set(items) and k in set(keys)]
            yield pd.DataFrame(out, columns=["group", "item", "key"])

    return groups.select("group", "payload", "items", "keys").mapInPandas(run, "group string, item string, key string")

"""What users plug in: extractors and pipeline stages over pages, and handlers by content type.

An extractor is a function of (html, url) or of an Arrow-friendly column; what it raises becomes the row's error and leaves the other
rows and extractors alone. A pipeline stage is a function from DataFrame to DataFrame: a stage that filters drops rows for all later ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import ship


@dataclass
class Extractor:
    """name: the field of the result. run: (html, url) -> anything that JSON can hold; None stores nothing."""

    name: str
    run: Callable


_EXTRACTED = "struct<extracted map<string,string>, errors array<struct<code string, source string, message string>>>"


def extracted(html: Column, url: Column, extractors: list[Extractor]) -> Column:
    """struct of extracted (name -> JSON) and errors, one for each extractor that raised. Names must differ."""
    names = [e.name for e in extractors]
    if len(set(names)) < len(names) or not all(callable(e.run) for e in extractors):
        raise TypeError("extractors need names of their own and something to call")

    def run(h, u):
        out, errors = {}, []
        for e in extractors:
            try:
                v = e.run(h, u)
                if v is not None:
                    out[e.name] = json.dumps(v, ensure_ascii=False, sort_keys=True)
            except Exception as x:  # an extractor's own faults are part of the result
                errors.append({"code": "EXTRACTOR_ERROR", "source": e.name, "message": f"{type(x).__name__}: {x}"})
        return {"extracted": out, "errors": errors}

    return F.udf(run, _EXTRACTED, useArrow=True)(html, url)


def piped(artifacts: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The artifacts after all stages in turn."""
    ship(artifacts.sparkSession)
    for s in stages:
        artifacts = s(artifacts)
        if not isinstance(artifacts, DataFrame):
            raise TypeError("a stage must return a DataFrame")
    return artifacts


def essence(content_type: Column) -> Column:
    """A content type without parameters, in lower case; '' for none."""
    return F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))


@dataclass
class Router:
    """Content types to functions of DataFrames. Registering a type again replaces its handler."""

    handlers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    default: Callable[[DataFrame], DataFrame] | None = None

    @staticmethod
    def key(content_type: str) -> str:
        return content_type.split(";")[0].strip().lower()

    def register(self, content_type: str, handler: Callable) -> "Router":
        self.handlers[self.key(content_type)] = handler
        return self

    def unregister(self, content_type: str) -> bool:
        return self.handlers.pop(self.key(content_type), None) is not None

    def handler(self, content_type: str) -> Callable | None:
        return self.handlers.get(self.key(content_type), self.default)

    def types(self) -> list[str]:
        return list(self.handlers)

    def route(self, pages: DataFrame, content_type: str = "content_type") -> DataFrame | None:
        """The union of what each handler makes of the pages of its type, and the default of the rest; None without handlers. Handlers must return like columns."""
        kind, parts = essence(F.col(content_type)), []
        for k, h in self.handlers.items():
            parts.append(h(pages.filter(kind == k)))
        if self.default is not None:
            parts.append(self.default(pages.filter(~kind.isin(*self.handlers)) if self.handlers else pages))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out


def fresh_pages(pages: DataFrame, text: str, order: str, name: str) -> DataFrame:
    """Pages whose content no earlier page has: what duplicates would cost, their extraction and links, isn't spent. `text` should be a column of normalised text."""
    from weftline.operators.ordered import first_seen

    return first_seen(pages, F.when(F.length(text) > 0, F.sha2(text, 256)), order, name).filter("not duplicate").drop("hash", "duplicate", "duplicate_of")

"""Pages that a caller's own code supplies, as a Spark data source for batches and streams."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)


class PageProvider(Protocol):
    """What ``provider`` names: a class, importable where tasks run, that is made anew in each of them, of the source's options."""

    def __init__(self, options: dict[str, str]): ...

    def latest(self) -> int:
        """How many pages there are by now; never less than before."""

    def pages(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        """Id and text of the pages at the places from ``start`` to before ``end``: the same each time."""


@dataclass
class Places(InputPartition):
    """The pages of one task: from one place to before another."""

    start: int
    end: int


def _provider(options) -> PageProvider:
    module, _, name = options["provider"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def _cut(start: int, end: int, options) -> list[Places]:
    """Places in runs of ``partitionPages`` (10,000 by default)."""
    step = int(options.get("partitionPages", 10_000))
    if step <= 0:
        raise ValueError("partitionPages must be positive")
    return [Places(at, min(at + step, end)) for at in range(start, end, step)]


#: How a page's id is held against a filter's value.
_TESTS = {
    EqualTo: lambda page, value: page == value, In: lambda page, value: page in value, GreaterThan: lambda page, value: page > value,
    GreaterThanOrEqual: lambda page, value: page >= value, LessThan: lambda page, value: page < value, LessThanOrEqual: lambda page, value: page <= value,
}


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters that compare ``page_id`` with values; Spark applies the others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("page_id",):
                self.tests.append((type(f), frozenset(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Places]:
        return _cut(0, _provider(self.options).latest(), self.options) or [Places(0, 0)]

    def read(self, places: Places) -> Iterator[tuple]:
        for page, text in _provider(self.options).pages(places.start, places.end):
            if all(_TESTS[kind](page, value) for kind, value in self.tests):
                yield page, text


class PageStreamReader(DataSourceStreamReader):
    """Offsets are places, so a query that is started again goes on behind the last place that it has committed."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"place": int(self.options.get("startingPlace", 0))}

    def latestOffset(self) -> dict:
        return {"place": _provider(self.options).latest()}

    def partitions(self, start: dict, end: dict) -> list[Places]:
        return _cut(start["place"], end["place"], self.options)

    def read(self, places: Places) -> Iterator[tuple]:
        yield from _provider(self.options).pages(places.start, places.end)

    def commit(self, end: dict) -> None:
        """Providers keep what they have."""


class PageSource(DataSource):
    """``spark.read.format("corpuspack_pages").option("provider", "package.module:Class")``, or ``readStream``; see :class:`PageProvider`."""

    @classmethod
    def name(cls) -> str:
        return "corpuspack_pages"

    def schema(self) -> str:
        return "page_id bigint, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def register_pages(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets filters on ``page_id`` reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)

"""The version-control log as a data source: ``spark.read.format("vcs_log")`` after ``register(spark)``.

Options: root (a working copy), path (within it, default all), program (the client), first and last
(revisions; by default 1 and the newest), step (revisions a task asks for). A row for each changed path of
each revision, or one with a null path. Filters on revision and date narrow the ranges that are asked for, one on
author goes to the client's search, one on path (equal, or a prefix) to its target; Spark applies all of
them again, so a client that does less gives the same rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import date, datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from lodestone.operators.vcs import Client

STEP = 1000


class Revisions(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PlainReader(DataSourceReader):
    """Asks for all revisions of the options."""

    def __init__(self, options: dict):
        self.root, self.program, self.step = options["root"], options.get("program", "svn"), int(options.get("step", STEP))
        self.path, self.first, self.last = options.get("path", "."), int(options.get("first", 1)), int(options["last"]) if "last" in options else None
        self.author, self.since, self.until = None, None, None

    def _asked(self, *args: str) -> ET.Element:
        return ET.fromstring(Client(self.root, self.program).run("log", "--xml", *args))

    def _at(self, when: date | datetime, newest_first: bool) -> int | None:
        """The first revision from a time on, or the last up to it."""
        if isinstance(when, datetime):
            when = when.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        span = f"{{{when}}}:1" if newest_first else f"{{{when}}}:HEAD"
        found = self._asked("--quiet", "-r", span, "--limit", "1").find("logentry")
        return None if found is None else int(found.get("revision"))

    def partitions(self) -> list[InputPartition]:
        newest = self._asked("--quiet", "-r", "HEAD:1", "--limit", "1").find("logentry")
        newest = int(newest.get("revision")) if newest is not None else 0
        self.last = newest if self.last is None else min(self.last, newest)  # a client fails on later ones
        if self.since is not None:
            # The client takes the revision that was current at a time, so one before it may be named: a revision too many, never one too few.
            at = self._at(self.since, False)
            self.first = max(self.first, at) if at is not None else self.last + 1
        if self.until is not None:
            at = self._at(self.until, True)
            self.last = min(self.last, at + 1) if at is not None else 0
        return [Revisions(lo, min(lo + self.step - 1, self.last)) for lo in range(self.first, self.last + 1, self.step)] or [Revisions(1, 0)]

    def read(self, part: Revisions) -> Iterator[tuple]:
        if part.last < part.first:
            return
        options = ["--verbose", "-r", f"{part.first}:{part.last}", *(["--search", self.author] if self.author else [])]
        target = [str(Client(self.root, self.program).resolved(self.path))] if self.path != "." else []
        for e in self._asked(*options, *target).iter("logentry"):
            when = e.findtext("date")
            head = (int(e.get("revision")), e.findtext("author"), datetime.fromisoformat(when.replace("Z", "+00:00")) if when else None, e.findtext("msg") or "")
            paths = e.findall("paths/path")
            for p in paths:
                yield (*head, p.get("action"), p.text)
            if not paths:
                yield (*head, None, None)


class LogReader(PlainReader):
    """Asks only for what the query's filters leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what narrows the question; every filter goes back to Spark as well."""
        for f in filters:
            if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)):
                yield f
                continue
            name, up, down = f.attribute[0], isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)), isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
            if name == "revision":
                value = int(f.value)
                if up:
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if down:
                    value -= isinstance(f, LessThan)
                    self.last = value if self.last is None else min(self.last, value)
            elif name == "date":
                if up:
                    self.since = max(self.since or f.value, f.value)
                if down:
                    self.until = min(self.until or f.value, f.value)
            elif name == "author" and isinstance(f, EqualTo):
                self.author = f.value
            elif name == "path" and isinstance(f, (EqualTo, StringStartsWith)) and self.path == ".":
                held = f.value if isinstance(f, EqualTo) else f.value.rpartition("/")[0]
                self.path = held.strip("/") or "."
            yield f


class LogSource(DataSource):
    kind = LogReader

    @classmethod
    def name(cls) -> str:
        return "vcs_log"

    def schema(self) -> str:
        return "revision long, author string, date timestamp, message string, action string, path string"

    def reader(self, schema) -> DataSourceReader:
        return self.kind(dict(self.options))


class PlainLogSource(LogSource):
    kind = PlainReader


def register(spark: SparkSession) -> None:
    """Makes the format known. Filters are pushed if the session allows it now (spark.sql.python.filterPushdown.enabled); Spark refuses sources that take them where it doesn't."""
    spark.dataSource.register(LogSource if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else PlainLogSource)

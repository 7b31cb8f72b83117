"""A Python data source for JSON feeds, over HTTP or from files; addressable by day, in a batch or as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: the session's setting that lets filters reach a Python data source
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class JsonFeed(DataSource):
    """spark.read.format("json_feed").option("urls", "a,b").option("list", "hits").load(): url, seq, item (JSON text), error, day.

    A feed that can't be read is a row with its error; other feeds are not held up.  A URL with {day}, {start} and {end} (the UTC day
    and its bounds in seconds) is asked once for each day of the options `first` to `last`; bounds on the column `day` are pushed
    into the source, so that other days aren't asked for.

    As a stream it has the days from `first` that are over; `until` stands for today.  Its offset is the next day, so that a query that is
    started again goes on there.
    """

    @classmethod
    def name(cls) -> str:
        return "json_feed"

    def schema(self) -> str:
        return "url string, seq int, item string, error string, day string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _StreamReader(self.options)


def _days(first: str, last: str) -> list[str]:
    a, n = date.fromisoformat(first), (date.fromisoformat(last) - date.fromisoformat(first)).days
    return [(a + timedelta(i)).isoformat() for i in range(n + 1)]


def _address(template: str, day: str) -> str:
    start = int(datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC).timestamp())
    return template.replace("{day}", day).replace("{start}", str(start)).replace("{end}", str(start + 86400))


class _Feeds:
    """What the batch and the stream reader share."""

    def __init__(self, options):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split(",") if u]
        self.field, self.timeout = options.get("list", ""), float(options.get("timeout", "10"))
        self.first, self.last, self.until = options.get("first"), options.get("last"), options.get("until")

    def addresses(self, days: list[str]) -> list[InputPartition]:
        dated = [u for u in self.urls if _address(u, "2000-01-01") != u]
        return [InputPartition((_address(u, day), day)) for day in days for u in dated]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.request

        url, day = partition.value
        try:
            if "://" in url and not url.startswith("file:"):
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    data = json.load(r)
            else:
                from pyarrow.fs import FileSystem

                fs, path = FileSystem.from_uri("file://" + url.removeprefix("file:").removeprefix("//"))
                with fs.open_input_stream(path) as f:
                    data = json.load(f)
            for key in self.field.split(".") if self.field else []:
                data = data[key]
            for i, item in enumerate(data if isinstance(data, list) else [data]):
                yield url, i, json.dumps(item, ensure_ascii=False), None, day
        except (OSError, ValueError, KeyError, TypeError) as e:
            yield url, None, None, f"{type(e).__name__}: {e}", day


class _Reader(_Feeds, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.days = _days(self.first, self.last or self.first) if self.first else []
        self.undated = True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kept = {EqualTo: lambda d, v: d == v, In: lambda d, v: d in v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v}
        for f in filters:
            if type(f) in kept and f.attribute == ("day",):
                self.days = [d for d in self.days if kept[type(f)](d, f.value)]
                self.undated = False  # their day is null
            else:
                yield f

    def partitions(self):
        whole = [InputPartition((u, None)) for u in self.urls if self.undated and _address(u, "2000-01-01") == u]
        return whole + self.addresses(self.days) or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:  # no day is left: nothing to ask for
            yield from super().read(partition)


class _StreamReader(_Feeds, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        today = self.until or datetime.now(UTC).date().isoformat()
        return {"day": max(self.first, today)}

    def partitions(self, start: dict, end: dict):
        last = (date.fromisoformat(end["day"]) - timedelta(1)).isoformat()
        return self.addresses(_days(start["day"], last))


def register(spark) -> None:
    """Makes the source known to the session, and lets filters reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(JsonFeed)

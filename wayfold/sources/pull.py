"""Activities of an outside service as a Spark data source: a partition a day, read by tasks.

source(client) makes the data source of a client, a function of a day that yields (name,
content) of that day's activities; client and contents live in tasks, the driver knows days
only. Options: since and until (days; until is left out), for streams also lookback, the days
before the last offset that are asked again, as services add to days that are past, and
cutoff, a day before which nothing is asked. A stream's offset is the first day that hasn't
been asked, kept in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, content binary, day date"
NAME = "wayfold_pull"


class Day(InputPartition):
    def __init__(self, day: date):
        self.day = day


def days(since: date, until: date) -> list[Day]:
    return [Day(since + timedelta(days=k)) for k in range((until - since).days)]


def _day(options: dict, name: str, default: date | None = None) -> date:
    value = options.get(name)
    if value is None and default is None:
        raise ValueError(f"option {name} is missing")
    return date.fromisoformat(value) if value is not None else default


def source(client: Callable[[date], Iterable[tuple[str, bytes]]]) -> type[DataSource]:
    """A data source to register with spark.dataSource.register()."""

    def read(partition: Day) -> Iterator[tuple]:
        seen = set()
        for name, content in client(partition.day):
            if name not in seen:
                seen.add(name)
                yield name, bytes(content), partition.day

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.since, self.until = _day(options, "since"), _day(options, "until")

        def partitions(self) -> list[Day]:
            return days(self.since, self.until) or [Day(None)]

        def read(self, partition: Day) -> Iterator[tuple]:
            return read(partition) if partition.day else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.since, self.until = _day(options, "since"), options.get("until")
            self.lookback, self.cutoff = int(options.get("lookback", 0)), _day(options, "cutoff", date.min)

        def initialOffset(self) -> dict:  # noqa: N802
            return {"day": max(self.since, self.cutoff).isoformat()}

        def latestOffset(self) -> dict:  # noqa: N802
            return {"day": self.until or (date.today() + timedelta(days=1)).isoformat()}

        def partitions(self, start: dict, end: dict) -> list[Day]:
            first = max(date.fromisoformat(start["day"]) - timedelta(days=self.lookback), self.cutoff, self.since)
            return days(first, date.fromisoformat(end["day"]))

        def read(self, partition: Day) -> Iterator[tuple]:
            return read(partition)

    class Pull(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return Stream(self.options)

    return Pull

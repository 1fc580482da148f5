"""Sources with offsets of their own, as Python data sources that streams read from.

``numbered`` is for events with ascending numbers: an offset is a number, a range of numbers is cut into parts that tasks
read, and the same range gives the same events when it is read again after a failure. ``paged`` is for feeds that go on from
an opaque token: an offset is a token, pages are drained in order (each names the next), by the driver, as the protocol has
it; what is read are references to changes, not contents.

    spark.dataSource.register(numbered("issues", "event long, value string", newest, between))
    spark.readStream.format("issues").load()
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

PER_READ = 100  # events that one call to a source asks for


@dataclass
class Range(InputPartition):
    """Numbers above ``low``, up to ``high``."""

    low: int
    high: int


def numbered(name: str, schema: str, newest: Callable[[dict], int], between: Callable[[dict, int, int], Iterable[tuple]], per_read: int = PER_READ) -> type[DataSource]:
    """A source of events (number first) that ``between(options, low, high)`` gives for numbers above low up to high, all of
    them whenever it is asked; ``newest(options)`` is the last number there is. Option ``after`` is where streams begin. Options
    come by their names in lower case."""

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = {k.lower(): v for k, v in options.items()}

        def initialOffset(self) -> dict:  # noqa: N802
            return {"number": int(self.options.get("after", 0))}

        def latestOffset(self) -> dict:  # noqa: N802
            return {"number": max(newest(self.options), int(self.options.get("after", 0)))}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            cuts = list(range(start["number"], end["number"], int(self.options.get("perread", per_read)))) + [end["number"]]
            return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

        def read(self, partition: Range) -> Iterator[tuple]:
            seen = partition.low
            for row in sorted(between(self.options, partition.low, partition.high), key=lambda r: r[0]):
                if seen < row[0] <= partition.high:  # each number once, whatever else the source sends
                    seen = row[0]
                    yield tuple(row)

        def commit(self, end: dict) -> None:
            pass  # the checkpoint holds the offset; the source keeps its events

    return _source(name, schema, lambda options: Reader(options))


def paged(name: str, schema: str, first: Callable[[dict], str], page: Callable[[dict, str], tuple[Iterable[tuple], str | None, str | None]]) -> type[DataSource]:
    """A source of pages: ``page(options, token)`` gives (rows, token of the next page, token to go on from later); the last
    page has no next one. ``first(options)`` is where a stream begins unless option ``token`` says it."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = {k.lower(): v for k, v in options.items()}

        def initialOffset(self) -> dict:  # noqa: N802
            return {"token": self.options.get("token") or first(self.options)}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, token = [], start["token"]
            while True:
                some, following, later = page(self.options, token)
                rows += some
                if following is None:
                    return iter(rows), {"token": later or token}
                token = following

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
            token = start["token"]
            while token != end["token"]:
                some, following, later = page(self.options, token)
                yield from some
                token = following or later or end["token"]

        def commit(self, end: dict) -> None:
            pass

    return _source(name, schema, None, lambda options: Reader(options))


def _source(name_: str, schema_: str, reader: Callable | None, simple: Callable | None = None) -> type[DataSource]:
    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

    if reader:
        Feed.streamReader = lambda self, schema: reader(self.options)
    else:
        Feed.simpleStreamReader = lambda self, schema: simple(self.options)
    return Feed

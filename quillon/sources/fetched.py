"""Pages fetched by the executors through a Python data source. The client is injected, so nothing here knows a network.

A ``Fetch`` takes a request and a cursor (None for the first page) and gives the page's content and the next cursor, None
after the last page. It travels to the executors, so it must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.storage import written

Fetch = Callable[[str, str | None], tuple[str, str | None]]
PAGE = "request string, page int, content string, error string"


class Slots(NamedTuple):
    """Requests that come into being with time: how many there are by now, and the name of each."""

    known: Callable[[], int]
    name: Callable[[int], str]


def page_source(name: str, fetch: Fetch, requests: Sequence[str] = (), slots: Slots | None = None, tries: int = 3, wait: float = 1.0, partitions: int = 200) -> type[DataSource]:
    """A data source of pages (request, page, content, error): all of ``requests`` as a batch, ``slots`` as a stream.

    Requests are spread over so many partitions at most; pages of one follow each other. A page that fails is tried
    again, with waits that double; one that fails each time is a row with the error and without content, and ends its
    request only. A cursor that does not move on counts as such a failure. The stream's offset is the number of slots
    read, so that a restart goes on behind the last batch.
    """

    def pages(request: str) -> Iterator[tuple]:
        import time

        cursor, page = None, 0
        while True:
            error = None
            for attempt in range(tries):
                try:
                    content, following = fetch(request, cursor)
                    error = None
                    break
                except Exception as e:  # noqa: BLE001  whatever a client raises
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < tries:
                        time.sleep(wait * 2**attempt)
            if error is not None:
                yield request, page, None, error
                return
            yield request, page, content, None
            if following is None:
                return
            page += 1
            if following == cursor:
                yield request, page, None, f"cursor stays at {cursor}"
                return
            cursor = following

    def spread(own: Sequence[str]) -> list[InputPartition]:
        n = min(len(own), partitions)
        return [InputPartition(list(own[k::n])) for k in range(n)]

    def read(partition: InputPartition) -> Iterator[tuple]:
        for request in partition.value:
            yield from pages(request)

    class Batch(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return spread(requests) or [InputPartition([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return read(partition)

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802  names of the interface
            return {"slots": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            return {"slots": slots.known()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return spread([slots.name(k) for k in range(start["slots"], end["slots"])])

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return read(partition)

        def commit(self, end: dict) -> None:
            pass

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE

        def reader(self, schema: object) -> DataSourceReader:
            return Batch()

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
            return Stream()

    return Pages


def fetched(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """All pages of a source, fetched once: they are written to the shared folder, which later steps read."""
    spark.dataSource.register(source)
    return written(spark.read.format(source.name()).load(), "pages")


def page_stream(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).load()


def failures(pages: DataFrame) -> DataFrame:
    """What could not be fetched: request, page, error."""
    return pages.where("error is not null").select("request", "page", "error")

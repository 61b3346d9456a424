"""A paged HTTP row service as a Spark data source, in batch and as a resumable stream.

``spark.read.format("pathloom_rows").options(url=..., config=..., split=..., limit=...)``: every page is an input
partition, so pages are fetched by executors and a lost executor costs its pages only. HTTP 429 waits and asks again;
any other failure halves the page until single rows are left, and then fails the task. As a stream, the offset is the
number of rows done and each micro-batch takes ``checkpointRows`` rows, so a restart resumes from the last checkpoint.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE, EVERY, DEADLINE, WAIT = 100, 1000, 8, 15
SCHEMA = "row_idx long, messages string, metadata string, imageCount int"


@dataclass
class Page(InputPartition):
    offset: int
    length: int


def pages(offset: int, limit: int, size: int = PAGE) -> list[Page]:
    return [Page(at, min(size, offset + limit - at)) for at in range(offset, offset + limit, size)]


def fetch_once(options: dict, offset: int, length: int) -> list[tuple]:
    """One request; anything but status 200 with exactly ``length`` rows is an error."""
    query = {k: options[k] for k in ("dataset", "config", "split") if options.get(k)} | {"offset": offset, "length": length}
    with urllib.request.urlopen(f"{options['url']}?{urllib.parse.urlencode(query)}", timeout=DEADLINE) as got:
        rows = json.load(got)["rows"]
    if len(rows) != length:
        raise ValueError(f"{length} rows wanted at {offset}, {len(rows)} came")
    return [(r["row_idx"], r["row"].get("messages"), r["row"].get("metadata"), len(r["row"]["images"]) if isinstance(r["row"].get("images"), list) else 0) for r in rows]


def fetch(options: dict, offset: int, length: int, once: Callable = fetch_once, sleep: Callable = time.sleep) -> list[tuple]:
    """The rows of a page in order, however the service has to be asked for them."""
    while True:
        try:
            return once(options, offset, length)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                sleep(float(options.get("wait") or WAIT))
                continue
            if length == 1:
                raise
        except Exception:
            if length == 1:
                raise
        half = length // 2
        return fetch(options, offset, half, once, sleep) + fetch(options, offset + half, length - half, once, sleep)


def _bounds(options: dict) -> tuple[int, int]:
    offset, limit = int(options.get("offset", 0)), int(options.get("limit", 500))
    if offset < 0 or not 1 <= limit <= 100_000:
        raise ValueError("offset must not be negative, limit must be 1 to 100000")
    return offset, limit


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        return pages(*_bounds(self.options))

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from fetch(self.options, partition.offset, partition.length)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.start, limit = _bounds(options)
        self.end = self.start + limit

    def initialOffset(self) -> dict:
        return {"row": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["row"] > self.end:
            raise ValueError("the checkpoint holds more rows than the limit")
        end = {"row": min(self.end, start["row"] + int(self.options.get("checkpointRows") or self.options.get("checkpointrows") or EVERY))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for p in pages(start["row"], end["row"] - start["row"]) for r in fetch(self.options, p.offset, p.length)])


class RowService(DataSource):
    """Options: url, dataset, config, split, offset (0), limit (500), wait (seconds after a 429), checkpointRows (1000)."""

    @classmethod
    def name(cls) -> str:
        return "pathloom_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(RowService)

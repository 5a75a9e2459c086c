"""Paged services as a Spark data source (S1-S5, S16, S17): a partition for each query, or for each query and page.

``spark.read.format("paged")`` (after `register`) asks a service page by page, by cursor or by number, and gives a row for
each item, as JSON text; what fails gives a row with the error instead, so one bad query loses nothing else. Answers are
kept in a folder that all executors share: each is written under a name of its own and renamed, and an answer that is there
isn't asked for again, so a lost task goes on where it was. The transport is a function by name, ``module:function``, from
(url, headers, seconds) to a `Reply`: `http_get`, or one that reads files.

Options: ``url`` with {query}, {page}, {cursor} and {size}; ``queries`` (JSON list); ``paging`` (cursor or page); ``items``
and ``next`` (dotted paths in an answer); ``per_query`` (items at most), ``page_size``, ``pages`` (page numbers asked for in
parallel; without it pages follow each other until one is empty), ``cache``, ``transport``, ``agent``, ``timeout``,
``pause`` (seconds between calls), ``wait`` (the longest wait for a new quota).
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, page int, item string, error string"
AGENT = "tessera/1 (batch analytics)"


@dataclass(frozen=True)
class Reply:
    """What a service answers; header names in lower case."""

    status: int
    body: bytes
    headers: dict[str, str] = field(default_factory=dict)


class FetchError(OSError):
    """A page that can't be had."""


def http_get(url: str, headers: dict[str, str], seconds: float) -> Reply:
    """A GET request."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as answer:  # noqa: S310
            return Reply(answer.status, answer.read(), {k.lower(): v for k, v in answer.headers.items()})
    except urllib.error.HTTPError as bad:
        return Reply(bad.code, bad.read(), {k.lower(): v for k, v in bad.headers.items()})
    except OSError as bad:
        raise FetchError(str(bad)) from bad


def file_get(url: str, headers: dict[str, str], seconds: float) -> Reply:
    """An answer from a file; one that isn't there is an empty page."""
    store, path = _store(url)
    if store.get_file_info(path).type != fs.FileType.File:
        return Reply(200, b"{}")
    with store.open_input_stream(path) as f:
        return Reply(200, f.read())


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_atomically(path: str, body: bytes) -> None:
    """Under another name first, so that nobody reads half a file."""
    store, name = _store(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(body)
    store.move(part, name)


@dataclass
class Client:
    """Answers from the cache, else from the transport, with pauses and one more try when a quota is used up."""

    transport: str = "tessera.sources.paged:http_get"
    cache: str = ""
    agent: str = AGENT
    timeout: float = 60
    pause: float = 0
    wait: float = 120

    def get(self, url: str) -> bytes:
        where = f"{self.cache}/{hashlib.sha256(url.encode()).hexdigest()}" if self.cache else ""
        if where:
            store, path = _store(where)
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_stream(path) as f:
                    return f.read()
        reply = self._call(url)
        if reply.status in (403, 429) and reply.headers.get("x-ratelimit-remaining") == "0":
            until = float(reply.headers.get("x-ratelimit-reset") or 0) - time.time()
            time.sleep(min(max(until, 0) + 0.1, self.wait))
            reply = self._call(url)
        if reply.status != 200:
            raise FetchError(f"status {reply.status}: {url}")
        if where:
            write_atomically(where, reply.body)
        return reply.body

    def _call(self, url: str) -> Reply:
        module, _, name = self.transport.partition(":")
        reply = getattr(importlib.import_module(module), name)(url, {"User-Agent": self.agent}, self.timeout)
        time.sleep(self.pause)
        return reply


def dig(doc: object, path: str) -> object:
    """The value at a dotted path, or None."""
    for part in filter(None, path.split(".")):
        doc = doc.get(part) if isinstance(doc, dict) else None
    return doc


@dataclass
class Asked(InputPartition):
    """A query, from a page on, for so many pages (None: to the end)."""

    query: str
    page: int
    pages: int | None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Asked]:
        queries, pages = json.loads(self.options["queries"]), int(self.options.get("pages", 0))
        if pages and self.options.get("paging", "cursor") == "page":
            return [Asked(q, p, 1) for q in queries for p in range(1, pages + 1)]
        return [Asked(q, 1, None) for q in queries]

    def read(self, asked: Asked) -> Iterator[tuple]:
        of, quote = self.options.get, urllib.parse.quote
        client = Client(of("transport", Client.transport), of("cache", ""), of("agent", AGENT), float(of("timeout", 60)), float(of("pause", 0)), float(of("wait", 120)))
        most, size, by_cursor = int(of("per_query", 2**31 - 1)), int(of("page_size", 100)), of("paging", "cursor") == "cursor"
        got, page, cursor, last = 0, asked.page, of("first", "*"), asked.page + asked.pages - 1 if asked.pages else None
        while got < most and (last is None or page <= last):
            url = self.options["url"].format(query=quote(asked.query, safe=""), page=page, cursor=quote(str(cursor), safe=""), size=size)
            try:
                answer = json.loads(client.get(url))
            except (OSError, ValueError) as bad:
                yield asked.query, page, None, str(bad)
                return
            items = dig(answer, of("items", "items")) or []
            for item in items[: most - got]:
                yield asked.query, page, json.dumps(item, ensure_ascii=False), None
            got += len(items)
            cursor = dig(answer, of("next", "next"))
            if not items or by_cursor and not cursor:
                return
            page += 1


class PagedSource(DataSource):
    """The data source ``paged``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(dict(self.options))


def read_paged(spark: SparkSession, queries: list[str], **options: object) -> DataFrame:
    """query, page, item (JSON), error; options as above."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(queries=json.dumps(queries), **{k: str(v) for k, v in options.items()}).load()

"""Paged outside systems (APIs, databases) as a stream of records with offsets.

A Pages object knows its shards and, for each, how to step from one position to the next and how to read
what lies between two. The offset of the stream has for each shard the bounds of the pages of the last batch, so a
batch that is run again reads the same pages, a restart goes on where the last planned batch ended, and
each page is a partition of its own. Only positions come to the driver; records are read in the tasks.

Positions are JSON values. A database's is the pair of cursor and key, so rows with equal cursors on both sides of a
page's edge are each read once, and numbers compare as numbers. An API's is the pair of its own cursor and the number
of records read of that page, so an open last page that grows is taken up in its middle.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from waymark.sources.ingest import cursor_order, page_of, raw_records

ATTEMPTS = 3


def retried(do: Callable, *args, attempts: int = ATTEMPTS, wait: float = 2.0):
    """do(*args), again after a pause if it fails; the last failure is raised."""
    for k in range(attempts):
        try:
            return do(*args)
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(min(wait * (k + 1), 5.0))


class Pages:
    """Records of an outside system, shard by shard, in the order of a position. Instances travel to the tasks."""

    def shards(self) -> list[str]:
        return [""]

    def start(self, shard: str) -> Any:
        """The position before the first record."""
        return None

    def step(self, shard: str, after: Any) -> Any:
        """The position at the end of the page after this one; None if nothing is there yet."""
        raise NotImplementedError

    def parts(self, shard: str, after: Any, upto: Any) -> list:
        """What tasks read between two positions, one part each."""
        return [(shard, after, upto)]

    def records(self, part: Any) -> list[dict]:
        raise NotImplementedError


class KeysetPages(Pages):
    """A table of a database (DB-API), page by page in the order of (cursor, key).

    connect: opens a connection, in the driver and in tasks. where: the predicate of each shard by its name.
    mark: the placeholder of the database's library. Rows with a null cursor or key have no place in the order and aren't read.
    """

    def __init__(self, connect: Callable, table: str, cursor: str, key: str, size: int = 1000, where: dict[str, str] | None = None, mark: str = "?"):
        self.connect, self.table, self.cursor, self.key, self.size, self.where, self.mark = connect, table, cursor, key, size, where or {"": "1 = 1"}, mark

    def shards(self) -> list[str]:
        return list(self.where)

    def _query(self, columns: str, shard: str, after: list | None, upto: list | None, tail: str = "") -> list[dict]:
        c, k, m = self.cursor, self.key, self.mark
        sql, values = f"SELECT {columns} FROM {self.table} WHERE ({self.where[shard]}) AND {c} IS NOT NULL AND {k} IS NOT NULL", []
        for bound, sign in ((after, ">"), (upto, "<")):
            if bound is not None:
                sql += f" AND ({c} {sign} {m} OR ({c} = {m} AND {k} {sign}{'=' if sign == '<' else ''} {m}))"
                values += [bound[0], bound[0], bound[1]]
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(f"{sql} ORDER BY {c}, {k} {tail}", values)
            names = [d[0] for d in cursor.description]
            return [dict(zip(names, row)) for row in cursor.fetchall()]
        finally:
            connection.close()

    def step(self, shard: str, after: list | None) -> list | None:
        page = self._query(f"{self.cursor} AS c, {self.key} AS k", shard, after, None, f"LIMIT {int(self.size)}")
        return [page[-1]["c"], page[-1]["k"]] if page else None

    def records(self, part) -> list[dict]:
        shard, after, upto = part
        return self._query("*", shard, after, upto)


class ApiPages(Pages):
    """An API that hands out pages by a cursor of its own: fetch(cursor) returns a decoded body (see ingest.page_of)."""

    def __init__(self, fetch: Callable[[str | None], Any], first: str | None = None, **paths):
        self.fetch, self.first, self.paths = fetch, first, paths

    def start(self, shard: str) -> list:
        return [self.first, 0]

    def step(self, shard: str, after: list) -> list | None:
        cursor, seen = after
        rows, following, _ = page_of(self.fetch(cursor), **self.paths)
        if following is not None and following != cursor:
            return [following, 0] if rows else None
        return [cursor, len(rows)] if len(rows) > seen else None

    def records(self, part) -> list[dict]:
        _, (cursor, seen), (last, upto) = part
        out = []
        while True:
            rows, following, _ = page_of(self.fetch(cursor), **self.paths)
            if cursor == last:
                return out + rows[seen:upto]
            out += rows[seen:]
            if following in (None, cursor):
                return out
            cursor, seen = following, 0


class OrderPages(Pages):
    """Orders of a delivery API by three nested requests: batches since a time, a batch's drivers, a driver's orders.

    Each request is a function that returns decoded records. The position is the largest add_time seen and the batches of the
    page; each batch is a partition. Batches of the last second come again, and their orders are upserted by their id.
    """

    def __init__(self, batches: Callable[[int], list], drivers: Callable[[str], list], orders: Callable[[str, str], list], since: int):
        self.batches, self.drivers, self.orders, self.since = batches, drivers, orders, since

    def start(self, shard: str) -> list:
        return [self.since, []]

    def _wanted(self, since: int) -> list[str]:
        return [str(b["referer"]) for b in self.batches(since) if str(b.get("referer") or "").startswith("HA") and int(b.get("refer_count") or 0) > 0]

    def step(self, shard: str, after: list) -> list | None:
        wanted = self._wanted(after[0])
        times = [t for b in wanted for r in self.records((shard, b)) if (t := _whole(r.get("add_time"))) is not None]
        last = max(times, default=after[0])
        return [last, wanted] if last > after[0] else None

    def parts(self, shard: str, after: list, upto: list) -> list:
        return [(shard, b) for b in upto[1]]

    def records(self, part) -> list[dict]:
        _, batch = part
        out = []
        for driver in self.drivers(batch):
            if driver.get("driver_id") is None or int(driver.get("order_count") or 0) <= 0:
                continue
            for order in self.orders(batch, str(driver["driver_id"])):
                if order.get("shipping_status") in (0, "0", None):
                    out.append({**order, "batch_id": batch, "driver_id": str(driver["driver_id"])})
        return out


def _whole(value) -> int | None:
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return None


#: Kinds of pages by the names a configuration may give.
KINDS: dict[str, type[Pages]] = {"generic": ApiPages, "default": ApiPages, "legacy_batch_orders": OrderPages, "legacy": OrderPages, "batch_orders": OrderPages, "api": ApiPages, "pull": ApiPages, "remote": ApiPages, "db": KeysetPages, "database": KeysetPages, "direct": KeysetPages}


def pages(kind: str | None = None, **options) -> Pages:
    """Pages of a kind (generic if none is given), in any case and with blanks around."""
    name = (kind or "generic").strip().lower()
    if name not in KINDS:
        raise ValueError(f"unknown kind of source: {kind}")
    return KINDS[name](**options)


class _Part(InputPartition):
    def __init__(self, shard: str, part: Any):
        self.shard, self.part = shard, part


class _Stream(DataSourceStreamReader):
    """Offsets: for each shard the positions at the edges of the pages of the last batch that had any."""

    def __init__(self, source: Pages, pages_a_batch: int, wait: float):
        self.source, self.pages_a_batch, self.wait, self.at = source, pages_a_batch, wait, None

    def initialOffset(self) -> dict:
        return {s: [self.source.start(s)] for s in self.source.shards()}

    def latestOffset(self) -> dict:
        at = self.at if self.at is not None else self.initialOffset()
        end = dict(at)
        for s in self.source.shards():
            edges = [at[s][-1] if s in at else self.source.start(s)]
            while len(edges) <= self.pages_a_batch:
                step = retried(self.source.step, s, edges[-1], wait=self.wait)
                if step is None:
                    break
                edges.append(step)
            if len(edges) > 1 or s not in end:
                end[s] = edges
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> list:
        if self.at is None:  # after a restart the engine plans the last batch first
            self.at = end
        out = []
        for s, edges in end.items():
            before = start[s][-1] if s in start else self.source.start(s)
            if edges[-1] == before:
                continue
            steps = edges if edges[0] == before else [before, edges[-1]]
            out += [_Part(s, p) for a, b in zip(steps, steps[1:]) for p in self.source.parts(s, a, b)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        for r in retried(self.source.records, partition.part, wait=self.wait):
            yield partition.shard, json.dumps(r, ensure_ascii=False, default=str)

    def commit(self, end: dict) -> None:
        if self.at is None:
            self.at = end


class _Batch(DataSourceReader):
    """All pages there are now, one partition a page."""

    def __init__(self, source: Pages, wait: float):
        self.source, self.wait = source, wait

    def partitions(self) -> list:
        out = []
        for s in self.source.shards():
            at = self.source.start(s)
            while (step := retried(self.source.step, s, at, wait=self.wait)) is not None:
                out += [_Part(s, p) for p in self.source.parts(s, at, step)]
                at = step
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition is not None:
            for r in retried(self.source.records, partition.part, wait=self.wait):
                yield partition.shard, json.dumps(r, ensure_ascii=False, default=str)


def paged_source(name: str, source: Pages, pages_a_batch: int = 16, wait: float = 2.0) -> type[DataSource]:
    """A data source with columns shard and record (JSON text), for read and readStream; register it with spark.dataSource.register."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "shard string, record string"

        def reader(self, schema):
            return _Batch(source, wait)

        def streamReader(self, schema):
            return _Stream(source, pages_a_batch, wait)

    return Source


def pages_stream(spark: SparkSession, name: str, source: Pages, **options) -> DataFrame:
    """The stream of a Pages' records: shard, record."""
    spark.dataSource.register(paged_source(name, source, **options))
    return spark.readStream.format(name).load()


def ingest_stream(stream: DataFrame, table, source_name: str, checkpoint: str, workspace: str = "default", mapping: dict[str, str] | None = None, interval: str | None = None) -> StreamingQuery:
    """Upserts a stream of records (JSON text in column record) into a keyed table by workspace, source and external id.

    Of rows with one key the one with the largest cursor wins. A batch that is run again changes nothing: the table
    knows its number. interval None takes what is there now and ends.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        records = raw_records(batch.select("record"), source_name, workspace, mapping, nested="record")
        records = records.withColumn("__order", cursor_order(F.col("source_cursor")))
        table.upsert(records, order="__order", batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

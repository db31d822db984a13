"""A paged remote feed as a Spark data source.

A feed answers (month, start, page size) with an Atom page: the month's total and some entries. Every month is a partition, so
months are fetched by as many tasks as there are cores, and a lost executor costs the repetition of its month. Filters on
``published`` reach the reader and cut the list of months; months named in ``done`` are left out, which resumes a run.

``spark.read.format("paged_feed")`` takes the options

- ``root``: where the pages are. Offline this is a folder of files ``YYYY-MM/START.xml`` (any store that Arrow reads), as
  ``write_pages`` makes it; ``transport`` names another class ("module:Class") with a method
  ``fetch(month, start, size) -> bytes``, such as one that asks a server;
- ``first``, ``last``: months (``YYYY-MM``); ``done``: months to leave out, comma-joined; ``page``: entries a page;
- ``attempts``, ``wait``: tries per page, and seconds that the wait grows by with each; ``empty``: tries of an empty page before the
  month fails as incomplete (``incomplete`` = "keep" ends it with what came instead); ``pause``: least seconds between two requests;
- ``lanes``: how many tasks share the pause. Months are dealt to as many partitions, and each asks only in its own time slots
  (``Slots``), so that no two requests of the job are closer than the pause. Clocks of the executors must agree to within the slots'
  margin, and speculative copies of a task would share its slots: leave speculation off.

``spark.readStream.format("paged_feed")`` takes the same options. The offset is the last month that has been read; a run takes the months
from there up to ``last``, and the checkpoint lets the next one, with a later ``last``, go on.
"""

from __future__ import annotations

import importlib
import math
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id string, published string, primary_category string, categories array<string>, title string, abstract string, month string"
ATOM = "{http://www.w3.org/2005/Atom}"
TOTAL = "{http://a9.com/-/spec/opensearch/1.1/}totalResults"
PRIMARY = "{http://arxiv.org/schemas/atom}primary_category"


class Months(InputPartition):
    """A month (None: there is none to read) or, where tasks share a pause, a lane's months and its number."""

    def __init__(self, months: str | list[str] | None, lane: int = 0):
        super().__init__(months)
        self.lane = lane


class Incomplete(Exception):
    """A month ended before its total."""


def months(first: str, last: str) -> list[str]:
    y, m = map(int, first.split("-"))
    out = []
    while f"{y}-{m:02d}" <= last:
        out.append(f"{y}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def parse_page(xml: bytes) -> tuple[int, list[tuple]]:
    """The month's total and the page's records (without the month)."""
    root = ET.fromstring(xml)
    total = root.findtext(TOTAL)
    rows = []
    for entry in root.iter(f"{ATOM}entry"):
        text = lambda name, entry=entry: (entry.findtext(ATOM + name) or "").strip()
        terms = [c.get("term") for c in entry.findall(f"{ATOM}category")]
        primary = entry.find(PRIMARY)
        rows.append((text("id").rsplit("/", 1)[-1], text("published"), primary.get("term") if primary is not None else "", terms, text("title"), text("summary")))
    return int(total or 0), rows


class FilePages:
    """Pages in a folder; a page that is not there is empty."""

    def __init__(self, root: str):
        self.store, self.root = fs.FileSystem.from_uri(root)

    def fetch(self, month: str, start: int, size: int) -> bytes:
        try:
            with self.store.open_input_stream(f"{self.root}/{month}/{start}.xml") as f:
                return f.read()
        except FileNotFoundError:
            return b"<feed/>"


def page_xml(total: int, records: list[dict]) -> bytes:
    """An Atom page of records as in ``SCHEMA``."""
    head = f'<feed xmlns="{ATOM[1:-1]}" xmlns:os="{TOTAL[1:].partition("}")[0]}" xmlns:ax="{PRIMARY[1:].partition("}")[0]}"><os:totalResults>{total}</os:totalResults>'
    entries = [
        f"<entry><id>http://feed/abs/{escape(r['id'])}</id><published>{escape(r['published'])}</published><title>{escape(r['title'])}</title><summary>{escape(r['abstract'])}</summary>"
        + f"<ax:primary_category term={quoteattr(r['primary_category'])}/>" + "".join(f"<category term={quoteattr(c)}/>" for c in r["categories"]) + "</entry>"
        for r in records
    ]
    return (head + "".join(entries) + "</feed>").encode()


def write_pages(records: DataFrame, root: str, size: int) -> int:
    """Records (as in ``SCHEMA``) as pages of ``size`` entries under ``root``, by month and published; the number of pages."""
    from wordtide.operators.corpus import ranked

    rows = ranked(records, ["month"], ["published", "id"]).withColumn("start", F.col("rn") - F.col("rn") % size)
    pages = rows.groupBy("month", "start").agg(F.first("cnt").alias("total"), F.array_sort(F.collect_list(F.struct("rn", *records.columns))).alias("records"))  # size rows a group

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for page in batch.to_pylist():
                store.create_dir(f"{folder}/{page['month']}")
                with store.open_output_stream(f"{folder}/{page['month']}/{page['start']}.xml") as f:
                    f.write(page_xml(page["total"], page["records"]))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return pages.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Paced:
    """Calls that keep a least distance in time."""

    def __init__(self, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep = pause, clock, sleep
        self.free = float("-inf")

    def wait(self) -> None:
        now = self.clock()
        if now < self.free:
            self.sleep(self.free - now)
        self.free = max(now, self.free) + self.pause


class Slots:
    """Calls of one of several lanes, in time slots that the lanes take in turn, counted from a common start. A slot is the pause and a margin
    wide; a call that comes up later than the margin within its slot waits for the lane's next one, so calls of any two lanes keep the pause."""

    def __init__(self, pause: float, lane: int, lanes: int, begin: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.lane, self.lanes, self.begin, self.clock, self.sleep = lane, lanes, begin, clock, sleep
        self.margin = 0.05 * pause + 0.01
        self.width, self.used = pause + self.margin, -1

    def wait(self) -> None:
        while True:
            now = self.clock() - self.begin
            first = max(self.used + 1, math.floor(now / self.width))
            slot = first + (self.lane - first) % self.lanes
            at = slot * self.width
            if now < at:
                self.sleep(at - now)
                now = self.clock() - self.begin
            if at <= now <= at + self.margin:
                self.used = slot
                return
            self.used = max(self.used, slot if now > at else self.used)


def fetched(fetch: Callable[[], bytes], attempts: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The page; after a failure the next try waits longer by ``wait``, and the last failure is raised."""
    for k in range(attempts):
        try:
            return fetch()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait * (k + 2))
    raise ValueError("attempts must be positive")


def read_month(fetch: Callable[[int], bytes], page: int, attempts: int, wait: float, empty: int, sleep: Callable[[float], None] = time.sleep, keep: bool = False) -> Iterator[tuple]:
    """All records of a month. An empty page before the total is tried again ``empty`` times, as feeds now and then send one; a short page is
    followed by what comes after it. A month that ends before its total raises ``Incomplete``, or ends with what came (``keep``)."""
    start, whole, tries = 0, None, 0
    while True:
        total, rows = parse_page(fetched(lambda: fetch(start), attempts, wait, sleep))
        whole = total if whole is None else max(whole, total)
        if not rows:
            if start < whole and tries < empty:
                tries += 1
                sleep(2 * wait)
                continue
            if start < whole and not keep:
                raise Incomplete(f"{start} of {whole} records came")
            return
        tries = 0
        yield from rows
        start += len(rows)
        if start >= whole:
            return


def read_lane(options: dict[str, str], partition: Months, begin: float) -> Iterator[tuple]:
    """The records of a partition's months."""
    of = options
    module, _, name = of.get("transport", f"{__name__}:FilePages").partition(":")
    feed = getattr(importlib.import_module(module), name)(of["root"])
    pause, lanes = float(of.get("pause", 0)), int(of.get("lanes", 0))
    pace = Slots(pause, partition.lane, lanes, begin) if lanes else Paced(pause)
    for month in [partition.value] if isinstance(partition.value, str) else partition.value or []:

        def fetch(start: int, month: str = month) -> bytes:
            pace.wait()
            return feed.fetch(month, start, int(of.get("page", 1000)))

        for row in read_month(fetch, int(of.get("page", 1000)), int(of.get("attempts", 5)), float(of.get("wait", 3.2)), int(of.get("empty", 4)), keep=of.get("incomplete") == "keep"):
            yield (*row, month)


def dealt(chosen: list[str], lanes: int) -> list[Months]:
    """A partition for each month, or for each lane its share of the months."""
    if not lanes:
        return [Months(m) for m in chosen]
    return [Months(chosen[k::lanes], k) for k in range(lanes) if chosen[k::lanes]]


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first, self.last, self.begin = options["first"], options["last"], time.time()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ``published`` cut the months; Spark applies all filters again, as months are coarser."""
        for f in filters:
            if getattr(f, "attribute", None) == ("published",) and isinstance(value := getattr(f, "value", None), str) and len(value) >= 7:
                month = value[:7]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, month)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last = min(self.last, month)
            yield f

    def partitions(self) -> list[Months]:
        done = set(filter(None, self.options.get("done", "").split(",")))
        return dealt([m for m in months(self.first, self.last) if m not in done], int(self.options.get("lanes", 0))) or [Months(None)]

    def read(self, partition: Months) -> Iterator[tuple]:
        return read_lane(self.options, partition, self.begin)


class FeedStreamReader(DataSourceStreamReader):
    """Months after the last one read. What Spark has committed to its checkpoint is never asked for again."""

    def __init__(self, options: dict[str, str]):
        self.options, self.begin = options, time.time()

    def initialOffset(self) -> dict[str, str]:
        return {"through": ""}

    def latestOffset(self) -> dict[str, str]:
        return {"through": self.options["last"]}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Months]:
        chosen = [m for m in months(self.options["first"], end["through"]) if m > start["through"]]
        return dealt(chosen, int(self.options.get("lanes", 0)))

    def read(self, partition: Months) -> Iterator[tuple]:
        return read_lane(self.options, partition, self.begin)


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeed)

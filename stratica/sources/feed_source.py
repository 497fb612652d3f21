"""A paged change feed as a Spark source: batch and streamed, resumable within a walk, restarted once when its cursor has expired.

A feed is a folder with one folder for each walk, ``w000001`` and so on, of pages ``000001.json`` with ``entries`` (a list).  A
service that lets a cursor expire begins a new walk, in which everything is listed anew.  The offset is (walk, page).  A stream that
stopped in the middle of a walk goes on behind the page that it had read last; one whose walk is no longer the last reads
the new walk from its first page, and says so in every row (``restart``), so that what the new walk does not list is known to be gone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "walk long, page long, place long, restart boolean, entry string"


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def last_page(folder: str) -> tuple[int, int]:
    """The last walk of a feed and its last page; (0, 0) for a feed without pages."""
    from pyarrow import fs

    system, base = _system(folder)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    pages = [(int(m[1]), int(m[2])) for f in found if (m := re.search(r"/w(\d+)/(\d+)\.json$", f.path))]
    return max(pages, default=(0, 0))


class Page(InputPartition):
    def __init__(self, walk: int, page: int, restart: bool):
        super().__init__((walk, page))
        self.walk, self.page, self.restart = walk, page, restart


def read_page(folder: str, part: Page | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # a feed without new pages
        return
    system, base = _system(folder)
    with system.open_input_stream(f"{base}/w{part.walk:06d}/{part.page:06d}.json") as f:
        entries = json.loads(f.read())["entries"]
    n = len(entries)
    columns = [pa.array([part.walk] * n, pa.int64()), pa.array([part.page] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([part.restart] * n, pa.bool_()), pa.array([json.dumps(e, sort_keys=True, ensure_ascii=False) for e in entries], pa.string())]
    yield pa.RecordBatch.from_arrays(columns, names=["walk", "page", "place", "restart", "entry"])


class Walk(DataSourceReader):
    """All pages of the last walk, or those behind a place that was read before."""

    def __init__(self, folder: str, after: tuple[int, int]):
        self.folder, self.after = folder, after

    def partitions(self) -> list[Page]:
        return pages_between(self.after, last_page(self.folder))

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return read_page(self.folder, partition)


class WalkStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"walk": 0, "page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        walk, page = last_page(self.folder)
        return {"walk": walk, "page": page}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return pages_between((start["walk"], start["page"]), (end["walk"], end["page"]))

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return read_page(self.folder, partition)


def pages_between(start: tuple[int, int], end: tuple[int, int]) -> list[Page]:
    """Pages behind the start; where the walk is another, all of the new walk, as a restart unless nothing was read before."""
    same = start[0] == end[0]
    return [Page(end[0], n, restart=not same and start[0] > 0) for n in range(start[1] + 1 if same else 1, end[1] + 1)]


class PagedFeed(DataSource):
    """``format("paged_feed")``; options: ``path``, and for batches ``walk`` and ``page`` (what was read before)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Walk:
        return Walk(self.options["path"], (int(self.options.get("walk", 0)), int(self.options.get("page", 0))))

    def streamReader(self, schema) -> WalkStream:  # noqa: N802
        return WalkStream(self.options["path"])


def read_feed(spark: SparkSession, folder: str, walk: int = 0, page: int = 0) -> DataFrame:
    spark.dataSource.register(PagedFeed)
    return spark.read.format("paged_feed").option("walk", walk).option("page", page).load(folder)


def stream_feed(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(PagedFeed)
    return spark.readStream.format("paged_feed").load(folder)


def walked(inventory: DataFrame, feed: DataFrame) -> DataFrame:
    """The inventory (``id, entry``) after rows of a feed: the last entry of each id counts, deleted ones go, and after a restart all that was not listed goes too."""
    number = F.struct("walk", "page", "place")
    last = feed.withColumn("id", F.get_json_object("entry", "$.id")).groupBy("id").agg(F.max_by("entry", number).alias("entry"))
    alive = last.where(~F.coalesce(F.get_json_object("entry", "$.deleted") == "true", F.lit(False))).select("id", "entry")
    restarted = feed.agg(F.coalesce(F.max("restart"), F.lit(False)).alias("_restarted"))
    kept = inventory.join(last.select("id"), "id", "left_anti").join(F.broadcast(restarted)).where("not _restarted").select("id", "entry")  # one row
    return kept.unionByName(alive)

"""Benchmark decontamination by greedy string tiling.

A document is compared with an item only where they share a seed: ``min_tile`` consecutive words.  For such a pair the
longest common run of unmarked words is found by comparing Karp-Rabin hashes of windows, all places of that length are
marked on both sides, and so on down to ``min_tile``.  Tiles may lie in any order, so a passage whose sentences were
moved is still covered; an item counts as leaked where its tiles cover ``threshold`` of its words.

Documents are never shuffled.  The items are the side whose size has to be proven: they are dealt by a hash into as many
blocks as keep each under ``block_chars``, written to the shared folder, and every block is one pass over the documents
whose tasks read it there: nothing of the benchmark goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import ALNUM, ascii_lower, map_rows, new_folder, texts

MIN_TILE = 5
THRESHOLD = 0.5
BLOCK_CHARS = 4_000_000
#: Odd multiplier of the window hashes, and the code of words that no item has.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ABSENT = 0

TILE = T.StructType([T.StructField("doc_start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("length", T.LongType())])


def words_of(text: bytes) -> list[bytes]:
    """Words of digits, letters A-Z in lower case, and non-ASCII bytes."""
    return ascii_lower(text).translate(ALNUM).split()


def mixed(codes: np.ndarray) -> np.ndarray:
    """Word codes as spread 64-bit values."""
    x = codes.astype(np.uint64) * MULTIPLIER
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` values, by doubling: a window is two shorter ones side by side."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, part, width, factor = np.zeros(n, dtype=np.uint64), 0, values, 1, MULTIPLIER
    rest = size
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                out = out * factor + part[done : done + n]
                done += width
            rest >>= 1
            if rest:
                part = part[:-width] * factor + part[width:]
                factor = factor * factor
                width *= 2
    return out


@dataclass(frozen=True)
class Tile:
    doc_start: int
    item_start: int
    length: int


def free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` without a marked word."""
    if len(marked) < size:
        return np.zeros(0, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[size:] == before[:-size])


def common_windows(doc: np.ndarray, item: np.ndarray, doc_marked: np.ndarray, item_marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the free windows that both sides have."""
    a, b = free_windows(doc_marked, size), free_windows(item_marked, size)
    if not len(a) or not len(b):
        return a[:0], np.zeros(0, np.uint64), b[:0], np.zeros(0, np.uint64)
    x, y = window_hashes(doc, size)[a], window_hashes(item, size)[b]
    both = np.intersect1d(x, y)
    in_a, in_b = np.isin(x, both), np.isin(y, both)
    return a[in_a], x[in_a], b[in_b], y[in_b]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[Tile]:
    """Tiles of two code sequences: always the longest common free run next; among equals the first of the item, then the first of the document.

    Codes ``ABSENT`` match nothing.  A common run of some length has common runs of every smaller length inside, so
    the longest is found by bisection over window hashes; equal hashes are verified word by word.
    """
    doc_marked, item_marked = doc == ABSENT, item == ABSENT
    xs, ys = mixed(doc), mixed(item)
    tiles: list[Tile] = []
    longest = min(len(doc), len(item))
    while longest >= min_tile:
        low, high = min_tile - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if len(common_windows(xs, ys, doc_marked, item_marked, middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < min_tile:
            break
        longest = low
        a, hash_a, b, hash_b = common_windows(xs, ys, doc_marked, item_marked, longest)
        places: dict[int, list[int]] = {}
        for start, h in zip(a[::-1].tolist(), hash_a[::-1].tolist(), strict=True):  # the first place is taken first
            places.setdefault(h, []).append(start)
        found = False
        for start, h in zip(b.tolist(), hash_b.tolist(), strict=True):
            if item_marked[start : start + longest].any():
                continue
            waiting = places.get(h, [])
            while waiting:
                at = waiting[-1]
                waiting.pop()
                if doc_marked[at : at + longest].any() or not np.array_equal(doc[at : at + longest], item[start : start + longest]):
                    continue
                tiles.append(Tile(at, start, longest))
                doc_marked[at : at + longest] = True
                item_marked[start : start + longest] = True
                found = True
                break
        if not found:  # only places with equal hashes and different words were left
            longest -= 1
    return tiles


@dataclass(frozen=True)
class Seeds:
    """The windows of one size of all items: distinct hashes in order, and for each the items that have it, once for each place.

    ``of_item`` are the numbers of the seeds at an item's places, from ``begins[item]`` on.
    """

    size: int
    hashes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    of_item: np.ndarray
    begins: np.ndarray

    def found(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a document's windows that are seeds, and the number of the seed at each."""
        windows = window_hashes(values, self.size)
        at = np.minimum(np.searchsorted(self.hashes, windows), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == windows)
        return places, at[places]

    def item_places(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that have any of the distinct seeds, and at how many places."""
        first, sizes = self.starts[seeds], self.starts[seeds + 1] - self.starts[seeds]
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.unique(self.owners[at], return_counts=True)


def covered_places(places: np.ndarray, size: int) -> int:
    """How many words windows at the ascending places cover."""
    return int(np.minimum(np.diff(places), size).sum()) + size if len(places) else 0


class SeedIndex:
    """The items of one block: codes of their words, and their seeds in flat arrays."""

    def __init__(self, items: list[tuple[int | None, bytes]], min_tile: int):
        self.codes: dict[bytes, int] = {}
        self.keys = [key for key, _ in items]
        self.items = [np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)], dtype=np.int64) for _, text in items]
        #: Items shorter than a tile are one seed of their own length.
        self.sizes = [min(min_tile, len(x)) for x in self.items]
        self.seeds = [self._seeds(size) for size in sorted(set(self.sizes) - {0})]

    def _seeds(self, size: int) -> Seeds:
        windows = [window_hashes(mixed(x), size) if n == size else np.zeros(0, dtype=np.uint64) for x, n in zip(self.items, self.sizes, strict=True)]
        owners = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        hashes, of_item = np.unique(np.concatenate(windows), return_inverse=True)
        order = np.argsort(of_item, kind="stable")
        starts = np.searchsorted(of_item[order], np.arange(len(hashes) + 1))
        return Seeds(size, hashes, starts, owners[order], of_item, np.cumsum([0, *map(len, windows)]))

    def candidates(self, codes: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items of which seeds that the document has can cover the threshold, with the document's words in those seeds (stretches, -1 between).

        Items are counted before any is looked at, each seed of the document once: one that very many items have adds one
        count to each, and an item without enough of them costs nothing more.
        """
        values = mixed(codes)
        for seeds in self.seeds:
            places, own = seeds.found(values)
            if not len(places):
                continue
            distinct = np.unique(own)
            items, counts = seeds.item_places(distinct)
            for k in items[counts * seeds.size >= threshold * np.array([len(self.items[i]) for i in items.tolist()])].tolist():
                of_item = seeds.of_item[seeds.begins[k] : seeds.begins[k + 1]]
                need = threshold * len(self.items[k])
                if covered_places(np.flatnonzero(np.isin(of_item, distinct)), seeds.size) < need:
                    continue
                here = places[np.isin(own, of_item)]
                if min(covered_places(here, seeds.size), len(self.items[k])) < need:
                    continue
                cut = np.flatnonzero(np.diff(here) > seeds.size) + 1
                yield k, np.concatenate([np.append(np.arange(part[0], part[-1] + seeds.size), -1) for part in np.split(here, cut)])

    def leaks(self, text: bytes, threshold: float) -> list[tuple[int, list[Tile]]]:
        """Items whose tiles cover at least ``threshold`` of their words, with the tiles."""
        get = self.codes.get
        codes = np.array([get(w, ABSENT) for w in words_of(text)], dtype=np.int64)
        out = []
        for k, where in self.candidates(codes, threshold):
            # words outside shared seeds are in no tile: only the shared stretches are compared, kept apart by an absent word
            item = self.items[k]
            tiles = greedy_tiles(np.where(where >= 0, codes[where], ABSENT), item, self.sizes[k])
            if sum(t.length for t in tiles) >= threshold * len(item):
                out.append((k, [Tile(int(where[t.doc_start]), t.item_start, t.length) for t in tiles]))
        return sorted(out)


@dataclass(frozen=True)
class Block:
    """One part of the items in the shared folder, read by the tasks themselves."""

    folder: str
    number: int
    min_tile: int

    def index(self) -> SeedIndex:
        import pyarrow.dataset
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.folder)
        found = pyarrow.dataset.dataset(f"{base}/block={self.number}", filesystem=system, format="parquet").to_table(columns=["item_id", "text"])
        rows = zip(found["item_id"].to_pylist(), (t.encode() for t in found["text"].to_pylist()), strict=True)
        return SeedIndex(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), self.min_tile)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, min_tile: int, block_chars: int) -> list[Block]:
    """The distinct items with a text, written to the shared folder in blocks of about ``block_chars`` characters each; only their number reaches the driver."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    if not n:
        return []
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    sizes = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))
    if not sizes.where(F.col("chars") > 8 * block_chars + F.col("longest")).isEmpty():
        raise ValueError("a block of items is far larger than its bound: choose smaller blocks")
    folder = new_folder(benchmark.sparkSession, "benchmark-blocks")
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return [Block(folder, r["block"], min_tile) for r in sizes.select("block").orderBy("block").collect()]


_indexes: dict[Block, SeedIndex] = {}


def index_of(block: Block) -> SeedIndex:
    """The index of a block, built once per worker; only the latest is kept."""
    if block not in _indexes:
        _indexes.clear()
        _indexes[block] = block.index()
    return _indexes[block]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that leaked into it: id, item_id, item_words, covered_words, coverage, tiles.

    Null and empty texts, and items without words, leak nothing; an item shorter than ``min_tile`` words must stand
    as a whole.  Repeated documents are repeated, repeated items count once, and items of one id with different texts
    are separate rows.  An empty benchmark gives no rows.  Other columns are not read.
    """
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", item_type), T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(TILE))])
    rows = docs.select(id_col, F.col(text_col).cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)

    def runner(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block)
            for batch in batches:
                columns: list[list] = [[] for _ in range(6)]
                for at, text in enumerate(texts(batch.column(1))):
                    for k, tiles in index.leaks(text, threshold):
                        covered, size = sum(t.length for t in tiles), len(index.items[k])
                        for column, value in zip(columns, (at, index.keys[k], size, covered, covered / size, [vars(t) for t in tiles]), strict=True):
                            column.append(value)
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                tile = pa.list_(pa.struct([(f.name, pa.int64()) for f in TILE.fields]))
                kinds = (None, pa.int64(), pa.int64(), pa.float64(), tile)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, type=t) if t else item_array(c) for c, t in zip(columns[1:], kinds, strict=True)]], names=schema.names)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_type)

    def item_array(values: list) -> pa.Array:
        return pa.array(values, type=arrow_item)

    parts = [map_rows(rows, runner(block), schema) for block in item_blocks(benchmark, item_col, item_text_col, min_tile, block_chars)]
    for k, part in enumerate(parts):
        out = part if k == 0 else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, into which no item leaked.

    Null and empty texts stay; repeated rows are judged each by itself; an empty benchmark or table changes nothing.
    """
    at = docs.columns.index(text_col)

    def runner(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block)
            for batch in batches:
                yield batch.filter(pa.array([not index.leaks(t, threshold) for t in texts(batch.column(at))], pa.bool_()))

        return run

    for block in item_blocks(benchmark, item_col, item_text_col, min_tile, block_chars):
        docs = map_rows(docs, runner(block), docs.schema)
    return docs

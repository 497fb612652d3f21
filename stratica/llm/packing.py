"""Token-id files with fixed-width bit packing.

Each id takes the minimum bits for the vocabulary.  A shard file holds whole documents in ascending id order:

    magic 8 bytes | bits, block size, documents, ids, blocks, number of the shard in its range: 6 unsigned 64-bit integers
    document ids: signed 64-bit | document starts: unsigned 64-bit (documents + 1) | block offsets: unsigned 64-bit (blocks + 1)
    packed blocks: ``block`` ids each (the last fewer), each block starting on a byte

All integers are little-endian.  Block offsets make any id reachable without unpacking what stands before it.  Beside the
shards of each range lies its index file, written once all sizes are known:

    magic 8 bytes | for every shard of the range in order: the number of ids of all shards before it, unsigned 64-bit

Documents are dealt by ranges of their id (a hash of the text and the row's place break ties, so neither repeated ids nor
repeated rows pile up in one range) and sorted within; every task writes shards of bounded size straight to the shared
folder and renames each into place, so a task that is run again replaces its files with equal ones.  The running sums are
taken on Spark: over the ranges, then over the shards of each; nothing of the corpus or of its shards reaches the driver.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import drop_stored, map_rows, new_folder, stored, texts

MAGIC, INDEX_MAGIC = b"BITPACK1", b"BITPIDX1"
BLOCK = 4096
SHARD_IDS = 4_000_000
KEPT_WORDS = 400_000
LINE_WORDS = 256


def bits_for(vocabulary: int) -> int:
    """Minimum bits of an id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a stream of ``bits``-wide little-endian fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    wide = np.zeros((n, 32), dtype="u1")
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, dtype="u1"), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


def shard_image(doc_ids: list[int], ids: list[np.ndarray], bits: int, block: int = BLOCK, number: int = 0) -> bytes:
    """The file of one shard."""
    sizes = np.array([len(x) for x in ids], dtype="<u8")
    flat = np.concatenate([np.zeros(0, dtype="<u4"), *ids])
    blocks = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    out = io.BytesIO()
    out.write(MAGIC)
    out.write(np.array([bits, block, len(ids), len(flat), len(blocks), number], dtype="<u8").tobytes())
    out.write(np.array(doc_ids, dtype="<i8").tobytes())
    out.write(np.concatenate([np.zeros(1, dtype="<u8"), np.cumsum(sizes, dtype="<u8")]).astype("<u8").tobytes())
    out.write(np.concatenate([np.zeros(1), np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes())
    for b in blocks:
        out.write(b)
    return out.getvalue()


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        self.bits, self.block, docs, self.n_ids, blocks, self.number = (int(x) for x in np.frombuffer(data, "<u8", 6, 8))
        at = 56
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (blocks + 1) :]

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the shard, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.body[self.offsets[b] : self.offsets[b + 1]], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def shard_name(task: int, number: int) -> str:
    return f"shard-{task:06d}-{number:06d}.bin"


def index_name(task: int) -> str:
    return f"index-{task:06d}.bin"


def put_file(system, base: str, name: str, content: bytes) -> None:
    """Write a file under another name and move it into place: no reader sees half of it."""
    passing = f"{base}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write(content)
    system.move(passing, f"{base}/{name}")


def get_file(system, base: str, name: str) -> bytes:
    with system.open_input_stream(f"{base}/{name}") as found:
        return found.read()


class WordEncoder:
    """Whole texts through the tokenizers library, word by word.

    The vocabulary's normaliser and pattern never join what blanks separate, so a text's ids are its words' ids one
    after another; frequent words are encoded once per worker.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[bytes, bytes] = {}
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        probe = "a b"
        self.by_word = normalizer is not None and splitter is not None and not any(" " in p or "Ġ" in p for p, _ in splitter.pre_tokenize_str(normalizer.normalize_str(probe)))

    def _library(self, many: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([m.decode("utf-8", "replace") for m in many], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: the library gets lines of many words, whose ids are told apart by where their tokens start."""
        lines = [b" ".join(words[i : i + LINE_WORDS]).decode("utf-8", "replace") for i in range(0, len(words), LINE_WORDS)]
        out: list[bytes] = []
        for line, found in zip(lines, self.tokenizer.encode_batch(lines, add_special_tokens=False), strict=True):
            ids, starts = np.array(found.ids, dtype="<u4").tobytes(), np.array([start for start, _ in found.offsets], dtype=np.int64)
            ends = np.cumsum([len(w) + 1 for w in line.split(" ")])
            cuts = (np.searchsorted(starts, ends) * 4).tolist()
            out += [ids[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        return out

    def encode(self, many: list[bytes]) -> list[bytes]:
        """For every text its ids as bytes of unsigned 32-bit integers."""
        if not self.by_word:
            return self._library(many)
        split = [m.split() for m in many]
        rows = [list(map(self.kept.get, words)) for words in split]
        missing = list({w for words, row in zip(split, rows, strict=True) if None in row for w, ids in zip(words, row, strict=True) if ids is None})
        fresh = dict(zip(missing, self._words(missing), strict=True))
        out = [b"".join([fresh[w] if ids is None else ids for w, ids in zip(words, row, strict=True)] if None in row else row) for words, row in zip(split, rows, strict=True)]
        room = KEPT_WORDS - len(self.kept)
        if room > 0:
            self.kept.update(list(fresh.items())[:room] if len(fresh) > room else fresh)
        return out


@lru_cache(maxsize=2)
def word_encoder(spec: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    return WordEncoder(spec)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, pack and write all rows; returns (range, number, n_docs, n_ids), which order the shards.

    A null text is empty and has the end id only; null ids come first and are stored as the smallest integer.
    Rows of one id stand next to each other, ordered by a hash of their text.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    spark = docs.sparkSession
    bits = bits_for(max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end_id + 1))
    sent = spark.sparkContext.broadcast(spec)  # a vocabulary file: a few MB, whatever the data
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumns({"_tie": F.xxhash64("_text"), "_place": F.monotonically_increasing_id()})
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "_id", "_tie", "_place").sortWithinPartitions("_id", "_tie", "_place").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = word_encoder(sent.value)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            name = shard_name(task, number)
            put_file(system, base, name, shard_image(held_ids, held, bits, number=number))
            row = pa.RecordBatch.from_pydict({"range": [task], "number": [number], "n_docs": [len(held)], "n_ids": [size]})
            held_ids.clear()
            held.clear()
            return row

        end = np.array([end_id], dtype="<u4").tobytes()
        for rows in batches:
            keys = rows.column(0).to_pylist()
            many = texts(rows.column(1))
            for at in range(0, len(many), 1000):  # bounded memory whatever the batch
                for key, ids in zip(keys[at : at + 1000], encoder.encode(many[at : at + 1000]), strict=True):
                    held_ids.append(-(1 << 63) if key is None else key)
                    held.append(np.frombuffer(ids + end, dtype="<u4"))
                    size += len(held[-1])
                    if size >= shard_ids:
                        yield flush()
                        size, number = 0, number + 1
        if held:
            yield flush()

    return map_rows(ranged, run, "range long, number long, n_docs long, n_ids long")


def write_starts(manifest: DataFrame, folder: str) -> DataFrame:
    """Write the index file of every range; returns (range, n_shards)."""
    ranges = manifest.groupBy("range").agg(F.sum("n_ids").alias("_all"))  # one row for each range, whatever the corpus
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranges.select("range", before("_all", Window.orderBy("range")).alias("_before"))
    shards = manifest.join(first, "range").select("range", "number", (F.col("_before") + before("n_ids", Window.partitionBy("range").orderBy("number"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        starts: dict[int, list[int]] = {}
        for rows in batches:
            for key, first in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                starts.setdefault(key, []).append(first)
        for key, own in starts.items():
            put_file(system, base, index_name(key), INDEX_MAGIC + np.array(own, dtype="<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"range": pa.array(list(starts), pa.int64()), "n_shards": pa.array(map(len, starts.values()), pa.int64())})

    return map_rows(shards.repartition("range").sortWithinPartitions("range", "number").select("range", "first"), run, "range long, n_shards long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shard and index files of the folder.

    ``start`` is the number of ids of all documents before it: that of its shard, from the range's index file, and its start
    within the shard.  Documents with a null id have none here; repeated rows are separate documents.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).select("path")  # Spark deals the files; a task opens its own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for path in rows.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                shard = Shard(get_file(system, base, name))
                index = get_file(system, base, index_name(int(name.split("-")[1])))
                if index[:8] != INDEX_MAGIC:
                    raise ValueError("not an index of token-id shards")
                first = int(np.frombuffer(index, "<u8", 1, 8 + 8 * shard.number)[0])
                crcs = [zlib.crc32(shard.document(k).tobytes()) for k in range(len(shard.doc_ids))]
                keys = [None if k == -(1 << 63) else k for k in shard.doc_ids.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shard.starts[:-1] + first), pa.array(np.diff(shard.starts)), pa.array(crcs, pa.int64())], names=schema.names)

    return map_rows(files, run, schema)


def pack_corpus(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the corpus as shards and return what reading them back gives, and the folder of the files.

    Nulls, empty texts and repeated rows as in ``write_shards``; an empty table gives no rows and no files.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    manifest = stored(write_shards(docs, tokenizer, folder, end_id, id_col, text_col), "token-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long"), folder
    drop_stored(stored(write_starts(manifest, folder), "token-starts"), manifest)
    return read_shards(spark, folder), folder

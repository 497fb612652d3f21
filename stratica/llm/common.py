"""Helpers shared by the training-data operators: text batches, shared folders, stable samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.storage import CLEANUP, clear_stored, delete_path, drop_stored, new_folder, own_folder, shared_dir, stored  # noqa: F401

#: Bytes of separators turned into blanks: everything but 0-9, a-z and non-ASCII, once lower-cased.
ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(text: bytes) -> bytes:
    """Lower-case A-Z only (bytes.lower leaves all non-ASCII bytes alone)."""
    return text.lower()


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUATION))


#: Bytes of the batches that the operators' functions get (a larger row is a batch by itself).
BATCH_BYTES = 2_000_000
BATCH_ROWS = 1_000
#: Rows that Spark's Parquet reader decodes at once: their texts are held whole, and a growing buffer is copied.
SCAN_ROWS = 256


def small_batches(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` bytes, whatever the sizes of rows."""
    for whole in batches:
        waiting = [whole]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > limit:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over small batches, so that a task's memory does not follow the lengths of texts.

    Spark's own batches are made small as well, those that it reads from files too: the session's limits on their rows and
    bytes are lowered where larger.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        now = conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(lambda batches: fn(small_batches(batches)), schema)


def batch(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()], names=list(types))


def arrow_ddl(types: dict[str, pa.DataType]) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_type

    return T.StructType([T.StructField(k, from_arrow_type(t)) for k, t in types.items()])


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a file into the application's shared folder; its address."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(own_folder(spark))
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(content)
    return f"{own_folder(spark)}/{name}"


def one_row_an_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each id (columns of ``docs``): that of the smallest text hash, so that a repeated id weighs no more than another."""
    rest = F.struct(*[c for c in docs.columns if c != id_col])
    return docs.groupBy(id_col).agg(F.min_by(rest, F.xxhash64(F.col(text_col).cast("string"))).alias("_one")).select(id_col, "_one.*")


def hash_order(*columns: str) -> list:
    """A stable pseudo-random order of rows that does not depend on partitioning."""
    return [F.xxhash64(*[F.col(c) for c in columns]), *[F.col(c) for c in columns]]


def crc_mod5(id_column: str) -> F.Column:
    """crc32 of the id as text, modulo 5 (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def most_frequent(counts: DataFrame, size: int, word: str = "word", n: str = "n") -> list[tuple[bytes, int]]:
    """At most ``size`` words, most frequent first: all whose count lies in the highest ranges that hold so many.

    The ranges (16 to a doubling) are counted first, so only the words that are returned reach the driver.
    """
    level = F.floor(F.log2(n) * 16)
    below, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        total += r["words"]
        if total > size:
            below = r["level"]
            break
    chosen = counts if below is None else counts.where(level > below)
    return sorted(((bytes(r[0]), r[1]) for r in chosen.select(word, n).collect()), key=lambda r: (-r[1], r[0]))


def flatten(rows: Iterable[Iterable]) -> list:
    return [x for row in rows for x in row]

"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three characters, with word boundaries),
most frequent first.  A document's own list is compared with each profile by the out-of-place distance: the sum of
rank differences, with the profile's length for an n-gram that the profile lacks.

Counting is a per-task partial sum followed by one aggregation over (language, n-gram); the profiles that come back
to the driver are languages x ``profile_size`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import crc_mod5, map_rows, texts

PROFILE_SIZE = 400
DOC_SIZE = 400
#: More learned languages than this do not fit the bound on what the driver gathers.
MAX_LANGUAGES = 2_000
BOUNDARY = 0
#: Places of a text whose n-grams are held at a time.
SLICE = 1 << 19


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point: itself where it is a letter, else the boundary."""
    return np.array([c if chr(c).isalpha() else BOUNDARY for c in range(0x110000)], dtype=np.int64)


def ngrams(codes: np.ndarray, starts: int) -> np.ndarray:
    """All n-grams that begin at the first ``starts`` places, packed 21 bits a character; a boundary stands only at an n-gram's ends.

    The number of characters is part of the code: one more boundary at the left would be a different n-gram, so
    n-grams with a leading boundary keep a marker above their characters.
    """
    a = letters()[codes]
    x, y = a[:-1][:starts], a[1:][:starts]
    pairs = (x << 21) | y
    pairs = pairs[(x > 0) | (y > 0)]
    first, middle, last = a[:-2][:starts], a[1:-1][:starts], a[2:][:starts]
    inside = middle > 0
    # a letter's code point is below 2**18, so the marker bits of the length are free above 18 bits of the first place
    triples = ((first << 42) | (middle << 21) | last)[inside]
    single = a[:starts]
    return np.concatenate([single[single > 0] | (np.int64(1) << 19), pairs | (np.int64(1) << 40), triples | (np.int64(1) << 62)])


def gram_slices(text: str, size: int = SLICE) -> Iterator[np.ndarray]:
    """The n-grams of the lower-cased letters of a whole text, ``size`` places at a time; slices overlap by two characters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    for at in range(0, len(codes), size):
        yield ngrams(codes[at : at + size + 2], min(size, len(codes) - at))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, ascending, and their counts."""
    grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for part in gram_slices(text):
        own, n = np.unique(part, return_counts=True)
        if not len(grams):
            grams, counts = own, n
        else:
            grams, place = np.unique(np.concatenate([grams, own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), minlength=len(grams)).astype(np.int64)
    return grams, counts


def ranked(text: str, size: int) -> np.ndarray:
    """The text's ``size`` most frequent n-grams, most frequent first, ties by code."""
    grams, counts = counted(text)
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(by_lang)
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[np.array(by_lang[k], dtype=np.int64) for k in self.langs]]))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int32)
        for row, lang in enumerate(self.langs):
            self.ranks[row, np.searchsorted(self.grams, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str, doc_size: int) -> tuple[str, float]:
        """The nearest language and how near: 1 for its own profile, 0 for nothing in common; ``und`` without letters."""
        own = ranked(text, doc_size)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = len(self.grams) - 1
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[:, at]
        place = np.arange(len(own), dtype=np.int32)
        distance = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - place), self.size)).sum(axis=1)
        best = int(distance.argmin())  # ties: the first name
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def count_ngrams(docs: DataFrame, lang_col: str, text_col: str, flush: int = 4_000_000) -> DataFrame:
    """(lang, gram, n) over all rows with a language: partial sums in the tasks, then one aggregation.

    Rows with a null language or text are left out, empty texts count nothing, repeated rows count each; no rows, no counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for rows in batches:
            for lang, text in zip(rows.column(0).to_pylist(), texts(rows.column(1)), strict=True):
                for part in gram_slices(text.decode("utf-8", "replace")):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= flush:
                        yield from sums()
                        size = 0
        yield from sums()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    return map_rows(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from every row of ``docs`` that has a language and a text."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = count_ngrams(docs, lang_col, text_col).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    rows = top.select("lang", "gram", "rank").limit(size * MAX_LANGUAGES + 1).collect()
    if len(rows) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    by_lang: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        by_lang.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(by_lang, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", doc_size: int = DOC_SIZE) -> DataFrame:
    """One row per row of ``docs``: id, held_out (crc32 of the id modulo 5 is 0), lang_pred, score (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0.  Only the text is an input of the prediction.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = [profiles.predict(t.decode("utf-8", "replace"), doc_size) for t in texts(rows.column(2))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.float64())], names=schema.names)

    held_out = (crc_mod5(id_col) == 0).alias("held_out")
    return map_rows(docs.select(id_col, held_out, F.col(text_col).cast("string")), run, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32 of the id modulo 5 is not 0."""
    return docs.where(crc_mod5(id_col) != 0)

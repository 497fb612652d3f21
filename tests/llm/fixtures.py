"""Awkward documents: nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Added to the ids below, which then differ from those of the documents table.
FIRST = 1_000_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, _row long, _root long, word string, held_out boolean, n long, label int, _text string, _label int, _key long, _node long, _fp long, _one string, _cell long, _id long, _tie long"
LONG = " ".join(f"word{i % 977} Über{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox, jumps over the lazy dog. It's 2024!\n\nAll rights reserved."),
    (2, None),
    (3, ""),
    (4, "   \n\t \r\n"),
    (5, LONG),
    (6, "naïve café   日本語 text with　blanks 👍🏽 <|endoftext|> after"),
    (7, "same text here twice"),
    (7, "same text here twice"),
    (8, "same text here twice"),
    (None, "an orphan without an id"),
    (None, None),
    (9, "x" * 5000),
    (10, "tab\tsep\x0bvt\x0cff a  b   c \u0000nul"),
    (11, "Licensed under the Apache Licence, version 2.0 and CC BY. cc  by; general\npublic   license all rights, reserved cc-by"),
]


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(None if i is None else FIRST + i, t, None if k % 3 else "en", None if k % 2 else "src", None, None, k, k, "w", None, k, None, "t", k, k, k, k, "o", k, k, k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in picked.collect()), key=repr)

"""Filter interaction audit: what each of five filters removes, in every order, by part of the corpus.

One Arrow pass reads whole texts and keeps a row of a few bytes for each document: which of the filters A to D it fails, and
its text's digest.  Filter E (a copy of a smaller id's text) needs the smallest id of each digest, a sum with partial
results in the tasks; documents meet those by (id, digest), so a text with a third of all copies is no hot key.  What is
left is at most 32 counts a part (one for each set of failed filters), from which all 600 rows of a part follow:

The expected number removed when filter i is switched on with probability x_i is a polynomial, linear in every x_i:
f(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)).  Its value at a corner is what that set of filters
removes; the integral of its i-th partial derivative along the diagonal is filter i's Shapley value, an exact fraction
whose denominator divides 120.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import code_points, map_rows, stored, texts

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS = 200
MARKS = b"#$%&*|"
UPPER = bytes(range(0x41, 0x5B))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text: bytes) -> int:
    """The filters A to D that a whole text fails, as bits (A is the lowest)."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    marks = len(text) != len(text.translate(None, MARKS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * code_points(text)) << 2 | marks << 3


class Removal:
    """The removal polynomial of one part: ``coefficients[S]`` belongs to the product of x_i over the filters of the set S."""

    def __init__(self, counts: Sequence[int]):
        self.coefficients = [0] * len(counts)
        for s in range(1, len(counts)):
            fail_all = sum(n for m, n in enumerate(counts) if m & s == s)
            self.coefficients[s] = fail_all if s.bit_count() % 2 else -fail_all

    def corner(self, chosen: int) -> int:
        """How many documents the chosen filters remove together."""
        return sum(c for s, c in enumerate(self.coefficients) if s & chosen == s)

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the partial derivative by x_i where all x are t."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if s >> i & 1), Fraction(0))


def interactions(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, *COUNTS) for every order of the filters; ``counts``: documents, good and toxic ones by failed filters."""
    size = 1 << len(filters)
    total = sum(n for n, _, _ in counts.values())
    removal, good, toxic = (Removal([counts.get(m, (0, 0, 0))[k] for m in range(size)]) for k in range(3))
    gone, gone_good, gone_toxic = ([p.corner(s) for s in range(size)] for p in (removal, good, toxic))
    orders = factorial(len(filters))
    shapley = [int(orders * removal.shapley(i)) for i in range(len(filters))]
    for order in permutations(range(len(filters))):
        before, name = 0, "".join(filters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield name, step, total - gone[after], removed, gone[1 << i] - removed, gone[-1] - gone[size - 1 - (1 << i)], gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], shapley[i]
            before = after


def failure_rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A short row for each document: id, part, filters A to D failed, SHA-256 of the text (null: empty)."""
    types = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("failed", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = texts(rows.column(2))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([failed(t) for t in own], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in own], pa.binary())], names=types.names)

    return map_rows(docs.select(F.col(id_col), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.col(text_col).cast("string")), run, types)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents, good and toxic ones for each part and set of failed filters (``mask``): at most 32 rows a part.

    An id of several label rows is good, or toxic, if one of them says so; null ids have no labels and are no copies.
    """
    rows = stored(failure_rows(docs, id_col, text_col, part_col), "audit-rows")
    first = rows.where("doc is not null").groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col(id_col).alias("doc")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c) for c in ("quality", "toxic")])
    copy = F.col("doc").isNotNull() & F.col("first").isNull()
    whole = rows.join(first, ["doc", "digest"], "left").join(marks, "doc", "left")
    mask = F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return whole.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Part, filter_order, step and ``COUNTS`` for every part, every order of the five filters and each of its steps.

    A null part is the empty one, a null text the empty text; repeated rows (equal in id and text) count each, and none of
    them is a copy of the other; other columns are not read.  An empty table gives no rows, empty labels no losses.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                found = list(interactions({x["mask"]: (x["n"], x["good"], x["toxic"]) for x in own}))
                columns = [[part] * len(found), *map(list, zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return map_rows(parts, run, schema)


#: The same rows in DuckDB: every document's failures, then every order step by step.
AUDIT_SQL = r"""
    WITH own AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
    ), marks AS (
        SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
    ), fails AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
               regexp_matches(t, '[#$%&*|]'), coalesce(o.doc_id > min(o.doc_id) OVER (PARTITION BY t), false)] AS f
        FROM own o LEFT JOIN marks m ON o.doc_id = m.doc_id
    ), counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
    p AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
    orders AS (
        SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
    ), steps AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS earlier FROM orders, p s),
    placed AS (
        SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails_own, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS n_failed FROM counts, steps
    ), sums AS (
        SELECT part, filter_order, step, own,
               coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails_own AND NOT gone), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (fails_own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_own AND n_failed = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (fails_own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails_own AND NOT gone), 0)::BIGINT AS toxic_lost
        FROM placed GROUP BY ALL
    )
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums
"""

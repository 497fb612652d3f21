"""Quality rules: two plain rules, then boosted trees over document statistics.

The statistics of a whole text come from byte-level operations inside one Arrow pass; nothing is shuffled for
scoring.  The trees are fitted on a bounded sample of labelled rows (``train_rows``, chosen by a hash of the id),
flattened to node arrays of a few KB and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import code_points, hash_order, map_rows, one_row_an_id, texts
from stratica.llm.trees import FlatTrees, fit_trees

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TRAIN_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, with the direction in which the verdict may move (-1: more of it never helps; 0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "unique_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "bang_share": -1,
    "words_per_line": 0,
    "short_word_share": 0,
    "long_word_share": -1,
    "stop_share": 0,
}
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(w.encode() for w in "the of and to in is was that it for with as at by be on are this from or an und der die das den dem nicht mit von ist zu ein eine auf für im es sich als auch le la les de des du et un une en est que qui dans pour sur au par el los las y del al se con por para su lo".split())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five counts of the base rules and the features of the trees, for one whole text."""
    words = text.split()
    n = len(words)
    word_chars = code_points(text.translate(None, BLANKS))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    n_dup_lines = len(lines) - len(set(lines))
    distinct: dict[bytes, int] = {}
    codes = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), dtype=np.int64, count=n)
    n_repeat = repeated_words(codes, len(distinct))
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))[codes] if n else np.zeros(0, dtype=np.int64)
    stops = np.fromiter((w.lower() in STOP_WORDS for w in distinct), dtype=bool, count=len(distinct))[codes] if n else np.zeros(0, dtype=bool)
    letters = max(word_chars, 1)
    some = max(n, 1)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    bangs = text.count(b"!") + text.count(b"?")
    return [n, word_chars, n_symbols, n_dup_lines, n_repeat], [
        float(np.log1p(n)),
        word_chars / some,
        n_symbols / some,
        n_dup_lines / max(len(lines), 1),
        n_repeat / some,
        len(distinct) / some,
        upper / letters,
        digits / letters,
        bangs / some,
        n / max(len(lines), 1),
        float((sizes <= 3).sum()) / some,
        float((sizes > 20).sum()) / some,
        float(stops.sum()) / some,
    ]


def repeated_words(codes: np.ndarray, n_distinct: int) -> int:
    """Words covered by a 3-word window that stands twice or more in the text, the first time included."""
    if len(codes) < 4:
        return 0
    width = np.int64(max(n_distinct, 2))
    if n_distinct < 2_000_000:  # three codes fit in 63 bits
        keys = (codes[:-2] * width + codes[1:-1]) * width + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * width + codes[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * np.int64(len(codes)) + pairs[1:]
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    again = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def with_statistics(docs: DataFrame, id_col: str, text_col: str, carry: str | None = None) -> DataFrame:
    """Id, an optional carried column, the counts, and the features as an array."""
    columns = [id_col, *([carry] if carry else [])]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in columns], T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = [statistics(t) for t in texts(rows.column(len(columns)))]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array([b[0] for b in both], pa.list_(pa.int64())), pa.array([b[1] for b in both], pa.list_(pa.float64()))], names=[*columns, "counts", "features"])

    return map_rows(docs.select(*columns, F.col(text_col).cast("string")), run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> FlatTrees:
    """Fit the trees on at most ``train_rows`` labelled ids (smallest hash of the id first).

    Labels other than 0 and 1 and null ids are not used.  Repeated labels of one id count as one, the smaller, and of
    repeated documents of one id only that of the smallest text hash is learned from.  Null and empty texts have no words.
    With no usable label the trees are empty and keep everything that the base rules keep.
    """
    usable = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).where(F.col(id_col).isNotNull() & F.col("_label").isin(0, 1))
    chosen = usable.groupBy(id_col).agg(F.min("_label").alias("_label")).orderBy(*hash_order(id_col)).limit(train_rows)
    sample = one_row_an_id(docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col), id_col, "_text")
    rows = with_statistics(sample, id_col, "_text", carry="_label").select(id_col, "_label", "features").toPandas()  # one row for each of at most train_rows ids
    rows = rows.sort_values(id_col)  # the fit must not hang on the order of tasks
    x = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["_label"].to_numpy(dtype=float), np.array(list(FEATURES.values())))


def judge_quality(docs: DataFrame, trees: FlatTrees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the five counts, base_failed, score (the trees' probability), kept.

    Null and empty texts have no words, fail the base rules and are not kept.  Other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            both = [statistics(t) for t in texts(rows.column(1))]
            counts, features = np.array([b[0] for b in both], dtype=np.int64), np.array([b[1] for b in both], dtype=float)
            failed, score = base_failed(counts), trees.probability(features)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(counts[:, k]) for k in range(5)], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=schema.names)

    return map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def drop_low_quality(docs: DataFrame, trees: FlatTrees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, all columns unchanged.

    Null and empty texts go, as they fail the base rules; repeated rows are judged each by itself; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                both = [statistics(t) for t in texts(rows.column(at))]
                failed = base_failed(np.array([b[0] for b in both], dtype=np.int64))
                yield rows.filter(pa.array(~failed & (trees.probability(np.array([b[1] for b in both], dtype=float)) >= threshold)))

    return map_rows(docs, run, docs.schema)

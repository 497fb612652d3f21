"""Language-model scoring: a recurrent model over frequent words, and corpus counts for all others.

All training tokens are counted (partial sums per task, then one sum); the count table is the shared model of rare
words and grows with the corpus, so it stays a table.  The most frequent words are the recurrent model's vocabulary.
Any other word is the model's "other" followed by its share among the other words: the probabilities of all words of
the training corpus and one unknown word add up to one.

Counts of the most frequent ``head`` words travel with the tasks.  The rest of each text's words is joined with the count
table once, after the texts have been read.  A word that is frequent in training texts is in the head and so no hot key
there; one that is frequent only in texts that are not learned from can be, and adaptive execution splits its rows, as both
sides of the join are read from stored tables.

The network is trained by replicas: tasks that start from the same weights each pass over their part of the training
documents, and their weights are averaged, for a few rounds.  Every training document is used once, in one of the rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm import gru
from stratica.llm.common import ascii_lower, crc_mod5, map_rows, most_frequent, small_batches, stored, texts

#: The end of a text in the count table: no word has a blank.
END = b" "
CLASSES, CLASS_SIZE, HIDDEN = 32, 32, 16
HEAD = 100_000
REPLICA_TOKENS = 1_000_000
MOST_REPLICAS = 4_096
ROUNDS = 2
RATE = 0.05
#: Tokens that a replica holds at a time, and characters that are scored side by side.
CHUNK_TOKENS = 300_000
CHUNK_BYTES = 6_000_000
#: Averaging goes through tasks of so many replicas each before the driver.
FAN_IN = 64


@dataclass
class Model:
    """Head words by falling count, their counts and network ids (``other`` for those the network lacks), and corpus totals."""

    words: list[bytes]
    counts: np.ndarray
    network: np.ndarray
    other: int
    end: int
    ends: int
    tokens: int
    distinct: int
    other_tokens: int
    other_distinct: int
    weights: gru.Weights

    def __post_init__(self) -> None:
        self.codes: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"codes": {}}

    def code(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """The lower-cased words and their head codes (-1: not in the head)."""
        if not self.codes and self.words:
            self.codes.update((w, k) for k, w in enumerate(self.words))
        words = ascii_lower(text).split()
        return words, np.fromiter(map(self.codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def known_ids(self) -> dict[bytes, int]:
        """The network ids of the words that the network has: a small table for training, which needs no counts."""
        return {w: i for w, i in zip(self.words, self.network.tolist(), strict=True) if i != self.other}

    def network_ids(self, codes: np.ndarray) -> np.ndarray:
        """Network ids of head codes, and the end."""
        return np.append(np.where(codes < 0, self.other, self.network[codes] if len(self.network) else self.other), self.end)


def count_words(docs: DataFrame, text_col: str, flush: int = 200_000) -> DataFrame:
    """(word, n) over all rows: the lower-cased words, and END once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in texts(batch.column(0)):
                counts.update(ascii_lower(text).split())
                counts[END] += 1
                if len(counts) >= flush:
                    yield sums()
        yield sums()

    return map_rows(docs.select(F.col(text_col).cast("string")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_model(counts: DataFrame, head: int = HEAD, classes: int = CLASSES, class_size: int = CLASS_SIZE, hidden: int = HIDDEN) -> Model:
    """An untrained model over a stored count table."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = sum(r["n"] for r in counts.where(F.col("word") == F.lit(bytearray(END))).collect())
    rows = [r for r in most_frequent(counts, head) if r[0] != END]
    size = classes * class_size
    known = rows[: size - 2]
    known_tokens = sum(n for _, n in known)
    other_tokens, other_distinct = tokens - known_tokens - ends, distinct - len(known) - (1 if ends else 0)
    # network ids by falling count, "other" and "end" among the words
    ranked = sorted([*((n, 2, k) for k, (_, n) in enumerate(known)), (other_tokens, 0, -1), (ends, 1, -2)], key=lambda r: (-r[0], r[1], r[2]))
    place = {r[2]: i for i, r in enumerate(ranked)}
    network = np.array([place[k] if k < len(known) else place[-1] for k in range(len(rows))], dtype=np.int64)
    shares = np.array([r[0] for r in ranked], dtype=float)
    return Model([w for w, _ in rows], np.array([n for _, n in rows], dtype=np.int64), network, place[-1], place[-2], ends, tokens, distinct, other_tokens, other_distinct, gru.initial(shares, classes, class_size, hidden))


def train_round(sample: DataFrame, replicas: int, model: Model, text_col: str, rate: float) -> gru.Weights:
    """Every partition of the sample trains a replica for one pass; the replicas are averaged by their tokens."""

    def replica(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.unpack(model.weights.pack())
        optimizer = gru.Adam(weights, rate)
        held: list[np.ndarray] = []
        size = total = 0
        get = model.known_ids().get
        for batch in batches:
            for text in texts(batch.column(0)):
                words = ascii_lower(text).split()
                held.append(np.append(np.fromiter(map(get, words, repeat(model.other)), dtype=np.int64, count=len(words)), model.end))
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    gru.train(weights, held, model.end, optimizer)
                    total += size
                    held, size = [], 0
        gru.train(weights, held, model.end, optimizer)
        if total + size:
            yield pa.RecordBatch.from_arrays([pa.array([weights.pack()], pa.binary()), pa.array([total + size], pa.int64())], names=["weights", "tokens"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for data, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, "<f4").astype(np.float64) * tokens
                total, n = part if total is None else total + part, n + tokens
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "tokens"])

    schema = "weights binary, tokens long"
    found = map_rows(sample.select(text_col), replica, schema)
    groups = -(-replicas // FAN_IN)
    rows = sorted(map_rows(found.repartition(groups, "tokens"), averaged, schema).collect(), key=lambda r: bytes(r["weights"]))
    if not rows:
        return model.weights
    n = sum(r["tokens"] for r in rows)
    mean = sum(np.frombuffer(bytes(r["weights"]), "<f4").astype(np.float64) * (r["tokens"] / n) for r in rows)
    return model.weights.unpack(mean.astype("<f4").tobytes())


def fit_model(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, **shape: int) -> Model:
    """A trained model of the rows of ``docs``, whose words ``counts`` holds."""
    model = build_model(counts, **shape)
    if not model.tokens:
        return model
    replicas = min(MOST_REPLICAS, max(1, round(model.tokens / rounds / REPLICA_TOKENS)))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("_text"), key.alias("_key"))
    for k in range(rounds):
        own = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(rounds)) == k)
        dealt = own.repartition(replicas, "_key").sortWithinPartitions("_key", "_text")
        model.weights = train_round(dealt, replicas, model, "_text", RATE * (1 - k / (rounds + 1)))
    return model


def log10_share(n: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """log10 of the smoothed share of words with these counts."""
    return np.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: only its end is scored.  Repeated rows are repeated; other columns are not read.
    """
    tail_kind = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("_tail", tail_kind)])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # head words and weights: bounded by the model's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = sent.value
        row, ln10 = TaskContext.get().partitionId() << 40, np.log(10.0)
        base_logs = log10_share(model.counts, model.tokens, model.distinct)
        other_logs = np.where(model.network == model.other, log10_share(model.counts, model.other_tokens, model.other_distinct), 0.0)
        end_log = float(log10_share(np.array(model.ends), model.tokens, model.distinct))
        end_known = int(model.ends > 0)

        held_ids: list[pa.Array] = []
        held: list[bytes] = []

        def scored() -> pa.RecordBatch:
            nonlocal row
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "other")}
            sequences, rare_words, rare_counts, ends = [], [], [], [0]
            for text in held:
                words, codes = model.code(text)
                known = codes[codes >= 0]
                sequences.append(model.network_ids(codes))
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(known) + end_known)
                out["base"].append(float(base_logs[known].sum()) + end_log)
                out["other"].append(float(other_logs[known].sum()))
                rare = Counter([words[i] for i in np.flatnonzero(codes < 0).tolist()])
                rare_words += rare.keys()
                rare_counts += rare.values()
                ends.append(len(rare_words))
            score = gru.score(model.weights, sequences) / ln10 + np.array(out["other"])
            rows = np.arange(row, row + len(held))
            row += len(held)
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], ["word", "n"]))
            ids = pa.concat_arrays(held_ids)
            held_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(score), tail], names=schema.names)

        size = 0
        for batch in batches:  # texts side by side across batches, and bounded whatever their lengths
            for part in small_batches([batch], CHUNK_BYTES):
                if held and size + part.nbytes > CHUNK_BYTES:
                    yield scored()
                    size = 0
                held_ids.append(part.column(0))
                held += texts(part.column(1))
                size += part.nbytes
        if held:
            yield scored()

    read = stored(map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema), "lm-scores")
    rare = read.select("_row", F.explode("_tail").alias("t")).select("_row", F.col("t.word").alias("word"), F.col("t.n").alias("k"))
    outside = counts.where(F.col("n") <= int(model.counts[-1])) if len(model.counts) else counts
    joined = rare.join(outside, "word", "left").select("_row", "k", F.coalesce("n", F.lit(0)).alias("c"))
    log_of = lambda tokens, distinct: F.log10((F.col("c") + 0.5) / F.lit(tokens + 0.5 * (distinct + 1)))
    sums = joined.groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * log_of(model.tokens, model.distinct)).alias("_base"), F.sum(F.col("k") * log_of(model.other_tokens, model.other_distinct)).alias("_other"))
    zero = F.lit(0.0)
    return read.drop("_tail").join(sums, "_row", "left").select(
        id_col,
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("_other", zero)).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that may not be learned from: crc32 of the id modulo 5 is 1."""
    return crc_mod5(id_col) == 1


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, and score all: the columns of ``score_texts`` and held_out."""
    training = docs.where(~held_out(id_col)).select(id_col, F.col(text_col).cast("string").alias(text_col))
    counts = stored(count_words(training, text_col), "lm-counts")
    model = fit_model(training, counts, id_col, text_col)
    return score_texts(docs, model, counts, id_col, text_col).withColumn("held_out", held_out(id_col))

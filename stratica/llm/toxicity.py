"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another.  Each is a logistic model over words and word beginnings of the whole text
and over the probabilities of all earlier categories.  While fitting, those probabilities come from models that did not
see the row (out-of-fold), so a later link learns how far an earlier one can be trusted on new texts.

The chain is fitted on a bounded sample of labelled rows (``train_rows``, chosen by a hash of the id) and is a few
thousand weights; scoring is row-local and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import ALNUM, ascii_lower, drop_stored, hash_order, map_rows, one_row_an_id, stored, texts

TRAIN_ROWS = 6_000
FOLDS = 4
FEATURES = 2_048
THRESHOLD = 0.5
#: Lengths in bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
KEPT_WORDS = 100_000
#: Features most associated with the label that mark a category's rows, and how far from chance they must be.
MARKERS = 64
LEAST_Z = 3.0


@dataclass(frozen=True)
class Category:
    """A label column of 0 and 1; with a ``quantile``, only those of its rows count as 1 that have as many markers as that quantile of them, one at least.

    Markers are the features most associated with the label.  Each row's are found on the other folds, so a row has no part
    in choosing its own, and any vocabulary gives categories.
    """

    name: str
    label: str
    quantile: float | None = None


CATEGORIES = (Category("marked", "toxic", 0.0), Category("severe", "toxic", 0.5), Category("toxic", "toxic"))


def words_of(text: bytes) -> list[bytes]:
    return ascii_lower(text).translate(ALNUM).split()


def features_of(word: bytes) -> list[int]:
    """Hashes of the word itself and of its beginnings, which are marked so that they differ from words."""
    return [xxhash.xxh64_intdigest(f) >> 1 for f in (word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k))]


def distinct_features(words: list[bytes]) -> np.ndarray:
    return np.unique(np.array([f for w in set(words) for f in features_of(w)], dtype=np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Rows:
    """Presence features of rows: ``codes[starts[i]:starts[i + 1]]`` are the distinct feature codes of row i."""

    codes: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))


@dataclass
class Link:
    """One fitted model: selected feature codes with weights, weights of the earlier probabilities, and a bias."""

    codes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return self.bias + before @ self.earlier
        at = np.minimum(np.searchsorted(self.codes, rows.codes), len(self.codes) - 1)
        hit = self.codes[at] == rows.codes
        return self.bias + before @ self.earlier + np.bincount(rows.row_numbers()[hit], self.weights[at[hit]], minlength=len(rows))


def association(rows: Rows, target: np.ndarray, use: np.ndarray, n_codes: int) -> np.ndarray:
    """For every feature how far its share among the target's rows is from that among the others, in standard errors; 0 for features of fewer than 3 rows."""
    number = rows.row_numbers()
    used = use[number]
    both = np.bincount(rows.codes[used], minlength=n_codes).astype(float)
    ones = np.bincount(rows.codes[used], target[number[used]], minlength=n_codes)
    return standard_errors(both, ones, int(use.sum()), float(target[use].sum()))


def standard_errors(both: np.ndarray, ones: np.ndarray, n: int, positive: float) -> np.ndarray:
    """``association`` from counts: rows with each feature, the target's among them, all rows and all of the target's."""
    p1, p0 = (ones + 0.5) / (positive + 1), (both - ones + 0.5) / (n - positive + 1)
    z = np.log(p1 / p0) / np.sqrt(1 / (ones + 0.5) + 1 / (both - ones + 0.5))
    z[both < 3] = 0
    return z


def marker_counts(rows: Rows, target: np.ndarray, fold: np.ndarray, n_codes: int) -> np.ndarray:
    """For every row how many markers of the target it has, where markers come from the rows of other folds."""
    out = np.zeros(len(rows))
    number = rows.row_numbers()
    for f in np.unique(fold):
        use = fold != f
        if not 0 < target[use].sum() < use.sum():
            continue
        z = association(rows, target, use, n_codes)
        chosen = np.argsort(-z, kind="stable")[:MARKERS]
        marks = np.zeros(n_codes, dtype=bool)
        marks[chosen[z[chosen] > LEAST_Z]] = True
        counts = np.bincount(number[marks[rows.codes]], minlength=len(rows))
        out[~use] = counts[~use]
    return out


def category_target(category: Category, label: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """1 for the label's rows with enough markers (all of them without a quantile), else 0."""
    if category.quantile is None or not label.any():
        return label
    least = max(1.0, float(np.quantile(markers[label > 0], category.quantile)))
    return label * (markers >= least)


def fit_link(rows: Rows, before: np.ndarray, target: np.ndarray, use: np.ndarray, n_codes: int, features: int = FEATURES, l2: float = 0.05, steps: int = 200) -> Link:
    """A logistic model on the rows in ``use``: the features most associated with the target, then accelerated gradient steps."""
    n, positive = int(use.sum()), float(target[use].sum())
    prior = (positive + 0.5) / (n + 1.0)
    if not 0 < positive < n:
        return Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(np.log(prior / (1 - prior))))
    number = rows.row_numbers()
    used = use[number]
    z = np.abs(association(rows, target, use, n_codes))
    chosen = np.sort(np.argsort(-z, kind="stable")[:features])
    chosen = chosen[z[chosen] > 2.0]
    at = np.minimum(np.searchsorted(chosen, rows.codes), max(len(chosen) - 1, 0))
    keep = used & ((chosen[at] == rows.codes) if len(chosen) else np.zeros(len(used), bool))
    r, c = number[keep], at[keep]
    y, x_before, rows_used = target[use], before[use], np.flatnonzero(use)
    place = np.full(len(rows), -1)
    place[rows_used] = np.arange(n)
    r = place[r]
    w, v, b = np.zeros(len(chosen)), np.zeros(before.shape[1]), float(np.log(prior / (1 - prior)))
    # step sizes by the curvature of each coordinate, shared among the features of a row
    shared = np.maximum(np.bincount(r, minlength=n), 1) + before.shape[1] + 1
    curve_w = np.bincount(c, shared[r] * 0.25, minlength=len(chosen)) + l2
    curve_v = (x_before**2 * shared[:, None]).sum(axis=0) * 0.25 + l2
    curve_b = 0.25 * shared.sum()
    mw, mv, mb = w.copy(), v.copy(), b
    for step in range(steps):
        residual = sigmoid(b + x_before @ v + np.bincount(r, w[c], minlength=n)) - y
        nw = w - (np.bincount(c, residual[r], minlength=len(chosen)) + l2 * w) / curve_w
        nv = v - (x_before.T @ residual + l2 * v) / curve_v
        nb = b - residual.sum() / curve_b
        speed = step / (step + 3.0)
        w, v, b = nw + speed * (nw - mw), nv + speed * (nv - mv), nb + speed * (nb - mb)
        mw, mv, mb = nw, nv, nb
    return Link(chosen, mw, mv, float(mb))


@dataclass
class Chain:
    """The links in order; ``table`` maps a feature's hash to its row in the weights (features x categories)."""

    names: list[str]
    table: dict[int, int]
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def hits(self, text: bytes) -> list[int]:
        """Rows of the features that the text has, each once."""
        kept, found = self.kept, set()
        for word in set(words_of(text)):
            rows = kept.get(word)
            if rows is None:
                rows = tuple(k for f in features_of(word) if (k := self.table.get(f)) is not None)
                if len(kept) < KEPT_WORDS:
                    kept[word] = rows
            if rows:
                found.update(rows)
        return sorted(found)

    def probabilities(self, many: list[bytes]) -> np.ndarray:
        """Texts x categories, each category given the probabilities of those before it; texts without words have 0."""
        raw = np.array([self.weights[self.hits(t)].sum(axis=0) for t in many]).reshape(len(many), len(self.names))
        out = np.zeros_like(raw)
        for k in range(len(self.names)):
            out[:, k] = sigmoid(self.bias[k] + raw[:, k] + out[:, :k] @ self.earlier[k, :k])
        empty = np.array([not t.translate(ALNUM).strip() and not ascii_lower(t).translate(ALNUM).strip() for t in many], dtype=bool)
        out[empty] = 0.0
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}


def fit(features: list[np.ndarray], labels: np.ndarray, categories: Sequence[Category], columns: Sequence[str], folds: int = FOLDS) -> Chain:
    """A chain from rows of distinct feature hashes and their 0/1 labels (rows x columns), row i in fold i modulo ``folds``."""
    hashes, codes = np.unique(np.concatenate([np.zeros(0, np.int64), *features]), return_inverse=True)
    rows = Rows(codes, np.cumsum([0, *map(len, features)]))
    fold = np.arange(len(features)) % folds
    markers = {c: marker_counts(rows, labels[:, j], fold, len(hashes)) for j, c in enumerate(columns)}
    return fit_links(targets_of(categories, columns, labels, markers), fold, categories, folds, lambda k, f: (hashes, rows))


def targets_of(categories: Sequence[Category], columns: Sequence[str], labels: np.ndarray, markers: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x categories, each 0 or 1."""
    return np.array([category_target(c, labels[:, columns.index(c.label)], markers[c.label]) for c in categories]).T.reshape(len(labels), len(categories))


def fit_links(targets: np.ndarray, fold: np.ndarray, categories: Sequence[Category], folds: int, rows_for: Callable[[int, int | None], tuple[np.ndarray, Rows]]) -> Chain:
    """A chain for given targets.  ``rows_for(k, f)`` has feature hashes, ascending, and all rows by their numbers: those at
    least that category k can choose on the rows outside fold f (None: on all rows)."""
    n, k_all = targets.shape
    before = np.zeros((n, k_all))
    links: list[tuple[np.ndarray, Link]] = []
    for k in range(k_all):
        hashes, rows = rows_for(k, None)
        link = fit_link(rows, before[:, :k], targets[:, k], np.ones(n, bool), len(hashes))
        links.append((hashes[link.codes], link))
        for f in range(folds if k + 1 < k_all else 0):
            own = fold == f
            if own.all() or not own.any():
                continue
            hashes, rows = rows_for(k, f)
            before[own, k] = sigmoid(fit_link(rows, before[:, :k], targets[:, k], ~own, len(hashes)).logits(rows, before[:, :k]))[own]
    chosen = np.unique(np.concatenate([np.zeros(0, np.int64), *[codes for codes, _ in links]]))
    weights, earlier = np.zeros((len(chosen), k_all)), np.zeros((k_all, k_all))
    for k, (codes, link) in enumerate(links):
        weights[np.searchsorted(chosen, codes), k] = link.weights
        earlier[k, :k] = link.earlier
    return Chain([c.name for c in categories], dict(zip(chosen.tolist(), range(len(chosen)), strict=True)), weights, earlier, np.array([link.bias for _, link in links]))


class StoredRows:
    """The distinct features of the rows to learn from, in the shared folder (``row, features``).

    Features are counted and chosen by Spark; the driver gets the chosen ones and which of them a row has, so what it
    holds is bounded by the numbers of rows and of chosen features, whatever the lengths of texts.
    """

    def __init__(self, stored_rows: DataFrame, ids: np.ndarray, fold: np.ndarray, folds: int):
        """``ids``: the column ``row`` in the order of rows; ``fold``: the fold of each."""
        self.frame, self.folds, self.n, self.fold = stored_rows, folds, len(ids), fold
        self.order = np.argsort(ids)
        self.sorted_ids = ids[self.order]

    def places(self) -> Callable[[pa.Array], np.ndarray]:
        ids, order = self.sorted_ids, self.order
        return lambda column: order[np.searchsorted(ids, column.to_numpy())]

    def associations(self, targets: np.ndarray) -> DataFrame:
        """Stored: ``feature``, and z<k>_<f> for every target k and fold f that is left out (f = folds: none), as ``association`` has it."""
        place, fold, folds, k_all = self.places(), self.fold, self.folds, targets.shape[1]
        width = folds * (1 + k_all)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.repeat(place(batch.column(0)), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                hashes, codes = np.unique(batch.column(1).flatten().to_numpy(), return_inverse=True)
                out = np.zeros((width, len(hashes)), dtype=np.int64)
                for j in range(1 + k_all):
                    hit = np.ones(len(at), bool) if j == 0 else targets[at, j - 1] > 0
                    for f in range(folds):
                        out[j * folds + f] = np.bincount(codes[hit & (fold[at] == f)], minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), *[pa.array(x) for x in out]], names=["feature", *[f"c{i}" for i in range(width)]])

        uses = [*[fold != f for f in range(folds)], np.ones(self.n, bool)]
        sums = [(int(u.sum()), [float(targets[u, k].sum()) for k in range(k_all)]) for u in uses]
        names = [f"z{k}_{f}" for k in range(k_all) for f in range(folds + 1)]

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = np.array([batch.column(1 + i).to_numpy() for i in range(width)], dtype=float).reshape(1 + k_all, folds, batch.num_rows)
                z = []
                for k in range(k_all):
                    for f, (n, positive) in enumerate(sums):
                        others = np.arange(folds) != f
                        z.append(standard_errors(c[0, others].sum(axis=0), c[1 + k, others].sum(axis=0), n, positive[k]) if 0 < positive[k] < n else np.zeros(batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, z)], names=["feature", *names])

        counts = map_rows(self.frame, count, ", ".join(["feature long", *[f"c{i} long" for i in range(width)]]))
        counts = counts.groupBy("feature").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])
        often = counts.where(sum((F.col(f"c{i}") for i in range(folds)), F.lit(0)) >= 3)  # all others have z = 0
        return stored(map_rows(often, judge, ", ".join(["feature long", *[f"{x} double" for x in names]])), "toxicity-associations")

    def best(self, targets: np.ndarray, most: int, least: float, signed: bool) -> dict[tuple[int, int], np.ndarray]:
        """For every target and fold left out the features, ascending, of the ``most`` largest z (or sizes of z) over ``least``."""
        z = self.associations(targets)
        every = [(k, f) for k in range(targets.shape[1]) for f in range(self.folds + 1)]
        parts = []
        for i, (k, f) in enumerate(every):
            value = F.col(f"z{k}_{f}") if signed else F.abs(f"z{k}_{f}")
            parts.append(z.where(value > least).orderBy(value.desc(), "feature").limit(most).select(F.lit(i).alias("i"), "feature"))
        found = reduce(DataFrame.unionByName, parts).toArrow()  # at most ``most`` features for each target and fold
        drop_stored(z)
        i, feature = found["i"].to_numpy(), found["feature"].to_numpy()
        return {x: np.sort(feature[i == at]) for at, x in enumerate(every)}

    def marker_counts(self, labels: np.ndarray) -> np.ndarray:
        """Rows x labels: ``marker_counts`` of every label."""
        marks, place, fold, columns = self.best(labels, MARKERS, LEAST_Z, True), self.places(), self.fold, labels.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = fold[place(batch.column(0))].tolist()
                sets = [x.values.to_numpy() for x in batch.column(1)]
                counts = [[int(np.isin(marks[j, f], x).sum()) for j in range(columns)] for f, x in zip(own, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["row", "counts"])

        found = map_rows(self.frame, run, "row long, counts array<int>").toArrow()  # a few numbers a row
        out = np.zeros((self.n, columns))
        if self.n:
            out[self.places()(found["row"])] = np.array(found["counts"].to_pylist(), dtype=float).reshape(-1, columns)
        return out

    def hits(self, features: np.ndarray) -> Rows:
        """All rows with those of the given features (ascending) that they have, as numbers."""

        def own(x: np.ndarray) -> np.ndarray:
            if not len(x):
                return np.zeros(0, np.int16)
            return np.flatnonzero(x[np.minimum(np.searchsorted(x, features), len(x) - 1)] == features).astype(np.int16)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = [own(x.values.to_numpy()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int16()))], names=["row", "codes"])

        if not len(features):
            return Rows(np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64))
        found = map_rows(self.frame, run, "row long, codes array<short>").toArrow().combine_chunks()  # at most FEATURES numbers a row
        column = found["codes"].combine_chunks().take(pa.array(np.argsort(self.places()(found["row"]))))
        return Rows(column.flatten().to_numpy().astype(np.int64), np.cumsum([0, *column.value_lengths().to_pylist()]))


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: Sequence[Category] = CATEGORIES, train_rows: int = TRAIN_ROWS) -> Chain:
    """Fit on at most ``train_rows`` labelled ids (smallest hash of the id first).

    Rows with a null id or with a label other than 0 and 1 are not used; repeated labels of one id count as one, the
    larger, and of repeated documents of one id only that of the smallest text hash is learned from.  Features are counted
    and chosen by Spark, so ``train_rows`` and ``FEATURES`` bound what reaches the driver, whatever the lengths of texts.  Null and empty texts are rows without features.  Without usable rows the chain finds
    nothing toxic.
    """
    columns = sorted({c.label for c in categories})
    usable = labels.select(id_col, *[F.col(c).cast("int").alias(c) for c in columns]).where(F.col(id_col).isNotNull())
    for c in columns:
        usable = usable.where(F.col(c).isin(0, 1))
    chosen = usable.groupBy(id_col).agg(*[F.max(c).alias(c) for c in columns]).orderBy(*hash_order(id_col)).limit(train_rows)
    sample = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen.select(id_col, F.array(*columns).alias("_label"))), id_col)
    sample = one_row_an_id(sample, id_col, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [distinct_features(words_of(text)) for text in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.int64())), *batch.columns[1:]], names=["features", "label", "key", "row"])

    numbered = sample.select("_text", "_label", F.col(id_col).cast("string"), F.monotonically_increasing_id())
    rows = stored(map_rows(numbered, run, "features array<long>, label array<int>, key string, row long"), "toxicity-rows")
    found = rows.select("key", "row", "label").toArrow()  # one row for each of at most train_rows ids
    key, number, labelled = found["key"].to_pylist(), found["row"].to_numpy(), found["label"].to_pylist()
    order = sorted(range(len(key)), key=lambda k: (key[k], number[k]))  # the fit must not hang on the order of tasks
    labels = np.array([labelled[r] for r in order], dtype=float).reshape(len(order), len(columns))
    fold = np.arange(len(order)) % FOLDS
    source = StoredRows(rows.select("row", "features"), number[order], fold, FOLDS)
    marked = source.marker_counts(labels)
    targets = targets_of(categories, columns, labels, {c: marked[:, j] for j, c in enumerate(columns)})
    chosen = source.best(targets, FEATURES, 2.0, False)

    def rows_for(k: int, f: int | None) -> tuple[np.ndarray, Rows]:
        features = chosen[k, FOLDS if f is None else f]
        return features, source.hits(features)

    chain = fit_links(targets, fold, categories, FOLDS, rows_for)
    drop_stored(rows)
    return chain


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, p_<category> of each link, is_toxic (the last link's probability reaches the threshold).

    Null texts and texts without words have probabilities 0.  Repeated rows are repeated; other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(f"p_{n}", T.DoubleType()) for n in chain.names], T.StructField("is_toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= threshold)], names=schema.names)

    return map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not find toxic, all columns unchanged.

    Null and empty texts and texts without words stay, as do repeated rows each by itself; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(chain.probabilities(texts(batch.column(at)))[:, -1] < threshold))

    return map_rows(docs, run, docs.schema)

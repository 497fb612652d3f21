"""Centroid clustering with exponion search: bounds per vector, and balls around its current centroid.

Vectors keep their centroid, an upper bound of the distance to it and a lower bound of that to any other.  After the
centroids have moved, a vector whose bounds still prove its centroid the only nearest is not compared at all; any other looks
only at centroids within ``2 * upper + s`` of its own (s: distance from there to the next centroid), which are the first ones of
that centroid's sorted list of distances.  The radius is inclusive and grown by the rounding error, so that all centroids at
equal distance are seen and the smallest number wins.  Comparisons and centroids are exact integers.

A round is one pass: tasks read the vectors with their bounds, write them anew and add one row of sums for each cluster they
saw; the driver gets centroids x components sums.  Tables are written to the shared folder and the one before is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import drop_stored, map_rows, stored

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
#: Components lie below this, so that a squared distance of 64 of them is a 64-bit integer.
LARGEST = 1 << 27
#: Up to this, products of float64 are exact integers too.
EXACT = 1 << 22
#: Share by which bounds give way to rounding.
GIVE = 1e-11
#: Vectors that are compared together.
ROWS = 8192


@dataclass
class Centroids:
    """Centroids of one round with what the search needs: sorted distances among them and how far each has moved."""

    values: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        k = len(self.values)
        between = np.sqrt(np.array([squares(self.values, v) for v in self.values], dtype=np.float64).reshape(k, k))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        #: Distance to the next other centroid; a copy of a centroid is at 0.
        self.next = np.where(np.eye(k, dtype=bool), np.inf, between).min(axis=1)
        without = np.where(np.eye(k, dtype=bool), 0.0, self.moved[None, :])
        self.moved_others = without.max(axis=1)
        self.exact = np.abs(self.values).max(initial=0) <= EXACT
        self.as_float = self.values.astype(np.float64)
        self.norms = (self.as_float**2).sum(axis=1)


def squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to one centroid."""
    apart = x - centroid
    return (apart * apart).sum(axis=-1)


def distances(x: np.ndarray, model: Centroids, which: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of every vector to the centroids of these numbers."""
    if model.exact and np.abs(x).max(initial=0) <= EXACT:
        y = x.astype(np.float64)
        return ((y * y).sum(axis=1)[:, None] - 2 * (y @ model.as_float[which].T) + model.norms[which]).astype(np.int64)
    return np.stack([squares(x, model.values[j]) for j in which], axis=1)


def nearest(x: np.ndarray, model: Centroids, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of these (ascending) centroids, the distance to it and that to the second nearest."""
    found = distances(x, model, which)
    best, rows = found.argmin(axis=1), np.arange(len(x))  # the first of equal ones: the smallest number
    least = found[rows, best]
    found[rows, best] = np.iinfo(np.int64).max
    second = np.sqrt(found.min(axis=1).astype(np.float64)) if len(which) > 1 else np.full(len(x), np.inf)
    return which[best], np.sqrt(least.astype(np.float64)), second


def grown(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + GIVE) + GIVE


def search(x: np.ndarray, model: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds of vectors that had these for the centroids before they moved, and the number of comparisons."""
    cluster, upper = cluster.copy(), upper + model.moved[cluster]
    lower = lower * (1 - GIVE) - grown(model.moved_others[cluster])
    enough = np.maximum(lower, model.next[cluster] / 2)
    open_ = np.flatnonzero(~(grown(upper) < enough))
    compared = len(open_)
    if compared:
        upper[open_] = np.sqrt(((x[open_] - model.values[cluster[open_]]) ** 2).sum(axis=1).astype(np.float64))
        open_ = open_[~(grown(upper[open_]) < enough[open_])]
    for own in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == own]
        inside = np.searchsorted(model.sorted[own], grown(2 * upper[rows] + grown(model.next[own])), side="right")
        low = 0
        for width in [*(1 << b for b in range(1, len(model.values).bit_length())), len(model.values)]:  # balls of like size together
            some = (inside > low) & (inside <= width)
            if width > low and some.any():
                part = rows[some]
                which = np.sort(model.order[own, : inside[some].max()])
                cluster[part], upper[part], lower[part] = nearest(x[part], model, which)
                compared += len(part) * len(which)
            low = width
    return cluster, upper, lower, compared


def as_lists(values: np.ndarray, type_: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), type_))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Small batches together, ``rows`` rows or a little more at a time."""
    waiting, n = [], 0
    for b in batches:
        waiting, n = [*waiting, b], n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Id and integer vector ``vec`` (floor of ``scale`` times every component) of the rows that have a whole vector.

    Rows whose vector is null, of another length, or with a null or non-finite component go; so do those with an integer
    component of 2**27 or more, whose distances a long does not hold.
    """
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("vec", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            whole = rows.filter(pa.array(rows.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == components))
            flat = whole.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)  # nulls turn into NaN
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(flat * scale)
                fine = np.isfinite(flat).all(axis=1) & (np.abs(scaled) < LARGEST).all(axis=1)
            yield pa.RecordBatch.from_arrays([whole.column(0).filter(pa.array(fine)), as_lists(scaled[fine].astype(np.int32), pa.int32())], names=schema.names)

    return map_rows(vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>")), run, schema)


def first_centroids(kept: DataFrame, id_col: str, count: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order (equal ids: in the vectors' order); null ids are none."""
    rank = F.sha2(F.concat(F.lit("2:"), F.col(id_col).cast("string")), 256)
    rows = kept.where(F.col(id_col).isNotNull()).select(rank.alias("rank"), "vec").orderBy("rank", "vec").limit(count).collect()
    return np.array([r["vec"] for r in rows], dtype=np.int64)


def state_schema(id_type: T.DataType) -> T.StructType:
    """Vectors with their bounds, and (``n`` not null) sums of the vectors of a cluster in one task."""
    longs, ints = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
    return T.StructType([T.StructField("id", id_type), T.StructField("vec", ints), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("distance", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sums", longs)])


def one_pass(state: DataFrame, model: Centroids, id_type: T.DataType, fresh: bool) -> DataFrame:
    """Vectors with their new centroid and bounds, then what every task has summed; ``fresh`` vectors have no bounds yet."""
    schema = state_schema(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = model.values.shape
        sums, counts, inertia = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        id_arrow = None
        for rows in gathered(batches):
            ids = rows.column(0).combine_chunks()
            x = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.int64)
            if fresh:
                cluster, upper, lower = nearest(x, model, np.arange(k))
            else:
                cluster, upper, lower, _ = search(x, model, *[rows.column(i).to_numpy() for i in (2, 3, 4)])
            distance = ((x - model.values[cluster]) ** 2).sum(axis=1)
            by = np.argsort(cluster, kind="stable")
            there, starts = np.unique(cluster[by], return_index=True)
            sums[there] += np.add.reduceat(x[by], starts, axis=0)
            counts += np.bincount(cluster, minlength=k)
            inertia[there] += np.add.reduceat(distance[by], starts)
            n, id_arrow = len(x), ids.type
            yield pa.RecordBatch.from_arrays([ids, as_lists(x.astype(np.int32), pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=schema.names)
        seen = np.flatnonzero(counts)
        if len(seen):
            n = len(seen)
            empty = [pa.nulls(n, id_arrow), pa.nulls(n, pa.list_(pa.int32())), pa.array(seen, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(inertia[seen]), pa.array(counts[seen]), as_lists(sums[seen], pa.int64())], names=schema.names)

    return state.mapInArrow(run, schema)


def moved_centroids(state: DataFrame, model: Centroids) -> Centroids:
    """Every centroid at the exact floor of its vectors' mean; one without vectors stays."""
    parts = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    values = model.values.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        values[r["cluster"], r["at"]] = r["s"] // r["n"]
    return Centroids(values, np.sqrt(((values - model.values) ** 2).sum(axis=1).astype(np.float64)))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Id, cluster, squared distance, both inertias and the centroid's digest for every vector that ``kept_vectors`` keeps.

    Repeated rows are repeated, and may both be among the first centroids; with fewer vectors than centroids each is one.  A
    vector with a null id is assigned but never starts a centroid.  No vector, or only null ids, gives no rows.  Other
    columns are not read.
    """
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType
    state = kept_vectors(vectors, id_col, vector_col, components, scale)
    values = first_centroids(state, id_col, centroids)
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not len(values):
        return spark.createDataFrame([], schema)
    model, before = Centroids(values, np.zeros(len(values))), None
    for n in range(rounds + 1):
        fresh = state if before is None else before.where("n is null").select("id", "vec", "cluster", "upper", "lower")
        now = stored(one_pass(fresh, model, id_type, before is None), "clusters")
        if before is not None:
            drop_stored(before)
        before = now
        if n < rounds:
            model = moved_centroids(now, model)
    own = before.where("n is not null").groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    total = sum(r["inertia"] for r in own)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in model.values.tolist()]
    figures = spark.createDataFrame([(r["cluster"], r["inertia"], total, digests[r["cluster"]]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = before.where("n is null").select(F.col("id").alias(id_col), "cluster", "distance")
    return found.join(F.broadcast(figures), "cluster").select(*schema.names)  # a row for each centroid


def cluster_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE) -> str:
    """The same in DuckDB, by comparing every vector with every centroid."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS num, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v AS c FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {centroids})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT num, vec_id, v, j, c, {apart} AS d FROM kept, c{r})")
        steps.append(f"a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY num ORDER BY d, j) = 1)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT j, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({components})) AS pos FROM a{r}) GROUP BY j, pos)")
            steps.append(f"m{r} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{r} GROUP BY j)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON o.j = m.j)")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds}"""

"""Lexical, semantic and fused ranking.

Texts without an index are read whole (``postings`` has the inverted index).  Corpus figures (number of items, mean length)
are one row, which is joined by broadcast.  Top-k keeps k rows a task before the last one merges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stratica.functions.text import words

K1, B, RRF_K = 1.2, 0.75, 60


def bm25(items: DataFrame, key: str, text: str | Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Scores of all items that have a term: the usual formula with k1 = 1.2, b = 0.75 and idf at least 1e-6.

    ``text`` is a column or several (title, text, names of attachments), which count as one.  Texts are read and split once:
    their term frequencies and lengths, a few numbers an item, are dealt by key, and both the corpus figures and the scores
    are taken from there.
    """
    columns = [text] if isinstance(text, str) else list(text)
    split = words(F.concat_ws(" ", *columns) if len(columns) > 1 else F.col(columns[0]))
    # what is left without a term tells how often it was there
    counts = lambda w: F.struct(F.size(w).alias("_len"), *[(F.size(w) - F.size(F.array_remove(w, t))).alias(f"_tf{k}") for k, t in enumerate(terms)])
    sized = items.select(key, F.transform(F.array(split), counts)[0].alias("_c")).select(key, "_c.*").repartition(key)
    figures = sized.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count(F.when(F.col(f"_tf{k}") > 0, 1)).alias(f"_df{k}") for k in range(len(terms))])
    return scored(sized, figures, key, len(terms))


def scored(sized: DataFrame, figures: DataFrame, key: str, n_terms: int) -> DataFrame:
    """BM25 of the items that have a term, from term frequencies and lengths and the one row of corpus figures."""
    score = F.lit(0.0)
    for k in range(n_terms):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    # every part is above 0; a filter on frequencies, or one that nulls do not pass, would go below the exchange, which is then not used twice
    found = sized.join(F.broadcast(figures)).select(key, score.alias("score"))  # figures: one row
    return found.where(F.coalesce(F.col("score") > 0, F.lit(False)))


def cosine(vectors: DataFrame, key: str, embedding: str, query: Sequence[float]) -> DataFrame:
    """Cosine similarity with a query vector; null for vectors of length 0, which are like nothing."""
    q = F.array(*[F.lit(float(x)) for x in query])
    e = F.transform(embedding, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(e, q, lambda a, b: a * b))
    return vectors.select(key, F.try_divide(F.try_divide(dot, F.sqrt(total(F.transform(e, lambda x: x * x)))), F.sqrt(total(F.transform(q, lambda x: x * x)))).alias("score"))


def top_k(scored: DataFrame, k: int, score: str, key: str) -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def fused(lists: Sequence[DataFrame], key: str, score: str = "score") -> DataFrame:
    """Reciprocal-rank fusion of top-k lists: the sum of 1 / (60 + rank)."""
    place = F.row_number().over(Window.orderBy(F.desc(score), key))
    ranked = [x.select(key, (1.0 / (RRF_K + place)).alias("_part")) for x in lists]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.unionByName(other)
    return out.groupBy(key).agg(F.sum("_part").alias("score"))


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page in the order (only offset + size rows reach the last task)."""
    return rows.orderBy(*order).offset(offset).limit(size)


def matching(items: DataFrame, text: str, wanted: str) -> DataFrame:
    """Items that a search text matches: every quoted phrase word by word, and one of the loose words if there are any."""
    import re

    split = lambda s: re.findall(r"[^\W]+", s.lower())
    phrases = [p for p in map(split, re.findall(r'"([^"]*)"', wanted)) if p]
    loose = split(re.sub(r'"[^"]*"', " ", wanted))
    if not phrases and not loose:
        return items.where(F.lit(False))
    line = F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" "))
    hit = F.lit(True)
    for p in phrases:
        hit = hit & line.contains(f" {' '.join(p)} ")
    if loose:
        any_word = F.lit(False)
        for w in loose:
            any_word = any_word | line.contains(f" {w} ")
        hit = hit & any_word
    return items.where(hit)


def similar_to(vectors: DataFrame, key: str, embedding: str, item: int | str, k: int) -> DataFrame:
    """The k items most like a stored one (none if it is unknown); its vector is one row."""
    own = vectors.where(F.col(key) == F.lit(item)).select(F.transform(embedding, lambda x: x.cast("double")).alias("_q")).limit(1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rest = vectors.where(F.col(key) != F.lit(item)).select(key, F.transform(embedding, lambda x: x.cast("double")).alias("_e"))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    scored = rest.join(F.broadcast(own)).select(key, F.round(F.try_divide(F.try_divide(total(F.zip_with("_e", "_q", lambda a, b: a * b)), norm("_e")), norm("_q")), 9).alias("score"))
    return top_k(scored.where("score is not null"), k, "score", key)


#: Queries that are compared in one pass, as one matrix that every task gets.
QUERIES = 4096


def cosine_many(vectors: DataFrame, key: str, embedding: str, queries: DataFrame, query: str, k: int, together: int = QUERIES) -> DataFrame:
    """(query, key, score): the k vectors most like each of many queries (``query``, ``embedding``), exactly; scores have 9 decimals, ties go to the smaller key.

    An Arrow batch is one matrix that meets ``together`` queries in one product.  A task keeps k a query, and these meet by query,
    so what is shuffled is tasks x queries x k rows.  Queries are dealt into blocks of that size by hash, one pass over the vectors
    each.  Null and zero vectors are like nothing; fewer than k vectors are all returned.
    """
    n = max(1, -(-queries.count() // together))
    out = None
    for block in range(n):
        rows = queries.where(F.pmod(F.xxhash64(query), F.lit(n)) == block).select(query, F.col(embedding).cast("array<double>")).collect() if n > 1 else queries.select(query, F.col(embedding).cast("array<double>")).collect()
        rows = [r for r in rows if r[1] is not None]
        if rows or (out is None and block == n - 1):
            own = _best_of_block(vectors, key, embedding, rows, queries.schema[query].dataType, query, k)
            out = own if out is None else out.unionByName(own)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return out.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _best_of_block(vectors: DataFrame, key: str, embedding: str, rows: list, query_type: T.DataType, query: str, k: int) -> DataFrame:
    schema = T.StructType([T.StructField(query, query_type), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    names = [r[0] for r in rows]

    def unit(m: np.ndarray) -> np.ndarray:
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unit(np.array([r[1] for r in rows], dtype=np.float64)).T if rows else np.zeros((0, 0))
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=object))] * len(rows)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), len(wanted)), False)) if rows else batch.slice(0, 0)
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            found = np.round(unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) @ wanted, 9)
            for q in range(len(rows)):
                scores = found[:, q]
                some = np.flatnonzero(~np.isnan(scores))
                if len(some) > k:  # all that are not below the k-th, equal ones too
                    some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
                if len(best[q][0]) == k:
                    some = some[scores[some] >= best[q][0][-1]]
                if len(some):
                    both, names_ = np.concatenate([best[q][0], scores[some]]), np.concatenate([best[q][1], keys[some]])
                    order = sorted(range(len(both)), key=lambda i: (-both[i], names_[i]))[:k]
                    best[q] = both[order], names_[order]
        sizes = [len(b[0]) for b in best]
        columns = [[n for n, size in zip(names, sizes, strict=True) for _ in range(size)], [x for b in best for x in b[1].tolist()], [x for b in best for x in b[0].tolist()]]
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return vectors.where(F.col(key).isNotNull()).select(key, F.col(embedding).cast("array<double>")).mapInArrow(run, schema)


def similar_items(vectors: DataFrame, key: str, item: str, embedding: str, wanted: DataFrame, k: int) -> DataFrame:
    """(query, item, key, score): for each chunk of ``wanted`` (``key``) the k other items most like it, one hit for each item, that of its best chunk.

    3 k chunks are ranked for k items, as chunks of one item lie close together.
    """
    asked = vectors.join(wanted.select(key), key, "left_semi").select(F.col(key).alias("query"), embedding)
    home = vectors.select(F.col(key).alias("query"), F.col(item).alias("_home"))
    near = cosine_many(vectors, key, embedding, asked, "query", 3 * k).join(vectors.select(key, item), key).join(home, "query").where(F.col(item) != F.col("_home"))
    best = near.withColumn("_place", F.row_number().over(Window.partitionBy("query", item).orderBy(F.desc("score"), key))).where("_place = 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return best.withColumn("_place", place).where(F.col("_place") <= k).select("query", item, key, "score")


def passages(hits: DataFrame, key: str, score: str, label: str, text: str, k: int, size: int = 2000) -> DataFrame:
    """The k best hits as numbered passages: ``[n] label`` and the head of the text, which is the feature's limit on an answer."""
    best = top_k(hits, k, score, key).withColumn("n", F.row_number().over(Window.orderBy(F.desc(score), key)))  # k rows
    return best.select("n", key, F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col(label), F.lit("\n"), F.left(F.col(text), F.lit(size))).alias("passage"))

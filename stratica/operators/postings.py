"""An inverted index that searches read: postings with positions by term, in segments that are merged on read.

A posting is (term, key, seg, tf, len, positions); ``len`` stands in every row, so a search needs no table of lengths.
Postings are written in ranges of terms, and a query's terms reach the scan as a filter, so it reads the row groups of its terms
alone.  Corpus figures are sums that every change adds to or takes from: (term, df) and (n, total).  They belong to the
whole index, whatever a search is narrowed by.  A replaced or removed row stays in its segment and is named in ``deleted``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratica.functions.text import words
from stratica.operators.rank import K1, B

#: Where the positions of the next column begin, so that no phrase runs from one into it.
COLUMN = 1 << 24
TABLES = ("postings", "terms", "figures", "deleted")


@dataclass(frozen=True)
class Index:
    """The four tables of an index, all their segments."""

    postings: DataFrame
    terms: DataFrame
    figures: DataFrame
    deleted: DataFrame


def placed(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, term, at) of every word of every row, columns one after the other ``COLUMN`` positions apart."""

    def of(column: str, first: int) -> Column:
        return F.transform(words(F.coalesce(F.col(column), F.lit(""))), lambda w, i: F.struct(w.alias("term"), (i + first).alias("at")))

    return rows.select(key, F.concat(*[of(c, n * COLUMN) for n, c in enumerate(columns)]).alias("_t"))


def frequencies(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(term, key, tf, len, positions); a hot term is dealt by its rows' keys too."""
    sized = placed(rows, key, columns).select(key, F.size("_t").alias("len"), F.explode("_t").alias("_w"))
    return sized.groupBy(F.col("_w.term").alias("term"), key).agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"), F.sort_array(F.collect_list("_w.at")).alias("positions"))


def counted(rows: DataFrame, key: str, columns: Sequence[str], sign: int) -> tuple[DataFrame, DataFrame]:
    """(term, df) and the one row (n, total) of these rows, added or taken away."""
    own = placed(rows, key, columns)
    terms = own.select(F.explode(F.array_distinct(F.transform("_t", lambda t: t["term"]))).alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df"))
    return terms, own.agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum(F.size("_t")), F.lit(0))).alias("total"))


def segment(new: DataFrame, seg: int, key: str = "cid", columns: Sequence[str] = ("title", "text", "att"), old: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a change adds: postings of ``new`` rows, and what ``old`` rows, which are replaced or go, take away.

    Keys are one to a row; ``seg`` is larger than that of any segment before.
    """
    found = frequencies(new, key, columns).select("term", key, F.lit(seg).cast("long").alias("seg"), "tf", "len", "positions")
    terms, figures = counted(new, key, columns, 1)
    deleted = new.where("false").select(key, F.lit(seg).cast("long").alias("seg"))
    if old is not None:
        fewer, less = counted(old, key, columns, -1)
        terms = terms.unionByName(fewer).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        figures = figures.unionByName(less).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        deleted = old.select(key, F.lit(seg).cast("long").alias("seg"))
    return {"postings": found.repartitionByRange("term", key).sortWithinPartitions("term", key), "terms": terms.repartitionByRange("term").sortWithinPartitions("term"), "figures": figures, "deleted": deleted}


def read_words(wanted: str) -> tuple[list[list[str]], list[str]]:
    """The quoted phrases, as words, and the loose words of a search text."""
    split = lambda s: re.findall(r"[^\W]+", s.lower())
    return [p for p in map(split, re.findall(r'"([^"]*)"', wanted)) if p], split(re.sub(r'"[^"]*"', " ", wanted))


def scores(index: Index, wanted: str, key: str = "cid") -> DataFrame:
    """(key, score) of the rows that a search text matches: every phrase word by word, and one of the loose words if there are any.

    BM25 over all of its words, with the figures of the whole index.
    """
    phrases, loose = read_words(wanted)
    terms = sorted({w for p in phrases for w in p} | set(loose))
    none = index.postings.where("false").select(key, F.lit(0.0).alias("score"))
    if not terms:
        return none
    asked = F.col("term").isin(terms)
    figures = index.figures.agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("n")).alias("_avg"))
    df = index.terms.where(asked).groupBy("term").agg(F.sum("df").alias("_df"))
    idf = F.greatest(F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
    own = index.postings.where(asked).join(F.broadcast(df.join(F.broadcast(figures)).select("term", idf.alias("_idf"), "_avg")), "term")  # a row for each word of the search
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
    inside = {w: F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"_p{k}") for k, w in enumerate(terms) if any(w in p and len(p) > 1 for p in phrases)}
    single = {p[0] for p in phrases if len(p) == 1}
    hits = own.groupBy(key, "seg").agg(F.sum(part).alias("score"), F.max(F.col("term").isin(loose)).alias("_loose"), F.count_if(F.col("term").isin(*single) if single else F.lit(False)).alias("_single"), *inside.values())
    hits = hits.where((F.col("_single") == len(single)) & (F.col("_loose") if loose else F.lit(True)))
    for p in phrases:
        if len(p) > 1:
            hits = hits.where(F.coalesce(in_a_row([F.col(f"_p{terms.index(w)}") for w in p]), F.lit(False)))
    gone = index.deleted.groupBy(key).agg(F.max("seg").alias("_gone"))
    return hits.join(gone, key, "left").where("_gone is null or seg >= _gone").select(key, "score")


def in_a_row(places: Sequence[Column]) -> Column:
    """Whether the first word has a place that the others follow, each at the next."""

    def followed(x: Column) -> Column:
        out = F.lit(True)
        for n, others in enumerate(places[1:], 1):
            out = out & F.array_contains(others, x + n)
        return out

    return F.exists(places[0], followed)

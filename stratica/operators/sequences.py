"""Order-dependent operators: dedupe, last write, version pairs, context, budgets, as-of, longest prefix, diffs and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_place = 1").drop("_place")


def collapse_threads(hits: DataFrame, thread: str, order: list[Column]) -> DataFrame:
    """The first hit of each thread and how many more it has."""
    own = Window.partitionBy(thread)
    return hits.withColumn("_place", F.row_number().over(own.orderBy(*order))).withColumn("more", F.count("*").over(own) - 1).where("_place = 1").drop("_place")


def context(rows: DataFrame, by: str, position: str, hit: Column, before: int, after: int) -> DataFrame:
    """Rows within ``before`` and ``after`` positions of a hit of the same group."""
    spread = Window.partitionBy(by).orderBy(position).rangeBetween(-after, before)
    return rows.withColumn("_near", F.max(hit.cast("int")).over(spread)).where("_near = 1").drop("_near")


def within_budget(rows: DataFrame, by: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs stay within the budget."""
    running = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_cost", running).where(F.col("_cost") <= budget).drop("_cost")


def as_of(facts: DataFrame, key: str, ts: str, value: str, moment: str) -> DataFrame:
    """Each key's latest value at a moment; ties by the larger value."""
    return facts.where(F.col(ts) <= F.lit(moment).cast("timestamp_ntz")).groupBy(key).agg(F.max(F.struct(ts, value)).alias("_last")).select(key, F.col("_last")[value].alias(value))


def longest_prefix(paths: DataFrame, path: str, units: DataFrame, unit: str) -> DataFrame:
    """The deepest unit that is an ancestor of each path: ancestors are exploded, so the join is by equality."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = paths.select(path, F.explode(ancestors).alias(unit))
    return exploded.join(units.select(unit).distinct(), unit).groupBy(path).agg(F.max_by(unit, F.length(unit)).alias(unit))


def manifest_diff(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """reused, changed, new or vanished for every key of either side."""
    both = old.select(key, F.col(signature).alias("_a"), F.lit(1).alias("_old")).join(new.select(key, F.col(signature).alias("_b"), F.lit(1).alias("_new")), key, "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "vanished").when(F.col("_a").eqNullSafe(F.col("_b")), "reused").otherwise("changed")
    return both.select(key, state.alias("state"))


def upsert(base: DataFrame, changes: DataFrame, key: str, number: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key; the rest stays.

    Of several changes of a key the last by ``number`` counts (without one, or with equal ones, the largest row).
    """
    rest = [c for c in changes.columns if c != key]
    order = ([number] if number else []) + [c for c in rest if c != number]
    last = changes.groupBy(key).agg(F.max(F.struct(*order)).alias("_l")).select(key, *[F.col("_l")[c].alias(c) for c in rest])
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def repeat_dates(first: Column, every: str, count: int) -> Column:
    """Dates of a daily, weekly or monthly rule; a day that a month lacks becomes its last day."""
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    step = {"daily": lambda n: F.date_add(first, n), "weekly": lambda n: F.date_add(first, n * 7), "monthly": lambda n: F.add_months(first, n)}[every]
    return F.transform(steps, step)

"""Change feeds against what is known: plans, tombstones, merges and partial updates, each by joins on the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(feed: DataFrame, key: str, number: str) -> DataFrame:
    """The last entry of each id, the largest of several with one number.  Maxima are taken before the shuffle, so a hot id is no burden."""
    rest = [number, *[c for c in feed.columns if c not in (key, number)]]
    return feed.groupBy(key).agg(F.max(F.struct(*rest)).alias("_l")).select(key, "_l.*")


def drive_plan(feed: DataFrame, inventory: DataFrame, number: str = "nr") -> DataFrame:
    """(id, action) for every id of a feed (``nr, id, rel, size, ctag, is_deleted, is_folder``) against the inventory (``id, rel, size, ctag``).

    Deleted: tombstone if known, else nothing; folders: tree; known under another path: move; same tag and size: skip; else load.
    """
    joined = last_wins(feed, "id", number).join(inventory.select("id", F.struct("rel", "size", "ctag").alias("_k")), "id", "left")
    known = F.col("_k").isNotNull()
    action = (
        F.when(F.col("is_deleted"), F.when(known, "tombstone").otherwise("nothing"))
        .when(F.col("is_folder"), "tree")
        .when(known & (F.col("_k.rel") != F.col("rel")), "move")
        .when(known & F.col("_k.ctag").eqNullSafe(F.col("ctag")) & F.col("_k.size").eqNullSafe(F.col("size")), "skip")
        .otherwise("load")
    )
    return joined.select("id", action.alias("action"))


def settle(marks: DataFrame, alive: DataFrame, gone: DataFrame, key: str, since: Column) -> DataFrame:
    """Tombstones after a clean round: the living lose theirs, old ones stay, each newly gone key gets one."""
    kept = marks.join(alive.select(key), key, "left_anti")
    fresh = gone.select(key).distinct().join(alive.select(key), key, "left_anti").join(marks.select(key), key, "left_anti")
    return kept.select(key, "since").unionByName(fresh.select(key, since.alias("since")))


def suspects(known: DataFrame, seen: DataFrame, listed: DataFrame, key: str, folder: str, message_id: str) -> DataFrame:
    """Known items that a fully listed folder no longer has and whose message id appears nowhere else."""
    absent = known.join(listed.select(folder).distinct(), folder, "left_semi").join(seen.select(key), key, "left_anti")
    return absent.join(seen.select(message_id).where(F.col(message_id).isNotNull()), message_id, "left_anti").select(key)


def merge_messages(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Store (``id, body, modified, deleted, earlier``) with a batch (``id, body, modified, deleted``) merged in.

    An edit keeps the replaced text in ``earlier``; a deletion keeps the body; older changes are ignored; nothing is removed.
    """
    s, c = store.select("id", F.struct("body", "modified", "deleted", "earlier").alias("_s")), changes.select("id", F.struct("body", "modified", "deleted").alias("_c"))
    both = s.join(c, "id", "full_outer")
    old, new = (lambda x: F.col(f"_s.{x}")), (lambda x: F.col(f"_c.{x}"))
    empty = F.array().cast("array<string>")
    fresh = F.col("_c").isNotNull() & (F.col("_s").isNull() | (new("modified") > old("modified")))
    edited = fresh & F.col("_s").isNotNull() & new("deleted").isNull() & ~new("body").eqNullSafe(old("body"))
    body = F.when(F.col("_s").isNull(), new("body")).when(edited, new("body")).otherwise(old("body"))
    earlier = F.when(edited & old("body").isNotNull(), F.concat(F.coalesce(old("earlier"), empty), F.array(old("body")))).otherwise(F.coalesce(old("earlier"), empty))
    return both.select("id", body.alias("body"), F.when(fresh, new("modified")).otherwise(old("modified")).alias("modified"), F.when(fresh, F.coalesce(new("deleted"), old("deleted"))).otherwise(old("deleted")).alias("deleted"), earlier.alias("earlier"))


def fold_fields(feed: DataFrame, key: str, number: str, removed: str, fields: str) -> DataFrame:
    """(key, field, value) after a feed of partial updates (``fields`` is a map): only fields that an entry names change.

    A named null is a value, an absent field is not.  A removal drops what stood before it.
    """
    gone = feed.where(F.col(removed)).groupBy(key).agg(F.max(number).alias("_gone"))
    named = feed.where(~F.col(removed)).select(key, number, F.explode(fields).alias("field", "value"))
    alive = named.join(gone, key, "left").where(F.col("_gone").isNull() | (F.col(number) > F.col("_gone")))
    return alive.groupBy(key, "field").agg(F.max_by(F.struct("value"), F.struct(number, "value")).alias("_v")).select(key, "field", F.col("_v.value").alias("value"))


def unanswered(items: DataFrame, verdicts: DataFrame, key: str, version: str) -> DataFrame:
    """Items without a verdict for this very version."""
    return items.join(verdicts.select(key, version), [key, version], "left_anti")


def reuse_chunks(chunks: DataFrame, states: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Chunks of reused files (``states`` from a manifest difference), each with today's tombstone."""
    kept = chunks.join(states.where("state = 'reused'").select(key), key, "left_semi").drop("gone")
    return kept.join(tombstones.select(key, F.col("since").alias("gone")), key, "left")


def newer_than(feed: DataFrame, marks: DataFrame, unit: str, modified: str) -> DataFrame:
    """Rows newer than their unit's stored high-water mark; units without one are read whole."""
    return feed.join(marks.select(unit, F.col("mark").alias("_mark")), unit, "left").where(F.col("_mark").isNull() | (F.col(modified) > F.col("_mark"))).drop("_mark")


def cadence_due(last: Column, cadence: Column, now: Column) -> Column:
    """Whether a unit is due again, with a minute of slack; never fetched or ``always`` is due."""
    period = F.when(cadence == "daily", 1).when(cadence == "weekly", 7).when(cadence == "monthly", 30) * 86400
    return last.isNull() | F.coalesce(now.cast("timestamp").cast("long") - last.cast("timestamp").cast("long") >= period - 60, F.lit(True))

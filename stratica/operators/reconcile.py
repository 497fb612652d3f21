"""Bookkeeping against what is there, and rounds of mirrors against what they know: joins that sort every entry into one state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratica.functions.times import ancestors


def disk_check(known: DataFrame, disk: DataFrame, tombstones: DataFrame, lost: DataFrame) -> DataFrame:
    """(rel, state) of every path of the bookkeeping, the disk or the tombstones.

    Known files are consistent, incomplete (another size than recorded), missing, or noted as lost; files that nobody knows
    are foreign unless a tombstone names them (kept); a tombstone without its file is lost or noted.  ``known`` and ``disk``
    have rel and size (a null recorded size means presence alone), ``tombstones`` and ``lost`` have rel.
    """
    side = lambda df, name: df.select("rel", F.struct("size").alias(name))
    mark = lambda df, name: df.select("rel").distinct().withColumn(name, F.lit(True))
    rows = side(known, "_k").join(side(disk, "_d"), "rel", "full_outer").join(mark(tombstones, "_t"), "rel", "full_outer").join(mark(lost, "_l"), "rel", "left")
    there = F.col("_d").isNotNull()
    state = (
        F.when(F.col("_k").isNotNull() & ~there, F.when(F.col("_l"), "noted").otherwise("missing"))
        .when(F.col("_k").isNotNull(), F.when(F.col("_k.size").isNotNull() & ~F.col("_k.size").eqNullSafe(F.col("_d.size")), "incomplete").otherwise("consistent"))
        .when(F.col("_t") & there, "kept")
        .when(F.col("_t"), F.when(F.col("_l"), "noted").otherwise("lost"))
        .otherwise("foreign")
    )
    return rows.select("rel", state.alias("state"))


def permanent(marks: DataFrame, disk: DataFrame) -> DataFrame:
    """(name, state): items that no run asks for again, refused or gone, unless a copy lies here or the mark is quiet.  ``marks``: rel, unit, name, kind, quiet."""
    own = marks.where(~F.coalesce("quiet", F.lit(False))).join(disk.select("rel"), "rel", "left_anti")
    said = F.coalesce("name", F.lit("?"))
    name = F.coalesce("rel", F.when(F.coalesce("unit", F.lit("")) != "", F.concat_ws(": ", "unit", said)).otherwise(said))
    return own.select(name.alias("name"), F.when(F.col("kind") == "refused", "refused").otherwise("gone").alias("state"))


def completeness(catalogue: DataFrame, reports: DataFrame) -> DataFrame:
    """Every source of the catalogue with its latest report (``state`` and ``at``), or ``never_checked``."""
    last = reports.groupBy("source").agg(F.max(F.struct("at", "state")).alias("_r"))
    return catalogue.join(last, "source", "left").select("source", F.coalesce("_r.state", F.lit("never_checked")).alias("state"), F.col("_r.at").alias("at"))


def tree_merge(known: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """The folder tree after a feed: changed folders replace the known, removed ones go."""
    fresh = changed.join(removed.select(key), key, "left_anti")
    return known.join(changed.select(key), key, "left_anti").join(removed.select(key), key, "left_anti").unionByName(fresh)


def tree_diff(old: DataFrame, new: DataFrame, key: str = "id", path: str = "path") -> DataFrame:
    """(id, kind): new, vanished or renamed folders between two trees; nothing is new where there was no tree yet."""
    had = old.limit(1).agg(F.count("*").alias("_had"))
    both = old.select(key, F.col(path).alias("_a"), F.lit(1).alias("_o")).join(new.select(key, F.col(path).alias("_b"), F.lit(1).alias("_n")), key, "full_outer").join(F.broadcast(had))
    kind = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "vanished").when(~F.col("_a").eqNullSafe(F.col("_b")), "renamed")
    return both.where("_had > 0").select(key, kind.alias("kind")).where("kind is not null")


def waiting(entries: DataFrame, held: DataFrame, due: DataFrame, unit: str = "unit", key: str = "id", number: str = "nr") -> tuple[DataFrame, DataFrame]:
    """(to do, to hold): entries of due units with those held for them, the feed's version before the held one, and all others, which wait."""
    now = entries.unionByName(held.join(entries.select(key), key, "left_anti"))
    return now.join(due.select(unit), unit, "left_semi"), now.join(due.select(unit), unit, "left_anti")


def mail_round(marks: DataFrame, known: DataFrame, seen: DataFrame, listed: DataFrame, reported: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(healed, fresh): marks that are taken back, and ids that get one, after a round over folders.

    Marks of mails that are seen again heal.  Known mails that a wholly listed folder lacks, and those reported as removed,
    are suspects, except where their message id reappeared elsewhere; only those that the service does not find are gone.
    ``known`` and ``seen``: id, folder, message_id.
    """
    healed = marks.join(seen.select("id"), "id", "left_semi").select("id")
    absent = known.join(listed.select("folder").distinct(), "folder", "left_semi").join(seen.select("id"), "id", "left_anti")
    named = known.join(reported.select("id"), "id", "left_semi").join(seen.select("id"), "id", "left_anti")
    suspects = absent.select("id", "message_id").unionByName(named.select("id", "message_id")).distinct()
    moved = seen.where("message_id is not null").select("message_id").distinct()
    lost = suspects.join(moved, "message_id", "left_anti").join(verdicts.where("status = 404").select("id"), "id", "left_semi")
    return healed, lost.join(marks.select("id"), "id", "left_anti").select("id")


def item_round(items: DataFrame, known: DataFrame, files: DataFrame, verdicts: DataFrame, stamp: str = "etag") -> DataFrame:
    """(id, action) for every item of a listing: ``skip`` what is current and has its file, ``verdict`` what was answered for this very version, ``rename`` what moved, else ``load``.

    ``items`` and ``known``: id, rel, the stamp; ``files``: rel; ``verdicts``: id, the stamp.
    """
    rows = items.join(known.select("id", F.struct("rel", stamp, F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted") if "deleted" in known.columns else F.lit(False).alias("deleted")).alias("_k")), "id", "left")
    rows = rows.join(files.select(F.col("rel").alias("_file")).distinct(), F.col("_k.rel") == F.col("_file"), "left").join(verdicts.select("id", F.col(stamp).alias("_said")).distinct().withColumn("_v", F.lit(True)), ["id"], "left")
    same = F.col("_k").isNotNull() & F.col(f"_k.{stamp}").eqNullSafe(F.col(stamp)) & ~F.col("_k.deleted")
    moved = F.col("_k").isNotNull() & (F.col("_k.rel") != F.col("rel"))
    answered = F.col("_v") & F.col("_said").eqNullSafe(F.col(stamp))
    action = F.when(same & F.col("_file").isNotNull() & ~moved, "skip").when(answered, "verdict").when(same & moved & F.col("_file").isNotNull(), "rename").otherwise("load")
    rank = F.when(action == "skip", 0).when(action == "verdict", 1).when(action == "rename", 2).otherwise(3)
    return rows.groupBy("id").agg(F.min_by(action, rank).alias("action"))


def gone_in_clean_units(known: DataFrame, listed: DataFrame, clean: DataFrame, unit: str = "unit") -> DataFrame:
    """(id): known items that are no longer listed, below units alone whose listing was complete."""
    return known.join(clean.select(unit).distinct(), unit, "left_semi").join(listed.select("id"), "id", "left_anti").select("id")


def absent_or_removed(known: DataFrame, listed: DataFrame, removed: DataFrame, complete: bool) -> DataFrame:
    """(id): what a task list lost: what it names as removed always, what it does not name only after a complete read."""
    named = known.join(removed.select("id"), "id", "left_semi").select("id")
    if not complete:
        return named.distinct()
    return named.unionByName(known.join(listed.select("id"), "id", "left_anti").select("id")).distinct()


def board_merge(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(id, place, kind): the tasks of a board in the order of its listing: new, changed, or unchanged although they were read again."""
    both = new.join(old.select("id", F.struct(*fields).alias("_old")), "id", "left")
    kind = F.when(F.col("_old").isNull(), "new").when(F.struct(*fields).eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return both.select("id", "place", kind.alias("kind"))


def next_cutoff(pending: DataFrame, start: str, last: str = "last_activity") -> DataFrame:
    """One row: how far back the next listing of chats must go: a day before this one started, and a second before the oldest that is unsettled."""
    first = F.lit(start).cast("timestamp_ntz") - F.expr("interval 1 day")
    return pending.agg(F.least(first, F.min(F.col(last)) - F.expr("interval 1 second")).alias("cutoff"))


def prefix_cover(paths: DataFrame, path: str) -> DataFrame:
    """The fewest folders that cover all of the paths: one below another goes."""
    own = paths.select(path).distinct()
    above = own.select(path, F.explode(ancestors(F.col(path))).alias("_up")).where(F.col("_up") != F.col(path))
    covered = above.join(own.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
    return own.join(covered, path, "left_anti")


def cadences(units: DataFrame, named: DataFrame, ranks: tuple[str, ...] = ("always", "daily", "weekly", "monthly"), path: str = "unit") -> DataFrame:
    """(unit, cadence): that of the deepest named folder on each unit's path, the more frequent of several there; ``always`` without one."""
    order = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("cadence"))
    table = named.withColumn("_rank", order)
    up = units.select(path, F.explode(ancestors(F.col(path))).alias("_up"))
    best = up.join(table.select(F.col("folder").alias("_up"), "cadence", "_rank"), "_up").groupBy(path).agg(F.min_by("cadence", F.struct(-F.length("_up"), "_rank")).alias("cadence"))
    return units.select(path).distinct().join(best, path, "left").select(path, F.coalesce("cadence", F.lit(ranks[0])).alias("cadence"))


def conversation_states(listed: DataFrame, recorded: DataFrame, excluded: Column) -> DataFrame:
    """(id, state) of every conversation that is listed or recorded: here, open (no record, or a preview newer than it), excluded by the rules, or kept though no longer listed.

    ``listed``: id, preview_at; ``recorded``: id, activity; ``excluded`` is a condition on the listing.
    """
    rows = listed.withColumn("_out", F.coalesce(excluded, F.lit(False))).join(recorded.select("id", F.lit(True).alias("_rec"), "activity"), "id", "full_outer")
    state = (
        F.when(F.col("_out").isNull(), "kept").when(F.col("_out") & F.col("_rec").isNull(), "excluded")
        .when(F.col("_rec").isNull() | F.coalesce(F.col("preview_at") > F.col("activity"), F.lit(False)), "open").otherwise("here")
    )
    return rows.select("id", state.alias("state"))


def balance_with_bytes(expected: DataFrame, states: DataFrame, unit: str, key: str, size: str) -> DataFrame:
    """(unit, state, n, bytes): items and bytes of every state in each folder; a key without a state is open."""
    return expected.join(states.select(key, "state"), key, "left").groupBy(unit, F.coalesce("state", F.lit("open")).alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def decremented(balance: DataFrame, fetched: DataFrame, unit: str) -> DataFrame:
    """The balance after a targeted fetch (unit, n fetched): open goes down, here up; folders with nothing open any more leave it."""
    rows = balance.join(fetched.groupBy(unit).agg(F.sum("n").alias("_n")), unit, "left")
    n = F.least(F.coalesce("_n", F.lit(0)), F.col("open"))
    return rows.withColumns({"here": F.col("here") + n, "open": F.col("open") - n}).where("open > 0").drop("_n")


def contacts_round(feed: DataFrame, known: DataFrame) -> DataFrame:
    """(id, kind): contacts of a round: new, updated, unchanged, or removed, which keeps its file."""
    rows = feed.join(known.select("id", F.col("modified").alias("_old")), "id", "left")
    kind = F.when(F.coalesce("removed", F.lit(False)), "removed").when(F.col("_old").isNull(), "new").when(F.col("modified") > F.col("_old"), "updated").otherwise("unchanged")
    return rows.select("id", kind.alias("kind"))


def threads_to_read(replies: DataFrame, threads: DataFrame, since: str, full: bool) -> DataFrame:
    """Threads of a channel that are read again: those with activity since a moment, or all in a full pass, as a feed never names replies."""
    if full:
        return threads.select("root_id")
    return threads.where(F.col("last_activity") >= F.lit(since).cast("timestamp_ntz")).select("root_id").unionByName(replies.select("root_id")).distinct()


def in_reading_order(messages: DataFrame, root: str = "root_id", key: str = "id", ts: str = "ts") -> DataFrame:
    """Messages with ``root_ts`` and ``orphan``, by which (then ts, id) a channel reads: posts in order, replies under theirs, replies without a post last."""
    posts = messages.where(F.col(root).isNull()).select(F.col(key).alias("_root"), F.col(ts).alias("_root_ts"))
    rows = messages.withColumn("_root", F.coalesce(root, key)).join(posts, "_root", "left")
    return rows.withColumns({"orphan": F.col("_root_ts").isNull(), "root_ts": F.coalesce("_root_ts", ts), "is_reply": F.col(root).isNotNull()}).drop("_root", "_root_ts")


def folder_states(listed: DataFrame, recorded: DataFrame, excluded: Column, unit: str = "folder", key: str = "id", master: str | None = None) -> DataFrame:
    """(unit, state, n): items of every folder that are here, open (listed and not recorded), excluded by the rules, or kept though no longer listed.

    With ``master`` the dates of a series count once, by it.
    """
    own = F.coalesce(master, key) if master else F.col(key)
    there = listed.select(F.col(unit), own.alias("_id"), F.coalesce(excluded, F.lit(False)).alias("_out")).groupBy(unit, "_id").agg(F.min("_out").alias("_out"))
    known = recorded.select(F.col(unit), F.col(key).alias("_id"), F.lit(True).alias("_rec")).distinct()
    rows = there.join(known, [unit, "_id"], "full_outer")
    state = F.when(F.col("_out").isNull(), "kept").when(F.col("_rec"), "here").when(F.col("_out"), "excluded").otherwise("open")
    return rows.groupBy(unit, state.alias("state")).agg(F.count("*").alias("n"))


def facts_to_read(files: DataFrame, facts: DataFrame, version: int) -> DataFrame:
    """Files (rel, mtime, size) whose facts are not known for this content and this version of the reader; those of files that are gone are not asked for."""
    known = facts.where(F.col("version") == version).select("rel", "mtime", "size")
    return files.join(known, ["rel", "mtime", "size"], "left_anti")

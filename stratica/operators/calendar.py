"""Calendars: the best mail of each appointment, appointments that mails alone still know, changes between two captures, rounds of a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratica.functions.times import plain_uid, without_status

#: How well a mail of a method describes its appointment.
METHOD_RANK = {"REQUEST": 4, "PUBLISH": 3, "CANCEL": 2, "COUNTER": 1, "REPLY": 0}


def minute(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 60_000_000)


def best_invites(invites: DataFrame) -> DataFrame:
    """(uid, recid, best, cancel): of the mails of each date the best, and the best that cancels it (null without one).

    ``invites``: uid, recid, method, status, seq, dtstart, summary, mail_ts.  A start counts most, then the method, the
    sequence and the mail's time.  Maxima are taken before the shuffle.
    """
    ranks = F.create_map(*[F.lit(x) for pair in METHOD_RANK.items() for x in pair])
    rank = F.struct(F.col("dtstart").isNotNull().cast("int").alias("has"), F.coalesce(ranks[F.col("method")], F.lit(0)).alias("method"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("mail_ts", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), F.col("summary").alias("tie"))
    one = F.struct("method", "status", "seq", "dtstart", "summary", "mail_ts")
    cancels = (F.col("method") == "CANCEL") | (F.col("status") == "cancelled")
    keyed = invites.withColumns({"uid": plain_uid(F.col("uid")), "recid": F.coalesce("recid", F.lit("")), "_rank": rank})
    return keyed.groupBy("uid", "recid").agg(F.max_by(one, "_rank").alias("best"), F.max_by(one, F.when(cancels, F.col("_rank"))).alias("cancel"))


def cancelled_by_mail(invites: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar entries (all columns) with ``st`` set to cancelled where a mail cancels the appointment, or this date of a series by its slot."""
    best = best_invites(invites).where("cancel is not null")
    whole = best.where("recid = ''").select(F.col("uid").alias("_uid")).distinct().withColumn("_whole", F.lit(True))
    dates = best.where("recid <> ''").select(F.col("uid").alias("_uid"), minute(F.to_timestamp_ntz(F.col("recid"), F.lit("yyyyMMdd'T'HHmmss"))).alias("_minute")).distinct().withColumn("_date", F.lit(True))
    rows = calendar.withColumns({"_uid": plain_uid(F.col("uid")), "_own": minute(F.col("ts")), "_slot": minute(F.col("rts"))})
    hit = rows.join(whole, "_uid", "left")
    own = dates.select("_uid", F.col("_minute").alias("_own"), F.col("_date").alias("_by_own"))
    slot = dates.select("_uid", F.col("_minute").alias("_slot"), F.col("_date").alias("_by_slot"))
    hit = hit.join(own, ["_uid", "_own"], "left").join(slot, ["_uid", "_slot"], "left")
    found = F.when(F.col("_whole") & (F.col("st") != "cancelled"), "cancelled").when((F.col("_by_own") | F.col("_by_slot")) & ~F.col("st").isin("cancelled", "removed"), "cancelled").otherwise(F.col("st"))
    return hit.withColumn("st", found).select(*calendar.columns)


def reconstructed(invites: DataFrame, calendar: DataFrame) -> DataFrame:
    """(uid, recid, ts, title, state): appointments that only mails know: ``deleted`` where one cancels it, else ``gone``.

    Of an appointment that the calendar has, only a cancelled date that it lacks counts.  Without a start there is no place
    in the calendar, and an entry of the same title and minute is the same appointment under another id.
    """
    best = best_invites(invites)
    known = calendar.where(F.col("uid").isNotNull()).select(plain_uid(F.col("uid")).alias("uid")).distinct().withColumn("_known", F.lit(True))
    minutes = calendar.select(plain_uid(F.col("uid")).alias("uid"), F.explode(F.array("ts", "rts")).alias("_ts")).where("_ts is not null").select("uid", minute(F.col("_ts")).alias("_minute")).distinct().withColumn("_there", F.lit(True))
    same = calendar.where("ts is not null").select(F.lower(F.trim("title")).alias("_title"), minute(F.col("ts")).alias("_start")).distinct()
    dated = best.withColumn("_minute", minute(F.to_timestamp_ntz(F.nullif(F.col("recid"), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))))
    rows = dated.join(known, "uid", "left").join(minutes, ["uid", "_minute"], "left")
    wanted = F.col("_known").isNull() | ((F.col("recid") != "") & F.col("cancel").isNotNull() & F.col("_there").isNull())
    told = F.coalesce("cancel", "best")
    ghosts = rows.where(wanted).select("uid", "recid", told.alias("_it"), F.when(F.col("cancel").isNotNull(), "deleted").otherwise("gone").alias("state")).where("_it.dtstart is not null")
    placed = ghosts.select("uid", "recid", F.col("_it.dtstart").alias("ts"), without_status(F.col("_it.summary")).alias("title"), "state")
    return placed.withColumns({"_title": F.lower("title"), "_start": minute(F.col("ts"))}).join(same, ["_title", "_start"], "left_anti").select("uid", "recid", "ts", "title", "state")


def calendar_changes(old: DataFrame, new: DataFrame, made: str = "by_rule") -> DataFrame:
    """One row (changed, removed): entries of the new capture that the old lacks, and the other way, by their whole content.

    Entries that a rule makes move with the window: those that are only in the old one are not removed.
    """
    columns = sorted(old.columns)
    sign = lambda df: df.select(F.sha1(F.to_json(F.struct(*columns))).alias("_sign"), F.coalesce(made, F.lit(False)).alias("_made"))
    a, b = sign(old), sign(new)
    changed = b.join(a, "_sign", "left_anti").agg(F.count("*").alias("changed"))
    removed = a.where(~F.col("_made")).join(b, "_sign", "left_anti").agg(F.count("*").alias("removed"))
    return changed.join(F.broadcast(removed))  # one row each


def masters_of_round(feed: DataFrame) -> DataFrame:
    """(id, modified, series): what a round of a calendar view names: dates of a series by its master with the newest stamp, single events by themselves."""
    series = F.col("type").isin("occurrence", "exception")
    return feed.where("removed is null or not removed").groupBy(F.when(series, F.col("master_id")).otherwise(F.col("id")).alias("id")).agg(F.max("modified").alias("modified"), F.max(series).alias("series"))


def to_read_again(masters: DataFrame, known: DataFrame, due: Column) -> DataFrame:
    """Ids of a round that are new, changed since their stored stamp, or due anyway."""
    return masters.join(known.select("id", F.col("modified").alias("_old")), "id", "left").where(F.col("_old").isNull() | (F.col("modified") > F.col("_old")) | due).select("id")


def vanished(known: DataFrame, seen: DataFrame, dates: DataFrame, verdicts: DataFrame, first: str, last: str) -> DataFrame:
    """(id): known appointments inside the days, by their start or a date of their series, that a full round did not see and that the service says are gone."""
    inside = lambda c: (c >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (c <= F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))
    dated = dates.where(inside(F.col("ts"))).select("id").distinct().withColumn("_date", F.lit(True))
    suspects = known.join(seen.select("id"), "id", "left_anti").join(dated, "id", "left").where(F.coalesce(inside(F.col("ts")), F.lit(False)) | F.col("_date"))
    return suspects.join(verdicts.where("status = 404").select("id"), "id", "left_semi").select("id")


def series_round(dates: DataFrame, taken: DataFrame, exceptions: DataFrame, listed: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(dates, taken, exceptions, due) of a book of series after a round of a calendar view.

    ``dates`` (occ, master, orig) are the known dates, ``taken`` (master, orig) those that were taken out, ``exceptions``
    (master, orig, sub) those that differ from their series.  ``listed`` (occ, master, orig, type, cancelled, sub) are what the
    view shows, ``removed`` (occ) what it took out.  A date that is listed with another original start means that its whole
    series moved: what was taken out moves by the same time, as it is not listed.  ``due`` are the masters to be written anew.
    """
    key = ["master", "orig"]
    old = dates.select("occ", F.col("master").alias("_master"), F.col("orig").alias("_orig"))
    rows = listed.where("orig is not null").join(old, "occ", "left")
    moved = rows.where(F.col("_orig").isNotNull() & (F.col("_orig") != F.col("orig")))
    delta = moved.groupBy("master").agg(F.min_by(F.unix_micros(F.col("orig").cast("timestamp")) - F.unix_micros(F.col("_orig").cast("timestamp")), "occ").alias("_delta"))
    before = moved.select("master", F.col("_orig").alias("orig")).distinct()
    gone = removed.select("occ").join(old, "occ").select("occ", F.col("_master").alias("master"), F.col("_orig").alias("orig"))
    shifted = taken.join(before, key, "left_anti").join(delta, "master", "left").withColumn("orig", F.timestamp_micros(F.unix_micros(F.col("orig").cast("timestamp")) + F.coalesce("_delta", F.lit(0))).cast("timestamp_ntz")).select(*key)
    shown = rows.select(*key).distinct()
    now_taken = shifted.join(shown, key, "left_anti").unionByName(gone.where("orig is not null").select(*key)).distinct()
    differs = (F.col("type") == "exception") | F.coalesce("cancelled", F.lit(False))
    fresh = rows.where(differs).groupBy(*key).agg(F.min("sub").alias("sub"))
    kept = exceptions.join(before, key, "left_anti").join(shown, key, "left_anti").join(gone.select(*key), key, "left_anti")
    now_exceptions = kept.select(*key, "sub").unionByName(fresh)
    now_dates = dates.join(rows.select("occ"), "occ", "left_anti").join(removed.select("occ"), "occ", "left_anti").select("occ", *key).unionByName(rows.select("occ", *key))
    changed_dates = rows.where(F.col("_orig").isNull() | (F.col("_orig") != F.col("orig"))).select("master")
    back = taken.join(shown, key, "left_semi").select("master")
    as_was = exceptions.select(*key, "sub")
    changed_exceptions = fresh.join(as_was, [*key, "sub"], "left_anti").select("master").unionByName(as_was.join(rows.where(~differs).select(*key), key, "left_semi").select("master"))
    due = changed_dates.unionByName(gone.select("master")).unionByName(back).unionByName(changed_exceptions).distinct()
    return now_dates, now_taken, now_exceptions, due


def dates_the_rule_makes(taken: DataFrame, series: DataFrame, horizon: str) -> DataFrame:
    """(master, orig): of the dates taken out those that the series' rule makes; for others an exception date would say nothing.  ``series``: master, start, rrule, tz."""
    from stratica.operators.recurrence import expand

    made = expand(series.select("master", "start", "rrule", "tz"), horizon).select("master", F.col("wall").alias("orig"))
    return taken.join(made, ["master", "orig"], "left_semi")


ENTRY = ("uid", "ts", "rts", "te", "title", "st", "cal", "place")


def calendar_written(base: str, entries: DataFrame, since: str, horizon: str) -> dict[str, int]:
    """Write the calendar (``ENTRY`` columns and ``by_rule``) with its window into a store, and count what is new or changed and what is gone.

    An entry is its whole content: one that was there before is unchanged, any other is changed.  Dates that a rule makes count
    only inside the window that both calendars share, as the window moves with the day; all counts are of distinct entries.
    """
    from stratica.sources import store

    spark = entries.sparkSession
    before, window = store.read_table(spark, base, "calendar"), store.read_table(spark, base, "calendar_window")
    old_window = window.first() if before is not None and window is not None else None
    first, last = (since, horizon) if old_window is None else (max(since, old_window["since"]), min(horizon, old_window["horizon"]))
    signed = lambda df: df.select("by_rule", "ts", F.to_json(F.struct(*ENTRY)).alias("_sig")).groupBy("_sig").agg(F.max("by_rule").alias("by_rule"), F.min("ts").alias("ts"))
    shared = F.col("ts").isNull() | F.col("ts").between(F.lit(f"{first} 00:00:00").cast("timestamp_ntz"), F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))
    counts = ~F.coalesce("by_rule", F.lit(False)) | shared
    made = {"calendar": store.stage(base, "calendar", entries.select(*ENTRY, "by_rule")), "calendar_window": store.stage(base, "calendar_window", spark.createDataFrame([(since, horizon)], "since string, horizon string"))}
    now = signed(store.staged(spark, base, made["calendar"]))
    if before is None:
        changed, removed = now.where(counts).count(), 0
    else:
        was = signed(before)
        changed, removed = (a.join(b.select("_sig"), "_sig", "left_anti").where(counts).count() for a, b in ((now, was), (was, now)))
    store.change(spark, base, lambda info: info | {"tables": {**info["tables"], **made}})
    return {"changed": changed, "removed": removed}

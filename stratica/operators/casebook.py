"""Cases: members, removals, new hits, folded search history, missing parts of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratica.operators.facets import DAY, time_bucket


def add_items(items: DataFrame, new: DataFrame, cases: DataFrame, added: str = "added") -> DataFrame:
    """Members after adding: the first add of a (case, key) wins and closed cases take none."""
    key = ["case_id", "key"]
    first = new.groupBy(*key).agg(F.min(added).alias(added))
    allowed = first.join(cases.where("status <> 'closed'").select(F.col("id").alias("case_id")), "case_id", "left_semi")
    return items.select(*key, added).unionByName(allowed.join(items.select(*key), key, "left_anti").select(*key, added))


def collect_new(hits: DataFrame, members: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Hits that the case neither has nor had removed."""
    return hits.join(members.select(key), key, "left_anti").join(removed.select(key), key, "left_anti")


def membership(hits: DataFrame, items: DataFrame, cases: DataFrame) -> DataFrame:
    """(key, cases): the names of the cases that hold each hit, open ones first, comma-joined."""
    named = items.join(cases.select(F.col("id").alias("case_id"), "name", "status"), "case_id").join(hits.select("key").distinct(), "key", "left_semi")
    ordered = F.array_sort(F.collect_set(F.struct((F.col("status") == "closed").alias("closed"), "name")))
    return named.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ", ").alias("cases"))


def fold_history(history: DataFrame, by: str, order: list[Column], criteria: str, ts: str | None = None, bucket_seconds: int = DAY) -> DataFrame:
    """Repeats of the same criteria in a row become one row, the latest.

    With ``ts``, the time that the order begins with, a key's rows are dealt by buckets of time, and only the first and the last row of
    each bucket meet those of the key's other buckets.
    """
    bucket = F.lit(0) if ts is None else time_bucket(F.unix_micros(F.col(ts).cast("timestamp")), bucket_seconds)
    own = Window.partitionBy(by, "_bucket").orderBy(*order)
    marked = history.withColumn("_bucket", bucket).withColumns({"_next": F.lead(criteria).over(own), "_last": F.lead(F.lit(1)).over(own).isNull(), "_first": F.lag(F.lit(1)).over(own).isNull()})
    all_ = Window.partitionBy(by).orderBy(F.asc_nulls_first("_bucket"), *order)  # two rows a bucket at most
    border = marked.where("_last or _first").withColumns({"_next": F.lead(criteria).over(all_), "_end": F.lead(F.lit(1)).over(all_).isNull()}).where("_last")
    inside = marked.where("not _last").withColumn("_end", F.lit(False))
    return inside.unionByName(border).where(F.col("_end") | ~F.col("_next").eqNullSafe(F.col(criteria))).drop("_bucket", "_next", "_last", "_first", "_end")


def thread_gap(items: DataFrame, messages: DataFrame, key: str, thread: str) -> DataFrame:
    """(thread, has, lacks) for each conversation of which the case has a message."""
    marked = messages.join(items.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return marked.groupBy(thread).agg(F.count("_in").alias("has"), (F.count("*") - F.count("_in")).alias("lacks")).where("has > 0")


def version_pairs(rows: DataFrame, by: str, order: list[Column], value: str) -> DataFrame:
    """Each version with the one before it."""
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(by).orderBy(*order))).where("before is not null")


def distinct_versions(rows: DataFrame, by: str, order: list[str], value: str, key: str) -> DataFrame:
    """The first row of every value of a group (its columns ``key`` and ``value``), ``back`` counting from the newest (0)."""
    first = rows.groupBy(by, value).agg(F.min(F.struct(*order, key)).alias("_first"))
    newest = Window.partitionBy(by).orderBy(F.desc("_first"))
    return first.select(by, value, F.col("_first")[key].alias(key), (F.row_number().over(newest) - 1).cast("long").alias("back"))


def rate(rows: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """How many rows of the same group the last ``seconds`` hold, this one included; none (0) for rows without a time.

    A group's rows are dealt by buckets of time eight times as long; what the next bucket looks back on is carried into it.
    """
    long = 8 * seconds
    bucket = time_bucket(F.col("_us"), long)
    timed = rows.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    late = F.col("_us") >= (bucket + 1) * (long * 1_000_000) - seconds * 1_000_000
    spread = timed.withColumn("_b", F.explode(F.when(F.coalesce(late, F.lit(False)), F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own"))))))
    own = Window.partitionBy(by, "_b.b").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return spread.withColumn("n", F.count("_us").over(own)).where("_b.own").drop("_us", "_b")


def month_gaps(items: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, after, before, months): runs of months without items between two that have some."""
    months = items.where(F.col(ts).isNotNull()).select(by, F.trunc(ts, "month").alias("m")).distinct()
    pairs = months.withColumn("_p", F.lag("m").over(Window.partitionBy(by).orderBy("m")))
    empty = (F.months_between("m", "_p") - 1).cast("long")
    return pairs.where(empty > 0).select(by, F.date_format("_p", "yyyy-MM").alias("after"), F.date_format("m", "yyyy-MM").alias("before"), empty.alias("months"))


def in_window_or_dates(items: DataFrame, key: str, within: Column, dates: DataFrame, date_within: Column) -> DataFrame:
    """Items inside a window by their own time or by one of their series' dates."""
    found = dates.where(date_within).select(key).distinct().withColumn("_date", F.lit(True))
    return items.join(found, key, "left").where(F.coalesce(within, F.lit(False)) | F.col("_date")).drop("_date")


def balance(expected: DataFrame, states: DataFrame, unit: str, key: str) -> DataFrame:
    """Per unit: expected = here + waiting + refused + gone + open; a key without a state is open."""
    joined = expected.join(states.select(key, "state"), key, "left")
    counts = [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("here", "waiting", "refused", "gone")]
    return joined.groupBy(unit).agg(F.count("*").alias("expected"), *counts, F.count(F.when(F.col("state").isNull(), 1)).alias("open"))


def book_state(events: DataFrame, key: list[str], number: str = "nr") -> DataFrame:
    """The state of things that events create, rename, close, open, note, move and delete: one row for each that is not deleted.

    ``events``: the key, nr, op, value.  Each property is the last value of its own events after the last deletion, so the
    fold is a set of maxima and needs no order of rows.  Columns: name, status (open without an event), folder, remark.
    """
    gone = events.where("op = 'delete'").groupBy(*key).agg(F.max(number).alias("_gone"))
    alive = events.join(gone, key, "left").where(F.col("_gone").isNull() | (F.col(number) > F.col("_gone"))).where("op <> 'delete'")
    last = lambda *ops: F.max_by(F.struct("op", "value"), F.when(F.col("op").isin(*ops), F.col(number)))
    found = alive.groupBy(*key).agg(F.count(F.when(F.col("op") == "create", 1)).alias("_made"), last("create", "rename").alias("_name"), last("close", "open").alias("_status"), last("move").alias("_folder"), last("remark").alias("_remark"))
    return found.where("_made > 0").select(*key, F.col("_name.value").alias("name"), F.when(F.col("_status.op") == "close", "closed").otherwise("open").alias("status"), F.col("_folder.value").alias("folder"), F.col("_remark.value").alias("remark"))


def without_folders(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Members whose folder no longer exists are unsorted."""
    known = folders.select("case_id", F.col("folder_id").alias("folder"), F.lit(True).alias("_there"))
    return items.join(known, ["case_id", "folder"], "left").withColumn("folder", F.when(F.col("_there"), F.col("folder"))).drop("_there")


def removals(removed: DataFrame, taken_out: DataFrame, added_by_hand: DataFrame) -> DataFrame:
    """(case_id, key): removal marks after taking out and adding: taking out sets a mark, adding by hand clears it."""
    key = ["case_id", "key"]
    return removed.select(*key).unionByName(taken_out.select(*key)).distinct().join(added_by_hand.select(*key), key, "left_anti")


def decorated_searches(searches: DataFrame, cases: DataFrame, folders: DataFrame) -> DataFrame:
    """Saved searches with the names of their case and folder, where they have one."""
    named = cases.select(F.col("id").alias("case_id"), F.col("name").alias("case_name"), "status")
    return searches.join(named, "case_id", "left").join(folders.select("case_id", "folder_id", F.col("name").alias("folder_name")), ["case_id", "folder_id"], "left")


def automatic_searches(searches: DataFrame, cases: DataFrame) -> DataFrame:
    """Searches that file by themselves: marked so, by text, and of an open case."""
    return searches.where("automatic and mode = 'text'").join(cases.where("status <> 'closed'").select(F.col("id").alias("case_id")), "case_id", "left_semi")


def collected(hits: DataFrame, members: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members to add, report) of automatic searches: each hit (search_id, case_id, key) is already there, skipped as once removed, or new."""
    key = ["case_id", "key"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    rows = hits.where("key is not null").join(mark(members, "_in"), key, "left").join(mark(removed, "_out"), key, "left")
    state = F.when(F.col("_in"), "already").when(F.col("_out"), "skipped").otherwise("new")
    judged = rows.withColumn("state", state)
    counts = [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("new", "skipped", "already")]
    return judged.where("state = 'new'").groupBy(*key).agg(F.min("search_id").alias("search_id")), judged.groupBy("search_id").agg(F.count("*").alias("hits"), *counts)


def pulled_thread(items: DataFrame, messages: DataFrame, removed: DataFrame) -> DataFrame:
    """(case_id, key, folder): messages of the conversations of which a case has one, each into that one's folder (the smallest of several)."""
    have = items.join(messages.select("key", "thread"), "key").groupBy("case_id", "thread").agg(F.min("folder").alias("folder"))
    wanted = messages.join(have, "thread").select("case_id", "key", "folder")
    return wanted.join(items.select("case_id", "key"), ["case_id", "key"], "left_anti").join(removed.select("case_id", "key"), ["case_id", "key"], "left_anti")


def kept_history(history: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    """What retention keeps: rows of the last days; 30.44 days are a month."""
    return history.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def snapshot(hits: DataFrame, list_id: str, criteria: str, at: str) -> DataFrame:
    """A result list: the hits of a search at one moment, with its criteria."""
    return hits.select(F.lit(list_id).alias("list_id"), F.lit(criteria).alias("criteria"), F.lit(at).cast("timestamp_ntz").alias("at"), "key")


def case_summary(cases: DataFrame, items: DataFrame, index: DataFrame, notes: DataFrame, searches: DataFrame) -> DataFrame:
    """One row a case: items, those that the index no longer has, notes, searches, first and last date."""
    rows = items.join(index.select("key", "ts", F.lit(True).alias("_there")), "key", "left")
    counts = rows.groupBy("case_id").agg(F.count("*").alias("items"), F.count(F.when(F.col("_there").isNull(), 1)).alias("not_in_index"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    of = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    joined = cases.select(F.col("id").alias("case_id"), "name", "status").join(counts, "case_id", "left").join(of(notes, "notes"), "case_id", "left").join(of(searches, "searches"), "case_id", "left")
    return joined.fillna(0, ["items", "not_in_index", "notes", "searches"])


def ordered_cases(cases: DataFrame, changed: str = "changed") -> DataFrame:
    """Cases as they are listed: open ones first, the last changed first."""
    return cases.orderBy(F.col("status") == "closed", F.desc(changed), "id")


def case_timeline(items: DataFrame, index: DataFrame, notes: DataFrame) -> DataFrame:
    """(case_id, month, ts, kind, key, text): what an export lists, items by their date in the index and notes by theirs, without a date under ``-``.

    To be ordered by case, month (``-`` last), ts, kind and key.
    """
    told = items.join(index.select("key", "ts", "title"), "key", "left").select("case_id", "ts", F.lit("item").alias("kind"), "key", F.coalesce("title", F.lit("(not in index)")).alias("text"))
    said = notes.where(F.trim("text") != "").select("case_id", "ts", F.lit("note").alias("kind"), F.col("note_id").cast("string").alias("key"), "text")
    rows = told.unionByName(said)
    return rows.select("case_id", F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("-")).alias("month"), "ts", "kind", "key", "text")


def items_csv(timeline: DataFrame, folder: str) -> None:
    """The list of a case's items as CSV files with a header, for spreadsheets."""
    timeline.where("kind = 'item'").select("case_id", "month", "key", "text").write.mode("overwrite").option("header", "true").partitionBy("case_id").csv(folder)


def casebook_lines(timeline: DataFrame) -> DataFrame:
    """(case_id, month, place, line) of a case book as text, to be ordered by these: a heading for each month, then its items and notes."""
    headings = timeline.select("case_id", "month").distinct().select("case_id", "month", F.lit("").alias("place"), F.concat(F.lit("## "), F.when(F.col("month") == "-", "undated").otherwise(F.col("month"))).alias("line"))
    mark = F.when(F.col("kind") == "note", "> ").otherwise("* ")
    place = F.concat_ws(" ", F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("-")), "kind", "key")
    return headings.unionByName(timeline.select("case_id", "month", place.alias("place"), F.concat(mark, F.regexp_replace("text", r"\s+", " ")).alias("line")))


def case_manifest(items: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, key, rel, sha256, size, state): what each case holds as files, ``missing`` where none is there any more."""
    rows = items.join(files.select("key", "rel", "sha256", "size"), "key", "left")
    return rows.select("case_id", "key", "rel", "sha256", "size", F.when(F.col("sha256").isNull(), "missing").otherwise("here").alias("state"))


def notes_after(notes: DataFrame, changes: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, touched): dated notes after changes, and the cases that these touch with the time of the last.

    ``notes``: id, case_id, at, text, origin; ``changes``: nr, op (add, change, delete), id, case_id, at, text, origin.  The last
    change of a note counts; closed or unknown cases and empty texts are refused; a change or deletion of a note that the case does not have
    changes nothing.  A changed note keeps its time and origin.
    """
    clean = changes.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    allowed = clean.where("op = 'delete' or text <> ''").join(cases.where("status <> 'closed'").select(F.col("id").alias("case_id")), "case_id", "left_semi")
    # what is added exists from then on, so changes of a note are taken in order: its first word gives time and origin, its last the text
    old = notes.select("id", "case_id", F.lit(-1).cast("long").alias("nr"), F.lit("add").alias("op"), "at", "text", "origin")
    all_ = old.unionByName(allowed.select("id", "case_id", F.col("nr").cast("long").alias("nr"), "op", "at", "text", "origin"))
    made = all_.groupBy("id", "case_id").agg(F.min(F.when(F.col("op") == "add", F.struct("nr", "at", "origin"))).alias("_a"), F.max(F.struct("nr", "op", "at", "text")).alias("_l"), F.min(F.when(F.col("op") == "delete", F.col("nr"))).alias("_gone"))
    known = made.where("_a is not null")
    left = known.where("_gone is null or _gone < _a.nr").select("id", "case_id", F.col("_a.at").alias("at"), F.col("_l.text").alias("text"), F.col("_a.origin").alias("origin"))
    touched = known.where("_l.nr >= 0").groupBy("case_id").agg(F.max("_l.at").alias("changed"))
    return left, touched


def collect_sums(report: DataFrame) -> DataFrame:
    """One row: what a run over all automatic searches has brought: new, skipped, already there, and searches that failed."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0))
    return report.agg(*[total(c).alias(c) for c in ("new", "skipped", "already")], F.count("error").alias("errors"))

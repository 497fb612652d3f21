"""Counts, timelines, gaps and people over items.  Aggregations are partial before they shuffle; windows run on their small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of the buckets of time by which one key's rows are dealt to tasks.
DAY = 86_400


def count_by(items: DataFrame, by: str, key: str) -> DataFrame:
    return items.groupBy(by).agg(F.countDistinct(key).alias("n"))


def timeline(items: DataFrame, ts: str) -> DataFrame:
    """Items a month (``YYYY-MM``); items without a time are left out."""
    return items.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def dense_months(items: DataFrame, ts: str) -> DataFrame:
    """The timeline with a row for every month between the first and the last."""
    known = timeline(items, ts)
    span = known.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence(F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01"))), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return every.join(known, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def islands(items: DataFrame, by: str, ts: str, gap_seconds: int, bucket_seconds: int = DAY) -> DataFrame:
    """Runs of items of one ``by`` without a pause over the gap: first, last and number.

    One ``by`` with most of the items is no hot key: runs are found within buckets of time, and only the first and the last run of a
    bucket, which may go on in the buckets beside it, meet those of all others.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = Window.partitionBy(by, "_bucket").orderBy("_us")
    marked = items.where(F.col(ts).isNotNull()).select(by, ts, micros.alias("_us")).withColumn("_bucket", time_bucket(F.col("_us"), bucket_seconds))
    gap = gap_seconds * 1_000_000
    runs = marked.withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(own) > gap).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(own.rangeBetween(Window.unboundedPreceding, 0))).groupBy(by, "_bucket", "_run")
    runs = runs.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    runs = runs.withColumn("_border", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(by, "_bucket"))))
    all_ = Window.partitionBy(by).orderBy("_from")  # two rows a bucket at most
    border = runs.where("_border").withColumn("_new", F.coalesce((F.col("_from") - F.lag("_to").over(all_) > gap).cast("int"), F.lit(1)))
    joined = border.withColumn("_run", F.sum("_new").over(all_)).groupBy(by, "_run").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"))
    return runs.where("not _border").select(by, "first_ts", "last_ts", "n").unionByName(joined.drop("_run"))


def time_bucket(micros: Column, seconds: int) -> Column:
    return F.floor(micros / (seconds * 1_000_000))


def top_rest(items: DataFrame, by: str, k: int, rest: str = "rest") -> DataFrame:
    """The k largest groups and one row for all others, if there are any; ties by name.  Only k rows meet in one task."""
    counts = items.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "name").limit(k)
    others = counts.agg(F.sum("n").alias("_all")).join(F.broadcast(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_top"))))  # one row each
    return top.unionByName(others.where("_all > _top").select(F.lit(rest).alias("name"), (F.col("_all") - F.col("_top")).alias("n")))


def people(items: DataFrame, who: str, ts: Column) -> DataFrame:
    """For every person: contacts, first and last."""
    return items.where(F.col(who).isNotNull()).groupBy(F.col(who).alias("who")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def presence(items: DataFrame, by: str, expected: list[str]) -> DataFrame:
    """Whether each expected source has items."""
    wanted = items.sparkSession.createDataFrame([(x,) for x in expected], "name string")
    found = items.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))
    return wanted.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


TALK = ("teams", "outlook")
UNKNOWN = "(unbekannt)"


def running_months(items: DataFrame, ts: str = "ts", src: str = "src", sources: tuple[str, ...] = TALK) -> DataFrame:
    """(month, one column a source, total, running): every month between the first and the last, and the total so far.

    The window runs over months, of which there are few, whatever the number of items.
    """
    counts = [F.count(F.when(F.col(src) == s, 1)).alias(s) for s in sources]
    known = items.where(F.col(ts).isNotNull() & F.col(src).isin(*sources)).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(*counts, F.count("*").alias("total"))
    filled = dense_months(items.where(F.col(src).isin(*sources)), ts).select("month").join(known, "month", "left").fillna(0)
    return filled.withColumn("running", F.sum("total").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


def talk_summary(chunks: DataFrame, sources: tuple[str, ...] = TALK) -> DataFrame:
    """One row: messages, conversations, with attachments, gone, senders, first and last time of the conversations' sources."""
    own = chunks.where(F.col("src").isin(*sources))
    first = F.col("seq") == 0
    named = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    return own.agg(
        F.countDistinct("uid").alias("messages"), named("thread").alias("conversations"), F.count(F.when(first & (F.coalesce("att", F.lit("")) != ""), 1)).alias("with_attachment"),
        F.count(F.when(first & F.col("gone").isNotNull(), 1)).alias("gone"), named("who").alias("persons"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def file_summary(chunks: DataFrame, roots: tuple[str, ...] = ("onedrive", "sharepoint", "teams")) -> DataFrame:
    """One row: files, pages, files below each root, and how many of them are gone."""
    files = F.col("src") == "datei"
    count = lambda c: F.countDistinct(F.when(c, F.col("uid")))
    each = [count(files & (F.col("root") == r)).alias(r) for r in roots]
    return chunks.agg(count(files).alias("files"), count(F.col("src") == "pages").alias("pages"), *each, F.count(F.when((F.col("seq") == 0) & F.col("gone").isNotNull() & F.col("src").isin("datei", "pages"), 1)).alias("gone"))


def source_summary(chunks: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(src, n, gone) for each of the sources, those without items too."""
    wanted = chunks.sparkSession.createDataFrame([(s,) for s in sources], "src string")
    found = chunks.groupBy("src").agg(F.countDistinct("uid").alias("n"), F.count(F.when((F.col("seq") == 0) & F.col("gone").isNotNull(), 1)).alias("gone"))
    return wanted.join(found, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gone", F.lit(0)).alias("gone"))


def attachment_types(chunks: DataFrame, k: int = 10, sources: tuple[str, ...] = TALK) -> DataFrame:
    """(name, n): the k most frequent types among the attachment names of conversations, and ``…`` for all others; every name counts."""
    from stratica.functions.mail import attachment_names

    own = chunks.where((F.col("seq") == 0) & F.col("src").isin(*sources) & (F.coalesce("att", F.lit("")) != ""))
    typed = own.select(F.explode(attachment_names(F.col("att"))).alias("_name")).where(F.col("_name").contains("."))
    return top_rest(typed.select(F.left(F.lower(F.substring_index("_name", ".", -1)), F.lit(8)).alias("type")), "type", k, "…")


def top_counts(items: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest groups of a column that is not empty; ties by name."""
    named = items.where(F.coalesce(F.col(by).cast("string"), F.lit("")) != "")
    return named.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def top_people(people_table: DataFrame, k: int = 40) -> DataFrame:
    """The k senders of most messages, over all sources."""
    return people_table.where("who <> ''").groupBy("who").agg(F.sum("messages").alias("n")).orderBy(F.desc("n"), "who").limit(k)


def search_people(people_table: DataFrame, contains: str = "", source: str = "") -> DataFrame:
    """(who, n) of known senders whose name or people words hold a text, in one source or all."""
    own = people_table.where((F.col("who") != "") & (F.col("who") != UNKNOWN))
    if source:
        own = own.where(F.col("src") == source)
    if contains:
        own = own.where(F.lower(F.concat_ws(" ", "who", "tokens")).contains(contains.lower()))
    return own.groupBy("who").agg(F.sum("messages").alias("n"))


def search_addresses(addresses: DataFrame, role: str, contains: str, k: int) -> DataFrame:
    """The k addresses of a line that stand in most mails."""
    return addresses.where((F.col("role") == role) & F.col("address").contains(contains.lower())).orderBy(F.desc("mails"), "address").limit(k)


def folder_sizes(files: DataFrame, by: str, path: str, size: str, largest: int = 8) -> tuple[DataFrame, DataFrame]:
    """(by, n, bytes) of every folder, and the largest files of all."""
    return files.groupBy(by).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), files.select(by, path, size).orderBy(F.desc(size), path).limit(largest)


def folders(chunks: DataFrame, unit: Column) -> DataFrame:
    """(src, root, unit, n): items of every unit that a folder list shows."""
    return chunks.where(unit.isNotNull()).groupBy("src", "root", unit.alias("unit")).agg(F.countDistinct("uid").alias("n"))


def filetypes(chunks: DataFrame, ext: str = "ext", uid: str = "uid") -> DataFrame:
    """(type, n): how many items have each type; an item with several counts for each of them once."""
    each = chunks.where(F.coalesce(ext, F.lit("")) != "").select(uid, F.explode(F.split(ext, " ")).alias("type")).where("type <> ''")
    return each.groupBy("type").agg(F.countDistinct(uid).alias("n"))


def one_level(files: DataFrame, path: str, folder: str) -> DataFrame:
    """(name, is_dir, n): what lies directly in a folder, folders with the number of files anywhere below."""
    inside = files if not folder else files.where(F.col(path).startswith(folder.rstrip("/") + "/"))
    rest = F.col(path) if not folder else F.substring(F.col(path), F.lit(len(folder.rstrip("/")) + 2), F.length(path))
    return inside.select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_dir")).groupBy("name", "is_dir").agg(F.count("*").alias("n"))


def people_of(rows: DataFrame, who: str = "who", address: str = "who_mail", date: str = "date", src: str = "src", by: tuple[str, ...] = ()) -> DataFrame:
    """(name, address, items, by_source, first, last) of every person whom rows name, for each of the columns ``by``.

    Several names stand with `` · `` between; the unknown sender and the address book are left out.  An address counts
    where a row names one person alone: the first by date.  Dates are texts; what is none counts as unknown.
    """
    names = F.filter(F.transform(F.split(F.coalesce(who, F.lit("")), " · ", -1), lambda n: F.trim(n)), lambda n: (n != "") & (n != UNKNOWN))
    day = F.when((F.length(F.trim(date)) >= 10) & (F.substring(F.trim(date), 5, 1) == "-"), F.left(F.trim(date), F.lit(16)))
    mail = F.when(F.size("_names") == 1, F.nullif(F.lower(F.trim(address)), F.lit("")))
    each = rows.where(~F.col(src).eqNullSafe(F.lit("kontakte"))).withColumn("_names", names).select(*by, F.explode("_names").alias("name"), mail.alias("_mail"), day.alias("_day"), F.col(src).alias("_src"))
    per_source = each.groupBy(*by, "name", "_src").agg(F.count("*").alias("_n"), F.min("_day").alias("_first"), F.max("_day").alias("_last"), F.min(F.when(F.col("_mail").isNotNull(), F.struct(F.coalesce("_day", F.lit("9")).alias("d"), F.col("_mail").alias("m")))).alias("_m"))
    found = per_source.groupBy(*by, "name").agg(F.min("_m").alias("_m"), F.sum("_n").alias("items"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_src", "_n")))).alias("by_source"), F.min("_first").alias("first"), F.max("_last").alias("last"))
    return found.select(*by, "name", F.coalesce("_m.m", F.lit("")).alias("address"), "items", "by_source", F.coalesce("first", F.lit("")).alias("first"), F.coalesce("last", F.lit("")).alias("last"))


def rule_summary(paths: DataFrame, path: str, rules: list[tuple[bool, str]], gone: Column) -> DataFrame:
    """(rule, taken, left_out, gone): how many paths each rule decides, the last that matches; null where none does."""
    from stratica.operators.filters import last_match

    deciding = F.lit(None).cast("string")
    for include, glob in rules:
        hit = last_match(F.col(path), [(False, "**"), (True, glob)])
        deciding = F.when(hit, F.lit(glob)).otherwise(deciding)
    rows = paths.select(deciding.alias("rule"), last_match(F.col(path), rules).alias("_in"), F.coalesce(gone, F.lit(False)).alias("_gone"))
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("rule").agg(count(F.col("_in") & ~F.col("_gone")).alias("taken"), count(~F.col("_in") & ~F.col("_gone")).alias("left_out"), count(F.col("_gone")).alias("gone"))


def findings(rows: DataFrame, source: str, state: str, name: str, cap: int = 200, quiet: tuple[str, ...] = ("consistent", "noted")) -> DataFrame:
    """(source, state, n, names): how many of each state, and the first names of those that are a finding (the list's own bound)."""
    place = F.row_number().over(Window.partitionBy(source, state).orderBy(name))
    counts = rows.groupBy(source, state).agg(F.count("*").alias("n"))
    listed = rows.where(~F.col(state).isin(*quiet)).withColumn("_place", place).where(F.col("_place") <= cap).groupBy(source, state).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return counts.join(listed, [source, state], "left").select(source, state, "n", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def last_success(runs: DataFrame, steps: DataFrame, run: str, step: str, started: str, kind: Column) -> DataFrame:
    """(step, last): when each step last ended well in a run of the kind."""
    return runs.where(kind).join(steps.where("ok"), run).groupBy(step).agg(F.max(started).alias("last"))


def analytics_document(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, rows): small results as JSON texts, as one run of the index stores them.  The results are top lists, months and single rows."""
    out = None
    for name, frame in sorted(frames.items()):
        one = frame.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*frame.columns)))).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out

"""The facts by which an item of each kind is known, as one JSON document a row, and what a citation can be held to.

Items carry most of them; what only the source knows (all addresses of a mail, the end of an appointment, a task's state)
comes from frames of the readers, joined by path or task.  All is expressions: a fact that is not there is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.functions.text import collapse, strip_html
from stratica.functions.times import calendar_time

DAY, CLOCK = "yyyy-MM-dd", "yyyy-MM-dd HH:mm"
#: What a task's facts are read from.
TASK = (
    "task struct<dueDateTime:string,percentComplete:int,status:string,completedDateTime:string,assignments:map<string,string>,checklistItems:array<struct<isChecked:boolean>>,linkedResources:array<struct<displayName:string,applicationName:string>>>,"
    "details struct<checklist:map<string,struct<isChecked:boolean>>>,kommentare array<struct<wer:string,wann:string,html:string>>"
)
#: The states of a list's tasks that have a name; others have none.
TODO_STATES = {"notStarted": "notstarted", "inProgress": "inprogress", "completed": "completed"}


def some(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def named(name: Column, address: Column) -> Column:
    return F.struct(some(name).alias("name"), F.lower(some(address)).alias("mail"))


def parts(value: Column, by: str) -> Column:
    return F.filter(F.split(some(value), by), lambda x: x != "")


def mail_facts(items: DataFrame, mails: DataFrame | None = None) -> DataFrame:
    """(uid, facts) of mails: from, to, cc, bcc (name and mail each), date, folder, attachments.  ``mails``: rel and the reader's lines."""
    rows = items.where("src = 'outlook'")
    lines = ("from_line", "to_line", "cc_line", "bcc_line")
    if mails is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in lines})
    else:
        rows = rows.join(mails.select("rel", *lines), "rel", "left")
    people = lambda c: F.transform(mail.address_list(F.col(c)), lambda a: F.struct(a["name"].alias("name"), F.lower(a["mail"]).alias("mail")))
    rows = rows.withColumn("_from", F.try_element_at(people("from_line"), F.lit(1)))
    filled = lambda field, own: F.coalesce(F.nullif(F.col(f"_from.{field}"), F.lit("")), some(own))
    files = F.transform(F.coalesce(mail.attachment_names(F.col("att")), F.array().cast("array<string>")), lambda n: F.struct(n.alias("name")))
    sender = F.struct(filled("name", F.col("who")).alias("name"), filled("mail", F.col("who_mail")).alias("mail"))
    return rows.select("uid", F.to_json(F.struct(sender.alias("from"), people("to_line").alias("to"), people("cc_line").alias("cc"), people("bcc_line").alias("bcc"), some(F.col("date")).alias("date"), some(F.col("ctx")).alias("folder"), files.alias("attachments"))).alias("facts"))


def event_facts(items: DataFrame, events: DataFrame) -> DataFrame:
    """(uid, facts) of appointments, the master's: start, end, allday, location, organiser, attendees, calendar.

    The end of whole days names the day after; shown is the last day, and none where that is the first.  ``events``: rows of the reader with rel.
    """
    master = events.groupBy("rel", "nth").agg(F.min_by(F.struct("start", "finish", "tz", "all_day", "place", "organizer", "organizer_name", "attendees", "attendee_names"), F.struct(F.col("recurrence_id").isNotNull().alias("x"), "position")).alias("e"))
    numbered = items.where("src = 'kalender'").withColumn("nth", F.regexp_extract("uid", r":(\d+)$", 1).cast("int"))
    rows = numbered.join(master, ["rel", "nth"], "left")
    e = lambda c: F.col(f"e.{c}")
    whole = F.coalesce(e("all_day"), F.lit(False))
    at = lambda c: calendar_time(e(c), e("tz"))
    first, last = F.date_format(at("start"), DAY), F.date_format(F.date_sub(at("finish").cast("date"), 1), DAY)
    start = F.coalesce(F.when(whole, first).otherwise(F.date_format(at("start"), CLOCK)), F.col("date"))
    end = F.when(whole, F.when(last > first, last)).otherwise(F.date_format(at("finish"), CLOCK))
    guests = F.transform(F.arrays_zip(F.split(some(e("attendee_names")), r"\|").alias("n"), parts(e("attendees"), r"\|").alias("m")), lambda a: named(a["n"], a["m"]))
    people = F.filter(guests, lambda a: a["mail"] != "")
    organiser = named(F.coalesce(e("organizer_name"), F.when(e("organizer").isNull(), F.col("who"))), F.coalesce(e("organizer"), F.col("who_mail")))
    return rows.select("uid", F.to_json(F.struct(some(start).alias("start"), some(end).alias("end"), whole.alias("allday"), some(e("place")).alias("location"), organiser.alias("organiser"), people.alias("attendees"), some(F.col("ctx")).alias("calendar"))).alias("facts"))


def contact_facts(items: DataFrame, cards: DataFrame) -> DataFrame:
    """(uid, facts) of contacts: org, role, emails, phones, note, folder.  ``cards``: rows of the reader with rel."""
    rows = items.where("src = 'kontakte'").withColumn("nth", F.regexp_extract("uid", r":(\d+)$", 1).cast("int")).join(cards.select("rel", "nth", "units", "job", "mails", "phones", "note"), ["rel", "nth"], "left")
    return rows.select("uid", F.to_json(F.struct(F.array_join(parts(F.col("units"), r"\|"), " · ").alias("org"), some(F.col("job")).alias("role"), parts(F.col("mails"), r"\|").alias("emails"), parts(F.col("phones"), r"\|").alias("phones"), some(F.col("note")).alias("note"), some(F.col("ctx")).alias("folder"))).alias("facts"))


def task_facts(items: DataFrame, tasks: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(uid, facts) of tasks of boards (plan, bucket, assigned, due, state, checklist, attachments, comments) and of lists (list, due, completed, state, steps, linked, attachments).

    ``tasks``: src, task_id, entry (JSON); ``people``: id and name of those that entries name by their id.
    """
    task = F.regexp_extract("uid", r"^[^:]*:[^/]*/(.*):[^:]*$", 1)
    rows = items.where("src in ('planner', 'todo')").withColumn("task_id", task).join(tasks.select("src", "task_id", F.from_json("entry", TASK).alias("e")), ["src", "task_id"], "left")
    names = F.create_map().cast("map<string,string>")
    if people is not None:
        known = people.groupBy().agg(F.map_from_entries(F.collect_set(F.struct("id", "name"))).alias("_names"))  # the people of an organisation: one row
        rows, names = rows.join(F.broadcast(known)), F.coalesce("_names", names)
    called = lambda i: F.coalesce(F.try_element_at(names, i), i)
    t = lambda c: F.col(f"e.task.{c}")
    day = lambda c: F.left(some(F.coalesce(F.get_json_object(t(c), "$.dateTime"), t(c))), F.lit(10))
    steps = lambda checked: F.when(F.size(checked) > 0, F.struct(F.size(F.filter(checked, lambda c: F.coalesce(c, F.lit(False)))).alias("done"), F.size(checked).alias("total")))
    files = F.coalesce(mail.attachment_names(F.col("att")), F.array().cast("array<string>"))
    assigned = F.array_sort(F.transform(F.coalesce(F.map_keys(t("assignments")), F.array().cast("array<string>")), called))
    own = F.when(F.size(assigned) > 0, assigned).otherwise(parts(F.col("who"), " · "))
    state = F.when(F.col("e").isNull(), "").when(F.coalesce(t("percentComplete"), F.lit(0)) == 0, "notstarted").when(t("percentComplete") == 100, "done").otherwise("inprogress")
    comments = F.transform(F.coalesce("e.kommentare", F.array().cast("array<struct<wer:string,wann:string,html:string>>")), lambda k: F.struct(called(some(k["wer"])).alias("who"), some(k["wann"]).alias("when"), collapse(strip_html(some(k["html"]))).alias("text")))
    board = F.struct(F.substring_index("ctx", "/", 1).alias("plan"), F.when(F.col("ctx").contains("/"), F.regexp_replace("ctx", "^[^/]*/", "")).otherwise("").alias("bucket"), own.alias("assigned"), day("dueDateTime").alias("due"), state.alias("state"), steps(F.transform(F.map_values("e.details.checklist"), lambda c: c["isChecked"])).alias("checklist"), files.alias("attachments"), comments.alias("comments"))
    states = F.create_map(*[F.lit(x) for pair in TODO_STATES.items() for x in pair])
    linked = F.transform(F.coalesce(t("linkedResources"), F.array().cast("array<struct<displayName:string,applicationName:string>>")), lambda r: F.coalesce(F.nullif(r["displayName"], F.lit("")), some(r["applicationName"])))
    list_ = F.struct(some(F.col("ctx")).alias("list"), day("dueDateTime").alias("due"), day("completedDateTime").alias("completed"), some(F.try_element_at(states, some(t("status")))).alias("state"), steps(F.transform(t("checklistItems"), lambda c: c["isChecked"])).alias("steps"), linked.alias("linked"), files.alias("attachments"))
    return rows.select("uid", F.when(F.col("src") == "planner", F.to_json(board)).otherwise(F.to_json(list_)).alias("facts"))


def plain_facts(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(uid, facts) of chat messages, files (``files``: root, rel, length, modified) and pages."""
    rows = items.where("src in ('teams', 'datei', 'pages', 'onenote')")
    if files is None:
        rows = rows.withColumns({"length": F.lit(None).cast("long"), "modified": F.lit(None).cast("timestamp")})
    else:
        rows = rows.join(files.select("root", "rel", "length", "modified"), ["root", "rel"], "left")
    name = F.substring_index("rel", "/", -1)
    ext = F.when(name.rlike(r"^.+\.[^.]+$"), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    chat = F.struct(F.struct(some(F.col("who")).alias("name"), F.lit("").alias("mail")).alias("from"), some(F.col("date")).alias("date"), some(F.col("ctx")).alias("folder"), some(F.col("title")).alias("chat"))
    file = F.struct(name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), F.coalesce(F.date_format("modified", CLOCK), F.col("date"), F.lit("")).alias("modified"), some(F.col("ctx")).alias("folder"))
    page = F.struct(some(F.col("ctx")).alias("folder"), some(F.col("date")).alias("modified"))
    return rows.select("uid", F.when(F.col("src") == "teams", F.to_json(chat)).when(F.col("src") == "datei", F.to_json(file)).otherwise(F.to_json(page)).alias("facts"))


def cited(items: DataFrame, lines: DataFrame, disk: DataFrame, journal: DataFrame, broken: DataFrame) -> DataFrame:
    """(uid, label, key, sha256, chain_line, captured, verdict) of items: how to quote them, and what the chain of evidence and the disk say now.

    ``lines``: n, at, rel, kind, sha256; ``disk``: rel, sha256; ``journal``: seq, op, rel, sha256, other; ``broken``: a row for each chain that does not hold.
    """
    from stratica.operators import evidence
    from stratica.operators.items import label

    said = lines.where(F.col("kind").isin(*evidence.CONTENT)).groupBy("rel").agg(F.max_by(F.struct("sha256", "kind"), "n").alias("_r"))
    # the line that first saw the content that is recorded last
    seen = lines.where(F.col("kind").isin(*evidence.CONTENT)).groupBy("rel", "sha256").agg(F.min(F.struct("n", "at")).alias("_s"))
    writes, _ = evidence.pending(journal)
    now = disk.groupBy("rel").agg(F.max("sha256").alias("_now"))
    whole = broken.agg((F.count("*") == 0).alias("_whole"))
    rows = items.join(said, "rel", "left").withColumn("sha256", F.col("_r.sha256")).join(seen, ["rel", "sha256"], "left").join(now, "rel", "left").join(writes.select("rel", F.col("sha256").alias("_announced")), "rel", "left").join(F.broadcast(whole))
    verdict = evidence.verdict(F.col("_now").isNotNull(), F.col("_whole"), F.col("sha256"), F.col("_now"), F.col("_r.kind"), F.col("_announced"))
    return rows.select("uid", label(F.col("src"), F.date_format("ts", DAY), F.col("who"), F.col("title")).alias("label"), "key", "sha256", F.col("_s.n").alias("chain_line"), F.col("_s.at").alias("captured"), verdict.alias("verdict"))

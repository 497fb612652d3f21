"""Items of mails, chats, calendars and contacts, with the columns of ``operators.items``, from the rows of ``readers``.

The rows may come from files or from any frame with the same columns; nothing here looks at a file.  All is expressions,
but for appointments, where the dates of one series (an event and its exceptions) meet by file and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.functions.text import bound_once, collapse, strip_html
from stratica.functions.times import calendar_time, zone
from stratica.operators import recurrence

UNKNOWN, NO_SUBJECT, NO_NAME = "(unbekannt)", "(kein Betreff)", "(ohne Namen)"
SHOWN = "yyyy-MM-dd HH:mm"


def filled(value: Column, instead: str | Column) -> Column:
    """The value, or what stands in for none or an empty one."""
    return F.coalesce(F.nullif(value, F.lit("")), instead if isinstance(instead, Column) else F.lit(instead))


def folder_of(rel: Column, without: str) -> Column:
    return F.when(rel.contains("/"), F.regexp_replace(rel, "/[^/]*$", "")).otherwise(without)


def known_key(name: str, found: Column) -> Column:
    """The item's own key, by the id that it carries; null without one (``items.with_keys`` then makes one)."""
    own = F.nullif(F.trim(F.coalesce(found, F.lit(""))), F.lit(""))
    return F.when(own.isNotNull(), F.concat(F.lit(f"{name}:"), own))


def mail_items(mails: DataFrame) -> DataFrame:
    """Items of mails (``readers.mails`` and ``rel``): who stands in which line, domains, conversation, the visible body.

    A body that is all quote is the content.  A sender without a name is called by the address.  A date that cannot be read stays as it
    is written.
    """
    lines = {name: mail.address_list(F.col(f"{name}_line")) for name in ("from", "to", "cc", "bcc")}
    rows = mails.select("*", *[v.alias(f"_{k}") for k, v in lines.items()])
    names = {k: F.filter(F.transform(f"_{k}", lambda a: a["name"]), lambda n: n != "") for k in lines}
    mails_ = {k: F.filter(F.transform(f"_{k}", lambda a: a["mail"]), lambda n: n != "") for k in lines}
    line = lambda k: F.lower(F.array_join(F.concat(names[k], mails_[k]), " "))
    text = bound_once(F.coalesce(mail.strip_quoted(F.col("body")), F.lit("")), lambda own: collapse(F.when(own.rlike(r"\S"), own).otherwise(F.coalesce("body", F.lit("")))))
    return rows.select(
        F.concat(F.lit("outlook:"), "rel", F.lit(":0")).alias("uid"), F.lit("outlook").alias("src"), F.lit("outlook").alias("root"), "rel", known_key("mail", F.col("message_id")).alias("key"),
        mail.thread_key(F.col("thread_index"), F.col("references"), F.col("reply_to"), F.col("message_id")).alias("thread"), F.col("att"),
        F.coalesce(F.try_element_at(names["from"], F.lit(1)), F.try_element_at(mails_["from"], F.lit(1)), F.lit(UNKNOWN)).alias("who"), F.lower(F.coalesce(F.try_element_at(mails_["from"], F.lit(1)), F.lit(""))).alias("who_mail"),
        F.lower(F.array_join(F.concat(*[x for k in lines for x in (names[k], mails_[k])]), " ")).alias("ppl"), mail.domains(F.concat(*mails_.values())).alias("domains"),
        line("to").alias("to_ppl"), line("cc").alias("cc_ppl"), line("bcc").alias("bcc_ppl"),
        F.col("sent").alias("ts"), F.coalesce(F.date_format("sent", SHOWN), F.col("sent_line")).alias("date"), filled(F.col("title"), NO_SUBJECT).alias("title"), folder_of(F.col("rel"), "(Stamm)").alias("ctx"), text.alias("text"),
    )


def chat_items(pages: DataFrame) -> DataFrame:
    """Items of chat pages (``rel``, ``html``): one for each message, by place in the page.

    Messages without words are numbered behind all others of their page, so that numbers of the others never hang on them.
    A page is one row, so its messages are ordered where they are: nothing is shuffled.
    """
    blocks = F.split("html", r'(?i)(?=<div class="msg")')
    attribute = lambda block, name: F.nullif(F.regexp_extract(block, f'^<div[^>]*\\b{name}="([^"]*)"', 1), F.lit(""))
    part = lambda block, name: F.trim(strip_html(F.regexp_extract(block, f'(?is)<span class="{name}"[^>]*>(.*?)</span>', 1)))

    def message(block: Column) -> Column:
        body = strip_html(F.regexp_extract(block, r'(?is)<div class="body"[^>]*>(.*)', 1))
        return F.struct(attribute(block, "data-id").alias("msg_id"), attribute(block, "data-gone").alias("gone"), part(block, "name").alias("name"), part(block, "time").alias("time"), body.alias("text"))

    title = F.trim(strip_html(F.regexp_extract(blocks[0], r"(?is)<h1[^>]*>(.*?)</h1>", 1)))  # a heading inside a message is its text
    numbered = lambda all_: F.concat(F.filter(all_, lambda m: m["text"] != ""), F.filter(all_, lambda m: m["text"] == ""))
    rows = pages.select("rel", title.alias("title"), F.posexplode(bound_once(F.transform(F.slice(blocks, 2, 1 << 30), message), numbered)).alias("_n", "_m"))
    m = lambda name: F.col(f"_m.{name}")
    return rows.select(
        F.concat(F.lit("teams:"), "rel", F.lit(":"), F.col("_n").cast("string")).alias("uid"), F.lit("teams").alias("src"), F.lit("teams").alias("root"), "rel", F.concat(F.lit("chat:"), "rel").alias("thread"),
        filled(m("name"), UNKNOWN).alias("who"), F.lower(F.concat(m("name"), F.lit(" "), "title")).alias("ppl"), F.try_to_timestamp(F.trim(m("time")), F.lit(SHOWN)).alias("ts"), m("time").alias("date"),
        "title", folder_of(F.col("rel"), "other").alias("ctx"), m("text").alias("text"), m("msg_id").alias("msg_id"), m("gone").alias("gone"),
    )


#: What a series is unfolded from: values of its calendar file as they stand there.
SERIES = "struct<start:string,tz:string,all_day:boolean,rrule:string,exdates:array<struct<value:string,tzid:string>>,ex:array<struct<rid:string,rtz:string,start:string,tz:string,date:boolean>>>"


def event_items(events: DataFrame) -> DataFrame:
    """Items of appointments (``readers.calendars`` and ``rel``): one for each event of a file, its exceptions folded into it.

    The first entry of an id without a slot of its own (``recurrence_id``) is the event, else the first of all.  Words of
    exceptions that the event lacks follow its text.  A repeating one has ``series``, a JSON document from which ``series_dates``
    makes its dates.  The item of the file's first event ends with ``:0``, those of further ones with their number.
    """
    entry = F.struct(*[c for c in events.columns if c not in ("rel", "nth", "position")])
    folded = events.groupBy("rel", "nth").agg(F.min(F.struct(F.col("recurrence_id").isNotNull().alias("x"), F.col("position").alias("at"))).alias("_first"), F.array_sort(F.collect_list(F.struct(F.col("position").alias("at"), entry.alias("e")))).alias("_all"))
    rows = folded.select("rel", "nth", "_first", F.filter("_all", lambda a: a["at"] == F.col("_first.at"))[0]["e"].alias("m"), F.filter("_all", lambda a: a["at"] != F.col("_first.at")).alias("_rest"))
    m = lambda c: F.col(f"m.{c}")
    mine = lambda c: F.coalesce(m(c), F.lit(""))
    words = F.flatten(F.transform("_rest", lambda a: F.transform(F.array(a["e"]["title"], a["e"]["place"], a["e"]["description"]), lambda w: F.coalesce(w, F.lit("")))))
    more = F.array_distinct(F.filter(words, lambda w: (w != "") & ~F.array_contains(F.array(mine("title"), mine("place"), mine("description")), w)))
    own = F.trim(F.concat(F.when(mine("place") != "", F.concat(F.lit("Ort: "), mine("place"), F.lit(". "))).otherwise(""), mine("description")))
    body = F.array_join(F.filter(F.concat(F.array(own), more), lambda w: w != ""), "\n")
    moved = F.transform(F.filter("_rest", lambda a: F.coalesce(a["e"]["recurrence_id"], F.lit("")) != ""), lambda a: F.struct(a["e"]["recurrence_id"].alias("rid"), a["e"]["recurrence_tz"].alias("rtz"), a["e"]["start"].alias("start"), a["e"]["tz"].alias("tz"), a["e"]["all_day"].alias("date")))
    out = F.transform(F.filter(F.split(mine("exdates"), r"\|"), lambda v: v != ""), lambda v: F.struct(v.alias("value"), m("exdate_tz").alias("tzid")))
    series = F.when(mine("rrule") != "", F.to_json(F.struct(m("start").alias("start"), m("tz").alias("tz"), m("all_day").alias("all_day"), m("rrule").alias("rrule"), out.alias("exdates"), moved.alias("ex"))))
    at = calendar_time(m("start"), m("tz"))
    shown = F.coalesce(F.when(mine("start").rlike(r"^\d{8}$") | F.coalesce(m("all_day"), F.lit(False)), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, SHOWN)), mine("start"))
    people = F.filter(F.concat(F.array(mine("organizer_name"), mine("organizer")), F.split(mine("attendee_names"), r"\|"), F.split(mine("attendees"), r"\|")), lambda p: p != "")
    parts = F.split("rel", "/")
    ctx = F.when((F.size(parts) >= 3) & (parts[0] == "kalender"), F.concat_ws("/", parts[0], parts[1])).otherwise("kalender")
    return rows.select(
        F.concat(F.lit("kalender:"), "rel", F.lit(":"), F.col("nth").cast("string")).alias("uid"), F.lit("kalender").alias("src"), F.lit("outlook").alias("root"), "rel", known_key("event", m("uid")).alias("key"),
        filled(mine("organizer_name"), filled(mine("organizer"), UNKNOWN)).alias("who"), F.lower(F.array_join(people, " ")).alias("ppl"), F.lower(mine("organizer")).alias("who_mail"), mail.domains(F.concat(F.array(mine("organizer")), F.split(mine("attendees"), r"\|"))).alias("domains"),
        at.alias("ts"), shown.alias("date"), filled(mine("title"), NO_SUBJECT).alias("title"), ctx.alias("ctx"), body.alias("text"), series.alias("series"),
    )


def series_dates(items: DataFrame, horizon: str, local: str = "UTC") -> DataFrame:
    """(uid, ts): every date that the series of items make up to the horizon, as instants, exceptions moved and exdates taken out."""
    wall = lambda v, tzid, own: F.when(v.endswith("Z"), F.from_utc_timestamp(calendar_time(v, tzid, local), own).cast("timestamp_ntz")).otherwise(F.coalesce(F.try_to_timestamp(F.left(v, F.lit(15)), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(F.left(v, F.lit(8)), F.lit("yyyyMMdd"))).cast("timestamp_ntz"))
    read = items.where("series is not null").select("uid", F.from_json("series", SERIES).alias("s")).select("uid", "s.*")
    zoned = read.withColumn("tz", F.when(F.col("start").endswith("Z"), "UTC").otherwise(F.coalesce(zone(F.col("tz")), F.lit(local))))
    rows = zoned.select("uid", "tz", "rrule", wall(F.col("start"), F.col("tz"), F.col("tz")).alias("start"), F.transform(F.coalesce("exdates", F.array().cast("array<struct<value:string,tzid:string>>")), lambda e: wall(e["value"], e["tzid"], F.col("tz"))).alias("exdates"), "ex")
    dates = recurrence.expand(rows.drop("ex"), horizon, exdates="exdates").select("uid", "wall")
    moved = rows.select("uid", "tz", F.explode("ex").alias("e")).select("uid", wall(F.col("e.rid"), F.col("e.rtz"), F.col("tz")).alias("slot"), wall(F.col("e.start"), F.col("e.tz"), F.col("tz")).alias("moved")).where("slot is not null")
    kept = recurrence.with_exceptions(dates, moved)
    return kept.join(rows.select("uid", "tz"), "uid").select("uid", recurrence.instant(F.col("wall"), F.col("tz")).cast("timestamp").alias("ts")).distinct()


def contact_items(cards: DataFrame) -> DataFrame:
    """Items of contact cards (``readers.contacts`` and ``rel``): without a date, found by name, addresses, numbers and note."""
    mine = lambda c: F.coalesce(F.col(c), F.lit(""))
    several = lambda c: F.filter(F.split(mine(c), r"\|"), lambda v: v != "")
    parts = F.split("rel", "/")
    unit = F.array_join(several("units"), " · ")
    ctx = F.when((F.size(parts) >= 3) & (parts[0] == "kontakte"), F.concat_ws("/", parts[0], parts[1])).otherwise("kontakte")
    text = F.array_join(F.filter(F.concat(F.array(unit, mine("job")), several("mails"), several("phones"), F.array(mine("note"))), lambda v: v != ""), " · ")
    return cards.select(
        F.concat(F.lit("kontakte:"), "rel", F.lit(":"), F.col("nth").cast("string")).alias("uid"), F.lit("kontakte").alias("src"), F.lit("outlook").alias("root"), "rel", known_key("contact", F.col("card_id")).alias("key"),
        filled(unit, filled(mine("job"), "Kontakt")).alias("who"), F.lower(F.array_join(F.concat(F.array(filled(mine("name"), NO_NAME)), several("mails")), " ")).alias("ppl"), F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("date"),
        filled(mine("name"), NO_NAME).alias("title"), ctx.alias("ctx"), text.alias("text"),
    )

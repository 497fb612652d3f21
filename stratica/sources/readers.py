"""Readers of archived files.  Spark lists and deals the files; a task parses one file at a time with the standard library.

Every reader takes a folder (any path that Spark reads) and returns one row per item.  A file that cannot be parsed gives
one row with ``error`` set instead of failing the job.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratica.functions.text import collapse, strip_html

MAIL = "path string, who string, who_mail string, to string, cc string, bcc string, sent string, title string, thread_index string, references string, reply_to string, message_id string, att string, body string, html string, from_line string, to_line string, cc_line string, bcc_line string, sent_line string, error string"
EVENT = "path string, uid string, recurrence_id string, title string, start string, tz string, all_day boolean, finish string, rrule string, exdates string, place string, status string, organizer string, attendees string, recurrence_tz string, exdate_tz string, organizer_name string, attendee_names string, description string, nth int, position int, error string"
CONTACT = "path string, name string, org string, mails string, phones string, card_id string, job string, note string, units string, nth int, error string"
TASK = "path string, board string, bucket string, task_id string, title string, notes string, done boolean, created string, modified string, error string"


def parsed(spark: SparkSession, folder: str | list[str], pattern: str, schema: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """Rows of ``parse`` for every file below the folder whose name matches."""
    names = [part.split()[0] for part in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                try:
                    rows = parse(bytes(content))
                except (ValueError, LookupError, TypeError, AttributeError) as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([{**dict.fromkeys(names), **r, "path": path} for r in rows], columns=names, dtype=object)

    return files.mapInPandas(run, schema)


def mails(spark: SparkSession, folder: str) -> DataFrame:
    """``.eml`` files; ``body`` is the plain part, else the text of the HTML part."""

    def parse(content: bytes) -> list[dict]:
        m = email.message_from_bytes(content, policy=email.policy.default)
        name, address = email.utils.parseaddr(str(m.get("From", "")))
        addresses = lambda field: "|".join(a.lower() for _, a in email.utils.getaddresses([str(x) for x in m.get_all(field, [])]) if "@" in a)
        text = lambda kind: (part.get_content() if (part := m.get_body((kind,))) else None)
        header = lambda field: str(m[field]) if m[field] else None
        line = lambda field: ", ".join(str(x) for x in m.get_all(field, [])) or None
        try:
            sent = email.utils.parsedate_to_datetime(m["Date"]).isoformat() if m["Date"] else None
        except ValueError:
            sent = None
        names = "|".join(n for a in m.iter_attachments() if (n := a.get_filename()))
        return [{"who": name or address, "who_mail": address.lower(), "to": addresses("To"), "cc": addresses("Cc"), "bcc": addresses("Bcc"), "sent": sent, "title": header("Subject"), "thread_index": header("Thread-Index"), "references": header("References"), "reply_to": header("In-Reply-To"), "message_id": header("Message-ID"), "att": names or None, "body": text("plain"), "html": text("html"), "from_line": line("From"), "to_line": line("To"), "cc_line": line("Cc"), "bcc_line": line("Bcc"), "sent_line": header("Date")}]

    rows = parsed(spark, folder, "*.eml", MAIL, parse)
    plain = F.nullif(F.trim("body"), F.lit(""))
    return rows.withColumn("body", F.coalesce(plain, strip_html(F.col("html")))).drop("html").withColumn("sent", F.to_timestamp("sent"))


def content_lines(content: bytes) -> list[tuple[str, dict[str, str], str]]:
    """(name, parameters, value) of the folded lines that calendars and contact cards share."""
    joined = re.sub(r"\r?\n[ \t]", "", content.decode("utf-8", "replace"))
    out = []
    for line in joined.splitlines():
        if found := re.match(r'([\w.-]+)((?:;[\w-]+=(?:"[^"]*"|[^;:]*))*):(.*)', line):
            name, params, value = found.groups()
            out.append((name.upper().rsplit(".", 1)[-1], {k.upper(): v.strip('"') for k, v in re.findall(r';([\w-]+)=("[^"]*"|[^;:]*)', params)}, value))
    return out


def plain_value(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value)


def event_rows(content: bytes) -> list[dict]:
    """One row for each VEVENT of a calendar text, masters and exceptions, in their order."""
    rows, row, inner, seen = [], None, 0, {}
    for name, params, value in content_lines(content):
        if name == "BEGIN" and value == "VEVENT":
            row, inner = {"exdates": [], "attendees": [], "attendee_names": [], "position": len(rows)}, 0
        elif row is None:
            continue
        elif name == "BEGIN":
            inner += 1
        elif name == "END" and value == "VEVENT":
            row["nth"] = seen.setdefault(row.get("uid"), len(seen))
            rows.append({k: ("|".join(v) or None) if isinstance(v, list) else v for k, v in row.items()})
            row = None
        elif name == "END":
            inner -= 1
        elif inner:
            continue  # alarms and the like
        elif name == "DTSTART":
            row |= {"start": value, "tz": "UTC" if value.endswith("Z") else params.get("TZID"), "all_day": params.get("VALUE") == "DATE" or len(value) == 8}
        elif name == "EXDATE":
            row["exdates"] += value.split(",")
            row.setdefault("exdate_tz", params.get("TZID"))
        elif name == "ATTENDEE":
            row["attendees"].append(re.sub("(?i)^mailto:", "", value).lower())
            row["attendee_names"] += [params["CN"]] if params.get("CN") else []
        elif name == "ORGANIZER":
            row |= {"organizer": re.sub("(?i)^mailto:", "", value).lower(), "organizer_name": params.get("CN")}
        elif name == "RECURRENCE-ID":
            row |= {"recurrence_id": value, "recurrence_tz": params.get("TZID")}
        elif name in (known := {"UID": "uid", "SUMMARY": "title", "DESCRIPTION": "description", "DTEND": "finish", "RRULE": "rrule", "LOCATION": "place", "STATUS": "status"}):
            row[known[name]] = plain_value(value)
    return rows


def calendars(spark: SparkSession, folder: str) -> DataFrame:
    """``.ics`` files: one row per VEVENT, masters and exceptions; times stay texts with their zone (``Z`` means UTC)."""
    return parsed(spark, folder, "*.ics", EVENT, event_rows)


INVITE = EVENT.replace(", error string", ", method string, mail_sent string, organizer_hint string, error string")


def invitation_rows(content: bytes) -> list[dict]:
    """The events of the calendar parts of one mail, with their method and the mail's own date and sender; none of most mails."""
    m, out = email.message_from_bytes(content, policy=email.policy.default), []
    for part in m.walk():
        if part.get_content_type() != "text/calendar":
            continue
        text = part.get_payload(decode=True) or b""
        said = next((v for n, _, v in content_lines(text) if n == "METHOD"), None) or part.get_param("method")
        try:
            sent = email.utils.parsedate_to_datetime(m["Date"]).isoformat() if m["Date"] else None
        except ValueError:
            sent = None
        out += [{**row, "method": str(said or "").upper(), "mail_sent": sent, "organizer_hint": email.utils.parseaddr(str(m.get("From", "")))[1].lower()} for row in event_rows(text)]
    return out


def invitations(spark: SparkSession, places: str | list[str]) -> DataFrame:
    """Appointments that lie in mails: those of a folder, or of the files named."""
    return parsed(spark, places, "*.eml", INVITE, invitation_rows)


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """``.vcf`` files: one row per card; the structured name stands in for a missing full name."""

    def parse(content: bytes) -> list[dict]:
        rows, row = [], None
        for name, _, value in content_lines(content):
            if name == "BEGIN":
                row = {"name": None, "org": None, "mails": [], "phones": [], "parts": "", "nth": len(rows)}
            elif row is None:
                continue
            elif name == "END":
                rows.append({"name": row["name"] or row["parts"] or None, "org": row["org"], "mails": "|".join(row["mails"]), "phones": "|".join(row["phones"]), **{k: row.get(k) for k in ("card_id", "job", "note", "units", "nth")}})
                row = None
            elif name == "FN":
                row["name"] = plain_value(value).strip()
            elif name == "N":
                family, given = [*value.split(";"), "", ""][:2]
                row["parts"] = plain_value(f"{given} {family}").strip()
            elif name == "ORG":
                units = [p for p in map(plain_value, re.split(r"(?<!\\);", value)) if p]
                row |= {"org": ", ".join(units), "units": "|".join(units)}
            elif name in ("UID", "TITLE", "NOTE"):
                row[{"UID": "card_id", "TITLE": "job", "NOTE": "note"}[name]] = plain_value(value).strip()
            elif name in ("EMAIL", "TEL"):
                row["mails" if name == "EMAIL" else "phones"].append(value.strip())
        return rows

    return parsed(spark, folder, "*.vcf", CONTACT, parse)


def boards(spark: SparkSession, folder: str) -> DataFrame:
    """Board and list files (JSON with ``title`` and ``tasks``): one row per task."""

    def parse(content: bytes) -> list[dict]:
        board = json.loads(content)
        text = lambda x: None if x is None else str(x)
        return [{"board": text(board.get("title")), "bucket": text(t.get("bucket")), "task_id": text(t.get("id")), "title": text(t.get("title")), "notes": text(t.get("notes")), "done": bool(t.get("completed")), "created": text(t.get("created")), "modified": text(t.get("modified"))} for t in board.get("tasks", [])]

    return parsed(spark, folder, "*.json", TASK, parse)


def with_rel(rows: DataFrame, root: str, source: str) -> DataFrame:
    """Rows of a reader with ``rel``, the path below the root; files that are no items of the source, or could not be read, go."""
    from stratica.sources.records import below, wanted

    named = rows.withColumn("rel", below(root, F.col("path"))).drop("path")
    own = named.where(wanted(source, F.col("rel")))
    return own.where("error is null").drop("error") if "error" in rows.columns else own


def chat_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of the pages below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """Chat pages: one row per ``div.msg`` with its place in the page, by built-in functions alone."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    blocks = pages.select("path", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"), F.posexplode(F.slice(F.split("html", r'(?i)(?=<div class="msg")'), 2, 1 << 30)).alias("position", "block"))
    attribute = lambda name: F.nullif(F.regexp_extract("block", f'^<div[^>]*\\b{name}="([^"]*)"', 1), F.lit(""))
    part = lambda name: collapse(strip_html(F.regexp_extract("block", f'(?is)<span class="{name}"[^>]*>(.*?)</span>', 1)))
    body = strip_html(F.regexp_extract("block", r'(?is)<div class="body"[^>]*>(.*)', 1))
    return blocks.select("path", strip_html(F.col("title")).alias("title"), "position", attribute("data-id").alias("message_id"), attribute("data-gone").alias("gone"), part("name").alias("who"), part("time").alias("sent"), body.alias("text"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Names, sizes and times of files; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

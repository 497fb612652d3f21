"""Column functions over times, zones and identifiers of calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of zones that office calendars use, and their zones.
ZONES = {
    "W. Europe Standard Time": "Europe/Berlin",
    "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw",
    "Romance Standard Time": "Europe/Paris",
    "GMT Standard Time": "Europe/London",
    "Greenwich Standard Time": "Etc/UTC",
    "E. Europe Standard Time": "Europe/Chisinau",
    "FLE Standard Time": "Europe/Helsinki",
    "GTB Standard Time": "Europe/Athens",
    "Russian Standard Time": "Europe/Moscow",
    "Turkey Standard Time": "Europe/Istanbul",
    "Eastern Standard Time": "America/New_York",
    "Central Standard Time": "America/Chicago",
    "Mountain Standard Time": "America/Denver",
    "Pacific Standard Time": "America/Los_Angeles",
    "India Standard Time": "Asia/Kolkata",
    "China Standard Time": "Asia/Shanghai",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Singapore Standard Time": "Asia/Singapore",
    "Arabian Standard Time": "Asia/Dubai",
    "Israel Standard Time": "Asia/Jerusalem",
    "South Africa Standard Time": "Africa/Johannesburg",
    "AUS Eastern Standard Time": "Australia/Sydney",
    "E. South America Standard Time": "America/Sao_Paulo",
    "UTC": "Etc/UTC",
}
WRAPPED_UID = "7643616C2D55696401000000"
#: Status words before the subject of answers to invitations.
STATUS_PREFIX = r"(?i)^(abgesagt|canceled|cancelled|angenommen|accepted|abgelehnt|declined|mit vorbehalt|tentative|vorläufig zugesagt|aktualisiert|updated|weitergeleitet|forwarded|zeitvorschlag|new time proposed)\s*:\s*"


def zone(name: Column) -> Column:
    """A zone that Spark knows: the name's own, or that of an office name; null where neither is known."""
    table = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    return F.coalesce(table[name], F.when(name.rlike(r"^[A-Za-z]+/[A-Za-z_+\-/0-9]+$"), name))


def calendar_time(value: Column, tzid: Column, local: str = "UTC") -> Column:
    """The instant of a calendar value: ``20260105``, ``20260105T090000`` in its zone (else ``local``), or with ``Z``; null if it cannot be read."""
    day = F.try_to_timestamp(F.substring(value, 1, 8), F.lit("yyyyMMdd"))
    clock = F.try_to_timestamp(F.left(F.regexp_replace(value, "Z$", ""), F.lit(15)), F.lit("yyyyMMdd'T'HHmmss"))
    own = F.when(value.endswith("Z"), "Etc/UTC").otherwise(F.coalesce(zone(tzid), F.lit(local)))
    return F.when(value.rlike(r"^\d{8}$"), F.to_utc_timestamp(day, F.lit(local))).otherwise(F.to_utc_timestamp(clock, own))


def service_time(value: Column) -> Column:
    """An ISO time of a service, with up to seven decimals of a second; null if it cannot be read."""
    return F.regexp_replace(value, r"(\.\d{6})\d+", "$1").try_cast("timestamp")


def plain_uid(uid: Column) -> Column:
    """An appointment's id in a form that compares: lower case, and unwrapped where a calendar put another's id into its own."""
    own = F.trim(F.coalesce(uid, F.lit("")))
    upper = F.upper(own)
    at = F.locate(WRAPPED_UID, upper)
    # the marker stands on a whole byte, and the inner id ends at the next zero byte
    inner = F.regexp_extract(F.substring(upper, at + len(WRAPPED_UID), F.length(upper)), "^((?:(?!00)..)*)", 1)
    text = F.nullif(F.lower(F.make_valid_utf8(F.unhex(inner).cast("string"))), F.lit(""))  # broken bytes become U+FFFD
    wrapped = upper.rlike("^(?:[0-9A-F]{2})+$") & (at > 0) & (at % 2 == 1)
    return F.when(wrapped, F.coalesce(text, F.lower(own))).otherwise(F.lower(own))


def without_status(subject: Column) -> Column:
    """The subject of an answer to an invitation without its status word."""
    return F.trim(F.regexp_replace(subject, STATUS_PREFIX, ""))


def ancestors(path: Column) -> Column:
    """The path and all folders above it, the shortest first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def shown_end(end: Column, all_day: Column) -> Column:
    """The last day of an all-day appointment, whose end names the day after; other ends as they are."""
    return F.when(all_day, end - F.expr("interval 1 day")).otherwise(end)


def task_state(percent: Column) -> Column:
    """open, started or done, from how much of a task is done."""
    return F.when(percent >= 100, "done").when(percent > 0, "started").when(percent == 0, "open")


def folded(line: Column) -> Column:
    """A calendar line in pieces of at most 74 characters, each continued on the next line behind a blank."""
    return F.regexp_replace(line, "(?s)(.{74})(?=.)", "$1\r\n ")


def escaped(value: Column) -> Column:
    """A text as calendar files write it."""
    return F.regexp_replace(F.regexp_replace(value, r"([\\;,])", r"\\$1"), "\r?\n", r"\\n")


def event_text(uid: Column, title: Column, start: Column, end: Column, rule: Column, place: Column) -> Column:
    """An appointment as the text of a calendar file; times are UTC, and what is null is left out."""
    named = lambda name, value: F.when(value.isNotNull(), folded(F.concat(F.lit(f"{name}:"), value)))
    utc = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    lines = [F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("BEGIN:VEVENT"), named("UID", uid), named("SUMMARY", escaped(title)), named("DTSTART", utc(start)), named("DTEND", utc(end)), named("RRULE", rule), named("LOCATION", escaped(place)), F.lit("END:VEVENT"), F.lit("END:VCALENDAR")]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"))

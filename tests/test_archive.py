"""Readers, recurrences, hierarchies and evidence on small fixtures whose results are known."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.operators import casebook, evidence, feeds, graph, recurrence
from stratica.sources import readers


def dates(spark, rule, start, horizon, tz="Europe/Berlin"):
    series = spark.createDataFrame([("u", datetime.datetime.fromisoformat(start), rule, tz)], "uid string, start timestamp_ntz, rrule string, tz string")
    return [(r.wall, r.at) for r in recurrence.expand(series, horizon).orderBy("wall").select("wall", F.date_format("at", "MM-dd HH:mm").alias("at")).collect()]


@pytest.mark.parametrize(
    ("rule", "start", "horizon", "expected"),
    [
        ("FREQ=WEEKLY;BYDAY=MO,TU,WE,TH,FR;INTERVAL=2", "2026-01-05", "2026-01-25", "01-05 01-06 01-07 01-08 01-09 01-19 01-20 01-21 01-22 01-23"),
        ("FREQ=WEEKLY;BYDAY=SU,MO;INTERVAL=2;WKST=SU", "2026-01-11", "2026-01-26", "01-11 01-12 01-25 01-26"),
        ("FREQ=WEEKLY;BYDAY=SU,MO;INTERVAL=2", "2026-01-11", "2026-01-26", "01-11 01-19 01-25"),
        ("FREQ=MONTHLY;BYMONTHDAY=31", "2026-01-31", "2026-05-31", "01-31 02-28 03-31 04-30 05-31"),
        ("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", "2024-02-29", "2026-12-31", "02-29 02-28 02-28"),
        ("FREQ=MONTHLY;BYDAY=-1FR", "2026-01-30", "2026-03-31", "01-30 02-27 03-27"),
        ("FREQ=MONTHLY;BYDAY=1MO,1TU,1WE,1TH,1FR", "2026-01-01", "2026-03-31", "01-01 02-02 03-02"),
        ("FREQ=DAILY;COUNT=3", "2026-01-01", "2026-03-31", "01-01 01-02 01-03"),
        ("FREQ=DAILY;UNTIL=20260102", "2026-01-01", "2026-03-31", "01-01 01-02"),
        ("FREQ=HOURLY", "2026-01-01", "2026-03-31", "01-01"),
        (None, "2026-01-01", "2026-03-31", "01-01"),
        ("FREQ=DAILY;COUNT=0", "2026-01-01", "2026-01-03", "01-01 01-02 01-03"),
        ("FREQ=MONTHLY;BYDAY=5FR;COUNT=2", "2026-01-02", "2026-12-31", "01-30 05-29"),
    ],
)
def test_recurrence(spark, rule, start, horizon, expected):
    assert " ".join(w.strftime("%m-%d") for w, _ in dates(spark, rule, start, horizon)) == expected


def test_clock_changes(spark):
    found = dates(spark, "FREQ=WEEKLY;BYDAY=MO", "2026-03-16T13:00:00", "2026-04-10")
    assert [at for _, at in found] == ["03-16 12:00", "03-23 12:00", "03-30 11:00", "04-06 11:00"]
    assert dates(spark, "FREQ=DAILY;COUNT=1", "2026-03-29T02:30:00", "2026-04-10")[0][1] == "03-29 01:30"


def test_strip_quoted(spark):
    cases = {
        "new\n\n-----Original Message-----\nold": "new\n\n",
        "hello\r\nFrom: a@x\nTo: b\nSent: today\nold": "hello\n",
        "yes\nOn Monday\nBob wrote:\n> old": "yes\n",
        "gut\nAm 3.4. schrieb Bob <b@x>:\n> alt": "gut\n",
        "text\n-- \nBob": "text\n",
        "-- \nall signature": "-- \nall signature",
        "a\n > quoted\nb": "a\n\nb",
        "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select(mail.strip_quoted(F.col("a")).alias("got"), "b").collect()
    assert [r.got for r in rows] == [r.b for r in rows]


def test_thread_key(spark):
    import base64

    index = base64.b64encode(bytes(range(27))).decode()
    rows = spark.createDataFrame([(index, "<A@x>", None, None), ("AAAA", "<A@x> <b>", None, None), (None, None, "<R@x>", "<o>"), (None, None, None, "<Own@X>"), (None, None, None, None)], "a string, b string, c string, d string")
    found = [r[0] for r in rows.select(mail.thread_key(*map(F.col, "abcd"))).collect()]
    assert found == ["tix:" + bytes(range(22)).hex(), "mid:a@x", "mid:r@x", "mid:own@x", ""]


def test_readers(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: Carla <Carla@X.example>\r\nTo: a@y.example, A <a@y.example>\r\nDate: Tue, 10 Jun 2025 08:00:00 +0000\r\nSubject: Rechnung\r\nMessage-ID: <m@x>\r\nContent-Type: text/html\r\n\r\n<p>Hallo <b>du</b></p>")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "b.json").write_text('{"title": "Board", "tasks": [{"id": 1, "title": "T", "completed": true}]}')
    (tmp_path / "c.ics").write_bytes(b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Long\\, na\r\n me\r\nDTSTART;TZID=Europe/Berlin:20260105T090000\r\nRRULE:FREQ=DAILY\r\nBEGIN:VALARM\r\nSUMMARY:no\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    (tmp_path / "d.vcf").write_bytes(b"BEGIN:VCARD\r\nN:Doe;Jo;;;\r\nEMAIL;TYPE=work:jo@x\r\nitem1.EMAIL:j@y\r\nORG:Acme;Lab\r\nEND:VCARD\r\n")
    (tmp_path / "e.html").write_text('<h1>Chat</h1><div class="msg" data-id="7"><span class="name">Bob</span><span class="time">09:30</span><div class="body"><p>hi\n there</p></div></div><div class="msg" data-id="8" data-gone="x"><div class="body"></div></div>')
    folder = f"file://{tmp_path}"
    m = readers.mails(spark, folder).first()
    assert (m.who, m.who_mail, m.to, m.title, m.body, m.error) == ("Carla", "carla@x.example", "a@y.example|a@y.example", "Rechnung", "Hallo du", None)
    e = readers.calendars(spark, folder).first()
    assert (e.uid, e.title, e.start, e.tz, e.all_day, e.rrule) == ("u1", "Long, name", "20260105T090000", "Europe/Berlin", False, "FREQ=DAILY")
    c = readers.contacts(spark, folder).first()
    assert (c.name, c.org, c.mails) == ("Jo Doe", "Acme, Lab", "jo@x|j@y")
    tasks = readers.boards(spark, folder).collect()
    assert sorted((r.board, r.done, r.error is not None) for r in tasks if r.error is None) == [("Board", True, False)] and sum(r.error is not None for r in tasks) == 1
    chat = readers.chats(spark, folder).orderBy("position").collect()
    assert [(r.title, r.message_id, r.gone, r.who, r.sent, r.text) for r in chat] == [("Chat", "7", None, "Bob", "09:30", "hi there"), ("Chat", "8", "x", "", "", "")]
    assert readers.files(spark, folder).count() == 6


def test_circles_and_totals(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (9, 9)], "id long, boss long")
    left = graph.cut_circles(edges, "id", "boss")
    assert sorted(tuple(r) for r in left.collect()) == [(2, 3), (3, 1), (4, 3), (5, 4)]
    assert {r.above: r.n for r in graph.totals(graph.closure(left, "id", "boss")).collect()} == {1: 4, 3: 3, 4: 1}


def test_sweep(spark):
    schema = "rel string, size long, mtime_ns long, sha256 string"
    disk = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 1, 2, "a"), ("ours", 2, 2, "b"), ("quiet", 1, 1, "q2"), ("theirs", 2, 2, "c"), ("new", 1, 1, "n"), ("to", 1, 1, "m"), ("back", 1, 1, "k"), ("versions/ours/1", 1, 1, "a")], schema)
    index = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 1, 1, "a"), ("ours", 1, 1, "a"), ("quiet", 1, 1, "q1"), ("theirs", 1, 1, "a"), ("gone", 1, 1, "g"), ("dropped", 1, 1, "d"), ("from", 1, 1, "m")], schema)
    lines = [(1, "write", "ours", "z", None), (2, "write", "ours", "b", None), (3, "write", "quiet", "q2", None), (4, "removed", "dropped", None, None), (5, "moved", "from", None, "to"), (6, "removed", "back", None, None), (7, "write", "back", "k", None)]
    journal = spark.createDataFrame(lines, "seq long, op string, rel string, sha256 string, other string")
    found = {r.rel: (r.state, r.source) for r in evidence.sweep(disk, index, journal).collect()}
    states = {"same": "unchanged", "touched": "refreshed", "ours": "write", "quiet": "write", "theirs": "outside", "new": "outside", "back": "write", "versions/ours/1": "version", "gone": "missing", "dropped": "removed", "from": "removed"}
    assert found == {**{k: (v, None) for k, v in states.items()}, "to": ("moved", "from")}
    first = {r.rel: r.state for r in evidence.sweep(disk, index.where("false"), journal.where("false"), first_run=True).collect()}
    assert set(first.values()) == {"initial", "version"}


def test_cases(spark):
    items = spark.createDataFrame([(1, "a", "2020")], "case_id long, key string, added string")
    new = spark.createDataFrame([(1, "a", "2021"), (1, "b", "2022"), (1, "b", "2021"), (2, "c", "2021")], "case_id long, key string, added string")
    cases = spark.createDataFrame([(1, "One", "open"), (2, "Two", "closed")], "id long, name string, status string")
    assert sorted(tuple(r) for r in casebook.add_items(items, new, cases).collect()) == [(1, "a", "2020"), (1, "b", "2021")]
    both = spark.createDataFrame([(2, "a"), (1, "a")], "case_id long, key string")
    assert casebook.membership(new, both, cases).first().cases == "One, Two"


def test_merge_and_fold(spark):
    store = spark.createDataFrame([("1", "a", 1, None, []), ("2", "b", 5, None, ["x"])], "id string, body string, modified int, deleted string, earlier array<string>")
    batch = spark.createDataFrame([("1", "c", 2, None), ("2", "old", 4, None), ("3", "n", 1, None)], "id string, body string, modified int, deleted string")
    assert {r.id: (r.body, r.earlier) for r in feeds.merge_messages(store, batch).collect()} == {"1": ("c", ["a"]), "2": ("b", ["x"]), "3": ("n", [])}
    gone = spark.createDataFrame([("1", None, 9, "now")], "id string, body string, modified int, deleted string")
    assert feeds.merge_messages(store, gone).where("id = '1'").first()[1:4] == ("a", 9, "now")
    feed = spark.createDataFrame([("u", 1, False, {"t": "a", "d": "x"}), ("u", 2, False, {"d": None}), ("v", 1, False, {"t": "q"}), ("v", 2, True, {})], "id string, nr long, removed boolean, fields map<string,string>")
    assert sorted(tuple(r) for r in feeds.fold_fields(feed, "id", "nr", "removed", "fields").collect()) == [("u", "d", None), ("u", "t", "a")]

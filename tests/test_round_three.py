"""Items of the four large sources from files to search, index segments, stored changes, closures and repaired rules."""

from __future__ import annotations

import datetime
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratica.archive import Archive
from stratica.functions import mail, times
from stratica.operators import evidence, graph, postings, recurrence, search
from stratica.sources import item_records, readers, records, store


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr("stratica.archive.BUCKETS", 4)


UNTIL = [
    ("2026-01-05 09:00:00", "Europe/Berlin", "FREQ=DAILY;UNTIL=20260110T080000Z", "05 06 07 08 09 10"),
    ("2026-01-05 09:00:00", "Europe/Berlin", "FREQ=DAILY;UNTIL=20260110T075959Z", "05 06 07 08 09"),
    ("2026-01-15 00:30:00", "America/New_York", "FREQ=DAILY;UNTIL=20260119T010000Z", "15 16 17 18"),
    ("2026-01-15 23:30:00", "America/New_York", "FREQ=DAILY;UNTIL=20260119T043000Z", "15 16 17 18"),
    ("2026-01-05 23:30:00", "Pacific/Auckland", "FREQ=WEEKLY;BYDAY=MO,TU;UNTIL=20260113T103000Z", "05 06 12 13"),
    ("2026-01-05 09:00:00", "UTC", "FREQ=DAILY;UNTIL=20260107", "05 06 07"),
]


def test_until_is_an_instant(spark):
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(UNTIL)], "k int, s string, tz string, rrule string").withColumn("start", F.col("s").cast("timestamp_ntz"))
    found = {k: [] for k in range(len(UNTIL))}
    for r in recurrence.expand(rows, "2026-02-28").select("k", "wall").orderBy("wall").collect():
        found[r.k].append(f"{r.wall:%d}")
    assert [" ".join(found[k]) for k in found] == [x[3] for x in UNTIL]


def test_broken_bytes(spark, tmp_path):
    one = lambda column: spark.range(1).select(column).first()[0]
    blob = (b"\x04\x00" * 8 + b"vCal-Uid\x01\x00\x00\x00" + b"a\xff\xc3b@x" + b"\x00rest").hex().upper()
    assert one(times.plain_uid(F.lit(blob))) == "a��b@x"
    (tmp_path / "t.txt").write_bytes("aé€".encode())
    windows = {n: records.file_window(spark, f"{tmp_path}/t.txt", 0, n).first() for n in (1, 2, 3, 4, 99)}
    assert [(w.text, w.truncated) for w in windows.values()] == [("a", True), ("a�", True), ("aé", True), ("aé�", True), ("aé€", False)]


def test_address_list(spark):
    line = '"Chef, Carla" <Carla@X.example>, bob@y.example; Dana <d@z>, <only@w>'
    found = spark.range(1).select(mail.address_list(F.lit(line))).first()[0]
    assert [tuple(x) for x in found] == [("Chef, Carla", "Carla@X.example"), ("", "bob@y.example"), ("Dana", "d@z"), ("", "only@w")]
    assert spark.range(1).select(mail.address_list(F.lit(None).cast("string"))).first()[0] == []


# the store


def files_below(folder: Path) -> int:
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_changes_touch_their_buckets(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    rows = spark.range(20_000).select("id", F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    store.write_version(base, {"people": spark.createDataFrame([("a",)], "who string")}, ready={"items": store.stage(base, "items", rows, "id", 128)})
    before, old = files_below(tmp_path), store.read_table(spark, base, "items")
    change = rows.where(store.bucket_of(F.col("id"), 128) == 7).withColumn("t", F.lit("new"))
    gone = rows.where(store.bucket_of(F.col("id"), 128) == 9).limit(3)
    n_gone = gone.persist().count()
    number = store.merged(base, "items", change, gone, "id", "cursor 1")
    assert files_below(tmp_path) - before < 0.03 * before
    now = store.read_table(spark, base, "items")
    assert now.count() == 20_000 - n_gone and now.where("t = 'new'").count() == change.count()
    assert store.read_table(spark, base, "people").first()[0] == "a" and store.read_table(spark, base, "items_pointer").first()[0] == "cursor 1"
    assert old.count() == 20_000  # a reader that began before the change reads on
    expected = sorted(map(tuple, now.collect()))
    store.merged(base, "items", change, gone, "id", "cursor 1")
    assert sorted(map(tuple, store.read_table(spark, base, "items").collect())) == expected
    with pytest.raises(store.StoreChanged):
        store.change(spark, base, lambda info: info, seen=number)
    Path(tmp_path / "store/manifests" / f"{number + 5:012d}.json").write_text('{"version": ')  # a writer that died
    assert store.read_table(spark, base, "items").count() == len(expected)
    assert store.merged(base, "items", change, gone, "id") == number + 6
    store.merged(base, "items", rows.where("false"), store.read_table(spark, base, "items"), "id")
    assert store.read_table(spark, base, "items").count() == 0


# closures


def test_closure_of_a_long_chain(spark):
    began = time.time()
    edges = spark.range(2_000).select("id", (F.col("id") + 1).alias("up"))
    found = graph.closure(edges, "id", "up")
    assert found.count() == 2_000 * 2_001 // 2
    assert found.where("above - node <> distance").isEmpty()
    assert time.time() - began < 60


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 700)]
    rows = [(3, 1), (1, 9), (9, 3), (20, 21), (22, 21), (50, 50), (None, 4), *chain, *[(1000, k) for k in range(1001, 1200)]]
    found = dict(map(tuple, graph.components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()))
    assert {k: found[k] for k in (1, 3, 9, 20, 21, 22, 50)} == {1: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20, 50: 50}
    assert {found[k] for k in range(100, 701)} == {100} and {found[k] for k in range(1000, 1200)} == {1000} and 4 not in found
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_names_follow_moves(spark):
    moves = spark.createDataFrame([("moved", "a", "b"), ("moved", "b", "c"), ("removed", "x", "c"), (None, "q", "r")], "kind string, rel string, other string")
    assert sorted(tuple(r) for r in evidence.names_of(moves).where("rel in ('a', 'x')").collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "x"), ("x", "x")]
    assert sorted(tuple(r) for r in evidence.file_classes(moves).collect()) == [("a", "a"), ("b", "a"), ("c", "a")]


# the index


def test_index_answers_like_all_texts(spark):
    rows = [("a#0", "Rechnung 4711", "bitte freigegeben", "plan.pdf"), ("b#0", "4711", "die Rechnung", None), ("c#0", None, "nichts", "rechnung.docx"), ("d#0", "x", "Rechnung 4711 und Urlaub, Rechnung", "")]
    chunks = spark.createDataFrame(rows, "cid string, title string, text string, att string")
    index = postings.Index(**postings.segment(chunks, 0))
    found = lambda q: {r.cid: round(r.score, 6) for r in postings.scores(index, q).collect()}
    plain = lambda q: {r.cid: round(r.score, 6) for r in search.lexical(chunks, q).collect()}
    for wanted in ("rechnung", '"Rechnung 4711"', '"Rechnung 4711" urlaub', "die nichts", '"4711"', "...!!!", "absent"):
        assert found(wanted) == plain(wanted), wanted
    assert set(found('"4711 Rechnung"')) == set() and set(found('"4711 bitte"')) == set()


# files to search


def write(root: Path, name: str, text: str) -> None:
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(text.replace("\n", "\r\n").encode() if not name.endswith("html") else text.encode())


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("export")
    outlook, teams = root / "outlook", root / "teams"
    write(outlook, "E-Mail/Kunden/1.eml", 'From: "Chef, Carla" <Carla@X.example>\nTo: Alice <alice@own.example>, bob@own.example\nCc: Dana <d@z.example>\nDate: Tue, 10 Jun 2025 08:00:00 +0000\nSubject: Rechnung 4711\nMessage-ID: <m1@x>\nContent-Type: text/plain\n\nBitte freigeben.\n\n-----Original Message-----\n> alter Text\n')
    write(outlook, "2.eml", "From: alice@own.example\nTo: Carla <carla@x.example>\nDate: irgendwann\nReferences: <m1@x>\nContent-Type: text/plain\n\n> nur Zitat\n")
    write(outlook, "_fremd/3.eml", "From: z@z\n\nnein\n")
    write(outlook, "kalender/Arbeit/e.ics", "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:u1\nSUMMARY:Runde\nLOCATION:Raum 1\nDESCRIPTION:Planung\\, lang\nORGANIZER;CN=Alice:mailto:alice@own.example\nATTENDEE;CN=Bob:MAILTO:bob@own.example\nDTSTART;TZID=W. Europe Standard Time:20260105T090000\nRRULE:FREQ=WEEKLY;UNTIL=20260126T080000Z\nEXDATE;TZID=W. Europe Standard Time:20260112T090000\nEND:VEVENT\nBEGIN:VEVENT\nUID:u1\nRECURRENCE-ID;TZID=W. Europe Standard Time:20260119T090000\nSUMMARY:Runde\nLOCATION:Keller\nDTSTART;TZID=W. Europe Standard Time:20260120T100000\nEND:VEVENT\nEND:VCALENDAR\n")
    write(outlook, "kalender/Arbeit/two.ics", "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:u2\nDTSTART;VALUE=DATE:20260301\nEND:VEVENT\nBEGIN:VEVENT\nUID:u3\nSUMMARY:Drei\nDTSTART:20260302T100000Z\nEND:VEVENT\nEND:VCALENDAR\n")
    write(outlook, "kontakte/Team/c.vcf", "BEGIN:VCARD\nUID:c1\nN:Doe;Jo;;;\nORG:Acme;Lab\nTITLE:Lead\nEMAIL:jo@x.example\nTEL:+49 30 1234567\nNOTE:mag Tee\nEND:VCARD\n")
    message = lambda i, who, time_, body, more="": f'<div class="msg" data-id="{i}"{more}><span class="name">{who}</span><span class="time">{time_}</span><div class="body">{body}</div></div>'
    write(teams, "1on1/alice__7.html", "<h1>Alice &amp; Bob</h1>" + message("7", "Alice", "2025-06-01 09:30", "<p>Hallo</p><h1>Kopf</h1>") + message("8", "Bob", "2025-06-01 09:35", "<img src='x'>") + message("9", "", "kaputt", "Rechnung  4711 ist da", ' data-gone="2025-07-01"'))
    write(teams, "search.html", "<h1>no</h1>" + message("1", "No", "2025-06-01 09:30", "no"))
    return f"file://{outlook}", f"file://{teams}"


def test_mail_items(spark, folders):
    rows = {r.rel: r for r in item_records.mail_items(readers.with_rel(readers.mails(spark, folders[0]), folders[0], "outlook")).collect()}
    assert set(rows) == {"E-Mail/Kunden/1.eml", "2.eml"}
    one, two = rows["E-Mail/Kunden/1.eml"], rows["2.eml"]
    assert (one.uid, one.key, one.who, one.who_mail, one.ctx, one.text, one.title, one.date) == ("outlook:E-Mail/Kunden/1.eml:0", "mail:<m1@x>", "Chef, Carla", "carla@x.example", "E-Mail/Kunden", "Bitte freigeben.", "Rechnung 4711", "2025-06-10 08:00")
    assert (one.to_ppl, one.cc_ppl, one.bcc_ppl, one.domains, one.thread) == ("alice alice@own.example bob@own.example", "dana d@z.example", "", "own.example x.example z.example", "mid:m1@x")
    assert one.ppl == "chef, carla carla@x.example alice alice@own.example bob@own.example dana d@z.example"
    assert (two.key, two.who, two.ctx, two.title, two.text, two.ts, two.date, two.thread) == (None, "alice@own.example", "(Stamm)", "(kein Betreff)", "> nur Zitat", None, "irgendwann", "mid:m1@x")


def test_chat_items(spark, folders):
    rows = item_records.chat_items(readers.with_rel(readers.chat_pages(spark, folders[1]), folders[1], "teams")).orderBy("uid").collect()
    assert [(r.uid[-2:], r.msg_id, r.who, r.text, r.gone) for r in rows] == [(":0", "7", "Alice", "Hallo Kopf", None), (":1", "9", "(unbekannt)", "Rechnung 4711 ist da", "2025-07-01"), (":2", "8", "Bob", "", None)]
    assert {(r.title, r.ctx, r.thread) for r in rows} == {("Alice & Bob", "1on1", "chat:1on1/alice__7.html")}
    assert [r.ts for r in rows] == [datetime.datetime(2025, 6, 1, 9, 30), None, datetime.datetime(2025, 6, 1, 9, 35)] and rows[0].ppl == "alice alice & bob"


def test_event_and_contact_items(spark, folders):
    found = item_records.event_items(readers.with_rel(readers.calendars(spark, folders[0]), folders[0], "kalender"))
    rows = {r.uid: r for r in found.collect()}
    assert set(rows) == {"kalender:kalender/Arbeit/e.ics:0", "kalender:kalender/Arbeit/two.ics:0", "kalender:kalender/Arbeit/two.ics:1"}
    one = rows["kalender:kalender/Arbeit/e.ics:0"]
    assert (one.key, one.who, one.who_mail, one.ctx, one.title, one.text, one.date) == ("event:u1", "Alice", "alice@own.example", "kalender/Arbeit", "Runde", "Ort: Raum 1. Planung, lang\nKeller", "2026-01-05 08:00")
    assert one.ppl == "alice alice@own.example bob bob@own.example" and one.domains == "own.example"
    series = json.loads(one.series)
    assert series["exdates"] == [{"value": "20260112T090000", "tzid": "W. Europe Standard Time"}] and series["ex"][0]["rid"] == "20260119T090000"
    two, three = rows["kalender:kalender/Arbeit/two.ics:0"], rows["kalender:kalender/Arbeit/two.ics:1"]
    assert (two.title, two.who, two.date, two.series, three.key, three.title) == ("(kein Betreff)", "(unbekannt)", "2026-03-01", None, "event:u3", "Drei")
    dates = sorted(r.ts for r in item_records.series_dates(found, "2026-12-31").collect())
    assert dates == [datetime.datetime(2026, 1, 5, 8), datetime.datetime(2026, 1, 20, 9), datetime.datetime(2026, 1, 26, 8)]
    card = item_records.contact_items(readers.with_rel(readers.contacts(spark, folders[0]), folders[0], "kontakte")).first()
    assert (card.key, card.title, card.who, card.ctx, card.text, card.ppl, card.ts) == ("contact:c1", "Jo Doe", "Acme · Lab", "kontakte/Team", "Acme · Lab · Lead · jo@x.example · +49 30 1234567 · mag Tee", "jo doe jo@x.example", None)


def test_archive_of_folders(spark, folders, tmp_path):
    base = f"file://{tmp_path}/store"
    archive = Archive.of_folders(spark, base, *folders, horizon="2026-12-31")
    hits = archive.search_messages('"Rechnung 4711"').collect()
    assert {h.uid for h in hits} == {"outlook:E-Mail/Kunden/1.eml:0", "teams:1on1/alice__7.html:1"}
    both = {h.uid: h.score for h in archive.search_messages("Rechnung 4711").collect()}
    narrowed = {h.uid: h.score for h in archive.search_messages("Rechnung 4711", search.Criteria(source="outlook")).collect()}
    assert narrowed.items() <= both.items() and len(narrowed) == 1 and len(both) == 2
    assert archive.search_messages("rechnung", search.Criteria(mail_cc="dana", party="external", own_domains=("own.example",))).count() == 1
    moved = archive.search_messages("keller", search.Criteria(date_from="2026-01-20", date_to="2026-01-20")).first()
    assert moved.uid == "kalender:kalender/Arbeit/e.ics:0" and moved.eff == datetime.datetime(2026, 1, 20, 9)
    assert archive.search_messages("keller", search.Criteria(date_from="2026-01-12", date_to="2026-01-12")).count() == 0
    assert [r.ts is None for r in archive.browse_messages().collect()][-2:] == [True, True]
    assert archive.lookup_contact("jo@x").first().phones == ["+49 30 1234567"]
    assert [r.month for r in archive.search_timeline("rechnung").collect()] == ["2025-06", "-"]
    assert {r.src: r.n for r in archive.search_facets("rechnung")["src"].collect()} == {"outlook": 1, "teams": 1}
    with pytest.raises(ValueError):
        archive.search_messages("x", mode="other")


def test_archive_updates(spark, folders, tmp_path):
    base = f"file://{tmp_path}/store"
    archive = Archive.of_folders(spark, base, *folders)
    rows = archive.chunks.where("uid = 'teams:1on1/alice__7.html:1'").drop("cid", "seq", "hash", "ext", "msg_idx").withColumn("text", F.lit("jetzt anders"))
    gone = spark.createDataFrame([("outlook:2.eml:0",)], "uid string")
    for _ in range(2):
        archive.update(rows, gone)
        assert archive.search_messages("rechnung").count() == 1 and archive.search_messages("anders").first().uid == "teams:1on1/alice__7.html:1"
        assert archive.chunks.where("uid = 'outlook:2.eml:0'").count() == 0
    fresh = Archive.build(f"file://{tmp_path}/again", [archive.chunks.drop("cid", "seq", "hash", "ext", "msg_idx")])
    for wanted in ("rechnung", "anders", "4711 bitte"):
        scores = [{h.uid: h.score for h in a.search_messages(wanted).collect()} for a in (archive, fresh)]
        assert scores[0] == scores[1]
    assert archive.table("people").count() > 0


def test_vectors_by_content(spark, tmp_path):
    base, log = f"file://{tmp_path}/store", tmp_path / "asked"
    log.mkdir()

    def embedder(texts: list[str]) -> list[list[float]]:
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    def asked() -> list[str]:
        found = sorted(line for f in log.iterdir() for line in f.read_text().split("\n"))
        for f in log.iterdir():
            f.unlink()
        return found

    def rows(*texts: str):
        data = [(f"u{k}:0", "pages", "pages", f"r{k}", "T", t) for k, t in enumerate(texts)]
        return spark.createDataFrame(data, "uid string, src string, root string, rel string, title string, text string").withColumns({c: F.lit(None).cast("string") for c in ("who", "ppl", "att", "who_mail", "to_ppl", "cc_ppl", "bcc_ppl")})

    long = "words enough to mean something in a search, number "
    archive = Archive.build(base, [rows(long + "1", long + "2", long + "2", "short")])
    archive.embed(embedder, 2, buckets=4)
    assert asked() == [f"T {long}1", f"T {long}2"]
    joined = archive.vectors_of_chunks()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert {r.cid: list(r.embedding)[1] for r in joined.collect()} == {"u0:0#0": 1.0, "u1:0#0": 1.0, "u2:0#0": 1.0, "u3:0#0": 0.0}
    archive = Archive.build(base, [rows(long + "3", long + "2")])  # a rebuild
    archive.embed(embedder, 2, buckets=4)
    assert asked() == [f"T {long}3"] and archive.vectors_of_chunks().count() == 2
    assert {r.retired for r in archive.table("hash_vectors").where("embedding[1] = 1").collect()} == {True, False}
    archive = Archive.build(base, [rows(long + "1")])  # what was gone comes back
    archive.embed(embedder, 2, buckets=4)
    assert asked() == [] and archive.vectors_of_chunks().count() == 1


def test_one_user_with_most_rows(spark):
    """Sessions, rates and folded histories by buckets of time: as over whole users, and no task gets most rows."""
    import random

    from pyspark.sql import Window

    from stratica.operators import casebook, facets

    rng = random.Random(8)
    first = datetime.datetime(2024, 1, 1)
    times_ = sorted(rng.randrange(40 * 86_400) for _ in range(4000))
    rows = [(1 if k % 10 else rng.randrange(2, 9), k, first + datetime.timedelta(seconds=s), rng.choice("ab")) for k, s in enumerate(times_)]
    rows += [(1, 9000, first + datetime.timedelta(days=10), "a"), (1, 9001, first + datetime.timedelta(days=10), "a"), (3, 9002, None, "b")]
    events = spark.createDataFrame(rows, "user int, id int, ts timestamp, kind string").persist()
    timed = [r for r in rows if r[2] is not None]
    for gap, bucket in ((600, 86_400), (7_200, 3_600), (200_000, 3_600)):
        runs = []
        for user in range(1, 9):
            own = sorted(r[2] for r in timed if r[0] == user)
            for t in own:
                if runs and runs[-1][0] == user and (t - runs[-1][2]).total_seconds() <= gap:
                    runs[-1][2:] = [t, runs[-1][3] + 1]
                else:
                    runs.append([user, t, t, 1])
        assert sorted(tuple(r) for r in facets.islands(events, "user", "ts", gap, bucket).collect()) == sorted(map(tuple, runs))
    plain = events.withColumn("us", F.unix_micros("ts")).withColumn("n", F.count("us").over(Window.partitionBy("user").orderBy("us").rangeBetween(-3_600_000_000, 0)))
    assert sorted((r.id, r.n) for r in casebook.rate(events, "user", "ts", 3600).collect()) == sorted((r.id, r.n) for r in plain.collect())
    order = [F.col("ts"), F.col("id")]
    whole, dealt = (sorted(tuple(r) for r in casebook.fold_history(events, "user", order, "kind", ts).select("user", "id", "kind").collect()) for ts in (None, "ts"))
    assert whole == dealt and whole
    sizes = [r["n"] for r in events.where("ts is not null").repartition(8, "user", facets.time_bucket(F.unix_micros("ts"), facets.DAY)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_facts_of_each_kind(spark, folders):
    from stratica.operators import detail

    found = lambda df: {r.uid: json.loads(r.facts) for r in df.collect()}
    mails = readers.with_rel(readers.mails(spark, folders[0]), folders[0], "outlook")
    facts = found(detail.mail_facts(item_records.mail_items(mails), mails))["outlook:E-Mail/Kunden/1.eml:0"]
    assert facts == {"from": {"name": "Chef, Carla", "mail": "carla@x.example"}, "to": [{"name": "Alice", "mail": "alice@own.example"}, {"name": "", "mail": "bob@own.example"}], "cc": [{"name": "Dana", "mail": "d@z.example"}], "bcc": [], "date": "2025-06-10 08:00", "folder": "E-Mail/Kunden", "attachments": []}
    events = readers.with_rel(readers.calendars(spark, folders[0]), folders[0], "kalender")
    facts = found(detail.event_facts(item_records.event_items(events), events))
    assert facts["kalender:kalender/Arbeit/e.ics:0"] == {"start": "2026-01-05 08:00", "end": "", "allday": False, "location": "Raum 1", "organiser": {"name": "Alice", "mail": "alice@own.example"}, "attendees": [{"name": "Bob", "mail": "bob@own.example"}], "calendar": "kalender/Arbeit"}
    assert facts["kalender:kalender/Arbeit/two.ics:0"]["allday"] and facts["kalender:kalender/Arbeit/two.ics:0"]["start"] == "2026-03-01"
    cards = readers.with_rel(readers.contacts(spark, folders[0]), folders[0], "kontakte")
    assert found(detail.contact_facts(item_records.contact_items(cards), cards)) == {"kontakte:kontakte/Team/c.vcf:0": {"org": "Acme · Lab", "role": "Lead", "emails": ["jo@x.example"], "phones": ["+49 30 1234567"], "note": "mag Tee", "folder": "kontakte/Team"}}
    items_ = spark.createDataFrame([("planner:B/t1:0", "planner", "Plan/Neu", "x · y", "a_b.pdf"), ("todo:L/t2:0", "todo", "Liste", "", None), ("todo:L/t3:0", "todo", "Liste", "", None)], "uid string, src string, ctx string, who string, att string")
    board = {"task": {"dueDateTime": "2026-02-03T00:00:00Z", "percentComplete": 50, "assignments": {"p1": {}, "p9": {}}}, "details": {"checklist": {"a": {"isChecked": True}, "b": {"isChecked": False}}}, "kommentare": [{"wer": "p1", "wann": "2026", "html": "<b>gut</b>"}]}
    todo = {"task": {"dueDateTime": {"dateTime": "2026-02-05T00:00:00", "timeZone": "UTC"}, "status": "inProgress", "checklistItems": [{"isChecked": True}], "linkedResources": [{"applicationName": "app"}]}}
    tasks = spark.createDataFrame([("planner", "t1", json.dumps(board)), ("todo", "t2", json.dumps(todo))], "src string, task_id string, entry string")
    facts = found(detail.task_facts(items_, tasks, spark.createDataFrame([("p1", "Greta")], "id string, name string")))
    assert facts["planner:B/t1:0"] == {"plan": "Plan", "bucket": "Neu", "assigned": ["Greta", "p9"], "due": "2026-02-03", "state": "inprogress", "checklist": {"done": 1, "total": 2}, "attachments": ["a_b.pdf"], "comments": [{"who": "Greta", "when": "2026", "text": "gut"}]}
    assert (facts["todo:L/t2:0"]["due"], facts["todo:L/t2:0"]["state"], facts["todo:L/t2:0"]["steps"], facts["todo:L/t2:0"]["linked"]) == ("2026-02-05", "inprogress", {"done": 1, "total": 1}, ["app"])
    assert facts["todo:L/t3:0"]["state"] == "" and facts["todo:L/t3:0"]["due"] == ""

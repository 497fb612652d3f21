"""Readers of items, versioned stores, evidence files, and functions whose results are known."""

from __future__ import annotations

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stratica.archive import Archive
from stratica.functions import mail, times
from stratica.functions import text as tx
from stratica.operators import calendar, casebook, evidence, facets, feeds, items, reconcile, search
from stratica.sources import records, store
from stratica.streaming import windows


def test_pieces():
    words = " ".join(f"wort{k}" for k in range(200))
    parts = items.pieces(words, 120, 30)
    assert all(len(p) <= 120 and p in words for p in parts) and len(parts) > 10
    assert all(b[:8] in a for a, b in zip(parts, parts[1:], strict=False))
    assert items.pieces("  x ") == ["x"] and items.pieces(" \n") == [] and items.pieces(None) == []
    assert len(items.pieces("x" * 4000)) == 3
    assert items.joined(["abcdef", "defghi", "xyz"]) == "abcdefghixyz" and items.joined([]) == ""


def test_chunks_of_items_without_words(spark):
    rows = spark.createDataFrame([("o:1", "outlook", "a", " "), ("p:1", "pages", "b", ""), ("t:1", "teams", "c", ""), ("t:2", "teams", "c", None), ("t:3", "teams", "d", ""), ("t:4", "teams", "d", "x y")], "uid string, src string, rel string, text string")
    found = items.chunked(rows.withColumns({"root": F.col("src"), "att": F.lit("n.pdf")}))
    assert sorted((r.uid, r.seq, r.text) for r in found.collect()) == [("o:1", 0, ""), ("t:1", 0, ""), ("t:4", 0, "x y")]
    long = " ".join(f"w{k}" for k in range(3000))
    one = items.chunked(spark.createDataFrame([("u", "outlook", "outlook", "r", "a.pdf", long)], "uid string, src string, root string, rel string, att string, text string"))
    assert [r.att for r in one.orderBy("seq").collect()] == ["a.pdf"] + [None] * (one.count() - 1)
    assert items.whole_texts(one).first().text == long


def test_names_times_and_ids(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(mail.attachment_names(F.lit("a b.pdf | c|"))) == ["a b.pdf", "c"]
    assert one(mail.attachment_names(F.lit("My file.pdf other.x notes"))) == ["My file.pdf", "other.x", "notes"]
    assert one(mail.extensions(F.lit("My file.PDF other.tar.gz no.dot-final"))) == "gz pdf"
    assert one(mail.short_hash(F.lit("x"))) == hashlib.sha1(b"x").hexdigest()[:8]
    assert one(mail.phones(F.lit("call +49 (30) 123-4567 or 12345, 030/7654321"))) == ["+49 (30) 123-4567", "030/7654321"]
    inner = b"Google-1@x"
    blob = (b"\x04\x00" * 8 + b"vCal-Uid\x01\x00\x00\x00" + inner + b"\x00rest").hex().upper()
    assert one(times.plain_uid(F.lit(blob))) == "google-1@x" and one(times.plain_uid(F.lit(" ABC@x "))) == "abc@x" and one(times.plain_uid(F.lit("0a0b" * 20))) == "0a0b" * 20
    assert one(times.service_time(F.lit("2024-05-01T10:00:00.1234567Z"))).microsecond == 123456 and one(times.service_time(F.lit("soon"))) is None
    at = lambda v, z: one(times.calendar_time(F.lit(v), F.lit(z)).cast("string"))
    assert at("20260105T090000", "W. Europe Standard Time") == "2026-01-05 08:00:00" and at("20260705T090000", "Europe/Berlin") == "2026-07-05 07:00:00"
    assert at("20260105T090000Z", "x") == "2026-01-05 09:00:00" and at("20260105", None) == "2026-01-05 00:00:00" and at("later", None) is None
    assert one(times.without_status(F.lit("Abgesagt: Runde"))) == "Runde"
    assert one(tx.unescape(F.lit("&amp;lt; &#228;&#x20AC; &#0; &unknown; &#99999999;"))) == "&lt; ä€ � &unknown; &#99999999;"
    assert one(tx.snippet(F.lit("a" * 100 + " Wort here"), ["wort"], 20)) == "…aaaa Wort here"[:20] and one(tx.snippet(F.lit("short Wort"), ["wort"], 20)) == "…hort Wort" and one(tx.snippet(F.lit("Wort one"), ["wort"], 4)) == "Wort" and one(tx.snippet(F.lit(None).cast("string"), ["x"], 9)) is None
    assert one(tx.strip_html(F.lit("<script>a</style>b</script>c<!-- d -->&euro;"))) == "c €"


def test_windows_of_days():
    today = datetime.date(2025, 3, 2)
    assert search.window(None, None, 7, today) == ("2025-02-24", "2025-03-02") and search.window("2025-01-01", None, 7, today) == ("2025-01-01", None)
    assert search.window(None, None, "x", today) == (None, None) and search.window(None, None, 0, today) == (None, None)
    with pytest.raises(ValueError):
        search.window("2021-06-31", None, None, today)
    assert search.pool_size(0, 12) == 100 and search.pool_size(90, 10) == 500 and search.pool_size(9000, 10) == 1000


def test_search_and_pages(spark):
    rows = spark.createDataFrame([("c1", "u1", "Invoice 4711", "please pay"), ("c2", "u1", "more", "invoice 4711 again invoice"), ("c3", "u2", "holiday", "nothing"), ("c4", "u3", "x", "the Invoice: 4711!")], "cid string, uid string, title string, text string")
    none = {c: F.lit(None).cast("string") for c in ("root", "rel", "att", "who", "gone", "ctx", "domains", "ext", "ppl")}
    chunks = rows.withColumns({**none, "src": F.lit("outlook"), "seq": F.lit(0), "ts": F.lit("2025-01-01").cast("timestamp_ntz")})
    found = search.search(chunks, '"Invoice 4711"', k=2).collect()
    assert sorted(r.uid for r in found) == ["u1", "u3"] and not any(r.has_more for r in found)
    assert [r.has_more for r in search.search(chunks, "invoice", k=1).collect()] == [True]
    assert search.search(chunks, "...!!!" + "zz", k=2).count() == 0 and search.search(chunks, "", k=10).count() == 4
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c3", [0.9, 0.1]), ("c4", [0.0, 1.0])], "cid string, embedding array<float>")
    both = search.search(chunks, "holiday", vectors=vectors, query=[1.0, 0.0], k=3).collect()
    assert both[0].uid == "u2" and {r.uid for r in both} == {"u1", "u2"}
    plan = search.embedding_plan(spark.createDataFrame([("h1", "x" * 50), ("h1", "x" * 50), ("h2", "y" * 50), ("h3", "short")], "hash string, text string"), spark.createDataFrame([("h2", [1.0])], "hash string, embedding array<float>"))
    assert sorted(tuple(r) for r in plan.select("hash", "action").collect()) == [("h1", "embed"), ("h2", "reuse"), ("h3", "zero")]
    done = search.embedded(plan, spark.createDataFrame([("h2", [7.0])], "hash string, embedding array<float>"), lambda texts: [[float(len(t))] for t in texts], 1)
    assert {r["hash"]: list(r.embedding) for r in done.collect()} == {"h1": [50.0], "h2": [7.0], "h3": [0.0]}


def test_records_of_files(spark, tmp_path):
    for name, content in {
        "site/a.html": '<html><title>A &amp; B</title><body><img src="data:xx"><p>Hello\n&nbsp;you</p></body>', "_fremd/b.html": "<p>no</p>", "site/x.files/c.html": "<p>attached</p>", "Dateien/d.pdf": "d", "Dateien/e.teil": "e",
        "chat/Dateien/f.html": "<p>file</p>", "index.html": "<p>i</p>",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    root = f"file://{tmp_path}"
    pages = {r.rel: r for r in records.read_pages(spark, root, "pages").collect()}
    assert set(pages) == {"site/a.html", "site/x.files/c.html", "chat/Dateien/f.html", "index.html"} and pages["site/a.html"].title == "A & B" and pages["site/a.html"].text == "A & B Hello you" and pages["site/a.html"].ctx == "site"
    assert {r.rel for r in records.read_pages(spark, root, "onenote").collect()} == {"site/a.html", "chat/Dateien/f.html", "index.html"}
    assert [(r.rel, r.title, r.text) for r in records.mirrored(spark, root, "onedrive").collect()] == [("Dateien/d.pdf", "d.pdf", "Dateien / d.pdf")]
    assert {r.rel for r in records.manifest(spark, root, "teams_files").collect()} == {"Dateien/d.pdf", "chat/Dateien/f.html"}
    gone = records.with_tombstones(records.mirrored(spark, root, "onedrive"), spark.createDataFrame([("onedrive", "Dateien/d.pdf", "2024")], "root string, rel string, since string"))
    assert gone.first().gone == "2024"
    assert records.file_window(spark, f"{root}/site/a.html", 6, 7).first()[1:] == ("<title>", len((tmp_path / "site/a.html").read_text()), True)
    (tmp_path / "cal.json").write_text(json.dumps({"recs": [{"uid": "u", "ts": 1.0, "title": "t", "st": "ok"}]}, indent=1))
    assert [(r.uid, r.te) for r in records.calendar_entries(spark, f"{root}/cal.json").collect()] == [("u", None)]
    (tmp_path / "org.json").write_text(json.dumps({"captured": "2024", "people": [{"id": "1", "name": "A"}]}))
    assert records.organisation_people(spark, f"{root}/org.json").first()[:3] == ("2024", "1", "A")


def test_boards_and_lists(spark):
    entry = {"task": {"title": "T", "bucketId": "b1", "createdDateTime": "2025-01-01T00:00:00Z", "assignments": {"p1": {}, "zz": {}}}, "details": {"description": "D", "checklist": {"c": {"title": "step"}}, "references": {"r": {"alias": "my file.pdf"}}}, "kommentare": [{"wer": "p2", "wann": "2025-02-01T00:00:00.1234567Z", "html": "<p>hi</p>"}], "deleted": "2025"}
    tasks = spark.createDataFrame([("Board", "t1", json.dumps(entry)), ("Board", "t2", "{}")], "board string, task_id string, entry string")
    boards = spark.createDataFrame([("Board", "My board", {"b1": "To do"})], "board string, title string, buckets map<string,string>")
    people = spark.createDataFrame([("Board", "p1", "Gast, Greta"), ("Board", "p2", "Bob")], "board string, id string, name string")
    first, second = records.board_items(tasks, boards, people).orderBy("uid").collect()
    assert (first.who, first.title, first.ctx, first.text, first.att, first.gone, str(first.ts)[:10]) == ("Gast, Greta · zz", "T", "My board/To do", "D\nstep\nhi", "my_file.pdf", "2025", "2025-02-01")
    assert (second.title, second.ctx, second.ts, second.text) == ("(ohne Titel)", "My board/?", None, "")
    entry = {"task": {"title": "L", "createdDateTime": "2025-01-01T00:00:00Z", "lastModifiedDateTime": "2025-03-01T00:00:00Z", "body": {"content": "<b>x</b> y", "contentType": "html"}, "checklistItems": [{"displayName": "s"}], "linkedResources": [{"applicationName": "app"}]}, "anhaenge": [{"name": "a b.txt"}]}
    row = records.list_items(spark.createDataFrame([("L1", "t", json.dumps(entry))], "list string, task_id string, entry string"), spark.createDataFrame([("L1", "Shop")], "list string, title string")).first()
    assert (row.uid, row.text, row.att, row.ctx, str(row.ts)[:10]) == ("todo:L1/t:0", "x y\ns\napp", "a_b.txt", "Shop", "2025-03-01")


def test_store(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    assert store.read_info(spark, base) is None and store.read_table(spark, base, "chunks") is None
    store.write_version(base, {"chunks": spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")}, parser=2)
    store.save_vectors(base, spark.createDataFrame([("h", [3.0, 4.0]), ("z", [0.0, 0.0])], "hash string, embedding array<float>"))
    assert {r["hash"]: [round(x, 6) for x in r.embedding] for r in store.read_vectors(spark, base).collect()} == {"h": [0.6, 0.8], "z": [0.0, 0.0]}
    assert store.reusable(spark, base, ["id"], 2).count() == 2 and store.reusable(spark, base, ["id", "new"], 2) is None and store.reusable(spark, base, ["id"], 3) is None
    store.merged(base, "chunks", spark.createDataFrame([(2, "B"), (3, "c")], "id long, t string"), spark.createDataFrame([(1,)], "id long"), "id", "cursor")
    assert sorted(tuple(r) for r in store.read_table(spark, base, "chunks").collect()) == [(2, "B"), (3, "c")] and store.read_table(spark, base, "chunks_pointer").first()[0] == "cursor"
    assert store.read_vectors(spark, base).count() == 2
    write, keep, journal = store.replaced_versions(spark.createDataFrame([("a", "1" * 64), ("b", "2" * 64)], "rel string, sha256 string"), spark.createDataFrame([("a", "1" * 64), ("b", "3" * 64), ("c", "4" * 64)], "rel string, sha256 string"))
    assert sorted(r.rel for r in write.collect()) == ["b", "c"] and [r.kept for r in keep.collect()] == ["versions/b/" + "2" * 16] and journal.count() == 2


def test_chains(spark, tmp_path):
    heads = spark.createDataFrame([("x", 0, None)], "chain string, n long, head string").where("false")
    facts = spark.createDataFrame([("x", k, json.dumps({"kind": "write", "rel": f"f{k}"})) for k in range(5)], "chain string, at long, body string")
    lines = evidence.appended(heads, facts, "chain").orderBy("n").collect()
    more = evidence.appended(spark.createDataFrame([("x", lines[-1].n, lines[-1].hash)], "chain string, n long, head string"), facts.where("at < 2"), "chain").orderBy("n").collect()
    rows = [(r.chain, r.n, r.line, r.prev) for r in [*lines, *more]]
    schema = "chain string, n long, line string, prev string"
    broken = lambda kept, heads=None: [tuple(r) for r in evidence.broken_lines(spark.createDataFrame(kept, schema), "chain", "n", "line", "prev", heads).collect()]
    assert broken(rows) == [] and broken(rows[:1] + rows[2:]) == [("x", 2)] and broken(rows[1:]) == [("x", 1)] and broken(rows[:3] + rows[2:]) == [("x", 5)]
    assert broken([(*rows[0][:3], "made up"), *rows[1:]]) == [("x", 1)] and broken([*rows[:2], (*rows[2][:2], "altered", rows[2][3]), *rows[3:]]) == [("x", 4)]
    assert broken(rows, spark.createDataFrame([("x", "other")], "chain string, head string")) == [("x", 7)]
    (tmp_path / "a.jsonl").write_text("\n".join([*(r[2] for r in rows[:2]), "{broken"]) + "\n")
    read = evidence.chain_lines(spark, f"file://{tmp_path}").orderBy("place").collect()
    assert [(r.place, r.n, r.rel) for r in read] == [(1, 1, "f0"), (2, 2, "f1"), (3, None, None)]
    assert not evidence.acknowledged(spark.createDataFrame([("a", "1")], "rel string, sha256 string"), spark.createDataFrame([("a", "1")], "rel string, sha256 string")).count()
    names = spark.createDataFrame([("state.db-wal",), (".x",), ("a.teil",), ("b.pdf",)], "n string")
    assert [r.n for r in names.where(evidence.is_archive_file(F.col("n"))).collect()] == ["b.pdf"]


def test_calendar_text_and_hash(spark):
    import base64

    row = spark.createDataFrame([("u@x", "A, b; " + "long " * 20, datetime.datetime(2025, 1, 2, 9), None, "FREQ=DAILY", "Room\n1")], "uid string, title string, a timestamp, b timestamp, rule string, place string").select(times.event_text(*map(F.col, ("uid", "title", "a", "b", "rule", "place")))).first()[0]
    assert all(len(line) <= 75 for line in row.split("\r\n")) and "DTEND" not in row
    joined = row.replace("\r\n ", "")
    assert "SUMMARY:A\\, b\\; long" in joined and "LOCATION:Room\\n1\r\n" in joined and "DTSTART:20250102T090000Z" in joined

    def slow(data):
        value = 0
        for k, b in enumerate(data):
            shift = k * 11 % 160
            value ^= ((b << shift) | (b << shift >> 160)) & ((1 << 160) - 1)
        return base64.b64encode((value ^ (len(data) << 96)).to_bytes(20, "little")).decode()

    contents = [b"", b"a", bytes(range(256)) * 3, None]
    got = [r[0] for r in spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k int, c binary").orderBy("k").select(evidence.xor_hash(F.col("c"))).collect()]
    assert got == [slow(c) if c is not None else None for c in contents]
    states = spark.createDataFrame([(0,), (50,), (100,), (None,)], "p int").select(times.task_state(F.col("p"))).collect()
    assert [r[0] for r in states] == ["open", "started", "done", None]


def test_rounds(spark):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id string")
    known = spark.createDataFrame([("1", "u"), ("2", "u"), ("3", "w")], "id string, unit string")
    assert sorted(r.id for r in reconcile.absent_or_removed(known, ids("1"), ids("1", "9"), True).collect()) == ["1", "2", "3"] and [r.id for r in reconcile.absent_or_removed(known, ids(), ids("2"), False).collect()] == ["2"]
    todo, hold = reconcile.waiting(spark.createDataFrame([("1", "u", 5)], "id string, unit string, nr int"), spark.createDataFrame([("1", "u", 2), ("2", "u", 2), ("3", "w", 2)], "id string, unit string, nr int"), spark.createDataFrame([("u",)], "unit string"))
    assert sorted((r.id, r.nr) for r in todo.collect()) == [("1", 5), ("2", 2)] and [r.id for r in hold.collect()] == ["3"]
    assert [r.asDict() for r in reconcile.decremented(spark.createDataFrame([("a", 1, 2), ("b", 0, 1)], "unit string, here long, open long"), spark.createDataFrame([("a", 1), ("b", 5)], "unit string, n long"), "unit").collect()] == [{"unit": "a", "here": 2, "open": 1}]
    suspects = feeds.suspects(spark.createDataFrame([("1", "in", "m1"), ("2", "in", "m2"), ("3", "out", "m3")], "id string, folder string, mid string"), spark.createDataFrame([("9", "m2")], "id string, mid string"), spark.createDataFrame([("in",)], "folder string"), "id", "folder", "mid")
    assert [r.id for r in suspects.collect()] == ["1"]
    marks = spark.createDataFrame([("a", None, "x", "refused", False), (None, "unit", "y", "gone", False), ("q", None, "z", "gone", True), ("here", None, "h", "gone", False)], "rel string, unit string, name string, kind string, quiet boolean")
    assert sorted(tuple(r) for r in reconcile.permanent(marks, spark.createDataFrame([("here",)], "rel string")).collect()) == [("a", "refused"), ("unit: y", "gone")]
    pulled = casebook.pulled_thread(spark.createDataFrame([(1, "k1", "f")], "case_id long, key string, folder string"), spark.createDataFrame([("k1", "t"), ("k2", "t"), ("k3", "t"), ("k4", "s")], "key string, thread string"), spark.createDataFrame([(1, "k3")], "case_id long, key string"))
    assert [tuple(r) for r in pulled.collect()] == [(1, "k2", "f")]


def test_case_texts_and_folder_states(spark):
    at = lambda d: datetime.datetime(2025, 6, d)
    timeline = spark.createDataFrame([("c", "2025-06", at(2), "note", "1", "said\nit"), ("c", "2025-06", at(1), "item", "k", "Mail"), ("c", "-", None, "item", "z", "gone")], "case_id string, month string, ts timestamp, kind string, key string, text string")
    lines = casebook.casebook_lines(timeline).orderBy("case_id", F.col("month") == "-", "month", "place").collect()
    assert [r.line for r in lines] == ["## 2025-06", "* Mail", "> said it", "## undated", "* gone"]
    files = spark.createDataFrame([("k", "a", "h", 1)], "key string, rel string, sha256 string, size long")
    assert {r.key: r.state for r in casebook.case_manifest(timeline.select("case_id", "key"), files).collect()} == {"k": "here", "1": "missing", "z": "missing"}
    listed = spark.createDataFrame([("f", "o1", "m", False), ("f", "o2", "m", False), ("f", "x", None, True), ("f", "y", None, False)], "folder string, id string, master string, out boolean")
    known = spark.createDataFrame([("f", "m"), ("f", "old")], "folder string, id string")
    assert {r.state: r.n for r in reconcile.folder_states(listed, known, F.col("out"), master="master").collect()} == {"here": 1, "kept": 1, "excluded": 1, "open": 1}
    found = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "rel string, mtime long, size long")
    facts = found.where("rel <> 'c'").withColumns({"mtime": F.when(F.col("rel") == "b", 9).otherwise(F.col("mtime")), "version": F.lit(2)})
    assert sorted(r.rel for r in reconcile.facts_to_read(found, facts, 2).collect()) == ["b", "c"] and reconcile.facts_to_read(found, facts, 3).count() == 3
    told = facets.analytics_document({"n": found.select("rel"), "m": found.where("false")}).collect()
    assert [(r.name, json.loads(r.rows)) for r in told] == [("m", []), ("n", [{"rel": "a"}, {"rel": "b"}, {"rel": "c"}])]


def test_series_round(spark):
    at = lambda d, h=9: datetime.datetime(2025, 1, d, h)
    dates = spark.createDataFrame([("o1", "m", at(1)), ("o2", "m", at(2)), ("o3", "m", at(3)), ("p1", "q", at(1)), ("p2", "q", at(2))], "occ string, master string, orig timestamp_ntz")
    taken = spark.createDataFrame([("m", at(8)), ("q", at(9))], "master string, orig timestamp_ntz")
    exceptions = spark.createDataFrame([("q", at(1), "room"), ("m", at(3), "late")], "master string, orig timestamp_ntz, sub string")
    kind = "occ string, master string, orig timestamp_ntz, type string, cancelled boolean, sub string"
    # m moves by an hour; q has its first date plain again, one taken out, one that comes back, and a new exception
    listed = spark.createDataFrame([("o1", "m", at(1, 10), "occurrence", None, None), ("o2", "m", at(2, 10), "occurrence", None, None), ("o3", "m", at(3, 10), "exception", None, "late"), ("p1", "q", at(1), "occurrence", None, None), ("p9", "q", at(9), "occurrence", None, None), ("p4", "q", at(4), "exception", None, "x")], kind)
    found = calendar.series_round(dates, taken, exceptions, listed, spark.createDataFrame([("p2",), ("unknown",)], "occ string"))
    rows = [sorted((tuple(r) for r in f.collect()), key=repr) for f in found]
    assert rows[0] == sorted([("o1", "m", at(1, 10)), ("o2", "m", at(2, 10)), ("o3", "m", at(3, 10)), ("p1", "q", at(1)), ("p9", "q", at(9)), ("p4", "q", at(4))], key=repr)
    assert rows[1] == [("m", at(8, 10)), ("q", at(2))]
    assert rows[2] == sorted([("m", at(3, 10), "late"), ("q", at(4), "x")], key=repr) and rows[3] == [("m",), ("q",)]
    quiet = calendar.series_round(*found[:3], listed, spark.createDataFrame([], "occ string"))
    assert quiet[3].count() == 0
    series = spark.createDataFrame([("q", at(1), "FREQ=DAILY", "UTC")], "master string, start timestamp_ntz, rrule string, tz string")
    assert [tuple(r) for r in calendar.dates_the_rule_makes(found[1].unionByName(taken.where("false")), series, "2025-02-01").collect()] == [("q", at(2))]


def test_people_facet(spark):
    rows = spark.createDataFrame([("Carla Chef", "Carla@x", "2026-05-01 10:00", "outlook"), ("Carla Chef · Bob", "no@x", "2026-07-01", "planner"), ("Bob", None, "", "teams"), ("(unbekannt)", "u@x", "2026-01-01", "teams"), ("Acme", "a@x", "2026-01-01", "kontakte"), (None, None, None, "teams")], "who string, who_mail string, date string, src string")
    found = {r.name: r for r in facets.people_of(rows).collect()}
    assert set(found) == {"Carla Chef", "Bob"} and (found["Carla Chef"].address, found["Carla Chef"].first, found["Carla Chef"].last) == ("carla@x", "2026-05-01 10:00", "2026-07-01")
    assert found["Bob"].by_source == {"planner": 1, "teams": 1} and found["Bob"].address == ""


def test_streaming_sessions_and_first_rows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(1, at(0)), (1, at(4)), (1, at(30)), (2, at(1)), (2, at(1))], "user long, ts timestamp")
    rows.write.parquet(f"{tmp_path}/feed")
    feed = lambda: windows.read_feed(spark, f"{tmp_path}/feed", rows.schema)
    windows.sessions(feed(), "ts", "user", "10 minutes", "1 day").writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.user, r.start.minute, r.end.minute, r.n) for r in spark.table("sessions").collect()) == [(1, 0, 14, 2), (1, 30, 40, 1), (2, 1, 11, 2)]
    windows.sliding(feed(), "ts", "user", "10 minutes", "5 minutes", "1 day").writeStream.outputMode("complete").format("memory").queryName("slides").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("slides").where("user = 2").count() == 2
    windows.first_of_each(feed(), "user", "ts", "1 day").writeStream.outputMode("append").format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.user for r in spark.table("firsts").collect()) == [1, 2]


def test_streaming_upserts(spark, tmp_path):
    schema = "id long, t string, nr long, removed boolean"
    for k, rows in enumerate([[(1, "a", 1, False), (2, "b", 2, False), (1, "A", 3, False)], [(2, "b", 4, True), (3, "c", 5, False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        query = windows.upserted(windows.read_feed(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema), f"file://{tmp_path}/store", "items", "id", "nr", f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
    assert sorted((r.id, r.t) for r in store.read_table(spark, f"file://{tmp_path}/store", "items").collect()) == [(1, "A"), (3, "c")]


PAID = " ".join(f"paid{k}" for k in range(900))


def test_archive(spark, tmp_path):
    at = lambda d: datetime.datetime(2025, 6, d)
    schema = "uid string, src string, root string, rel string, who string, who_mail string, ppl string, ts timestamp_ntz, title string, ctx string, text string, att string, thread string, gone string, key string, to_ppl string, cc_ppl string, bcc_ppl string, domains string"
    mails = spark.createDataFrame([
        ("o:1:0", "outlook", "outlook", "a.eml", "Carla", "carla@x", "carla alice", at(1), "Rechnung 4711", "inbox", "please pay", "r.pdf", "t1", None, "mail:1", "alice@y", None, None, "x y"),
        ("o:2:0", "outlook", "outlook", "b.eml", "Alice", "alice@y", "alice carla", at(2), "Re: Rechnung", "inbox", PAID, None, "t1", None, "mail:2", "carla@x", None, None, "y"),
    ], schema)
    files = spark.createDataFrame([("datei:x/c.pdf:0", "datei", "onedrive", "x/c.pdf", at(3), "c.pdf", "x", "x / c.pdf", "c.pdf", "file:9")], "uid string, src string, root string, rel string, ts timestamp_ntz, title string, ctx string, text string, att string, key string")
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    criteria = search.Criteria(source="outlook", person="carla")
    archive = Archive.build(
        f"file://{tmp_path}/archive", [mails, files],
        cases=one([("c1", "One", "open", at(1)), ("c2", "Two", "closed", at(9))], "id string, name string, status string, changed timestamp_ntz"), case_items=one([("c1", "mail:1")], "case_id string, key string"), case_removed=one([("c1", "mail:9")], "case_id string, key string"),
        case_notes=one([("c1", at(4), 1, "said"), ("c1", at(4), 2, " ")], "case_id string, ts timestamp_ntz, note_id long, text string"), searches=one([("s1", "c1", "rechnung", Archive.criteria_text(criteria))], "id string, case_id string, query string, criteria string"),
        organisation=one([("1", "Boss", "Chief", "D", None, False), ("2", "Mid", "Lead", "D", "1", False), ("3", "Low", "Dev", "E", "2", False)], "id string, name string, title string, department string, manager string, disabled boolean"),
        lines=one([(1, "old.txt", "write", "h1", at(1)), (2, "new.txt", "write", "h2", at(5))], "n long, rel string, kind string, sha256 string, at timestamp_ntz"), moves=one([("moved", "old.txt", "new.txt")], "kind string, rel string, other string"),
    )
    uids = lambda df: sorted(r.uid for r in df.collect())
    assert uids(archive.search_messages("rechnung")) == ["o:1:0", "o:2:0"] and uids(archive.search_messages("rechnung", case="c1")) == ["o:1:0"] and [r.uid for r in archive.browse_messages(k=2).collect()] == ["datei:x/c.pdf:0", "o:2:0"]
    assert archive.get_document("o:2:0").first().text == PAID and [r.uid for r in archive.get_thread("t1").collect()] == ["o:1:0", "o:2:0"]
    assert {r.who: r.n for r in archive.list_people("car").collect()} == {"Carla": 1, "Alice": 1} and archive.list_addresses("to").count() == 2 and {r.type: r.n for r in archive.list_filetypes().collect()} == {"pdf": 2}
    assert [tuple(r) for r in archive.list_files("onedrive").collect()] == [("x", True, 1)] and {r.name: r.present for r in archive.list_sources(["outlook", "teams"]).collect()} == {"outlook": True, "teams": False}
    told = archive.archive_analytics()
    assert told["talk"].first().messages == 2 and told["files"].first().onedrive == 1 and [r.running for r in told["months"].collect()] == [2]
    assert [r.id for r in archive.get_org_chart("3").orderBy("distance").collect()] == ["2", "1"] and [r.id for r in archive.get_manager("3").collect()] == ["2"] and archive.list_reports("1", 2).count() == 2 and archive.find_by_role("lead").first().id == "2" and archive.list_roles().count() == 3
    assert [r.id for r in archive.list_cases().collect()] == ["c1", "c2"] and archive.get_case("c1").first()["items"] == 1 and [(r.kind, r.key) for r in archive.case_timeline("c1").collect()] == [("item", "mail:1"), ("note", "1")]
    assert [r.name for r in archive.case_people("c1").collect()] == ["Carla"] and uids(archive.case_new_hits("c1", "rechnung")) == ["o:2:0"] and uids(archive.run_saved_search("s1")) == ["o:1:0", "o:2:0"]
    assert [r.sha256 for r in archive.history("new.txt").collect()] == ["h2", "h1"] and archive.get_version("new.txt", "2025-06-05").first().sha256 == "h2" and archive.get_version("new.txt", "2025-06-04").count() == 0
    with pytest.raises(LookupError):
        archive.list_events()

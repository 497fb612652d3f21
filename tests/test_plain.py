"""Functions that no contract query goes through, on rows whose results are known."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from stratica.archive import Archive
from stratica.functions import times
from stratica.operators import calendar, casebook, evidence, organisation, reconcile
from stratica.operators import search as sr


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr("stratica.archive.BUCKETS", 4)


at = lambda day, hour=0: datetime.datetime(2025, 1, day, hour)


def rows(df, *columns) -> list[tuple]:
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_calendar_rounds(spark):
    masters = spark.createDataFrame([("new", at(2), False), ("same", at(2), False), ("later", at(3), False), ("due", at(2), True)], "id string, modified timestamp_ntz, is_due boolean")
    known = spark.createDataFrame([("same", at(2)), ("later", at(2)), ("due", at(2))], "id string, modified timestamp_ntz")
    assert rows(calendar.to_read_again(masters, known, F.col("is_due"))) == [("due",), ("later",), ("new",)]
    had = spark.createDataFrame([("in", at(5)), ("out", at(25)), ("seen", at(5)), ("moved", at(5)), ("series", at(25)), ("undated", None)], "id string, ts timestamp_ntz")
    dates = spark.createDataFrame([("series", at(6)), ("out", at(26))], "id string, ts timestamp_ntz")
    verdicts = spark.createDataFrame([("in", 404), ("out", 404), ("moved", 200), ("series", 404), ("seen", 404), ("undated", 404)], "id string, status int")
    seen = spark.createDataFrame([("seen",)], "id string")
    assert rows(calendar.vanished(had, seen, dates, verdicts, "2025-01-01", "2025-01-10")) == [("in",), ("series",)]


def test_case_parts(spark, tmp_path):
    members = spark.createDataFrame([(1, "f", "a"), (1, "g", "b"), (2, "f", "c"), (2, None, "d")], "case_id long, folder string, key string")
    folders = spark.createDataFrame([(1, "f")], "case_id long, folder_id string")
    assert {r.key: r.folder for r in casebook.without_folders(members, folders).collect()} == {"a": "f", "b": None, "c": None, "d": None}
    listed = casebook.snapshot(spark.createDataFrame([("k", 1.0)], "key string, score double"), "l1", "{}", "2025-01-02 03:00:00").first()
    assert tuple(listed) == ("l1", "{}", at(2, 3), "k")
    timeline = spark.createDataFrame([(1, "2025-01", "k", "item", 'a "b", c'), (1, "2025-01", "n", "note", "x"), (2, "-", "m", "item", None)], "case_id long, month string, key string, kind string, text string")
    casebook.items_csv(timeline, f"{tmp_path}/csv")
    back = spark.read.option("header", "true").csv(f"{tmp_path}/csv")
    assert sorted(map(str, map(tuple, back.select("case_id", "month", "key", "text").collect()))) == sorted(map(str, [(1, "2025-01", "k", 'a "b", c'), (2, "-", "m", None)]))
    notes = spark.createDataFrame([("o1", 1, at(1), "old", "ui")], "id string, case_id long, at timestamp_ntz, text string, origin string")
    changes = [(1, "add", "a", 1, at(2), " new ", "mcp"), (2, "change", "a", 1, at(3), "newer", "ui"), (3, "change", "o1", 1, at(4), "  ", "ui"), (4, "change", "o1", 2, at(5), "other case", "ui"), (5, "add", "b", 2, at(6), "closed", "ui"), (6, "add", "c", 1, at(7), "gone", "ui"), (7, "delete", "c", 1, at(8), None, "ui")]
    cases = spark.createDataFrame([(1, "open"), (2, "closed")], "id long, status string")
    left, touched = casebook.notes_after(notes, spark.createDataFrame(changes, "nr long, op string, id string, case_id long, at timestamp_ntz, text string, origin string"), cases)
    assert rows(left) == [("a", 1, at(2), "newer", "mcp"), ("o1", 1, at(1), "old", "ui")] and rows(touched) == [(1, at(8))]


def test_kept_and_upstream(spark):
    files = spark.createDataFrame([("versions/a/1", 10), ("versions/b/1", 5), ("a", 7)], "rel string, size long")
    assert tuple(evidence.kept_versions(files, F.col("rel").startswith("versions/"), "size").first()) == (2, 15) and tuple(evidence.kept_versions(files, F.lit(False), "size").first()) == (0, 0)
    history = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "rel string, sha256 string")
    said = spark.createDataFrame([("a", "1", "h", "h"), ("b", "2", "h", "other"), ("c", "3", "h", None), ("d", "9", "h", "h")], "rel string, sha256 string, hash string, service_hash string")
    assert {r.rel: r.agrees for r in evidence.upstream_match(history, said).collect()} == {"a": True, "b": False, "c": None}


def test_organisation_parts(spark):
    people = spark.createDataFrame([("1", "Ann", "T", "D", None, False), ("2", "Bob", None, "D", "1", True), ("3", "Cy", None, None, "9", False), ("4", "Di", None, None, None, True)], "id string, name string, title string, department string, manager string, disabled boolean")
    lines = {r.id: r.line for r in organisation.canonical(people).collect()}
    assert lines["1"] == '{"id":"1","name":"Ann","title":"T","department":"D"}' and lines["2"] == '{"id":"2","name":"Bob","department":"D","manager":"1","disabled":true}'
    asked = spark.createDataFrame([("1", at(1))], "id string, at timestamp_ntz")
    assert rows(organisation.without_manager(people, asked, "2025-01-05 00:00:00")) == [("9",)]
    assert rows(organisation.without_manager(people, asked, "2025-01-20 00:00:00")) == [("1",), ("9",)]


def test_trees_and_threads(spark):
    known = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, path string")
    changed = spark.createDataFrame([("2", "B"), ("4", "d"), ("3", "x")], "id string, path string")
    assert rows(reconcile.tree_merge(known, changed, spark.createDataFrame([("3",)], "id string"))) == [("1", "a"), ("2", "B"), ("4", "d")]
    threads = spark.createDataFrame([("t1", at(1)), ("t2", at(9))], "root_id string, last_activity timestamp_ntz")
    replies = spark.createDataFrame([("t3",), ("t2",)], "root_id string")
    assert rows(reconcile.threads_to_read(replies, threads, "2025-01-05 00:00:00", False)) == [("t2",), ("t3",)]
    assert rows(reconcile.threads_to_read(replies, threads, "2025-01-05 00:00:00", True)) == [("t1",), ("t2",)]
    ends = spark.createDataFrame([(at(3), True), (at(3), False)], "e timestamp_ntz, whole boolean").select(times.shown_end(F.col("e"), F.col("whole")).alias("s"))
    assert rows(ends) == [(at(2),), (at(3),)]


def test_archive_questions(spark, tmp_path):
    texts = ["Rechnung eins", "Rechnung zwei Rechnung", "Urlaub", "Rechnung drei"]
    data = [(f"m{k}", "outlook", "outlook", f"In/{k}.eml", "Bob", "bob", at(k + 1), "T", f"In/{k % 2}", t, f"key{k}", "t1" if k < 2 else None) for k, t in enumerate(texts)]
    items_ = spark.createDataFrame(data, "uid string, src string, root string, rel string, who string, ppl string, ts timestamp, title string, ctx string, text string, key string, thread string")
    items_ = items_.withColumns({c: F.lit(None).cast("string") for c in ("att", "who_mail", "to_ppl", "cc_ppl", "bcc_ppl", "gone", "domains")})
    base = f"file://{tmp_path}/store"
    tables = {
        "case_items": spark.createDataFrame([("c1", "key0", "f1"), ("c1", "key1", None), ("c2", "key1", None)], "case_id string, key string, folder_id string"),
        "cases": spark.createDataFrame([("c1", "One", "open"), ("c2", "Two", "closed")], "id string, name string, status string"),
        "organisation": spark.createDataFrame([("1", "Ann", None, None, None, False), ("2", "Bo", "Lead", "D", "1", False)], "id string, name string, title string, department string, manager string, disabled boolean"),
        "runs": spark.createDataFrame([("r1", "collect", at(1)), ("r2", "collect", at(2))], "run string, kind string, started timestamp"),
        "steps": spark.createDataFrame([("r1", "a", True), ("r2", "a", True)], "run string, step string, ok boolean"),
        "lines": spark.createDataFrame([(1, "2025", "In/0.eml", "write", "s0"), (2, "2025", "In/1.eml", "write", "s1")], "n long, at string, rel string, kind string, sha256 string"),
        "files": spark.createDataFrame([("In/0.eml", "s0"), ("In/1.eml", "other")], "rel string, sha256 string"),
    }
    archive = Archive.build(base, [items_], **tables)
    found = lambda **kw: [r.uid for r in archive.search_messages("rechnung", **kw).collect()]
    assert found() == ["m1", "m0", "m3"] or set(found()) == {"m0", "m1", "m3"}
    assert set(found(case="c1")) == {"m0", "m1"} and found(case="c1", case_folder="f1") == ["m0"]
    assert set(found(collapse=True)) == {"m1", "m3"} or set(found(collapse=True)) == {"m0", "m3"}
    assert {r.uid: r.cases for r in archive.search_messages("rechnung", with_cases=True).collect()} == {"m0": "One", "m1": "One, Two", "m3": None}
    archive.embed(lambda many: [[1.0, float("eins" in t), float("drei" in t)] for t in many], 3, buckets=2)
    assert archive.search_messages("", vector=[1.0, 1.0, 0.0], mode="semantic").count() == 0  # texts so short have vectors of length 0
    assert set(found(vector=[1.0, 0.0, 0.0], mode="text")) == {"m0", "m1", "m3"}
    first = archive.answer_context("urlaub").first()
    assert (first.n, first.passage) == (1, "[1] outlook · 2025-01-03 · Bob · T\nUrlaub")
    assert archive.similar_messages("m0", 2).count() <= 2
    assert {v for r in archive.list_folders().collect() for v in r} >= {"In/0", "In/1", 2}
    assert rows(archive.find_person("bo"), "id") == [("2",)] and rows(archive.get_manager("2"), "id") == [("1",)] and rows(archive.list_reports("1"), "id") == [("2",)]
    assert archive.list_runs("collect").count() >= 1
    assert [archive.verify_item(u).first().verdict for u in ("m0", "m1", "m2")] == ["unchanged", "changed_outside", "missing"]
    assert "from" in archive.get_facts("m0").first().facts
    assert [r.uid for r in archive.browse_messages(sr.Criteria(folder="In/1")).collect()] == ["m3", "m1"]


def test_calendar_is_written_with_counts(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    schema = "uid string, ts timestamp_ntz, rts timestamp_ntz, te timestamp_ntz, title string, st string, cal string, place string, by_rule boolean"
    entry = lambda uid, day, by_rule=False, title="T": (uid, None if day is None else at(day), None, None, title, "ok", "c", "", by_rule)
    write = lambda rows_, first, last: calendar.calendar_written(base, spark.createDataFrame(rows_, schema), first, last)
    assert write([entry("a", 5), entry("s", 6, True), entry("s", 13, True), entry("u", None)], "2025-01-01", "2025-01-20") == {"changed": 4, "removed": 0}
    # the window has moved on: the series' first date left it and a further one came in, which are no changes; a title is one
    assert write([entry("a", 5, title="New"), entry("s", 13, True), entry("s", 27, True), entry("u", None)], "2025-01-10", "2025-01-30") == {"changed": 1, "removed": 1}
    assert write([entry("a", 5, title="New"), entry("s", 27, True), entry("u", None), entry("s", 14, True)], "2025-01-10", "2025-01-30") == {"changed": 1, "removed": 1}
    assert write([entry("u", None)], "2025-01-10", "2025-01-30") == {"changed": 0, "removed": 3}

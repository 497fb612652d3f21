"""The paged feed source and keyed state across rounds."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from stratica.operators import feeds
from stratica.sources import feed_source
from stratica.streaming import stateful


def put(root, walk: int, page: int, entries: list[dict]) -> None:
    (root / f"w{walk:06d}").mkdir(parents=True, exist_ok=True)
    (root / f"w{walk:06d}" / f"{page:06d}.json").write_text(json.dumps({"entries": entries}))


def test_paged_feed(spark, tmp_path):
    root, rows = tmp_path / "feed", []
    entries = lambda walk, page: [{"id": f"i{(page * 3 + k) % 8}", "v": f"{walk}.{page}.{k}", "deleted": page == 4 and k == 0} for k in range(3)]
    assert feed_source.read_feed(spark, str(root)).count() == 0

    def run() -> None:
        query = feed_source.stream_feed(spark, str(root)).writeStream.foreachBatch(lambda b, n: rows.append(sorted(tuple(r) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    for page in (1, 2, 3):
        put(root, 1, page, entries(1, page))
    run()
    for page in (4, 5):  # the walk goes on after a stop
        put(root, 1, page, entries(1, page))
    run()
    run()  # nothing new
    batch = sorted(tuple(r) for r in feed_source.read_feed(spark, str(root)).collect())
    assert [r for some in rows for r in some] == batch and len(batch) == 15 and not any(r[3] for r in batch)
    assert sorted(tuple(r) for r in feed_source.read_feed(spark, str(root), 1, 3).collect()) == [r for r in batch if r[1] > 3]
    none = spark.createDataFrame([], "id string, entry string")
    known = feed_source.walked(none, feed_source.read_feed(spark, str(root))).persist()
    assert {r.id: json.loads(r.entry)["v"] for r in known.collect()} == {"i0": "1.5.1", "i1": "1.5.2", "i2": "1.3.1", "i3": "1.3.2", "i5": "1.4.1", "i6": "1.4.2", "i7": "1.5.0"}
    del rows[:]
    put(root, 2, 1, [{"id": "i1", "v": "new"}])  # the cursor has expired: everything is listed anew, once
    run()
    put(root, 2, 2, [{"id": "i9", "v": "later"}])
    run()
    assert [[(r[0], r[1], r[3]) for r in some] for some in rows if some] == [[(2, 1, True)], [(2, 2, False)]]
    after = feed_source.walked(known, feed_source.read_feed(spark, str(root), 1, 5)).collect()
    assert {r.id for r in after} == {"i1", "i9"}
    partly = feed_source.walked(known, feed_source.read_feed(spark, str(root), 2, 1)).collect()
    assert {r.id for r in partly} == {"i0", "i1", "i2", "i3", "i5", "i6", "i7", "i9"}


def fed(spark, tmp_path, rows: list[tuple], schema: str, batches: int, use, again: bool = False) -> list[tuple]:
    """What a stateful query gives for the rows in so many batches; ``again``: each batch comes twice."""
    folder, out = tmp_path / f"in{batches}", []
    size = -(-len(rows) // batches)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    for part in [x for p in parts for x in ([p, p] if again else [p])]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    feed = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = use(feed).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / f"check{batches}")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return out


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_message_versions_in_any_batches(spark, tmp_path, one_partition):
    rng = random.Random(4)
    rows = [(f"m{rng.randrange(6)}", None if rng.random() < 0.1 else f"text {rng.randrange(4)}", k, "gone" if rng.random() < 0.15 else None) for k in range(48)]
    schema = "id string, body string, modified long, deleted string"
    store = spark.createDataFrame([], "id string, body string, modified long, deleted string, earlier array<string>")
    state = {}
    for row in rows:  # the rules, one change at a time
        i, body, modified, deleted = row
        if i not in state:
            state[i] = (body, modified, deleted, [])
            continue
        b, _, d, earlier = state[i]
        state[i] = (body, modified, d, earlier + ([b] if b is not None else [])) if deleted is None and body != b else (b, modified, deleted or d, earlier)
    for batches, again in ((1, False), (3, True), (6, False)):
        found = fed(spark, tmp_path, rows, schema, batches, stateful.message_versions, again)
        assert {r[0]: (*r[1:4], list(r[4])) for r in found} == state
    batch = feeds.merge_messages(store, spark.createDataFrame([r for r in rows if r[0] == "m0"][:1], schema)).first()
    assert batch.earlier == []


def test_waiting_and_series_in_any_batches(spark, tmp_path, one_partition):
    waiting = [("a", 1, "x", "1", False), ("a", 2, "y", "1", False), ("b", 3, "x", "1", False), ("a", 4, "x", "2", False), ("a", 5, None, None, True), ("a", 6, "z", "1", False), ("a", 7, None, None, True), ("b", 8, "w", "1", False), ("a", 9, None, None, True)]
    series = [("s", 1, None, "DAILY"), ("s", 2, "0105", "0106"), ("s", 3, "0107", None), ("t", 4, None, "WEEKLY"), ("s", 5, None, "DAILY"), ("t", 6, "0101", "0102"), ("t", 7, None, "MONTHLY"), ("s", 8, "0105", "0108")]
    for batches, again in ((1, False), (3, True)):
        found = fed(spark, tmp_path / "w", waiting, "unit string, nr long, id string, entry string, due boolean", batches, stateful.waiting_entries, again)
        assert sorted(found) == [("a", "x", 4, "2", 5), ("a", "y", 2, "1", 5), ("a", "z", 6, "1", 7)]
        book = fed(spark, tmp_path / "s", series, "uid string, nr long, slot string, value string", batches, stateful.series_book, again)
        assert {r[0]: r[1:] for r in book} == {"s": (8, "DAILY", '{"0105": "0108", "0107": null}'), "t": (7, "MONTHLY", "{}")}


def test_invitations_are_read_once(spark, tmp_path):
    import os

    from stratica.sources import invitations

    def mail(name: str, title: str | None, when: int = 1_700_000_000) -> None:
        part = "" if title is None else f"Content-Type: text/calendar; method=REQUEST\r\n\r\nBEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u-{name}\r\nSUMMARY:{title}\r\nDTSTART:20260105T090000Z\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
        path = tmp_path / "mails" / f"{name}.eml"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(f"From: Ann <Ann@x.example>\r\nDate: Tue, 10 Jun 2025 08:00:00 +0000\r\nMIME-Version: 1.0\r\n{part or 'Content-Type: text/plain' + chr(13) + chr(10) * 2 + 'hi'}".encode())
        os.utime(path, (when, when))

    root = f"file://{tmp_path}/mails"
    for name, title in (("a", "One"), ("b", None), ("c", "Three")):
        mail(name, title)
    first, facts = invitations.invitation_round(spark, root)
    assert sorted((r.rel, r.title, r.method, r.organizer_hint) for r in facts.collect()) == [("a.eml", "One", "REQUEST", "ann@x.example"), ("c.eml", "Three", "REQUEST", "ann@x.example")]
    assert not any(r.reused for r in first.collect()) and first.count() == 3
    first.write.parquet(f"{tmp_path}/manifest")
    known = spark.read.parquet(f"{tmp_path}/manifest")
    mail("a", "Changed", 1_700_000_100)
    mail("d", "Four")
    (tmp_path / "mails/c.eml").unlink()
    second, facts = invitations.invitation_round(spark, root, known)
    assert {r.rel: r.reused for r in second.collect()} == {"a.eml": False, "b.eml": True, "d.eml": False}
    assert sorted(r.title for r in facts.collect()) == ["Changed", "Four"]
    (tmp_path / "mails/d.eml").unlink()
    (tmp_path / "mails/a.eml").unlink()
    last, facts = invitations.invitation_round(spark, root, known)
    assert [(r.rel, r.reused) for r in last.collect()] == [("b.eml", True)] and facts.count() == 0

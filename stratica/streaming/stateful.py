"""Keyed state across rounds: versions of messages, entries that wait until their unit is due, and series with exceptions.

Each is a processor of ``transformWithState``: a key's rows meet its state, in the order of their numbers, whatever batches they come
in.  So a history gives the same tables in one batch or in many, and what was taken in before changes nothing.  State lies in
RocksDB, a list or map item a row of its own, so a key's state is not rewritten whole for every change.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_order(rows: Iterator[pd.DataFrame], number: str) -> pd.DataFrame:
    """A key's rows of one batch by their numbers."""
    return pd.concat(list(rows), ignore_index=True).sort_values(number, kind="stable")


def text_or_none(value) -> str | None:
    return None if value is None or value != value else value


class Versions(StatefulProcessor):
    """Value state: a message as it is now; list state: its earlier texts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "body string, modified long, deleted string")
        self.earlier = handle.getListState("earlier", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = self.now.get() if self.now.exists() else None
        changed = False
        for r in in_order(rows, "modified").itertuples(index=False):
            body, deleted, modified = text_or_none(r.body), text_or_none(r.deleted), int(r.modified)
            if now is not None and modified <= now[1]:
                continue  # taken in before
            if now is None:
                now = (body, modified, deleted)
            elif deleted is None and body != now[0]:
                if now[0] is not None:
                    self.earlier.appendValue((now[0],))
                now = (body, modified, now[2])
            else:
                now = (now[0], modified, deleted if deleted is not None else now[2])
            changed = True
        if changed:
            self.now.update(now)
            yield pd.DataFrame({"id": [key[0]], "body": [now[0]], "modified": [now[1]], "deleted": [now[2]], "earlier": [[x[0] for x in self.earlier.get()]]})

    def close(self) -> None:
        pass


class Waiting(StatefulProcessor):
    """Map state: entries of a unit by id, which go out when the unit is due; a later entry of an id takes the place of an earlier one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "id string", "nr long, entry string")
        self.seen = handle.getValueState("seen", "nr long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen, out = (self.seen.get()[0] if self.seen.exists() else -1), []
        for r in in_order(rows, "nr").itertuples(index=False):
            if int(r.nr) <= seen:
                continue  # taken in before
            seen = int(r.nr)
            if not r.due:
                self.entries.updateValue((r.id,), (seen, text_or_none(r.entry)))
                continue
            out += [(key[0], i[0], e[0], e[1], seen) for i, e in self.entries.iterator()]
            self.entries.clear()
        self.seen.update((seen,))
        if out:
            yield pd.DataFrame(sorted(out, key=lambda x: (x[4], x[1])), columns=["unit", "id", "nr", "entry", "due_nr"])

    def close(self) -> None:
        pass


class Series(StatefulProcessor):
    """Value state: the rule of a series; map state: its exceptions by slot.  Another rule takes all exceptions away, as services do."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rule = handle.getValueState("rule", "rule string, nr long")
        self.moved = handle.getMapState("moved", "slot string", "moved string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        rule, seen = self.rule.get() if self.rule.exists() else (None, -1)
        before = seen
        for r in in_order(rows, "nr").itertuples(index=False):
            if int(r.nr) <= seen:
                continue  # taken in before
            seen, slot = int(r.nr), text_or_none(r.slot)
            if slot is None:
                if text_or_none(r.value) != rule:
                    self.moved.clear()
                rule = text_or_none(r.value)
            else:
                self.moved.updateValue((slot,), (text_or_none(r.value),))
        if seen > before:
            self.rule.update((rule, seen))
            exceptions = {slot[0]: moved[0] for slot, moved in self.moved.iterator()}
            yield pd.DataFrame({"uid": [key[0]], "nr": [seen], "rule": [rule], "exceptions": [json.dumps(exceptions, sort_keys=True)]})

    def close(self) -> None:
        pass


def message_versions(feed: DataFrame) -> DataFrame:
    """(id, body, modified, deleted, earlier) of every message that a batch changes; ``feed``: id, body, modified (a number), deleted.

    An edit keeps the replaced text, a deletion keeps the body, older changes are ignored: the rules of ``feeds.merge_messages``.
    """
    with_state_store(feed.sparkSession)
    return feed.groupBy("id").transformWithStateInPandas(Versions(), "id string, body string, modified long, deleted string, earlier array<string>", "Update", "None")


def waiting_entries(feed: DataFrame) -> DataFrame:
    """(unit, id, nr, entry, due_nr) of entries whose unit has become due; ``feed``: unit, nr, id, entry, due (true: the unit is due now)."""
    with_state_store(feed.sparkSession)
    return feed.groupBy("unit").transformWithStateInPandas(Waiting(), "unit string, id string, nr long, entry string, due_nr long", "Append", "None")


def series_book(feed: DataFrame) -> DataFrame:
    """(uid, nr, rule, exceptions) of every series that a batch changes; ``feed``: uid, nr, slot (null: the rule itself), value (the rule, or where a date has moved; null: taken out)."""
    with_state_store(feed.sparkSession)
    return feed.groupBy("uid").transformWithStateInPandas(Series(), "uid string, nr long, rule string, exceptions string", "Update", "None")

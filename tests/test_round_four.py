"""Rules of bookkeeping, mails, evidence and renames where ties, odd characters and larger inputs decide."""

from __future__ import annotations

import random
import time
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from stratica.operators import evidence, reconcile
from stratica.plans import archive  # noqa: F401
from stratica.plans.contract import ORACLE_SQL, QUERIES
from stratica.storage import shared_dir


def test_the_more_frequent_cadence_of_a_folder(spark):
    """Whatever the order in which a folder's cadences come."""
    named = spark.createDataFrame([("a", "monthly"), ("a", "daily"), ("b", "daily"), ("b", "monthly"), ("c", "weekly"), ("c/d", "monthly")], "folder string, cadence string").coalesce(1)
    units = spark.createDataFrame([("a/x",), ("b/x",), ("c/x",), ("c/d/x",), ("e",)], "unit string")
    assert dict(map(tuple, reconcile.cadences(units, named).collect())) == {"a/x": "daily", "b/x": "daily", "c/x": "weekly", "c/d/x": "monthly", "e": "always"}


def test_marks_mean_what_they_mean_in_the_sql(spark, tmp_path):
    """Edges of words beside letters beyond ASCII, characters of two units before a mark, other cases and white space, a mark at the start and another later."""
    texts = [
        "a\nOn\u00eaan said\nBob wrote:\nold", "a\nOn Monday Bob \u00eawrote:\nold", "a\nAm Montag schrieb\u00ea Bob:\nold", "a\nOnce Bob wrote:\nold",
        "\U0001f600\U0001f600 new\n-----Original Message-----\nold", "\U0001f600 new\n-- \nBob", "new\n--- URSPR\u00dcNGLICHE NACHRICHT ---\nold", "new\nFrom: x\n\u017fent: y\nold", "new\nGet Outloo\u212a for iOS",
        "new\n__________\x0b\nmore", "new\nFrom:\x0bx\nSent: y\nmore", "-- \nhi\n-- \nBob", "\nSent from my phone", "Sent from my phone\nmore\nSent from my phone", "", None,
    ]
    docs = spark.createDataFrame([(7 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = dict(con.execute(ORACLE_SQL["strip_quoted"]).fetchall())
    assert dict(map(tuple, QUERIES["strip_quoted"](spark, str(tmp_path)).collect())) == expected and expected[0] == "a\n" and expected[28] == "\U0001f600\U0001f600 new\n"


def test_stamps_of_many_lines(spark):
    """A frame that is summed up anew for each row takes minutes here."""
    began = time.time()
    lines, stamps = spark.range(600_000).select(F.col("id").alias("n")), spark.range(0, 600_000, 3).select(F.col("id").alias("s"))
    found = evidence.covering_stamp(lines, "n", stamps, "s")
    assert found.where("stamp is null or stamp < n or stamp >= n + 3 or stamp % 3 <> 0").count() == 2 and found.count() == 600_000
    assert time.time() - began < 45


def test_stamps_wherever_numbers_lie(spark):
    """Below zero, far apart, at the ends of a long, repeated, null."""
    far = [-(1 << 63), -(1 << 62), -(1 << 40) - 1, -70_000, -65_536, -1, 0, 1, 65_535, 65_536, 1 << 33, (1 << 48) + 5, (1 << 62) + 1, (1 << 63) - 1]
    numbers = [*far, *[n + k for n in far[1:-1] for k in (-1, 1, 70_000)], 0, None, None]
    stamps = [*far[1:-1:2], far[-1] - 5, 65_536, None]
    found = evidence.covering_stamp(spark.createDataFrame([(n,) for n in numbers], "n long"), "n", spark.createDataFrame([(s,) for s in stamps], "s long"), "s").collect()
    first = lambda n: None if n is None else min((s for s in stamps if s is not None and s >= n), default=None)
    assert sorted(map(tuple, found), key=repr) == sorted([(n, first(n)) for n in numbers], key=repr)


def plain_names(moves):
    """Every name that leads to every other, step by step."""
    steps = {}
    for kind, rel, other in moves:
        if kind in ("moved", "removed") and rel is not None and other is not None and rel != other:
            steps.setdefault(other, set()).add(rel)
            steps.setdefault(rel, set()).update({other} if kind == "moved" else ())
    found = set()
    for name in steps:
        seen, ahead = {name}, [name]
        while ahead:
            ahead = [y for x in ahead for y in steps[x] if y not in seen and not seen.add(y)]
        found |= {(name, x) for x in seen}
    return found


def test_names_over_moves_and_removals(spark):
    """Removals lead one way, through classes, in circles too; every pair comes once."""
    chance = random.Random(3)
    moves = [(chance.choice(["moved", "moved", "removed", "removed", None]), f"n{chance.randrange(90)}", f"n{chance.randrange(90)}") for _ in range(95)]
    moves += [("removed", "x", "y"), ("removed", "y", "z"), ("removed", "z", "x"), ("moved", "z", "w"), ("removed", "w", "z"), ("moved", None, "q"), ("moved", "same", "same"), *moves[:9]]
    found = [tuple(r) for r in evidence.names_of(spark.createDataFrame(moves, "kind string, rel string, other string")).select("rel", "name").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_names(moves)
    assert sorted(map(tuple, evidence.names_of(spark.createDataFrame(moves[-12:-9], "kind string, rel string, other string").where("kind = 'none'")).collect())) == []


def test_names_leave_no_pairs_on_disk(spark):
    """What stays in the shared folder is the names' classes, not their pairs of every round."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    before = size()
    rows = spark.range(8_000).where("id % 40 <> 39").select(F.lit("moved").alias("kind"), name(F.col("id")).alias("rel"), name(F.col("id") + 1).alias("other"))
    assert evidence.names_of(rows).count() == 200 * 40 * 40
    assert size() - before < 400_000

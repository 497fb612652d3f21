"""Every contract query against its SQL on the small tables, and the streaming forms against their batch forms."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import stratica.plans.archive  # noqa: F401
import stratica.plans.items  # noqa: F401
import stratica.plans.records  # noqa: F401
import stratica.plans.rounds  # noqa: F401
from stratica.plans.contract import ORACLE_SQL, QUERIES
from stratica.streaming import windows


def normal(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return str(value) if isinstance(value, datetime.date) else value


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    result = sql.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in result.description)
    place = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted((tuple(normal(r[k]) for k in place) for r in result.fetchall()), key=repr)
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    assert sorted((tuple(normal(r[c]) for c in columns) for r in found.collect()), key=repr) == expected and expected


def test_streaming_tumbling(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "feed"))
    feed = windows.read_feed(spark, str(tmp_path / "feed"), events.schema)
    stream = windows.tumbling(feed, "ts", "event_type", "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    batch = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(spark.table("tumbled").collect()) == sorted(batch.collect())

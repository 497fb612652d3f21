"""The toxicity chain fitted on Spark: equal to the plain one, and what reaches the driver does not follow the lengths of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratica.llm import toxicity
from stratica.llm.common import map_rows
from tests.llm.fixtures import FIRST, awkward


def test_chain_on_spark_equals_the_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").unionByName(spark.range(FIRST, FIRST + 12).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic")))
    rows = sorted((str(r["doc_id"]), r["text"] or "", r["toxic"]) for r in docs.join(labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect())
    features = [toxicity.distinct_features(toxicity.words_of(text.encode())) for _, text, _ in rows]
    plain = toxicity.fit(features, np.array([[float(y)] for *_, y in rows]), toxicity.CATEGORIES, ["toxic"])
    for parts in (1, 7):
        chain = toxicity.fit_chain(docs.repartition(parts), labels)
        assert chain.names == plain.names and chain.table == plain.table and len(chain.table) > 10
        assert np.array_equal(chain.weights, plain.weights) and np.array_equal(chain.earlier, plain.earlier) and np.array_equal(chain.bias, plain.bias)


def test_long_texts_stay_off_the_driver(spark, monkeypatch):
    """60 texts of 6,000 words of their own: their features are 8 MB, the chain needs a few of them."""
    word = F.concat(F.lit("w"), F.hex(F.xxhash64("id", "k")))
    docs = spark.range(60).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5_999)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word), F.when(F.col("id") % 3 == 0, "vile").otherwise("kind")).alias("text")).withColumnRenamed("id", "doc_id")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    sizes, frame = [], type(docs)
    before = frame.toArrow

    def watched(self):
        sizes.append((found := before(self)).nbytes)
        return found

    monkeypatch.setattr(frame, "toArrow", watched)
    chain = toxicity.fit_chain(docs, labels)
    assert sizes and max(sizes) < 100_000
    assert {r["doc_id"] for r in toxicity.score_toxicity(docs, chain).where("is_toxic").collect()} == set(range(0, 60, 3))


def test_few_long_texts_are_read_at_once(spark):
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    try:
        map_rows(spark.range(1), lambda batches: batches, "id long")
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    finally:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", before)

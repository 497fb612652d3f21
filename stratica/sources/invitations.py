"""Appointments that came by mail, read once: a manifest of mails by path, size and time tells which files have to be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratica.sources import readers
from stratica.sources.records import below, manifest

#: A part of the manifest: rows of another shape count as changed.
VERSION = 1
FACTS = [c.split()[0] for c in readers.INVITE.split(", ") if c.split()[0] not in ("path", "error")]
#: Files that are named to one read; further ones are a read of their own.
TOGETHER = 10_000


def invitation_round(spark: SparkSession, root: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, facts) of the mails below a root.

    ``manifest``: rel, mtime, size, version, facts (array; empty for mails without an appointment) and ``reused``.  Files whose size and
    time are those of ``known`` keep their facts and are not opened; vanished ones go; one that cannot be read has no row, so the next
    round tries again.  ``facts``: rel and the columns of ``readers.invitations``.
    """
    now = manifest(spark, root, "outlook")
    if known is None:
        todo, kept = now, None
        found = readers.invitations(spark, root)
    else:
        same = known.where(F.col("version") == VERSION).select("rel", "mtime", "size", "version", "facts")
        kept = same.join(now, ["rel", "mtime", "size"], "left_semi").withColumn("reused", F.lit(True))
        todo = now.join(kept.select("rel"), "rel", "left_anti")
        paths = [f"{root.rstrip('/')}/{r['rel']}" for r in todo.select("rel").toLocalIterator()]  # what has changed since the last round
        found = None
        for at in range(0, len(paths), TOGETHER):
            own = readers.invitations(spark, paths[at : at + TOGETHER])
            found = own if found is None else found.unionByName(own)
    if found is None:
        fresh = kept.where("false")
    else:
        rows = found.withColumn("rel", below(root, F.col("path")))
        broken = rows.where("error is not null").select("rel").distinct()
        facts = rows.where("error is null").groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("position", *[c for c in FACTS if c != "position"]))).alias("facts"))  # the appointments of one mail
        read = todo.join(broken, "rel", "left_anti").join(facts, "rel", "left")
        none = F.array().cast(facts.schema["facts"].dataType)
        fresh = read.select("rel", "mtime", "size", F.lit(VERSION).alias("version"), F.coalesce("facts", none).alias("facts"), F.lit(False).alias("reused"))
    whole = fresh if kept is None else kept.unionByName(fresh)
    return whole, whole.select("rel", F.explode("facts").alias("_f")).select("rel", "_f.*")

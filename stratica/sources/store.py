"""Versioned tables in a folder: one manifest names the live folders of every table, and the highest complete manifest counts.

A change writes new folders and then one new manifest, made by one atomic create under the next number: of two writers one
fails (``StoreChanged``), and a reader finds the old version or the new one, also while a manifest is half written.  Tables
that a change does not name keep their folders.

A table may be kept in buckets by the hash of a column; then a change reads and rewrites only the buckets that its rows
fall into.  A table may also grow by segments, which a reader puts one below another.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
ATTEMPTS = 5


class StoreChanged(RuntimeError):
    """Another writer has changed what this one had read."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, name: str, text: str) -> bool:
    """Create a small file; False if there is one already."""
    path, system = _path(spark, name)
    try:
        stream = system.create(path, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _read_text(spark: SparkSession, path) -> str:
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _manifests(spark: SparkSession, base: str) -> list[tuple[int, object]]:
    """Numbers and paths of the manifests, the newest first."""
    path, system = _path(spark, f"{base}/manifests")
    if not system.exists(path):
        return []
    found = [s.getPath() for s in system.listStatus(path)]
    numbered = [(int(p.getName().split(".")[0]), p) for p in found if p.getName().split(".")[0].isdigit() and p.getName().endswith(".json")]
    return sorted(numbered, key=lambda x: -x[0])


def read_info(spark: SparkSession, base: str) -> dict | None:
    """What the newest complete manifest says, or None without one."""
    for number, path in _manifests(spark, base):
        try:
            info = json.loads(_read_text(spark, path))
        except ValueError:  # half written
            continue
        return info | {"number": number}
    return None


def change(spark: SparkSession, base: str, edit: Callable[[dict], dict], seen: int | None = None) -> dict:
    """Make ``edit`` of the newest manifest the next one.  With ``seen`` nobody may have written since that number was read."""
    for _ in range(ATTEMPTS):
        old = read_info(spark, base) or {"number": 0, "parser": 0, "vectors": None, "tables": {}}
        if seen is not None and old["number"] != seen:
            raise StoreChanged(f"{base} is at {old['number']}, not {seen}")
        new = edit({**old, "tables": dict(old["tables"])})
        number = max([old["number"], *[n for n, _ in _manifests(spark, base)][:1]]) + 1
        if _create(spark, f"{base}/manifests/{number:012d}.json", json.dumps({k: v for k, v in new.items() if k != "number"})):
            return new | {"number": number}
    raise StoreChanged(f"{base} is changed all the time")


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _write_folder(base: str, name: str, table: DataFrame) -> str:
    folder = f"data/{name}-{uuid.uuid4().hex}"
    table.write.parquet(f"{base}/{folder}")
    return folder


def _write_buckets(base: str, name: str, table: DataFrame, by: str, buckets: int) -> dict[str, str]:
    """Write rows into a folder for each bucket; bucket numbers and their folders."""
    spark = table.sparkSession
    folder = f"data/{name}-{uuid.uuid4().hex}"
    table.withColumn(BUCKET, bucket_of(F.col(by), buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{base}/{folder}")
    path, system = _path(spark, f"{base}/{folder}")
    found = [s.getPath().getName() for s in system.listStatus(path)]
    return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith(f"{BUCKET}=")}


def _plain(table: DataFrame, folder: str) -> dict:
    return {"folders": [folder], "schema": table.schema.json()}


def stage(base: str, name: str, table: DataFrame, by: str | None = None, buckets: int = 64) -> dict:
    """Write a table that no manifest names yet; what a manifest is to say of it (``write_version``'s ``ready``).

    With ``by`` its rows are dealt to buckets by the hash of that column, so that ``merged`` can change a few of them.
    """
    if by is None:
        return _plain(table, _write_folder(base, name, table))
    return {"by": by, "buckets": buckets, "parts": _write_buckets(base, name, table, by, buckets), "schema": table.schema.json()}


def stage_clustered(base: str, name: str, table: DataFrame, by: str, buckets: int) -> dict:
    """Write a table in Spark's own buckets by the hash of a column, sorted by it: two such tables with as many buckets are joined by it without a shuffle."""
    spark, passing = table.sparkSession, f"stratica_{uuid.uuid4().hex}"
    folder = f"data/{name}-{uuid.uuid4().hex}"
    table.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", f"{base}/{folder}").saveAsTable(passing)
    spark.sql(f"DROP TABLE {passing}")  # an external table: its files stay
    return _plain(table, folder) | {"clustered": [by, buckets]}


def _clustered(spark: SparkSession, base: str, entry: dict) -> DataFrame:
    """Buckets are no property of files, so the session's catalog is told of them under the folder's name."""
    from pyspark.sql import types as T

    (by, buckets), folder = entry["clustered"], entry["folders"][0]
    name = "stratica_" + "".join(c if c.isalnum() else "_" for c in folder.rsplit("/", 1)[-1])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(entry["schema"])).fields)
    place = f"{base}/{folder}".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def staged(spark: SparkSession, base: str, entry: dict) -> DataFrame:
    """The rows of a staged table."""
    if "clustered" in entry:
        return _clustered(spark, base, entry)
    return _read(spark, base, entry, sorted(entry["parts"].values()) if "parts" in entry else entry["folders"])


def discard(spark: SparkSession, base: str, entry: dict) -> None:
    """Delete a staged table that no manifest names."""
    for folder in entry.get("folders") or {f.split("/_")[0] for f in entry["parts"].values()}:
        path, system = _path(spark, f"{base}/{folder}")
        system.delete(path, True)


def write_version(base: str, tables: dict[str, DataFrame], parser: int = 1, ready: dict[str, dict] | None = None) -> int:
    """Write tables and make them count together with those that are ``ready``; tables of the store that are not named stay.  The new version's number."""
    spark = next(iter(tables.values())).sparkSession
    made = {**(ready or {}), **{name: stage(base, name, table) for name, table in tables.items()}}
    return change(spark, base, lambda info: info | {"parser": parser, "tables": {**info["tables"], **made}})["number"]


def grown(info: dict, name: str, entry: dict) -> dict:
    """What a manifest says of a table with a staged segment more."""
    old = info["tables"].get(name)
    return entry if old is None else old | {"folders": [*old["folders"], *entry["folders"]]}


def appended(base: str, tables: dict[str, DataFrame]) -> int:
    """Add a segment to each of these tables (a table that is not there begins with it), all at once."""
    spark = next(iter(tables.values())).sparkSession
    segments = {name: stage(base, name, table) for name, table in tables.items()}
    return change(spark, base, lambda info: info | {"tables": {**info["tables"], **{n: grown(info, n, e) for n, e in segments.items()}}})["number"]


def _read(spark: SparkSession, base: str, table: dict, folders: Sequence[str]) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType.fromJson(json.loads(table["schema"]))
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/{f}" for f in folders])


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """A table of the version that counts, or None."""
    info = read_info(spark, base)
    return staged(spark, base, info["tables"][name]) if info and name in info["tables"] else None


def save_vectors(base: str, vectors: DataFrame, embedding: str = "embedding") -> str:
    """Write vectors at length one under a new name, and let the manifest name them; zero vectors stay zero."""
    spark = vectors.sparkSession
    squares = F.aggregate(F.transform(embedding, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = F.transform(F.array(F.sqrt(squares)), lambda n: F.transform(embedding, lambda x: F.when(n > 0, (x / n).cast("float")).otherwise(x.cast("float"))))[0]
    name = _write_folder(base, "vectors", vectors.withColumn(embedding, length))
    change(spark, base, lambda info: info | {"vectors": name})
    return name


def read_vectors(spark: SparkSession, base: str) -> DataFrame | None:
    info = read_info(spark, base)
    return spark.read.parquet(f"{base}/{info['vectors']}") if info and info.get("vectors") else None


def reusable(spark: SparkSession, base: str, columns: list[str], parser: int) -> DataFrame | None:
    """The old chunks that a new index may reuse: none if an older parser made them or a column is missing."""
    info = read_info(spark, base)
    old = read_table(spark, base, "chunks") if info and info["parser"] == parser else None
    return old if old is not None and set(columns) <= set(old.columns) else None


def stage_merge(base: str, info: dict, name: str, changes: DataFrame, gone: DataFrame, key: str, buckets: int | None = None) -> dict:
    """A table with changed rows in place of those of their keys and without gone ones, staged; untouched buckets keep their folders.

    ``buckets``: into how many a table is dealt by the key that begins with this change (None: none).
    """
    from stratica.operators.sequences import upsert

    spark = changes.sparkSession
    table = info["tables"].get(name)
    if table is None:
        return stage(base, name, changes.join(gone.select(key), key, "left_anti").select(*changes.columns), key if buckets else None, buckets or 0)
    if "parts" not in table:
        old = staged(spark, base, table)
        return stage(base, name, upsert(old, changes, key).join(gone.select(key), key, "left_anti").select(*old.columns))
    by, n = table["by"], table["buckets"]
    touched = sorted(r[0] for r in changes.select(by).unionByName(gone.select(by)).select(bucket_of(F.col(by), n)).distinct().collect())  # bucket numbers
    old = _read(spark, base, table, [table["parts"][str(b)] for b in touched if str(b) in table["parts"]])
    rows = upsert(old, changes, key).join(gone.select(key), key, "left_anti").select(*old.columns)
    fresh = _write_buckets(base, name, rows, by, n) if touched else {}
    return table | {"parts": {b: f for b, f in table["parts"].items() if int(b) not in touched} | fresh}


def merged(base: str, name: str, changes: DataFrame, gone: DataFrame, key: str, pointer: str | None = None, buckets: int | None = None) -> int:
    """One transaction on a stored table: changed rows replace, gone ones go, and the feed's pointer moves, all by one new version.

    In a table with buckets only those that a changed or gone row falls into are read and written: its bucket column must be
    the key, or one that never changes for a key and that ``gone`` has too.  Other tables stay.  The same change made twice
    gives the same table.  A table that is not there begins with the changes.
    """
    spark = changes.sparkSession
    info = read_info(spark, base) or {"number": 0, "tables": {}}
    made = {name: stage_merge(base, info, name, changes, gone, key, buckets), f"{name}_pointer": stage(base, f"{name}_pointer", spark.createDataFrame([(pointer,)], "pointer string"))}
    return change(spark, base, lambda now: now | {"tables": {**now["tables"], **made}}, seen=info["number"])["number"]


def replaced_versions(files: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(write, keep, journal) for files (rel, sha256) about to be written: only different content is written, what it replaces is kept under the start of its hash, and each write is journalled."""
    changed = new.join(files.select("rel", F.col("sha256").alias("_old")), "rel", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("sha256")))
    keep = changed.where("_old is not null").select("rel", F.col("_old").alias("sha256"), F.concat_ws("/", F.lit("versions"), "rel", F.left("_old", F.lit(16))).alias("kept"))
    return changed.select("rel", "sha256"), keep, changed.select(F.lit("write").alias("op"), "rel", "sha256")

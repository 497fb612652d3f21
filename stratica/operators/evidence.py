"""The chain of evidence: integrity, the current state of files, sweeps of the disk and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Kinds of lines that say what a file holds.
CONTENT = ("initial", "write", "outside", "moved")


def broken_lines(lines: DataFrame, by: str, number: str, line: str, prev: str, heads: DataFrame | None = None) -> DataFrame:
    """(by, broken): the place of the first line of each chain that does not follow the one before it.

    Lines are numbered from 1: the first has no ``prev``, each other the hash of the line numbered one less.  A line that
    was deleted, altered, repeated or put in front breaks the chain at the line after it.  ``heads`` (by, head) name the hash
    of the last line, whose own alteration no line would show.  Lines meet by number, so no chain lands in one task.
    """
    hashed = lines.select(by, F.col(number).alias("_n"), F.sha2(F.coalesce(line, F.lit("")), 256).alias("_hash"), F.col(prev).alias("_prev"))
    before = hashed.groupBy(by, (F.col("_n") + 1).alias("_n")).agg(F.min("_hash").alias("_before"), F.count("*").alias("_many"))
    checked = hashed.join(before, [by, "_n"], "left")
    follows = F.when(F.col("_n") == 1, F.col("_prev").isNull()).otherwise((F.col("_many") == 1) & F.col("_before").eqNullSafe(F.col("_prev")))
    wrong = checked.where(~F.coalesce(follows, F.lit(False))).groupBy(by).agg(F.min("_n").alias("_first"))
    if heads is not None:
        last = hashed.groupBy(by).agg(F.max(F.struct("_n", "_hash")).alias("_last")).join(heads, by).where(~F.col("_last._hash").eqNullSafe(F.col("head"))).select(by, F.col("_last._n").alias("_first"))
        wrong = wrong.unionByName(last).groupBy(by).agg(F.min("_first").alias("_first"))
    return hashed.join(wrong, by).where("_n <= _first").groupBy(by).agg(F.count("*").alias("broken"))


def verified(lines: DataFrame, by: str, number: str, line: str, prev: str, disk: DataFrame, heads: DataFrame | None = None, accepted: DataFrame | None = None, content: tuple[str, ...] = CONTENT, ended: tuple[str, ...] = ("removed", "missing")) -> DataFrame:
    """One row for each chain: ``lines``, ``broken`` (as ``broken_lines``; null: whole), and how its files lie on the disk.

    A file's last line says what it should be: ``unchanged``, ``changed``, ``accepted`` (changed, and the keeper has acknowledged this very content) or ``missing``.
    ``lines`` also have kind (those of ``content`` say what a file holds, those of ``ended`` that it is gone), rel and sha256;
    ``disk`` and ``accepted`` have rel and sha256.  Lines are hashed where they are read, and files meet the disk by path.
    """
    total = lines.groupBy(by).agg(F.count("*").alias("lines"))
    broken = broken_lines(lines, by, number, line, prev, heads)
    last = lines.where(F.col("kind").isin(*content, *ended)).groupBy(by, "rel").agg(F.max_by(F.struct("kind", "sha256"), number).alias("_l")).where(~F.col("_l.kind").isin(*ended))
    known = disk.groupBy("rel").agg(F.max("sha256").alias("_now"))
    rows = last.select(by, "rel", F.col("_l.sha256").alias("_was")).join(known, "rel", "left")
    if accepted is None:
        rows = rows.withColumn("_ok", F.lit(False))
    else:
        own = accepted.select("rel", F.col("sha256").alias("_now"), F.lit(True).alias("_ok")).distinct()
        rows = rows.join(own, ["rel", "_now"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    same, there = F.col("_now").eqNullSafe(F.col("_was")), F.col("_now").isNotNull()
    counts = {"unchanged": there & same, "changed": there & ~same & ~F.col("_ok"), "accepted": there & ~same & F.col("_ok"), "missing": ~there}
    files = rows.groupBy(by).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    return total.join(broken, by, "left").join(files, by, "left")


def current(lines: DataFrame, rel: str, number: str, kind: str, ended: tuple[str, ...], keep: list[str]) -> DataFrame:
    """The last line of each path, without paths whose last line ended them."""
    last = lines.groupBy(rel).agg(F.max_by(F.struct(kind, number, *keep), number).alias("_l"))
    return last.select(rel, "_l.*").where(~F.col(kind).isin(*ended))


def sweep(disk: DataFrame, index: DataFrame, journal: DataFrame, first_run: bool = False, versions: str = "versions/") -> DataFrame:
    """(rel, state, source) for every path of the disk or the index; ``source`` is where a moved file was before.

    ``disk`` and ``index`` have rel, size, mtime_ns, sha256; ``journal`` has seq, op (write, removed, moved), rel, sha256 and
    other (where a moved file went), and is read by ``pending``: a path's last write announces content, and a removal or move counts unless a
    write came after.  Unchanged by size and time unless a write was announced; the same hash only refreshes the stat; a new
    path is a kept version (below ``versions``), initial (first run), moved, written or from outside; a changed one written
    or from outside; a vanished one removed or missing.
    """
    writes, gone = pending(journal)
    announced = writes.select("rel", F.lit(True).alias("_announced"), F.col("sha256").alias("_written"))
    left = gone.select("rel", F.lit(True).alias("_left"))
    came = gone.where("op = 'moved' and other is not null").groupBy(F.col("other").alias("rel")).agg(F.max("rel").alias("_from"))
    side = lambda df, name: df.select("rel", F.struct("size", "mtime_ns", "sha256").alias(name))
    both = side(disk, "_d").join(side(index, "_i"), "rel", "full_outer").join(announced, "rel", "left").join(left, "rel", "left").join(came, "rel", "left")
    d, i = (lambda c: F.col(f"_d.{c}")), (lambda c: F.col(f"_i.{c}"))
    moved = F.col("_i").isNull() & F.col("_from").isNotNull()
    changed = (
        F.when(F.col("rel").startswith(versions), "version").when(F.lit(first_run), "initial").when(moved, "moved")
        .when(F.coalesce(F.col("_written") == d("sha256"), F.lit(False)), "write").otherwise("outside")
    )
    state = (
        F.when(F.col("_d").isNull(), F.when(F.col("_left"), "removed").otherwise("missing"))
        .when((d("size") == i("size")) & (d("mtime_ns") == i("mtime_ns")) & F.col("_announced").isNull(), "unchanged")
        .when(d("sha256") == i("sha256"), "refreshed")
        .otherwise(changed)
    )
    return both.select("rel", state.alias("state"), F.when(state == "moved", F.col("_from")).alias("source"))


def verdict(present: Column, chain_ok: Column, recorded: Column, now: Column, kind: Column, announced: Column) -> Column:
    """What can be said about a file, in fixed order of precedence."""
    return (
        F.when(~present, "missing")
        .when(~chain_ok, "chain_broken")
        .when(recorded.isNull(), "not_yet_chained")
        .when(now == recorded, F.when(kind == "outside", "unchanged_outside_version").otherwise("unchanged"))
        .when(announced == now, "changed_by_app")
        .otherwise("changed_outside")
    )


def covering_stamp(lines: DataFrame, number: str, stamps: DataFrame, stamp: str, levels: int = 3) -> DataFrame:
    """For each line the first stamp at or after it; null behind the last stamp and for lines without a number.

    Lines and stamps meet in blocks of 65,536 numbers, by a window that runs from a block's end to its start.  The first stamp
    behind a block comes in as one more row at its end; the same search finds it, over the numbers of blocks.  After three
    levels 16 bits of a long are left, so no task gets more than a block, wherever numbers lie.
    """
    from pyspark.sql import Window

    width, block = 16, F.shiftright("_n", 16)
    wanted = lines.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("_n"))
    marks = stamps.where(F.col(stamp).isNotNull()).select(F.col(stamp).cast("long").alias("_n")).distinct()
    rows = wanted.select("_n", F.lit(None).cast("long").alias("_s"), F.lit(False).alias("_mark")).unionByName(marks.select("_n", F.col("_n").alias("_s"), F.lit(True).alias("_mark")))
    if levels:
        firsts = marks.groupBy(block.alias("_block")).agg(F.min("_n").alias("_s"))
        behind = covering_stamp(wanted.select((block + 1).alias("_behind")).distinct(), "_behind", firsts, "_block", levels - 1)
        end = F.shiftleft(F.col("_behind") - 1, width).bitwiseOR(F.lit((1 << width) - 1))
        rows = rows.unionByName(behind.join(firsts, F.col("stamp") == F.col("_block")).select(end.alias("_n"), "_s", F.lit(True).alias("_mark")))
    # a frame from the start is extended row by row; one to the end would be summed up anew for each row
    own = Window.partitionBy(block if levels else F.lit(0)).orderBy(F.desc("_n"))
    found = rows.withColumn("stamp", F.min("_s").over(own)).where("not _mark")
    kind = lines.schema[number].dataType
    return found.select(F.col("_n").cast(kind).alias(number), "stamp").unionByName(lines.where(F.col(number).isNull()).select(number, F.lit(None).cast("long").alias("stamp")))


def names_of(moves: DataFrame) -> DataFrame:
    """(rel, name): every name of the same file, itself too: renames and moves followed in both directions.

    ``moves``: kind (moved or removed), rel, other (the successor).  Only names that a move knows are listed.  Names that
    moves join are one class, found without pairs; removals lead backwards from class to class.  Pairs of names are made
    last, by one join over classes, and are not shuffled.
    """
    from stratica.operators import graph
    from stratica.storage import drop_stored, stored

    pairs = moves.where("kind in ('moved', 'removed') and rel is not null and other is not null and rel <> other")
    # backwards over both kinds, forwards over moves alone
    removed = stored(pairs.where("kind = 'removed'").select("rel", "other").distinct(), "removals")
    alone = removed.select(F.explode(F.array("rel", "other")).alias("rel")).select("rel", F.col("rel").alias("other"))
    joined = graph.components(pairs.where("kind = 'moved'").select("rel", "other").unionByName(alone), "rel", "other")
    side = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    steps = stored(removed.join(side("rel"), "rel").join(side("other"), "other").where("_rel <> _other").select("_other", "_rel").distinct(), "steps")
    named = side("name").select("name", F.col("_name").alias("root"))
    same = side("rel").join(named, F.col("_rel") == F.col("root")).select("rel", "name")
    drop_stored(removed)
    if steps.isEmpty():
        return same
    before = graph.closure(steps, "_other", "_rel").where("node <> above")
    return same.unionByName(side("rel").join(before, F.col("_rel") == F.col("node")).select("rel", "above").join(named, F.col("above") == F.col("root")).select("rel", "name"))


def file_classes(moves: DataFrame) -> DataFrame:
    """(name, file): the smallest of all names that moves join, for each of them; one row for each name instead of all pairs."""
    from stratica.operators import graph

    own = moves.where("kind = 'moved'")
    return graph.components(own, "rel", "other").select(F.col("node").alias("name"), F.col("root").alias("file"))


def history_of(lines: DataFrame, names: DataFrame, current: DataFrame) -> DataFrame:
    """(rel, sha256, n, kind, current): every version of each file under any of its names, by the line that first saw it.

    ``lines``: n, rel, kind, sha256; ``names``: rel, name; ``current``: rel, sha256.
    """
    all_names = names.unionByName(lines.select("rel").distinct().select("rel", F.col("rel").alias("name"))).distinct()
    seen = lines.where("sha256 is not null and kind not in ('removed', 'missing', 'version')").select(F.col("rel").alias("name"), "sha256", "n", "kind")
    first = all_names.join(seen, "name").groupBy("rel", "sha256").agg(F.min(F.struct("n", "kind")).alias("_f"))
    now = current.select("rel", F.col("sha256").alias("_now"))
    return first.join(now, "rel", "left").select("rel", "sha256", "_f.n", "_f.kind", F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False)).alias("current"))


def pending(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes, gone) of a journal (seq, op, rel, sha256, other): the last write of each path, and its last removal or move unless a write came after."""
    writes = journal.where("op = 'write' and rel is not null").groupBy("rel").agg(F.max(F.struct("seq", "sha256")).alias("_w")).select("rel", "_w.*")
    gone = journal.where("op in ('removed', 'moved') and rel is not null").groupBy("rel").agg(F.max(F.struct("seq", "op", "other")).alias("_g")).select("rel", "_g.*")
    later = gone.join(writes.select("rel", F.col("seq").alias("_written")), "rel", "left")
    return writes, later.where("_written is null or seq > _written").drop("_written")


def chain_lines(spark, folder: str) -> DataFrame:
    """(path, place, line, n, prev, kind, rel, sha256) of evidence files: one JSON text a line; those that cannot be read keep their place with nulls."""
    schema = "n long, prev string, kind string, rel string, sha256 string, at string"
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\n$", "").alias("value"))
    lines = text.select("path", F.posexplode(F.split("value", "\n", -1)).alias("_at", "line"))
    return lines.select("path", (F.col("_at") + 1).cast("long").alias("place"), "line", F.from_json("line", schema).alias("_d")).select("path", "place", "line", "_d.*")


def appended(heads: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """(by, n, prev, line, hash) of new lines of each chain: each names the hash of the one before, so a chain's batch is written in order by one task.

    ``heads``: by, n, head (the last line's number and hash); ``facts``: by, at, body (JSON text).  Batches are what one run adds.
    """
    import hashlib
    import json

    import pandas as pd

    kind = facts.schema[by].dataType.simpleString()

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "body"])
        n, prev, out = int(rows["_n"].iloc[0]), rows["_head"].iloc[0] or None, []
        for body in rows["body"]:
            n += 1
            line = json.dumps({"n": n, "prev": prev, **json.loads(body)}, ensure_ascii=False)
            out.append((key[0], n, prev, line, hashlib.sha256(line.encode()).hexdigest()))
            prev = out[-1][-1]
        return pd.DataFrame(out, columns=[by, "n", "prev", "line", "hash"])

    started = facts.join(heads.select(by, F.col("n").alias("_n"), F.col("head").alias("_head")), by, "left").fillna({"_n": 0, "_head": ""})
    return started.groupBy(by).applyInPandas(write, f"{by} {kind}, n long, prev string, line string, hash string")


def message_versions(messages: DataFrame) -> DataFrame:
    """(id, back, sha256, modified, kind): every version of a message that the store holds, the newest first (0).

    ``messages``: id, body, subject, modified, deleted, earlier (array of body, subject, at).
    """
    said = lambda body, subject: F.sha2(F.to_json(F.array(F.coalesce(body, F.lit("")), F.coalesce(subject, F.lit("")))), 256)
    now = F.struct(said(F.col("body"), F.col("subject")).alias("sha256"), F.col("modified").cast("string").alias("modified"), F.when(F.col("deleted").isNotNull(), "deleted").otherwise("current").alias("kind"))
    before = F.transform(F.coalesce("earlier", F.array().cast("array<struct<body:string,subject:string,at:string>>")), lambda e: F.struct(said(e["body"], e["subject"]).alias("sha256"), e["at"].cast("string").alias("modified"), F.lit("earlier").alias("kind")))
    rows = messages.select("id", F.posexplode(F.reverse(F.concat(before, F.array(now)))).alias("back", "_v"))
    return rows.select("id", F.col("back").cast("long").alias("back"), "_v.*")


def acknowledged(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings (rel, sha256) that the keeper has not acknowledged for this very content."""
    return findings.join(accepted.select("rel", "sha256"), ["rel", "sha256"], "left_anti")


def is_archive_file(name: Column) -> Column:
    """Whether a walk counts a file: no bookkeeping, hidden or half-written file."""
    return ~(name.startswith("state.db") | name.startswith(".") | name.endswith(".tmp") | name.endswith(".teil"))


def kept_versions(files: DataFrame, folder: Column, size: str) -> DataFrame:
    """One row: number and bytes of kept versions."""
    return files.where(folder).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def upstream_match(history: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, sha256, agrees): whether the content that the service named for a file is the one that was recorded; null where it named none."""
    return history.join(files.select("rel", "sha256", "hash", "service_hash"), ["rel", "sha256"]).select("rel", "sha256", F.when(F.col("service_hash").isNotNull(), F.col("hash") == F.col("service_hash")).alias("agrees"))


def xor_hash(content: Column) -> Column:
    """The 160-bit hash by which file services compare contents: every byte is turned 11 bits further and all are combined by exclusive or, with the length at the end."""
    import pandas as pd

    def of(data: bytes | None) -> bytes | None:
        import numpy as np

        if data is None:
            return None
        padded = np.frombuffer(bytes(data) + bytes(-len(data) % 160), dtype=np.uint8).reshape(-1, 160)
        value, ring = 0, (1 << 160) - 1
        for place, byte in enumerate(np.bitwise_xor.reduce(padded, axis=0).tolist() if len(padded) else []):
            turned = byte << (place * 11 % 160)
            value ^= (turned & ring) | (turned >> 160)
        return (value ^ len(data) << 96).to_bytes(20, "little")

    return F.base64(F.pandas_udf(lambda contents: pd.Series([of(c) for c in contents], dtype=object), "binary")(content))

"""The organisation of a directory: who belongs to it, lines upwards and downwards, roles, names that are looked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratica.operators import graph
from stratica.operators.filters import last_match


def name_paths(people: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, path): the names from the top down to each person, with slashes between."""
    names = people.select(F.col("id").alias("above"), F.replace(F.coalesce("name", F.col("id").cast("string")), F.lit("/"), F.lit("-")).alias("_name"))
    above = reach.where("node <> above").join(names, "above").groupBy(F.col("node").alias("id")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("distance", "_name")))).alias("_up"))
    own = names.select(F.col("above").alias("id"), "_name").join(above, "id", "left")
    return own.select("id", F.concat_ws("/", F.transform(F.coalesce("_up", F.array().cast("array<struct<distance:int,_name:string>>")), lambda x: x["_name"]), F.array("_name")).alias("path"))


def build(users: DataFrame, rules: Sequence[tuple[bool, str]] = ()) -> DataFrame:
    """The people of an organisation (id, name, title, department, manager, disabled) from all directory users.

    Guests are left out.  A disabled account stays only in the line above someone who is kept, and nobody stays without a
    manager or reports.  ``rules``, of which the last that matches counts, narrow it over each person's path of names.
    ``users``: id, displayName, jobTitle, department, accountEnabled, userType, manager.
    """
    member = F.coalesce("userType", F.lit("Member")) == "Member"
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = users.where(member).select("id", clean("displayName").alias("name"), clean("jobTitle").alias("title"), clean("department").alias("department"), "manager", (~F.coalesce("accountEnabled", F.lit(True))).alias("disabled"))
    known = own.select(F.col("id").alias("manager"), F.lit(True).alias("_known"))
    people = own.join(known, "manager", "left").withColumn("manager", F.when(F.col("_known") & (F.col("manager") != F.col("id")), F.col("manager"))).drop("_known")
    edges = graph.cut_circles(people.where("manager is not null").select("id", "manager"), "id", "manager")
    reach = graph.closure(edges, "id", "manager")
    active = people.where("not disabled").select("id")
    if rules:
        active = active.join(name_paths(people, reach).where(last_match(F.col("path"), rules)).select("id"), "id", "left_semi")
    # disabled accounts between someone kept and the next kept one above
    lines = reach.join(active.select(F.col("id").alias("node")), "node", "left_semi")
    nearest = lines.join(active.select(F.col("id").alias("above")), "above", "left_semi").groupBy("node").agg(F.min("distance").alias("_stop"))
    between = lines.join(nearest, "node", "left").where(F.col("_stop").isNull() | (F.col("distance") < F.col("_stop")))
    links = between.join(people.where("disabled").select(F.col("id").alias("above")), "above", "left_semi").select(F.col("above").alias("id")).distinct()
    kept = people.join(active.unionByName(links).distinct(), "id", "left_semi")
    there = kept.select(F.col("id").alias("manager"), F.lit(True).alias("_there"))
    kept = kept.join(there, "manager", "left").withColumn("manager", F.when(F.col("_there"), F.col("manager"))).drop("_there")
    managers = kept.where("manager is not null").select(F.col("manager").alias("id")).distinct().withColumn("_reports", F.lit(True))
    placed = kept.join(managers, "id", "left").where("manager is not null or _reports")
    return placed.select("id", "name", "title", "department", "manager", "disabled")


def canonical(people: DataFrame) -> DataFrame:
    """(id, line): each person as one JSON text with fixed keys in fixed order, so that equal captures are equal files."""
    return people.select("id", F.to_json(F.struct("id", "name", "title", "department", "manager", F.when(F.col("disabled"), F.lit(True)).alias("disabled"))).alias("line"))


def find(people: DataFrame, wanted: str) -> DataFrame:
    """Whom a text names: the id, else the whole name, else a part of it; several of one kind are all returned, for the caller to ask."""
    low = wanted.strip().lower()
    name = F.lower(F.coalesce("name", F.lit("")))
    rank = F.when(F.lower(F.col("id").cast("string")) == low, 1).when(name == low, 2).when(name.contains(low), 3)
    ranked = people.withColumn("_rank", rank).where("_rank is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("_rank").alias("_rank"))), "_rank").drop("_rank")  # one row


def roles(people: DataFrame, contains: str = "", department: str = "") -> DataFrame:
    """(title, n): how many people have each title, narrowed by a part of it or of the department."""
    own = people.where(F.col("title").isNotNull() & ~F.col("disabled"))
    if contains:
        own = own.where(F.lower("title").contains(contains.lower()))
    if department:
        own = own.where(F.lower("department").contains(department.lower()))
    return own.groupBy("title").agg(F.count("*").alias("n"))


def roots(people: DataFrame, reach: DataFrame) -> DataFrame:
    """Those without a manager, the largest trees first; disabled people are not counted."""
    counted = reach.where("node <> above").join(people.where("not disabled").select(F.col("id").alias("node")), "node", "left_semi")
    sizes = counted.groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n"))
    return people.where("manager is null").join(sizes, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), F.lower("name"), "id")


def changes(old: DataFrame, new: DataFrame, fields: Sequence[str] = ("name", "title", "department")) -> DataFrame:
    """(id, kind, fields): joined, moved, changed and left, with the fields that differ, sorted."""
    kinds = graph.changes(old, new, "id", "manager", list(fields))
    both = old.select("id", F.struct(*fields).alias("_a")).join(new.select("id", F.struct(*fields).alias("_b")), "id")
    differ = both.select("id", F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in fields])).alias("fields"))
    return kinds.join(differ, "id", "left").select("id", "kind", F.array_sort(F.coalesce("fields", F.array().cast("array<string>"))).alias("fields"))


def without_manager(people: DataFrame, asked: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(id): members whose manager is to be asked for: they have none, and no answer of the last days says that there is none."""
    fresh = asked.where(F.col("at") > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
    missing = people.where("manager is null and not disabled").select("id")
    unknown = people.where("manager is not null").select(F.col("manager").alias("id")).distinct().join(people.select("id"), "id", "left_anti")
    return missing.join(fresh.select("id"), "id", "left_anti").unionByName(unknown)

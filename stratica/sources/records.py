"""Items of an archive from its files: pages, boards, lists, notes and mirrored files, all with the columns that the search has.

``rel`` is the path below the root; what a source keeps aside, half-written files and the app's own pages are no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratica.functions.text import collapse, strip_html, unescape
from stratica.functions.times import service_time

SET_ASIDE = "_fremd"
FILES_FOLDER, CHAT_FILES = "Dateien", "Anhaenge"


def below(root: str, path: Column) -> Column:
    """The path below a root folder, without scheme and percent codes."""
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    return F.substring(plain(path), F.length(plain(F.lit(root.rstrip("/")))) + 2, F.lit(1 << 30))


def wanted(source: str, rel: Column) -> Column:
    """Which files of a source are items."""
    parts = F.split(rel, "/", -1)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    archived = parts[0] != SET_ASIDE
    files = F.arrays_overlap(folders, F.array(F.lit(FILES_FOLDER), F.lit(CHAT_FILES)))
    html, whole = F.lower(name).endswith(".html"), ~name.endswith(".teil")
    return {
        "teams": html & ~name.isin("index.html", "search.html") & archived & ~files,
        "teams_files": whole & archived & files,
        "onenote": html & archived & ~F.exists(folders, lambda f: f.endswith(".files")),
        "outlook": F.lower(name).endswith(".eml") & archived,
        "onedrive": whole & (parts[0] == FILES_FOLDER),
        "sharepoint": whole & archived & (F.size(parts) > 3) & (F.try_element_at(parts, F.lit(3)) == FILES_FOLDER),
        "pages": html & archived,
        "kalender": F.lower(name).endswith(".ics"),
        "kontakte": F.lower(name).endswith(".vcf"),
    }[source]


def mirrored(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Items of mirrored files: names, sizes and times alone; their path is their text, so that folders are found too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(below(root, F.col("path")).alias("rel"), "length", "modificationTime")
    own = found.where(wanted("teams_files" if source == "teams" else source, F.col("rel")))
    name = F.substring_index("rel", "/", -1)
    folder = F.when(F.col("rel").contains("/"), F.regexp_replace("rel", "/[^/]*$", "")).otherwise(FILES_FOLDER)
    return own.select(F.concat(F.lit("datei:"), "rel", F.lit(":0")).alias("uid"), F.lit("datei").alias("src"), F.lit(source).alias("root"), "rel", F.lit("").alias("who"), F.col("modificationTime").alias("ts"), name.alias("title"), folder.alias("ctx"), name.alias("att"), F.replace("rel", F.lit("/"), F.lit(" / ")).alias("text"), F.col("length").alias("size"))


def manifest(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(rel, mtime, size) of a source's files, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(below(root, F.col("path")).alias("rel"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return found.where(wanted(source, F.col("rel")))


def page_title(html: Column, rel: Column) -> Column:
    title = collapse(unescape(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(F.substring_index(rel, "/", -1), r"\.[^.]*$", ""))


def page_items(pages: DataFrame, source: str, html: str = "html", rel: str = "rel", ts: str = "ts") -> DataFrame:
    """Items of pages (``rel, ts, html``): title and visible text; embedded data and the header that an export adds are no text."""
    plain = F.regexp_replace(html, '"data:[^"]*"', '""')
    body = F.regexp_replace(plain, r'(?s)<div class="mn-(?:kopf|weg)">.*?</div>', "") if source == "onenote" else plain
    folder = F.when(F.col(rel).contains("/"), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")
    return pages.select(F.concat(F.lit(f"{source}:"), rel, F.lit(":0")).alias("uid"), F.lit(source).alias("src"), F.lit(source).alias("root"), F.col(rel).alias("rel"), F.lit("").alias("who"), F.col(ts).alias("ts"), page_title(plain, F.col(rel)).alias("title"), folder.alias("ctx"), strip_html(body).alias("text"))


def read_pages(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Items of the page files below a root."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(root, wholetext=True)
    rows = found.select(below(root, F.input_file_name()).alias("rel"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("html"))
    return page_items(rows.where(wanted(source, F.col("rel"))), source)


TASK_JSON = (
    "task struct<title:string,bucketId:string,createdDateTime:string,lastModifiedDateTime:string,assignments:map<string,string>,body:struct<content:string,contentType:string>,"
    "checklistItems:array<struct<displayName:string>>,linkedResources:array<struct<displayName:string,applicationName:string>>>,"
    "details struct<description:string,checklist:map<string,struct<title:string>>,`references`:map<string,struct<alias:string>>>,"
    "kommentare array<struct<wer:string,wann:string,html:string>>,anhaenge array<struct<name:string>>,deleted string"
)


def lines(*parts: Column) -> Column:
    """Texts one below another, arrays of texts too, without white space around."""
    flat = F.flatten(F.array(*parts))
    return F.regexp_replace(F.array_join(F.transform(flat, lambda x: F.coalesce(x, F.lit(""))), "\n"), r"^\s+|\s+$", "")


def file_names(names: Column) -> Column:
    """Attachment names as one column: blanks become underscores, empty names go."""
    clean = F.transform(names, lambda n: F.replace(F.coalesce(n, F.lit("")), F.lit(" "), F.lit("_")))
    return F.nullif(F.array_join(F.filter(clean, lambda n: n != ""), "|"), F.lit(""))


def board_items(tasks: DataFrame, boards: DataFrame, people: DataFrame) -> DataFrame:
    """Items of boards: a task's description, checklist and comments; its time is the latest of creation and comments.

    ``tasks``: board (folder), task_id, entry (JSON); ``boards``: board, title, buckets (map id to name); ``people``: board, id, name.
    """
    read = tasks.select("board", "task_id", F.from_json("entry", TASK_JSON).alias("e")).select("board", "task_id", "e.*")
    names = people.groupBy("board").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("_names"))  # the people of one board
    rows = read.join(boards, "board", "left").join(names, "board", "left")
    known = F.coalesce("_names", F.create_map().cast("map<string,string>"))
    named = lambda ids: F.array_sort(F.transform(ids, lambda i: F.coalesce(F.try_element_at(known, i), i)))
    none = F.array().cast("array<string>")
    comments = F.coalesce("kommentare", F.array().cast("array<struct<wer:string,wann:string,html:string>>"))
    responsible = named(F.coalesce(F.map_keys("task.assignments"), none))
    speakers = F.array_distinct(named(F.filter(F.transform(comments, lambda k: F.coalesce(k["wer"], F.lit(""))), lambda w: w != "")))
    text = lines(F.array("details.description"), F.transform(F.coalesce(F.map_values("details.checklist"), F.array().cast("array<struct<title:string>>")), lambda c: c["title"]), F.transform(comments, lambda k: strip_html(k["html"])))
    ts = F.array_max(F.array_compact(F.concat(F.array(service_time(F.col("task.createdDateTime"))), F.transform(comments, lambda k: service_time(k["wann"])))))
    aliases = F.transform(F.coalesce(F.map_values("details.references"), F.array().cast("array<struct<alias:string>>")), lambda r: r["alias"])
    bucket = F.coalesce(F.try_element_at("buckets", "task.bucketId"), F.lit("?"))
    return rows.select(
        F.concat(F.lit("planner:"), "board", F.lit("/"), "task_id", F.lit(":0")).alias("uid"), F.concat(F.lit("planner:"), "task_id").alias("key"), F.lit("planner").alias("src"), F.lit("planner").alias("root"), F.concat("board", F.lit("/board.html")).alias("rel"),
        F.array_join(F.slice(F.when(F.size(responsible) > 0, responsible).otherwise(speakers), 1, 3), " · ").alias("who"), F.lower(F.array_join(F.concat(responsible, speakers), " ")).alias("ppl"), ts.alias("ts"),
        F.coalesce(F.nullif("task.title", F.lit("")), F.lit("(ohne Titel)")).alias("title"), F.concat_ws("/", F.coalesce("title", "board"), bucket).alias("ctx"), text.alias("text"), file_names(aliases).alias("att"), F.col("deleted").alias("gone"),
    )


def list_items(tasks: DataFrame, lists: DataFrame) -> DataFrame:
    """Items of task lists: body, steps and links; the time is that of the last change, else of creation.  ``tasks``: list, task_id, entry (JSON); ``lists``: list, title."""
    rows = tasks.select("list", "task_id", F.from_json("entry", TASK_JSON).alias("e")).select("list", "task_id", "e.*").join(lists, "list", "left")
    body = F.when(F.col("task.body.contentType") == "html", strip_html(F.col("task.body.content"))).otherwise(F.col("task.body.content"))
    steps = F.transform(F.coalesce("task.checklistItems", F.array().cast("array<struct<displayName:string>>")), lambda s: s["displayName"])
    links = F.transform(F.coalesce("task.linkedResources", F.array().cast("array<struct<displayName:string,applicationName:string>>")), lambda r: F.coalesce(F.nullif(r["displayName"], F.lit("")), r["applicationName"]))
    names = F.transform(F.coalesce("anhaenge", F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    return rows.select(
        F.concat(F.lit("todo:"), "list", F.lit("/"), "task_id", F.lit(":0")).alias("uid"), F.concat(F.lit("todo:"), "task_id").alias("key"), F.lit("todo").alias("src"), F.lit("todo").alias("root"), F.concat("list", F.lit("/list.html")).alias("rel"), F.lit("").alias("who"), F.lit("").alias("ppl"),
        F.coalesce(service_time(F.col("task.lastModifiedDateTime")), service_time(F.col("task.createdDateTime"))).alias("ts"), F.coalesce(F.nullif("task.title", F.lit("")), F.lit("(ohne Titel)")).alias("title"), F.coalesce("title", "list").alias("ctx"), lines(F.array(body), steps, links).alias("text"), file_names(names).alias("att"), F.col("deleted").alias("gone"),
    )


def with_tombstones(items: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Items with ``gone``, since when the source no longer has them; a mark of their own stays."""
    marks = tombstones.groupBy("root", "rel").agg(F.min("since").alias("_since"))
    own = F.col("gone") if "gone" in items.columns else F.lit(None).cast("string")
    return items.join(marks, ["root", "rel"], "left").withColumn("gone", F.coalesce(own, "_since")).drop("_since")


def calendar_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of calendar files (JSON with ``recs``)."""
    schema = "recs array<struct<uid:string,ts:double,rts:double,te:double,title:string,st:string,cal:string,place:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("recs").alias("r")).select("r.*")


def organisation_people(spark: SparkSession, path: str) -> DataFrame:
    """People of organisation files (JSON with ``people``), with the file's capture time."""
    schema = "captured string, people array<struct<id:string,name:string,title:string,department:string,manager:string,disabled:boolean>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("captured", F.explode("people").alias("p")).select("captured", "p.*")


def file_window(spark: SparkSession, path: str, offset: int, size: int) -> DataFrame:
    """(path, text, total, truncated): a window of bytes of each file as text; bytes that are no characters, as where it cuts one, become U+FFFD."""
    found = spark.read.format("binaryFile").load(path)
    part = F.substring("content", offset + 1, size)
    return found.select("path", F.make_valid_utf8(part.cast("string")).alias("text"), F.col("length").alias("total"), (F.col("length") > offset + size).alias("truncated"))

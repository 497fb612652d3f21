"""The archive as one object: every question that can be put to it is a method that returns a DataFrame.

An archive is a versioned store (``sources.store``) with the tables ``chunks``, ``people``, ``addresses`` and, as far as a
user has them, ``vectors``, ``series_dates``, ``calendar``, ``organisation``, ``cases``, ``case_items``, ``case_notes``,
``case_removed``, ``searches``, ``lines`` (evidence), ``moves``, ``runs`` and ``steps``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.operators import casebook, detail, evidence, facets, filters, graph, items, organisation, postings, rank, sequences
from stratica.operators import search as sr
from stratica.sources import item_records, readers, store

#: Buckets of chunks by the hash of their item.
BUCKETS = 64


def with_all_keys(rows: DataFrame) -> DataFrame:
    """Items with a key: their own, else one made of their path."""
    none = rows.select("src", "root", "rel", F.lit(None).cast("string").alias("id")).where("false")
    return items.with_keys(rows, none)


class Archive:
    """Questions to one archive.  A table that is asked for and not there is an error, never an empty answer."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    @classmethod
    def build(cls, base: str, sources: Sequence[DataFrame], parser: int = 1, horizon: str | None = None, **tables: DataFrame) -> Archive:
        """Write a new version from the items of all sources: chunks with their inverted index, people and addresses, and whatever other tables are given.

        ``horizon`` (a day): dates of the items' series up to it, as the table ``series_dates``.  All counts at once.
        """
        union = items.union_of_sources(*sources)
        spark, passing = union.sparkSession, store.stage(base, "items", union)  # files are read and parsed once
        chunks = items.chunk_rows(items.chunked(store.staged(spark, base, passing))).withColumn("cid", F.concat_ws("#", "uid", "seq"))
        entry = store.stage(base, "chunks", chunks, "uid", BUCKETS)
        built = store.staged(spark, base, entry)
        made = {**postings.segment(built, 0), "people": items.people_table(built.withColumn("_order", F.xxhash64("cid")), "_order"), "addresses": items.addresses(built)}
        if horizon is not None and "series" in built.columns:
            made["series_dates"] = item_records.series_dates(built.where("seq = 0"), horizon)
        store.write_version(base, {**made, **tables}, parser, {"chunks": entry})
        store.discard(spark, base, passing)
        return cls(spark, base)

    @classmethod
    def of_folders(cls, spark: SparkSession, base: str, outlook: str | None = None, teams: str | None = None, others: Sequence[DataFrame] = (), horizon: str | None = None, **tables: DataFrame) -> Archive:
        """The archive of exported folders: mails, appointments and contacts below ``outlook``, chat pages below ``teams``, and items of ``others``."""
        own = list(others)
        if outlook is not None:
            own.append(item_records.mail_items(readers.with_rel(readers.mails(spark, outlook), outlook, "outlook")))
            own.append(item_records.event_items(readers.with_rel(readers.calendars(spark, outlook), outlook, "kalender")))
            own.append(item_records.contact_items(readers.with_rel(readers.contacts(spark, outlook), outlook, "kontakte")))
        if teams is not None:
            own.append(item_records.chat_items(readers.with_rel(readers.chat_pages(spark, teams), teams, "teams")))
        return cls.build(base, [with_all_keys(x) for x in own], horizon=horizon, **tables)

    def update(self, changed: DataFrame, gone: DataFrame) -> None:
        """Take in changed and new items, and take away those with the ``uid`` of ``gone``: only buckets of chunks that these fall into are written.

        The index gets one segment more.  People and addresses stay those of the last build.  The same update made twice changes nothing.
        """
        info = store.read_info(self.spark, self.base)
        uids = changed.select("uid").unionByName(gone.select("uid")).distinct()
        old = self.chunks.join(uids, "uid", "left_semi")
        columns = old.columns
        fresh = items.chunk_rows(items.chunked(changed)).withColumn("cid", F.concat_ws("#", "uid", "seq"))
        fresh = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in columns])
        entry = store.stage_merge(self.base, info, "chunks", fresh, old.join(fresh.select("cid"), "cid", "left_anti"), "cid")
        segment = {n: store.stage(self.base, n, t) for n, t in postings.segment(fresh, info["number"], old=old).items()}
        made = lambda now: {**now["tables"], "chunks": entry, **{n: store.grown(now, n, e) for n, e in segment.items()}}
        store.change(self.spark, self.base, lambda now: now | {"tables": made(now)}, seen=info["number"])

    @property
    def index(self) -> postings.Index | None:
        found = {name: self._optional(name) for name in postings.TABLES}
        return None if None in found.values() else postings.Index(**found)

    def table(self, name: str) -> DataFrame:
        found = store.read_vectors(self.spark, self.base) if name == "vectors" else store.read_table(self.spark, self.base, name)
        if found is None:
            raise LookupError(f"the archive has no table {name}")
        return found

    def _optional(self, name: str) -> DataFrame | None:
        try:
            return self.table(name)
        except LookupError:
            return None

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    # search
    def search_messages(
        self, query: str, criteria: sr.Criteria = sr.Criteria(), vector: Sequence[float] | None = None, case: str | None = None, k: int = 12, offset: int = 0, preview: int = 200,
        mode: str = "hybrid", case_folder: str | None = None, collapse: bool = False, with_cases: bool = False,
    ) -> DataFrame:
        """A page of hits.  ``mode``: text, semantic, or hybrid (both where there is a vector); ``case_folder`` narrows a case; ``with_cases`` names the cases that hold a hit."""
        if mode not in ("hybrid", "text", "semantic"):
            raise ValueError(f"no such mode: {mode}")
        if mode == "semantic" and vector is None:
            raise ValueError("a semantic search needs a vector")
        members = None if case is None else self.case_items(case)
        if case_folder is not None:
            if members is None:
                raise ValueError("a case folder belongs to a case")
            members = members.where(F.col("folder_id") == case_folder)
        asked = None if mode == "text" else vector
        hits = sr.search(self.chunks, "" if mode == "semantic" else query, criteria, None if asked is None else self.vectors_of_chunks(), asked, self._optional("series_dates"), members, k, offset, preview, self.index, collapse)
        if not with_cases:
            return hits
        return hits.join(F.broadcast(casebook.membership(hits, self.table("case_items"), self.table("cases"))), "key", "left")  # at most k rows

    def browse_messages(self, criteria: sr.Criteria = sr.Criteria(), k: int = 30, offset: int = 0) -> DataFrame:
        return self.search_messages("", criteria, k=k, offset=offset)

    def all_hits(self, query: str, criteria: sr.Criteria = sr.Criteria()) -> DataFrame:
        return sr.all_hits(self.chunks, query, criteria, self._optional("series_dates"), index=self.index)

    def answer_context(self, query: str, criteria: sr.Criteria = sr.Criteria(), vector: Sequence[float] | None = None, k: int = 8, size: int = 2000) -> DataFrame:
        """The best hits as numbered passages: kind, day, who and title above the head of each text."""
        hits = self.search_messages(query, criteria, vector, k=k)
        texts = self.chunks.select("cid", "text").join(F.broadcast(hits.select("cid", "score", items.label(F.col("src"), F.date_format("ts", "yyyy-MM-dd"), F.col("who"), F.col("title")).alias("label"))), "cid")  # at most k rows
        return rank.passages(texts, "cid", "score", "label", "text", k, size)

    def search_timeline(self, query: str, criteria: sr.Criteria = sr.Criteria()) -> DataFrame:
        return sr.timeline(self.all_hits(query, criteria))

    def search_facets(self, query: str, criteria: sr.Criteria = sr.Criteria()) -> dict[str, DataFrame]:
        return sr.facet_rows(self.all_hits(query, criteria))

    def similar_messages(self, uid: str, k: int = 12) -> DataFrame:
        """The items most like one: of the 3 k chunks most like its first, the best of each item, itself left out."""
        own = self.vectors_of_chunks()
        near = rank.similar_to(own, "cid", "embedding", f"{uid}#0", 3 * k).withColumn("uid", sr.item_of(F.col("cid"))).where(F.col("uid") != uid)
        return rank.top_k(sr.best_of_items(near), k, "score", "cid")

    def embed(self, embedder: Callable[[list[str]], list[list[float]]], dim: int, buckets: int = BUCKETS) -> None:
        """Give every content its vector: known ones are taken by their hash, also those that no chunk has had for a while, and only the others go to the embedder.

        Vectors and the chunks' hashes lie in buckets by hash.  Vectors that no chunk has now stay as ``retired``.
        """
        known = self._optional("hash_vectors")
        none = self.spark.createDataFrame([], "hash string, embedding array<float>, retired boolean")
        known = none if known is None else known
        plan = sr.embedding_plan(self.chunks.withColumn("text", items.embedded(F.col("title"), F.col("text"))), known)
        used = sr.embedded(plan, known.select("hash", "embedding"), embedder, dim).withColumn("retired", F.lit(False))
        rest = known.join(self.chunks.select("hash"), "hash", "left_anti").select("hash", "embedding", F.lit(True).alias("retired"))
        entries = {
            "hash_vectors": store.stage_clustered(self.base, "hash_vectors", used.unionByName(rest), "hash", buckets),
            "hash_chunks": store.stage_clustered(self.base, "hash_chunks", self.chunks.select("cid", "hash"), "hash", buckets),
        }
        store.change(self.spark, self.base, lambda now: now | {"tables": {**now["tables"], **entries}})

    def vectors_of_chunks(self) -> DataFrame:
        """(cid, embedding): by buckets without a shuffle where ``embed`` has written them, else a join of chunks and vectors by content."""
        chunks, vectors = self._optional("hash_chunks"), self._optional("hash_vectors")
        if chunks is None or vectors is None:
            return self.chunks.select("cid", "hash").join(self.table("vectors"), "hash").select("cid", "embedding")
        return chunks.hint("merge").join(vectors.where("not retired"), "hash").select("cid", "embedding")

    def get_thread(self, thread: str) -> DataFrame:
        return sr.thread(self.chunks.where("seq = 0"), F.col("thread") == thread)

    def get_document(self, uid: str) -> DataFrame:
        own = self.chunks.where(F.col("uid") == uid)
        return own.where("seq = 0").drop("text").join(items.whole_texts(own), "uid")

    def verify_item(self, uid: str) -> DataFrame:
        """How to quote an item, and what the chain of evidence and the disk (table ``files``: rel, sha256) say of it now."""
        lines = self.table("lines")
        none = self.spark.createDataFrame([], "seq long, op string, rel string, sha256 string, other string")
        journal, broken = self._optional("journal"), self._optional("broken")
        return detail.cited(self.chunks.where((F.col("uid") == uid) & (F.col("seq") == 0)), lines, self.table("files"), none if journal is None else journal, lines.where("false") if broken is None else broken)

    def get_facts(self, uid: str) -> DataFrame:
        """The facts of a chat message, file or page; of other kinds those that its item carries."""
        own = self.chunks.where((F.col("uid") == uid) & (F.col("seq") == 0))
        shown = F.date_format("ts", "yyyy-MM-dd HH:mm")
        own = own.withColumn("date", F.coalesce("date", shown) if "date" in own.columns else shown)
        return detail.plain_facts(own).unionByName(detail.mail_facts(own))

    def neighbours(self, cid: str, before: int = 2, after: int = 2) -> DataFrame:
        own = self.chunks.where(F.col("cid") == cid).select("root", "rel")
        return sequences.context(self.chunks.where("seq = 0").join(own, ["root", "rel"], "left_semi"), "rel", "msg_idx", F.col("cid") == cid, before, after)

    # lists
    def list_people(self, contains: str = "", source: str = "") -> DataFrame:
        return facets.search_people(self.table("people"), contains, source)

    def list_addresses(self, role: str, contains: str = "", k: int = 40) -> DataFrame:
        return facets.search_addresses(self.table("addresses"), role, contains, k)

    def list_folders(self) -> DataFrame:
        return facets.folders(self.chunks, mail.folder_unit(F.col("src"), F.col("root"), F.col("ctx")))

    def list_filetypes(self, source: str = "") -> DataFrame:
        return facets.filetypes(self.chunks.where(sr.from_sources(source)))

    def list_files(self, root: str, path: str = "") -> DataFrame:
        return facets.one_level(self.chunks.where((F.col("src") == "datei") & (F.col("root") == root) & (F.col("seq") == 0)), "rel", path)

    def list_events(self, first: str | None = None, last: str | None = None, calendar: str = "") -> DataFrame:
        own = self.table("calendar")
        return sr.overlapping(own.where(F.lower("cal").contains(calendar.lower())) if calendar else own, first, last)

    def list_sources(self, expected: Sequence[str]) -> DataFrame:
        return facets.presence(self.chunks.where("seq = 0"), "src", list(expected))

    def lookup_contact(self, wanted: str) -> DataFrame:
        return sr.contact_cards(self.chunks.where("src = 'kontakte' and seq = 0"), wanted)

    def list_runs(self, kind: str) -> DataFrame:
        return facets.last_success(self.table("runs"), self.table("steps"), "run", "step", "started", F.col("kind") == kind)

    def archive_analytics(self) -> dict[str, DataFrame]:
        own = self.chunks
        first = own.where("seq = 0")
        return {
            "sources": facets.count_by(own, "src", "uid"), "talk": facets.talk_summary(own), "files": facets.file_summary(own), "tasks": facets.source_summary(own, ("planner", "todo", "onenote")), "months": facets.running_months(first),
            "attachment_types": facets.attachment_types(own), "file_types": facets.top_counts(first.where("src = 'datei'"), "ext", 10), "people": facets.top_people(self.table("people")),
        }

    # organisation
    def _reach(self) -> DataFrame:
        return graph.closure(graph.cut_circles(self.table("organisation").where("manager is not null").select("id", "manager"), "id", "manager"), "id", "manager")

    def get_org_chart(self, who: str) -> DataFrame:
        """The line above a person, nearest first by ``distance``."""
        above = self._reach().where((F.col("node") == who) & (F.col("node") != F.col("above"))).select(F.col("above").alias("id"), "distance")
        return above.join(self.table("organisation"), "id")

    def get_manager(self, who: str) -> DataFrame:
        return self.get_org_chart(who).where("distance = 1")

    def list_reports(self, who: str, levels: int = 1) -> DataFrame:
        below = self._reach().where((F.col("above") == who) & (F.col("node") != F.col("above")) & (F.col("distance") <= levels)).select(F.col("node").alias("id"), "distance")
        return below.join(self.table("organisation"), "id")

    def find_person(self, wanted: str) -> DataFrame:
        return organisation.find(self.table("organisation"), wanted)

    def find_by_role(self, contains: str, department: str = "") -> DataFrame:
        own = self.table("organisation").where(F.lower("title").contains(contains.lower()))
        return own.where(F.lower("department").contains(department.lower())) if department else own

    def list_roles(self, contains: str = "", department: str = "") -> DataFrame:
        return organisation.roles(self.table("organisation"), contains, department)

    # cases
    def case_items(self, case: str) -> DataFrame:
        return self.table("case_items").where(F.col("case_id") == case)

    def list_cases(self) -> DataFrame:
        return casebook.ordered_cases(self.table("cases"))

    def get_case(self, case: str) -> DataFrame:
        searches = self._optional("searches")
        none = self.table("case_items").where("false").select("case_id")
        index = self.chunks.where("seq = 0").select("key", "ts")
        return casebook.case_summary(self.table("cases").where(F.col("id") == case), self.case_items(case), index, self.table("case_notes"), none if searches is None else searches)

    def case_timeline(self, case: str) -> DataFrame:
        index = self.chunks.where("seq = 0").select("key", "ts", "title")
        return casebook.case_timeline(self.case_items(case), index, self.table("case_notes").where(F.col("case_id") == case)).orderBy(F.col("month") == "-", "month", "ts", "kind", "key")

    def case_people(self, case: str) -> DataFrame:
        rows = filters.members(self.chunks.where("seq = 0"), self.case_items(case), "key").withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm"))
        return facets.people_of(rows)

    def case_new_hits(self, case: str, query: str, criteria: sr.Criteria = sr.Criteria()) -> DataFrame:
        return casebook.collect_new(self.all_hits(query, criteria), self.case_items(case), self.table("case_removed").where(F.col("case_id") == case), "key")

    def run_saved_search(self, saved: str, k: int = 12) -> DataFrame:
        """A saved search with all of its criteria, which are stored as JSON beside its words."""
        row = self.table("searches").where(F.col("id") == saved).first()
        if row is None:
            raise LookupError(f"there is no saved search {saved}")
        stored = json.loads(row["criteria"])
        stored["own_domains"] = tuple(stored.get("own_domains", ()))
        return self.search_messages(row["query"], sr.Criteria(**stored), k=k)

    @staticmethod
    def criteria_text(criteria: sr.Criteria) -> str:
        """Criteria as a saved search stores them: those that are set, in fixed order."""
        return json.dumps({k: v for k, v in sorted(asdict(criteria).items()) if v}, ensure_ascii=False)

    # evidence
    def history(self, rel: str) -> DataFrame:
        """Every version of a file under any of its names, the newest first by ``n``."""
        lines, moves = self.table("lines"), self._optional("moves")
        names = lines.where("false").select("rel", F.col("rel").alias("name")) if moves is None else evidence.names_of(moves)
        current = evidence.current(lines, "rel", "n", "kind", ("removed", "missing"), ["sha256"]).select("rel", "sha256")
        return evidence.history_of(lines, names, current).where(F.col("rel") == rel).orderBy(F.desc("n"))

    def get_version(self, rel: str, day: str) -> DataFrame:
        """The version of a file that was current at the end of a day."""
        seen = self.table("lines").where((F.col("rel") == rel) & F.col("sha256").isNotNull())
        return sequences.as_of(seen, "rel", "at", "sha256", f"{day} 23:59:59")

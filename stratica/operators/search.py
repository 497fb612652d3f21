"""The search over chunks: criteria as predicates, ranked and fused hits, one hit for each item, pages, contexts and embedding plans."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.functions import text as tx
from stratica.operators import filters, postings, rank, sequences

MIRRORS = ("onedrive", "sharepoint")
LEAST_SIMILARITY = 0.45
SHORT_TEXT = 40


def from_sources(wanted: str) -> Column:
    """``a,b`` means either.  A mirror is told by its root among the files, and chats count with the files beside them."""
    out = None
    for name in [x.strip().lower() for x in wanted.split(",") if x.strip() and x.strip().lower() != "all"]:
        files = F.col("src") == "datei"
        own = files & (F.col("root") == name) if name in MIRRORS else F.col("src") == name
        own = own | (files & (F.col("root") == "teams")) if name == "teams" else own
        out = own if out is None else out | own
    return F.lit(True) if out is None else out


def last_days(days: int | str | None, today: datetime.date) -> tuple[str, str] | None:
    """First and last day of ``days`` calendar days that end today; None for what is no positive number."""
    try:
        n = int(days)
    except (TypeError, ValueError):
        return None
    return (str(today - datetime.timedelta(days=n - 1)), str(today)) if n > 0 else None


def window(date_from: str | None, date_to: str | None, days: int | str | None, today: datetime.date) -> tuple[str | None, str | None]:
    """The days of a search: a first day that is named wins over ``days``; a date that does not exist is an error."""
    for day in (date_from, date_to):
        if day:
            datetime.date.fromisoformat(day)
    found = None if date_from else last_days(days, today)
    return (found[0], date_to or found[1]) if found else (date_from, date_to)


@dataclass(frozen=True)
class Criteria:
    """What a search asks for beside its words; nothing is asked by default."""

    source: str = ""
    person: str = ""
    mail_from: str = ""
    mail_to: str = ""
    mail_cc: str = ""
    mail_bcc: str = ""
    party: str = ""
    own_domains: tuple[str, ...] = ()
    filetype: str = ""
    folder: str = ""
    only_gone: bool = False
    with_attachments: bool = False
    date_from: str | None = None
    date_to: str | None = None


def predicate(c: Criteria) -> Column:
    """The criteria of a row alone: plain expressions, so that they reach the scan.  The window is not among them (``narrowed``)."""
    out = from_sources(c.source)
    if c.person:
        out = out & tx.like_person(F.col("ppl"), c.person)
    lines = {"mail_from": F.concat_ws(" ", "who", "who_mail"), "mail_to": F.col("to_ppl"), "mail_cc": F.col("cc_ppl"), "mail_bcc": F.col("bcc_ppl")}
    asked = {k: v for k in lines if (v := getattr(c, k))}
    if asked:
        out = out & (F.col("src") == "outlook")
    for name, wanted in asked.items():
        out = out & tx.like_person(lines[name], wanted)
    if c.party in ("internal", "external"):
        out = out & (mail.external(F.col("domains"), c.own_domains) == F.lit(c.party == "external"))
    if c.filetype:
        out = out & filters.has_token(F.col("ext"), c.filetype.lstrip(".").lower())
    if c.folder:
        out = out & tx.in_subtree(F.col("ctx"), c.folder)
    if c.only_gone:
        out = out & F.col("gone").isNotNull()
    if c.with_attachments:
        out = out & (F.coalesce("att", F.lit("")) != "")
    return out


def narrowed(items: DataFrame, c: Criteria, dates: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Items that meet the criteria, with ``eff``, the time by which they count.

    With a window an item counts by its own time or, if its series (``dates``: uid, ts) has a date inside, by the first of
    those; ``members`` (key) are the items of a case.
    """
    rows = items.where(predicate(c))
    if members is not None:
        rows = filters.members(rows, members, "key")
    return effective(rows, dates, c.date_from, c.date_to)


def effective(items: DataFrame, dates: DataFrame | None, first: str | None, last: str | None) -> DataFrame:
    if not first and not last:
        return items.withColumn("eff", F.col("ts"))
    own = filters.day_window(F.col("ts"), first, last)
    if dates is None:
        return items.where(own).withColumn("eff", F.col("ts"))
    inside = dates.where(filters.day_window(F.col("ts"), first, last)).groupBy("uid").agg(F.min("ts").alias("_date"))
    rows = items.join(inside, "uid", "left").withColumn("eff", F.coalesce("_date", "ts"))
    return rows.where(F.col("_date").isNotNull() | F.coalesce(own, F.lit(False))).drop("_date")


def pool_size(offset: int, k: int) -> int:
    """Candidates that each ranking hands to the fusion for a page."""
    return min(1000, max(100, (offset + k) * 5))


def lexical(chunks: DataFrame, wanted: str, key: str = "cid", columns: Sequence[str] = ("title", "text", "att"), index: postings.Index | None = None) -> DataFrame:
    """(key, score) of the chunks that the search text matches, over title, text and attachment names.

    With an index only its words' postings are read.  Without one all chunks are: the figures are those of ``chunks``, so a
    search that is narrowed takes its hits from here and narrows them afterwards.
    """
    import re

    if index is not None:
        return postings.scores(index, wanted, key)
    terms = sorted(set(re.findall(r"[^\W]+", wanted.lower())))
    if not terms:
        return chunks.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    line = chunks.withColumn("_line", F.concat_ws(" ", *columns))
    return rank.bm25(line, key, "_line", terms).join(rank.matching(line, "_line", wanted).select(key), key, "left_semi")


def semantic(vectors: DataFrame, query: Sequence[float], key: str = "cid", embedding: str = "embedding", least: float = LEAST_SIMILARITY) -> DataFrame:
    """(key, score) of vectors that are at least so similar to the query: below that a likeness says nothing."""
    return rank.cosine(vectors, key, embedding, query).where(F.col("score") >= least)


def best_of_items(ranked: DataFrame, key: str = "cid", uid: str = "uid") -> DataFrame:
    """One hit for each item, that of its best chunk."""
    own = Window.partitionBy(uid).orderBy(F.desc("score"), key)
    return ranked.withColumn("_place", F.row_number().over(own)).where("_place = 1").drop("_place")


def item_of(cid: Column) -> Column:
    """The item of a chunk: a chunk's id is its item's and its own number."""
    return F.regexp_replace(cid, "#[0-9]+$", "")


def page(hits: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page in the order with ``has_more``: one row more than the page is looked for."""
    rows = rank.page(hits, order, offset, size + 1)
    place = F.row_number().over(Window.orderBy(*order))  # size + 1 rows
    return rows.withColumns({"_place": place, "has_more": F.count("*").over(Window.partitionBy()) > size}).where(F.col("_place") <= size).drop("_place")


def search(
    chunks: DataFrame, wanted: str, c: Criteria = Criteria(), vectors: DataFrame | None = None, query: Sequence[float] | None = None, dates: DataFrame | None = None, members: DataFrame | None = None,
    k: int = 12, offset: int = 0, preview: int = 200, index: postings.Index | None = None, collapse: bool = False,
) -> DataFrame:
    """A page of hits, best first: words and, if there is a query vector, likeness, fused by rank; one hit for each item.

    Without words and vector the newest items come first.  Scores are those of the whole index; criteria take hits away and
    change no score.  ``collapse`` leaves the best hit of each conversation (``more``: how many others it has).  Columns: cid, uid, score (4
    decimals), preview, uri, eff and the item's own; ``has_more`` tells whether there is a further page.  Without criteria an index answers
    by itself, and chunks are read for the rows of the page alone.
    """
    import re

    rows = narrowed(chunks, c, dates, members)
    words = re.findall(r"[^\W]+", wanted.lower())
    if not words and query is None:
        newest = rows.where("seq = 0").withColumn("score", F.lit(None).cast("double"))
        return page(shown(newest, words, preview), [F.desc_nulls_last("eff"), F.col("uid")], offset, k)
    whole = c == Criteria() and members is None
    lists = [lexical(chunks, wanted, index=index)] if words else []
    if query is not None and vectors is not None:
        lists.append(semantic(vectors, query))
    if len(lists) > 1:
        inside = [x if whole else x.join(rows.select("cid"), "cid", "left_semi") for x in lists]
        lists = [rank.fused([rank.top_k(x, pool_size(offset, k), "score", "cid") for x in inside], "cid")]
    if whole and index is not None and not collapse:
        found = lists[0].withColumn("uid", item_of(F.col("cid")))
    else:
        found = lists[0].join(rows.select("cid", "uid", *(["thread"] if collapse else [])), "cid")
    best, order = best_of_items(found).withColumn("score", F.round("score", 4)), [F.desc("score"), F.col("cid")]
    if collapse:
        best = sequences.collapse_threads(best.withColumn("_talk", F.coalesce(F.nullif("thread", F.lit("")), "uid")), "_talk", order).drop("_talk", "thread")
    few = page(best, order, offset, k)
    return shown(few.drop("uid").join(rows, "cid"), words, preview).orderBy(*order)  # at most k rows


def all_hits(chunks: DataFrame, wanted: str, c: Criteria = Criteria(), dates: DataFrame | None = None, members: DataFrame | None = None, index: postings.Index | None = None) -> DataFrame:
    """Every item that a search by words finds, with its score: no page and no pool of candidates cuts the result."""
    return best_of_items(lexical(chunks, wanted, index=index).join(narrowed(chunks, c, dates, members), "cid"))


def timeline(hits: DataFrame, most: int = 5000) -> DataFrame:
    """(month, at, ...): hits as they lie in time, the oldest first and those without a date last under ``-``; at most ``most``, which is the feature's bound."""
    month = F.coalesce(F.date_format("eff", "yyyy-MM"), F.lit("-"))
    return hits.withColumn("month", month).orderBy(F.asc_nulls_last("eff"), "uid").limit(most)


def facet_rows(hits: DataFrame) -> dict[str, DataFrame]:
    """Counts of all hits by source, month, folder and extension, none cut off; an item with several extensions counts for each."""
    by = lambda name, column: hits.groupBy(column.alias(name)).agg(F.count("*").alias("n"))
    kinds = hits.select(F.explode(F.split(F.coalesce("ext", F.lit("")), " ")).alias("ext")).where("ext <> ''")
    return {"src": by("src", F.col("src")), "month": by("month", F.coalesce(F.date_format("eff", "yyyy-MM"), F.lit("-"))), "folder": by("folder", mail.folder_unit(F.col("src"), F.col("root"), F.col("ctx"))), "ext": kinds.groupBy("ext").agg(F.count("*").alias("n"))}


def shown(hits: DataFrame, words: Sequence[str], preview: int) -> DataFrame:
    """Hits as they are answered: rounded score, preview around the first word, address of the source."""
    return hits.withColumns({"score": F.round("score", 4), "preview": tx.snippet(F.col("text"), words, preview), "uri": mail.source_uri(F.col("root"), F.col("rel"))}).drop("text")


def overlapping(events: DataFrame, first: str | None, last: str | None, start: str = "ts", end: str = "te") -> DataFrame:
    """Events that touch the days: they end no earlier than the first begins and begin no later than the last ends; without an end they are a moment."""
    out = F.lit(True)
    if first:
        out = out & filters.day_window(F.coalesce(end, start), first, None)
    if last:
        out = out & filters.day_window(F.col(start), None, last)
    return events.where(out)


def thread(messages: DataFrame, own: Column, order: str = "ts", cap: int = 500) -> DataFrame:
    """A conversation from its beginning, what has no time last, at most ``cap`` messages, which is the answer's own bound."""
    return messages.where(own).orderBy(F.asc_nulls_last(order), "uid").limit(cap)


def takes(path: Column, size: Column, ext: Column, scope: Sequence[str], rules: Sequence[tuple[bool, str]], largest: int | None, only: Sequence[str] = (), never: Sequence[str] = ()) -> Column:
    """Whether a selection takes a file: inside the scope, by the last rule that matches, small enough, and of a wanted type; an excluded type wins."""
    out = filters.last_match(path, rules)
    if scope:
        inside = F.lit(False)
        for folder in scope:
            inside = inside | tx.in_subtree(path, folder)
        out = out & inside
    if largest is not None:
        out = out & (size <= largest)
    if only:
        out = out & ext.isin(*only)
    return out & ~F.coalesce(ext.isin(*never), F.lit(False)) if never else out


def embedding_plan(chunks: DataFrame, known: DataFrame, text: str = "text", hash_col: str = "hash", short: int = SHORT_TEXT) -> DataFrame:
    """(hash, text, action) of each distinct content: ``reuse`` a known vector, ``zero`` for texts too short to mean anything, else ``embed``."""
    distinct = chunks.groupBy(hash_col).agg(F.min(text).alias(text))
    rows = distinct.join(known.select(hash_col).distinct().withColumn("_known", F.lit(True)), hash_col, "left")
    action = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < short, "zero").when(F.col("_known"), "reuse").otherwise("embed")
    return rows.select(hash_col, text, action.alias("action"))


def embedded(plan: DataFrame, known: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dim: int, hash_col: str = "hash", embedding: str = "embedding", together: int = 128) -> DataFrame:
    """(hash, embedding) of all contents of a plan: each text goes to the embedder once, in batches; known vectors are kept by their content."""
    todo = plan.where("action = 'embed'").select(hash_col, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ordered = rows.iloc[rows["text"].str.len().argsort()]
            for at in range(0, len(ordered), together):
                part = ordered.iloc[at : at + together]
                yield pd.DataFrame({hash_col: part[hash_col], embedding: embedder(part["text"].tolist())})

    fresh = todo.mapInPandas(run, f"{hash_col} string, {embedding} array<float>")
    zero = plan.where("action = 'zero'").select(hash_col, F.array_repeat(F.lit(0.0).cast("float"), dim).alias(embedding))
    kept = known.join(plan.where("action = 'reuse'").select(hash_col), hash_col, "left_semi").groupBy(hash_col).agg(F.first(embedding).alias(embedding))
    return fresh.unionByName(zero).unionByName(kept)


def contact_cards(contacts: DataFrame, wanted: str) -> DataFrame:
    """(key, title, mails, phones) of address book entries that name what is looked for in title, people or text."""
    hit = F.lit(False)
    for column in ("title", "ppl", "text"):
        hit = hit | F.lower(F.coalesce(column, F.lit(""))).contains(wanted.lower())
    own = F.concat_ws("\n", "title", "ppl", "text")
    return contacts.where(hit).select("key", "title", mail.contacts(own).alias("mails"), mail.phones(F.col("text")).alias("phones"))

"""Items and their chunks: overlapping pieces of texts, the columns of the search table, keys, people and addresses.

An item has ``uid, src, root, rel, who, who_mail, ppl, ts, date, title, ctx, text, att, thread, gone, key`` and mail lines;
columns that a source lacks are null.  A chunk is an item with one piece of its text and the number ``seq`` of the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratica.functions.mail import extensions

SIZE, OVERLAP, LATEST_BREAK = 1500, 200, 0.6
BLANKS = " \t\n\r\x0b\x0c"
#: Sources of which an item without words is still found: by its subject, people and date.
WORDLESS = ("outlook", "onenote", "kalender")
TOKENS = 60
MAIL_LINES = {"from": ("who", "who_mail"), "to": ("to_ppl",), "cc": ("cc_ppl",), "bcc": ("bcc_ppl",)}


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters, each ``overlap`` characters into the one before, broken at the last blank of the final 40 %."""
    text = text or ""
    if len(text) <= size:
        return [x for x in [text.strip(BLANKS)] if x]
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text) and (blank := text.rfind(" ", start + int(size * LATEST_BREAK), end)) >= 0:
            end = blank
        out.append(text[start:end].strip(BLANKS))
        if end >= len(text):
            return [x for x in out if x]
        start = max(end - overlap, start + 1)


def split_text(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """``pieces`` of a column, in Arrow batches: where a piece ends hangs on the text, so there is no closed form."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: pieces(t, size, overlap)), "array<string>")(text)


def chunked(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the item's columns, ``text`` the piece and ``seq`` its number; attachment names stand on the first alone.

    An item without words has no chunk, except in the sources of ``WORDLESS`` and, of a conversation without any words, the
    first message: these have one empty chunk.  Items with words are never shuffled.
    """
    file, rest = ["src", "root", "rel"], [c for c in items.columns if c not in ("text", "att", "seq")]
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\r\x0b\x0c]"), F.lit(False))
    pieces_ = items.where(worded).select(*rest, "att", F.posexplode(split_text(F.col("text"), size, overlap)).alias("seq", "text"))
    silent = items.where(~worded & (F.col("src") == "teams"))
    spoken = items.where(worded & (F.col("src") == "teams")).select(*file).distinct()
    first = silent.groupBy(*file).agg(F.min("uid").alias("uid")).join(spoken, file, "left_anti")
    empty = items.where(~worded & F.col("src").isin(*WORDLESS)).unionByName(silent.join(first, [*file, "uid"], "left_semi"))
    rows = pieces_.unionByName(empty.select(*rest, "att", F.lit(0).alias("seq"), F.lit("").alias("text")))
    return rows.withColumn("att", F.when(F.col("seq") == 0, F.col("att")))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with what the search table adds: number of the message in its file, extensions, hash of what is embedded; empty texts of optional columns become null."""
    number = F.coalesce(F.regexp_extract("uid", r":(\d+)$", 1).try_cast("int"), F.lit(0))
    empty = {c: F.nullif(F.col(c), F.lit("")) for c in ("who_mail", "domains", "to_ppl", "cc_ppl", "bcc_ppl", "series") if c in chunks.columns}
    return chunks.withColumns({"msg_idx": number, "ext": F.nullif(extensions(F.col("att")), F.lit("")), "hash": chunk_hash(F.col("title"), F.col("text")), **empty})


def embedded(title: Column, text: Column) -> Column:
    """What is embedded: title and text, without white space around."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.regexp_replace(both, r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")


def chunk_hash(title: Column, text: Column) -> Column:
    return F.sha1(embedded(title, text))


def joined(parts: list[str], longest: int = 300) -> str:
    """A text from its overlapping pieces: of each only what the longest overlap with the text so far leaves."""
    out = ""
    for part in parts:
        shared = next((n for n in range(min(len(out), len(part), longest), 0, -1) if out.endswith(part[:n])), 0)
        out += part[shared:]
    return out


def whole_texts(chunks: DataFrame, key: str = "uid") -> DataFrame:
    """(key, text): the text of each item, put together again from its chunks."""
    ordered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("_parts"))
    join = F.pandas_udf(lambda parts: parts.map(joined), "string")
    return ordered.select(key, join(F.transform("_parts", lambda p: p["text"])).alias("text"))


def with_keys(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items with a ``key`` that survives moves: their own, else the id that the bookkeeping has for (src, root, rel), else the path.

    ``ids`` has ``src, root, rel, id``; for chats the id is that of the conversation and the message is added.
    """
    known = ids.groupBy("src", "root", "rel").agg(F.min("id").alias("_id"))
    rows = items.join(known, ["src", "root", "rel"], "left")
    number = F.coalesce(F.regexp_extract("uid", r":(\d+)$", 1).try_cast("int"), F.lit(0)).cast("string")
    message = F.coalesce(F.col("msg_id"), number) if "msg_id" in items.columns else number
    named = {"outlook": "mail", "kalender": "event", "kontakte": "contact", "pages": "page", "onenote": "note"}
    place = F.coalesce("_id", "rel")
    task = F.substring_index(F.regexp_replace(F.regexp_replace("uid", r"^[^:]*:", ""), r":[^:]*$", ""), "/", -1)
    key = F.when(F.col("src") == "teams", F.concat(F.lit("teams:"), place, F.lit("#"), message))
    for src, name in named.items():
        key = key.when(F.col("src") == src, F.concat(F.lit(f"{name}:"), place))
    key = key.when(F.col("src") == "datei", F.concat(F.lit("file:"), F.coalesce("_id", F.concat_ws(":", "root", "rel")))).when(F.col("src").isin("planner", "todo"), F.concat_ws(":", "src", task))
    made = key.otherwise(F.concat_ws(":", "src", "root", "rel"))
    own = F.coalesce(F.nullif(F.col("key"), F.lit("")), made) if "key" in items.columns else made
    return rows.withColumn("key", own).drop("_id").select(*[c for c in items.columns if c != "key"], "key")


def people_table(chunks: DataFrame, order: str, cap: int = TOKENS) -> DataFrame:
    """(src, who, messages, tokens): messages of each sender, and the sorted words of their people lines.

    Words are taken message by message in the order (a number) until ``cap`` are there, at most ``cap`` of a message; the
    message that reaches the cap still counts whole.  The words are reduced before anything meets, so no sender is a hot key.
    """
    own = chunks.where("seq = 0").select("src", F.trim(F.coalesce("who", F.lit(""))).alias("who"), F.col(order).cast("long").alias("_at"), F.filter(F.split(F.coalesce("ppl", F.lit("")), r"\s+"), lambda t: t != "").alias("_tokens"))
    counts = own.groupBy("src", "who").agg(F.count("*").alias("messages"))
    first = own.select("src", "who", "_at", F.explode(F.slice("_tokens", 1, cap)).alias("_token")).groupBy("src", "who", "_token").agg(F.min("_at").alias("_at"))
    before = F.count("*").over(Window.partitionBy("src", "who").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    taken = first.withColumn("_before", before).where(F.col("_before") < cap).groupBy("src", "who").agg(F.array_join(F.array_sort(F.collect_list("_token")), " ").alias("tokens"))
    return counts.join(taken, ["src", "who"], "left").select("src", "who", "messages", F.coalesce("tokens", F.lit("")).alias("tokens"))


def addresses(chunks: DataFrame, uid: str = "uid", lines: dict[str, tuple[str, ...]] = MAIL_LINES) -> DataFrame:
    """(role, address, mails): in how many mails each address stands in each line; brackets and quotes around it are not part of it."""
    rows = chunks.where("seq = 0") if "seq" in chunks.columns else chunks
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws(" ", *columns).alias("line")) for role, columns in lines.items()])
    words = rows.select(uid, F.explode(roles).alias("_r")).select(uid, "_r.role", F.explode(F.split("_r.line", r"\s+")).alias("_word"))
    found = words.select(uid, "role", F.lower(F.regexp_replace("_word", r"""^[<>,;()\[\]"']+|[<>,;()\[\]"']+$""", "")).alias("address")).where(F.col("address").contains("@"))
    return found.groupBy("role", "address").agg(F.countDistinct(uid).alias("mails"))


def label(*parts: Column) -> Column:
    """What an item is called in lists: its non-empty parts with dots between."""
    return F.concat_ws(" · ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def union_of_sources(*sources: DataFrame) -> DataFrame:
    """All items of all sources; columns that one lacks are null."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out

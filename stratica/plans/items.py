"""Contract queries over items: chunks, filters, search pages, facets, people and addresses."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.functions import text as tx
from stratica.operators import facets, items, postings, search
from stratica.plans.contract import query

#: Documents as items of an archive, in SQL; ``items_of`` is the same in Spark.
ITEMS_SQL = """WITH base AS (SELECT *, CASE lang WHEN 'en' THEN 'teams' WHEN 'de' THEN 'outlook' WHEN 'fr' THEN 'datei' WHEN 'es' THEN 'pages' ELSE 'kalender' END AS src FROM documents),
    items AS (SELECT doc_id, 'd:' || doc_id || ':' || (doc_id % 7) AS uid, 'd:' || doc_id || ':' || (doc_id % 7) || '#0' AS cid, 'k' || doc_id AS key, 0 AS seq, src,
        CASE WHEN src = 'datei' THEN (['onedrive', 'sharepoint', 'teams'])[doc_id % 3 + 1] ELSE src END AS root, source || '/' || (doc_id % 10) || '/' || doc_id || '.txt' AS rel,
        CASE WHEN doc_id % 11 = 0 THEN '(unbekannt)' WHEN doc_id % 6 = 0 THEN source || ' · B' || (doc_id % 3) ELSE source END AS who, CASE WHEN doc_id % 2 = 0 THEN source || '@N' || (doc_id % 4) || '.example' END AS who_mail,
        source || ' p' || (doc_id % 5) || ' w' || (doc_id % 400) AS ppl, 'Bob (bob@x.example) <bob@x.example>, "p' || (doc_id % 5) || '@n' || (doc_id % 4) || '.example"' AS to_ppl, CASE WHEN doc_id % 5 > 0 THEN 'n' || (doc_id % 4) || '.example' END AS domains,
        CASE WHEN doc_id % 13 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * doc_id::INT END AS ts, source AS title, source || '/' || coalesce(lang, 'none') AS ctx,
        CASE doc_id % 4 WHEN 0 THEN 'a b.PDF|x.' || (['docx', 'png', 'csv'])[doc_id % 3 + 1] WHEN 1 THEN 'old name.pdf second.xlsx' END AS att, CASE doc_id % 4 WHEN 0 THEN (['docx pdf', 'pdf png', 'csv pdf'])[doc_id % 3 + 1] WHEN 1 THEN 'pdf xlsx' END AS ext,
        CASE WHEN doc_id % 9 = 0 THEN '2024' END AS gone, CASE WHEN doc_id % 3 > 0 THEN 't' || (doc_id % 50) END AS thread, text FROM base)
"""


def items_of(read):
    n = F.col("doc_id")
    text = lambda c: c.cast("string")
    pick = lambda values, k: F.array(*[F.lit(v) for v in values])[(n % k).cast("int")]
    src = F.when(F.col("lang") == "en", "teams").when(F.col("lang") == "de", "outlook").when(F.col("lang") == "fr", "datei").when(F.col("lang") == "es", "pages").otherwise("kalender")
    uid = F.concat(F.lit("d:"), text(n), F.lit(":"), text(n % 7))
    made = {
        "uid": uid, "cid": F.concat(uid, F.lit("#0")), "key": F.concat(F.lit("k"), text(n)), "seq": F.lit(0), "src": src,
        "root": F.when(src == "datei", pick(["onedrive", "sharepoint", "teams"], 3)).otherwise(src), "rel": F.concat("source", F.lit("/"), text(n % 10), F.lit("/"), text(n), F.lit(".txt")),
        "who": F.when(n % 11 == 0, facets.UNKNOWN).when(n % 6 == 0, F.concat("source", F.lit(" · B"), text(n % 3))).otherwise(F.col("source")),
        "who_mail": F.when(n % 2 == 0, F.concat("source", F.lit("@N"), text(n % 4), F.lit(".example"))),
        "ppl": F.concat("source", F.lit(" p"), text(n % 5), F.lit(" w"), text(n % 400)),
        "to_ppl": F.concat(F.lit('Bob (bob@x.example) <bob@x.example>, "p'), text(n % 5), F.lit("@n"), text(n % 4), F.lit('.example"')),
        "domains": F.when(n % 5 > 0, F.concat(F.lit("n"), text(n % 4), F.lit(".example"))),
        "ts": F.when(n % 13 > 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), n.cast("int"))),
        "title": F.col("source"), "ctx": F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("none"))),
        "att": F.when(n % 4 == 0, F.concat(F.lit("a b.PDF|x."), pick(["docx", "png", "csv"], 3))).when(n % 4 == 1, "old name.pdf second.xlsx"),
        "gone": F.when(n % 9 == 0, "2024"), "thread": F.when(n % 3 > 0, F.concat(F.lit("t"), text(n % 50))),
    }
    found = read("documents").select("doc_id", *[v.alias(k) for k, v in made.items()], F.col("text"))
    return found.withColumn("ext", F.nullif(mail.extensions(F.col("att")), F.lit("")))


def picked(sql: str) -> str:
    return ITEMS_SQL + sql


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    r AS (SELECT doc_id, text, n, 0 AS a, CASE WHEN n <= 1500 THEN n WHEN contains(substr(text, 901, 600), ' ') THEN 1500 - strpos(reverse(substr(text, 901, 600)), ' ') ELSE 1500 END AS b FROM d
      UNION ALL SELECT doc_id, text, n, s, CASE WHEN s + 1500 >= n THEN n WHEN contains(substr(text, s + 901, 600), ' ') THEN s + 1500 - strpos(reverse(substr(text, s + 901, 600)), ' ') ELSE s + 1500 END
      FROM (SELECT *, greatest(b - 200, a + 1) AS s FROM r WHERE b < n)),
    p AS (SELECT doc_id, a, trim(substr(text, a + 1, b - a), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS piece FROM r)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS seq, length(piece) AS n, md5(piece) AS piece FROM p WHERE piece <> ''"""
)
def chunks(read):
    """Pieces of whole texts, of which none is longer than 1,500 characters; a text without words has none."""
    rows = items.chunked(items_of(read).withColumn("src", F.lit("pages")))
    return rows.select("doc_id", "seq", F.length("text").alias("n"), F.md5("text").alias("piece"))


@query(picked("SELECT doc_id, (doc_id % 7)::INT AS msg_idx, ext, sha1(regexp_replace(title || chr(10) || coalesce(text, ''), '^[ \\t\\n\\r\\x0b\\x0c]+|[ \\t\\n\\r\\x0b\\x0c]+$', '', 'g')) AS hash FROM items"))
def chunk_columns(read):
    return items.chunk_rows(items_of(read)).select("doc_id", "msg_idx", "ext", "hash")


@query(
    picked(
        """SELECT doc_id, CASE src WHEN 'teams' THEN 'teams:' || coalesce(i, rel) || '#' || (doc_id % 7) WHEN 'outlook' THEN 'mail:' || coalesce(i, rel) WHEN 'kalender' THEN 'event:' || coalesce(i, rel)
        WHEN 'pages' THEN 'page:' || coalesce(i, rel) ELSE 'file:' || coalesce(i, root || ':' || rel) END AS key FROM items LEFT JOIN (SELECT doc_id AS d, 'id' || doc_id AS i FROM labels WHERE quality = 1 GROUP BY 1, 2) ON d = doc_id"""
    )
)
def stable_keys(read):
    """Ids are known for the documents of good quality."""
    rows = items_of(read).drop("key")
    known = rows.join(read("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("src", "root", "rel", F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("id"))
    return items.with_keys(rows, known).select("doc_id", "key")


@query(picked("SELECT doc_id, concat_ws(' · ', src, nullif(strftime(ts, '%Y-%m-%d'), ''), who) AS label FROM items"))
def item_label(read):
    return items_of(read).select("doc_id", items.label(F.col("src"), F.date_format("ts", "yyyy-MM-dd"), F.col("who"), F.lit("")).alias("label"))


def filtered(read, **criteria):
    return search.narrowed(items_of(read), search.Criteria(**criteria)).select("doc_id")


@query(picked("SELECT doc_id FROM items WHERE src = 'teams' OR (src = 'datei' AND root IN ('teams', 'sharepoint'))"))
def filter_source_mirror(read):
    return filtered(read, source="Teams, sharepoint")


@query(picked("SELECT doc_id FROM items WHERE src = 'outlook' AND lower(to_ppl) LIKE '%bob@x%p%n2%' AND lower(who || ' ' || coalesce(who_mail, '')) LIKE '%src%1%'"))
def filter_mail_line(read):
    return filtered(read, mail_to="Bob@x*p*n2", mail_from="src*1")


@query(picked("SELECT doc_id FROM items WHERE domains NOT IN ('n0.example', 'n1.example')"))
def filter_party_external(read):
    return filtered(read, party="external", own_domains=("n0.example", "n1.example"))


@query(picked("SELECT doc_id FROM items WHERE gone IS NOT NULL AND att IS NOT NULL AND list_contains(string_split(ext, ' '), 'xlsx')"))
def filter_gone_with_attachments(read):
    return filtered(read, only_gone=True, with_attachments=True, filetype=".XLSX")


@query(picked("SELECT doc_id FROM items WHERE ctx = 'src1' OR starts_with(ctx, 'src1/')"))
def filter_folder_subtree(read):
    return filtered(read, folder="src1")


@query(picked("SELECT doc_id FROM items WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-09 23:59:59'"))
def filter_last_days(read):
    first, last = search.window(None, None, 7, datetime.date(2024, 1, 9))
    return filtered(read, date_from=first, date_to=last)


@query("SELECT page_id, starts_with(url, 'https://') AND (regexp_matches(url, '(?i)/en/') OR NOT regexp_matches(url, '^https://blog')) AND length(html) <= 6000 AND page_id % 3 <> 2 AS taken FROM pages")
def selection_takes(read):
    ext = F.array(*[F.lit(x) for x in ("pdf", "txt", "exe")])[(F.col("page_id") % 3).cast("int")]
    rules = [(False, "https://blog**"), (True, "**/en/**")]
    return read("pages").select("page_id", search.takes(F.col("url"), F.length("html"), ext, ["https:/"], rules, 6000, ("pdf", "txt", "exe"), ("exe",)).alias("taken"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 1 SECOND * (value * 1000)::INT >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 23:59:59'")
def events_overlap(read):
    ended = read("events").withColumn("te", F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("value") * 1000).cast("int").cast("decimal(18,6)")))
    return search.overlapping(ended, "2024-01-10", "2024-01-10").select("event_id")


@query(
    picked(
        """, s AS (SELECT 'd:' || o_orderkey || ':' || (o_orderkey % 7) AS uid, min(TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 HOUR * o_custkey::INT) AS d FROM orders
        WHERE TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 HOUR * o_custkey::INT BETWEEN TIMESTAMP '2024-01-06 00:00:00' AND TIMESTAMP '2024-01-08 23:59:59' GROUP BY 1)
        SELECT doc_id, coalesce(d, ts) AS eff FROM items LEFT JOIN s USING (uid) WHERE d IS NOT NULL OR ts BETWEEN TIMESTAMP '2024-01-06 00:00:00' AND TIMESTAMP '2024-01-08 23:59:59'"""
    )
)
def effective_date(read):
    """Orders give further dates to the items of their number."""
    key = F.col("o_orderkey")
    dates = read("orders").select(F.concat(F.lit("d:"), key.cast("string"), F.lit(":"), (key % 7).cast("string")).alias("uid"), (F.lit("2024-01-05 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("o_custkey").cast("int"))).alias("ts"))
    return search.narrowed(items_of(read), search.Criteria(date_from="2024-01-06", date_to="2024-01-08"), dates).select("doc_id", "eff")


#: BM25 of two words over all items, in SQL: what a search is narrowed by changes no score.
SEARCH_SQL = r""", tok AS (SELECT doc_id, cid, uid, src, root, thread, ext, ts, regexp_extract_all(lower(concat_ws(' ', title, text, att)), '[\p{L}\p{N}_]+') AS w FROM items),
    sized AS (SELECT * EXCLUDE (w), len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'pdf')) AS t1 FROM tok),
    g AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM sized),
    bm AS (SELECT *, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a)), 4) AS score FROM sized, g WHERE t0 > 0 OR t1 > 0)
"""


def index_of(rows) -> postings.Index:
    return postings.Index(**postings.segment(rows, 1))


@query(picked(SEARCH_SQL + "SELECT doc_id, score, true AS has_more FROM bm WHERE src IN ('teams', 'outlook') OR (src = 'datei' AND root = 'teams') ORDER BY score DESC, cid LIMIT 10 OFFSET 5"))
def search_page(read):
    """The second page of a search over title, text and attachment names in two sources, without an index."""
    return search.search(items_of(read), "the PDF", search.Criteria(source="teams, outlook"), k=10, offset=5).select("doc_id", "score", "has_more")


@query(picked(SEARCH_SQL + "SELECT doc_id, score FROM bm WHERE src = 'outlook' AND list_contains(string_split(ext, ' '), 'pdf') ORDER BY score DESC, cid LIMIT 20"))
def search_filtered(read):
    """Postings decide; source and file type take hits away and leave the scores of the whole index."""
    rows = items_of(read)
    return search.search(rows, "the PDF", search.Criteria(source="outlook", filetype=".pdf"), k=20, index=index_of(rows)).select("doc_id", "score")


@query(picked(SEARCH_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY coalesce(thread, uid) ORDER BY score DESC, cid) AS place, count(*) OVER (PARTITION BY coalesce(thread, uid)) - 1 AS more FROM bm) SELECT doc_id, score, more FROM p WHERE place = 1 ORDER BY score DESC, cid LIMIT 15"))
def search_collapsed(read):
    """The best hit of each conversation, from postings."""
    rows = items_of(read)
    return search.search(rows, "the PDF", k=15, index=index_of(rows), collapse=True).select("doc_id", "score", "more")


@query(
    picked(
        r""", tok AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS x, ' ' || array_to_string(regexp_extract_all(lower(att), '[\p{L}\p{N}_]+'), ' ') || ' ' AS y FROM items)
        SELECT doc_id FROM tok WHERE (contains(x, ' of the ') OR contains(y, ' of the ')) AND (contains(x, ' pdf ') OR contains(y, ' pdf ') OR contains(x, ' name ') OR contains(y, ' name '))"""
    )
)
def phrase_positions(read):
    """A phrase by the positions of its words, never from one column into the next, and one of two loose words."""
    return postings.scores(index_of(items_of(read)), '"of the" pdf name').select(F.regexp_extract("cid", "^d:([0-9]+):", 1).cast("long").alias("doc_id"))


@query(
    picked(
        SEARCH_SQL.replace("FROM items)", "FROM live)").replace(", tok AS", ", live AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN 'the new PDF ' || source_ ELSE text END AS text) FROM (SELECT *, title AS source_ FROM items) WHERE doc_id % 5 <> 0 OR doc_id % 10 = 5), tok AS")
        + "SELECT doc_id, score FROM bm"
    )
)
def index_segments(read):
    """Three segments: the even ones of every fifth item are removed, the next of each five gets another text; scores are those of what is left."""
    rows = items_of(read)
    changed = rows.where("doc_id % 5 = 1").withColumn("text", F.concat(F.lit("the new PDF "), F.col("title")))
    parts = [postings.segment(rows, 1), postings.segment(changed, 2, old=rows.where("doc_id % 5 = 1")), postings.segment(rows.where("false"), 3, old=rows.where("doc_id % 10 = 0"))]
    tables = {name: parts[0][name].unionByName(parts[1][name]).unionByName(parts[2][name]) for name in postings.TABLES}
    found = postings.scores(postings.Index(**tables), "the PDF")
    return found.select(F.regexp_extract("cid", "^d:([0-9]+):", 1).cast("long").alias("doc_id"), F.round("score", 4).alias("score"))


@query(picked(SEARCH_SQL + "SELECT kind, value, count(*) AS n FROM (SELECT 'src' AS kind, src AS value FROM bm UNION ALL SELECT 'month', coalesce(strftime(ts, '%Y-%m'), '-') FROM bm UNION ALL SELECT 'ext', unnest(string_split(ext, ' ')) FROM bm WHERE ext IS NOT NULL) GROUP BY 1, 2"))
def hit_facets(read):
    """All hits of a search by source, month and file type, none cut off."""
    found = search.facet_rows(search.all_hits(items_of(read), "the PDF"))
    out = None
    for kind in ("src", "month", "ext"):
        own = found[kind].select(F.lit(kind).alias("kind"), F.col(kind).alias("value"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(picked(SEARCH_SQL + "SELECT doc_id, coalesce(strftime(ts, '%Y-%m'), '-') AS month FROM bm ORDER BY ts NULLS LAST, uid LIMIT 5000"))
def hit_timeline(read):
    """All hits of a search in the order of time."""
    return search.timeline(search.all_hits(items_of(read), "the PDF")).select("doc_id", "month")


@query(picked("SELECT doc_id, uid, preview, has_more FROM (SELECT *, left(text, 60) AS preview, true AS has_more FROM items WHERE gone IS NULL) ORDER BY ts DESC NULLS LAST, uid LIMIT 12 OFFSET 24"))
def browse_items(read):
    """Without words the newest items come first."""
    rows = items_of(read).where("gone is null")
    return search.search(rows, "", k=12, offset=24, preview=60).select("doc_id", "uid", "preview", "has_more")


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], v) >= 0.1"""
)
def semantic_floor(read):
    """Likeness to one vector, and nothing below the floor."""
    own = read("embeddings").where("vec_id = 3").first()["embedding"]  # one row
    return search.semantic(read("embeddings"), own, "vec_id", least=0.1).select("vec_id", F.round("score", 6).alias("score"))


@query(
    picked(
        """SELECT count(DISTINCT uid) AS messages, count(DISTINCT thread) AS conversations, count(*) FILTER (att IS NOT NULL) AS with_attachment, count(*) FILTER (gone IS NOT NULL) AS gone, count(DISTINCT who) AS persons, min(ts) AS first_ts, max(ts) AS last_ts
        FROM items WHERE src IN ('teams', 'outlook')"""
    )
)
def comm_summary(read):
    return facets.talk_summary(items_of(read))


@query(picked("SELECT count(*) FILTER (src = 'datei') AS files, count(*) FILTER (src = 'pages') AS pages, count(*) FILTER (src = 'datei' AND root = 'onedrive') AS onedrive, count(*) FILTER (src = 'datei' AND root = 'sharepoint') AS sharepoint, count(*) FILTER (src = 'datei' AND root = 'teams') AS teams, count(*) FILTER (src IN ('datei', 'pages') AND gone IS NOT NULL) AS gone FROM items"))
def files_summary(read):
    return facets.file_summary(items_of(read))


@query(picked("SELECT s.src, count(uid) AS n, count(gone) AS gone FROM (VALUES ('pages'), ('kalender'), ('todo')) s(src) LEFT JOIN items USING (src) GROUP BY 1"))
def source_counts(read):
    return facets.source_summary(items_of(read), ("pages", "kalender", "todo"))


@query(
    """WITH k AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate IS NOT NULL GROUP BY 1),
    e AS (SELECT unnest(generate_series((SELECT min(d) FROM k)::TIMESTAMP, (SELECT max(d) FROM k)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS d)
    SELECT strftime(e.d, '%Y-%m') AS month, coalesce(f, 0) AS "F", coalesce(p, 0) AS "P", coalesce(n, 0) AS total, CAST(sum(coalesce(n, 0)) OVER (ORDER BY e.d) AS BIGINT) AS running FROM e LEFT JOIN k USING (d)"""
)
def running_sum(read):
    return facets.running_months(read("orders"), "o_orderdate", "o_orderstatus", ("F", "P"))


@query(
    picked(
        """, n AS (SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['pdf', (['docx', 'png', 'csv'])[doc_id % 3 + 1]] ELSE ['pdf', 'xlsx'] END) AS t FROM items WHERE att IS NOT NULL AND src IN ('teams', 'outlook')),
        c AS (SELECT t, count(*) AS n FROM n GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS k FROM c) SELECT CASE WHEN k <= 3 THEN t ELSE '…' END AS name, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1"""
    )
)
def attachment_types(read):
    return facets.attachment_types(items_of(read), 3)


@query(picked("SELECT ext AS name, count(*) AS n FROM items WHERE src = 'datei' AND ext IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"))
def types_top10(read):
    return facets.top_counts(items_of(read).where("src = 'datei'"), "ext", 3)


@query(
    picked(
        """, t AS (SELECT src, who, doc_id, unnest(string_split(ppl, ' ')) AS w FROM items), f AS (SELECT src, who, w, min(doc_id) AS d FROM t GROUP BY 1, 2, 3), c AS (SELECT *, (SELECT count(*) FROM f g WHERE g.src = f.src AND g.who = f.who AND g.d < f.d) AS b FROM f)
        SELECT src, who, messages, tokens FROM (SELECT src, who, count(*) AS messages FROM items GROUP BY 1, 2) JOIN (SELECT src, who, array_to_string(list_sort(list(w)), ' ') AS tokens FROM c WHERE b < 12 GROUP BY 1, 2) USING (src, who)"""
    )
)
def people_table(read):
    return items.people_table(items_of(read), "doc_id", 12)


@query(
    picked(
        """, l AS (SELECT uid, 'to' AS role, unnest(['bob@x.example', 'p' || (doc_id % 5) || '@n' || (doc_id % 4) || '.example']) AS address FROM items UNION ALL SELECT uid, 'from', lower(who_mail) FROM items WHERE who_mail IS NOT NULL)
        SELECT role, address, count(DISTINCT uid) AS mails FROM l GROUP BY 1, 2"""
    )
)
def addresses(read):
    return items.addresses(items_of(read), lines={"to": ("to_ppl",), "from": ("who", "who_mail")})


@query(picked("SELECT who, count(*) AS n FROM items WHERE who <> '(unbekannt)' AND src = 'teams' GROUP BY 1 HAVING bool_or(contains(who || ' ' || ppl, 'src1')) "))
def people_search(read):
    return facets.search_people(items.people_table(items_of(read), "doc_id"), "SRC1", "teams")


@query(picked("SELECT who, count(*) AS n FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def top_people(read):
    return facets.top_people(items.people_table(items_of(read), "doc_id"), 5)


@query(picked("SELECT src, root, CASE WHEN src IN ('teams', 'pages') OR (src = 'datei' AND root = 'teams') THEN string_split(ctx, '/')[1] ELSE ctx END AS unit, count(*) AS n FROM items GROUP BY 1, 2, 3"))
def folders_units(read):
    return facets.folders(items_of(read), mail.folder_unit(F.col("src"), F.col("root"), F.col("ctx")))


@query(picked("SELECT t AS type, count(DISTINCT uid) AS n FROM (SELECT uid, unnest(string_split(ext, ' ')) AS t FROM items) WHERE t <> '' GROUP BY 1"))
def filetypes_exploded(read):
    return facets.filetypes(items_of(read))


@query(picked("SELECT string_split(substr(rel, 6), '/')[1] AS name, contains(substr(rel, 6), '/') AS is_dir, count(*) AS n FROM items WHERE starts_with(rel, 'src1/') GROUP BY 1, 2"))
def tree_level(read):
    return facets.one_level(items_of(read), "rel", "src1")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def folder_sizes(read):
    return facets.folder_sizes(read("documents"), "source", "doc_id", "n_chars")[0]


@query("SELECT source, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def largest_files(read):
    return facets.folder_sizes(read("documents"), "source", "doc_id", "n_chars")[1]


@query(
    picked(
        """, e AS (SELECT trim(unnest(string_split(who, ' · '))) AS name, src, strftime(ts, '%Y-%m-%d %H:%M') AS d, CASE WHEN NOT contains(who, ' · ') THEN lower(who_mail) END AS m FROM items)
        SELECT name, coalesce(arg_min(m, coalesce(d, '9') || m), '') AS address, count(*) AS items, coalesce(min(d), '') AS first, coalesce(max(d), '') AS last, (SELECT string_agg(src || '=' || n, ' ' ORDER BY src) FROM (SELECT src, count(*) AS n FROM e f WHERE f.name = e.name GROUP BY 1)) AS by_source
        FROM e WHERE name <> '(unbekannt)' GROUP BY name"""
    )
)
def people_of(read):
    found = facets.people_of(items_of(read).withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm")))
    told = F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return found.withColumn("by_source", told)


@query(
    """WITH r AS (SELECT CASE WHEN regexp_matches(url, '(?i)/en/') THEN '**/en/**' WHEN regexp_matches(url, '^https?://blog') THEN '*://blog**' END AS rule, page_id % 10 = 0 AS gone FROM pages)
    SELECT rule, count(*) FILTER (NOT gone AND rule IS DISTINCT FROM '*://blog**') AS taken, count(*) FILTER (NOT gone AND rule = '*://blog**') AS left_out, count(*) FILTER (gone) AS gone FROM r GROUP BY 1"""
)
def rule_summary(read):
    return facets.rule_summary(read("pages"), "url", [(False, "*://blog**"), (True, "**/en/**")], F.col("page_id") % 10 == 0)


@query(
    """WITH s AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'foreign' WHEN 2 THEN 'noted' ELSE 'consistent' END AS state, 'd' || doc_id AS rel FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source, state ORDER BY rel) AS k FROM s)
    SELECT source, state, count(*) AS n, coalesce(string_agg(rel, ' ' ORDER BY rel) FILTER (k <= 5 AND state NOT IN ('noted', 'consistent')), '') AS names FROM p GROUP BY 1, 2"""
)
def findings_capped(read):
    state = F.array(*[F.lit(x) for x in ("missing", "foreign", "noted", "consistent")])[(F.col("doc_id") % 4).cast("int")]
    rows = read("documents").select("source", state.alias("state"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rel"))
    return facets.findings(rows, "source", "state", "rel", 5).withColumn("names", F.array_join("names", " "))


@query("SELECT l_linenumber AS step, max(o_orderdate) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'R' GROUP BY 1")
def last_resync(read):
    runs = read("orders").select(F.col("o_orderkey").alias("run"), "o_orderdate", "o_orderstatus")
    steps = read("lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), (F.col("l_returnflag") != "R").alias("ok"))
    return facets.last_success(runs, steps, "run", "step", "o_orderdate", F.col("o_orderstatus") == "F")


@query(picked("SELECT doc_id FROM items WHERE thread = 't7' ORDER BY ts NULLS LAST, uid LIMIT 500"))
def thread_order(read):
    return search.thread(items_of(read), F.col("thread") == "t7").select("doc_id")


@query(
    """WITH c AS (SELECT md5(text) AS hash, min(text) AS text FROM documents GROUP BY 1), k AS (SELECT DISTINCT md5(text) AS hash FROM documents WHERE doc_id % 3 = 0)
    SELECT hash, CASE WHEN length(trim(coalesce(text, ''))) < 300 THEN 'zero' WHEN hash IN (SELECT hash FROM k) THEN 'reuse' ELSE 'embed' END AS action FROM c"""
)
def unique_hash_plan(read):
    rows = read("documents").withColumn("hash", F.md5("text"))
    return search.embedding_plan(rows, rows.where("doc_id % 3 = 0"), short=300).select("hash", "action")


@query("SELECT event_id, trim(regexp_replace(trim(s), '(?i)^((re|aw|fw|fwd|wg)\\s*:\\s*)+', '')) AS stem FROM (SELECT event_id, (['Re: AW : ', 'Fwd:', '', 'Rest: '])[event_id % 4 + 1] || event_type AS s FROM events)")
def subject_stem(read):
    start = F.array(*[F.lit(x) for x in ("Re: AW : ", "Fwd:", "", "Rest: ")])[(F.col("event_id") % 4).cast("int")]
    return read("events").select("event_id", F.trim(mail.subject_stem(F.concat(start, "event_type"))).alias("stem"))


@query("SELECT page_id, '<b>€ 5 &lt; Ä' || chr(8364) || '</b> ' || page_id AS text FROM pages")
def unescaped(read):
    """Named and numbered characters, each resolved once."""
    raw = F.concat(F.lit("&lt;b&gt;&euro; 5 &amp;lt; &Auml;&#8364;&#x3c;/b&gt; "), F.col("page_id").cast("string"))
    return read("pages").select("page_id", tx.unescape(raw).alias("text"))

"""Contract queries over items of mails, chats, appointments and contacts, and over many queries at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratica.operators import casebook, detail, rank
from stratica.plans.contract import query
from stratica.plans.items import items_of, picked
from stratica.sources import item_records


def text(column):
    return column.cast("string")


@query(
    r"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, CASE WHEN turn % 3 = 2 THEN '' ELSE trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' ') END AS t FROM conversations)
    SELECT 'teams:talk/' || conv_id || '.html:' || (row_number() OVER (PARTITION BY conv_id ORDER BY t = '', turn) - 1) AS uid, CASE WHEN role = '' THEN '(unbekannt)' ELSE role END AS who, lower(role || ' Chat ' || conv_id || ' & Co') AS ppl,
      CASE WHEN turn % 5 < 4 THEN TIMESTAMP '2025-01-01 08:00:00' + INTERVAL 1 MINUTE * turn::INT END AS ts, 'm' || turn AS msg_id, CASE WHEN turn % 7 = 3 THEN '2025-02-01' END AS gone, t AS text FROM m"""
)
def chat_items(read):
    """Conversations as chat pages; every third message is a picture, and some times cannot be read."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.when(F.col("turn") % 3 == 2, "<img src='x'>").otherwise(escaped)
    time = F.when(F.col("turn") % 5 < 4, F.date_format(F.lit("2025-01-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int")), "yyyy-MM-dd HH:mm")).otherwise("soon")
    gone = F.when(F.col("turn") % 7 == 3, ' data-gone="2025-02-01"').otherwise("")
    message = F.concat(F.lit('<div class="msg" data-id="m'), text(F.col("turn")), F.lit('"'), gone, F.lit('><span class="name">'), F.coalesce("role", F.lit("")), F.lit('</span><span class="time">'), time, F.lit('</span><div class="body"><p>'), body, F.lit("</p></div></div>"))
    pages = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("all"))
    html = F.concat(F.lit("<h1>Chat "), text(F.col("conv_id")), F.lit(" &amp; Co</h1>"), F.array_join(F.transform("all", lambda x: x["m"]), ""))
    rows = item_records.chat_items(pages.select(F.concat(F.lit("talk/"), text(F.col("conv_id")), F.lit(".html")).alias("rel"), html.alias("html")))
    return rows.select("uid", "who", "ppl", F.col("ts").cast("timestamp_ntz").alias("ts"), "msg_id", "gone", "text")


@query(
    """WITH m AS (SELECT *, conv_id || '.' || turn AS k, coalesce(role, 'none') AS r FROM conversations)
    SELECT 'outlook:In/' || conv_id || '/' || turn || '.eml:0' AS uid, CASE WHEN turn % 6 < 5 THEN 'mail:<m' || k || '@x>' END AS key, CASE WHEN turn % 4 = 3 THEN 'u' || (conv_id % 50) || '@n.example' ELSE 'Chef, ' || r END AS who, 'u' || (conv_id % 50) || '@n.example' AS who_mail,
      'a' || turn || ' bob a' || turn || '@own.example bob@x.example' AS to_ppl, CASE WHEN turn % 2 = 0 THEN 'd@z' || (conv_id % 3) || '.example' ELSE '' END AS cc_ppl, CASE WHEN turn % 2 = 0 THEN 'n.example own.example x.example z' || (conv_id % 3) || '.example' ELSE 'n.example own.example x.example' END AS domains,
      CASE WHEN turn > 0 THEN 'mid:m' || conv_id || '.0@x' WHEN turn % 6 < 5 THEN 'mid:m' || k || '@x' ELSE '' END AS thread, CASE WHEN turn % 4 > 0 THEN 'Topic ' || conv_id ELSE '(kein Betreff)' END AS title, 'In/' || conv_id AS ctx,
      CASE WHEN turn % 5 < 4 THEN strftime(TIMESTAMP '2025-01-01 08:00:00' + INTERVAL 1 HOUR * turn::INT, '%Y-%m-%d %H:%M') ELSE 'soon' END AS date FROM m"""
)
def mail_items(read):
    """Turns as mails: names with commas, several people in a line, missing ids, subjects and dates."""
    conv, turn = text(F.col("conv_id")), text(F.col("turn"))
    n, none = F.col("turn"), F.lit(None).cast("string")
    sender = F.concat(F.lit("U"), text(F.col("conv_id") % 50), F.lit("@N.Example"))
    rows = read("conversations").select(
        F.concat(F.lit("In/"), conv, F.lit("/"), turn, F.lit(".eml")).alias("rel"), F.when(n % 4 == 3, F.lower(sender)).otherwise(F.concat(F.lit('"Chef, '), F.coalesce("role", F.lit("none")), F.lit('" <'), sender, F.lit(">"))).alias("from_line"),
        F.concat(F.lit("A"), turn, F.lit(" <a"), turn, F.lit("@own.example>, Bob <bob@x.example>")).alias("to_line"), F.when(n % 2 == 0, F.concat(F.lit("d@z"), text(F.col("conv_id") % 3), F.lit(".example"))).alias("cc_line"), none.alias("bcc_line"),
        none.alias("thread_index"), F.when(n > 0, F.concat(F.lit("<m"), conv, F.lit(".0@x> <o@x>"))).alias("references"), none.alias("reply_to"), F.when(n % 6 < 5, F.concat(F.lit("<m"), conv, F.lit("."), turn, F.lit("@x>"))).alias("message_id"),
        F.when(n % 5 < 4, F.lit("2025-01-01 08:00:00").cast("timestamp") + F.make_dt_interval(hours=n.cast("int"))).alias("sent"), F.lit("soon").alias("sent_line"), F.when(n % 4 > 0, F.concat(F.lit("Topic "), conv)).alias("title"), none.alias("att"), F.col("text").alias("body"),
    )
    return item_records.mail_items(rows).select("uid", "key", "who", "who_mail", "to_ppl", "cc_ppl", "domains", "thread", "title", "ctx", "date")


@query(
    """WITH x AS (SELECT l_orderkey, 'Keller ' || (l_suppkey % 3) AS place, min(l_linenumber * 1000000 + l_suppkey) AS pos, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    e AS (SELECT l_orderkey, string_agg(place, chr(10) ORDER BY pos, place) FILTER (place <> 'Keller 0') AS more, sum(n)::BIGINT AS n FROM x GROUP BY 1)
    SELECT 'kalender:kalender/K' || (o_custkey % 7) || '/' || o_orderkey || '.ics:0' AS uid, 'event:o' || o_orderkey AS key, 'Order ' || o_orderkey AS title, 'kalender/K' || (o_custkey % 7) AS ctx,
      'Ort: Keller 0. ' || o_orderpriority || coalesce(chr(10) || more, '') AS text, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(n, 0) END AS exceptions, strftime(o_orderdate, '%Y-%m-%d') || ' 09:00' AS date FROM orders LEFT JOIN e ON l_orderkey = o_orderkey"""
)
def event_items(read):
    """Orders as appointments, their lines as exceptions of the same file in other rooms; every third repeats."""
    key = text(F.col("o_orderkey"))
    rel = F.concat(F.lit("kalender/K"), text(F.col("o_custkey") % 7), F.lit("/"), key, F.lit(".ics"))
    clock = lambda c: F.concat(F.date_format(c, "yyyyMMdd"), F.lit("T090000"))
    none = F.lit(None).cast("string")
    shared = lambda at, rid, place, rule, words: [rel.alias("rel"), F.lit(0).alias("nth"), at.alias("position"), F.concat(F.lit("o"), key).alias("uid"), rid.alias("recurrence_id"), none.alias("recurrence_tz"), F.concat(F.lit("Order "), key).alias("title"), clock(F.col("o_orderdate")).alias("start"), F.lit("UTC").alias("tz"), F.lit(False).alias("all_day"), rule.alias("rrule"), none.alias("exdates"), none.alias("exdate_tz"), place.alias("place"), none.alias("organizer"), none.alias("organizer_name"), none.alias("attendees"), none.alias("attendee_names"), words.alias("description")]
    masters = read("orders").select(*shared(F.lit(100), none, F.lit("Keller 0"), F.when(F.col("o_orderkey") % 3 == 0, "FREQ=WEEKLY"), F.col("o_orderpriority")))
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    exceptions = lines.select(*shared((F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).cast("int"), clock(F.col("l_shipdate")), F.concat(F.lit("Keller "), text(F.col("l_suppkey") % 3)), none, none))
    found = item_records.event_items(masters.unionByName(exceptions))
    return found.select("uid", "key", "title", "ctx", "text", F.size(F.from_json("series", item_records.SERIES)["ex"]).cast("long").alias("exceptions"), "date").withColumn("exceptions", F.when(F.col("exceptions") >= 0, F.col("exceptions")))


@query(
    """SELECT 'kontakte:kontakte/N' || c_nationkey || '/' || c_custkey || '.vcf:0' AS uid, 'contact:c' || c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN '(ohne Namen)' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Acme · ' || c_mktsegment WHEN c_custkey % 3 = 0 THEN 'Lead' ELSE 'Kontakt' END AS who,
      concat_ws(' · ', CASE WHEN c_custkey % 2 = 0 THEN 'Acme · ' || c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'Lead' END, 'a' || c_custkey || '@x', 'b@y', CASE WHEN c_custkey % 5 = 0 THEN 'note' END) AS text, 'kontakte/N' || c_nationkey AS ctx FROM customer"""
)
def contact_items(read):
    n = F.col("c_custkey")
    rows = read("customer").select(
        F.concat(F.lit("kontakte/N"), text(F.col("c_nationkey")), F.lit("/"), text(n), F.lit(".vcf")).alias("rel"), F.lit(0).alias("nth"), F.concat(F.lit("c"), text(n)).alias("card_id"), F.when(n % 9 > 0, F.col("c_name")).alias("name"),
        F.when(n % 2 == 0, F.concat(F.lit("Acme|"), F.col("c_mktsegment"))).alias("units"), F.when(n % 3 == 0, "Lead").alias("job"), F.concat(F.lit("a"), text(n), F.lit("@x|b@y")).alias("mails"), F.lit(None).cast("string").alias("phones"), F.when(n % 5 == 0, "note").alias("note"),
    )
    return item_records.contact_items(rows).select("uid", "key", "title", "who", "text", "ctx")


MANY_SQL = "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, vec_id // 4 AS item, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM embeddings, q)"


@query(MANY_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s) SELECT query, vec_id, round(score, 6) AS score FROM p WHERE place <= 10")
def cosine_many(read):
    """Every hundredth vector asks all others."""
    vectors = read("embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return rank.cosine_many(vectors, "vec_id", "embedding", asked, "query", 10).select("query", "vec_id", F.round("score", 6).alias("score"))


@query(
    MANY_SQL
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY score DESC, vec_id) AS best FROM p WHERE place <= 15 AND item <> query // 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS nth FROM b WHERE best = 1) SELECT query, item, vec_id, round(score, 6) AS score FROM r WHERE nth <= 5"""
)
def similar_items(read):
    """Four vectors to an item: the five items most like that of every hundredth vector."""
    vectors = read("embeddings").withColumn("item", F.floor(F.col("vec_id") / 4))
    found = rank.similar_items(vectors, "vec_id", "item", "embedding", vectors.where("vec_id % 100 = 0"), 5)
    return found.select("query", "item", "vec_id", F.round("score", 6).alias("score"))


@query(
    picked(
        """SELECT uid, src AS kind, CASE src WHEN 'datei' THEN doc_id || '.txt' WHEN 'teams' THEN who END AS name, CASE WHEN src = 'datei' THEN 'txt' END AS ext, CASE WHEN src = 'datei' THEN length(text) END AS size, ctx AS folder,
        CASE WHEN src = 'teams' THEN title END AS chat, CASE WHEN src <> 'teams' THEN coalesce(strftime(ts, '%Y-%m-%d'), '') END AS modified FROM items WHERE src IN ('teams', 'datei', 'pages')"""
    )
)
def item_facts(read):
    """Facts of messages, files and pages."""
    rows = items_of(read).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    files = rows.where("src = 'datei'").select("root", "rel", F.length("text").cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    fact = lambda path: F.get_json_object("facts", path)
    found = detail.plain_facts(rows, files).join(rows.select("uid", "src"), "uid")
    return found.select("uid", F.col("src").alias("kind"), F.coalesce(fact("$.name"), fact("$.from.name")).alias("name"), fact("$.ext").alias("ext"), fact("$.size").cast("long").alias("size"), fact("$.folder").alias("folder"), fact("$.chat").alias("chat"), fact("$.modified").alias("modified"))


@query(
    picked(
        """SELECT uid, concat_ws(' · ', src, nullif(strftime(ts, '%Y-%m-%d'), ''), who, title) AS label, CASE WHEN doc_id % 5 > 0 THEN doc_id END AS chain_line,
        CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'not_yet_chained' WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'unchanged_outside_version' ELSE 'unchanged' END WHEN doc_id % 8 = 0 THEN 'changed_by_app' ELSE 'changed_outside' END AS verdict FROM items"""
    )
)
def cite_items(read):
    """Every document's file is in the chain, on the disk and in the journal, or lacks one of them."""
    rows, n = items_of(read), F.col("doc_id")
    was, other = F.md5(F.coalesce("text", F.lit(""))), F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("x")))
    lines = rows.where(n % 5 > 0).select(n.alias("n"), F.lit("2024").alias("at"), "rel", F.when(n % 3 == 0, "outside").otherwise("write").alias("kind"), was.alias("sha256"))
    disk = rows.where(n % 7 > 0).select("rel", F.when(n % 4 == 0, other).otherwise(was).alias("sha256"))
    journal = rows.where(n % 8 == 0).select(n.alias("seq"), F.lit("write").alias("op"), "rel", other.alias("sha256"), F.lit(None).cast("string").alias("other"))
    return detail.cited(rows, lines, disk, journal, lines.where("false")).select("uid", "label", "chain_line", "verdict")


@query(
    """WITH c AS (SELECT event_id AS nr, CASE event_type WHEN 'view' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'change' END AS op, 'n' || (event_id * 7 % 3000) AS id, event_id * 7 % 3000 % 25 AS case_id, ts AS at, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'T' || event_id END AS text FROM events),
    a AS (SELECT * FROM c WHERE (op = 'delete' OR text <> '') AND case_id IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 > 0)),
    g AS (SELECT id, case_id, min(nr) FILTER (op = 'add') AS born, min(nr) FILTER (op = 'delete') AS gone, arg_max(text, nr) AS text FROM a GROUP BY 1, 2)
    SELECT g.id, g.case_id, a.at, g.text FROM g JOIN a ON a.nr = born WHERE gone IS NULL OR gone < born"""
)
def notes_round(read):
    """Events as changes of notes of the cases of nations, a quarter of which are closed."""
    n = F.col("event_id")
    ops = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "error", "delete").otherwise("change")
    key = n * 7 % 3000
    changes = read("events").select(n.alias("nr"), ops.alias("op"), F.concat(F.lit("n"), text(key)).alias("id"), (key % 25).alias("case_id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.when(n % 11 == 0, " \n").otherwise(F.concat(F.lit(" T"), text(n), F.lit("\n"))).alias("text"), F.lit("ui").alias("origin"))
    cases = read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "closed").otherwise("open").alias("status"))
    notes = changes.where("false").select("id", "case_id", "at", "text", "origin")
    return casebook.notes_after(notes, changes, cases)[0].select("id", "case_id", "at", "text")


@query("SELECT coalesce(sum(l_linenumber) FILTER (l_returnflag <> 'R'), 0)::BIGINT AS new, coalesce(sum(l_suppkey) FILTER (l_returnflag <> 'R'), 0)::BIGINT AS skipped, coalesce(sum(l_partkey) FILTER (l_returnflag <> 'R'), 0)::BIGINT AS already, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem")
def collect_sums(read):
    """Lines as reports of searches; those that were returned have failed."""
    report = read("lineitem").select(F.col("l_linenumber").cast("long").alias("new"), F.col("l_suppkey").alias("skipped"), F.col("l_partkey").alias("already"), F.when(F.col("l_returnflag") == "R", "x").alias("error"))
    return casebook.collect_sums(report)

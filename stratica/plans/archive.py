"""More contract queries: mail functions, recurrences, hierarchies, evidence, cases, feeds and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratica.functions import mail
from stratica.operators import casebook, evidence, feeds, graph, rank, recurrence
from stratica.plans.contract import query


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz")


#: What is put behind the texts, so that every kind of mark and none occurs.
ENDINGS = ("", "\r\n\r\n-----Original Message-----\r\n> old", "\nOn Monday 3 May\nBob wrote:\n> old\n", "\nFrom: a@x\nTo: b@x\nSent: today\nold", "\n > cited\nmore\n-- \nBob", "\n__________________________\nold", "\nSent from my phone\n")
MARKS = "|".join(mail.QUOTE_MARKS)
SIGNED = ["(?s)^(.+?)" + m for m in mail.SIGNATURE_MARKS]


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ended(column: str):
    """The column with one of the endings, by the row's id."""
    ends = F.array(*[F.lit(e) for e in ENDINGS])
    return F.concat(F.col(column), ends[(F.col("doc_id") % len(ENDINGS)).cast("int")])


def head_sql(inner: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({inner}, {sql_text(pattern)}) THEN regexp_extract({inner}, {sql_text(pattern)}, 1) ELSE {inner} END"


@query(
    f"""WITH t AS (SELECT doc_id, regexp_replace(text || ([{", ".join(sql_text(e) for e in ENDINGS)}])[doc_id % {len(ENDINGS)} + 1], '\r\n?', chr(10), 'g') AS b FROM documents),
    q AS (SELECT doc_id, {head_sql("b", "(?s:^(.*?))(?:" + MARKS + ")")} AS h0 FROM t),
    s1 AS (SELECT doc_id, {head_sql("h0", SIGNED[0])} AS h1 FROM q), s2 AS (SELECT doc_id, {head_sql("h1", SIGNED[1])} AS h2 FROM s1),
    s3 AS (SELECT doc_id, {head_sql("h2", SIGNED[2])} AS h3 FROM s2), s4 AS (SELECT doc_id, {head_sql("h3", SIGNED[3])} AS h4 FROM s3)
    SELECT doc_id, regexp_replace(h4, '(?m)^[ \t]*>.*$', '', 'g') AS text FROM s4"""
)
def strip_quoted(read):
    return read("documents").select("doc_id", mail.strip_quoted(ended("text")).alias("text"))


@query(
    """SELECT conv_id, turn, role, CASE WHEN turn % 4 = 0 AND text IS NOT NULL THEN 'tix:' || lower(hex(encode(left(md5(text), 22))))
    WHEN turn % 4 <= 1 THEN 'mid:c' || conv_id || '@' || lower(coalesce(role, 'none')) WHEN turn % 4 = 2 THEN 'mid:r' || conv_id ELSE 'mid:own' || turn END AS thread FROM conversations"""
)
def thread_key(read):
    """Mails with an index (where there is a text), references, an answered id, or only their own."""
    kind, none = F.col("turn") % 4, F.lit(None).cast("string")
    index = F.when(kind == 0, F.base64(F.encode(F.substring(F.md5("text"), 1, 27), "UTF-8"))).otherwise("!!")
    refs = F.when(kind <= 1, F.concat(F.lit("<C"), F.col("conv_id").cast("string"), F.lit("@"), F.coalesce("role", F.lit("None")), F.lit("> <other@x>"))).otherwise(none)
    reply = F.when(kind == 2, F.concat(F.lit("<R"), F.col("conv_id").cast("string"), F.lit(">")))
    own = F.concat(F.lit("<Own"), F.col("turn").cast("string"), F.lit(">"))
    return read("conversations").select("conv_id", "turn", "role", mail.thread_key(index, refs, reply, own).alias("thread"))


@query(
    """WITH n AS (SELECT page_id, string_split(replace(trim(u), chr(92), '/'), '/')[-1] AS last FROM (SELECT page_id, unnest([url, url || '. .', '..' || chr(92) || ' a?b' || page_id || '<c> ', 'x/']) AS u, unnest([0, 1, 2, 3]) AS kind FROM pages)),
    c AS (SELECT page_id, left(trim(regexp_replace(last, '[<>:"|?*\x00-\x1f]', '_', 'g'), '. '), 150) AS name FROM n)
    SELECT page_id, coalesce(nullif(name, ''), 'anhang') AS name FROM c"""
)
def safe_name(read):
    """Every address as it is, with dots behind it, a path of another system, and one without a name."""
    url = F.col("url")
    names = F.array(url, F.concat(url, F.lit(". .")), F.concat(F.lit("..\\ a?b"), F.col("page_id").cast("string"), F.lit("<c> ")), F.lit("x/"))
    return read("pages").select("page_id", F.explode(names).alias("n")).select("page_id", mail.safe_name(F.col("n")).alias("name"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(['pdf', lower(left(p_type, 3))])), ' ') AS ext FROM part")
def extensions(read):
    names = F.concat(F.lit("a b.PDF|no.dot-final|x."), F.left("p_type", F.lit(3)), F.lit("|c.pdf"))
    return read("part").select("p_partkey", mail.extensions(names).alias("ext"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 'n0.example' ELSE 'n0.example n' || s_nationkey || '.example' END AS domains, s_nationkey > 4 AS external FROM supplier")
def party_domains(read):
    found = mail.domains(F.array(F.concat(F.lit("A@N"), F.col("s_nationkey").cast("string"), F.lit(".Example")), F.lit("b@n0.example"), F.lit("nobody")))
    return read("supplier").select("s_suppkey", found.alias("domains"), mail.external(found, [f"n{k}.example" for k in range(5)]).alias("external"))


@query("SELECT page_id, 'o365://sites/' || url_encode(url || ' (ä)*~') AS uri FROM pages")
def source_uri(read):
    return read("pages").select("page_id", mail.source_uri(F.lit("sites"), F.concat("url", F.lit(" (ä)*~"))).alias("uri"))


@query("SELECT event_id, CASE WHEN user_id % 7 = 3 OR event_type = 'error' THEN 'refused' WHEN user_id % 7 IN (4, 5) THEN 'gone' ELSE 'retry' END AS verdict FROM events")
def verdict_class(read):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 429, 500, 403, 404, 410, 503)]), (F.col("user_id") % 7 + 1).cast("int"))
    return read("events").select("event_id", mail.verdict_class(status, F.when(F.col("event_type") == "error", "MalwareDetected")).alias("verdict"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))), ' ') AS mails FROM documents")
def contact_regex(read):
    return read("documents").select("doc_id", F.array_join(mail.contacts(F.col("text")), " ").alias("mails"))


@query("SELECT doc_id, least(greatest(CAST(pow(2, ceil(log2(floor(length(text) / 4) + 1024))) AS BIGINT), 4096), 32768) AS num_ctx FROM documents")
def num_ctx(read):
    return read("documents").select("doc_id", mail.window_size(F.length("text")).alias("num_ctx"))


@query(
    """WITH m AS (SELECT o_orderkey, o_orderdate::DATE AS d, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 11 MONTH, INTERVAL 1 MONTH))::DATE AS m FROM orders),
    x AS (SELECT o_orderkey, d, CAST(m + (least(31, day(last_day(m))) - 1)::INT AS DATE) AS day FROM m)
    SELECT o_orderkey, day FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY day) AS k FROM x WHERE day >= d) WHERE k <= 5"""
)
def expand_monthly_clamped(read):
    series = read("orders").select("o_orderkey", ntz("o_orderdate").alias("start"), F.lit("FREQ=MONTHLY;BYMONTHDAY=31;COUNT=5").alias("rrule"), F.lit("UTC").alias("tz"))
    return recurrence.expand(series, "2010-01-01").select("o_orderkey", F.to_date("wall").alias("day"))


@query(
    """SELECT o_orderkey, day FROM (SELECT o_orderkey, o_orderdate::DATE AS d, date_trunc('week', o_orderdate)::DATE AS w FROM orders) o,
    LATERAL (SELECT CAST(w + (14 * k + s)::INT AS DATE) AS day FROM range(0, 3) a(k), (VALUES (0), (2), (4)) b(s)) x WHERE day >= d AND day <= d + 20"""
)
def expand_weekly(read):
    """Every other week on Monday, Wednesday and Friday for three weeks."""
    until = F.concat(F.lit("FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE,FR;UNTIL="), F.date_format(F.date_add(F.to_date("o_orderdate"), 20), "yyyyMMdd"))
    series = read("orders").select("o_orderkey", F.to_date("o_orderdate").cast("timestamp_ntz").alias("start"), until.alias("rrule"), F.lit("UTC").alias("tz"))
    return recurrence.expand(series, "2010-01-01").select("o_orderkey", F.to_date("wall").alias("day"))


@query("SELECT o_orderkey, CAST(o_orderdate::DATE + (3 * k)::INT AS DATE) AS day FROM orders, range(4) r(k)")
def expand_daily(read):
    series = read("orders").select("o_orderkey", ntz("o_orderdate").alias("start"), F.lit("FREQ=DAILY;INTERVAL=3;COUNT=4").alias("rrule"), F.lit("UTC").alias("tz"))
    return recurrence.expand(series, "2010-01-01").select("o_orderkey", F.to_date("wall").alias("day"))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 WEEK * k AS wall FROM orders, range(5) r(k)), f AS (SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS slot, o_orderstatus AS s FROM orders)
    SELECT o_orderkey, wall FROM d WHERE (o_orderkey, wall) NOT IN (SELECT o_orderkey, slot FROM f WHERE s IN ('F', 'P'))
    UNION ALL SELECT o_orderkey, slot + INTERVAL 90 MINUTE FROM f WHERE s = 'P'
    UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR FROM orders WHERE o_orderkey % 4 = 0 AND o_orderdate >= TIMESTAMP '1998-01-01'"""
)
def exdates_exceptions(read):
    """Weekly series of five: the second date is taken out (F), moved (P) or kept; some have a date moved in from outside."""
    orders = read("orders").select("o_orderkey", "o_orderstatus", ntz("o_orderdate").alias("start"))
    out = F.when(F.col("o_orderstatus") == "F", F.array(F.expr("start + interval 7 days"))).otherwise(F.array().cast("array<timestamp_ntz>"))
    dates = recurrence.expand(orders.select("o_orderkey", "start", F.lit("FREQ=WEEKLY;COUNT=5").alias("rrule"), F.lit("UTC").alias("tz"), out.alias("exdates")), "2012-01-01", exdates="exdates")
    moved = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.expr("start + interval 7 days").alias("slot"), F.expr("start + interval 7 days 90 minutes").alias("moved"))
    inside = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.expr("start - interval 400 days").alias("slot"), F.expr("start + interval 1 hour").alias("moved"))
    return recurrence.with_exceptions(dates, moved.unionByName(inside), "1998-01-01 00:00:00", None, "o_orderkey")


@query(
    """SELECT o_orderkey, wall, CASE WHEN wall >= TIMESTAMP '1999-03-28 03:00:00' AND wall < TIMESTAMP '1999-10-31 02:00:00' THEN wall - INTERVAL 2 HOUR ELSE wall - INTERVAL 1 HOUR END AS utc
    FROM (SELECT o_orderkey, TIMESTAMP '1999-03-14 09:30:00' + INTERVAL 1 HOUR * (o_orderkey % 5)::INT + INTERVAL 1 WEEK * k AS wall FROM orders, range(4) r(k))"""
)
def dst_wall_clock(read):
    """Weekly series of a zone whose clocks go forward in between keep their wall clock."""
    start = F.lit("1999-03-14 09:30:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 5).cast("int"))
    series = read("orders").select("o_orderkey", start.alias("start"), F.lit("FREQ=WEEKLY;COUNT=4").alias("rrule"), F.lit("Europe/Berlin").alias("tz"))
    return recurrence.expand(series, "2010-01-01").select("o_orderkey", "wall", F.col("at").cast("timestamp_ntz").alias("utc"))


@query(
    """SELECT s_suppkey AS node, a AS above, d AS distance FROM (WITH RECURSIVE r AS (SELECT s_suppkey, s_suppkey // 3 AS a, 1 AS d FROM supplier WHERE s_suppkey > 0
    UNION ALL SELECT s_suppkey, a // 3, d + 1 FROM r WHERE a > 0) SELECT * FROM r)"""
)
def org_chain(read):
    return graph.closure(read("supplier").where("s_suppkey > 0").select("s_suppkey", F.floor(F.col("s_suppkey") / 3).alias("boss")), "s_suppkey", "boss").select("node", "above", "distance")


@query(
    """WITH RECURSIVE r AS (SELECT s_suppkey, s_suppkey // 3 AS a, 1 AS d FROM supplier WHERE s_suppkey > 0
    UNION ALL SELECT s_suppkey, a // 3, d + 1 FROM r WHERE a > 0) SELECT a AS above, d AS level, count(*) AS n FROM r GROUP BY 1, 2"""
)
def org_below_levels(read):
    return graph.below(org_chain(read))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'left' WHEN c_acctbal > 8000 THEN 'moved' ELSE 'changed' END AS kind FROM customer WHERE c_acctbal < 0 OR c_acctbal > 8000 OR c_mktsegment = 'FURNITURE'"""
)
def org_changes(read):
    old = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    new = read("customer").where("c_acctbal >= 0").select("c_custkey", F.when(F.col("c_acctbal") > 8000, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_mktsegment") == "FURNITURE", "HOME").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return graph.changes(old, new, "c_custkey", "c_nationkey", ["c_mktsegment"])


@query(
    """WITH l AS (SELECT conv_id, turn + 1 AS n, text, lag(text) OVER w AS before, row_number() OVER w AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT *, CASE WHEN nth = 1 THEN CASE WHEN conv_id % 7 = 3 THEN 'invented' END WHEN length(before) > 1500 THEN 'altered' ELSE sha256(coalesce(before, '')) END AS prev FROM l),
    k AS (SELECT *, row_number() OVER w AS place, lag(text) OVER w AS b, lag(1) OVER w AS has FROM p WHERE NOT (conv_id % 5 = 0 AND n = 2) WINDOW w AS (PARTITION BY conv_id ORDER BY n))
    SELECT conv_id, min(place) AS broken FROM k WHERE n <> place OR prev IS DISTINCT FROM (CASE WHEN has = 1 THEN sha256(coalesce(b, '')) END)
    OR (conv_id % 11 = 1 AND place = (SELECT max(place) FROM k m WHERE m.conv_id = k.conv_id)) GROUP BY 1"""
)
def chain_check(read):
    """Chains with hashes of long lines recorded wrongly, a line deleted, a first line with a predecessor, or a wrong head."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    before = F.when(F.length(F.lag("text").over(own)) > 1500, "altered").otherwise(F.sha2(F.coalesce(F.lag("text").over(own), F.lit("")), 256))
    first = F.when(F.col("conv_id") % 7 == 3, "invented")
    lines = read("conversations").withColumn("prev", F.when(F.row_number().over(own) == 1, first).otherwise(before)).withColumn("n", F.col("turn") + 1)
    kept = lines.where("not (conv_id % 5 = 0 and n = 2)")
    heads = kept.groupBy("conv_id").agg(F.when(F.col("conv_id") % 11 == 1, "wrong").otherwise(F.sha2(F.coalesce(F.max_by("text", "n"), F.lit("")), 256)).alias("head"))
    return evidence.broken_lines(kept, "conv_id", "n", "text", "prev", heads)


@query(
    """WITH l AS (SELECT conv_id, turn + 1 AS n, text, lag(text) OVER w AS before, row_number() OVER w AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT *, CASE WHEN nth = 1 THEN CASE WHEN conv_id % 7 = 3 THEN 'invented' END WHEN length(before) > 1500 THEN 'altered' ELSE sha256(coalesce(before, '')) END AS prev FROM l),
    k AS (SELECT *, row_number() OVER w AS place, lag(text) OVER w AS b, lag(1) OVER w AS has FROM p WHERE NOT (conv_id % 5 = 0 AND n = 2) WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
    bad AS (SELECT conv_id, min(place) AS broken FROM k WHERE n <> place OR prev IS DISTINCT FROM (CASE WHEN has = 1 THEN sha256(coalesce(b, '')) END)
      OR (conv_id % 11 = 1 AND place = (SELECT max(place) FROM k m WHERE m.conv_id = k.conv_id)) GROUP BY 1),
    files AS (SELECT conv_id, conv_id || '/' || (n % 3) AS rel, arg_max(md5(coalesce(text, '')), n) AS sha FROM k WHERE n % 8 <> 7 GROUP BY 1, 2),
    disk AS (SELECT conv_id || '/' || (n % 3) AS rel, max(md5(coalesce(text, ''))) AS sha FROM k WHERE conv_id % 4 <> 3 OR n % 3 <> 1 GROUP BY 1),
    seen AS (SELECT conv_id, f.sha, d.rel IS NULL AS missing, d.sha AS now FROM files f LEFT JOIN disk d ON d.rel = f.rel)
    SELECT k.conv_id, count(*) AS lines, any_value(bad.broken) AS broken, any_value(s.unchanged) AS unchanged, any_value(s.changed) AS changed, any_value(s.accepted) AS accepted, any_value(s.missing) AS missing
    FROM k LEFT JOIN bad ON bad.conv_id = k.conv_id
    LEFT JOIN (SELECT conv_id, count(*) FILTER (now = sha) AS unchanged, count(*) FILTER (now <> sha AND left(now, 1) > '3') AS changed, count(*) FILTER (now <> sha AND left(now, 1) <= '3') AS accepted, count(*) FILTER (missing) AS missing FROM seen GROUP BY 1) s ON s.conv_id = k.conv_id GROUP BY 1"""
)
def chain_verify(read):
    """The chains of ``chain_check`` with their totals: each turn writes one of its conversation's three files, and the disk holds another state of some."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    before = F.when(F.length(F.lag("text").over(own)) > 1500, "altered").otherwise(F.sha2(F.coalesce(F.lag("text").over(own), F.lit("")), 256))
    first = F.when(F.col("conv_id") % 7 == 3, "invented")
    rel = F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("n") % 3).cast("string"))
    lines = read("conversations").withColumn("prev", F.when(F.row_number().over(own) == 1, first).otherwise(before)).withColumn("n", F.col("turn") + 1).withColumns({"rel": rel, "sha256": F.md5(F.coalesce("text", F.lit(""))), "kind": F.when(F.col("n") % 8 == 7, "stamp").otherwise("write")})
    kept = lines.where("not (conv_id % 5 = 0 and n = 2)")
    heads = kept.groupBy("conv_id").agg(F.when(F.col("conv_id") % 11 == 1, "wrong").otherwise(F.sha2(F.coalesce(F.max_by("text", "n"), F.lit("")), 256)).alias("head"))
    disk = kept.where("conv_id % 4 <> 3 or n % 3 <> 1").groupBy("rel").agg(F.max("sha256").alias("sha256"))
    accepted = disk.where("left(sha256, 1) <= '3'")
    return evidence.verified(kept, "conv_id", "n", "text", "prev", disk, heads, accepted, ("write",))


@query("SELECT o_custkey, k AS o_orderkey FROM (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) WHERE s <> 'F'")
def evidence_fold(read):
    return evidence.current(read("orders"), "o_custkey", "o_orderkey", "o_orderstatus", ("F",), []).select("o_custkey", "o_orderkey")


@query(
    """SELECT o_orderkey, (SELECT min(s.o_orderkey) FROM orders s WHERE s.o_orderstatus = 'P' AND s.o_orderkey >= o.o_orderkey) AS stamp FROM orders o WHERE o_orderstatus = 'F'"""
)
def stamp_after(read):
    return evidence.covering_stamp(read("orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", read("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("stamp")), "stamp")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing' WHEN value < 20 THEN 'chain_broken' WHEN user_id < 3 THEN 'not_yet_chained' WHEN value > 100 THEN 'unchanged' WHEN value > 60 THEN 'changed_by_app' ELSE 'changed_outside' END AS verdict FROM events")
def verify_verdict(read):
    value = F.col("value")
    recorded = F.when(F.col("user_id") >= 3, F.when(value > 100, "new").otherwise("old"))
    announced = F.when(value > 60, "new").otherwise("x")
    return read("events").select("event_id", evidence.verdict(F.col("event_type") != "error", value >= 20, recorded, F.lit("new"), F.lit("write"), announced).alias("verdict"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)")
def collect_new(read):
    labels = read("labels")
    return casebook.collect_new(read("documents"), labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id").select("doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS DISTINCT FROM event_type")
def history_folding(read):
    return casebook.fold_history(read("events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", "ts").select("user_id", "event_id", "event_type")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS has, count(*) FILTER (role <> 'user') AS lacks FROM conversations GROUP BY 1 HAVING has > 0")
def thread_gap(read):
    messages = read("conversations").select("conv_id", "role", F.concat_ws("/", "conv_id", "turn", "role").alias("key"))
    return casebook.thread_gap(messages.where("role = 'user'"), messages, "key", "conv_id")


@query("SELECT o_custkey, o_orderkey, b AS before FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL")
def version_pairs(read):
    return casebook.version_pairs(read("orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey").select("o_custkey", "o_orderkey", "before")


@query(
    """WITH f AS (SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min((o_orderdate, o_orderkey)) AS seen FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC) - 1 AS back FROM f"""
)
def distinct_versions(read):
    return casebook.distinct_versions(read("orders"), "o_custkey", ["o_orderdate"], "o_orderstatus", "o_orderkey")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window(read):
    return casebook.rate(read("events"), "user_id", "ts", 3600).select("event_id", "n")


@query(
    """WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders), p AS (SELECT *, lag(m) OVER (PARTITION BY o_custkey ORDER BY m) AS b FROM m)
    SELECT o_custkey, strftime(b, '%Y-%m') AS after, strftime(m, '%Y-%m') AS before, date_diff('month', b, m) - 1 AS months FROM p WHERE date_diff('month', b, m) > 1"""
)
def gaps(read):
    return casebook.month_gaps(read("orders"), "o_custkey", "o_orderdate")


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31 23:59:59'
    OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31 23:59:59')"""
)
def filter_window_or_series(read):
    from stratica.operators.filters import day_window

    dates = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), ntz("l_shipdate").alias("at"))
    inside = day_window(ntz("o_orderdate"), "1997-01-01", "1997-03-31")
    return casebook.in_window_or_dates(read("orders"), "o_orderkey", inside, dates, day_window(F.col("at"), "1997-01-01", "1997-03-31")).select("o_orderkey")


@query(
    """SELECT source, count(*) AS expected, count(*) FILTER (s = 'here') AS here, count(*) FILTER (s = 'waiting') AS waiting, count(*) FILTER (s = 'refused') AS refused, count(*) FILTER (s = 'gone') AS gone, count(*) FILTER (s IS NULL) AS open
    FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'refused' WHEN quality = 1 THEN 'here' ELSE 'waiting' END AS s FROM labels) USING (doc_id) GROUP BY 1"""
)
def balance_folder(read):
    states = read("labels").select("doc_id", F.when(F.col("toxic") == 1, "refused").when(F.col("quality") == 1, "here").otherwise("waiting").alias("state"))
    return casebook.balance(read("documents"), states, "source", "doc_id")


@query("SELECT event_type AS step, max(ts) AS last_ok FROM events WHERE value > 50 GROUP BY 1")
def last_ok_step(read):
    return read("events").where("value > 50").groupBy(F.col("event_type").alias("step")).agg(F.max("ts").alias("last_ok"))


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def last_wins(read):
    return feeds.last_wins(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")


@query(
    """WITH f AS (SELECT user_id AS id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1), i AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier)
    SELECT f.id, CASE WHEN t = 'error' THEN CASE WHEN i.id IS NULL THEN 'nothing' ELSE 'tombstone' END WHEN t = 'signup' THEN 'tree' WHEN i.id IS NOT NULL AND n > 20 THEN 'move' WHEN i.id IS NOT NULL AND v > 50 THEN 'skip' ELSE 'load' END AS action FROM f LEFT JOIN i USING (id)"""
)
def delta_plan(read):
    feed = read("events").select(F.col("event_id").alias("nr"), F.col("user_id").alias("id"), F.lit("a").alias("rel"), F.lit(1).alias("size"), F.when(F.col("value") > 50, "1").otherwise("2").alias("ctag"), (F.col("event_type") == "error").alias("is_deleted"), (F.col("event_type") == "signup").alias("is_folder"))
    inventory = read("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") > 20, "b").otherwise("a").alias("rel"), F.lit(1).alias("size"), F.lit("1").alias("ctag"))
    return feeds.drive_plan(feed, inventory)


@query(
    """SELECT doc_id, 'old' AS since FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)
    UNION ALL SELECT doc_id, 'now' FROM documents WHERE n_chars <= 100 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""
)
def tombstones_settle(read):
    marks = read("labels").where("quality = 0").select("doc_id", F.lit("old").alias("since"))
    docs = read("documents")
    return feeds.settle(marks, docs.where("n_chars > 500"), docs.where("n_chars <= 100"), "doc_id", F.lit("now"))


@query(
    """WITH s AS (SELECT conv_id || '/' || turn AS id, text FROM conversations WHERE turn < 3), c AS (SELECT conv_id || '/' || turn AS id, CASE WHEN role = 'user' THEN text || '!' ELSE text END AS text FROM conversations WHERE turn > 0)
    SELECT id, CASE WHEN c.id IS NULL THEN s.text ELSE c.text END AS body, CASE WHEN s.id IS NOT NULL AND c.id IS NOT NULL AND c.text IS DISTINCT FROM s.text THEN 1 ELSE 0 END AS edits FROM s FULL JOIN c USING (id)"""
)
def message_merge(read):
    rows = read("conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    none = F.lit(None).cast("string")
    store = rows.where("turn < 3").select("id", F.col("text").alias("body"), F.lit(1).alias("modified"), none.alias("deleted"), F.array().cast("array<string>").alias("earlier"))
    batch = rows.where("turn > 0").select("id", F.when(F.col("role") == "user", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"), F.lit(2).alias("modified"), none.alias("deleted"))
    return feeds.merge_messages(store, batch).select("id", "body", F.size("earlier").alias("edits"))


@query(
    """WITH g AS (SELECT user_id, max(event_id) AS g FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT e.user_id, event_type AS field, CAST(arg_max(CAST(value AS VARCHAR), event_id) AS DOUBLE) AS value FROM events e LEFT JOIN g USING (user_id) WHERE event_type <> 'error' AND (g IS NULL OR event_id > g) GROUP BY 1, 2"""
)
def feed_fold(read):
    feed = read("events").select("user_id", "event_id", (F.col("event_type") == "error").alias("removed"), F.create_map("event_type", "value").alias("fields"))
    return feeds.fold_fields(feed, "user_id", "event_id", "removed", "fields")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = CAST(d.n_chars > 500 AS INT))")
def verdict_marks(read):
    items = read("documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("version"))
    return feeds.unanswered(items, read("labels").select("doc_id", F.col("toxic").alias("version")), "doc_id", "version").select("doc_id")


@query(
    """SELECT event_id FROM events e LEFT JOIN (SELECT s_suppkey AS user_id, TIMESTAMP '2024-01-10 00:00:00' AS mark FROM supplier) USING (user_id) WHERE mark IS NULL OR ts > mark"""
)
def newer_than_mark(read):
    marks = read("supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz").alias("mark"))
    return feeds.newer_than(read("events"), marks, "user_id", "ts").select("event_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderdate <= TIMESTAMP '1998-12-25 00:01:00' WHEN 'O' THEN o_orderdate <= TIMESTAMP '1998-12-02 00:01:00' ELSE true END AS due FROM orders")
def cadence_due(read):
    cadence = F.when(F.col("o_orderstatus") == "F", "weekly").when(F.col("o_orderstatus") == "O", "monthly").otherwise("always")
    return read("orders").select("o_orderkey", feeds.cadence_due(ntz("o_orderdate"), cadence, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).alias("due"))


@query(
    r"""SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents)
    WHERE contains(t, ' all rights reserved ') AND (contains(t, ' the ') OR contains(t, ' und '))"""
)
def phrase_required(read):
    return rank.matching(read("documents"), "text", 'the "All rights reserved" und').select("doc_id")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS w FROM e WHERE vec_id = 7), s AS (SELECT vec_id, round(list_cosine_similarity(v, w), 9) AS s FROM e, q WHERE vec_id <> 7)
    SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 12"""
)
def similar_to(read):
    return rank.similar_to(read("embeddings"), "vec_id", "embedding", 7, 12).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n, doc_id, '[' || n || '] ' || source || chr(10) || left(text, 2000) AS passage FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8)")
def answer_context(read):
    return rank.passages(read("documents"), "doc_id", "n_chars", "source", "text", 8)

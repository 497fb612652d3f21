"""Contract queries over calendars, organisations, bookkeeping, rounds, cases and evidence, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratica.operators import calendar, casebook, evidence, facets, organisation, reconcile
from stratica.plans.contract import query


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz")


def text(c):
    return c.cast("string")


def pick(values, k):
    return F.array(*[F.lit(v) for v in values])[k.cast("int")]


#: Orders as invitation mails and lines as calendar entries, in SQL.
CALENDAR_SQL = """WITH inv AS (SELECT 'U' || (o_custkey % 400) AS uid, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y%m%dT%H%M%S') ELSE '' END AS recid, (['REQUEST', 'CANCEL', 'REPLY', 'COUNTER', 'PUBLISH'])[o_orderkey % 5 + 1] AS method, CASE WHEN o_orderkey % 17 = 0 THEN 'cancelled' ELSE 'ok' END AS status,
    o_orderkey % 4 AS seq, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS dtstart, 'Accepted: Topic ' || o_custkey AS summary, TIMESTAMP '2020-01-01' + INTERVAL 1 SECOND * o_orderkey::INT AS mail_ts FROM orders),
    cal AS (SELECT l_orderkey, l_linenumber, 'u' || (l_partkey % 800) AS uid, l_shipdate AS ts, CASE WHEN l_linenumber = 2 THEN l_shipdate + INTERVAL 1 HOUR END AS rts, 'Topic ' || l_suppkey AS title, (['ok', 'cancelled', 'removed'])[l_orderkey % 3 + 1] AS st FROM lineitem),
    rk AS (SELECT *, lower(uid) AS u, (dtstart IS NOT NULL)::INT AS h, CASE method WHEN 'REQUEST' THEN 4 WHEN 'PUBLISH' THEN 3 WHEN 'CANCEL' THEN 2 WHEN 'COUNTER' THEN 1 ELSE 0 END AS m, (method = 'CANCEL' OR status = 'cancelled') AS c FROM inv),
    best AS (SELECT u, recid, max(row(h, m, seq, mail_ts, summary, dtstart)) AS b, max(CASE WHEN c THEN row(h, m, seq, mail_ts, summary, dtstart) END) AS k FROM rk GROUP BY 1, 2)
"""


def invites_of(read):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return read("orders").select(
        F.concat(F.lit("U"), text(c % 400)).alias("uid"), F.when(n % 5 == 0, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")).otherwise("").alias("recid"), pick(["REQUEST", "CANCEL", "REPLY", "COUNTER", "PUBLISH"], n % 5).alias("method"), F.when(n % 17 == 0, "cancelled").otherwise("ok").alias("status"),
        (n % 4).alias("seq"), F.when(n % 7 > 0, ntz("o_orderdate")).alias("dtstart"), F.concat(F.lit("Accepted: Topic "), text(c)).alias("summary"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))).alias("mail_ts"),
    )


def calendar_of(read):
    return read("lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("u"), text(F.col("l_partkey") % 800)).alias("uid"), ntz("l_shipdate").alias("ts"), F.when(F.col("l_linenumber") == 2, ntz("l_shipdate") + F.expr("interval 1 hour")).alias("rts"),
        F.concat(F.lit("Topic "), text(F.col("l_suppkey"))).alias("title"), pick(["ok", "cancelled", "removed"], F.col("l_orderkey") % 3).alias("st"),
    )


@query(CALENDAR_SQL + "SELECT u AS uid, recid, b[5] AS summary, b[4] AS mail_ts, k[4] AS cancel_ts FROM best")
def best_by_rank(read):
    found = calendar.best_invites(invites_of(read))
    return found.select("uid", "recid", F.col("best.summary").alias("summary"), F.col("best.mail_ts").alias("mail_ts"), F.col("cancel.mail_ts").alias("cancel_ts"))


@query(
    CALENDAR_SQL
    + """, mins AS (SELECT DISTINCT uid AS u, epoch(t)::BIGINT // 60 AS m FROM (SELECT uid, ts AS t FROM cal UNION ALL SELECT uid, rts FROM cal WHERE rts IS NOT NULL)), same AS (SELECT DISTINCT lower(title) AS t, epoch(ts)::BIGINT // 60 AS m FROM cal),
    g AS (SELECT u, recid, coalesce(k, b) AS it, CASE WHEN k IS NOT NULL THEN 'deleted' ELSE 'gone' END AS state FROM best
      WHERE u NOT IN (SELECT uid FROM cal) OR (recid <> '' AND k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mins WHERE mins.u = best.u AND mins.m = epoch(try_strptime(nullif(recid, ''), '%Y%m%dT%H%M%S'))::BIGINT // 60)))
    SELECT u AS uid, recid, it[6] AS ts, substr(it[5], 11) AS title, state FROM g WHERE it[6] IS NOT NULL AND NOT EXISTS (SELECT 1 FROM same WHERE same.t = lower(substr(it[5], 11)) AND same.m = epoch(it[6])::BIGINT // 60)"""
)
def reconstruct(read):
    return calendar.reconstructed(invites_of(read), calendar_of(read))


@query(
    CALENDAR_SQL
    + """, w AS (SELECT DISTINCT u FROM best WHERE k IS NOT NULL AND recid = ''), d AS (SELECT DISTINCT u, epoch(try_strptime(nullif(recid, ''), '%Y%m%dT%H%M%S'))::BIGINT // 60 AS m FROM best WHERE k IS NOT NULL AND recid <> '')
    SELECT l_orderkey, l_linenumber, CASE WHEN st <> 'cancelled' AND uid IN (SELECT u FROM w) THEN 'cancelled'
      WHEN st = 'ok' AND EXISTS (SELECT 1 FROM d WHERE d.u = uid AND (d.m = epoch(ts)::BIGINT // 60 OR d.m = epoch(rts)::BIGINT // 60)) THEN 'cancelled' ELSE st END AS st FROM cal"""
)
def cancelled_dates(read):
    return calendar.cancelled_by_mail(invites_of(read), calendar_of(read)).select("l_orderkey", "l_linenumber", "st")


@query("SELECT CAST(count(*) FILTER (o_orderkey % 5 = 0) AS BIGINT) AS changed, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 3 = 0) + count(*) FILTER (o_orderkey % 5 = 0 AND NOT (o_orderstatus = 'P')) - count(*) FILTER (o_orderkey % 5 = 0 AND o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS BIGINT) AS removed FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def calendar_changes(read):
    """Every fifth entry has another title; a third of those of one status is gone, and entries made by a rule (P) do not count as removed."""
    old = read("orders").select("o_orderkey", F.lit("t").alias("title"), (F.col("o_orderstatus") == "P").alias("by_rule"), "o_orderstatus")
    new = old.where("not (o_orderstatus = 'F' and o_orderkey % 3 = 0)").withColumn("title", F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(F.col("title")))
    return calendar.calendar_changes(old.where("not (o_orderstatus = 'F' and o_orderkey % 3 = 0 and o_orderkey % 5 = 0)"), new)


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'm' || user_id ELSE 'e' || event_id END AS id, max(ts) AS modified, bool_or(event_type IN ('view', 'click')) AS series FROM events WHERE event_type <> 'error' GROUP BY 1")
def calendar_round(read):
    feed = read("events").select(F.concat(F.lit("e"), text(F.col("event_id"))).alias("id"), F.concat(F.lit("m"), text(F.col("user_id"))).alias("master_id"), F.when(F.col("event_type") == "view", "occurrence").when(F.col("event_type") == "click", "exception").otherwise("single").alias("type"), (F.col("event_type") == "error").alias("removed"), F.col("ts").alias("modified"))
    return calendar.masters_of_round(feed)


#: Suppliers as users of a directory, in SQL: three reports a manager, guests, disabled accounts.
PEOPLE_SQL = """WITH RECURSIVE u AS (SELECT s_suppkey AS id, s_name AS name, 'T' || s_nationkey % 4 AS title, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS manager, s_suppkey % 7 = 2 AS disabled FROM supplier WHERE s_suppkey % 11 <> 5),
    p AS (SELECT id, name, title, disabled, CASE WHEN manager IN (SELECT id FROM u) THEN manager END AS manager FROM u),
    r AS (SELECT id AS node, manager AS above, 1 AS d FROM p WHERE manager IS NOT NULL UNION ALL SELECT node, p.manager, d + 1 FROM r JOIN p ON r.above = p.id WHERE p.manager IS NOT NULL)
"""


def users_of(read):
    n = F.col("s_suppkey")
    return read("supplier").select(n.alias("id"), F.col("s_name").alias("displayName"), F.concat(F.lit("T"), text(F.col("s_nationkey") % 4)).alias("jobTitle"), F.lit(None).cast("string").alias("department"), (n % 7 != 2).alias("accountEnabled"), F.when(n % 11 == 5, "Guest").otherwise("Member").alias("userType"), F.when(n > 0, F.floor(n / 3)).alias("manager"))


@query(
    PEOPLE_SQL
    + """, a AS (SELECT id FROM p WHERE NOT disabled), stop AS (SELECT node, min(d) AS s FROM r WHERE above IN (SELECT id FROM a) GROUP BY 1),
    links AS (SELECT DISTINCT above AS id FROM r LEFT JOIN stop USING (node) WHERE node IN (SELECT id FROM a) AND (s IS NULL OR d < s) AND above IN (SELECT id FROM p WHERE disabled)),
    k AS (SELECT id, name, title, disabled, manager FROM p WHERE id IN (SELECT id FROM a UNION SELECT id FROM links)), k2 AS (SELECT id, name, title, disabled, CASE WHEN manager IN (SELECT id FROM k) THEN manager END AS manager FROM k)
    SELECT id, name, title, manager, disabled FROM k2 WHERE manager IS NOT NULL OR id IN (SELECT manager FROM k2)"""
)
def org_build(read):
    return organisation.build(users_of(read)).select("id", "name", "title", "manager", "disabled")


def people_of(read):
    users = users_of(read).where("userType = 'Member'")
    known = users.select(F.col("id").alias("manager"), F.lit(True).alias("_k"))
    return users.join(known, "manager", "left").select("id", F.col("displayName").alias("name"), F.col("jobTitle").alias("title"), "department", F.when(F.col("_k"), F.col("manager")).alias("manager"), (~F.col("accountEnabled")).alias("disabled"))


@query(PEOPLE_SQL + "SELECT title, count(*) AS n FROM p WHERE NOT disabled AND title <> 'T3' GROUP BY 1")
def org_roles(read):
    return organisation.roles(people_of(read)).where("title <> 'T3'")


@query(PEOPLE_SQL + "SELECT p.id, p.name, count(x.node) AS n FROM p LEFT JOIN (SELECT above, node FROM r WHERE node IN (SELECT id FROM p WHERE NOT disabled)) x ON x.above = p.id WHERE p.manager IS NULL GROUP BY 1, 2")
def org_roots(read):
    from stratica.operators import graph

    people = people_of(read)
    return organisation.roots(people, graph.closure(people, "id", "manager"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey // 64 AS block, row_number() OVER (PARTITION BY c_custkey // 64 ORDER BY c_custkey) AS place FROM customer)
    SELECT a.id AS node, b.id AS above, a.place - b.place AS distance FROM c a JOIN c b ON a.block = b.block AND a.place > b.place""")
def org_deep(read):
    """Chains of 64 people, each under the one before."""
    from pyspark.sql import Window

    from stratica.operators import graph

    block = F.floor(F.col("c_custkey") / 64)
    people = read("customer").select(F.col("c_custkey").alias("id"), F.lag("c_custkey").over(Window.partitionBy(block).orderBy("c_custkey")).alias("manager"))
    return graph.closure(people, "id", "manager").withColumn("distance", F.col("distance").cast("long"))


@query("""SELECT 'r' || n_regionkey AS above, count(DISTINCT n_nationkey) + count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
    UNION ALL SELECT 'n' || c_nationkey, count(*) FROM customer GROUP BY 1""")
def tree_totals(read):
    """How many nations and customers stand below each region, and customers below each nation."""
    from stratica.operators import graph

    edge = lambda child, parent: [child.alias("node"), parent.alias("parent")]
    named = lambda letter, c: F.concat(F.lit(letter), text(F.col(c)))
    edges = read("nation").select(*edge(named("n", "n_nationkey"), named("r", "n_regionkey"))).unionByName(read("customer").select(*edge(named("c", "c_custkey"), named("n", "c_nationkey"))))
    return graph.totals(graph.closure(edges, "node", "parent"))


@query(PEOPLE_SQL + "SELECT id, name FROM p WHERE contains(lower(name), '0001')")
def org_find(read):
    return organisation.find(people_of(read), "0001 ").select("id", "name")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 8000 THEN 'moved' ELSE 'changed' END AS kind, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'title' ELSE '' END AS fields FROM customer WHERE c_acctbal > 8000 OR c_mktsegment = 'FURNITURE'")
def org_field_changes(read):
    old = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"), F.lit("d").alias("department"), F.col("c_nationkey").alias("manager"), "c_acctbal")
    new = old.withColumns({"title": F.when(F.col("title") == "FURNITURE", "HOME").otherwise(F.col("title")), "manager": F.when(F.col("c_acctbal") > 8000, F.col("manager") + 1).otherwise(F.col("manager"))})
    return organisation.changes(old, new).withColumn("fields", F.array_join("fields", ","))


@query(
    """WITH s AS (SELECT 'f' || o_orderkey AS rel, o_orderkey AS n, o_orderstatus AS st FROM orders)
    SELECT rel, CASE WHEN n % 4 = 0 THEN CASE WHEN n % 3 = 0 THEN 'noted' ELSE 'missing' END WHEN n % 4 = 1 THEN CASE WHEN st = 'F' THEN 'incomplete' ELSE 'consistent' END
      WHEN n % 4 = 2 THEN CASE WHEN n % 5 = 0 THEN 'kept' ELSE 'foreign' END ELSE CASE WHEN n % 3 = 0 THEN 'noted' ELSE 'lost' END END AS state FROM s WHERE n % 4 <> 3 OR n % 5 = 0"""
)
def disk_check(read):
    n = F.col("o_orderkey")
    files = read("orders").select(F.concat(F.lit("f"), text(n)).alias("rel"), n.alias("n"), F.lit(10).alias("size"), "o_orderstatus")
    disk = files.where("n % 4 in (1, 2)").withColumn("size", F.when((F.col("n") % 4 == 1) & (F.col("o_orderstatus") == "F"), 9).otherwise(10))
    return reconcile.disk_check(files.where("n % 4 in (0, 1)"), disk, files.where("n % 5 = 0 and n % 4 >= 2"), files.where("n % 3 = 0"))


@query("SELECT s.source, coalesce(arg_max(event_type, ts), 'never_checked') AS state, max(ts) AS at FROM (VALUES ('1'), ('2'), ('none')) s(source) LEFT JOIN events ON user_id::VARCHAR = s.source GROUP BY 1")
def source_completeness(read):
    reports = read("events").select(text(F.col("user_id")).alias("source"), F.col("ts").alias("at"), F.col("event_type").alias("state"))
    return reconcile.completeness(reports.sparkSession.createDataFrame([("1",), ("2",), ("none",)], "source string"), reports)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'vanished' WHEN c_custkey % 5 = 1 THEN 'renamed' ELSE 'new' END AS kind FROM customer WHERE c_custkey % 5 <= 2")
def tree_diff(read):
    rows = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))
    new = rows.where("id % 5 <> 0").withColumn("path", F.when(F.col("id") % 5 == 1, F.concat("path", F.lit("!"))).otherwise(F.col("path")))
    return reconcile.tree_diff(rows.where("id % 5 <> 2"), new)


@query(
    """WITH k AS (SELECT o_orderkey AS id, o_custkey % 20 AS folder, 'm' || o_orderkey % 3000 AS mid FROM orders), seen AS (SELECT id, mid FROM k WHERE id % 4 <> 0),
    sus AS (SELECT id, mid FROM k WHERE id % 4 = 0 AND folder < 10 UNION SELECT id, mid FROM k WHERE id % 4 = 0 AND id % 16 = 0)
    SELECT id, 'fresh' AS kind FROM sus WHERE mid NOT IN (SELECT mid FROM seen) AND id % 3 <> 0 AND id % 32 <> 0 AND id % 101 <> 0 UNION ALL SELECT id, 'healed' FROM k WHERE (id % 32 = 0 OR id % 101 = 0) AND id % 4 <> 0"""
)
def mail_deletions(read):
    n = F.col("o_orderkey")
    known = read("orders").select(n.alias("id"), (F.col("o_custkey") % 20).alias("folder"), F.concat(F.lit("m"), text(n % 3000)).alias("message_id"))
    verdicts = known.select("id", F.when(F.col("id") % 3 == 0, 500).otherwise(404).alias("status"))
    healed, fresh = reconcile.mail_round(known.where("id % 32 = 0 or id % 101 = 0").select("id"), known, known.where("id % 4 <> 0"), known.where("folder < 10"), known.where("id % 16 = 0"), verdicts)
    return fresh.withColumn("kind", F.lit("fresh")).unionByName(healed.withColumn("kind", F.lit("healed")))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'skip' WHEN p_partkey % 6 = 1 THEN 'rename' WHEN p_partkey % 6 = 2 THEN 'verdict' ELSE 'load' END AS action FROM part"""
)
def item_round(read):
    """Of six items one is current, one was renamed, one was refused in this version, one is new, one changed, one lost its file."""
    n = F.col("p_partkey")
    listed = read("part").select(n.alias("id"), F.concat(F.lit("r"), text(n)).alias("rel"), F.lit("v2").alias("etag"))
    known = listed.where("id % 6 in (0, 1, 2, 4, 5)").withColumns({"rel": F.when(F.col("id") % 6 == 1, F.concat(F.lit("old"), text(F.col("id")))).otherwise(F.col("rel")), "etag": F.when(F.col("id") % 6 == 4, "v1").otherwise(F.col("etag"))})
    return reconcile.item_round(listed, known, known.where("id % 6 not in (2, 5)").select("rel"), listed.where("id % 6 = 2"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def gone_in_clean_units(read):
    known = read("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("unit"))
    return reconcile.gone_in_clean_units(known, known.where("id % 3 <> 0"), known.where("unit in ('Brand#1', 'Brand#2', 'Brand#3')"))


@query("SELECT p_partkey AS id, p_size AS place, CASE WHEN p_partkey % 4 = 0 THEN 'new' WHEN p_partkey % 4 = 1 THEN 'changed' ELSE 'unchanged' END AS kind FROM part")
def board_merge(read):
    new = read("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("place"), F.col("p_name").alias("title"))
    old = new.where("id % 4 <> 0").withColumn("title", F.when(F.col("id") % 4 == 1, "before").otherwise(F.col("title")))
    return reconcile.board_merge(old, new, ["title"])


@query("SELECT least(TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY, min(ts) - INTERVAL 1 SECOND) AS cutoff FROM events WHERE value > 300")
def next_cutoff(read):
    return reconcile.next_cutoff(read("events").where("value > 300").select(F.col("ts").cast("timestamp_ntz").alias("last_activity")), "2024-01-30 12:00:00")


@query("WITH p AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*/[a-z]+)', 1) FROM pages WHERE page_id % 5 = 0) SELECT url FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.url, q.url || '/'))")
def prefix_cover(read):
    pages = read("pages")
    paths = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url")).unionByName(pages.where("page_id % 5 = 0").select(F.regexp_extract("url", "^(https?://[^/]*/[a-z]+)", 1).alias("url")))
    return reconcile.prefix_cover(paths, "url")


@query("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS unit, CASE WHEN contains(url, '/en/') THEN 'daily' WHEN starts_with(url, 'https://') THEN 'weekly' ELSE 'always' END AS cadence FROM pages")
def cadence_inherited(read):
    units = read("pages").select(F.regexp_replace("url", "[?#].*$", "").alias("unit"))
    deep = units.where(F.col("unit").contains("/en/")).select(F.regexp_extract("unit", "^(.*/en)/", 1).alias("folder")).distinct()
    named = deep.withColumn("cadence", F.explode(F.array(F.lit("monthly"), F.lit("daily")))).unionByName(units.sparkSession.createDataFrame([("https:", "weekly")], "folder string, cadence string"))
    return reconcile.cadences(units, named)


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'kept' WHEN a.x AND b.id IS NULL THEN 'excluded' WHEN b.id IS NULL OR a.t > b.t THEN 'open' ELSE 'here' END AS state FROM (SELECT DISTINCT conv_id AS id, conv_id % 5 = 0 AS x, conv_id % 7 AS t FROM conversations WHERE conv_id % 3 <> 0) a FULL JOIN (SELECT DISTINCT conv_id AS id, 3 AS t FROM conversations WHERE conv_id % 4 <> 1) b USING (id)")
def conversation_states(read):
    ids = read("conversations").select(F.col("conv_id").alias("id")).distinct()
    return reconcile.conversation_states(ids.where("id % 3 <> 0").withColumn("preview_at", F.col("id") % 7), ids.where("id % 4 <> 1").withColumn("activity", F.lit(3)), F.col("id") % 5 == 0)


@query("SELECT source, CASE WHEN toxic = 1 THEN 'refused' WHEN quality = 1 THEN 'here' ELSE 'open' END AS state, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def balance_bytes(read):
    states = read("labels").select("doc_id", F.when(F.col("toxic") == 1, "refused").when(F.col("quality") == 1, "here").otherwise("open").alias("state"))
    return reconcile.balance_with_bytes(read("documents"), states, "source", "doc_id", "n_chars")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'removed' WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 3 = 1 THEN 'updated' ELSE 'unchanged' END AS kind FROM customer")
def contacts_round(read):
    feed = read("customer").select(F.col("c_custkey").alias("id"), F.lit(2).alias("modified"), (F.col("c_custkey") % 10 == 0).alias("removed"))
    return reconcile.contacts_round(feed, feed.where("id % 3 <> 0").select("id", F.when(F.col("id") % 3 == 1, 1).otherwise(2).alias("modified")))


@query(
    """WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -1 ELSE event_id // 5 * 5 END AS root_id, ts FROM events)
    SELECT id, orphan, row_number() OVER (PARTITION BY orphan, root ORDER BY reply, ts, id) AS place, root_ts FROM
      (SELECT m.id, p.id IS NULL AS orphan, coalesce(p.ts, m.ts) AS root_ts, coalesce(m.root_id, m.id) AS root, m.root_id IS NOT NULL AS reply, m.ts FROM m LEFT JOIN (SELECT id, ts FROM m WHERE root_id IS NULL) p ON p.id = coalesce(m.root_id, m.id))"""
)
def root_reply_order(read):
    from pyspark.sql import Window

    n = F.col("event_id")
    messages = read("events").select(n.alias("id"), F.when(n % 5 == 0, None).when(n % 7 == 0, F.lit(-1)).otherwise(F.floor(n / 5) * 5).alias("root_id"), "ts")
    rows = reconcile.in_reading_order(messages)
    place = F.row_number().over(Window.partitionBy("orphan", F.coalesce("root_id", "id")).orderBy("is_reply", "ts", "id"))
    return rows.select("id", "orphan", place.alias("place"), "root_ts")


@query(
    """WITH e AS (SELECT (user_id * 7 + event_id // 40) % 5000 AS user_id, event_id, CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'rename' WHEN 'signup' THEN 'close' WHEN 'purchase' THEN 'open' ELSE 'delete' END AS op, CAST(value AS VARCHAR) AS v FROM events),
    g AS (SELECT user_id, max(event_id) AS g FROM e WHERE op = 'delete' GROUP BY 1), a AS (SELECT e.* FROM e LEFT JOIN g USING (user_id) WHERE op <> 'delete' AND (g IS NULL OR event_id > g))
    SELECT user_id, arg_max(v, event_id) FILTER (op IN ('create', 'rename'))::DOUBLE AS name, CASE WHEN arg_max(op, event_id) FILTER (op IN ('close', 'open')) = 'close' THEN 'closed' ELSE 'open' END AS status FROM a GROUP BY 1 HAVING count(*) FILTER (op = 'create') > 0"""
)
def case_states(read):
    ops = F.create_map(*[F.lit(x) for x in ("view", "create", "click", "rename", "signup", "close", "purchase", "open", "error", "delete")])
    feed = read("events").select(((F.col("user_id") * 7 + F.floor(F.col("event_id") / 40)) % 5000).alias("user_id"), F.col("event_id").alias("nr"), ops[F.col("event_type")].alias("op"), F.col("value").alias("value"))
    return casebook.book_state(feed, ["user_id"]).select("user_id", "name", "status")


@query("SELECT doc_id % 20 AS case_id, 'k' || doc_id AS key FROM documents WHERE (doc_id % 4 = 0 OR doc_id % 6 = 0) AND doc_id % 9 <> 0")
def remove_marks(read):
    n = F.col("doc_id")
    rows = read("documents").select((n % 20).alias("case_id"), F.concat(F.lit("k"), text(n)).alias("key"), "doc_id")
    return casebook.removals(rows.where("doc_id % 4 = 0"), rows.where("doc_id % 6 = 0"), rows.where("doc_id % 9 = 0"))


@query("SELECT source AS search_id, count(*) AS hits, count(*) FILTER (toxic IS DISTINCT FROM 1 AND quality IS DISTINCT FROM 1) AS new, count(*) FILTER (toxic = 1 AND quality IS DISTINCT FROM 1) AS skipped, count(*) FILTER (quality = 1) AS already FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1")
def collect_report(read):
    own = lambda rows: rows.select(F.lit(1).alias("case_id"), "doc_id").withColumnRenamed("doc_id", "key")
    hits = read("documents").select(F.col("source").alias("search_id"), F.lit(1).alias("case_id"), F.col("doc_id").alias("key"))
    labels = read("labels")
    return casebook.collected(hits, own(labels.where("quality = 1")), own(labels.where("toxic = 1")))[1]


@query(
    """SELECT s.item_id, 'case ' || c.n_nationkey AS case_name, f.r_name AS folder_name FROM (SELECT item_id, item_id % 30 AS case_id, item_id % 7 AS folder_id FROM benchmark) s LEFT JOIN nation c ON c.n_nationkey = s.case_id LEFT JOIN region f ON f.r_regionkey = s.folder_id AND s.case_id = 3"""
)
def saved_with_case(read):
    searches = read("benchmark").select("item_id", (F.col("item_id") % 30).alias("case_id"), (F.col("item_id") % 7).alias("folder_id"))
    cases = read("nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("case "), text(F.col("n_nationkey"))).alias("name"), F.lit("open").alias("status"))
    folders = read("region").select(F.lit(3).alias("case_id"), F.col("r_regionkey").alias("folder_id"), F.col("r_name").alias("name"))
    return casebook.decorated_searches(searches, cases, folders).select("item_id", "case_name", "folder_name")


@query("SELECT item_id FROM benchmark WHERE item_id % 3 = 0 AND item_id % 2 = 0 AND item_id % 30 IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def automatic_open(read):
    n = F.col("item_id")
    searches = read("benchmark").select("item_id", (n % 30).alias("case_id"), (n % 3 == 0).alias("automatic"), F.when(n % 2 == 0, "text").otherwise("meaning").alias("mode"))
    cases = read("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 2, "closed").otherwise("open").alias("status"))
    return casebook.automatic_searches(searches, cases).select("item_id")


@query(
    """SELECT n_nationkey AS case_id, n_name AS name, count(c_custkey) AS items, count(c_custkey) FILTER (c_custkey % 4 = 0) AS not_in_index, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS notes, min(c_acctbal) FILTER (c_custkey % 4 <> 0) AS first_ts, max(c_acctbal) FILTER (c_custkey % 4 <> 0) AS last_ts
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2"""
)
def case_counts(read):
    customers = read("customer")
    cases = read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("open").alias("status"))
    items = customers.select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("key"))
    index = customers.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("ts"))
    notes = read("supplier").select(F.col("s_nationkey").alias("case_id"))
    return casebook.case_summary(cases, items, index, notes, notes.where("false")).select("case_id", "name", "items", "not_in_index", "notes", "first_ts", "last_ts")


@query("SELECT o_custkey % 50 AS case_id, CASE WHEN o_orderkey % 6 = 0 THEN '-' ELSE strftime(o_orderdate, '%Y-%m') END AS month, 'item' AS kind, CAST(o_orderkey AS VARCHAR) AS key FROM orders UNION ALL SELECT user_id % 50, strftime(ts, '%Y-%m'), 'note', CAST(event_id AS VARCHAR) FROM events WHERE event_type <> 'view'")
def case_timeline(read):
    orders, events = read("orders"), read("events")
    items = orders.select((F.col("o_custkey") % 50).alias("case_id"), text(F.col("o_orderkey")).alias("key"))
    index = orders.where("o_orderkey % 6 <> 0").select(text(F.col("o_orderkey")).alias("key"), ntz("o_orderdate").alias("ts"), F.lit("t").alias("title"))
    notes = events.select((F.col("user_id") % 50).alias("case_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("note_id"), F.when(F.col("event_type") == "view", "  ").otherwise("said").alias("text"))
    return casebook.case_timeline(items, index, notes).select("case_id", "month", "kind", "key")


@query("SELECT source AS case_id, lang AS name, count(*) AS items FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2")
def case_people(read):
    rows = read("documents").select(F.col("source").alias("case_id"), F.col("lang").alias("who"), F.lit(None).cast("string").alias("who_mail"), F.lit("").alias("date"), F.lit("outlook").alias("src"))
    return facets.people_of(rows, by=("case_id",)).select("case_id", "name", "items")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY")
def history_kept(read):
    return casebook.kept_history(read("events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "2024-01-30 00:00:00", 10).select("event_id")


@query(
    """WITH m AS (SELECT o_custkey, 'n' || lag(o_orderkey) OVER w AS a, 'n' || o_orderkey AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    names AS (SELECT o_custkey, b AS name FROM m WHERE o_custkey IN (SELECT o_custkey FROM m WHERE a IS NOT NULL))
    SELECT x.name AS rel, y.name FROM names x JOIN names y USING (o_custkey)"""
)
def rename_closure(read):
    """Files that go through all orders of a customer as their names; every name leads to every other."""
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    moves = read("orders").select(F.lit("moved").alias("kind"), F.concat(F.lit("n"), text(before)).alias("rel"), F.concat(F.lit("n"), text(F.col("o_orderkey"))).alias("other"))
    return evidence.names_of(moves)


@query("SELECT 'n' || o_orderkey AS name, 'n' || lpad(CAST(min(o_orderkey) OVER (PARTITION BY o_custkey) AS VARCHAR), 9, '0') AS file FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def rename_classes(read):
    """The same chains as classes: one row for each name."""
    from pyspark.sql import Window

    own = F.concat(F.lit("n"), F.lpad(text(F.col("o_orderkey")), 9, "0"))
    before = F.lag(own).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    found = evidence.file_classes(read("orders").select(F.lit("moved").alias("kind"), before.alias("rel"), own.alias("other")))
    return found.select(F.concat(F.lit("n"), F.regexp_replace("name", "^n0*(?=[0-9])", "")).alias("name"), "file")


@query(
    """WITH l AS (SELECT 'f' || o_custkey AS rel, o_orderstatus AS sha, o_orderkey AS n FROM orders WHERE o_orderkey % 5 <> 0), f AS (SELECT rel, sha, min(n) AS n FROM l GROUP BY 1, 2)
    SELECT rel, sha AS sha256, n, sha = 'F' AS current FROM f"""
)
def evidence_history(read):
    n = F.col("o_orderkey")
    lines = read("orders").select(n.alias("n"), F.concat(F.lit("f"), text(F.col("o_custkey"))).alias("rel"), F.when(n % 5 == 0, "removed").otherwise("write").alias("kind"), F.col("o_orderstatus").alias("sha256"))
    none = lines.where("false").select("rel", F.col("rel").alias("name"))
    current = lines.select("rel").distinct().withColumn("sha256", F.lit("F"))
    return evidence.history_of(lines, none, current).select("rel", "sha256", "n", "current")


@query(
    """WITH w AS (SELECT user_id AS rel, max(event_id) AS s FROM events WHERE event_type = 'click' GROUP BY 1), g AS (SELECT user_id AS rel, max(event_id) AS s FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT rel, 'write' AS op, s AS seq FROM w UNION ALL SELECT g.rel, 'removed', g.s FROM g LEFT JOIN w USING (rel) WHERE w.s IS NULL OR g.s > w.s"""
)
def journal_pending(read):
    op = F.when(F.col("event_type") == "click", "write").when(F.col("event_type") == "error", "removed").otherwise("case")
    journal = read("events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("rel"), F.lit("h").alias("sha256"), F.lit(None).cast("string").alias("other"))
    writes, gone = evidence.pending(journal)
    return writes.select("rel", F.lit("write").alias("op"), "seq").unionByName(gone.select("rel", "op", "seq"))


@query("SELECT conv_id || '/' || turn AS id, b AS back, sha256('[\"' || replace(replace(replace(CASE b WHEN 0 THEN coalesce(role, '') ELSE 'old' END, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\",\"\"]') AS sha256, CASE b WHEN 0 THEN 'current' ELSE 'earlier' END AS kind FROM conversations, range(2) r(b) WHERE b = 0 OR turn % 2 = 1")
def message_versions(read):
    earlier = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.lit("old").alias("body"), F.lit(None).cast("string").alias("subject"), F.lit("t").alias("at"))))
    rows = read("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("role").alias("body"), F.lit(None).cast("string").alias("subject"), F.lit("m").alias("modified"), F.lit(None).cast("string").alias("deleted"), earlier.alias("earlier"))
    return evidence.message_versions(rows).select("id", "back", "sha256", "kind")


@query("SELECT doc_id, 'x' AS gone FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND n_chars <= 3000 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND n_chars <= 3000")
def incremental_reuse(read):
    """Chunks of unchanged files are reused with today's tombstones."""
    from stratica.operators import feeds

    docs = read("documents")
    states = docs.select("doc_id", F.when(F.col("n_chars") <= 3000, "reused").otherwise("changed").alias("state"))
    marks = read("labels").where("toxic = 1").select("doc_id", F.lit("x").alias("since")).distinct()
    return feeds.reuse_chunks(docs.withColumn("gone", F.lit("old")), states, marks, "doc_id").select("doc_id", "gone")

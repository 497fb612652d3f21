"""Contract queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratica.functions import text as tx
from stratica.operators import facets, filters, rank, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of (read, spark) under its name; ``read(table)`` gives a table."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


BM25_TERMS = ("the", "of", "der")
#: BM25 over documents in plain SQL: tokens, document frequencies, lengths, score.
BM25_SQL = """
    WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
    sized AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'of')) AS t1, len(list_filter(w, lambda x: x = 'der')) AS t2 FROM tok),
    g AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM sized),
    bm AS (SELECT doc_id,
             greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a))
           + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a))
           + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / a)) AS score
           FROM sized, g WHERE t0 > 0 OR t1 > 0 OR t2 > 0)
"""


@query(BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_topk(read):
    scored = rank.bm25(read("documents"), "doc_id", "text", BM25_TERMS).withColumn("score", F.round("score", 9))
    return rank.top_k(scored, 10, "score", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


QUERY_VECTOR = tuple(1.0 if k % 3 == 0 else -0.5 for k in range(64))
COSINE_SQL = f"""
    WITH q AS (SELECT {list(QUERY_VECTOR)}::DOUBLE[] AS v),
    cs AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q)
"""


@query(COSINE_SQL + "SELECT vec_id, round(score, 6) AS score FROM cs ORDER BY round(score, 9) DESC, vec_id LIMIT 10")
def cosine_topk(read):
    scored = rank.cosine(read("embeddings"), "vec_id", "embedding", QUERY_VECTOR).withColumn("score", F.round("score", 9))
    return rank.top_k(scored, 10, "score", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(
    BM25_SQL
    + ", cs AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], "
    + f"{list(QUERY_VECTOR)}::DOUBLE[]) AS score FROM embeddings), "
    + """a AS (SELECT doc_id, round(score, 9) AS s FROM bm ORDER BY s DESC, doc_id LIMIT 50), b AS (SELECT doc_id, round(score, 9) AS s FROM cs ORDER BY s DESC, doc_id LIMIT 50),
    r AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, doc_id)) AS p FROM a UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, doc_id)) FROM b)
    SELECT doc_id, round(sum(p)::DOUBLE, 6) AS score FROM r GROUP BY doc_id"""
)
def hybrid_rrf(read):
    lexical = rank.bm25(read("documents"), "doc_id", "text", BM25_TERMS).withColumn("score", F.round("score", 9))
    semantic = rank.cosine(read("embeddings"), "vec_id", "embedding", QUERY_VECTOR).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return rank.fused([rank.top_k(x, 50, "score", "doc_id") for x in (lexical, semantic)], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de')")
def filter_source_list(read):
    return read("documents").where(filters.sources(F.col("lang"), "en, de")).select("doc_id", "lang", "source")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%customer#%1' OR lower(c_name) LIKE '%r#%5%'")
def filter_person_wildcard(read):
    return read("customer").where(F.lower("c_name").like("%customer#%1") | tx.like_person(F.col("c_name"), "r#*5")).select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def filter_case_semi(read):
    return filters.members(read("documents"), read("labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_new_hits(read):
    return filters.not_members(read("documents"), read("labels"), "doc_id").select("doc_id", "source")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-05 23:59:59'")
def filter_day_window(read):
    return read("events").where(filters.day_window(F.col("ts"), "2024-01-03", "2024-01-05")).select("event_id", "user_id")


@query("SELECT p_partkey, p_type FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL') OR list_contains(string_split(p_type, ' '), 'PROMO')")
def filter_filetype(read):
    return read("part").where(filters.has_token(F.col("p_type"), "STEEL") | filters.has_token(F.col("p_type"), "PROMO")).select("p_partkey", "p_type")


@query("SELECT page_id, url, regexp_matches(url, '(?i)^https?://[^/]*/.*1$') AND NOT regexp_matches(url, '(?i)^https://[^/]*0[^/]*(/.*)?$') AS taken FROM pages")
def rules_last_match(read):
    url = F.col("url")
    rules = [(False, "**"), (True, "http://*/**1"), (True, "https://*/**1"), (False, "https://*0*/**")]
    return read("pages").select("page_id", "url", filters.last_match(url, rules).alias("taken"))


@query("SELECT lang AS src, count(DISTINCT doc_id) AS n FROM documents GROUP BY lang")
def count_by_source(read):
    return facets.count_by(read("documents"), "lang", "doc_id").withColumnRenamed("lang", "src")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def timeline_monthly(read):
    return facets.timeline(read("orders"), "o_orderdate")


@query(
    """WITH k AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    e AS (SELECT unnest(generate_series((SELECT min(d) FROM k)::TIMESTAMP, (SELECT max(d) FROM k)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS d)
    SELECT strftime(e.d, '%Y-%m') AS month, coalesce(n, 0) AS n FROM e LEFT JOIN k USING (d)"""
)
def densify(read):
    return facets.dense_months(read("orders"), "o_orderdate")


@query(
    """WITH o AS (SELECT user_id, ts, coalesce((epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) > 7200)::INT, 1) AS fresh FROM events WHERE ts IS NOT NULL),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM o)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM r GROUP BY user_id, run"""
)
def islands(read):
    return facets.islands(read("events"), "user_id", "ts", 7200)


@query("WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM c) SELECT CASE WHEN k <= 8 THEN name ELSE 'rest' END AS name, sum(n)::BIGINT AS n FROM p GROUP BY 1")
def types_top_rest(read):
    return facets.top_rest(read("part"), "p_brand", 8)


@query("SELECT user_id AS who, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def people_facet(read):
    return facets.people(read("events"), "user_id", F.col("ts"))


@query("SELECT w.name, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM (VALUES ('en'), ('fr'), ('xx')) w(name) LEFT JOIN (SELECT lang AS name, count(*) AS n FROM documents GROUP BY 1) d USING (name)")
def sources_present_absent(read):
    return facets.presence(read("documents"), "lang", ["en", "fr", "xx"])


@query(
    """WITH s AS (SELECT o_orderkey AS k, 'b' AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'c' FROM orders WHERE o_orderkey % 6 = 0)
    SELECT o_orderkey, coalesce(v, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT k, max(v) AS v FROM s GROUP BY 1) ON k = o_orderkey"""
)
def upsert_last_wins(read):
    """Every sixth order is changed twice in one batch."""
    orders = read("orders").select("o_orderkey", "o_orderstatus")
    changes = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("b").alias("o_orderstatus"), F.lit(1).alias("nr")).unionByName(orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("c").alias("o_orderstatus"), F.lit(2).alias("nr")))
    return sequences.upsert(orders, changes, "o_orderkey", "nr")


@query("SELECT doc_id, text_sha FROM (SELECT doc_id, sha256(text) AS text_sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_best(read):
    docs = read("documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return sequences.best_of(docs, ["text_sha"], [F.col("doc_id")])


@query("SELECT conv_id, turn, role, more FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS k, count(*) OVER (PARTITION BY conv_id) - 1 AS more FROM conversations) WHERE k = 1")
def collapse_thread(read):
    return sequences.collapse_threads(read("conversations"), "conv_id", [F.desc("turn"), F.col("role")]).select("conv_id", "turn", "role", "more")


@query("SELECT conv_id, turn, role FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations h WHERE h.conv_id = c.conv_id AND h.role = 'user' AND length(h.text) > 100 AND c.turn BETWEEN h.turn - 1 AND h.turn + 1)")
def neighbours(read):
    return sequences.context(read("conversations"), "conv_id", "turn", (F.col("role") == "user") & (F.length("text") > 100), 1, 1).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 2000")
def budget_prefix(read):
    return sequences.within_budget(read("conversations"), ["conv_id"], [F.col("turn"), F.col("role")], F.length("text"), 2000).select("conv_id", "turn")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1")
def asof_version(read):
    return sequences.as_of(read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), "o_custkey", "o_orderdate", "o_orderkey", "1998-01-01 00:00:00")


@query(
    """WITH b AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)
    SELECT k AS o_orderkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'vanished' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'reused' ELSE 'changed' END AS state
    FROM a FULL JOIN b USING (k)"""
)
def manifest_diff(read):
    return sequences.manifest_diff(read("orders"), line_states(read), "o_orderkey", "o_orderstatus")


def line_states(read):
    """The states of orders as their lines have them."""
    return read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))


@query(
    """WITH b AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1)
    SELECT k AS o_orderkey, s AS o_orderstatus FROM b UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT k FROM b)"""
)
def upsert(read):
    return sequences.upsert(read("orders").select("o_orderkey", "o_orderstatus"), line_states(read), "o_orderkey")


@query(
    """WITH u AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*)', 1) AS unit FROM pages)
    SELECT url, max(unit) AS unit FROM (SELECT DISTINCT url FROM pages) p, u WHERE url = unit OR starts_with(url, unit || '/') GROUP BY url"""
)
def longest_prefix(read):
    pages = read("pages").select("url").distinct()
    units = pages.select(F.regexp_extract("url", r"^(https?://[^/]*)", 1).alias("unit"))
    return sequences.longest_prefix(pages, "url", units, "unit")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 30 OFFSET 60")
def browse_page(read):
    return rank.page(read("events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.col("event_id")], 60, 30)


@query("SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def subtree_totals(read):
    tree = read("region").join(read("nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(read("customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return tree.groupBy(F.col("r_name").alias("region")).agg(F.countDistinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages"""
)
def strip_html(read):
    return read("pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query(
    """WITH p AS (SELECT doc_id, text, list_min(list_filter([strpos(lower(text), 'license'), strpos(lower(text), ' queque'), strpos(lower(text), 'the ')], lambda x: x > 0)) AS first FROM documents)
    SELECT doc_id, CASE WHEN first - 1 - 20 > 0 THEN '…' || ltrim(substr(text, first - 20, 79)) ELSE left(text, 80) END AS preview FROM p"""
)
def preview_snippet(read):
    return read("documents").select("doc_id", tx.snippet(F.col("text"), ["license", " queque", "the "], 80).alias("preview"))


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey, 'weekly' AS rule, CAST(d + 7 * k::INT AS DATE) AS day FROM s, range(5) r(k)
    UNION ALL SELECT o_orderkey, 'monthly', CAST(d + to_months(k::INT) AS DATE) FROM s, range(6) r(k)"""
)
def repeat_dates(read):
    """A weekly and a monthly rule from the date of every order."""
    series = read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    weekly = series.select("o_orderkey", F.lit("weekly").alias("rule"), F.explode(sequences.repeat_dates(F.col("d"), "weekly", 5)).alias("day"))
    monthly = series.select("o_orderkey", F.lit("monthly").alias("rule"), F.explode(sequences.repeat_dates(F.col("d"), "monthly", 6)).alias("day"))
    return weekly.unionByName(monthly)

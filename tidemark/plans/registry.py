"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, lifecycle, text, urls
from tidemark.operators import changes, consensus, health, match, outbox, records, research, resolve, retention, scoring, views
from tidemark.plans import entity_queries, field_queries, model_queries, state_queries, stream_queries  # noqa: F401  (they add their queries)
from tidemark.plans.base import ORACLES, QUERIES, query  # noqa: F401
from tidemark.sources import fixtures as fx

FLAGSHIP = "actionable_list"

_NOW = f"TIMESTAMP '{fx.NOW}'"
_E, _E2, _N, _O = fx.entities_sql(), fx.entities_sql(1), fx.NOTIFICATIONS_SQL, fx.OBSERVATIONS_SQL
_DASH = "CASE status WHEN 'registration_open' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'preview' THEN 2 ELSE 3 END"


def _seconds(name: str):
    return F.unix_timestamp(name).alias(name)


@query(f"SELECT id, status, CAST(epoch(last_seen) AS BIGINT) AS last_seen FROM {_E} WHERE status IN ('preview', 'registration_open', 'upcoming', 'ongoing') AND (competition_end IS NULL OR competition_end >= {_NOW}) AND (status IN ('upcoming', 'ongoing') OR registration_end IS NULL OR registration_end >= {_NOW}) ORDER BY {_DASH}, last_seen DESC, id LIMIT 20")
def actionable_list(spark: SparkSession, d: str) -> DataFrame:
    return views.actionable_list(fx.entities(spark, d), fx.now()).select("id", "status", F.unix_timestamp("last_seen").alias("last_seen"))


@query(f"SELECT id, CAST(epoch(last_seen) AS BIGINT) AS seen FROM {_E} WHERE status = 'unknown' ORDER BY last_seen DESC, id LIMIT 20")
def unconfirmed_list(spark: SparkSession, d: str) -> DataFrame:
    return views.unconfirmed_list(fx.entities(spark, d)).select("id", F.unix_timestamp("last_seen").alias("seen"))


@query(f"SELECT id, status FROM {_E} WHERE status IN ('preview', 'registration_open', 'registration_closed', 'upcoming', 'ongoing')")
def active_list(spark: SparkSession, d: str) -> DataFrame:
    return views.active(fx.entities(spark, d)).select("id", "status")


@query(f"SELECT id, status IN ('preview', 'registration_open', 'upcoming', 'ongoing') AND coalesce(competition_end >= {_NOW}, true) AND NOT (status = 'registration_open' AND coalesce(registration_end < {_NOW}, false)) AND year(last_seen) >= year({_NOW}) AS actionable FROM {_E}")
def actionable_flag(spark: SparkSession, d: str) -> DataFrame:
    flag = views.is_actionable(F.col("status"), F.col("registration_end"), F.col("competition_end"), F.year("last_seen"), fx.now())
    return fx.entities(spark, d).select("id", flag.alias("actionable"))


@query(f"SELECT id, CASE WHEN status = 'registration_open' THEN 'open' WHEN status = 'registration_closed' THEN 'closed' WHEN status = 'preview' THEN 'preview' ELSE 'unknown' END AS registration, CASE WHEN status IN ('upcoming', 'ongoing', 'finished') THEN status ELSE 'unknown' END AS competition, status FROM {_E}")
def composite_status(spark: SparkSession, d: str) -> DataFrame:
    both = fx.entities(spark, d).select("id", lifecycle.phases(F.col("status")).alias("p"))
    return both.select("id", "p.registration", "p.competition", lifecycle.composite_status(F.col("p.registration"), F.col("p.competition")).alias("status"))


@query(f"SELECT id, content_hash FROM {_O}")
def normalize_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return fx.observations(spark, d).select("id", "content_hash")


@query(r"SELECT doc_id, sha256(regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g')) AS norm FROM documents")
def search_norm(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.sha2(text.search_norm(F.col("text")), 256).alias("norm"))


@query(r"SELECT p_partkey, coalesce(nullif(regexp_replace(replace(replace(lower(p_name || '|' || p_brand), 'brand', ''), 'red', ''), '[^\p{L}\p{Nd}]', '', 'g'), ''), left(sha256(lower(p_name || '|' || p_brand)), 24)) AS entity_key FROM part")
def entity_key(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select("p_partkey", text.entity_key(F.col("p_name"), F.col("p_brand"), ["brand", "red"]).alias("entity_key"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_name), 'red', ''), '20\d{2}', '', 'g'), '[^\p{L}\p{Nd}]', '', 'g') AS name, regexp_replace(lower(p_name), '\s', '', 'g') AS identity FROM part")
def competition_name(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select("p_partkey", text.competition_name(F.col("p_name"), ["red"]).alias("name"), text.identity_norm(F.col("p_name")).alias("identity"))


@query(r"SELECT page_id, CASE WHEN q <> '' THEN head || '?' || q ELSE head END AS canonical FROM (SELECT page_id, split_part(base, '?', 1) AS head, array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(base, '?') THEN regexp_replace(base, '^[^?]*\?', '') ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|spm|from|source)(=|$)'))), '&') AS q FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS base FROM pages))")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, h AS host, regexp_replace(h, '^www\.', '') AS official, CASE WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'high' WHEN h LIKE 'www.%' AND h LIKE '%.example.com' THEN 'low' WHEN h = 'm.example.com' OR h LIKE '%.example.org' THEN 'medium' ELSE 'low' END AS trust FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages)")
def domain_trust(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    trust = urls.trust_for_url(url, ["example.net"], ["m.example.com", ".example.org"], F.lit("low"), F.lit("page"))
    return fx.table(spark, d, "pages").select("page_id", urls.host(url).alias("host"), urls.official_domain(url).alias("official"), trust.alias("trust"))


@query("""SELECT c_custkey, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0) OR (a = 198 AND b IN (18, 19))) AS public
FROM (SELECT c_custkey, c_custkey % 256 AS a, (c_custkey * 7) % 256 AS b, (c_custkey * 13) % 256 AS c FROM customer)""")
def safe_ip_range(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    address = F.concat_ws(".", key % 256, (key * 7) % 256, (key * 13) % 256, F.lit("9"))
    return fx.table(spark, d, "customer").select("c_custkey", urls.public_ipv4(address).alias("public"))


@query("""SELECT doc_id, tag FROM documents, (VALUES ('data', 'tion'), ('design', 'ment'), ('design', 'ing'), ('law', 'keit'), ('math', 'ción'), ('math', 'ados')) v(tag, marker) WHERE contains(lower(text), marker) GROUP BY ALL""")
def keyword_tags(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.explode(scoring.labels(F.col("text"), fx.LEXICON.tags)).alias("tag"))


@query("""WITH hit AS (SELECT doc_id, label FROM documents, (VALUES ('algorithm', 'eren'), ('business', 'ouan'), ('business', 'verk'), ('general_arts', 'thth')) v(label, marker) WHERE contains(lower(text), marker) GROUP BY ALL)
SELECT * FROM hit UNION ALL SELECT doc_id, 'general' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)""")
def profile_labels(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.explode(scoring.labels(F.col("text"), fx.LEXICON.categories, "general")).alias("label"))


def window_sql(text: str, markers: list[str]) -> str:
    """The evidence of the first marker, in list order, that occurs in ``text``; else null."""
    ends = "[^。！？!?；;\\n]"
    quoted = [m.replace("'", "''") for m in markers]
    parts = (f"nullif(trim(regexp_extract({text}, '({ends}{{0,80}}?(?i:{m}){ends}{{0,{160 - len(m)}}})', 1)), '')" for m in quoted)
    return f"coalesce({', '.join(parts)})"


@query(f"SELECT doc_id, {window_sql('text', ['tible', 'keit'])} AS evidence FROM documents")
def evidence_window(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", text.evidence_window(F.col("text"), ["tible", "keit"]).alias("evidence"))


@query("SELECT o_orderkey, CAST(epoch(date_trunc('day', CAST(o_orderdate AS TIMESTAMP))) AS BIGINT) + 3600 * (o_orderkey % 24) + 60 * (o_orderkey % 60) AS parsed FROM orders WHERE year(o_orderdate) >= 2000")
def date_extract(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    hour, minute = F.pmod("o_orderkey", F.lit(24)), F.pmod("o_orderkey", F.lit(60))
    said = F.concat(F.lit("截止 "), F.date_format(day, "yyyy年M月d日"), F.lit(" "), hour, F.lit(":"), minute)
    parsed = dates.parse_date(said)
    return fx.table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(parsed).alias("parsed")).where("parsed is not null")


@query("""SELECT o_orderkey, CASE WHEN ok THEN CAST(epoch(a) AS BIGINT) END AS first_day, CASE WHEN ok THEN CAST(epoch(b) AS BIGINT) END AS last_day FROM (
SELECT o_orderkey, a, make_timestamp(year(a), month(c), day(c), 0, 0, 0) AS b, make_timestamp(year(a), month(c), day(c), 0, 0, 0) >= a AS ok
FROM (SELECT o_orderkey, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 2557 DAY AS a, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 2557 DAY + to_days(CAST(o_orderkey % 27 AS INTEGER)) AS c FROM orders))""")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    first = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 2557 DAY")
    last = first + F.make_interval(days=F.pmod("o_orderkey", F.lit(27)).cast("int"))
    said = F.concat(F.date_format(first, "yyyy年M月d日"), F.lit("至"), F.date_format(last, "M月d日"))
    rows = fx.table(spark, d, "orders").select("o_orderkey", dates.date_range(said).alias("r"))
    return rows.select("o_orderkey", F.unix_timestamp("r.start").alias("first_day"), F.unix_timestamp("r.end").alias("last_day"))


_LINKS = r"""SELECT page_id, pos, href, title, 10 * (CAST(contains(lower(title), 'the') AS INTEGER) + CAST(contains(lower(title), 'ing') AS INTEGER) + CAST(contains(lower(title), 'an') AS INTEGER)) - 20 * (CAST(contains(lower(title), 'sch') AS INTEGER) + CAST(contains(lower(title), 'keit') AS INTEGER)) AS priority
FROM (SELECT page_id, i - 1 AS pos, regexp_extract(a[i], 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a[i], '>([^<]*)</a>', 1)) AS title FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*?href="[^"]*"[^>]*>[^<]*</a>') AS a FROM pages)))
WHERE length(title) >= 4 AND NOT regexp_matches(lower(href), '^(javascript|mailto):')"""


@query(f"SELECT page_id, CAST(pos AS BIGINT) AS pos, href, title, CAST(priority AS BIGINT) AS priority FROM ({_LINKS})")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.page_links(fx.table(spark, d, "pages"), fx.LEXICON, 500)
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "title", F.col("priority").cast("long").alias("priority"))


@query(f"SELECT page_id, href, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pos) AS place FROM ({_LINKS})) WHERE place <= 3")
def link_priority_topk(spark: SparkSession, d: str) -> DataFrame:
    return scoring.page_links(fx.table(spark, d, "pages"), fx.LEXICON, 3).select("page_id", "href", F.col("place").cast("long").alias("place"))


@query(f"SELECT href, page_id, CAST(pos AS BIGINT) AS pos, title FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS r FROM ({_LINKS})) WHERE r = 1")
def distinct_candidates(spark: SparkSession, d: str) -> DataFrame:
    links = scoring.page_links(fx.table(spark, d, "pages"), fx.LEXICON, 500).select("href", "page_id", F.col("pos").cast("long").alias("pos"), "title")
    return records.first_by(links, ["href"], ["page_id", "pos"])


#: Anchors of the pages lead to paths of their own site; the SQL reads no other kind, and takes pages on a text's number in nine as listings.
_MEANT = "regexp_extract(trim(url), '^[a-z]+://[^/?#]*') || "
_PATH_SQL = "CASE WHEN regexp_full_match(href, '[A-Za-z0-9_.~!$&''()*+,;=:@/%-]*') THEN href ELSE replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(href), '%24', '$'), '%26', '&'), '%2B', '+'), '%2C', ','), '%2F', '/'), '%3A', ':'), '%3B', ';'), '%3D', '='), '%40', '@') END"


@query(f"""WITH own AS (SELECT page_id, 0 AS place, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '[?].*$', '') || CASE WHEN contains(url, '?') THEN '?' || coalesce(list_aggregate(list_sort(list_filter(string_split(regexp_replace(regexp_replace(url, '#.*$', ''), '^[^?]*[?]', ''), '&'), lambda p: NOT regexp_matches(p, '^(utm_|spm=|from=|source=)'))), 'string_agg', '&'), '') ELSE '' END AS url, '' AS title FROM pages WHERE page_id % 9 <> 0),
links AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pos) AS place, {_MEANT}{_PATH_SQL} AS url, title FROM (SELECT l.* EXCLUDE (priority), p.url, {' + '.join(f"10 * CAST(contains(lower(title), '{t.lower()}') AS INTEGER)" for t in scoring.FIELD.link_up)} - 20 * ({' + '.join(f"CAST(contains(lower(title), '{t.lower()}') AS INTEGER)" for t in scoring.FIELD.link_down)}) AS priority FROM ({_LINKS}) l JOIN pages p USING (page_id))),
top AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM links)),
once AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS turn FROM top WHERE n <= 5)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS BIGINT) AS place, rtrim(url, '?') AS url, title FROM once WHERE turn = 1""")
def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "pages").withColumn("listing", F.col("page_id") % 9 == 0)
    found = scoring.candidates(rows, scoring.FIELD, 5, listing="listing")
    return found.select("page_id", F.col("place").cast("long").alias("place"), "url", "title")


_BASELINE = f"(SELECT source_id, url, any_value(CASE WHEN id % 10 = 0 THEN 'x' ELSE content_hash END) AS last_hash, any_value(version) AS version FROM (SELECT id, source_id, 'doc/' || id AS url, content_hash, version FROM {_O}) WHERE id % 2 = 0 GROUP BY source_id, url)"


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return fx.observations(spark, d).withColumn("url", F.concat(F.lit("doc/"), F.col("id")))


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).where("id % 2 = 0").select("source_id", "url", F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("content_hash")).alias("last_hash"), "version")


@query(f"SELECT o.id, CASE WHEN b.last_hash IS NULL THEN 'new' WHEN b.last_hash = o.content_hash AND b.version = o.version THEN 'unchanged' ELSE 'changed' END AS kind FROM (SELECT id, source_id, 'doc/' || id AS url, content_hash, version FROM {_O}) o LEFT JOIN {_BASELINE} b USING (source_id, url)")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return changes.detect_changes(_seen(spark, d), _baseline(spark, d)).select("id", "kind")


@query(f"SELECT source_id, url, content_hash AS last_hash, version FROM (SELECT id, source_id, 'doc/' || id AS url, content_hash, version FROM {_O})")
def next_baseline(spark: SparkSession, d: str) -> DataFrame:
    return changes.next_baseline(_seen(spark, d), _baseline(spark, d))


@query(f"SELECT source_id, url, content_hash, id, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url, content_hash ORDER BY seen_at DESC, id DESC) AS r FROM {_O}) WHERE r = 1")
def latest_observation(spark: SparkSession, d: str) -> DataFrame:
    return retention.latest_observation(fx.observations(spark, d)).select("source_id", "url", "content_hash", "id", "seen_at")


@query(f"SELECT url, min(seen_at) AS first_seen FROM {_O} GROUP BY url")
def first_observed(spark: SparkSession, d: str) -> DataFrame:
    return retention.first_observed(fx.observations(spark, d))


@query(f"SELECT id FROM {_O} WHERE seen_at >= 500 OR id IN (SELECT max(id) FROM {_O} GROUP BY source_id, url)")
def retention_keep(spark: SparkSession, d: str) -> DataFrame:
    return retention.kept_observations(fx.observations(spark, d), F.lit(500)).select("id")


@query(f"SELECT id FROM {_E} WHERE status IN ('registration_closed', 'finished') AND last_seen < {_NOW} AND id NOT IN (SELECT competition_id FROM {_N} WHERE status IN ('pending', 'failed'))")
def compact_closed(spark: SparkSession, d: str) -> DataFrame:
    return retention.compactable(fx.entities(spark, d), fx.notifications(spark, d), fx.now()).select("id")


_STREAKS = """SELECT event_id, user_id, CAST(CASE WHEN failed THEN row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - (CASE WHEN island > 0 THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS streak
FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, event_type = 'error' AS failed FROM events))"""


def _streaks(spark: SparkSession, d: str) -> DataFrame:
    log = fx.table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return health.failure_streaks(log, "user_id", ["ts", "event_id"], "failed", F.date_trunc("day", "ts"))


@query(_STREAKS)
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return _streaks(spark, d).select("event_id", "user_id", "streak")


@query(f"SELECT event_id, user_id, streak FROM ({_STREAKS}) WHERE streak >= 3")
def alerts_due(spark: SparkSession, d: str) -> DataFrame:
    return health.alerts(_streaks(spark, d), "user_id", ["ts", "event_id"], 3).select("event_id", "user_id", "streak")


_GROUPS = f"SELECT delivery_group, user_id, min(due_at) AS due_at FROM {_N} JOIN supplier ON s_suppkey = user_id WHERE status IN ('pending', 'failed') AND due_at <= {_NOW} AND s_acctbal > 0 GROUP BY ALL"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return outbox.due_groups(fx.notifications(spark, d), fx.recipients(spark, d), fx.now())


@query(f"SELECT delivery_group, user_id, CAST(epoch(due_at) AS BIGINT) AS due_at FROM ({_GROUPS})")
def pending_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("delivery_group", "user_id", _seconds("due_at"))


@query(f"SELECT n.delivery_group, n.user_id, n.competition_id, n.event_key, n.status, coalesce(c.decision, 'undecided') AS decision FROM {_N} n SEMI JOIN ({_GROUPS}) g ON g.delivery_group = n.delivery_group AND g.user_id = n.user_id LEFT JOIN {fx.CHOICES_SQL} c ON c.user_id = n.user_id AND c.competition_id = n.competition_id WHERE n.status IN ('pending', 'failed')")
def group_items(spark: SparkSession, d: str) -> DataFrame:
    return outbox.group_items(fx.notifications(spark, d), _groups(spark, d), fx.choices(spark, d)).select("delivery_group", "user_id", "competition_id", "event_key", "status", "decision")


@query(f"SELECT user_id, count(*) AS n FROM {_N} WHERE status IN ('pending', 'failed') GROUP BY user_id")
def pending_count(spark: SparkSession, d: str) -> DataFrame:
    return outbox.pending_counts(fx.notifications(spark, d))


@query(f"SELECT n.competition_id, n.event_key, n.status, e.status AS entity_status, CAST(epoch(n.due_at) AS BIGINT) AS due_at FROM {_N} n JOIN {_E} e ON e.id = n.competition_id WHERE n.user_id = 7 ORDER BY n.due_at DESC, n.competition_id, n.event_key LIMIT 20")
def notification_history(spark: SparkSession, d: str) -> DataFrame:
    return outbox.history(fx.notifications(spark, d), fx.entities(spark, d), 7).select("competition_id", "event_key", "status", "entity_status", F.unix_timestamp("due_at").alias("due_at"))


@query(f"SELECT user_id, competition_id, event_key, CASE WHEN g.delivery_group IS NOT NULL THEN 'failed' ELSE status END AS status, CAST(attempt_count + CASE WHEN g.delivery_group IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempt_count, CASE WHEN g.delivery_group IS NOT NULL THEN CAST(epoch({_NOW}) AS BIGINT) + least(86400, 300 * CAST(pow(2, least(attempt_count, 8)) AS BIGINT)) ELSE CAST(epoch(n.due_at) AS BIGINT) END AS due_at FROM {_N} n LEFT JOIN (SELECT DISTINCT delivery_group FROM ({_GROUPS})) g USING (delivery_group)")
def backoff_due(spark: SparkSession, d: str) -> DataFrame:
    return outbox.mark_failed(fx.notifications(spark, d), _groups(spark, d), fx.now()).select("user_id", "competition_id", "event_key", "status", "attempt_count", _seconds("due_at"))


@query("""SELECT c_custkey AS user_id, CAST(epoch(CASE c_custkey % 3 WHEN 2 THEN n WHEN 0 THEN timezone('UTC', CASE WHEN at0 > l0 THEN at0 ELSE at0 + INTERVAL 1 DAY END) ELSE timezone('Asia/Shanghai', CASE WHEN at1 > l1 THEN at1 ELSE at1 + INTERVAL 7 DAY END) END) AS BIGINT) AS due_at FROM (
SELECT *, date_trunc('day', l0) + to_hours(c_custkey % 24) AS at0, date_trunc('day', l1) + to_hours(c_custkey % 24) + to_days(CAST((c_custkey % 7 - dayofweek(l1) + 7) % 7 AS INTEGER)) AS at1 FROM (
SELECT c_custkey, timezone('UTC', TIMESTAMP '1998-06-01 00:00:00') AS n, TIMESTAMP '1998-06-01 00:00:00' AS l0, timezone('Asia/Shanghai', timezone('UTC', TIMESTAMP '1998-06-01 00:00:00')) AS l1 FROM customer))""")
def next_delivery(spark: SparkSession, d: str) -> DataFrame:
    due = dates.next_delivery(fx.now(), F.col("frequency"), F.col("hour"), F.lit(0), F.col("weekday"), F.col("zone"))
    return fx.audience(spark, d).select("user_id", F.unix_timestamp(due).alias("due_at"))


@query(r"""SELECT DISTINCT doc_id, keyword FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') AS t FROM documents), (VALUES ('tible', 'tible'), ('retion', 'retion'), ('retion', 'keitver'), ('ouanle', 'ouanle')) v(keyword, form) WHERE contains(t, form)""")
def alias_keyword_match(spark: SparkSession, d: str) -> DataFrame:
    keywords = spark.createDataFrame([("tible",), ("retion",), ("ouanle",)], "keyword string")
    return match.keyword_match(fx.table(spark, d, "documents"), keywords, [["retion", "keitver"]], "doc_id", "text")


@query(f"""WITH disp AS (SELECT user_id, competition_id, event_key + 1 AS event_key, due_at + INTERVAL 1 DAY AS due_at FROM {_N} WHERE event_key % 2 = 1)
SELECT user_id, competition_id, event_key, CASE WHEN d.user_id IS NOT NULL AND (n.status IS NULL OR n.status = 'cancelled') THEN 'pending' ELSE n.status END AS status, CASE WHEN d.user_id IS NOT NULL AND (n.status IS NULL OR n.status = 'cancelled') THEN 0 ELSE n.attempt_count END AS attempt_count,
CAST(epoch(CASE WHEN d.user_id IS NOT NULL AND (n.status IS NULL OR n.status = 'cancelled') THEN d.due_at ELSE n.due_at END) AS BIGINT) AS due_at FROM {_N} n FULL JOIN disp d USING (user_id, competition_id, event_key)""")
def enqueue_upsert(spark: SparkSession, d: str) -> DataFrame:
    box = fx.notifications(spark, d)
    sent = box.where("event_key % 2 = 1").withColumns({"event_key": F.col("event_key") + 1, "due_at": F.col("due_at") + F.expr("INTERVAL 1 DAY")})
    return outbox.enqueue(box, sent).select("user_id", "competition_id", "event_key", "status", "attempt_count", _seconds("due_at"))


_DICE = """WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, length(name) - 1 AS size, substring(name, i, 2) AS gram FROM (SELECT name, unnest(range(1, length(name))) AS i FROM n)),
c AS (SELECT name, size, gram, count(*) AS k FROM g GROUP BY ALL), pairs AS (SELECT a.name AS left_name, b.name AS right_name, round(2.0 * sum(least(a.k, b.k)) / (a.size + b.size), 6) AS dice FROM c a JOIN c b USING (gram) WHERE a.name < b.name GROUP BY a.name, b.name, a.size, b.size)"""


@query(f"{_DICE} SELECT left_name, right_name, dice FROM pairs WHERE dice >= 0.5")
def dice_pairs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.dice_pairs(fx.table(spark, d, "part"), "p_name", 0.5)


@query("""WITH t AS (SELECT conv_id, CAST(length(text) % 3 AS BIGINT) AS value, role AS edition, count(*) AS votes FROM conversations GROUP BY ALL), m AS (SELECT *, max(votes) OVER (PARTITION BY conv_id) AS most FROM t)
SELECT conv_id, CASE WHEN count(*) = 1 THEN min(value) END AS value, CASE WHEN count(*) = 1 THEN min(edition) END AS edition, max(votes) AS votes, count(*) > 1 AS conflict FROM m WHERE votes = most GROUP BY conv_id""")
def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = fx.table(spark, d, "conversations").select("conv_id", F.pmod(F.char_length("text"), F.lit(3)).cast("long").alias("value"), F.col("role").alias("edition"), F.lit("medium").alias("confidence"), F.col("text").alias("evidence"))
    return consensus.consensus(votes, "conv_id")


@query(r"SELECT b.item_id AS quote_id, d.doc_id AS text_id FROM (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark) b JOIN (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) d ON contains(t, q) WHERE len(string_split(q, ' ')) >= 5")
def evidence_containment(spark: SparkSession, d: str) -> DataFrame:
    quotes = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return consensus.quoted(quotes, fx.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query("SELECT conv_id, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations) WHERE n = 1")
def duplicate_field_reject(spark: SparkSession, d: str) -> DataFrame:
    return consensus.single_proposals(fx.table(spark, d, "conversations"), ["conv_id", "role"]).select("conv_id", "turn")


@query("""SELECT conv_id, turn, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place FROM (SELECT *, 20 * (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'please') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER)) + CASE WHEN turn = 0 THEN 10 ELSE 0 END AS score FROM conversations)) WHERE place <= 2""")
def segment_topk(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_segments(fx.table(spark, d, "conversations"), fx.LEXICON, 2, "conv_id", "turn", "text").select("conv_id", "turn", F.col("score").cast("long").alias("score"))


_GAPS = " UNION ALL ".join(f"SELECT id, '{f}' AS field FROM {_E} WHERE {f} IS NULL" for f in lifecycle.DATE_FIELDS)


@query(_GAPS)
def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return research.evidence_gaps(fx.entities(spark, d)).select("id", "field")


@query(f"""WITH gaps AS ({_GAPS}), due AS (SELECT * FROM gaps WHERE NOT (id % 2 = 0 AND id % 4 <> 0)), first_ones AS (SELECT DISTINCT id, id % 2 = 0 AS known FROM due ORDER BY known, id LIMIT 50)
SELECT id, field FROM due SEMI JOIN first_ones USING (id)""")
def research_plan(spark: SparkSession, d: str) -> DataFrame:
    gaps = research.evidence_gaps(fx.entities(spark, d))
    later = F.when(F.col("id") % 4 == 0, fx.now()).otherwise(fx.now() + F.expr("INTERVAL 1 DAY"))
    states = gaps.where("id % 2 = 0").select("id", "field", later.alias("next_retry_at"))
    return research.research_plan(gaps, states, fx.now(), 50)


@query("""SELECT doc_id, CASE WHEN q = 1 THEN CASE WHEN s >= 6 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END WHEN q = 0 THEN CASE WHEN s >= 4 THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence FROM (SELECT d.doc_id, l.quality AS q, CASE l.quality WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 0 END + CASE WHEN length(trim(d.text)) >= 8 THEN 2 ELSE 0 END + CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END + 1 AS s FROM documents d LEFT JOIN labels l USING (doc_id))""")
def fact_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "left")
    trust = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    sure = lifecycle.fact_confidence(trust, F.col("text"), F.when(F.col("doc_id") % 2 == 0, "2026"), F.lit("2026-01-01"))
    return rows.select("doc_id", sure.alias("confidence"))


from tidemark.plans import dispatch_queries  # noqa: E402, F401  (its SQL reads that of next_delivery)

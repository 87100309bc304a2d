"""Queries of entity resolution: pairs, pairwise merges, and the fold of announcements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.markers import NAME_NOISE, TITLE_NOISE
from tidemark.operators import merge, resolve, upsert
from tidemark.plans.base import query
from tidemark.sources import announcements as ann
from tidemark.sources import fixtures as fx

#: Columns that the SQL folds and merges.
SHOWN = ["entity_key", "name", "organizer", "status", "status_evidence", "registration_phase", "competition_phase", "registration_end_raw", "registration_end", "team_requirement", "fee", "fee_evidence", "keywords", "content", "fit_reason", "eligibility_note", "official_url", "trust", "analyzer_version", "problem_released", "first_seen", "last_seen"]
_KEYS = ["name_key", "organizer_key", "edition_mark", "name_year"]
_TIMES = ("registration_end", "first_seen", "last_seen")

_YEAR = "coalesce(try_cast(nullif(regexp_extract({}, '20\\d{{2}}'), '') AS INTEGER), 0)"


def _letters(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{Nd}}]', '', 'g')"


def _name_key(c: str) -> str:
    out = f"lower({c})"
    for phrase in NAME_NOISE:
        out = f"replace({out}, '{phrase}', '')"
    return _letters(rf"regexp_replace({out}, '20\d{{2}}', '', 'g')")


def _keyed(rows: str) -> str:
    """``rows`` with what identity looks at."""
    return f"(SELECT *, {_name_key('name')} AS name_key, {_letters('organizer')} AS organizer_key, regexp_extract(name, '第[一二三四五六七八九十百零〇0-9]+届') AS edition_mark, {_YEAR.format('name')} AS name_year FROM {rows})"


def _dice(names: str) -> str:
    """CTEs that end in ``alike`` (l, r, d): all pairs of distinct names of six characters or more."""
    return f"""faces AS (SELECT DISTINCT name_key AS n FROM {names} WHERE length(name_key) >= 6),
grams AS (SELECT n, substr(n, i, 2) AS g, count(*) AS c FROM (SELECT n, unnest(range(1, length(n))) AS i FROM faces) GROUP BY ALL),
common AS (SELECT a.n AS l, b.n AS r, sum(least(a.c, b.c)) AS c FROM grams a JOIN grams b USING (g) GROUP BY ALL),
alike AS (SELECT l, r, round(2.0 * c / (length(l) + length(r) - 2), 6) AS d FROM common WHERE round(2.0 * c / (length(l) + length(r) - 2), 6) >= 0.78 OR contains(l, r) OR contains(r, l))"""


def _conflict(a: str, b: str) -> str:
    year = lambda t: f"(CASE WHEN {t}.name_year > 0 THEN {t}.name_year ELSE {_YEAR.format(f'{t}.status_evidence')} END)"
    return f"({year(a)} > 0 AND {year(b)} > 0 AND {year(a)} <> {year(b)} OR {a}.edition_mark <> '' AND {b}.edition_mark <> '' AND {a}.edition_mark <> {b}.edition_mark)"


def _agree(a: str, b: str, d: str) -> str:
    return f"({a}.organizer_key = '' OR {b}.organizer_key = '' OR contains({a}.organizer_key, {b}.organizer_key) OR contains({b}.organizer_key, {a}.organizer_key) OR {d} >= 0.92)"


def _lifecycle(r: str, c: str, s: str) -> dict[str, str]:
    """Phases and status that agree, from columns."""
    bare = f"coalesce({r}, '') IN ('', 'unknown') AND coalesce({c}, '') IN ('', 'unknown')"
    reg = f"CASE WHEN {bare} THEN CASE {s} WHEN 'registration_open' THEN 'open' WHEN 'registration_closed' THEN 'closed' WHEN 'preview' THEN 'preview' ELSE 'unknown' END WHEN coalesce({r}, '') = '' THEN 'unknown' ELSE {r} END"
    com = f"CASE WHEN {bare} THEN CASE WHEN {s} IN ('upcoming', 'ongoing', 'finished') THEN {s} ELSE 'unknown' END WHEN coalesce({c}, '') = '' THEN 'unknown' ELSE {c} END"
    status = f"CASE WHEN ({com}) IN ('upcoming', 'ongoing', 'finished') THEN ({com}) ELSE CASE ({reg}) WHEN 'open' THEN 'registration_open' WHEN 'closed' THEN 'registration_closed' WHEN 'preview' THEN 'preview' ELSE 'unknown' END END"
    return {"registration_phase": reg, "competition_phase": com, "status": status}


def _replaced(rows: str, columns: dict[str, str]) -> str:
    return f"(SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in columns.items())}) FROM {rows})"


def _normal(rows: str, prefix: str = "") -> str:
    p = [prefix + c for c in ("registration_phase", "competition_phase", "status")]
    return _replaced(rows, {prefix + c: v for c, v in _lifecycle(*p).items()})


_RANK = "CASE {} WHEN 'preview' THEN 10 WHEN 'registration_open' THEN 20 WHEN 'registration_closed' THEN 30 WHEN 'upcoming' THEN 40 WHEN 'ongoing' THEN 50 WHEN 'finished' THEN 60 ELSE 0 END"
_TRUST = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_NOISY = "(" + " OR ".join(f"contains({{0}}, '{n}')" for n in TITLE_NOISE) + ")"


def _merged(rows: str) -> str:
    """``rows`` with o_* and n_* columns, of which n_* become the merged entity; both are normal."""
    same = "o_official_url = n_official_url"
    anew = f"({same} AND n_analyzer_version <> '' AND n_analyzer_version <> o_analyzer_version)"
    ours, theirs = _TRUST.format("o_trust"), _TRUST.format("n_trust")
    old = lambda when, *columns: {f"n_{c}": f"CASE WHEN {when} THEN o_{c} ELSE n_{c} END" for c in columns}
    noise_o, noise_n = _NOISY.format("o_name"), _NOISY.format("n_name")
    first = old(f"(CASE WHEN {noise_o} <> {noise_n} THEN NOT {noise_o} ELSE length(o_name) <= length(n_name) END)", "name", "name_key", "edition_mark", "name_year")
    first |= old(f"n_organizer = '' AND NOT {anew}", "organizer", "organizer_key") | old(f"n_status_evidence = '' AND NOT {anew}", "status", "status_evidence")
    for c in ("registration_phase", "competition_phase"):
        first |= old(f"n_{c} = 'unknown' AND NOT {anew}", c)
    stated = (("registration_end_raw", ("registration_end_raw", "registration_end")), ("team_requirement", ("team_requirement",)), ("fee", ("fee", "fee_evidence")))
    for told, columns in stated:
        first |= old(f"n_{told} = '' AND NOT {anew}", *columns)
    first |= old(f"n_eligibility_note = '' AND NOT {anew}", "eligibility_note")
    for c in ("content", "fit_reason", "analyzer_version"):
        first |= old(f"n_{c} = ''", c)
    words = "list_filter(list_transform(list_concat(o_keywords, n_keywords), lambda w: trim(w)), lambda w: w <> '')"
    first["n_keywords"] = f"list_filter({words}, lambda w, i: list_position(list_transform({words}, lambda v: lower(v)), lower(w)) = i)"
    first["n_first_seen"] = "o_first_seen"
    step = _normal(_replaced(rows, first), "n_")
    back = f"(NOT {same} AND {_RANK.format('o_status')} > {_RANK.format('n_status')} AND {ours} >= {theirs})"
    second = old(back, "status", "status_evidence", "registration_phase", "competition_phase") | old(f"{ours} > {theirs}", "official_url", "trust")
    for told, columns in stated:
        differ = f"NOT {same} AND o_{told} <> '' AND n_{told} <> '' AND o_{told} <> n_{told}"
        for c in columns:
            second[f"n_{c}"] = f"CASE WHEN {differ} AND {ours} > {theirs} THEN o_{c} WHEN {differ} AND {ours} = {theirs} THEN {'NULL' if c in _TIMES else chr(39) * 2} ELSE n_{c} END"
    return _normal(_replaced(step, second), "n_")


_ROWS = _keyed(_normal(f"(SELECT *, seen_at AS last_seen FROM {ann.ARRIVALS_SQL})"))
_STATE = [*SHOWN, *_KEYS]
_PAIR = f"SELECT e.k + 1 AS k, e.eid, e.how, e.urls, r.id AS rid, {', '.join(f'e.{c} AS o_{c}, r.{c} AS n_{c}' for c in _STATE)}, a.d"
#: The fold: rows of a step are the entities after it; entity -1 stands for what isn't there yet.
_FOLD = f"""WITH RECURSIVE arrivals AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seen_at, id) AS turn FROM {_ROWS}),
{_dice('arrivals')},
state AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS eid, '' AS how, CAST([] AS VARCHAR[]) AS urls, CAST(-1 AS BIGINT) AS told, {', '.join(f"CAST(NULL AS {dict(keywords='VARCHAR[]', registration_end='TIMESTAMP', first_seen='TIMESTAMP', last_seen='TIMESTAMP', problem_released='BOOLEAN', name_year='INTEGER').get(c, 'VARCHAR')}) AS {c}" for c in _STATE)}
  UNION ALL
  SELECT k, CASE WHEN part = 1 THEN rid ELSE eid END, CASE WHEN part = 1 THEN 'new' WHEN hit THEN stage_name ELSE '' END, CASE WHEN part = 1 THEN [url] WHEN hit THEN list_distinct(list_append(urls, url)) ELSE urls END, CASE WHEN hit OR part = 1 THEN rid ELSE -1 END,
    {', '.join(f"CASE WHEN part = 1 THEN {'coalesce(a_first_seen, a_last_seen)' if c == 'first_seen' else f'a_{c}'} WHEN hit THEN {'o_entity_key' if c == 'entity_key' else f'n_{c}'} ELSE o_{c} END" for c in _STATE)}
  FROM (
    SELECT *, unnest(CASE WHEN eid = -1 AND NOT bool_or(hit) OVER () THEN [0, 1] ELSE [0] END) AS part FROM (
      SELECT *, stage > 0 AND eid = first_value(eid) OVER (ORDER BY CASE WHEN stage = 0 THEN 9 ELSE stage END, CASE WHEN stage = 3 THEN -epoch(o_last_seen) ELSE 0 END, eid) AS hit, CASE stage WHEN 1 THEN 'key' WHEN 2 THEN 'url' ELSE 'identity' END AS stage_name
      FROM {_merged(f'''(SELECT *, {', '.join(f'n_{c} AS a_{c}' for c in _STATE)} FROM (
        {_PAIR}, r.official_url AS url,
          CASE WHEN e.eid = -1 THEN 0 WHEN e.entity_key = r.entity_key THEN 1
            WHEN e.eid = min(CASE WHEN list_contains(e.urls, r.official_url) THEN e.eid END) OVER () AND NOT {_conflict('e', 'r')} THEN 2
            WHEN a.d IS NOT NULL AND NOT {_conflict('e', 'r')} AND {_agree('e', 'r', 'a.d')} THEN 3 ELSE 0 END AS stage
        FROM state e JOIN arrivals r ON r.turn = e.k + 1 LEFT JOIN alike a ON a.l = e.name_key AND a.r = r.name_key))''')})))"""
_LAST = "(SELECT * FROM state WHERE k = (SELECT max(k) FROM state) AND eid >= 0)"


def _out(c: str) -> str:
    return f"CAST(epoch({c}) AS BIGINT) AS {c}" if c in _TIMES else f"array_to_string({c}, ',') AS {c}" if c == "keywords" else c


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", *(F.unix_timestamp(c).alias(c) if c in _TIMES else F.array_join(c, ",").alias(c) if c == "keywords" else F.col(c) for c in SHOWN))


@query(f"{_FOLD} SELECT eid AS id, {', '.join(map(_out, SHOWN))} FROM {_LAST}")
def entity_fold(spark: SparkSession, d: str) -> DataFrame:
    return _shown(upsert.fold(ann.arrivals(spark, d))[0])


@query(f"{_FOLD} SELECT id, entity, how, r = 1 AS links FROM (SELECT s.told AS id, s.eid AS entity, s.how, row_number() OVER (PARTITION BY s.eid, a.official_url ORDER BY a.turn DESC) AS r FROM state s JOIN arrivals a ON a.id = s.told WHERE s.told >= 0)")
def entity_steps(spark: SparkSession, d: str) -> DataFrame:
    """How each announcement found its entity, and whether the link of its address is its own."""
    rows = ann.arrivals(spark, d)
    _, steps, links = upsert.fold(rows)
    last = links.select(F.col("id").alias("entity"), F.col("url").alias("official_url"), F.col("source_id").alias("_source"), F.col("last_seen").alias("_last"))
    told = steps.join(rows.select("id", "official_url", "source_id", "seen_at"), "id").join(last, ["entity", "official_url"])
    return told.select("id", "entity", "how", ((F.col("source_id") == F.col("_source")) & (F.col("seen_at") == F.col("_last"))).alias("links"))


#: Announcements and the ones that come a thousand later, as two snapshots of one entity.
_PAIRS = f"SELECT o.id, {', '.join(f'o.{c} AS o_{c}, n.{c} AS n_{c}' for c in _STATE)} FROM (SELECT * FROM {_ROWS} WHERE id % 7 < 5) o JOIN (SELECT * REPLACE (CAST(id - 3 AS BIGINT) AS id) FROM {_ROWS}) n USING (id)"
_ALONE = f"SELECT id, {', '.join(SHOWN)} FROM (SELECT * REPLACE (CAST(id - 3 AS BIGINT) AS id) FROM {_ROWS}) WHERE id NOT IN (SELECT id FROM {_ROWS} WHERE id % 7 < 5) UNION ALL SELECT id, {', '.join(SHOWN)} FROM {_ROWS} WHERE id % 7 < 5 AND id NOT IN (SELECT id - 3 FROM {_ROWS})"


@query(f"SELECT id, {', '.join(map(_out, SHOWN))} FROM (SELECT id, {', '.join(f'n_{c} AS {c}' for c in SHOWN)} FROM {_merged(f'({_PAIRS})')} UNION ALL {_ALONE})")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Each announcement is the newer state of the one three before it; some have one side only."""
    rows = ann.arrivals(spark, d).withColumn("last_seen", F.col("seen_at"))
    return _shown(merge.merge_rows(rows.where("id % 7 < 5"), rows.withColumn("id", F.col("id") - 3)))


_PARTS = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') || ' 2026' WHEN p_partkey % 7 = 0 THEN '关于举办' || p_name || p_brand || '的通知' WHEN p_partkey % 5 = 0 THEN p_name || '第十届' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 11 = 0 THEN p_brand || ' GmbH' ELSE '' END AS organizer, CASE WHEN p_partkey % 13 = 0 THEN '2025' ELSE '' END AS status_evidence FROM part)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Items of ``part`` as announcements: spelt in several ways, with organisers, years and editions."""
    key, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    spelt = F.when(key % 3 == 0, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(" 2026"))).when(key % 7 == 0, F.concat(F.lit("关于举办"), name, brand, F.lit("的通知"))).when(key % 5 == 0, F.concat(name, F.lit("第十届"))).otherwise(name)
    organizer = F.when(key % 2 == 0, brand).when(key % 11 == 0, F.concat(brand, F.lit(" GmbH"))).otherwise("")
    return fx.table(spark, d, "part").select(key.alias("id"), spelt.alias("name"), organizer.alias("organizer"), F.when(key % 13 == 0, "2025").otherwise("").alias("status_evidence"))


_FACES = f"(SELECT name_key, organizer_key, edition_mark, CASE WHEN name_year > 0 THEN name_year ELSE {_YEAR.format('status_evidence')} END AS name_year, '' AS status_evidence, min(id) AS face FROM {_keyed(_PARTS)} WHERE length(name_key) >= 6 GROUP BY ALL)"


@query(f"WITH known AS (SELECT * FROM {_keyed(_PARTS)}), {_dice('known')} SELECT x.face AS left_id, y.face AS right_id FROM {_FACES} x JOIN alike a ON a.l = x.name_key JOIN {_FACES} y ON a.r = y.name_key WHERE x.face < y.face AND NOT {_conflict('x', 'y')} AND {_agree('x', 'y', 'a.d')}")
def identity_match(spark: SparkSession, d: str) -> DataFrame:
    return resolve.same_entities(parts(spark, d))

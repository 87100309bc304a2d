"""Announcement pages and entities made up from ``orders``, with the same as SQL.

Each column is picked by the order key from a short list, so all combinations
of phrases, phases, dates and sources occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of these fixtures.
NOW = "2026-06-15 12:00:00"

PREFIX = ["", "关于组织学生参加", "", "关于举办", "第十届", "", "第三届"]
YEAR = ["2026年", "", "2025年", "2027", ""]
SUBJECT = ["全国大学生程序设计竞赛", "AI Agent 黑客松", "网络安全CTF挑战赛", "校园摄影大赛", "华为ICT大赛", "公共政策案例分析大赛", "机器人创新大赛总决赛", "云原生开发者大赛", "CCPC 算法邀请赛", "诗歌朗诵", "重庆市软件大赛"]
SUFFIX = ["", "报名通知", "圆满落幕", " | 官网", "延期通知", "", "报名预告 - 首页", "", "获奖名单", "校内选拔"]
SITE = ["https://www.ccf.example.org/a", "http://cs.example.edu.cn/n", "https://developer.huawei.com/x", "https://bbs.example.com/t", ""]
STATUS = ["报名通道已开启，欢迎参加", "比赛已结束", "大赛正式开赛！祝好运", "距离开赛还有几天", "计划于七月在上海开赛", "报名已截止", "敬请期待", "将于下周公布", "开放报名", "赛事进行中", "暂无消息", "报名中"]
ORGANIZER = ["主办单位：中国计算机学会", "主办方: 某某科技有限公司", "", "主办机构：上海大学教务处；协办：无", "由开源社区组织"]
TEAM = ["每队三人", "可单人参赛", "", "欢迎组队参赛，人数不限", ""]
FEE = ["免费报名", "参赛费：100元/人", "", "报名费为人民币 50.5 元 每队", "报名费另行通知"]
SCOPE = ["面向全国高校", "区域赛", "", "线上公开挑战", "面向全球开发者", "仅限本校学生", "浙江与广东赛区", "对象为本科生"]
PROBLEM = ["赛题发布会", "", "赛题已发布", "赛题发布", "", ""]
DATES = ["", "报名时间：2026年6月1日8:00至9月19日17:00", "报名截止：2026-06-10", "报名开始时间 2026.5.1。报名截止时间：2026/7/1", "报名将于近期截止为2026年7月1日，注册截止为2026年7月2日", "比赛时间：2026年7月25日至26日", "竞赛时间：2026年7月30日至8月2日", "大赛将于2026年7月25~26日举行", "报名将于2026年7月1日至3日进行", "比赛时间：2026年7月30日至2日", "比赛时间：2026年7月25日 至26日18:00", "开赛时间：2026年9月1日 24:00", "比赛时间：2026年2月30日至3月2日", "报名时间：2026年9月19日至6月1日"]
#: What the dates above mean: registration start and end, competition start and end.
MEANT = [
    (None, None, None, None),
    ("2026-06-01 08:00", "2026-09-19 17:00", None, None),
    (None, "2026-06-10 00:00", None, None),
    ("2026-05-01 00:00", "2026-07-01 00:00", None, None),
    (None, None, None, None),
    (None, None, "2026-07-25 00:00", "2026-07-26 00:00"),
    (None, None, "2026-07-30 00:00", "2026-08-02 00:00"),
    (None, None, "2026-07-25 00:00", "2026-07-26 00:00"),
    (None, None, None, None),
    (None, None, None, None),
    (None, None, None, None),
    (None, None, "2026-09-01 23:59", None),
    (None, None, None, None),
    (None, None, None, None),
]
TRUST = ["high", "medium", "low", "high"]
REGISTRATION = ["unknown", "preview", "open", "closed", "open", "unknown", "preview"]
COMPETITION = ["unknown", "unknown", "upcoming", "unknown", "ongoing", "unknown", "finished", "unknown", "unknown"]
PUBLISHED = ["2026-06-01", "2025-01-01", None, "unreadable", None]
RISK = ["", "", "可能不符合", " "]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(values: list, times: int = 1, shift: int = 0, key: str = "o_orderkey") -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(F.col(key) * times + shift, F.lit(len(values))) + 1).cast("int"))


def _literal(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def picked(values: list, times: int = 1, shift: int = 0) -> str:
    return f"(CAST([{', '.join(map(_literal, values))}] AS VARCHAR[]))[CAST((o_orderkey * {times} + {shift}) % {len(values)} + 1 AS INTEGER)]"


_NAME = ((PREFIX, 1), (YEAR, 3), (SUBJECT, 1), (SUFFIX, 7))
_BODY = ((STATUS, 5), (ORGANIZER, 2), (TEAM, 1), (FEE, 3), (SCOPE, 3), (PROBLEM, 5), (DATES, 3))


#: Keys of one task.
KEYS_A_TASK = 50_000


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """The keys of a table, dealt over all cores: a file of one row group is one partition, and what follows is costly.

    Tasks grow with the table (its count is read from the file's footer): a session
    says two cores until its executors have come, and so few tasks would be the rest of it.
    """
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("o_orderkey"))
    return keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // KEYS_A_TASK)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(_keys(spark, sf_dir, "orders", "o_orderkey"))


def pages_of(keys: DataFrame) -> DataFrame:
    return keys.select(
        F.col("o_orderkey").alias("id"),
        F.concat(*(pick(v, t) for v, t in _NAME)).alias("title"),
        F.lit("").alias("candidate_title"),
        F.concat_ws("。", *(pick(v, t) for v, t in _BODY)).alias("text"),
        pick(SITE, 2).alias("url"),
        pick(TRUST, 1).alias("trust"),
        (F.pmod("o_orderkey", F.lit(97)) == 0).alias("is_listing"),
        pick(PUBLISHED, 1).alias("published"),
    )


PAGES_SQL = f"""(SELECT o_orderkey AS id, o_orderkey % 14 AS unused, {' || '.join(picked(v, t) for v, t in _NAME)} AS title,
  concat_ws('。', {', '.join(picked(v, t) for v, t in _BODY)}) AS text, {picked(SITE, 2)} AS url, {picked(TRUST)} AS trust, o_orderkey % 97 = 0 AS is_listing, {picked(PUBLISHED)} AS published, o_orderkey FROM orders)"""
#: The same with white space folded.
BODY_SQL = f"(SELECT *, trim(regexp_replace(title || '  ' || text, '\\s+', ' ', 'g')) AS body FROM {PAGES_SQL})"


def _days(times: int, range_: int, back: int, skip: int) -> Column:
    day = F.lit(NOW[:10]).cast("timestamp") + F.make_interval(days=(F.pmod(F.col("o_orderkey") * times, F.lit(range_)) - back).cast("int"))
    return F.when(F.pmod("o_orderkey", F.lit(skip)) != 0, day)


def _days_sql(times: int, range_: int, back: int, skip: int) -> str:
    return f"CASE WHEN o_orderkey % {skip} <> 0 THEN TIMESTAMP '{NOW[:10]} 00:00:00' + to_days(CAST((o_orderkey * {times}) % {range_} - {back} AS INTEGER)) END"


def competitions(spark: SparkSession, sf_dir: str, shift: int = 0, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """Entities; ``shift`` moves their phases, for a later snapshot."""
    return entities_of(_keys(spark, sf_dir, table, key), shift)


def entities_of(keys: DataFrame, shift: int = 0) -> DataFrame:
    return keys.select(
        F.col("o_orderkey").alias("id"),
        F.concat(*(pick(v, t) for v, t in _NAME)).alias("name"),
        F.concat(pick(ORGANIZER, 2)).alias("organizer"),
        F.concat_ws("。", pick(SCOPE, 3), pick(TEAM, 1)).alias("content"),
        pick(STATUS, 5).alias("status_evidence"),
        pick(REGISTRATION, 3, shift).alias("registration_phase"),
        pick(COMPETITION, 2, shift).alias("competition_phase"),
        _days(7, 61, 30, 6).alias("registration_end"),
        _days(11, 121, 40, 4).alias("competition_end"),
        pick(TRUST, 1).alias("trust"),
        pick(SITE, 2).alias("official_url"),
        _days(5, 400, 400, 1_000_003).alias("first_seen"),
        pick(PUBLISHED, 1).alias("published"),
        (F.pmod("o_orderkey", F.lit(13)) == shift).alias("problem_released"),
        pick(RISK, 1).alias("eligibility_note"),
    )


def competitions_sql(shift: int = 0, table: str = "orders", key: str = "o_orderkey") -> str:
    return f"""(SELECT o_orderkey AS id, {' || '.join(picked(v, t) for v, t in _NAME)} AS name, {picked(ORGANIZER, 2)} AS organizer, concat_ws('。', {picked(SCOPE, 3)}, {picked(TEAM)}) AS content,
  {picked(STATUS, 5)} AS status_evidence, {picked(REGISTRATION, 3, shift)} AS registration_phase, {picked(COMPETITION, 2, shift)} AS competition_phase,
  {_days_sql(7, 61, 30, 6)} AS registration_end, {_days_sql(11, 121, 40, 4)} AS competition_end, {picked(TRUST)} AS trust, {picked(SITE, 2)} AS official_url,
  {_days_sql(5, 400, 400, 1_000_003)} AS first_seen, {picked(PUBLISHED)} AS published, o_orderkey % 13 = {shift} AS problem_released, {picked(RISK)} AS eligibility_note FROM (SELECT {key} AS o_orderkey FROM {table}))"""


#: Lists that users choose from; an empty one is no filter.
WANTED_CATEGORIES = [["algorithm", "ai_data"], [], ["security"], ["hackathon", "cloud_native", "general"], ["iot_hardware"]]
WANTED_TYPES = [[], ["university", "enterprise"], [], ["government_society"], []]
WANTED_SCOPES = [[], ["national", "regional"], [], []]
WANTED_REGIONS = [["浙江"], [], ["重庆", "广东"]]
INCLUDE = [[], ["LLM", "竞赛"], [], ["Cloud-Native"], [], ["大赛"], []]
EXCLUDE = [[], [], ["摄影"], ["诗歌", "校园"], []]


def _pick_list(values: list[list[str]], times: int = 1) -> Column:
    arrays = [F.array(*map(F.lit, v)).cast("array<string>") for v in values]
    return F.element_at(F.array(*arrays), (F.pmod(F.col("s_suppkey") * times, F.lit(len(values))) + 1).cast("int"))


def _picked_list(values: list[list[str]], times: int = 1) -> str:
    lists = ", ".join("[" + ", ".join(map(_literal, v)) + "]" for v in values)
    return f"(CAST([{lists}] AS VARCHAR[][]))[CAST((s_suppkey * {times}) % {len(values)} + 1 AS INTEGER)]"


FLAGS = ("notify_important_update", "notify_preview", "notify_registration", "notify_upcoming", "notify_started", "notify_problem_release")


def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        key.alias("user_id"),
        _pick_list(WANTED_CATEGORIES).alias("categories"),
        _pick_list(WANTED_TYPES, 2).alias("organizer_types"),
        _pick_list(WANTED_SCOPES).alias("scopes"),
        _pick_list(WANTED_REGIONS).alias("regions"),
        _pick_list(INCLUDE, 3).alias("include_keywords"),
        _pick_list(EXCLUDE, 3).alias("exclude_keywords"),
        F.when(key % 3 == 0, "high").when(key % 3 == 1, "medium").otherwise("low").alias("min_trust"),
        (F.col("s_acctbal") > 0).alias("allow_risk"),
        *((key % (5 + i) != 0).alias(f) for i, f in enumerate(FLAGS)),
    )


AUDIENCE_SQL = f"""(SELECT s_suppkey AS user_id, {_picked_list(WANTED_CATEGORIES)} AS categories, {_picked_list(WANTED_TYPES, 2)} AS organizer_types, {_picked_list(WANTED_SCOPES)} AS scopes, {_picked_list(WANTED_REGIONS)} AS regions,
  {_picked_list(INCLUDE, 3)} AS include_keywords, {_picked_list(EXCLUDE, 3)} AS exclude_keywords, CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS least_trust, s_acctbal > 0 AS allow_risk, {', '.join(f's_suppkey % {5 + i} <> 0 AS {f}' for i, f in enumerate(FLAGS))} FROM supplier)"""


#: What announcements say beside the columns of entities; each list is picked by its own step.
FEES = ["", "50元/人", "", "100元/人", "50元/人", ""]
TEAMS = ["", "每队三人", "可单人参赛", "", "每队三人"]
ENDS = ["", "2026年7月1日", "", "2026年7月2日", "7月1日"]
VERSIONS = ["v1", "v2", "", "v1", "v1", "v2", "v1"]
OLD_STATUS = ["", "registration_open", "upcoming", "unknown", "preview", "finished", "registration_closed", ""]
FIT = ["", "适合", "", "值得参加"]
WORDS = [["云计算", "AI"], ["ai ", "算法"], [], ["", "算法", "机器人"]]


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements in order of arrival, from ``customer``: some without phases, some of equal times."""
    rows = competitions(spark, sf_dir, table="customer", key="c_custkey").withColumn("o_orderkey", F.col("id"))
    bare = F.pmod("id", F.lit(9)) == 0
    subject = F.pmod("id", F.lit(len(SUBJECT))).cast("string")
    end = pick(ENDS, 5)
    words = F.array(*(F.array(*map(F.lit, w)).cast("array<string>") for w in WORDS))
    return rows.withColumns({
        "seen_at": F.lit(NOW).cast("timestamp") + F.make_interval(hours=F.floor(F.col("id") / 3).cast("int")),
        "source_id": F.concat(F.lit("s"), F.pmod("id", F.lit(5)).cast("string")),
        "entity_key": F.concat(F.lit("k"), subject, F.lit("-"), F.pmod("id", F.lit(37)).cast("string")),
        "official_url": F.concat(F.lit("https://s"), subject, F.lit(".example.org/"), F.pmod(F.col("id") * 7, F.lit(23)).cast("string")),
        "organizer": F.regexp_extract(pick(ORGANIZER, 2), "[：:](.+)$", 1),
        "status": pick(OLD_STATUS, 3),
        "status_evidence": F.when(F.pmod("id", F.lit(4)) == 1, "").otherwise(pick(STATUS, 5)),
        "registration_phase": F.when(bare, "").otherwise(F.col("registration_phase")),
        "competition_phase": F.when(bare, F.lit(None)).otherwise(F.col("competition_phase")),
        "registration_end_raw": end,
        "registration_end": F.when(end != "", F.lit("2026-07-01").cast("timestamp") + F.make_interval(days=F.pmod("id", F.lit(3)).cast("int"))),
        "team_requirement": pick(TEAMS, 3),
        "fee": pick(FEES, 5),
        "fee_evidence": F.when(pick(FEES, 5) != "", F.concat(F.lit("报名费为"), pick(FEES, 5))).otherwise(""),
        "analyzer_version": pick(VERSIONS, 3),
        "fit_reason": pick(FIT, 3),
        "keywords": F.element_at(words, (F.pmod("id", F.lit(len(WORDS))) + 1).cast("int")),
        "first_seen": F.when(F.pmod("id", F.lit(5)) == 0, F.col("first_seen")),
    }).drop("o_orderkey", "competition_end", "published")


_WORDS_SQL = f"[{', '.join('CAST([' + ', '.join(map(_literal, w)) + '] AS VARCHAR[])' for w in WORDS)}][CAST(id % {len(WORDS)} + 1 AS INTEGER)]"
ARRIVALS_SQL = f"""(SELECT id, name, content, trust, problem_released, eligibility_note, TIMESTAMP '{NOW}' + to_hours(CAST(floor(id / 3) AS BIGINT)) AS seen_at, 's' || (id % 5) AS source_id,
  'k' || (id % {len(SUBJECT)}) || '-' || (id % 37) AS entity_key, 'https://s' || (id % {len(SUBJECT)}) || '.example.org/' || (id * 7 % 23) AS official_url,
  regexp_extract({picked(ORGANIZER, 2)}, '[：:](.+)$', 1) AS organizer, {picked(OLD_STATUS, 3)} AS status, CASE WHEN id % 4 = 1 THEN '' ELSE {picked(STATUS, 5)} END AS status_evidence,
  CASE WHEN id % 9 = 0 THEN '' ELSE registration_phase END AS registration_phase, CASE WHEN id % 9 = 0 THEN '' ELSE competition_phase END AS competition_phase,
  {picked(ENDS, 5)} AS registration_end_raw, CASE WHEN {picked(ENDS, 5)} <> '' THEN TIMESTAMP '2026-07-01 00:00:00' + to_days(CAST(id % 3 AS INTEGER)) END AS registration_end,
  {picked(TEAMS, 3)} AS team_requirement, {picked(FEES, 5)} AS fee, CASE WHEN {picked(FEES, 5)} <> '' THEN '报名费为' || {picked(FEES, 5)} ELSE '' END AS fee_evidence,
  {picked(VERSIONS, 3)} AS analyzer_version, {picked(FIT, 3)} AS fit_reason, {_WORDS_SQL} AS keywords, CASE WHEN id % 5 = 0 THEN first_seen END AS first_seen
FROM (SELECT *, id AS o_orderkey FROM {competitions_sql(table='customer', key='c_custkey')}))"""


#: What a made-up model says of a page: for each fact its value, its evidence and its edition, each a list and the step it is picked by.
_EDITIONS = ["2026", "", "2025", " 2026年 ", ""]
SAID = {
    "recommendation": ((["适合开发者", "", " 值得一看 "], 1), (SUBJECT, 1), (_EDITIONS, 7)),
    "identity.name": ((SUBJECT, 1), (SUBJECT, 1), (_EDITIONS, 3)),
    "identity.edition": ((["2026", "", "2025年", "第十届", ""], 3), (SUBJECT, 1), ([""], 1)),
    "identity.organizer": ((ORGANIZER, 2), (ORGANIZER, 2), (_EDITIONS, 1)),
    "facts.published_at": ((["2026-06-01", "2024年1月1日", "", "unreadable"], 1), (STATUS, 5), (["", "", "2026", "2024"], 1)),
    "facts.registration_start": ((["2026年5月1日", "", "2026年12月1日", "soon"], 3), (DATES, 3), (_EDITIONS, 1)),
    "facts.registration_end": ((["2026年7月1日", "", "2026年6月1日", "2026年7月2日"], 1), (DATES, 3), (_EDITIONS, 2)),
    "facts.competition_start": ((["2026年7月25日", "", "", "2026年8月30日"], 1), (DATES, 3), (_EDITIONS, 3)),
    "facts.competition_end": ((["2026年8月2日", "", "2026/8/3", ""], 3), (DATES, 3), (_EDITIONS, 1)),
    "facts.team_requirement": ((TEAM, 1), (TEAM, 1), (_EDITIONS, 2)),
    "facts.fee": ((FEE, 3), (FEE, 3), (_EDITIONS, 3)),
    "facts.competition_contents": ((SCOPE, 3), (SCOPE, 3), (_EDITIONS, 7)),
}
SURE = ["high", " Medium", "unsure", "low"]
#: Events of a result: type, evidence and edition, each a list and its step.
HAPPENED = [
    ((["registration_opened"], 1), (STATUS, 5), (_EDITIONS, 3)),
    ((["competition_finished", "competition_started", "competition_previewed", "registration_closed", "competition_upcoming", "problem_released", "moon_landing", "registration_announced", "rules_released"], 1), (STATUS + PROBLEM[:3], 5), (["2026", "", "2026年"], 1)),
    ((["competition_upcoming", "registration_opened", "registration_closed"], 2), (STATUS, 5), (["2026", ""], 1)),
    ((["registration_deadline_changed"], 1), (DATES, 3), (["", "2026"], 1)),
    ((["problem_released", "competition_started", "competition_previewed"], 1), (PROBLEM + STATUS, 5), (["2026"], 1)),
]


def _moved(values: list[str], times: int, every: int) -> Column:
    """Picked as the page picks it, but for every some pages, of which it is another phrase."""
    return F.when(F.pmod("o_orderkey", F.lit(every)) == 0, pick(values, times, 1)).otherwise(pick(values, times))


def _moved_sql(values: list[str], times: int, every: int) -> str:
    return f"CASE WHEN o_orderkey % {every} = 0 THEN {picked(values, times, 1)} ELSE {picked(values, times)} END"


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(pages(spark, sf_dir))


def results_of(pages: DataFrame) -> DataFrame:
    """Pages (id, title, text, url, published_at_raw) with ``raw``, the JSON of what a model says of each.

    Some say a fact as plain text, some are of another version or kind, some go on after the value.
    """
    rows = pages.withColumn("o_orderkey", F.col("id"))
    sure = pick(SURE).alias("confidence")
    bare = {f: pick(*v) for f, (v, _, _) in SAID.items()}
    full = {f: F.struct(pick(*v).alias("value"), _moved(*e, 5).alias("evidence"), pick(*ed).alias("edition"), sure) for f, (v, e, ed) in SAID.items()}
    part = lambda facts, prefix: F.struct(*(c.alias(f.removeprefix(prefix)) for f, c in facts.items() if f.startswith(prefix)))
    # a function over an array keeps all this out of whole-stage code, in which it is one method, too long to be compiled
    events = F.transform(F.array(*(F.struct(pick(*k).alias("type"), _moved(*e, 7).alias("evidence"), pick(*ed).alias("edition")) for k, e, ed in HAPPENED)), lambda x: F.struct(x["type"].alias("type"), x["evidence"].alias("evidence"), x["edition"].alias("edition"), sure))
    said = lambda facts: F.to_json(F.struct(
        F.when(F.pmod("o_orderkey", F.lit(31)) == 0, "v4").otherwise("competition-audit-v10").alias("schema_version"), F.when(F.pmod("o_orderkey", F.lit(29)) == 0, "diary").otherwise("official_announcement").alias("document_type"), F.lit("official_primary").alias("source_role"),
        F.lit(True).alias("computer_related"), F.lit(True).alias("competition_announcement"), (F.pmod(F.col("o_orderkey") * 7, F.lit(131)) - 10).alias("fit_score"),
        facts["recommendation"].alias("recommendation"), part(facts, "identity.").alias("identity"), part(facts, "facts.").alias("facts"), events.alias("events"),
    ))
    raw = F.concat(F.when(F.pmod("o_orderkey", F.lit(17)) == 0, said(bare)).otherwise(said(full)), F.when(F.pmod("o_orderkey", F.lit(53)) == 0, " {}").otherwise(""))
    return rows.select("id", "title", "text", "url", F.col("published").alias("published_at_raw"), "trust", raw.alias("raw"))


def _said_sql() -> str:
    sure = f"lower(trim({picked(SURE)}))"
    fact = lambda f, v, e, ed: f"struct_pack(field := '{f}', value := trim({picked(*v)}), evidence := CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE trim({_moved_sql(*e, 5)}) END, edition := CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE trim({picked(*ed)}) END, confidence := CASE WHEN o_orderkey % 17 <> 0 AND {sure} IN ('high', 'medium') THEN {sure} ELSE 'low' END)"
    return ", ".join(fact(f, *x) for f, x in SAID.items())


def _events_sql() -> str:
    return ", ".join(f"struct_pack(type := {picked(*k)}, evidence := trim({_moved_sql(*e, 7)}), edition := trim({picked(*ed)}))" for k, e, ed in HAPPENED)


MODEL_SQL = rf"""(SELECT id, title, text, url, published AS published_at_raw, trust, trim(regexp_replace(title || ' ' || text, '\s+', ' ', 'g')) AS body,
  CASE WHEN id % 53 = 0 THEN 'invalid json' WHEN id % 31 = 0 THEN 'unsupported ai schema version "v4"' WHEN id % 29 = 0 THEN 'invalid document_type "diary"' END AS error,
  CASE WHEN id % 53 <> 0 THEN least(100, greatest(0, id * 7 % 131 - 10)) ELSE 0 END AS fit_score, [{_said_sql()}] AS facts, [{_events_sql()}] AS events FROM {PAGES_SQL})"""


def model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules found on the same pages: a range of days on every third, another one on the others."""
    rows = pages(spark, sf_dir).withColumn("o_orderkey", F.col("id"))
    day = F.pmod("id", F.lit(3)) == 0
    at = lambda d: F.lit(f"2026-{d} 00:00:00").cast("timestamp")
    fact = F.struct(F.lit("2026年7月25日").alias("value"), F.lit("2026年7月25日").alias("raw"), F.lit("比赛时间：2026年7月25日至26日").alias("evidence"), F.lit("2026").alias("edition"), F.col("url").alias("source_url"), F.lit("high").alias("confidence"), at("06-01").alias("observed_at"))
    return rows.select(
        "id", F.col("title").alias("name"), F.lit("rules").alias("organizer"), "trust", F.lit("rules").alias("content"), (F.pmod("id", F.lit(60))).cast("int").alias("fit_score"), pick(FIT, 3).alias("fit_reason"),
        F.lit("rules").alias("team_requirement"), F.lit("rules").alias("fee"), F.lit("rules").alias("fee_evidence"), F.lit("rules").alias("eligibility_note"), F.lit("unknown").alias("registration_phase"), F.lit("unknown").alias("competition_phase"), F.lit("").alias("status"), F.lit("").alias("status_evidence"),
        *(F.lit(None).cast("timestamp").alias(c) for c in ("registration_start", "registration_end")), F.lit("").alias("registration_start_raw"), F.lit("").alias("registration_end_raw"),
        at("07-25").alias("competition_start"), F.lit("2026年7月25日").alias("competition_start_raw"), F.when(day, at("07-26")).otherwise(at("08-01")).alias("competition_end"), F.when(day, "26日").otherwise("8月1日").alias("competition_end_raw"),
        F.create_map(F.lit("competition_start"), fact).alias("facts"), (F.pmod("id", F.lit(13)) == 0).alias("problem_released"),
    )

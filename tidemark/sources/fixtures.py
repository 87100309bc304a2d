"""Driver tables as domain tables: fixed projections, each with the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scoring import Lexicon

#: The clock of the fixtures.
NOW = "1998-06-01 00:00:00"

LEXICON = Lexicon(
    focus=["retion"],
    positive=["the", "tion", "ing", "keit", "ment", "ción"],
    negative=["pills", "!!", "###"],
    closed_titles=["zzz", "|"],
    link_up=["the", "ing", "an"],
    link_down=["sch", "keit"],
    tags={"data": ["tion"], "design": ["ment", "ing"], "law": ["keit"], "math": ["ción", "ados"]},
    categories={"algorithm": ["eren"], "business": ["ouan", "verk"], "general_arts": ["thth"]},
    segment=["the", "please", "tion"],
)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Entities from ``orders``; ``shift`` moves statuses, for a later snapshot."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("day"))
    key, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    status = (
        F.when(F.col("o_orderstatus") == "O", F.when(first == "1", "upcoming").otherwise("registration_open"))
        .when(F.col("o_orderstatus") == "P", "preview")
        .otherwise(F.when(first == "2", "ongoing").when(first == "5", "unknown").otherwise("finished"))
    )
    if shift:
        status = F.when(F.pmod(key, F.lit(10)) == 0, "ongoing").otherwise(status)
    after = lambda base, days: F.col("day") + F.make_interval(days=(base + F.pmod(key, F.lit(days))).cast("int"))
    none = lambda c, m: F.when(F.pmod(key, F.lit(m)) != 0, c)
    return o.select(
        key.alias("id"),
        status.alias("status"),
        F.when(first.isin("1", "2"), "high").when(first == "3", "medium").otherwise("low").alias("trust"),
        none(F.col("day"), 11).alias("registration_start"),
        none(after(F.lit(0), 45), 7).alias("registration_end"),
        none(after(F.lit(60), 30), 5).alias("competition_start"),
        none(after(F.lit(90), 30), 3).alias("competition_end"),
        F.col("day").alias("last_seen"),
        (F.pmod(key, F.lit(13)) == shift).alias("problem_released"),
        F.concat(F.lit("cat"), F.pmod(key, F.lit(1000))).alias("category"),
    )


def _days(base: int, modulus: int) -> str:
    return f"day + to_days(CAST({base} + o_orderkey % {modulus} AS INTEGER))"


def entities_sql(shift: int = 0) -> str:
    moved = "WHEN o_orderkey % 10 = 0 THEN 'ongoing'" if shift else ""
    return f"""(SELECT o_orderkey AS id,
  CASE {moved} WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority[1] = '1' THEN 'upcoming' ELSE 'registration_open' END
    WHEN o_orderstatus = 'P' THEN 'preview'
    ELSE CASE o_orderpriority[1] WHEN '2' THEN 'ongoing' WHEN '5' THEN 'unknown' ELSE 'finished' END END AS status,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS trust,
  CASE WHEN o_orderkey % 11 <> 0 THEN day END AS registration_start,
  CASE WHEN o_orderkey % 7 <> 0 THEN {_days(0, 45)} END AS registration_end,
  CASE WHEN o_orderkey % 5 <> 0 THEN {_days(60, 30)} END AS competition_start,
  CASE WHEN o_orderkey % 3 <> 0 THEN {_days(90, 30)} END AS competition_end,
  day AS last_seen, o_orderkey % 13 = {shift} AS problem_released, 'cat' || (o_orderkey % 1000) AS category
FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders))"""


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("due_at"))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "sent").when(F.col("l_linestatus") == "O", "pending").otherwise("cancelled")
    return li.select(
        F.col("l_suppkey").alias("user_id"),
        F.col("l_orderkey").alias("competition_id"),
        F.col("l_linenumber").cast("long").alias("event_key"),
        status.alias("status"),
        (F.col("l_quantity").cast("int") % 10).alias("attempt_count"),
        "due_at",
        F.concat_ws(":", F.col("l_suppkey"), F.date_format("due_at", "yyyy-MM-dd")).alias("delivery_group"),
    )


NOTIFICATIONS_SQL = """(SELECT l_suppkey AS user_id, l_orderkey AS competition_id, CAST(l_linenumber AS BIGINT) AS event_key,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'sent' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'cancelled' END AS status,
  CAST(l_quantity AS INTEGER) % 10 AS attempt_count, CAST(l_shipdate AS TIMESTAMP) AS due_at,
  l_suppkey || ':' || strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d') AS delivery_group FROM lineitem)"""


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") > 0).alias("enabled"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision of one recipient for some entities."""
    o = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_linestatus = 'F'")
    return o.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("competition_id"), F.when(F.col("l_returnflag") == "R", "declined").otherwise("participating").alias("decision"))


CHOICES_SQL = "(SELECT l_suppkey AS user_id, l_orderkey AS competition_id, CASE WHEN l_returnflag = 'R' THEN 'declined' ELSE 'participating' END AS decision FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'F')"


def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with preferences from ``customer``."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.array(F.concat(F.lit("cat"), F.pmod(key, F.lit(1000))), F.concat(F.lit("cat"), F.pmod(key * 7, F.lit(1000)))).alias("categories"),
        F.when(key % 2 == 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey")))).otherwise(F.array().cast("array<string>")).alias("regions"),
        F.when(key % 3 == 0, "high").when(key % 3 == 1, "medium").otherwise("low").alias("min_trust"),
        (F.col("c_acctbal") > 0).alias("allow_risk"),
        F.when(key % 3 == 0, "daily").when(key % 3 == 1, "weekly").otherwise("immediate").alias("frequency"),
        (key % 24).cast("int").alias("hour"),
        (key % 7).cast("int").alias("weekday"),
        F.when(key % 3 == 0, "UTC").when(key % 3 == 1, "Asia/Shanghai").otherwise("America/New_York").alias("zone"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.text import content_hash

    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.concat(F.lit("doc/"), F.pmod("doc_id", F.lit(400))).alias("url"), content_hash(F.col("text")).alias("content_hash"), F.col("lang").alias("version"), F.pmod(F.col("doc_id") * 7919, F.lit(1000)).alias("seen_at"))


OBSERVATIONS_SQL = r"""(SELECT doc_id AS id, source AS source_id, 'doc/' || (doc_id % 400) AS url,
  sha256(trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS content_hash, lang AS version, (doc_id * 7919) % 1000 AS seen_at FROM documents)"""

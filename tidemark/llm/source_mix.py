"""Mixing sources to target weights, in DataFrame functions only.

A token budget is propagated through a tree of domain, language and source.
At each node the children share its budget by weight; a child that cannot use
its share (its tokens times ``max_epochs`` are fewer) is filled up, and what it
leaves goes to its siblings.  Only when a whole subtree is short does the rest
go to the siblings of its root, so siblings come before ancestors.  Each leaf
then takes whole documents in the order of seeded epochs while their tokens fit
the leaf's budget: an epoch is a reshuffle of all its documents by a seeded
hash, and a new one begins when the one before is used up.

Prefix sums run in two steps: sums of ``BUCKETS`` hash ranges for each leaf and
epoch, then rows of the one range in which the budget ends.  So a leaf with a
third of all rows is spread over the buckets, and no task gets a whole leaf.

Edge cases: null text has 0 tokens and null domain, language or source is '';
a weight that is missing is 1, and one of 0 or less gets nothing; ties in the
hash are broken by id, then text hash; repeated rows are separate documents; a
budget of 0 or less takes only leading documents without tokens; an empty table gives
an empty result; extra columns are kept, and columns named as a result are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import named, unpacked, whole_text, written

TREE = ("domain", "lang", "source")
#: Hash ranges of an epoch: hexadecimal digits of the hash, and so 16**3 ranges.
BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS


def word_tokens(text: str = "text") -> Column:
    """Tokens as runs of characters other than white space."""
    return F.regexp_count(whole_text(text), F.lit(r"\S+")).cast("long")


def share_out(nodes: DataFrame, parents: tuple[str, ...], name: str) -> DataFrame:
    """Add ``budget``: each child's part of ``parent_budget``.

    ``nodes`` has the columns of ``parents``, ``name``, ``weight`` and ``capacity``.  With children
    in order of capacity a weight, the level up to which all are filled is the
    greatest of (budget - capacities before) / (weights from here on).
    """
    used = nodes.where("weight > 0 and capacity > 0")
    by = [F.col(c) for c in parents] or [F.lit(0)]
    order = Window.partitionBy(*by).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = used.withColumn("_tm_level", (F.col("parent_budget") - before).cast("double") / onward.cast("double"))
    top = level.withColumn("_tm_top", F.max("_tm_level").over(Window.partitionBy(*by)))
    share = F.floor(F.col("weight").cast("double") * F.col("_tm_top")).cast("long")
    return top.withColumn("budget", F.greatest(F.lit(0), F.least("capacity", share))).drop("_tm_level", "_tm_top", "parent_budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """Rows (domain, lang, source, tokens, budget) from rows (domain, lang, source, tokens)."""
    whole = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above = None
    for depth, name in enumerate(TREE):
        parents = TREE[:depth]
        level = whole.groupBy(*TREE[: depth + 1]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        known = weights.get(name, {})
        weight = F.lit(1)
        for value, w in known.items():
            weight = F.when(F.col(name) == value, w).otherwise(weight)
        level = level.withColumn("weight", weight.cast("long"))
        if above is None:
            level = level.withColumn("parent_budget", F.lit(budget).cast("long"))
        else:
            level = level.join(above.select(*parents, F.col("budget").alias("parent_budget")), list(parents))
        above = share_out(level, parents, name)
    return above.select(*TREE, "tokens", "budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | None = None, share: float = 0.5, max_epochs: int = 3, seed: int = 17, tokens: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The selected documents with ``domain``, ``epoch``, ``n_tokens`` and ``n_tokens_before``.

    ``budget`` is in tokens; without one it is ``share`` of the corpus's tokens.
    ``n_tokens_before`` is what the leaf had taken before this document.
    """
    count = word_tokens(text) if tokens is None else tokens
    leaf = [F.coalesce(c.cast("string"), F.lit("")) for c in (domain, *(named(c) for c in TREE[1:]))]
    row = F.struct(*(named(c) for c in docs.columns)).alias("row")
    keys = [f"key_{c}" for c in TREE]
    counted = docs.select(row, named(doc_id).alias("id"), F.xxhash64(whole_text(text)).alias("version"), *(c.alias(k) for c, k in zip(leaf, keys, strict=True)), count.alias("n_tokens"))
    slim = written(counted.select("id", *keys, "n_tokens"))
    sizes = written(slim.groupBy(*(F.col(k).alias(c) for c, k in zip(TREE, keys, strict=True))).agg(F.sum("n_tokens").alias("tokens")))
    if budget is None:
        budget = math.floor((sizes.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = written(leaf_budgets(sizes, weights, budget, max_epochs)).select(*(F.col(c).alias(k) for c, k in zip(TREE, keys, strict=True)), F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"))
    epochs = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_epochs), F.greatest(F.lit(1), F.ceil(F.col("leaf_budget") / F.col("leaf_tokens")).cast("int")))))

    def dealt(rows: DataFrame) -> DataFrame:
        """Each document once for each epoch that its leaf begins, with its seeded hash."""
        many = rows.join(plan, keys).withColumn("epoch", epochs)
        hashed = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
        return many.withColumn("hash", hashed).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))

    placed = [*keys, "epoch", "bucket"]
    sums = dealt(slim).groupBy(*placed).agg(F.sum("n_tokens").alias("sum"), F.first("leaf_tokens").alias("leaf_tokens"), F.first("leaf_budget").alias("leaf_budget"))
    run = Window.partitionBy(*keys, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("epoch") - 1) * F.col("leaf_tokens") + F.coalesce(F.sum("sum").over(run), F.lit(0))
    ranges = sums.withColumn("start", start.cast("long")).where(F.col("start") <= F.col("leaf_budget"))
    ranges = written(ranges.select(*placed, "start"))

    inside = dealt(counted).join(ranges, placed)
    order = Window.partitionBy(*placed).orderBy("hash", "id", "version").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    taken = inside.withColumn("before", before.cast("long")).where(F.col("before") + F.col("n_tokens") <= F.col("leaf_budget"))
    return unpacked(taken, domain=F.col("key_domain"), epoch=F.col("epoch"), n_tokens=F.col("n_tokens"), n_tokens_before=F.col("before"))


def oracle(domain_sql: str, weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> str:
    """The same selection of ``documents`` as DuckDB SQL."""

    def weight(name: str) -> str:
        cases = "".join(f" WHEN {name} = '{v}' THEN {w}" for v, w in weights.get(name, {}).items())
        return f"CAST(CASE{cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"

    levels = []
    for depth, name in enumerate(TREE):
        group = ", ".join(TREE[: depth + 1])
        by = f"PARTITION BY {', '.join(TREE[:depth])}" if depth else ""
        above = f"JOIN share{depth} USING ({', '.join(TREE[:depth])})" if depth else "CROSS JOIN goal"
        given = f"share{depth}.budget" if depth else "goal.budget"
        levels.append(f"""
node{depth + 1} AS (
  SELECT n.*, {given} AS parent_budget FROM (
    SELECT {group}, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS capacity, CAST(sum(tokens) AS BIGINT) AS tokens, {weight(name)} AS weight
    FROM leaf GROUP BY {group}) n {above}
  WHERE weight > 0 AND capacity > 0),
level{depth + 1} AS (
  SELECT *, CAST(parent_budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fill
  FROM node{depth + 1} WINDOW w AS ({by} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {name})),
share{depth + 1} AS (
  SELECT {group}, tokens, greatest(0, least(capacity, CAST(floor(CAST(weight AS DOUBLE) * max(fill) OVER ({by})) AS BIGINT))) AS budget
  FROM level{depth + 1})""")
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce({domain_sql}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
goal AS (SELECT CAST(floor(sum(tokens) * {share!r}) AS BIGINT) AS budget FROM leaf),
{",".join(levels)},
dealt AS (
  SELECT d.*, s.budget, e.epoch, CAST((e.epoch - 1) * s.tokens + coalesce(sum(n_tokens) OVER (
      PARTITION BY domain, lang, source, e.epoch ORDER BY md5('{seed}-' || e.epoch || '-' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_tokens_before
  FROM docs d JOIN share3 s USING (domain, lang, source) CROSS JOIN (SELECT CAST(range AS INTEGER) AS epoch FROM range(1, {max_epochs + 1})) e
  WHERE e.epoch <= greatest(1, ceil(s.budget / s.tokens)))
SELECT doc_id, domain, lang, source, epoch, n_tokens, n_tokens_before FROM dealt WHERE n_tokens_before + n_tokens <= budget
"""

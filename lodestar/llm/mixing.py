"""Hierarchical budgeting of sources (operator 10). Native columns and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.session import staged, table

LEVELS = ("domain", "language", "source")

#: Target weights by level; what is not named weighs 1.
WEIGHTS: tuple[dict[str, int], ...] = (
    {"prose": 70, "table": 20, "loud": 10},
    {"en": 50, "de": 20, "es": 15, "fr": 15},
    {"src0": 2},
)


def domain_of(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!!")), "loud").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Parts of a text between blanks and line ends; none in an empty one."""
    apart = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(apart + 1).cast("long")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        out = F.when(name == key, F.lit(w)).otherwise(out)
    return out.cast("long")


def poured(nodes: DataFrame, over: list[str], name: str) -> DataFrame:
    """nodes (over, name, weight, cap, above) with `budget`: `above` shared by weight among siblings, none over its cap.

    Siblings in the order of cap per weight fill up one after another; what the full ones leave is shared by the
    weights of the others, so a shortage goes to siblings. Only what a whole family cannot hold is left, and there is
    nothing of that, as a family's budget is never over its caps. Shares are whole numbers, rounded down.
    """
    family = Window.partitionBy(*over)
    rank = family.orderBy(F.col("cap") / F.col("weight"), name)
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(19,0)")
    out = nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("weight_from", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("full", wide(F.col("cap")) * wide(F.col("weight_from")) <= wide(F.col("above") - F.col("cap_before")) * wide(F.col("weight")))
    out = out.withColumn("left", F.col("above") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)))
    out = out.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(family), F.lit(1)))
    share = F.expr("cast(cast(left as decimal(19,0)) * cast(weight as decimal(19,0)) div cast(open as decimal(19,0)) as long)")
    return out.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("cap_before", "weight_from", "full", "left", "open")


def plan(rows: DataFrame, weights: tuple[dict[str, int], ...], percent: int, epochs: int) -> DataFrame:
    """domain, language, source, size, budget, turns (whole epochs), rest (tokens of the next epoch) of every leaf.

    A leaf can give its tokens `epochs` times; a node what its leaves can. The corpus' budget is `percent` of its tokens
    and is poured from the root down.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("size"))
    for level, w in zip(LEVELS, weights, strict=True):
        leaves = leaves.withColumn(f"w_{level}", weight_of(F.col(level), w))
    # a leaf below a node of no weight can give nothing
    live = F.col("w_domain") * F.col("w_language") * F.col("w_source") > 0
    leaves = leaves.withColumn("cap", F.when(live, F.col("size") * epochs).otherwise(0))
    tops = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("size").alias("size"), F.max("w_domain").alias("weight")).withColumn("root", F.lit(0))
    total = Window.partitionBy("root")
    tops = tops.withColumn("above", F.least(F.expr(f"sum(size) over (partition by root) * {percent} div 100"), F.sum("cap").over(total)))
    tops = poured(tops.where("weight > 0"), ["root"], "domain").select("domain", F.col("budget").alias("above"))
    mids = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap"), F.max("w_language").alias("weight"))
    mids = poured(mids.where("weight > 0").join(tops, "domain"), ["domain"], "language").select("domain", "language", F.col("budget").alias("above"))
    ends = leaves.where("w_source > 0").withColumnRenamed("w_source", "weight").join(mids, ["domain", "language"])
    ends = poured(ends, ["domain", "language"], "source").where("size > 0")
    return ends.select(*LEVELS, "size", "budget", F.expr("budget div size").alias("turns"), (F.col("budget") % F.col("size")).alias("rest"))


def order_key(seed: int) -> Column:
    """The place of a document in its leaf's next epoch; those without a doc_id share one."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("turns"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def described(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), domain_of(text).alias("domain"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source"), tokens_of(text).alias("tokens")]


def quotas(docs: DataFrame, weights: tuple[dict[str, int], ...] = WEIGHTS, percent: int = 60, epochs: int = 4, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The leaves with `bound`, the last order key that the next epoch still gives, and the described rows.

    A leaf's epochs are orders of its documents by a seeded hash. Budget buys whole epochs and then a prefix of the
    next one: the longest whose tokens do not exceed the rest; documents with one key go together. A leaf may hold
    much of all rows, so its order is cut into 4096 parts by the key: sums of the parts show the one where the rest
    ends, and only the rows of that one are put in order.
    """
    rows = staged(docs.select(*described(docs)))
    leaves = staged(plan(rows, weights, percent, epochs))
    keyed = rows.join(leaves, list(LEVELS)).withColumn("key", order_key(seed)).withColumn("part", F.substring("key", 1, 3))
    parts = keyed.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    before = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("gone", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = parts.where("gone <= rest and rest < gone + n").select(*LEVELS, "part", "gone")
    inside = keyed.join(cut, [*LEVELS, "part"])
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS, "part").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", F.col("gone") + running).where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    bounds = cut.select(*LEVELS, "part").join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "part").alias("bound"))
    # written, so that Spark knows its size and broadcasts it only if it is small
    return staged(leaves.join(bounds, list(LEVELS), "left").withColumn("bound", F.coalesce("bound", F.lit("")))), rows


def copies(seed: int) -> Column:
    return (F.col("turns") + (order_key(seed) <= F.col("bound")).cast("long")).alias("copies")


def mixed(docs: DataFrame, weights: tuple[dict[str, int], ...] = WEIGHTS, percent: int = 60, epochs: int = 4, seed: int = 17) -> DataFrame:
    """doc_id, domain, language, source, tokens, copies of every document that the mix takes, once or more often.

    The text's form is its domain; a null language or source is the empty name; a null doc_id stays null, and all rows without one
    that a leaf has go together, as do repeated rows and others that tie in their order key. A null or empty text has no tokens; long ones are
    counted whole. A leaf without tokens gives nothing. An empty table gives none. Other columns are ignored, whatever their names.
    """
    leaves, rows = quotas(docs, weights, percent, epochs, seed)
    return rows.join(leaves, list(LEVELS)).withColumn("copies", copies(seed)).where("copies > 0").select("doc_id", *LEVELS, "tokens", "copies")


def remixed(docs: DataFrame, weights: tuple[dict[str, int], ...] = WEIGHTS, percent: int = 100, epochs: int = 4, seed: int = 17) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it takes them, with the columns of `docs`; nulls and ties as in mixed()."""
    leaves, _ = quotas(docs, weights, percent, epochs, seed)
    own = docs.select(F.struct(*docs.columns).alias("whole"), *described(docs))
    taken = own.join(leaves, list(LEVELS)).withColumn("copies", copies(seed)).where("copies > 0")
    return taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, language, source, tokens, copies."""
    return mixed(table(spark, sf_dir, "documents"))


def poured_sql(source: str, over: str, name: str) -> str:
    return f"""
SELECT *, CASE WHEN is_full THEN cap ELSE ((above - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {over}), 0))::HUGEINT * weight // coalesce(sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {over}), 1))::BIGINT END AS budget
FROM (SELECT *, cap::HUGEINT * weight_from <= (above - cap_before)::HUGEINT * weight AS is_full
FROM (SELECT *, coalesce(sum(cap) OVER w, 0)::BIGINT AS cap_before, (sum(weight) OVER (PARTITION BY {over}) - coalesce(sum(weight) OVER w, 0))::BIGINT AS weight_from
FROM {source} WINDOW w AS (PARTITION BY {over} ORDER BY cap::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def case_sql(name: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS language, coalesce(source, '') AS source FROM documents),
d AS (SELECT doc_id, language, source, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'loud' ELSE 'prose' END AS domain,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END::BIGINT AS tokens FROM t),
leaf AS (SELECT domain, language, source, sum(tokens)::BIGINT AS size, 4 * sum(tokens)::BIGINT AS cap, {case_sql("source", WEIGHTS[2])} AS weight FROM d GROUP BY ALL),
top0 AS (SELECT domain, sum(cap)::BIGINT AS cap, {case_sql("domain", WEIGHTS[0])} AS weight, least((sum(sum(size)) OVER () * 60 // 100), sum(sum(cap)) OVER ())::BIGINT AS above, 0 AS root FROM leaf GROUP BY domain),
top1 AS ({poured_sql("top0", "root", "domain")}),
mid0 AS (SELECT l.domain, l.language, sum(l.cap)::BIGINT AS cap, {case_sql("l.language", WEIGHTS[1])} AS weight, any_value(t.budget) AS above FROM leaf l JOIN top1 t USING (domain) GROUP BY l.domain, l.language),
mid1 AS ({poured_sql("mid0", "domain", "language")}),
end0 AS (SELECT l.domain, l.language, l.source, l.size, l.cap, l.weight, m.budget AS above FROM leaf l JOIN mid1 m USING (domain, language)),
end1 AS ({poured_sql("end0", "domain, language", "source")}),
plan AS (SELECT domain, language, source, budget // size AS turns, budget % size AS rest FROM end1 WHERE size > 0),
k AS (SELECT d.*, turns, rest, md5(concat('17:', turns, ':', coalesce(doc_id::VARCHAR, 'null'))) AS key FROM d JOIN plan USING (domain, language, source)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, language, source, tokens, (turns + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM s WHERE turns > 0 OR upto <= rest
"""

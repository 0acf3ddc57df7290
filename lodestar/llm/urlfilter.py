"""URL filters: longest rule, and a blocked Bloom filter before an exact join (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import urls
from lodestar.session import table

# fixed values: the rules, (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Hosts whose pages make up the list of URLs in the test tables, which have no list of their own.
BAD_HOSTS = r"(^|\.)(spam-farm|cheap-pills|free-bets|casino-win|ads-track)\.example\.(com|net|org)$"

WORDS = 8  # of 64 bits in a block
MOST_BLOCKS = 1 << 17


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule whose host is this one or above it and whose path begins this one; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def bits(key: Column) -> list[Column]:
    """One bit in each word of the key's block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * w).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(blocks - 1)


def bloom_filter(keys: DataFrame, bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """The blocks (block, w0 .. w7) that hold a key, and their number in all: a power of two, MOST_BLOCKS at most.

    All bits of a key lie in one block of 512. The filter is never over 10 MB, whatever the list; a longer list makes
    more false positives, which the exact join removes.
    """
    n = keys.count()
    blocks = 1
    while blocks * 64 * WORDS < n * bits_a_key and blocks < MOST_BLOCKS:
        blocks *= 2
    words = keys.select(block(F.col("canonical"), blocks).alias("block"), *(b.alias(f"w{w}") for w, b in enumerate(bits(F.col("canonical")))))
    return words.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS))), blocks


def judged(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, canonical, listed of every url.

    `listed` has a column url. A canonical URL that is in the list is listed; rules come before the list, and what
    neither names is allowed. A url that is null or has no :// has empty parts, no rule, no canonical form and is
    allowed. Nulls in the list do not matter, nor do repeats; repeated rows and null ids are judged row by row, long urls whole; rules of one
    length that both fit: the last in the order of the text; an empty table gives no rows, an empty list lists nothing; other columns
    are ignored, whatever their names.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), urls.host(url).alias("host"), urls.path(url).alias("path"), urls.canonical(url).alias("canonical"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    keys = listed.select(urls.canonical(F.col("url").cast("string")).alias("canonical")).where("canonical is not null").distinct()
    filter_, blocks = bloom_filter(keys)
    held = F.lit(True)
    for w, bit in enumerate(bits(F.col("canonical"))):
        held = held & (F.col(f"w{w}").bitwiseAND(bit) != 0)
    # at most MOST_BLOCKS rows of 72 bytes are broadcast
    probed = rows.withColumn("block", block(F.col("canonical"), blocks)).join(F.broadcast(filter_), "block", "left").withColumn("possible", F.col("canonical").isNotNull() & F.coalesce(held, F.lit(False)))
    probed = probed.select("id", "host", "path", "canonical", "rule", "possible")
    hits = probed.where("possible").join(keys.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left").select("id", "host", "path", "canonical", "rule", F.coalesce("listed", F.lit(False)).alias("listed"))
    clear = probed.where("not possible").select("id", "host", "path", "canonical", "rule", F.lit(False).alias("listed"))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return hits.unionAll(clear).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: page_id, host, path, rule, verdict; also canonical, listed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, pages.where(urls.host(F.col("url")).rlike(BAD_HOSTS)).select("url"))


OP4_SQL = f"""
WITH p AS (SELECT page_id, {urls.HOST_SQL} AS host, {urls.PATH_SQL} AS path, {urls.CANONICAL_SQL} AS canonical FROM pages),
l AS (SELECT DISTINCT canonical FROM p WHERE canonical IS NOT NULL AND regexp_matches(host, '{BAD_HOSTS}')),
r AS (SELECT p.*, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
  canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l) AS listed FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed FROM r
"""

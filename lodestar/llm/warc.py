"""Not-modified revisits resolved by an as-of join (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import urls
from lodestar.session import staged, table

# fixed values: header fields that a 304 answer may update, lower-cased
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def resolved(records: DataFrame, spans: int = 256) -> DataFrame:
    """Every revisit beside the latest earlier full response to its canonical URL.

    `records` has record_id, kind (response, revisit; other kinds don't count), url, ts (long), etag, digest (null: not
    known) and headers (a map with lower-cased names). Returns record_id, canonical, status, source_id, headers. The
    status is resolved, mismatch if a validator known on both sides differs, or orphan without an earlier response. A
    resolved revisit has the response's headers, with permitted ones replaced by its own; others have null.

    Of responses at one time the one with the larger record_id is the latest; a response at the time of the revisit is
    not earlier. A url that is null or has no :// makes an orphan, and so does a null ts. Repeated records are kept.

    A URL may hold much of all records, so each URL's time is cut into `spans` even parts: the last response is found
    within a part, and what earlier parts leave behind comes from one row per URL and part.
    """
    rows = records.select("record_id", "kind", urls.canonical(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "etag", "digest", "headers").where(F.col("kind").isin("response", "revisit"))
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, width = ends["lo"] or 0, max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // spans))
    known = rows.where("canonical is not null and ts is not null").withColumn("span", F.expr(f"(ts - {lo}L) div {width}L"))
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "digest", "headers"))
    marked = known.withColumn("response", response)
    # a response at the revisit's own time stands after it, and so is not seen
    order = [F.col("ts"), (F.col("kind") == "response").cast("int"), F.col("record_id")]
    within = Window.partitionBy("canonical", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumn("near", F.last("response", True).over(within)).where("kind = 'revisit'")
    left = marked.groupBy("canonical", "span").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.withColumn("far", F.last("end", True).over(before)).select("canonical", "span", "far").where("far is not null")
    found = seen.join(carried, ["canonical", "span"], "left").withColumn("source", F.coalesce("near", "far"))
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"source.{c}"), F.lit(False))
    status = F.when(F.col("source").isNull(), "orphan").when(differs("etag") | differs("digest"), "mismatch").otherwise("resolved")
    own = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("source.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    done = found.select("record_id", "canonical", status.alias("status"), F.col("source.record_id").alias("source_id"), F.when(status == "resolved", F.map_concat(kept, own)).alias("headers"))
    lost = rows.where("kind = 'revisit' and (canonical is null or ts is null)")
    return done.unionByName(lost.select("record_id", "canonical", F.lit("orphan").alias("status"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("source_id"), F.lit(None).cast("map<string,string>").alias("headers")))


def crawl(pages: DataFrame, lag: int = 1_000) -> DataFrame:
    """A crawl's records made of pages: each is answered in full at its page_id and, `lag` later, as not modified."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    base = pages.select("page_id", "url", tag.alias("etag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))

    def record(kind: str, at, id_, headers: dict) -> F.Column:
        pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
        return F.struct(id_.alias("record_id"), F.lit(kind).alias("kind"), F.col("url").alias("url"), at.alias("ts"), F.col("etag").alias("etag"), F.lit(None).cast("string").alias("digest"), F.create_map(*pairs).alias("headers"))

    page = F.col("page_id")
    full = record("response", page, 2 * page, {"content-length": F.col("size"), "content-type": F.lit("text/html"), "date": page.cast("string"), "etag": F.col("etag"), "server": F.lit("origin")})
    again = record("revisit", page + lag, 2 * page + 1, {"cache-control": F.lit("max-age=60"), "content-length": F.lit("0"), "date": (page + lag).cast("string"), "etag": F.col("etag"), "server": F.lit("edge")})
    return base.select(F.inline(F.array(full, again)))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, canonical, status, source_id, headers (name: value by name, joined by "; ") of every revisit."""
    records = staged(crawl(table(spark, sf_dir, "pages")))  # so that the pages are hashed once
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved(records).select("record_id", "canonical", "status", "source_id", F.array_join(lines, "; ").alias("headers"))


OP8_SQL = f"""
WITH p AS (SELECT page_id, {urls.CANONICAL_SQL} AS canonical, concat('"', md5(coalesce(html, '')), '"') AS etag, length(coalesce(html, '')) AS size FROM pages),
m AS (SELECT v.page_id, v.canonical, v.etag, s.page_id AS source, s.etag AS source_etag, s.size,
  row_number() OVER (PARTITION BY v.page_id ORDER BY s.page_id DESC NULLS LAST) AS nth
  FROM p v LEFT JOIN p s ON s.canonical = v.canonical AND s.page_id < v.page_id + 1000)
SELECT 2 * page_id + 1 AS record_id, canonical,
  CASE WHEN source IS NULL THEN 'orphan' WHEN etag <> source_etag THEN 'mismatch' ELSE 'resolved' END AS status, 2 * source AS source_id,
  CASE WHEN etag = source_etag THEN concat('cache-control: max-age=60; content-length: ', size, '; content-type: text/html; date: ', page_id + 1000, '; etag: ', etag, '; server: origin') END AS headers
FROM m WHERE nth = 1
"""

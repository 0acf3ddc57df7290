"""A corpus made ready for training: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, mixing, neardup, packing, pii
from lodestar.session import staged, table, unstage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; `lang` becomes the language found. Others go.

    Every row is judged by itself: by its text, lang and source. Rows that repeat a doc_id, or have none, are no exception. Null and empty
    texts are of no language and go; a null lang or source is no evidence; long texts are judged whole; of equally likely languages
    the first by name counts; an empty table stays empty; other columns are kept as they are.
    """
    # what a row is judged by: rows that agree in it are judged alike
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text", "lang", "source").alias("hash"))
    found = langid.identify(docs.select(key.alias("key"), "text", "lang", "source"), id_col="key", declared=F.lower("lang"), host=F.lower("source"))
    # written, so that Spark knows its size; mostly nothing changes, and that needs no shuffle of the texts
    changed = staged(found.where("not kept or not (lang <=> declared)").groupBy("key").agg(F.min("kept").alias("kept"), F.min("lang").alias("found")))
    whole = docs.select(F.struct("*").alias("whole"), key.alias("key")).join(changed, "key", "left").where("kept is null or kept")
    return whole.select(*(F.coalesce("found", "whole.lang").alias(c) if c == "lang" else F.col(f"whole.`{c}`") for c in docs.columns))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, as neardup.deduplicated() says for nulls, ties, repeats and the rest."""
    return neardup.deduplicated(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, which must be a column, follows the text. Nulls and the rest as in pii.redact()."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken once or more often, so that tokens come near the target weights; nulls and the rest as in mixing.mixed()."""
    return mixing.remixed(docs, percent=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with the token ids of every piece; nulls and the rest as in packing.pack()."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language identification", identified),
    ("near-duplicates", deduplicated),
    ("personal data", redacted),
    ("source mix", mixed),
    ("packing", packed),
]

#: The first, second, third and last stage are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        done = staged(stage(spark, docs, sf_dir))
        if before is not None:
            unstage(before)
        docs = before = done
    return STAGES[-1][1](spark, docs, sf_dir)

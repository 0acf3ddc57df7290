"""Language identification by Bayesian evidence fusion (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bytegrams
from lodestar.llm.memo import release
from lodestar.session import staged, table

BITS = 15
LANG_ATTRIBUTE = r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2,3})"""


#: ASCII letters and all bytes of longer characters stay; digits, signs and white space become blanks.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The text lower-cased, with its words parted by single blanks and stripped of ASCII digits and signs."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def declared_in(html: Column) -> Column:
    """The language that a page's markup declares, lower-cased; null if none."""
    found = F.lower(F.regexp_extract(html, LANG_ATTRIBUTE, 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def suffix_of(host: Column) -> Column:
    """What follows a host's last dot, without a port; the empty string for a name without a dot, null for none."""
    return F.when(host.isNotNull(), F.regexp_extract(host, r"\.([^.:]*)(?::[0-9]*)?$", 1))


def page_text(html: Column) -> Column:
    """A page without comments, scripts, styles, tags and entities; each leaves a blank."""
    return F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[^>]*>|&#?[a-z0-9]+;", " ")


def text_model(docs: DataFrame, sample: int) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log probabilities of byte 4-grams.

    Fitted on about `sample` rows of each declared language, those of a small hash, or on all if it has no more. A
    language whose rows show no grams has no model and is not among the names. The model takes 256 KB a language.
    """
    sizes = docs.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n"))
    # a few standard deviations more, so that chance does not leave much fewer than `sample`
    bar = sizes.select("declared", F.least(F.lit(1.0), F.lit(sample + 4 * sample**0.5) / F.col("n")).alias("share"))
    place = F.xxhash64("row", "text").bitwiseAND((1 << 52) - 1)
    # as many rows are broadcast as there are languages
    some = docs.join(F.broadcast(bar), "declared").where(place <= F.col("share") * float(1 << 52)).select("text", "declared")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            own: dict[str, list[bytes]] = {}
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(x, []).append(letters(t))
            for name, texts in own.items():
                for part in bytegrams.blocks(texts):
                    n = bytegrams.counts(texts[part], BITS)
                    total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["name", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in some.mapInArrow(count, "name string, bucket int, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["name"], np.zeros(1 << BITS, np.int64))[r["bucket"]] = r["n"]
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, 1 << BITS))
    return names, np.stack([bytegrams.log_probabilities(counts[x], 0.2, even=0.2) for x in names])


def text_evidence(docs: DataFrame, names: list[str], model: np.ndarray, temper: float) -> DataFrame:
    """Adds `evidence`, an array of log likelihoods by language and last of no language at all, and `seen`, the place of its largest.

    No language means bytes drawn evenly over the buckets. Overlapping grams repeat each other, so the sums are
    divided by `temper`. A text without letters is of no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack([model, np.full(1 << BITS, -np.log(1 << BITS))]))
    other = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [letters(t) for t in batch.column("text").to_pylist()]
            logs = np.zeros((len(texts), len(names) + 1))
            for part in bytegrams.blocks(texts):
                logs[part] = bytegrams.sums(texts[part], BITS, shared.value)[0] / temper
            for i, t in enumerate(texts):
                if not t:
                    logs[i] = [*[-1e6] * len(names), 0.0]
            best = logs.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
            flat = pa.array(logs.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (len(names) + 1)), flat)
            yield pa.record_batch([*(batch.column(c) for c in other), lists, pa.array(best.astype(np.int32))], names=[*other, "evidence", "seen"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in other), "evidence array<double>", "seen int"]))


def shares(counts: DataFrame, key: str, n: int, parent: list[Column] | Column, strength: float) -> DataFrame:
    """key, `p_<key>`: log of (count of each language + strength * parent's share) / (total + strength)."""
    total = sum((F.col(f"c{k}") for k in range(n)), F.lit(0))
    above = parent if isinstance(parent, list) else [parent[k] for k in range(n)]
    logs = F.array(*(F.log((F.col(f"c{k}") + F.lit(strength) * above[k]) / (total + F.lit(strength))) for k in range(n)))
    return counts.select(key, logs.alias(f"p_{key}"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, sample: int = 8_000, temper: float = 6.0, strength: float = 20.0, least: float = 0.5) -> DataFrame:
    """The posterior language of every row.

    Evidence: the text's byte 4-gram likelihood; the declared language and the address suffix, each as the chance of
    being seen beside a language; and the host's prior. Grouped aggregation counts, over all rows, which language the
    texts of a host, a suffix and a declared language show; a host's prior is smoothed by its suffix's, that by the
    overall one. Returns id_col, lang (null if no language is likeliest), p (its posterior), declared, kept. A row is kept
    if lang is a language and p >= `least`.

    Null and empty texts, and those of ASCII digits and signs alone, are of no language and are not kept. A null host, suffix or
    declared language is no evidence. Repeated rows and null ids are judged row by row, long texts whole; of languages that tie the first
    by name counts; an empty table gives no rows; other columns are ignored, whatever their names. The text model is
    fitted on about `sample` rows of each declared language; all other counts cover all rows. No declared language is left
    out unless its texts show no grams.
    """
    host = F.lit(None).cast("string") if host is None else host
    rows = docs.select(
        F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.lit(None).cast("string") if declared is None else declared).cast("string").alias("declared"),
        host.cast("string").alias("host"), (suffix_of(host) if suffix is None else suffix).cast("string").alias("suffix"),
    )
    names, model = text_model(rows, sample)
    n = len(names) + 1
    scored = staged(text_evidence(rows, names, model, temper))

    def counted(*keys: str) -> DataFrame:
        return scored.groupBy(*keys).agg(*(F.sum((F.col("seen") == k).cast("long")).alias(f"c{k}") for k in range(n)))

    top = counted().first()
    c = [float(top[f"c{k}"] or 0) for k in range(n)]
    overall = [F.lit((x + 1.0) / (sum(c) + n)) for x in c]
    # the tables of shares are written, so that Spark knows their size and broadcasts them only if they are small
    suffixes = staged(shares(counted("suffix").where("suffix is not null"), "suffix", n, overall, strength))
    parent = F.when(F.col("p_suffix").isNotNull(), F.transform("p_suffix", F.exp)).otherwise(F.array(*overall))
    hosts = staged(shares(counted("host", "suffix").where("host is not null").groupBy("host").agg(F.max("suffix").alias("suffix"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(n))).join(suffixes, "suffix", "left"), "host", n, parent, strength))

    def beside(key: str) -> DataFrame:
        """Log of the chance of a value of `key` given each language, up to a constant: its posterior share over the overall one."""
        p = shares(counted(key).where(F.col(key).isNotNull()), key, n, overall, strength)
        return staged(p.select(key, F.array(*(F.col(f"p_{key}")[k] - F.log(overall[k]) for k in range(n))).alias(f"p_{key}")))

    prior = F.coalesce("p_host", F.col("p_parent"), F.array(*(F.log(x) for x in overall)))
    zero = F.array(*[F.lit(0.0)] * n)
    # a known host's prior has its suffix in it already; the suffix counts by itself only without a host
    fused = (
        scored.join(hosts, "host", "left").join(suffixes.withColumnRenamed("p_suffix", "p_parent"), "suffix", "left").join(beside("declared"), "declared", "left")
        .withColumn("logs", F.zip_with(F.zip_with("evidence", prior, lambda a, b: a + b), F.coalesce("p_declared", zero), lambda a, b: a + b))
        .withColumn("peak", F.array_max("logs"))
        .withColumn("p", 1.0 / F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("peak"))), F.lit(0.0), lambda a, b: a + b))
        .withColumn("at", F.array_position("logs", F.col("peak")).cast("int"))
    )
    lang = F.element_at(F.array(*(F.lit(x) for x in names), F.lit(None).cast("string")), F.col("at"))
    return fused.select(F.col("row").alias(id_col), lang.alias("lang"), "p", "declared", (lang.isNotNull() & (F.col("p") >= least)).alias("kept"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, p, declared, kept for all documents: `lang` is the declared language and `source` the host."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, declared=F.lower("lang"), host=F.lower("source"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, lang, p, declared, kept for all pages: the text without markup, the markup's language, the address's host and its suffix."""
    pages = table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html").cast("string")).alias("text"), declared_in(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(pages, id_col="page_id", declared=F.col("declared"), host=F.nullif(F.col("host"), F.lit("")))

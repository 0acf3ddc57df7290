"""Quality rules and a hashed n-gram log-likelihood ratio (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bytegrams
from lodestar.session import bounded_sample, table

BITS = 14
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


class WordNumbers(dict):
    """A number for each word; starts anew between texts when it holds `most`."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(words: list[bytes], numbers: WordNumbers, most: int = 1 << 18) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(words) < 4:
        return 0
    if len(numbers) > most:
        numbers.clear()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(numbers) <= 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # a text with millions of different words
        _, key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)
        numbers.clear()
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(ids), bool)
    for k in range(3):
        twice[order[1:][same] + k] = True
        twice[order[:-1][same] + k] = True
    return int(twice.sum())


def base_rules(text: str, numbers: WordNumbers) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # on ASCII white space alone
    chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words, numbers)


def labelled_ids(labels: DataFrame, quality: int, most: int) -> DataFrame:
    """Up to `most` documents with this label, in the order of a hash: the bounded sample that the model is fitted on."""
    ids = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    return bounded_sample(ids, "doc_id", most)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """bucket, n, raw, over all rows: `kind` 0 rows count in raw alone, others also under their kind. One row per bucket, kind and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << BITS), np.int64)
        for batch in batches:
            texts, kinds = [t.encode() for t in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            for part in bytegrams.blocks(texts):
                total[0] += bytegrams.counts(texts[part], BITS)
            for kind in (1, 2):
                if some := [t for t, k in zip(texts, kinds, strict=True) if k == kind]:
                    for part in bytegrams.blocks(some):
                        total[kind] += bytegrams.counts(some[part], BITS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), *(pa.array(row[at]) for row in total)], names=["bucket", "n_raw", "n_good", "n_bad"])

    rows = docs.mapInArrow(count, "bucket int, n_raw long, n_good long, n_bad long")
    return rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n_raw", "n_good", "n_bad")))


def model(docs: DataFrame, labels: DataFrame, sample: int, cut: float = 0.25) -> tuple[np.ndarray, float]:
    """Weight of every bucket, log p(target) - log p(raw), and the threshold.

    The raw multinomial counts all rows. The trusted target is a sample of at most `sample` documents labelled good.
    The threshold lies a part `cut` of the way from the mean score of the grams labelled good to that of those labelled
    bad. If a label is missing or the bad score no lower, it is minus infinity: the base rules decide alone.
    """
    kinds = labelled_ids(labels, 1, sample).withColumn("kind", F.lit(1)).unionAll(labelled_ids(labels, 0, sample).withColumn("kind", F.lit(2)))
    kinds = kinds.groupBy("doc_id").agg(F.min("kind").alias("kind"))  # at most 2 x sample rows
    marked = plain(docs).join(F.broadcast(kinds), "doc_id", "left").select("text", F.coalesce("kind", F.lit(0)).alias("kind"))
    total = np.zeros((3, 1 << BITS), np.int64)
    for r in gram_counts(marked).collect():  # one row per bucket
        total[:, r["bucket"]] = r["n_raw"], r["n_good"], r["n_bad"]
    if not total[1].sum() or not total[2].sum():
        return np.zeros(1 << BITS), float("-inf")
    weights = bytegrams.log_probabilities(total[1]) - bytegrams.log_probabilities(total[0])
    good = float(weights @ total[1] / total[1].sum())
    bad = float(weights @ total[2] / total[2].sum())
    return weights, good + cut * (bad - good) if bad < good else float("-inf")


def quality(docs: DataFrame, labels: DataFrame, sample: int = 5_000, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Base counts, score and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept. The score is
    the mean over the text's hashed 4-byte grams of log p(target) / p(raw); a document is kept if the base rules
    pass and its score is not under the threshold of model(). Null texts count as empty and fail the base rules;
    repeated rows and rows without a doc_id are judged row by row; long texts whole; a score equal to the threshold is kept; an empty table gives
    no rows; other columns are ignored, whatever their names; without usable labels only the base rules decide.
    """
    weights, threshold = model(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS doubles

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rules = np.array([base_rules(t, numbers) for t in texts], np.int64).reshape(-1, 5)
            score = np.zeros(len(texts))
            texts = [t.encode() for t in texts]
            for part in bytegrams.blocks(texts):
                total, n = bytegrams.sums(texts[part], BITS, shared.value[None])
                score[part] = total[:, 0] / np.maximum(n, 1)
            failed = (rules[:, 0] < min_words) | (rules[:, 4] > max_repeat * rules[:, 0])
            cols = [batch.column(0), *(pa.array(c) for c in rules.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.record_batch(cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return plain(docs).mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; also score."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

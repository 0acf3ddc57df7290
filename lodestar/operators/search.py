"""Nearest neighbours: one query as a plain plan, many queries block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import InvalidArgument
from lodestar.functions.distance import distance, exact, literal, rough
from lodestar.session import staged

BLOCK_ROWS = 4_096
BROADCAST_BYTES = 64 << 20

HELD_ROWS = 1 << 18  # of a task's running result


def nearest(records: DataFrame, query: list[float], top_k: int, metric: str = "l2") -> DataFrame:
    """id, score of the top_k records, nearest first; records at one distance by id. Only id and embedding are read."""
    if top_k <= 0:
        raise InvalidArgument("top_k must be greater than zero")
    score = distance(metric, F.col("embedding"), literal(query))
    return records.select("id", score.alias("score")).orderBy("score", "id").limit(top_k)


def with_payload(results: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the payload to results (id, ..); a record without one has the empty string. The results were cut to top_k before."""
    return results.join(records.select("id", "payload"), "id", "left").withColumn("payload", F.coalesce("payload", F.lit("")))


def blocks(vectors: DataFrame, dimension: int, rows: int = BLOCK_ROWS, *keys: str) -> DataFrame:
    """ids (binary, 64-bit) and vectors (binary, 32-bit floats, row by row) of runs of at most `rows` vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off in range(0, batch.num_rows, rows):
                some = batch.slice(off, rows)
                ids = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                if len(values) != len(ids) * dimension:
                    raise ValueError("vector dimension does not match")
                yield pa.record_batch([pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["ids", "vectors"])

    return vectors.select("id", "embedding").mapInArrow(each, "ids binary, vectors binary")


def best_of(metric: str, q: np.ndarray, r: np.ndarray, rid: np.ndarray, top_k: int, skip: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every row of q: its place, and ids and exact scores of its top_k rows of r. `skip`: an id that doesn't count."""
    guess = rough(metric, q, r)
    if skip is not None:
        guess[skip[:, None] == rid[None, :]] = np.inf
    k = min(top_k, len(r))
    kth = np.partition(guess, k - 1, axis=1)[:, k - 1]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)) + (q * q).sum(axis=1))
    for i in range(len(q)):
        at = np.flatnonzero((guess[i] <= kth[i] + slack[i]) & (guess[i] < np.inf))
        score = exact(metric, np.broadcast_to(q[i], (len(at), q.shape[1])), r[at])
        order = np.lexsort((rid[at], score))[:k]
        yield i, rid[at][order], score[order]


def least(parts: list[tuple[np.ndarray, ...]], top_k: int) -> tuple[np.ndarray, ...]:
    """Of parts (qid, id, score) the top_k rows of each qid."""
    qid, ids, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, score, qid))
    qid = qid[order]
    at = np.arange(len(qid))
    first = np.maximum.accumulate(np.where(np.r_[True, qid[1:] != qid[:-1]], at, 0))
    keep = at - first < top_k
    return qid[keep], ids[order][keep], score[order][keep]


def nearest_join(queries: DataFrame, records: DataFrame, top_k: int, dimension: int, metric: str = "l2", excluding_self: bool = False) -> DataFrame:
    """qid, rank, id, score: the top_k records of every query, exactly.

    Both sides are packed into blocks of vectors, and each block of records meets each block of queries once: a matrix
    product finds what can be near, exact sums in element order decide. A task holds two blocks at a time, whatever
    the tables' sizes. The queries' blocks are broadcast only if they are measured to be under 64 MB; else Spark pairs
    the blocks partition by partition. A task keeps the top_k rows of each query over all blocks it sees, HELD_ROWS rows at a time,
    and passes on only these.
    """
    if top_k <= 0:
        raise InvalidArgument("top_k must be greater than zero")
    asked = staged(blocks(queries, dimension, 1_024).select(F.col("ids").alias("qids"), F.col("vectors").alias("queries")))
    size = asked.agg(F.sum(F.length("queries") + F.length("qids"))).first()[0] or 0
    held = blocks(records, dimension)
    pairs = held.crossJoin(F.broadcast(asked) if size <= BROADCAST_BYTES else asked)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                rid, qid = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
                r = np.frombuffer(row["vectors"], np.float32).reshape(len(rid), dimension).astype(float)
                q = np.frombuffer(row["queries"], np.float32).reshape(len(qid), dimension).astype(float)
                for i, ids, scores in best_of(metric, q, r, rid, top_k, qid if excluding_self else None):
                    parts.append((np.full(len(ids), qid[i]), ids, scores))
                    n += len(ids)
                if n > HELD_ROWS:
                    parts = [least(parts, top_k)]
                    n = len(parts[0][0])
                    if n > HELD_ROWS // 2:  # of very many queries
                        yield pa.record_batch([pa.array(c) for c in parts[0]], names=["qid", "id", "score"])
                        parts, n = [], 0
        if parts:
            yield pa.record_batch([pa.array(c) for c in least(parts, top_k)], names=["qid", "id", "score"])

    near = pairs.mapInArrow(each, "qid long, id long, score double")
    return ranked(near, top_k)


def ranked(near: DataFrame, top_k: int, *by: Column) -> DataFrame:
    """The top_k rows of each qid with their rank, from 1."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return near.withColumn("rank", place.cast("long")).where(F.col("rank") <= top_k).select("qid", "rank", "id", "score")

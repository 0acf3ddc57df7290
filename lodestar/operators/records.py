"""Keyed tables of records: latest version, deletion, lookup, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import InvalidArgument, IOFailure
from lodestar.functions.codecs import crc32c_of


def latest(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row per key: that of the largest order. The pick is a partial aggregate, so repeats of a hot key stay where they are."""
    whole = F.struct(*changes.columns)
    return changes.groupBy(key).agg(F.max_by(whole, order).alias("r")).select("r.*")


def merged(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records after changes (seq, op, id, embedding, payload): the last change of an id holds, a deleted id goes."""
    last = latest(changes)
    kept = records.join(last.select("id"), "id", "left_anti")
    put = last.where("op = 'put'").select("id", "embedding", F.coalesce("payload", F.lit("")).alias("payload"))
    return kept.select("id", "embedding", "payload").unionByName(put)


def upserted(records: DataFrame, batch: DataFrame) -> DataFrame:
    """Records with a batch of whole records (one per id) put over them."""
    return records.join(batch.select("id"), "id", "left_anti").unionByName(batch)


def deleted(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")


def found(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records with one of the ids."""
    return records.join(ids.select("id"), "id", "left_semi")


def wrong_dimension(records: DataFrame, dimension: int) -> DataFrame:
    return records.where(F.size("embedding") != dimension)


def check_dimension(records: DataFrame, dimension: int) -> None:
    bad = wrong_dimension(records, dimension).select(F.size("embedding").alias("n")).first()
    if bad is not None:
        raise InvalidArgument(f"vector dimension {bad['n']} does not match index dimension {dimension}")


def changed_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change of every record of `new`: insert, same (the vector, so the graph stays) or move."""
    both = new.select("id", F.col("embedding").alias("now")).join(old.select("id", F.col("embedding").alias("was")), "id", "left")
    change = F.when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("now"), "same").otherwise("move")
    return both.select("id", change.alias("change"))


def kth_last(accesses: DataFrame, key: str, at: str, k: int = 2) -> DataFrame:
    """key, last, kth, first: times of the last and k-th last access (null if there are fewer), and the first of the last k."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    near = accesses.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    kth = F.max(F.when(F.col("n") == k, F.col(at)))
    return near.groupBy(key).agg(F.max(at).alias("last_access"), kth.alias("kth_access"), F.min(at).alias("first_kept"))


def victims(accesses: DataFrame, key: str, at: str, n: int, k: int = 2) -> DataFrame:
    """The first n keys that a k-distance replacer gives up, with their place, from 1.

    Keys of fewer than k accesses come first, then those with the longest time back to the k-th last; the earlier first
    of the kept accesses breaks ties.
    """
    order: list[Column] = [F.col("kth_access").isNotNull(), F.col("kth_access"), F.col("first_kept"), F.col(key)]
    top = kth_last(accesses, key, at, k).orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def check_images(images: DataFrame, body: str, size: int, checksum: str) -> None:
    """Fails if an image is not `size` bytes long or its CRC32C is not the one in the column `checksum`; a null is a fault too."""
    sized = F.octet_length(body).eqNullSafe(size)
    bad = images.where(~(sized & F.col(checksum).eqNullSafe(crc32c_of(F.col(body).cast("binary"))))).select(sized.alias("sized")).first()
    if bad is not None:
        raise IOFailure("checksum mismatch in the page log" if bad["sized"] else "page log record of unexpected size")


def replayed(images: DataFrame, page: str, order: str, body: str | None = None, size: int = 0, checksum: str = "checksum") -> DataFrame:
    """The last image of every page, as a log replayed in order leaves it. With `body` every image is checked first."""
    if body is not None:
        check_images(images, body, size, checksum)
    return latest(images, page, order)

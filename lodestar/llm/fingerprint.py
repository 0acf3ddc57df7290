"""Closed-syncmer fingerprints (operator 6)."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestar.session import table

BLOCK = 1 << 20
PARTS = 64  # of the range of anchors
BATCH_BYTES = 1 << 22
RANGES_A_TASK = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
HALF, LOW = np.uint64(32), np.uint64((1 << 32) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit hash of each element."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` code points."""
    out = codes[: len(codes) - size + 1].copy()
    for i in range(1, size):
        out = out * np.uint64(0x100000001B3) + codes[i : len(codes) - size + 1 + i]
    return mix(out)


def syncmers(text: str, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers: k-mers whose smallest s-mer is the first or the last in them.

    Whether a k-mer is chosen depends on it alone. A text shorter than k is its own single anchor.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < k:
        return (np.zeros(1, np.int64), mix(np.array([hash_text(text)], np.uint64))) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    inner = windows(codes, s)
    n, width = len(codes) - k + 1, k - s + 1
    least = inner[:n].copy()
    for i in range(1, width):
        np.minimum(least, inner[i : n + i], out=least)
    at = np.flatnonzero((inner[:n] == least) | (inner[width - 1 :] == least))
    whole = codes[at]
    for i in range(1, k):
        whole = whole * np.uint64(0x100000001B3) + codes[at + i]
    return at, mix(whole)


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def found(text: str, k: int, s: int, keep: int = PARTS) -> np.ndarray:
    """Every anchor of the text in text order, as place * 2 ** 32 + anchor; anchors have 32 bits.

    The anchors in the lowest `keep` of the 64 parts of their range count, so that the number grows with the text;
    64 is all of them. Long texts go block by block; blocks overlap so that no k-mer is lost.
    """
    parts = []
    for start in range(0, max(1, len(text) - k + 1), BLOCK):
        at, hashed = syncmers(text[start : start + BLOCK + k - 1], k, s)
        parts.append(lowest((at + start).astype(np.uint64) << HALF | hashed >> HALF, keep))
    return np.concatenate(parts)


def lowest(keys: np.ndarray, keep: int) -> np.ndarray:
    return keys if keep >= PARTS else keys[keys & LOW < np.uint64(keep * ((1 << 32) // PARTS))]


def turned(keys: np.ndarray) -> np.ndarray:
    """With anchors before places, or back."""
    return keys >> HALF | keys << HALF


def first(keys: np.ndarray) -> np.ndarray:
    """The first occurrence of every different anchor, as anchor * 2 ** 32 + place, in order."""
    keys = np.sort(turned(keys))
    anchors = keys >> HALF
    return keys[np.concatenate([np.ones(len(keys[:1]), bool), anchors[1:] != anchors[:-1]])]


def in_text_order(keys: np.ndarray) -> np.ndarray:
    """Rows (anchor, place) of what first() gives."""
    keys = np.sort(turned(keys))
    return np.stack([keys & LOW, keys >> HALF], axis=1).astype(np.int64)


def anchored(text: str, k: int, s: int, keep: int = PARTS) -> np.ndarray:
    """Rows (anchor, place) of the text's different anchors in text order; places are of their first occurrence."""
    return in_text_order(first(found(text, k, s, keep)))


def fingerprint(text: str, k: int, s: int, keep: int = PARTS) -> list[tuple[int, int]]:
    """The rows of anchored() as a list."""
    return [(a, p) for a, p in anchored(text, k, s, keep).tolist()]


def rows_of(print_: np.ndarray | list[tuple[int, int]]) -> np.ndarray:
    return np.asarray(print_, np.int64).reshape(-1, 2)


def spelled(print_: np.ndarray | list[tuple[int, int]]) -> str:
    """anchor:place, in hexadecimal and decimal digits, parted by commas."""
    rows, out = rows_of(print_), []
    for off in range(0, len(rows), 1 << 16):
        a, p = rows[off : off + (1 << 16)].T
        tens = 10 ** np.arange(len(str(int(p.max()))) - 1, -1, -1)
        digits = np.full((len(a), 8 + 1 + len(tens) + 1), ord(","), np.uint8)
        digits[:, :8] = np.frombuffer(b"0123456789abcdef", np.uint8)[a[:, None] >> np.arange(28, -4, -4) & 15]
        digits[:, 8] = ord(":")
        digits[:, 9:-1] = p[:, None] // tens % 10 + ord("0")
        shown = np.ones(digits.shape, bool)
        shown[:, 9:-2] = p[:, None] >= tens[:-1]
        out.append(digits[shown].tobytes())
    return b"".join(out)[:-1].decode()


def in_step(a: np.ndarray) -> int:
    """Length of the longest increasing run of places, not necessarily adjacent."""
    if (a[1:] > a[:-1]).all():
        return len(a)
    tails: list[int] = []
    for x in a.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def likeness(one: np.ndarray | list[tuple[int, int]], two: np.ndarray | list[tuple[int, int]], keep: int = PARTS) -> float:
    """0 to 1: the part of the anchors of both, in the lowest `keep` of the 64 parts of their range, that both have in the same order.

    Shared anchors count only as far as their places agree in order. Two empty fingerprints are alike.
    """
    keys = (rows[:, 1].astype(np.uint64) << HALF | rows[:, 0].astype(np.uint64) for rows in (rows_of(one), rows_of(two)))
    return alike(*(first(lowest(x, keep)) for x in keys))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """likeness() of two fingerprints as first() gives them."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b >> HALF, a >> HALF), len(b) - 1)
    both = b[at] >> HALF == a >> HALF
    pairs = np.sort(a[both] << HALF | b[at[both]] & LOW)  # their places
    return in_step((pairs & LOW).astype(np.int64)) / (len(a) + len(b) - len(pairs))


def fingerprints(docs: DataFrame, k: int = 16, s: int = 10, keep: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of every whole text: all its anchors with their places. Null texts count as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, size = [], [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids.append(i)
                out.append(spelled(anchored(t or "", k, s, keep)))
                size += len(out[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.record_batch([batch.column(0).take(pa.array(ids)), pa.array(out, pa.string())], names=["id", "fingerprint"])
                    ids, out, size = [], [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "id long, fingerprint string").withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Ranges:
    """Cuts of the order by descending doc_id; positions count from its beginning.

    The range that ends at ends[i] holds the ids above ends[i - 1], the last one those above all ends. One with bits holds one id alone and is cut
    further into 2 ** bits even parts of the text's hash, those of null ids after the others.
    """

    ends: np.ndarray
    bits: np.ndarray

    def split(self, at: np.ndarray) -> np.ndarray:
        return self.bits[at] > 0

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, ids)

    def position(self, at: np.ndarray, none: np.ndarray, tie: np.ndarray) -> np.ndarray:
        width = np.where(self.bits > 0, 2 << self.bits, 1)
        bits = self.bits[at]
        part = ((tie.view(np.uint64) ^ np.uint64(1 << 63)) >> (64 - np.maximum(bits, 1)).astype(np.uint64)).astype(np.int64)
        return (width.sum() - width.cumsum())[at] + np.where(bits > 0, (none.astype(np.int64) << bits) + part, 0)


def packs(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts for the shuffle, each compressed by itself if that makes it shorter, and their sizes in bytes."""
    codec = pa.Codec("zstd", compression_level=1)
    plain = texts.cast(pa.binary()).to_pylist()
    return pa.array((min(t, codec.compress(t, asbytes=True), key=len) for t in plain), pa.binary()), pa.array(map(len, plain), pa.int64())


def unpacked(packed: bytes, size: int) -> str:
    return (packed if len(packed) == size else pa.Codec("zstd").decompress(packed, size, asbytes=True)).decode()


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, none, tie."""
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()


def heads(keys: DataFrame, ranges: Ranges) -> list[Row]:
    """position, n, below (~doc_id) and tie of the first row of every position that has rows; keys are (doc_id, none, tie)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, none, tie = columns_of(batch)
                at = ranges.position(ranges.place(ids), none, tie)
                order = np.lexsort((tie, ~ids, at))
                own, first, n = np.unique(at[order], return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(own), pa.array(n), pa.array(~ids[order][first]), pa.array(tie[order][first])], names=["position", "n", "below", "tie"])

    parts = keys.mapInArrow(each, "position long, n long, below long, tie long")
    least = parts.groupBy("position").agg(F.sum("n").alias("n"), F.min(F.struct("below", "tie")).alias("m"))
    return least.select("position", "n", "m.below", "m.tie").orderBy("position").collect()


def followed(docs: DataFrame, rows_a_range: int = 2_000, most_ranges: int = 100_000) -> DataFrame:
    """Rows (span, ghost, doc_id, none, tie, packed, size), sorted so that each document stands before the next one by descending doc_id.

    Texts are compressed by packs(), so that the shuffle, and the sort if it spills, take less disk than the table does. The table is dealt to ranges of doc_id in one shuffle. Ranges end near quantiles; quantiles are computed in doubles, so the ids at which
    ranges begin are then read from the table. The first rows of a range are also sent, as ghosts, to the range before it, the very first ones
    to the last range. Rows of one doc_id are in the order of their text's hash, and an id that fills ranges by itself is cut by that hash; only
    rows that are equal in both stay together. What goes to the driver are the ranges, a few times `most_ranges` numbers at most. A row
    without a doc_id (none) comes after all others; its doc_id reads as the least long.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(most_ranges, -(-n // rows_a_range)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], min(20 * parts, 1_000_000)).alias("cuts")).first()["cuts"] if parts > 1 else None
    ends = np.unique(np.array(cuts or [], np.int64))
    ranges = Ranges(ends, np.zeros(len(ends) + 1, np.int64))
    tie = F.xxhash64("text").alias("tie")
    first = heads(rows.select("doc_id", "none", F.lit(0).cast("long").alias("tie")), ranges)
    much = 4 * max(rows_a_range, -(-n // parts))
    if any(r["n"] > much for r in first):
        hot = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().where(F.col("count") > much // 2).collect()}
        ends = np.unique(np.array([*ends.tolist(), *hot, *(h - 1 for h in hot if h > lowest)], np.int64))
        bits = [int(4 * hot[e] // much).bit_length() if e in hot else 0 for e in ends.tolist()]
        ranges = Ranges(ends, np.array([*bits, 0], np.int64))
        if hot:
            first = heads(rows.select("doc_id", "none", tie), ranges)
    positions, head_id, head_tie = (np.array([r[c] for r in first], np.int64) for c in ("position", "below", "tie"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, none, ties = columns_of(batch)
            at = ranges.place(ids)
            span = np.searchsorted(positions, ranges.position(at, none, ties))
            alone = ranges.split(at)
            head = (~head_id[span] == ids) & (~alone | (head_tie[span] == ties))
            # of a batch's rows that may be the first of a range, only the first can be
            ghosts = np.flatnonzero(head)
            ghosts = ghosts[np.lexsort((ties[ghosts], none[ghosts], span[ghosts]))]
            ghosts = ghosts[np.unique(span[ghosts], return_index=True)[1]]
            packed, size = packs(batch.column(3))
            batch = pa.record_batch([*batch.columns[:3], packed, size], names=["doc_id", "none", "tie", "packed", "size"])
            for some, to, ghost in ((batch, span, False), (batch.take(pa.array(ghosts)), (span[ghosts] - 1) % len(positions), True)):
                if some.num_rows:
                    yield pa.record_batch([pa.array(to.astype(np.int32)), pa.array(np.full(some.num_rows, ghost)), *some.columns], names=["span", "ghost", *batch.schema.names])

    dealt = rows.select("doc_id", "none", tie, "text").mapInArrow(deal, "span int, ghost boolean, doc_id long, none boolean, tie long, packed binary, size long")
    tasks = -(-len(positions) // RANGES_A_TASK)  # more than the session's, if those would sort too much at once
    dealt = dealt.repartition(tasks, "span") if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else dealt.repartition("span")
    return dealt.sortWithinPartitions("span", "ghost", F.desc("doc_id"), "none", "tie")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def edited_anchors(own: np.ndarray, after: np.ndarray, text: str, following: str, k: int, s: int, keep: int = PARTS) -> np.ndarray:
    """found() of edited(text, following), from found() of both: only the k-mers across the seam are new."""
    changed, cut = edited(text, following), len(text) - len(text) // 3
    if len(changed) < k:
        return found(changed, k, s, keep)
    low, ends = max(0, cut - k + 1), lambda keys: (keys >> HALF) + np.uint64(k)
    seam = changed[low : cut + k - 1]
    parts = [own[: np.searchsorted(ends(own), np.uint64(cut), "right")]]
    parts += [found(seam, k, s, keep) + (np.uint64(low) << HALF)] if len(seam) >= k else []
    parts += [after[: np.searchsorted(ends(after), np.uint64(len(changed) - cut), "right")] + (np.uint64(cut) << HALF)]
    return np.concatenate(parts)


def compare_with_next(docs: DataFrame, k: int = 16, s: int = 10, keep: int = PARTS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document by descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The document
    after the last is the first, so a lone one follows itself. A null text counts as empty; a null doc_id stays null and comes last; a row
    that repeats another is a document of its own; rows that tie in doc_id are in the order of their text's hash; long texts are
    taken whole; an empty table gives no rows; other columns are ignored, whatever their names. Fingerprints are longer than
    their texts, so rows go out in batches of about BATCH_BYTES.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # span, doc_id, text, found() and first() of the row before
        out: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)

        for batch in batches:
            for span, ghost, doc, none, packed, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)), strict=True):
                doc = None if none else doc
                if last and last[0] == span:
                    text = unpacked(packed, n)
                    all_ = found(text, k, s, keep)
                    own = first(all_)
                    other = first(edited_anchors(last[3], all_, last[2], text, k, s, keep))
                    digest = hashlib.sha256(edited(last[2], text).encode()).hexdigest()
                    out.append((last[1], len(last[2]), digest, spelled(in_text_order(last[4])), spelled(in_text_order(other)), alike(last[4], other), alike(last[4], own)))
                    last = None if ghost else (span, doc, text, all_, own)
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size >= BATCH_BYTES:
                        yield made()
                        out, size = [], 0
                elif not ghost:
                    text = unpacked(packed, n)
                    all_ = found(text, k, s, keep)
                    last = (span, doc, text, all_, first(all_))
        yield made()

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return followed(docs).mapInArrow(each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compare_with_next(table(spark, sf_dir, "documents"))

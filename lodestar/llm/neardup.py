"""Near-duplicate documents by Order MinHash and banded alignment (operator 9).

1. Every text gives, in one scan, a hash of its words and `tables` sketches. A sketch is the `ordered` smallest
   occurrence-labelled 5-word shingles under its own hash function, in text order. Texts with equal words are one node.
2. Nodes that share a sketch are candidates. In each bucket the most central node, the one that meets the most others
   over all its buckets, is the pivot; all others are compared with it. That is linear in the bucket.
3. Members of buckets that then still hold several components meet those of other components by an exact prefix filter: in
   the order of rarity, two similar texts share a shingle among their first few. Texts that have only a frequent passage
   or a form in common never meet, however many they are.
4. Candidates are verified on their texts: the ordered shingle similarity by bounds or a banded alignment.
5. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.fingerprint import mix
from lodestar.llm.memo import Memo, kept
from lodestar.session import staged, table, unstage

SHINGLE = 5
TABLES, ORDERED = 20, 4
FEW = 10  # shingles up to which no link is left to chance
STEP = np.uint64(0x100000001B3)
SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


def word_memo() -> Memo:
    return kept("words", lambda: Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 60_000))


def shingles(words: list[str], memo: Memo) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle; a text without words has none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    out = h[: n - width + 1] + np.uint64(width)
    for i in range(1, width):
        out = out * STEP + h[i : n - width + 1 + i]
    return mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """The shingles told apart by occurrence: the second one of a kind differs from the first."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.ones(len(s), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return s
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(s)
    out[order] = ranked + nth.astype(np.uint64) * ODD
    return out


def sketches(s: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """One hash per table: the `ORDERED` smallest labelled shingles under that table's function, folded in text order."""
    if len(s) > ORDERED:
        step = max(1, (1 << 20) // len(s))
        parts = []
        for i in range(0, TABLES, step):
            value = (lab[None, :] ^ SEEDS[i : i + step, None]) * ODD
            parts.append(np.argpartition(value, ORDERED - 1, axis=1)[:, :ORDERED])
        at = np.sort(np.concatenate(parts), axis=1)
    else:
        at = np.tile(np.arange(len(s)), (TABLES, 1))
    out = SEEDS.copy()
    for i in range(at.shape[1]):
        out = out * STEP + s[at[:, i]]
    return mix(out)


def rarest(lab: np.ndarray, least: float) -> np.ndarray:
    """One hash for each of a short text's first labelled shingles in a fixed order, enough that similar texts share one.

    Two sets whose similarity is `least` share one of their first n - ceil(least * n) + 1 elements in any common order.
    """
    value = np.sort(mix(lab ^ ODD))
    return value[: len(lab) - math.ceil(least * len(lab) - 1e-9) + 1]


def ordered_similarity_at_least(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the longest common subsequence of two shingle sequences is `least` of their union or more.

    Shared shingles without regard to order are an upper bound, those in step by occurrence a lower one. Where they
    differ in their verdict, a banded alignment decides: its band is as wide as the edits that `least` permits.
    """
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return n == 0
    limit = int(n * (1 - least) / (1 + least) + 1e-9)
    la, lb = labelled(a), labelled(b)
    _, at_a, at_b = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    if n - 2 * len(at_a) > limit:
        return False
    places = at_b[np.argsort(at_a)]
    if len(places) == 0 or np.all(np.diff(places) > 0):
        return True
    tails: list[int] = []
    for x in places.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    if n - 2 * len(tails) <= limit:
        return True
    return edits_within(a.tolist(), b.tolist(), limit)


def edits_within(a: list, b: list, limit: int) -> bool:
    """Whether insertions and deletions, `limit` in all, turn a into b: furthest-reaching paths in a band of diagonals."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    reach = {1: 0}
    for d in range(limit + 1):
        for k in range(-d, d + 1, 2):
            if abs(n - m - k) > limit - d:
                continue  # even straight steps from here would end outside the band
            down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
            x = max(down, right)
            if x < 0:
                continue
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return True
    return False


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (a hash of the text), text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def sketched(rows: DataFrame, least: float) -> DataFrame:
    """doc_id, row, node (16-byte hash of the words), n (shingles), keys (a long per table) of keyed() rows.

    Texts of FEW shingles, and those that can be similar to one, have the hashes of rarest() among their keys too.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            node, n, keys = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text or "")
                s = shingles(words, memo)
                node.append(node_of(words))
                n.append(len(s))
                lab = labelled(s)
                own = sketches(s, lab) if len(s) else s
                keys.append((np.concatenate([own, rarest(lab, least)]) if 0 < len(s) <= FEW / least + 1e-9 else own).view(np.int64))
            yield pa.record_batch([*batch.columns[:2], pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "n", "keys"])

    return rows.mapInArrow(each, "doc_id long, row long, node binary, n long, keys array<long>")


def node_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted (node, id, row), where id is 0 for none; rows are those of keyed().

    A row counts only if its words hash to the node, so one that shares another's id and hash by chance doesn't.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [node_of(words_of(t or "")) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    found = rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).join(wanted, ["id", "row"]).select("node", "text")
    return found.mapInArrow(each, "node binary, text string").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        last, made = None, np.zeros(0, np.uint64)  # rows come in the order of b
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tb != last:
                    last, made = tb, shingles(words_of(tb or ""), memo)
                good.append(ordered_similarity_at_least(shingles(words_of(ta or ""), memo), made, least))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(each, "a binary, b binary")


def reach(x: str, y: str, least: float) -> Column:
    """The fewest shingles that texts of x and of y shingles must have in common."""
    return F.ceil((F.col(x) + F.col(y)) * (least / (1 + least)) - 1e-9)


def crossing(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members (node, n, root) of different roots that can be similar: no similar pair is missing.

    A shingle that only one root has cannot be common to two. A node's shingles are put in the order of how many members
    have them, such ones first; what two similar nodes have in common begins so early in both that enough can follow.
    Of a shingle's members, those of its largest root are not compared with each other, only with the others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            made = [labelled(shingles(words_of(t or ""), memo)).view(np.int64) for t in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], names=["node", "n", "root", "shingles"])

    own = members.join(texts, "node").select("node", "n", "root", "text").mapInArrow(each, "node binary, n long, root binary, shingles array<long>")
    own = staged(own)
    every = own.select("node", "n", "root", F.explode("shingles").alias("shingle"))
    held = every.groupBy("shingle").agg(F.count("*").alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle", "held")
    ranked = every.join(held, "shingle").groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("ranked"))
    first = F.col("n") - F.size("ranked")
    early = ranked.select("node", "n", "root", first.alias("first"), F.posexplode(F.slice("ranked", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - first).cast("int"))))
    early = staged(early.select(F.col("col.shingle").alias("shingle"), "node", "n", "root", (F.col("n") - F.col("first") - F.col("pos")).alias("left")))
    largest = early.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots"))
    few = early.join(largest.where("roots > 1").select("shingle", F.col("m.root").alias("main")), "shingle").where("root <> main")
    few = few.select("shingle", "main", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "root", "left")))
    both = few.join(early, "shingle").where("root <> root_ and (root = main or node < node_)").where(F.least("left", "left_") >= reach("n", "n_", least))
    pairs = staged(both.select(F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b")).distinct())
    unstage(own, early)
    return pairs


def grouped(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of keyed() rows: all of them as sketched() gives them, and (node, root, rep, class_id) of all nodes; root is one node of its class.

    rep is (none, id, row) of a node's first row: by whether it has no doc_id, its doc_id, its text's hash.
    """
    every = staged(sketched(rows, least))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    nodes = staged(every.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(keys.join(shared, "key"))
    central = members.groupBy("node").agg(F.sum("size").alias("c"))
    ranked = members.join(central, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("c", "node", "n")).alias("p"))
    # every member of a bucket but its pivot, beside the pivot
    led = staged(ranked.join(pivots, "key").where(F.col("node") != F.col("p.node")).select("key", "node", "n", "p"))
    fits = F.least("n", F.col("p.n")) >= least * F.greatest("n", F.col("p.n"))
    pairs = staged(led.where(fits).groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.max("p.c").alias("c")))
    ends = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = staged(texts_of(rows, ends.select("node", "rep.id", "rep.row")))

    best = pairs.groupBy("a").agg(F.max(F.struct("c", "b")).alias("p")).select("a", F.col("p.b").alias("b"))
    first = staged(verified(best, texts, least))
    star_a = first.select("a", F.col("b").alias("ra"))
    star_b = first.select(F.col("a").alias("b"), F.col("b").alias("rb"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(star_a, "a", "left").join(star_b, "b", "left")
    rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    second = staged(verified(rest, texts, least))
    roots = staged(components(first.unionAll(second)))
    # the pivot was compared with all of its bucket
    placed = led.select("key", "node", "n").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = staged(placed.join(mixed, "key").select("node", "n", "root").distinct())
    met = crossing(open_, texts, least)
    more = staged(verified(met, texts, least))
    if not more.isEmpty():
        roots = staged(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)))
    own = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep", "doc_id")
    own = staged(own)
    unstage(nodes, members, led, pairs, texts, open_, met, first, second, more, roots)
    names = own.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return every, own.join(names, "root").select("node", "root", "rep", "class_id")


def classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the documents tied to it by links of similarity `least` or more.

    One row each. Null texts count as empty; all texts without words are copies of each other. Repeated rows share a class,
    as do equal texts; rows that share a doc_id but not their words are documents of their own. A null doc_id is never the smallest: it is
    the class_id only where no document of the class has one. Long texts are taken whole. An empty table gives no rows; other columns
    are ignored, whatever their names. Two texts that tie at 0.8 always share a bucket if one has FEW shingles or less. Others
    miss each other's buckets with a chance of (1 - C(m, 4) / C(u, 4)) ** 20 for m common ones of u: 12 in 100,000 for 12 of 15,
    8 for 16 of 20, 4 for 40 of 50, 3 for long texts, less if they are more alike. Nothing else is left to chance.
    """
    every, own = grouped(keyed(docs, id_col, text_col), least)
    return every.select("doc_id", "node").join(own.select("node", "class_id"), "node").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of `docs` with one of each class, the one of the smallest doc_id; rows without a doc_id come after all others.

    Of rows with equal doc_id and text one stays. Rows that share a doc_id but not their words are different documents. Nulls, empty and
    long texts count as in classes(); an empty table stays empty; all columns are kept, whatever their names.
    """
    _, own = grouped(keyed(docs, "doc_id", "text"), least)
    stay = own.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.id", "rep.row")
    rows = docs.select(F.struct("*").alias("whole"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("row"))
    return rows.join(stay, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]).select("whole.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id of every document."""
    return classes(table(spark, sf_dir, "documents"))

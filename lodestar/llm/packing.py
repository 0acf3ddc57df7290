"""Best-fit packing of documents into fixed-length token sequences (operator 1)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.binpack import pack_histogram
from lodestar.llm.memo import Memo, kept
from lodestar.session import staged, table

END = b"\0\0\0\0"


def gathered(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ids that stand in a row, those at `at`, again in a row; and their ends, after a 0."""
    n = size[at]
    ends = np.concatenate([[0], n.cumsum()])
    return ids[np.repeat((size.cumsum() - size)[at] - ends[:-1], n) + np.arange(ends[-1])], ends


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Token ids of texts, as unsigned 32-bit numbers.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words in a row; and a
    word of plain letters with signs after it is two units to its merge model. Texts go together: their different words and
    these words' different units are found by Arrow, and only units are looked up, in a memo of fixed size; all other words go
    through the whole tokenizer, with a memo of their own.
    """

    LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")

    def __init__(self, path: str, words: int = 20_000, units: int = 120_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.units = Memo(self.word, words), Memo(self.unit, units)
        whole = self.tokenizer.pre_tokenizer.pre_tokenize_str  # spells bytes as characters
        self.spelled = {i: whole(chr(i))[0][0] for i in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}

    def unit(self, unit: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(unit if unit.isascii() else unit.translate(self.spelled))] if unit else []
        return pack_ids(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        letters, signs = pc.utf8_rtrim(words, self.SIGNS), pc.utf8_ltrim(words, self.LETTERS)
        plain = pc.match_substring_regex(letters, rf"\A[{self.LETTERS}]+\z")
        units = pc.if_else(plain, pc.utf8_lower(letters), None).dictionary_encode()
        after = pc.if_else(plain, signs, "").dictionary_encode()
        rest = words.filter(pc.invert(plain))
        runs = [*map(self.units.__getitem__, strings(units.dictionary)), *map(self.units.__getitem__, strings(after.dictionary)), *map(self.words.__getitem__, strings(rest))]
        first = units.indices.fill_null(0).to_numpy().astype(np.int64)
        first[~plain.to_numpy(zero_copy_only=False)] = np.arange(len(runs) - len(rest), len(runs))
        at = np.stack([first, after.indices.to_numpy() + len(units.dictionary)], axis=1).ravel()
        ids, ends = gathered(np.frombuffer(b"".join(runs), "<u4"), np.fromiter(map(len, runs), np.int64, len(runs)) // 4, at)
        return ids, np.diff(ends[::2])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last; null texts have none."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        ids, ends = gathered(*self.different(words.dictionary), words.indices.to_numpy())
        return ids, ends[np.concatenate([[0], split.value_lengths().to_numpy().cumsum()])]

    def text(self, text: str) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0].tobytes()


def word_ids(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return kept(f"tokenizer {path}", lambda: WordIds(path))


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, part, nth (, ids).

    `part` is the task that made the piece and `nth` counts its pieces of that length, from 0; both become the rank
    of a piece among all of its length without any sort of the pieces.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for off in range(0, batch.num_rows, 256):
                some = batch.slice(off, 256)
                cols: list[list] = [[] for _ in names]
                tokens, bounds = words.texts(some.column(1))
                for doc, lo, hi in zip(some.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = memoryview(tokens[lo:hi].tobytes() + END)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        row = (doc, k, at // 4, n, zlib.crc32(own), part, seen[n], own.tobytes() if with_ids else None)
                        seen[n] += 1
                        for col, x in zip(cols, row, strict=False):
                            col.append(x)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], schema=schema)
        pa.default_memory_pool().release_unused()  # other stages' workers stand beside this one

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, ddl)


def layout(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, in order of rank: the first rank of each run, its first bin, items a bin, and place in the bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for filling, times in patterns:
        place = 0
        for x, n in filling:
            at = ranks.get(x, 0)
            runs.setdefault(x, []).append((at, first, n, place))
            ranks[x] = at + n * times
            place += n * x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in runs.items()}


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", work: int = 12_000_000) -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as bin completion finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with `with_ids`, ids (binary,
    little-endian unsigned 32-bit). A document's ids end in 0; only longer ones are cut. A null or empty text is the
    lone id 0. Repeated rows, null and repeated ids are packed row by row; an empty table gives no rows; other columns are ignored, whatever
    their names. Pieces of one length tie; any order of them packs as well. `work` bounds the search in the driver.

    The text is read once. What goes to the driver is the histogram of lengths and what comes back is the layout of
    the patterns: both are bounded by `capacity`, whatever the corpus.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, tokenizer, with_ids, id_col, text_col))
    per_part = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(layout(pack_histogram(hist, capacity, work).patterns))
    ranked = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *["ids"] * with_ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                x = int(length[own[0]])
                at, first, n, base = runs.value[x]
                run = np.searchsorted(at, rank[own], "right") - 1
                nth = rank[own] - at[run]
                seq[own] = first[run] + nth // n[run]
                off[own] = base[run] + nth % n[run] * x
            cols = [*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off), *(batch.column(i) for i in range(6, batch.num_columns))]
            yield pa.record_batch(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, ddl)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)

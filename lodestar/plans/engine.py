"""The engine: named indexes of vectors with payloads in one database folder.

An index is a base table of records and a few tables of later changes. Reading merges them, so a put or delete costs
what it brings, not what the index holds; after `MOST_DELTAS` changes they are folded into a new base. All
tables are immutable; the manifest says which ones count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.errors import AlreadyExists, InvalidArgument, NotFound
from lodestar.operators import graph, records, search
from lodestar.options import CHANGES, EDGES, NODES, RECORDS, IndexOptions, ReadOptions, SearchOptions, WriteOptions
from lodestar.session import staged, unstage
from lodestar.sources.store import Store

MOST_DELTAS = 8


def signed(id_: int) -> int:
    """Ids are unsigned; those of 2^63 and more are kept as negative longs."""
    if not 0 <= id_ < 1 << 64:
        if -(1 << 63) <= id_ < 0:
            return id_
        raise InvalidArgument("id does not fit 64 bits")
    return id_ - (1 << 64) if id_ >= 1 << 63 else id_


class Engine:
    """A change is durable once its call has returned; `write` and `read` options are taken and change nothing."""

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False):
        self.spark = spark
        self.store = Store(spark, path, create_if_missing, error_if_exists)

    # catalog

    def create_index(self, name: str, options: IndexOptions) -> None:
        if not name:
            raise InvalidArgument("index name must not be empty")
        options.check()
        if name in self.store.indexes:
            raise AlreadyExists(f"index already exists: {name}")
        self._commit(name, {"options": options.as_row(), "base": None, "deltas": [], "graph": None, "batch": None})

    def drop_index(self, name: str) -> None:
        self._entry(name)
        self.store.commit({k: v for k, v in self.store.indexes.items() if k != name})

    def has_index(self, name: str) -> bool:
        return name in self.store.indexes

    def list_indexes(self) -> list[str]:
        return sorted(self.store.indexes, key=lambda n: n.encode())

    def catalog(self) -> DataFrame:
        """index_name, dimension, metric, max_degree, ef_construction, allow_replace_deleted."""
        rows = [(n, *(self.store.indexes[n]["options"][k] for k in ("dimension", "metric", "max_degree", "ef_construction", "allow_replace_deleted"))) for n in self.list_indexes()]
        return self.spark.createDataFrame(rows, "index_name string, dimension int, metric string, max_degree int, ef_construction int, allow_replace_deleted boolean")

    def options(self, name: str) -> IndexOptions:
        return IndexOptions(**self._entry(name)["options"])

    # records

    def records(self, name: str) -> DataFrame:
        """id, embedding, payload of all records. A filter on id reaches the files."""
        entry = self._entry(name)
        base = self.store.read(entry["base"], RECORDS) if entry["base"] else self.spark.createDataFrame([], RECORDS)
        if not entry["deltas"]:
            return base
        changes = self.store.read(entry["deltas"][0], CHANGES)
        for delta in entry["deltas"][1:]:
            changes = changes.unionByName(self.store.read(delta, CHANGES))
        return records.merged(base, changes)

    def load(self, name: str, rows: DataFrame) -> None:
        """Replaces all records by rows (id, embedding, payload), one per id; of repeated ids one stays."""
        options = self.options(name)
        rows = self._shaped(rows)
        records.check_dimension(rows, options.dimension)
        base = self.store.write(rows.dropDuplicates(["id"]), "id")
        self._commit(name, {**self._entry(name), "base": base, "deltas": [], "graph": None})

    def apply(self, name: str, changes: DataFrame, batch: str | None = None) -> None:
        """Puts and deletes (seq, op, id, embedding, payload): the last one of an id holds. A batch that was the last to
        be applied is not applied again; deleting an id that is not there does nothing."""
        entry = self._entry(name)
        if batch is not None and entry["batch"] == batch:
            return
        options = self.options(name)
        changes = changes.select("seq", "op", "id", F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
        records.check_dimension(changes.where("op = 'put'"), options.dimension)
        step = len(entry["deltas"]) + 1
        path = self.store.write(records.latest(changes).withColumn("seq", F.lit(step).cast("long")), "id")
        made = self._graph_after(name, path) if entry["graph"] else None
        entry = {**entry, "deltas": [*entry["deltas"], path], "graph": made, "batch": batch or entry["batch"]}
        self._commit(name, entry)
        if len(entry["deltas"]) > MOST_DELTAS:
            self.compact(name)

    def _graph_after(self, name: str, delta: str) -> dict | None:
        """What a change leaves of the graph: all of it if only payloads are new, one to be grown if there are new ids, none if
        vectors moved or went."""
        new = self.store.read(delta, CHANGES)
        if not new.where("op <> 'put'").isEmpty():
            return None
        kinds = {r["change"] for r in records.changed_vectors(self.records(name), new).select("change").distinct().collect()}
        made = self._entry(name)["graph"]
        return None if "move" in kinds else {**made, "grown": True} if "insert" in kinds else made

    def compact(self, name: str) -> None:
        entry = self._entry(name)
        if entry["deltas"]:
            self._commit(name, {**entry, "base": self.store.write(self.records(name), "id"), "deltas": []})

    def put_many(self, name: str, rows: DataFrame, write: WriteOptions | None = None) -> None:
        self._entry(name)
        self.apply(name, self._shaped(rows).select(F.lit(0).cast("long").alias("seq"), F.lit("put").alias("op"), "id", "embedding", "payload"))

    def put(self, name: str, id_: int, embedding: list[float], payload: str = "", write: WriteOptions | None = None) -> None:
        """One record; a put without payload clears it."""
        options = self.options(name)
        if len(embedding) != options.dimension:
            raise InvalidArgument(f"vector dimension {len(embedding)} does not match index dimension {options.dimension}")
        self.put_many(name, self.spark.createDataFrame([(signed(id_), [float(np.float32(x)) for x in embedding], payload)], RECORDS))

    def delete(self, name: str, id_: int, write: WriteOptions | None = None) -> None:
        self.get(name, id_)
        self.delete_many(name, self.spark.createDataFrame([(signed(id_),)], "id long"))

    def delete_many(self, name: str, ids: DataFrame, write: WriteOptions | None = None) -> None:
        """Deletes the records with these ids, as far as there are any."""
        self.apply(name, ids.select(F.lit(0).cast("long").alias("seq"), F.lit("delete").alias("op"), F.col("id").cast("long").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("payload")))

    def get(self, name: str, id_: int, read: ReadOptions | None = None) -> tuple[int, list[float], str]:
        row = self.records(name).where(F.col("id") == signed(id_)).first()
        if row is None:
            raise NotFound("vector id not found")
        return id_, list(row["embedding"]), row["payload"] or ""

    def get_many(self, name: str, ids: DataFrame, read: ReadOptions | None = None) -> DataFrame:
        return records.found(self.records(name), ids)

    # search

    def search(self, name: str, query: list[float], options: SearchOptions | None = None, read: ReadOptions | None = None) -> DataFrame:
        """id, score (and payload), nearest first."""
        options = (options or SearchOptions()).check()
        index = self.options(name)
        if len(query) != index.dimension:
            raise InvalidArgument(f"query dimension {len(query)} does not match index dimension {index.dimension}")
        held = self.records(name)
        if options.mode == "graph":
            asked = self.spark.createDataFrame([(0, [float(np.float32(x)) for x in query])], "qid long, embedding array<float>")
            found = self.search_many(name, asked, options).select("id", "score")
        else:
            found = search.nearest(held, query, options.top_k, index.metric)
        if options.include_payload:
            # top_k rows at most on this side
            found = held.select("id", "payload").join(F.broadcast(found), "id", "right").select("id", "score", F.coalesce("payload", F.lit("")).alias("payload"))
        return found.orderBy("score", "id")

    def search_many(self, name: str, queries: DataFrame, options: SearchOptions | None = None, read: ReadOptions | None = None) -> DataFrame:
        """qid, rank, id, score for queries (qid, embedding)."""
        options = (options or SearchOptions()).check()
        index = self.options(name)
        records.check_dimension(queries, index.dimension)
        held = self.records(name)
        if options.mode == "graph":
            nodes, edges = self.graph(name)
            return graph.search(queries, nodes, edges, held, index.metric, options.top_k, options.ef_search)
        return search.nearest_join(queries.select(F.col("qid").alias("id"), "embedding"), held, options.top_k, index.dimension, index.metric)

    def build_graph(self, name: str) -> None:
        """Makes the neighbour graph of the records as they are; a change of vectors makes it stale, new records are inserted."""
        index = self.options(name)
        self._keep_graph(name, *graph.build(self.records(name), index.dimension, index.metric, index.max_degree, index.ef_construction))

    def _grow_graph(self, name: str) -> None:
        """Inserts the records that are not nodes yet; where they are over a quarter of all, the graph is made anew."""
        index, made, held = self.options(name), self._entry(name)["graph"], self.records(name)
        nodes, edges = self.store.read(made["nodes"], NODES), self.store.read(made["edges"], EDGES)
        added = staged(held.select("id", "embedding").join(nodes.select("id"), "id", "left_anti"))
        if 4 * added.count() > held.count():
            self.build_graph(name)
        else:
            self._keep_graph(name, *graph.inserted(nodes, edges, held, added, index.dimension, index.metric, index.max_degree, index.ef_construction))
        unstage(added)

    def _keep_graph(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        self._commit(name, {**self._entry(name), "graph": {"nodes": self.store.write(nodes), "edges": self.store.write(edges, "src")}})

    def graph(self, name: str) -> tuple[DataFrame, DataFrame]:
        """nodes and edges of the present vectors; made or grown first if need be."""
        made = self._entry(name)["graph"]
        if made is None:
            self.build_graph(name)
        elif made.get("grown"):
            self._grow_graph(name)
        made = self._entry(name)["graph"]
        return self.store.read(made["nodes"], NODES), self.store.read(made["edges"], EDGES)

    def stats(self, name: str) -> dict[str, int]:
        """dimension, size, deleted_count, graph_edges (0 while there is no graph), memory_bytes."""
        edges = self.graph(name)[1] if self._entry(name)["graph"] else None
        return graph.stats(self.records(name).select("id"), edges, self.options(name).dimension).first().asDict()

    # helpers

    def _entry(self, name: str) -> dict:
        if name not in self.store.indexes:
            raise NotFound(f"index not found: {name}")
        return self.store.indexes[name]

    def _commit(self, name: str, entry: dict) -> None:
        self.store.commit({**self.store.indexes, name: entry})

    def _shaped(self, rows: DataFrame) -> DataFrame:
        payload = F.coalesce(F.col("payload").cast("string"), F.lit("")) if "payload" in rows.columns else F.lit("")
        return rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), payload.alias("payload"))

"""Registered queries of the engine's own operators, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import codecs
from lodestar.functions.distance import distance, literal
from lodestar.functions.resp import encoded
from lodestar.operators import graph, records, search
from lodestar.options import IndexOptions, SearchOptions
from lodestar.plans.commands import Commands
from lodestar.plans.engine import Engine
from lodestar.session import shared_dir, staged, table
from lodestar.streaming import mutations

DIM = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("label "), "label").alias("payload"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of joins: every vector whose id is divisible by 20."""
    return vectors(spark, sf_dir).where("id % 20 = 0")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def knn_search(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(search.nearest(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, metric))

    return run


def knn_join(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(search.nearest_join(asked(spark, sf_dir), vectors(spark, sf_dir), 10, DIM, metric))

    return run


def knn_excluding_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.nearest_join(asked(spark, sf_dir), vectors(spark, sf_dir), 8, DIM, excluding_self=True))


def knn_payload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    return rounded(search.with_payload(search.nearest(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, "cosine"), docs))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three distances of every vector to the first one."""
    q = literal(first_vector(spark, sf_dir))
    return vectors(spark, sf_dir).select("id", *(F.round(distance(m, F.col("embedding"), q, checked=True), 6).alias(m) for m in ("l2", "ip", "cosine")))


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id = 7").select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "payload")


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose id is also a document's with the label toxic."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return records.found(vectors(spark, sf_dir), ids).select("id", "payload")


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as records of several indexes, one per label."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("ix"), "label").alias("index_name"), F.col("vec_id").alias("id"), "embedding")


def list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes(spark, sf_dir).select("index_name").distinct().orderBy("index_name")


def has_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = indexes(spark, sf_dir).select("index_name").distinct().withColumn("has", F.lit(True))
    wanted = spark.createDataFrame([("ix3",), ("IX3",), ("missing",)], "index_name string")
    return wanted.join(names, "index_name", "left").select("index_name", F.coalesce("has", F.lit(False)).alias("has"))


def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = indexes(spark, sf_dir).select(codecs.record_key(F.col("index_name"), F.col("id")).alias("record_key"))
    return keys.where(F.col("record_key").startswith("record:ix1:"))


def key_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes(spark, sf_dir).select("id", codecs.encode_id(F.col("id")).alias("id_text"), codecs.encode_id(-F.col("id") - 1).alias("high_id_text"), codecs.record_key(F.col("index_name"), F.col("id")).alias("record_key"))


def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the wrong dimension, after every 7th has lost its last element."""
    cut = vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("id") % 7 == 0, F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding")))
    return records.wrong_dimension(cut, DIM).select("id", F.size("embedding").cast("long").alias("dimension"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of puts: new ids, the same vectors, and vectors turned round, by id."""
    v = vectors(spark, sf_dir)
    return v.select((F.col("id") + F.when(F.col("id") % 3 == 0, 1_000_000).otherwise(0)).alias("id"), F.when(F.col("id") % 3 == 2, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"), F.lit("new").alias("payload"))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.upserted(vectors(spark, sf_dir), moved(spark, sf_dir))
    return out.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "payload")


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.changed_vectors(vectors(spark, sf_dir), moved(spark, sf_dir))


def delete_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return records.deleted(vectors(spark, sf_dir), gone).select("id", "payload")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: one record per user; an error deletes it."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), F.array(F.col("value").cast("float")).alias("embedding"), F.col("event_type").alias("payload"))


def changelog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "id long, embedding array<float>, payload string")
    return records.merged(empty, log(spark, sf_dir)).select("id", "payload")


def changelog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log put through a stream into an index: the index's records when it has ended."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log(spark, sf_dir).write.parquet(f"{folder}/log")
    engine = Engine(spark, f"{folder}/db")
    engine.create_index("users", IndexOptions(1))
    mutations.start(engine, "users", mutations.change_log(spark, f"{folder}/log"), f"{folder}/checkpoint").awaitTermination()
    return engine.records("users").select("id", "payload")


def lru_k_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.kth_last(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "last_access", "kth_access")


def lru_k_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.victims(table(spark, sf_dir, "events"), "user_id", "event_id", 10).select("place", "user_id", "kth_access")


def log_last_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last image of each page in a log where users are pages."""
    return records.replayed(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "props")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(vectors(spark, sf_dir), None, DIM)


def stats_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes(spark, sf_dir).groupBy("index_name").agg(F.count("*").alias("size")).withColumn("memory_bytes", F.col("size") * 24 + 4096)


def level_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_of(vectors(spark, sf_dir))


def graph_entry_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entry_point(graph.nodes_of(vectors(spark, sf_dir)))


def near_edges(spark: SparkSession, sf_dir: str, top_k: int = 8) -> DataFrame:
    """layer 0 edges to each vector's nearest others, exactly."""
    v = vectors(spark, sf_dir)
    near = search.nearest_join(v, v, top_k, DIM, excluding_self=True)
    return staged(near.select(F.lit(0).alias("layer"), F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("score").alias("distance")))


def knn_graph_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.linked(near_edges(spark, sf_dir)).select("src", "dst")


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges of every node, in and out."""
    e = near_edges(spark, sf_dir).select("src", "dst")
    return e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("dst", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes two steps from each query that are not reached in one, and not itself."""
    e = near_edges(spark, sf_dir).select("src", "dst")
    start = asked(spark, sf_dir).select(F.col("id").alias("qid"))
    one = start.join(e, F.col("qid") == F.col("src")).select("qid", F.col("dst").alias("id"))
    two = one.join(e, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id")).distinct()
    seen = one.unionAll(start.select("qid", F.col("qid").alias("id")))
    return two.join(seen, ["qid", "id"], "left_anti")


def greedy_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each node the nearest neighbour by an edge."""
    near = near_edges(spark, sf_dir)
    return near.groupBy("src").agg(F.min(F.struct("distance", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"), F.round("m.distance", 6).alias("score"))


def diverse_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's diverse neighbours, 4 of its 8 near ones."""
    return graph.selected(near_edges(spark, sf_dir), vectors(spark, sf_dir), 4, "l2").select("src", "dst", F.round("distance", 6).alias("score"))


def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of every layer of the graph."""
    nodes, edges = graph.build(vectors(spark, sf_dir), DIM, "l2", 16, 64)
    per_layer = nodes.select(F.explode(F.sequence(F.lit(0), "level")).alias("layer")).groupBy("layer").agg(F.count("*").alias("nodes"))
    return per_layer.join(edges.groupBy("layer").agg(F.count("*").alias("edges")), "layer", "left").select("layer", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam search of the graph for the query set."""
    v = vectors(spark, sf_dir)
    nodes, edges = (staged(x) for x in graph.build(v, DIM, "l2", 16, 64))
    return rounded(graph.search(asked(spark, sf_dir).select(F.col("id").alias("qid"), "embedding"), nodes, edges, v, "l2", 10, 50))


def texts(spark: SparkSession, sf_dir: str, elements: int) -> DataFrame:
    """The first elements of vectors as text, some of them spoilt in one way or another."""
    parts = F.array_join(F.transform(F.slice("embedding", 1, elements), lambda x: F.round(x.cast("double"), 4).cast("decimal(10,4)").cast("string")), ", ")
    spoilt = F.when(F.col("vec_id") % 5 == 0, F.concat(parts, F.lit(","))).when(F.col("vec_id") % 5 == 1, F.concat(F.lit("x"), parts)).when(F.col("vec_id") % 25 == 2, F.lit("")).otherwise(F.concat(F.lit(" "), parts, F.lit(" ")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), spoilt.alias("csv"))


def parsed(rows: DataFrame) -> DataFrame:
    v = codecs.parse_vector_csv(F.col("csv"))
    return rows.select("id", v.isNotNull().alias("valid"), F.size(v).cast("long").alias("dimension"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total")).withColumn("dimension", F.when(F.col("valid"), F.col("dimension")).otherwise(-1))


def csv_vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of the vectors, spelled and parsed again."""
    return parsed(texts(spark, sf_dir, DIM))


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned numbers and floats of texts that are sound, signed, blank, too large or too small by turns."""
    forms = ["{}", "+{}", " {}", "{} ", "", "99999999999999999999{}", "1844674407370955161{}", "-{}", "000000000000000000000{}", "{}.5", "{}f", "1e4{}", "1e-6{}"]
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    text = F.regexp_replace(form, r"\{\}", (F.col("event_id") % 10).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", "text", codecs.parse_uint64(F.col("text")).cast("string").alias("number"), codecs.parse_float(F.col("text")).isNotNull().alias("is_float"))


def metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l2", "L2", "ip", "Inner_Product", "INNERPRODUCT", "cosine", "cos", "", "L2 "]
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("name"))
    return rows.select("event_id", "name", codecs.parse_metric(F.col("name")).alias("metric"), codecs.upper_ascii(F.col("name")).alias("upper_name"))


def split_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of command lines made from conversations, each with the whole text of its turn."""
    line = F.concat(F.lit("  VPUT\t"), "role", F.lit(" \t "), F.col("turn").cast("string"), F.lit("  "), "text")
    parts = codecs.split_inline(F.regexp_replace(line, "[\r\n]", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(parts).cast("long").alias("n_args"), parts[0].alias("command"), parts[1].alias("index_name"), F.element_at(parts, -1).alias("last_arg"))


def float_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six significant digits of every element of each vector, plain and scaled; place counts from 0."""
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("place", "x"))
    return x.select("id", "place", codecs.format_float(F.col("x")).alias("plain"), codecs.format_float((F.col("x") * 1e9).cast("float")).alias("large"))


def payload_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum of the payloads that knn_payload_join attaches: the whole texts of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", codecs.crc32c_of(F.col("text").cast("binary")).alias("crc"))


def command_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to a session of commands on a fresh database."""
    commands = Commands(Engine(spark, f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"))
    lines = ["PING", "VCREATE docs 3 COSINE 8 32", "VCREATE docs 3 L2", "VPUT docs 1 1,0,0 alpha", "VPUT docs 2 0.9,0.1,0 beta", "VPUT docs 3 1,x", "VSEARCH docs 1,0,0 2 16 WITHPAYLOADS", "VGET docs 2", "VDEL docs 2", "VDEL docs 2", "VSTATS docs", "VLIST", "VDROP docs", "VHASINDEX docs", "NOPE"]
    return spark.createDataFrame([(i, x, encoded(commands.execute(x.split())).decode()) for i, x in enumerate(lines)], "step long, command string, reply string")


def engine_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors loaded into an index, changed by a batch, reopened and searched."""
    path = f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
    engine = Engine(spark, path)
    engine.create_index("v", IndexOptions(DIM, "cosine"))
    engine.load("v", vectors(spark, sf_dir))
    engine.put_many("v", moved(spark, sf_dir))
    engine.delete_many("v", table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id")))
    return rounded(Engine(spark, path).search("v", first_vector(spark, sf_dir), SearchOptions(10, include_payload=True)))


QUERIES = {
    **{f"knn_search_{m}": knn_search(m) for m in ("l2", "ip", "cosine")},
    **{f"knn_join_{m}": knn_join(m) for m in ("l2", "ip", "cosine")},
    **{f.__name__: f for f in (
        knn_excluding_self, knn_payload_join, distances, full_scan, get_by_id, multi_get, list_indexes, has_index, prefix_scan, key_encoding,
        dimension_check, upsert, upsert_changes, delete_anti_join, changelog_replay, changelog_stream, lru_k_distance, lru_k_victims,
        log_last_image, index_stats, stats_by_index, level_sampling, graph_entry_point, knn_graph_undirected, graph_degrees, neighbour_expansion,
        greedy_step, diverse_neighbours, graph_build, graph_search, csv_vector_parse, number_parse, metric_parse, split_inline,
        float_format, payload_crc32c, command_session, engine_round_trip,
    )},
}

# SQL

A, B = "a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]"
L2 = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({A}, {B}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda s, v: s + v)"
DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({}, {}), lambda p: p[1] * p[2])), lambda s, v: s + v)"
IP = f"-({DOT.format(A, B)})"
COSINE = f"CASE WHEN {DOT.format(A, A)} = 0 OR {DOT.format(B, B)} = 0 THEN 1.0 ELSE 1 - {DOT.format(A, B)} / sqrt({DOT.format(A, A)} * {DOT.format(B, B)}) END"
SCORES = {"l2": L2, "ip": IP, "cosine": COSINE}


def search_sql(score: str) -> str:
    return f"SELECT a.vec_id AS id, round({score}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {score}, a.vec_id LIMIT 10"


def join_sql(score: str, k: int, more: str = "TRUE") -> str:
    return f"""WITH d AS (SELECT b.vec_id AS qid, a.vec_id AS id, {score} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND {more}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM d)
SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


NEAR = f"""d AS (SELECT b.vec_id AS src, a.vec_id AS dst, {L2} AS distance FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
near AS (SELECT src, dst, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM d) WHERE n <= 8)"""
LOG = "SELECT user_id AS id, arg_max(event_type, event_id) AS payload FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"
INDEXES = "(SELECT concat('ix', label) AS index_name, vec_id AS id, embedding FROM embeddings)"
TOTAL = "round(list_reduce(list_prepend(0.0::DOUBLE, embedding::DOUBLE[]), lambda s, x: s + x), 6) AS total"
MOVED = "SELECT vec_id + CASE WHEN vec_id % 3 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN vec_id % 3 = 2 THEN list_reverse(embedding) ELSE embedding END AS embedding, 'new' AS payload, label FROM embeddings"
HASH = "('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT"
LEVEL = "(" + " + ".join(f"CASE WHEN {HASH} % {1 << i} = 0 THEN 1 ELSE 0 END" for i in range(1, 33)) + ")"
FORMS = "['{}', '+{}', ' {}', '{} ', '', '99999999999999999999{}', '1844674407370955161{}', '-{}', '000000000000000000000{}', '{}.5', '{}f', '1e4{}', '1e-6{}']"

ORACLES = {
    **{f"knn_search_{m}": search_sql(s) for m, s in SCORES.items()},
    **{f"knn_join_{m}": join_sql(s, 10) for m, s in SCORES.items()},
    "knn_excluding_self": join_sql(L2, 8, "a.vec_id <> b.vec_id"),
    "knn_payload_join": f"SELECT k.id, k.score, coalesce(t.text, '') AS payload FROM ({search_sql(COSINE)}) k LEFT JOIN documents t ON t.doc_id = k.id",
    "distances": f"SELECT a.vec_id AS id, round({L2}, 6) AS l2, round({IP}, 6) AS ip, round({COSINE}, 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b",
    "full_scan": f"SELECT vec_id AS id, {TOTAL} FROM embeddings",
    "get_by_id": f"SELECT vec_id AS id, {TOTAL}, concat('label ', label) AS payload FROM embeddings WHERE vec_id = 7",
    "multi_get": "SELECT vec_id AS id, concat('label ', label) AS payload FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "list_indexes": f"SELECT DISTINCT index_name FROM {INDEXES}",
    "has_index": f"SELECT index_name, index_name IN (SELECT index_name FROM {INDEXES}) AS has FROM (VALUES ('ix3'), ('IX3'), ('missing')) t(index_name)",
    "prefix_scan": f"SELECT concat('record:', index_name, ':', lpad(id::VARCHAR, 20, '0')) AS record_key FROM {INDEXES} WHERE index_name = 'ix1'",
    "key_encoding": f"SELECT id, lpad(id::VARCHAR, 20, '0') AS id_text, (18446744073709551615::HUGEINT - id)::VARCHAR AS high_id_text, concat('record:', index_name, ':', lpad(id::VARCHAR, 20, '0')) AS record_key FROM {INDEXES}",
    "dimension_check": "SELECT vec_id AS id, 63::BIGINT AS dimension FROM embeddings WHERE vec_id % 7 = 0",
    "upsert": f"WITH m AS ({MOVED}) SELECT vec_id AS id, {TOTAL}, concat('label ', label) AS payload FROM embeddings WHERE vec_id NOT IN (SELECT id FROM m) UNION ALL SELECT id, {TOTAL}, payload FROM m",
    "upsert_changes": f"WITH m AS ({MOVED}) SELECT m.id, CASE WHEN e.vec_id IS NULL THEN 'insert' WHEN e.embedding = m.embedding THEN 'same' ELSE 'move' END AS change FROM m LEFT JOIN embeddings e ON e.vec_id = m.id",
    "delete_anti_join": "SELECT vec_id AS id, concat('label ', label) AS payload FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings d WHERE d.label = 3 AND d.vec_id = e.vec_id)",
    "changelog_replay": LOG,
    "changelog_stream": LOG,
    "lru_k_distance": "SELECT user_id, max(event_id) AS last_access, max(event_id) FILTER (n = 2) AS kth_access FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 2 GROUP BY user_id",
    "lru_k_victims": """WITH k AS (SELECT user_id, max(event_id) FILTER (n = 2) AS kth_access, min(event_id) AS first_kept FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 2 GROUP BY user_id),
p AS (SELECT *, row_number() OVER (ORDER BY kth_access IS NOT NULL, kth_access NULLS FIRST, first_kept, user_id) AS place FROM k) SELECT place, user_id, kth_access FROM p WHERE place <= 10""",
    "log_last_image": "SELECT user_id, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id",
    "index_stats": "SELECT 64::BIGINT AS dimension, count(*) AS size, 0::BIGINT AS deleted_count, 0::BIGINT AS graph_edges, count(*) * 24 + 4096 AS memory_bytes FROM embeddings",
    "stats_by_index": f"SELECT index_name, count(*) AS size, count(*) * 24 + 4096 AS memory_bytes FROM {INDEXES} GROUP BY index_name",
    "level_sampling": f"SELECT vec_id AS id, ({LEVEL})::INTEGER AS level FROM embeddings",
    "graph_entry_point": f"SELECT vec_id AS id, ({LEVEL})::INTEGER AS level FROM embeddings ORDER BY 2 DESC, 1 LIMIT 1",
    "knn_graph_undirected": f"WITH {NEAR} SELECT src, dst FROM near UNION SELECT dst, src FROM near",
    "graph_degrees": f"WITH {NEAR}, e AS (SELECT src AS id, 1 AS o, 0 AS i FROM near UNION ALL SELECT dst, 0, 1 FROM near) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM e GROUP BY id",
    "neighbour_expansion": f"""WITH {NEAR}, one AS (SELECT src AS qid, dst AS id FROM near WHERE src % 20 = 0)
SELECT DISTINCT one.qid, near.dst AS id FROM one JOIN near ON near.src = one.id WHERE near.dst <> one.qid AND NOT EXISTS (SELECT 1 FROM one o WHERE o.qid = one.qid AND o.id = near.dst)""",
    "greedy_step": f"WITH {NEAR} SELECT src, arg_min(dst, (distance, dst)) AS dst, round(min(distance), 6) AS score FROM near GROUP BY src",
    # a candidate is barred by the kept ones that it is nearer to than to the source; barred ones fill up
    "diverse_neighbours": f"""WITH RECURSIVE {NEAR}, c AS (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM near),
bars AS (SELECT c.src, c.n, list(k.n) AS ns FROM c JOIN c k ON k.src = c.src AND k.n < c.n JOIN d ON d.src = c.dst AND d.dst = k.dst WHERE d.distance < c.distance GROUP BY c.src, c.n),
walk AS (SELECT DISTINCT src, 0::BIGINT AS n, []::BIGINT[] AS kept FROM c UNION ALL
SELECT w.src, c.n, CASE WHEN len(w.kept) < 4 AND NOT list_has_any(w.kept, coalesce(b.ns, []::BIGINT[])) THEN list_append(w.kept, c.n) ELSE w.kept END FROM walk w JOIN c ON c.src = w.src AND c.n = w.n + 1 LEFT JOIN bars b ON b.src = c.src AND b.n = c.n),
ends AS (SELECT src, arg_max(kept, n) AS kept FROM walk GROUP BY src),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.src ORDER BY NOT list_contains(e.kept, c.n), c.n) AS place FROM c JOIN ends e ON e.src = c.src)
SELECT src, dst, round(distance, 6) AS score FROM r WHERE place <= 4""",
    "float_format": "SELECT id, place - 1 AS place, printf('%.6g', x::DOUBLE) AS plain, printf('%.6g', ((x * 1e9)::FLOAT)::DOUBLE) AS large FROM (SELECT vec_id AS id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1))::INTEGER AS place FROM embeddings)",
    # byte by byte over the table of the reversed polynomial
    "payload_crc32c": f"""WITH b AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor({codecs.CRC_TABLE}[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) END AS crc FROM b""",
    # ~ stands for the end of a line of the protocol
    "command_session": """WITH s AS (SELECT printf('%.6g', 1 - x / sqrt(x * x + y * y)) AS score FROM (SELECT 0.9::FLOAT::DOUBLE AS x, 0.1::FLOAT::DOUBLE AS y)),
t(step, command, reply) AS (VALUES (0, 'PING', '+PONG~'), (1, 'VCREATE docs 3 COSINE 8 32', '+OK~'), (2, 'VCREATE docs 3 L2', '-ERR index already exists: docs~'),
(3, 'VPUT docs 1 1,0,0 alpha', '+OK~'), (4, 'VPUT docs 2 0.9,0.1,0 beta', '+OK~'), (5, 'VPUT docs 3 1,x', '-ERR invalid vector~'),
(6, 'VSEARCH docs 1,0,0 2 16 WITHPAYLOADS', (SELECT concat('*2~*3~:1~$1~0~$5~alpha~*3~:2~$', length(score), '~', score, '~$4~beta~') FROM s)),
(7, 'VGET docs 2', '*3~:2~*3~$3~0.9~$3~0.1~$1~0~$4~beta~'), (8, 'VDEL docs 2', ':1~'), (9, 'VDEL docs 2', '-ERR vector id not found~'),
(10, 'VSTATS docs', '*10~$9~dimension~$1~3~$4~size~$1~1~$13~deleted_count~$1~0~$11~graph_edges~$1~0~$12~memory_bytes~$4~4120~'),
(11, 'VLIST', '*1~$4~docs~'), (12, 'VDROP docs', '+OK~'), (13, 'VHASINDEX docs', ':0~'), (14, 'NOPE', '-ERR unknown command~'))
SELECT step::BIGINT AS step, command, replace(reply, '~', concat(chr(13), chr(10))) AS reply FROM t""",
    "csv_vector_parse": """WITH t AS (SELECT vec_id AS id, vec_id % 5 >= 2 AS valid, vec_id % 25 = 2 AS blank, [round(x::DOUBLE, 4)::DECIMAL(10,4)::VARCHAR::FLOAT::DOUBLE FOR x IN embedding] AS v FROM embeddings)
SELECT id, valid, CASE WHEN valid THEN CASE WHEN blank THEN 0 ELSE len(v) END ELSE -1 END::BIGINT AS dimension, CASE WHEN valid THEN CASE WHEN blank THEN 0.0 ELSE round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda s, x: s + x), 4) END END::DOUBLE AS total FROM t""",
    "number_parse": f"""WITH t AS (SELECT event_id, event_id % 13 AS f, replace({FORMS}[event_id % 13 + 1], '{{}}', (event_id % 10)::VARCHAR) AS text FROM events)
SELECT event_id, text, CASE WHEN regexp_full_match(text, '[0-9]+') AND try_cast(text AS HUGEINT) <= 18446744073709551615::HUGEINT THEN try_cast(text AS HUGEINT)::VARCHAR END AS number,
f IN (0, 1, 2, 5, 6, 7, 8, 9) AS is_float FROM t""",
    "metric_parse": """WITH t AS (SELECT event_id, ['l2', 'L2', 'ip', 'Inner_Product', 'INNERPRODUCT', 'cosine', 'cos', '', 'L2 '][event_id % 9 + 1] AS name FROM events)
SELECT event_id, name, CASE upper(name) WHEN 'L2' THEN 'l2' WHEN 'IP' THEN 'ip' WHEN 'INNER_PRODUCT' THEN 'ip' WHEN 'INNERPRODUCT' THEN 'ip' WHEN 'COSINE' THEN 'cosine' END AS metric, upper(name) AS upper_name FROM t""",
    "split_inline": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(concat('  VPUT', chr(9), role, ' ', chr(9), ' ', turn, '  ', text), '[\r\n]', ' ', 'g'), '[^ \t]+') AS parts FROM conversations)
SELECT conv_id, turn, len(parts)::BIGINT AS n_args, parts[1] AS command, parts[2] AS index_name, parts[-1] AS last_arg FROM t""",
    "engine_round_trip": f"""WITH m AS ({MOVED}), u AS (SELECT vec_id, embedding, concat('label ', label) AS payload, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM m) UNION ALL SELECT id, embedding, payload, -1 FROM m),
a AS (SELECT * FROM u WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3))
SELECT a.vec_id AS id, round({COSINE}, 6) AS score, a.payload FROM a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {COSINE}, a.vec_id LIMIT 10""",
}

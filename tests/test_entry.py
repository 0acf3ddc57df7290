import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar import queries as own

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 10


@needs_data
@pytest.mark.parametrize("name", ["knn_search_ip", "knn_join_cosine", "knn_excluding_self", "upsert", "changelog_replay", "number_parse", "csv_vector_parse", "lru_k_victims", "level_sampling", "diverse_neighbours", "float_format", "payload_crc32c", "command_session", "get_by_id"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = own.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({own.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = own.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({own.ORACLES[name]})").fetchall()
    rows = [r.asDict() for r in got.collect()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in cols)) for r in rows)
    return rows


@needs_data
def test_split_inline_of_whole_turns(spark):
    rows = against_sql(spark, "split_inline")
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    plain = {k: ["VPUT", "?", "?", *re.findall("[^ \t\r\n]+", t)] for k, t in texts.items()}
    assert len(rows) == len(texts) and all(r["n_args"] == len(plain[r["conv_id"], r["turn"]]) for r in rows)


@needs_data
def test_whole_vectors_and_payloads(spark):
    from lodestar.functions import codecs

    rows = against_sql(spark, "csv_vector_parse")
    assert {r["dimension"] for r in rows} == {-1, 0, 64}
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {(r["id"], r["place"]): r["plain"] for r in own.QUERIES["float_format"](spark, SF).collect()}
    assert got == {(i, k): codecs.float_text(x) for i, v in vectors.items() for k, x in enumerate(v)}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    crcs = dict(own.QUERIES["payload_crc32c"](spark, SF).collect())
    assert crcs == {i: codecs.crc32c(t.encode()) for i, t in texts.items()}


def test_every_sql_has_its_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_imports_without_the_optional_parts(tmp_path):
    """The engine and the entry work where the subpackage for training data and the pipeline are gone."""
    for name in ("lodestar", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lodestar" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)

import random

import numpy as np
import pytest

from lodestar import cli
from lodestar.errors import AlreadyExists, InvalidArgument, IOFailure, NotFound
from lodestar.functions.resp import Failure, Simple
from lodestar.operators import graph
from lodestar.options import CHANGES, IndexOptions, SearchOptions
from lodestar.plans.commands import Commands
from lodestar.plans.engine import Engine
from lodestar.streaming import mutations


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "db")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_empty_index_and_invalid_arguments(spark, path):
    e = Engine(spark, path)
    with pytest.raises(InvalidArgument):
        e.create_index("", IndexOptions(2))
    with pytest.raises(InvalidArgument):
        e.create_index("x", IndexOptions(0))
    e.create_index("v", IndexOptions(2))
    assert ids(e.search("v", [0, 0], SearchOptions(3))) == []
    with pytest.raises(AlreadyExists):
        e.create_index("v", IndexOptions(2))
    for call in (lambda: e.put("v", 1, [1.0]), lambda: e.search("v", [1.0]), lambda: e.search("v", [1, 2], SearchOptions(0)), lambda: e.put("v", 1 << 64, [1, 2])):
        with pytest.raises(InvalidArgument):
            call()
    for call in (lambda: e.delete("v", 999), lambda: e.drop_index("missing"), lambda: e.get("missing", 1), lambda: e.search("missing", [1, 2]), lambda: e.stats("missing"), lambda: e.delete("missing", 1)):
        with pytest.raises(NotFound):
            call()


def test_open_policies(spark, path):
    with pytest.raises(NotFound):
        Engine(spark, path, create_if_missing=False)
    Engine(spark, path)
    Engine(spark, path, create_if_missing=False)
    with pytest.raises(AlreadyExists):
        Engine(spark, path, error_if_exists=True)


def test_two_writers(spark, path):
    a = Engine(spark, path)
    b = Engine(spark, path)
    a.create_index("x", IndexOptions(2))
    with pytest.raises(IOFailure):
        b.create_index("y", IndexOptions(2))
    b.store.refresh()
    b.create_index("y", IndexOptions(2))
    assert b.list_indexes() == ["x", "y"]


def test_recovery_update_and_drop(spark, path):
    e = Engine(spark, path)
    e.create_index("v", IndexOptions(2))
    e.put("v", 1, [0, 0], "v1")
    e.put("v", 2, [1, 1], "v2")
    e = Engine(spark, path)
    first = e.search("v", [0.05, 0.05], SearchOptions(2, 8, True)).collect()
    assert [(r["id"], r["payload"]) for r in first] == [(1, "v1"), (2, "v2")]
    e.put("v", 1, [2, 2], "v1-new")
    e = Engine(spark, path)
    assert e.search("v", [2.1, 2.1], SearchOptions(1, include_payload=True)).first()["payload"] == "v1-new"
    assert e.get("v", 1) == (1, [2, 2], "v1-new")
    e.put("v", 2, [1, 1])
    assert e.get("v", 2)[2] == ""
    big = (1 << 64) - 1
    e.put("v", big, [9, 9])
    assert e.get("v", big)[0] == big
    e.drop_index("v")
    assert not e.has_index("v") and e.store.vacuum() > 0
    e.create_index("v", IndexOptions(2))
    assert e.records("v").count() == 0


def test_batches_and_compaction(spark, path):
    e = Engine(spark, path)
    e.create_index("v", IndexOptions(1))
    e.load("v", spark.createDataFrame([(i, [float(i)], "old") for i in range(6)], "id long, embedding array<float>, payload string"))
    for k in range(10):
        e.put_many("v", spark.createDataFrame([(k % 3, [10.0 + k])], "id long, embedding array<float>"))
    assert len(e.store.indexes["v"]["deltas"]) <= 8
    got = {r["id"]: r["embedding"][0] for r in e.records("v").collect()}
    assert got == {0: 19, 1: 17, 2: 18, 3: 3, 4: 4, 5: 5}
    e.delete_many("v", spark.createDataFrame([(3,), (77,)], "id long"))
    assert sorted(ids(e.get_many("v", spark.createDataFrame([(3,), (4,), (5,)], "id long")))) == [4, 5]
    with pytest.raises(InvalidArgument):
        e.put_many("v", spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>"))
    assert e.stats("v") == {"dimension": 1, "size": 5, "deleted_count": 0, "graph_edges": 0, "memory_bytes": 5 * 24 + 4096}
    assert e.catalog().first()["metric"] == "l2"


def test_random_operations_against_a_model(spark, path):
    rng = random.Random(123456)
    e, model = Engine(spark, path), {}
    e.create_index("v", IndexOptions(2))
    for step in range(40):
        op = rng.randrange(10)
        id_ = rng.randint(1, 12)
        if op < 5:
            x = [float(np.float32(rng.uniform(-5, 5))) for _ in range(2)]
            e.put("v", id_, x, f"p{id_}_{step}")
            model[id_] = (x, f"p{id_}_{step}")
        elif op < 7:
            if id_ in model:
                e.delete("v", id_)
                del model[id_]
            else:
                with pytest.raises(NotFound):
                    e.delete("v", id_)
        elif op == 7:
            e = Engine(spark, path)
        else:
            q = [float(np.float32(rng.uniform(-5, 5))) for _ in range(2)]
            want = sorted(model, key=lambda i: (sum((a - b) ** 2 for a, b in zip(model[i][0], q)), i))[:3]
            got = e.search("v", q, SearchOptions(3, 16, True)).collect()
            assert [r["id"] for r in got] == want
            assert [r["payload"] for r in got] == [model[i][1] for i in want]


def test_graph_mode(spark, path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 6)).astype(np.float32))]
    e = Engine(spark, path)
    e.create_index("v", IndexOptions(6, "l2", 8, 32))
    e.load("v", spark.createDataFrame(rows, "id long, embedding array<float>"))
    nodes, edges = e.graph("v")
    made = edges.collect()
    degree = {}
    for r in made:
        degree[r["layer"], r["src"]] = degree.get((r["layer"], r["src"]), 0) + 1
        assert r["src"] != r["dst"]
    assert max(degree.values()) <= 8 and len({(r["layer"], r["src"], r["dst"]) for r in made}) == len(made)
    assert e.stats("v")["graph_edges"] == len(made)
    q = spark.createDataFrame(rows[:10], "qid long, embedding array<float>")
    near = {(r["qid"], r["id"]) for r in e.search_many("v", q, SearchOptions(5, 40, mode="graph")).collect()}
    exact = {(r["qid"], r["id"]) for r in e.search_many("v", q, SearchOptions(5)).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    e.put_many("v", spark.createDataFrame(rows[:1], "id long, embedding array<float>"))
    assert e.store.indexes["v"]["graph"] is not None  # the vector is the same
    old = {(r["layer"], r["src"]) for r in made}
    more = [(1_000 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(12, 6)).astype(np.float32))]
    e.put_many("v", spark.createDataFrame(more, "id long, embedding array<float>"))
    assert e.store.indexes["v"]["graph"]["grown"]
    grown = e.graph("v")[1].collect()
    assert "grown" not in e.store.indexes["v"]["graph"] and e.stats("v")["graph_edges"] == len(grown)
    lists = {}
    for r in grown:
        lists.setdefault((r["layer"], r["src"]), set()).add(r["dst"])
    assert max(map(len, lists.values())) <= 8 and old < set(lists) and {r["id"] for r in e.graph("v")[0].collect()} == {i for i, _ in rows + more}
    for key in old:  # a node that no new one names keeps its edges
        before = {r["dst"] for r in made if (r["layer"], r["src"]) == key}
        assert lists[key] == before or any(key[1] in lists[key[0], i] for i, _ in more if (key[0], i) in lists)
    vectors = dict(rows + more)
    for i, v in more:  # the new ones' diverse neighbours, recomputed; back links may have been pruned, or added to them
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in vectors.items() if j != i)[:32]
        want = graph.diverse(np.array([vectors[j] for _, j in order]), np.array(v), "l2", 8)
        assert len(lists[0, i] & {order[k][1] for k in want}) >= 6
    near = [r["id"] for r in e.search_many("v", spark.createDataFrame(more, "qid long, embedding array<float>"), SearchOptions(1, 40, mode="graph")).orderBy("qid").collect()]
    assert near == [i for i, _ in more]
    e.put("v", 0, [0.0] * 6)
    assert e.store.indexes["v"]["graph"] is None


def test_stream_of_changes(spark, path, tmp_path):
    e = Engine(spark, path)
    e.create_index("v", IndexOptions(1))
    log = str(tmp_path / "log")
    rows = [(1, "put", 1, [1.0], "a"), (2, "put", 2, [2.0], "b"), (3, "put", 1, [3.0], "c"), (4, "delete", 2, None, None)]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(log)
    mutations.start(e, "v", mutations.change_log(spark, log), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in e.records("v").collect()] == [(1, [3.0], "c")]
    spark.createDataFrame([(5, "put", 2, [5.0], "d")], CHANGES).coalesce(1).write.mode("append").parquet(log)
    mutations.start(e, "v", mutations.change_log(spark, log), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in e.records("v").collect()) == [1, 2]
    before = e.store.version
    e.apply("v", spark.createDataFrame([], CHANGES), e.store.indexes["v"]["batch"])  # run again after a failure
    assert e.store.version == before


def test_commands(spark, path):
    c = Commands(Engine(spark, path))
    run = lambda line: c.execute(line.split())
    assert run("ping") == Simple("PONG") and run("PING x y") == "x" and run("echo") == Failure("ERR wrong number of arguments for 'echo' command")
    assert c.execute([]) == Failure("ERR empty command") and run("nope") == Failure("ERR unknown command")
    assert len(run("HELLO")) == 14 and "db_path" in run("INFO") and run("COMMAND DOCS") == [] and run("CLIENT x") == Simple("OK")
    for line, why in (("VCREATE d", "usage"), ("VCREATE d 0 L2", "dimension"), ("VCREATE d 3 X", "metric"), ("VCREATE d 3 L2 x", "max_degree"), ("VCREATE d 3 L2 1 x", "ef_construction")):
        assert why in run(line).text
    assert run("VCREATE docs 3 cosine 8 32") == Simple("OK")
    assert run("VPUT docs 1 1,0,0 alpha") == run("VPUT docs 2 0.9,0.1,0 beta") == Simple("OK")
    for line, why in (("VPUT docs x 1,0,0", "invalid id"), ("VPUT docs 1 1,", "invalid vector"), ("VSEARCH docs 1,0,0 0", "top_k"), ("VSEARCH docs 1,0,0 1 x", "ef_search"), ("VSEARCH docs 1,0,0 1 5 x", "WITHPAYLOADS"), ("VGET docs 9", "not found"), ("VSTATS no", "index not found: no")):
        assert why in run(line).text
    assert run("VSEARCH docs 1,0,0 2 16 withpayloads") == [[1, "0", "alpha"], [2, "0.00611627", "beta"]]
    assert run("VSEARCH docs 1,0,0 1 WITHPAYLOADS") == [[1, "0", "alpha"]] and run("VSEARCH docs 1,0,0 1") == [[1, "0"]]
    assert run("VGET docs 2") == [2, ["0.9", "0.1", "0"], "beta"]
    assert run("VDEL docs 2") == 1 and run("VHASINDEX docs") == 1 and run("VLIST") == ["docs"]
    assert run("VSTATS docs") == ["dimension", "3", "size", "1", "deleted_count", "0", "graph_edges", "0", "memory_bytes", "4120"]
    assert run("VDROP docs") == Simple("OK") and run("VHASINDEX docs") == 0
    assert run("QUIT") == Simple("OK") and c.closed


def test_command_line(spark, path, capsys):
    def said(*words):
        code = cli.main(["--path", path, *words])
        return code, capsys.readouterr().out.strip()

    assert cli.main(["--path", path]) == 1 and "usage" in capsys.readouterr().out
    assert said("VCREATE", "docs", "2", "L2") == (0, "OK")
    assert said("VPUT", "docs", "7", "1,0", "alpha")[0] == 0
    code, text = said("VSEARCH", "docs", "1,0", "1", "WITHPAYLOADS")
    assert code == 0 and "7" in text and "alpha" in text
    code, text = said("NOPE")
    assert code == 1 and "unknown command" in text.lower()

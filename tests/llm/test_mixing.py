import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing
from tests.llm.helpers import AWKWARD, frame, prose


def plain_pour(budget, children):
    """children: name -> (weight, cap). Full ones are found one after another by exact fractions."""
    out, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if cap * total <= left * w]
        if not full:
            return out | {n: left * w // total for n, (w, _) in open_.items()}
        first = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
        out[first] = open_[first][1]
        left -= open_.pop(first)[1]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pouring_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    families, rows = {}, []
    for f in range(12):
        children = {f"c{i}": (rng.randint(1, 9), rng.choice([0, rng.randint(1, 500), 10**12])) for i in range(rng.randint(1, 8))}
        above = rng.randint(0, min(3000, sum(c for _, c in children.values())))
        families[f"f{f}"] = (above, children)
        rows += [(f"f{f}", n, w, c, above) for n, (w, c) in children.items()]
    got = mixing.poured(spark.createDataFrame(rows, "f string, name string, weight long, cap long, above long"), ["f"], "name").collect()
    for r in got:
        above, children = families[r["f"]]
        assert r["budget"] == plain_pour(above, children)[r["name"]] <= r["cap"]


def plain_mix(rows, percent, epochs, seed, weights):
    leaf = {}
    for _, d, lang, s, n in rows:
        leaf[d, lang, s] = leaf.get((d, lang, s), 0) + n
    w = lambda level, name: weights[level].get(name, 1)
    cap = lambda p: sum(n * epochs for k, n in leaf.items() if k[: len(p)] == p and all(w(i, x) > 0 for i, x in enumerate(k)))
    shares = {(): min(sum(leaf.values()) * percent // 100, cap(()))}
    for depth in range(3):
        for parent in [p for p in shares if len(p) == depth]:
            names = {k[depth] for k in leaf if k[:depth] == parent and w(depth, k[depth]) > 0}
            for n, b in plain_pour(shares[parent], {n: (w(depth, n), cap((*parent, n))) for n in names}).items():
                shares[(*parent, n)] = b
    out = {}
    for k, size in leaf.items():
        if size and k in shares:
            turns, rest = divmod(shares[k], size)
            own = sorted((hashlib.md5(f"{seed}:{turns}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[4], r[0]) for r in rows if r[1:4] == k)
            total = 0
            for key in sorted({x[0] for x in own}):
                group = [x for x in own if x[0] == key]
                total += sum(x[1] for x in group)
                for _, _, doc in group:
                    if turns + (total <= rest):
                        out[doc] = turns + (total <= rest)
    return out


@pytest.mark.parametrize("percent", [0, 1, 60, 100, 1000])
def test_mix_against_a_plain_version(spark, percent):
    rng = random.Random(percent)
    forms = [lambda t: t, lambda t: t.replace(" ", " | "), lambda t: t + "!!"]
    texts = [rng.choice(forms)(prose(rng, rng.randint(1, 40))) for _ in range(400)] + [None, "", " ", "x" * 20_000]
    langs = [rng.choice(["en", "en", "en", "de", "xx", None]) for _ in texts]
    sources = [rng.choice(["src0"] * 6 + ["src1", "src2", None]) for _ in texts]  # one leaf holds most rows
    weights = ({"prose": 70, "table": 20, "loud": 10}, {"en": 50, "xx": 0}, {"src0": 2, "src2": 0})
    docs = frame(spark, texts, "weight cap key part size domain tokens", lang=langs, source=sources)
    rows = [tuple(r) for r in docs.select(*mixing.described(docs)).collect()]
    got = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs, weights, percent, 3, 5).collect()}
    assert got == plain_mix(rows, percent, 3, 5, weights)


def test_described_columns(spark):
    docs = frame(spark, [None, "", "a", "a b\nc", " ", "a | b", "x!!"])
    got = [(r["domain"], r["tokens"]) for r in docs.select(*mixing.described(docs)).orderBy("doc_id").collect()]
    assert got == [("prose", 0), ("prose", 0), ("prose", 1), ("prose", 3), ("prose", 2), ("table", 3), ("loud", 1)]


def test_remixed_rows(spark):
    rng = random.Random(9)
    docs = frame(spark, [prose(rng, 20) for _ in range(60)] + AWKWARD, "copies nth whole")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs, percent=250).collect()}
    out = mixing.remixed(docs, percent=250)
    assert out.columns == docs.columns and {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == taken
    assert max(taken.values()) > 1
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.remixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.unionAll(docs), percent=100).groupBy("doc_id").agg(F.countDistinct("copies").alias("n")).where("n > 1").count() == 0


def test_rows_without_an_id_are_not_those_of_another(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s"), (-1, "d e f", "en", "s"), (None, "g h i", "en", "s")], "doc_id long, text string, lang string, source string")
    assert sorted((r["doc_id"] for r in mixing.mixed(docs, percent=100).collect()), key=str) == [-1, None, None]


def test_mix_matches_its_sql(spark, tmp_path):
    rng = random.Random(3)
    docs = frame(spark, [prose(rng, rng.randint(1, 50)) for _ in range(300)] + [None, ""], lang=[rng.choice(["en", "de", None]) for _ in range(302)], source=[rng.choice(["src0", "s1", "s2"]) for _ in range(302)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in mixing.op10_source_mix(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
    assert got == sorted(db.sql(mixing.OP10_SQL).fetchall())

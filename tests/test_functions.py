import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.errors import InvalidArgument
from lodestar.functions import codecs, resp
from lodestar.functions.distance import distance, exact, literal, rough


def scores(spark, a, b):
    row = spark.range(1).select(*(distance(m, literal(a), literal(b), checked=True).alias(m) for m in ("l2", "ip", "cosine"))).first()
    return tuple(row)


def test_distance_constants(spark):
    l2, ip, cos = scores(spark, [1, 2, 3, 4, 5], [5, 4, 3, 2, 1])
    assert (l2, ip) == (40, -35) and abs(cos - (1 - 35 / 55)) < 1e-12
    assert scores(spark, [0, 0, 0], [0, 0, 0]) == (0, 0, 1)
    with pytest.raises(Exception, match="dimensions differ"):
        scores(spark, [1, 2], [1])
    with pytest.raises(InvalidArgument):
        distance("hamming", F.col("a"), F.col("b"))


def test_column_and_matrix_distances_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 9)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>")
    for m in ("l2", "ip", "cosine"):
        got = [r[0] for r in df.orderBy("id").select(distance(m, F.col("v"), literal(x[3]))).collect()]
        want = exact(m, x.astype(float), np.broadcast_to(x[3].astype(float), x.shape))
        assert got == want.tolist()
        assert np.allclose(rough(m, x.astype(float), x[3:4].astype(float))[:, 0], want)


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("s"))).collect()]


def test_numbers_as_text(spark):
    given = ["0", "007", "18446744073709551615", "18446744073709551616", "+5", " 5", "5 ", "", "-1", "٣", None, "5\n"]
    want = [0, 7, 2**64 - 1] + [None] * 9
    assert [None if x is None else int(x) for x in column(spark, codecs.parse_uint64, given)] == want
    assert [codecs.text_uint64(x) for x in given if x is not None] == [w for w, x in zip(want, given) if x is not None]


def test_floats_as_text(spark):
    given = ["1", "-1.5", " 2", "2 ", ".5", "5.", "1e3", "1f", "1d", "1e400", "1e-50", "0e-99", "3.5e38", "", ".", "0x", "1e", None]
    want = [1, -1.5, 2, None, 0.5, 5, 1000, None, None, None, None, 0, None, None, None, None, None, None]
    assert column(spark, codecs.parse_float, given) == want
    assert [codecs.text_float(x) for x in given if x is not None] == want[:-1]
    assert codecs.text_float("0x1p3") == 8 and math.isnan(codecs.text_float("nan")) and codecs.text_float("-inf") == -math.inf


def test_hexadecimal_and_special_floats(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choices("0123456789abcDEF", k=n))
    given = ["0x1p3", "-0X.8", "0x1.", "0x", "0x.", "0x1p", "0x1p+", "0x1g", "0x0p9", "-0x0", "0x1p127", "0x1p128", "0x1p-126", "0x1p-127", "0x1p99999999999", "0x1p-99999999999", "1x1", "0x1e3", " 0xA", "0xA ", "+inf", "-Infinity", "INF", "infi", "nan", "-NaN(a_1)", "nan(", "nan(-)"]
    # just above, at and just below halfway between two floats
    given += ["0x1000001", "0x1000003", "0x100000100000000000000000001", "0x1000000ffffffffffffffffffff"]
    given += [f"{rng.choice(['', '-', '+'])}0x{digits(rng.randint(0, 12))}.{digits(rng.randint(1, 12))}p{rng.randint(-60, 60)}" for _ in range(300)]
    for x, value in zip(given, column(spark, codecs.parse_float, given), strict=True):
        want = codecs.text_float(x)
        if x == "0x100000100000000000000000001":  # the twin rounds twice, here to even
            want = float.fromhex("0x1.000002p104")
        assert repr(value) == repr(want), x


def test_vectors_as_text(spark):
    given = ["", "1,2", " 1 , 2 ", "1,2,", ",", "a", "1,,2", None]
    want = [[], [1, 2], [1, 2], None, None, None, None, None]
    assert column(spark, codecs.parse_vector_csv, given) == want
    assert [codecs.text_vector(x) for x in given if x is not None] == want[:-1]


def test_metrics_keys_words_and_formats(spark):
    assert column(spark, codecs.parse_metric, ["l2", "Ip", "inner_product", "INNERPRODUCT", "cosine", "x", None]) == ["l2", "ip", "ip", "ip", "cosine", None, None]
    with pytest.raises(InvalidArgument):
        codecs.text_metric("x")
    ids = spark.createDataFrame([(0,), (7,), (-1,), (-(2**63),)], "id long")
    assert [r[0] for r in ids.select(codecs.encode_id(F.col("id"))).collect()] == ["0" * 20, "7".zfill(20), str(2**64 - 1), str(2**63).zfill(20)]
    assert column(spark, codecs.split_inline, ["  a\tb  c ", "", "x"]) == [["a", "b", "c"], [], ["x"]]
    assert [codecs.float_text(x) for x in (0.1, 1e8, 100000, 1234567, 1e-7, -0.0)] == ["0.1", "1e+08", "100000", "1.23457e+06", "1e-07", "-0"]
    assert codecs.crc32c(b"123456789") == 0xE3069283
    assert spark.range(1).select(codecs.crc32c_of(F.lit(b"123456789"))).first()[0] == 0xE3069283


def test_protocol():
    assert resp.parse(b"*2\r\n$4\r\nPING\r\n+x\r\nrest") == ([b"PING", b"x"], 18)
    assert resp.parse(b"*2\r\n:-07\r\n$-1\r\n") == ([b"-7", b""], 15)
    assert resp.parse(b"VGET  a\t1\r\n") == ([b"VGET", b"a", b"1"], 11)
    for cut in (b"", b"*1\r\n", b"*1\r\n$4\r\nPI", b"PING", b"*1\r\n$4\r\nPING"):
        with pytest.raises(resp.NeedMore):
            resp.parse(cut)
    for bad, why in ((b"*x\r\n", "multibulk"), (b"*1\r\n$-2\r\n", "bulk length"), (b"*1\r\n-x\r\n", "unsupported"), (b"*1\r\n:x\r\n", "integer"), (b"*1\r\n$1\r\nabc", "CRLF"), (b"  \r\n", "empty")):
        with pytest.raises(resp.ProtocolError, match=why):
            resp.parse(bad)
    assert resp.encoded(["a", 1, [], None, resp.Simple("OK"), resp.Failure("ERR x")]) == b"*6\r\n$1\r\na\r\n:1\r\n*0\r\n$-1\r\n+OK\r\n-ERR x\r\n"
    assert resp.shown([1, ["a", resp.Failure("no")]]) == "1) 1\n2) \n  1) a\n  2) (error) no"


def test_parse_of_cut_input_never_misreads():
    rng = random.Random(3)
    for _ in range(200):
        args = [bytes(rng.choices(b"ab\r\n$*:1", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 4))]
        data = resp.encoded([a for a in args])
        assert resp.parse(data) == (args, len(data))
        with pytest.raises(resp.NeedMore):
            resp.parse(data[: rng.randrange(len(data))])

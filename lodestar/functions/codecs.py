"""Text forms of ids, numbers, metrics and vectors: native columns, and Python twins where a driver-side call needs one."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.errors import InvalidArgument

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: names of metrics
METRIC_NAMES = {"L2": "l2", "IP": "ip", "INNER_PRODUCT": "ip", "INNERPRODUCT": "ip", "COSINE": "cosine"}

FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
HEX_FLOAT = r"\A[+-]?0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]+))?\z"
INFINITE, NOT_A_NUMBER = r"(?i)\A[+-]?inf(?:inity)?\z", r"(?i)\A[+-]?nan(?:\([a-z0-9_]*\))?\z"
LEAST_NORMAL = 1.1754943508222875e-38  # of a float; what rounds to less overflows downwards
SPACE = r"[\x20\t\n\x0B\f\r]"


def upper_ascii(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def parse_uint64(s: Column) -> Column:
    """decimal(20,0) of a string of digits alone, null if it is anything else or over 2^64 - 1."""
    value = F.when(s.rlike(r"\A[0-9]+\z"), F.ltrim(F.concat(F.regexp_replace(s, r"\A0+(?=[0-9])", ""))))
    number = F.when(F.length(value) <= 20, value).try_cast("decimal(20,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def hex_double(text: Column) -> Column:
    """The size of a hexadecimal float, in double: 13 digits exactly, and half a unit if any later one is not 0, so that a float rounds right."""
    fraction, power = F.regexp_extract(text, HEX_FLOAT, 2), F.regexp_extract(text, HEX_FLOAT, 3)
    digits = F.regexp_replace(F.concat(F.regexp_extract(text, HEX_FLOAT, 1), fraction), r"\A0+", "")
    head = F.coalesce(F.conv(F.substring(digits, 1, 13), 16, 10).cast("double"), F.lit(0.0))
    head = head + F.when(F.regexp_replace(digits, r"\A.{1,13}", "").rlike("[^0]"), 0.5).otherwise(0.0)
    exponent = 4 * F.greatest(F.length(digits) - 13, F.lit(0)) - 4 * F.length(fraction) + F.coalesce(power.try_cast("double"), F.lit(0.0))
    return F.when(digits == "", 0.0).otherwise(head * F.pow(F.lit(2.0), exponent))


def parse_float(s: Column) -> Column:
    """float of a whole string, null if malformed or out of a float's range, either way.

    White space may stand before the number. Decimal and hexadecimal numbers, inf and nan are taken.
    """
    text = F.regexp_replace(s, rf"\A{SPACE}+", "")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    number = F.when(text.rlike(rf"\A{FLOAT}\z"), text.try_cast("double")).when(text.rlike(HEX_FLOAT), sign * hex_double(text))
    zero = text.rlike(r"\A[+-]?0*\.?0*(?:[eE][+-]?[0-9]+)?\z") | text.rlike(r"\A[+-]?0[xX]0*\.?0*(?:[pP][+-]?[0-9]+)?\z")
    single = number.cast("float")
    fits = (F.abs(single) < F.lit(float("inf")).cast("float")) & (zero | (F.abs(number) >= LEAST_NORMAL))
    word = F.when(text.rlike(INFINITE), sign * float("inf")).when(text.rlike(NOT_A_NUMBER), float("nan"))
    return F.when(fits, single).otherwise(word.cast("float"))


def parse_metric(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, metric in METRIC_NAMES.items():
        out = F.when(upper_ascii(s) == name, F.lit(metric)).otherwise(out)
    return out


def parse_vector_csv(s: Column) -> Column:
    """array<float>, null if any token is malformed. The empty string is the empty vector."""
    parts = F.transform(F.split(s, ","), lambda x: parse_float(F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")))
    return F.when(s == "", F.array().cast("array<float>")).when(~F.exists(parts, lambda x: x.isNull()), parts)


def encode_id(id_: Column) -> Column:
    """20 digits, so that text order is number order; negative longs stand for ids of 2^63 and more."""
    wide = id_.cast("decimal(20,0)") + F.when(id_ < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return F.lpad(wide.cast("decimal(20,0)").cast("string"), 20, "0")


def record_key(index: Column, id_: Column) -> Column:
    return F.concat(F.lit("record:"), index, F.lit(":"), encode_id(id_))


def split_inline(s: Column) -> Column:
    """Words of a line between blanks and tabs."""
    return F.regexp_extract_all(s, F.lit(r"([^ \t]+)"), 1)


def float_text(x: float) -> str:
    """Six significant digits, as C++ streams print a float."""
    return f"{np.float32(x):.6g}"


@F.pandas_udf(T.StringType())
def format_float(x: pd.Series) -> pd.Series:
    return x.map(float_text, na_action="ignore")


CASTAGNOLI = 0x82F63B78


def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


CRC_TABLE = crc_table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = CRC_TABLE[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    return data.map(lambda b: crc32c(bytes(b)), na_action="ignore").astype("Int64")


def text_uint64(s: str) -> int | None:
    if re.fullmatch("[0-9]+", s, re.ASCII) and len(s.lstrip("0")) <= 20 and int(s) < 1 << 64:
        return int(s)
    return None


def text_float(s: str) -> float | None:
    """A float as the C library reads it: decimal, hexadecimal, inf or nan, the whole string, in range."""
    body = s.lstrip(" \t\n\v\f\r")
    try:
        if re.fullmatch(FLOAT, body, re.ASCII):
            value = float(body)
        elif re.fullmatch(r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?", body, re.ASCII):
            value = float.fromhex(body)
        elif re.fullmatch(r"[+-]?(?:inf(?:inity)?|nan(?:\([A-Za-z0-9_]*\))?)", body, re.ASCII | re.IGNORECASE):
            return float(re.sub(r"\(.*", "", body))
        else:
            return None
    except OverflowError:
        return None
    with np.errstate(over="ignore"):
        single = float(np.float32(value))
    if math.isinf(single) or (value == 0 and re.search("[1-9a-fA-F]", re.split("[pP]" if "x" in body.lower() else "[eE]", body.lower().replace("0x", "", 1))[0])) or 0 < abs(value) < LEAST_NORMAL:
        return None
    return single


def text_vector(s: str) -> list[float] | None:
    if not s:
        return []
    out = [text_float(x.strip(" \t\n\v\f\r")) for x in s.split(",")]
    return None if None in out else out


def text_metric(s: str) -> str:
    metric = METRIC_NAMES.get(s.translate(str.maketrans(LOWER, UPPER)))
    if metric is None:
        raise InvalidArgument(f"unknown metric: {s}")
    return metric


def words(line: str) -> Iterator[str]:
    return (m[0] for m in re.finditer(r"[^ \t]+", line))

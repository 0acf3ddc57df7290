"""Options, their defaults and the schemas of stored tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from lodestar.errors import InvalidArgument

METRICS = ("l2", "ip", "cosine")


@dataclass(frozen=True)
class ReadOptions:
    """Taken with every read. Parquet pages are always checked as far as their writer summed them, and nothing is cached: no effect."""

    verify_checksums: bool = False
    fill_cache: bool = True


@dataclass(frozen=True)
class WriteOptions:
    """Taken with every change. A change is in a committed manifest before its call returns, with `sync` or without."""

    sync: bool = False


@dataclass(frozen=True)
class IndexOptions:
    """Fixed when an index is made. `allow_replace_deleted` is stored and has no effect."""

    dimension: int
    metric: str = "l2"
    max_degree: int = 32
    ef_construction: int = 200
    allow_replace_deleted: bool = False

    def check(self) -> IndexOptions:
        if self.dimension <= 0:
            raise InvalidArgument("index dimension must be greater than zero")
        if self.metric not in METRICS:
            raise InvalidArgument(f"unknown metric: {self.metric}")
        if self.max_degree <= 0 or self.ef_construction <= 0:
            raise InvalidArgument("max_degree and ef_construction must be greater than zero")
        return self

    def as_row(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class SearchOptions:
    """`mode` exact scans all records; graph walks the neighbour graph with a beam of max(ef_search, top_k)."""

    top_k: int = 10
    ef_search: int = 50
    include_payload: bool = False
    mode: str = "exact"

    def check(self) -> SearchOptions:
        if self.top_k <= 0:
            raise InvalidArgument("top_k must be greater than zero")
        if self.mode not in ("exact", "graph"):
            raise InvalidArgument(f"unknown search mode: {self.mode}")
        return self

    @property
    def beam(self) -> int:
        return max(self.ef_search, self.top_k)


RECORDS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("payload", T.StringType(), True),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("payload", T.StringType(), True),
])

NODES = "id long, level int"
EDGES = "layer int, src long, dst long, distance double"

"""Distances as native columns. All arithmetic is in double and in element order; smaller is nearer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.errors import InvalidArgument


def folded(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return folded(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    """Negated dot product."""
    return -folded(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """One less the cosine; exactly 1 if either vector has no length."""
    na, nb = folded(a, a, lambda x, y: x * y), folded(b, b, lambda x, y: x * y)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - folded(a, b, lambda x, y: x * y) / F.sqrt(na * nb))


BY_METRIC = {"l2": l2, "ip": inner_product, "cosine": cosine}


def distance(metric: str, a: Column, b: Column, checked: bool = False) -> Column:
    """The distance of two array columns. With `checked`, vectors of different length raise; else they must not occur."""
    if metric not in BY_METRIC:
        raise InvalidArgument(f"unknown metric: {metric}")
    out = BY_METRIC[metric](a, b)
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("vector dimensions differ"))) if checked else out


def literal(vector: list[float]) -> Column:
    """A vector as a constant column of doubles, each the float nearest to the number given."""
    return F.array(*(F.lit(float(x)) for x in np.asarray(vector, np.float32)))


def in_order(values: np.ndarray) -> np.ndarray:
    """Sums along the last axis from left to right, as the columns above take them."""
    return np.cumsum(values, axis=-1)[..., -1] if values.shape[-1] else np.zeros(values.shape[:-1])


def exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows of two double matrices, equal to the columns' to the last bit."""
    if metric == "l2":
        return in_order((a - b) * (a - b))
    dot = in_order(a * b)
    if metric == "ip":
        return -dot
    na, nb = in_order(a * a), in_order(b * b)
    none = (na == 0) | (nb == 0)
    return np.where(none, 1.0, 1 - dot / np.sqrt(np.where(none, 1.0, na * nb)))


def rough(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b by matrix products, good to about 1e-9 of their size."""
    dot = a @ b.T
    if metric == "ip":
        return -dot
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if metric == "l2":
        return na[:, None] + nb[None, :] - 2 * dot
    size = np.sqrt(na[:, None] * nb[None, :])
    return np.where(size == 0, 1.0, 1 - dot / np.where(size == 0, 1.0, size))

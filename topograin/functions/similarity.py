"""Similarities: containment, edit distance with transpositions, geography, vectors."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.0088


def containment(query: Column, name: Column) -> Column:
    """Share of the longer string that the shorter, contained in it regardless of case, makes;
    null if neither contains the other."""
    q, n = F.lower(query), F.lower(name)
    return F.when(n.contains(q), F.try_divide(F.length(query), F.length(name))).when(q.contains(n), F.try_divide(F.length(name), F.length(query)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null for coordinates out of range."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    valid = (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90) & (F.abs(lon1) <= 180) & (F.abs(lon2) <= 180)
    return F.when(valid, F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gram_vector(name: Column, size: int = 64, grams: int = 3) -> Column:
    """A string as counts of its hashed character grams, of unit length; what no vectors have been
    trained for can be matched by these."""
    padded = F.concat(F.lit("#"), F.lower(name), F.lit("#"))
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (grams - 1))), lambda i: F.pmod(F.xxhash64(padded.substr(i, F.lit(grams))), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / norm)


def osa_distance(a: str, b: str) -> int:
    """Edits, with swaps of neighbours that are not edited again, between two strings."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        two, one = one, row
    return one[-1]


def osa_distances(a: str, others: list[str]) -> np.ndarray:
    """osa_distance of a to each of others, all at once: a row of the table a step."""
    sizes = np.array([len(b) for b in others], np.int64)
    width = int(sizes.max(initial=0))
    codes = np.full((width, len(others)), -1, np.int32)
    for k, b in enumerate(others):
        codes[: len(b), k] = [ord(c) for c in b]
    steps = np.arange(width + 1, dtype=np.int32)[:, None]
    two, one, before = None, np.broadcast_to(steps, (width + 1, len(others))), None
    for i, x in enumerate(map(ord, a), 1):
        same = codes == x
        row = np.empty((width + 1, len(others)), np.int32)
        row[0] = i
        row[1:] = np.minimum(one[1:] + 1, one[:-1] + ~same)
        if two is not None:
            swapped = same[:-1] & (codes[1:] == before)
            row[2:] = np.where(swapped, np.minimum(row[2:], two[:-2] + 1), row[2:])
        # insertions: each cell is at most one more than the cell before it
        row = np.minimum.accumulate(row - steps, axis=0) + steps
        two, one, before = one, row, x
    return one[sizes, np.arange(len(others))]


def osa_similarity(a: str, b: str) -> float:
    """1 less the distance over the longer length, regardless of case; the quotient is rounded
    to a 32-bit float, as stored similarities are."""
    a, b = a.lower(), b.lower()
    return 1.0 - float(np.float32(osa_distance(a, b) / max(len(a), len(b), 1)))


@F.pandas_udf(DoubleType())
def osa_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: str, b: str) -> int:
    """Share in percent, rounded, of both strings in their longest common subsequence."""
    if not a and not b:
        return 100
    one = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(one[j - 1] + 1 if x == y else max(one[j], row[-1]))
        one = row
    return round(200 * one[-1] / (len(a) + len(b)))

"""Edit distances that the engine has no built-in for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def deletes(word: str, distance: int) -> set[str]:
    """The word and all that is left of it after up to ``distance`` letters are taken out."""
    found = {word}
    edge = {word}
    for _ in range(distance):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found |= edge
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def deletes_of(words: pd.Series, distances: pd.Series) -> pd.Series:
    return pd.Series([sorted(deletes(w, int(d))) if w is not None else None for w, d in zip(words, distances, strict=True)])

"""Delta coding of ascending integer arrays, and the text form of an index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta_encoded(values: Column) -> Column:
    """The first value, then each difference; null stays null, empty stays empty."""
    previous = F.concat(F.array(F.lit(0)), values)
    return F.transform(values, lambda x, i: x - F.get(previous, i).cast("int"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def delta_decoded(values: pd.Series) -> pd.Series:
    """Running sums, linear in the length of the array; null stays null."""
    return values.map(lambda v: None if v is None else np.cumsum(np.asarray(v, dtype=np.int64)).astype(np.int32))

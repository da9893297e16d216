"""A user-defined aggregate in Pandas, for aggregates no built-in covers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def grouped(function: Callable[[pd.Series], float], returns: str = "double") -> Callable[[str], Column]:
    """Turn a function of a group's values into an aggregate.

    A group is handed over whole, nulls included, so use it on groups that are small by nature (a window of a sensor); a
    built-in aggregate combines before the shuffle and should be preferred. Groups are collected by Spark and go to a worker
    many at a time.
    """

    def aggregate(groups: pd.Series) -> pd.Series:
        return pd.Series([function(pd.Series(values)) for values in groups], dtype=object)

    applied = pandas_udf(aggregate, returns)

    def column(name: str) -> Column:
        held = F.collect_list(F.struct(F.col(name).alias("value")))  # a list of plain values would lose its nulls
        return applied(F.transform(held, lambda row: row["value"]))

    return column

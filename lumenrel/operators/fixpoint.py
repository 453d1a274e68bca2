"""Semi-naive fix-points on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrel.plans import errors
from lumenrel.plans.query import Query
from lumenrel.plans.storage import materialised


def _missing(new: DataFrame, known: DataFrame) -> DataFrame:
    on = None
    right = known.select(*(F.col(f"`{n}`").alias(f"__r_{n}") for n in new.columns))
    for n in new.columns:
        same = F.col(f"`{n}`").eqNullSafe(F.col(f"`__r_{n}`"))
        on = same if on is None else on & same
    return new.join(right, on, "left_anti")


def iterate(seed: Query, step: Callable[[Query, Query], Query], rounds: int = 1_000_000) -> Query:
    """step(all, new) until it gives nothing new. The seed keeps its duplicates, derived rows come once. The result is a bag.

    Each round is written to shared storage, so that a round's plan has that round's joins only and a lost executor costs one round.
    """
    seed = seed.elements().unorder()
    every = materialised(seed.df.select(*(f"`{n}`" for n in seed.names)), "iterate")
    new = every
    for _ in range(rounds):
        made = step(replace(seed, df=every), replace(seed, df=new))
        made = seed._aligned(made).unorder().df.select(*(f"`{n}`" for n in seed.names)).distinct()
        new = materialised(_missing(made, every), "iterate")
        if new.isEmpty():
            break
        every = every.unionByName(new)
    else:
        raise errors.Error(f"no fix-point after {rounds} rounds")
    return replace(seed, df=every)

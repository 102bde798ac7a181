"""Small helpers that keep the optimizer from repeating costly expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Evaluate ``cols`` once per row, here.

    A later filter on a computed column is otherwise pushed below its
    projection with the whole expression copied into it, which evaluates it
    twice and can outgrow one generated method. Filters on a generator's
    output stay above it, so the columns pass through a one-element one.
    """
    cols = list(cols)
    rest = [c for c in df.columns if c not in cols]
    d = df.select(*rest, F.explode_outer(F.array(F.struct(*cols))).alias("_pinned"))
    return d.select(*rest, *[F.col(f"_pinned.{c}").alias(c) for c in cols])

"""Work beside the columns of a table, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """Those of the named columns that ``docs`` has, and its rows as the struct
    ``_row``: columns added to these clash with none of ``docs``."""
    return docs.select(*[F.col(n) for n in names if n in docs.columns], F.struct("*").alias(ROW))


def back(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that ``aside`` put away, with ``new`` ones in place of some."""
    return df.select(*[new[c].alias(c) if c in new else F.col(ROW).getField(c).alias(c) for c in columns])


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that reach ``most`` in sum; no row is cut."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        end = min(int(np.searchsorted(upto, before + most)) + 1, len(sizes))
        yield at, end
        at = end

"""Name a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    What a lambda takes from outside is computed anew for every element; as a
    lambda's own variable it is not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))

"""The gain of a move in whole numbers: same sign and order as the change of modularity, exact in any order of sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = (1 << 63) - 1


def gain_numerator(m2: int, w_to, w_from, d, d_from, d_to, num: int = 1, den: int = 1) -> Column:
    """den * M * (w_to - w_from) + num * d * (D_from - d - D_to), with M twice the total weight, gamma = num / den."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.lit(den * m2) * (c(w_to) - c(w_from)) + F.lit(num) * c(d) * (c(d_from) - c(d) - c(d_to))


def fits(m2: int, num: int, den: int) -> bool:
    """Whether no gain of such a graph can leave 64 bits."""
    return 2 * max(num, den) * m2 * m2 <= LARGEST
